"""URL rules by a bit-parallel wildcard automaton.

All glob rules are packed into one bit vector of 64-bit words. A rule of m symbols has m + 1 states; ``*`` is a
loop on a state. One step of Shift-And per symbol of the canonical URL moves every rule at once, for a whole
batch of URLs: D = ((D << 1) & B[symbol]) | (D & loops), with carries between words.

The canonical URL is ``.`` + host + ``#`` + path: ``#`` occurs in neither, so ``*.net#/*`` is the host ``net``, its
subdomains and paths that start with ``/``. Globs know ``*`` and ``?``; other symbols stand for themselves.

Defined cases: null urls and urls without ``://`` have an empty host and path; ties between rules of a length go
to the earlier rule; repeated rows are judged alike; an empty table gives no rows. Long urls cost a step per
symbol, in the rows that still have symbols. ``judge`` carries unknown columns along and replaces columns named
like its results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: (verdict, rule) as host and path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: (verdict, glob) over the canonical URL, for urls that no rule fits; the first that fits decides.
GLOBS = (("block", "*spam*#*"), ("block", "*cheap-*#*"), ("block", "*.casino?.*#*"), ("block", "*#*/pills*"))


def rule_glob(rule: str) -> str:
    host, slash, path = rule.partition("/")
    return f"*.{host}#{slash}{path}*"


class Automaton:
    def __init__(self, globs: list[str]):
        self.alphabet = np.array(sorted({ord(c) for g in globs for c in g if c not in "*?"}), dtype=np.uint32)
        start = loops = final = 0
        symbols = [0] * (len(self.alphabet) + 1)  # the last is any other symbol
        at = 0
        self.finals = []
        for g in globs:
            start |= 1 << at
            for c in g:
                if c == "*":
                    loops |= 1 << at
                    continue
                at += 1
                for i in range(len(symbols)) if c == "?" else (int(np.searchsorted(self.alphabet, ord(c))),):
                    symbols[i] |= 1 << at
            self.finals.append(at)
            final |= 1 << at
            at += 1
        self.words = (at + 63) // 64
        self.start, self.loops = self._pack(start), self._pack(loops)
        self.symbols = np.stack([self._pack(s) for s in symbols])

    def _pack(self, bits: int) -> np.ndarray:
        return np.array([bits >> (64 * i) & (1 << 64) - 1 for i in range(max(1, self.words))], dtype=np.uint64)

    def match(self, urls: list[str]) -> np.ndarray:
        """Boolean array of urls by globs. Longest urls come first, so the rows still running are a prefix."""
        n = len(urls)
        lengths = np.fromiter(map(len, urls), np.int64, n)
        order = np.argsort(-lengths, kind="stable")
        points = np.frombuffer("".join(urls).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        index = np.searchsorted(self.alphabet, points)
        known = self.alphabet[np.minimum(index, len(self.alphabet) - 1)] == points if len(self.alphabet) else np.zeros(len(points), bool)
        index = np.where(known, index, len(self.alphabet))
        begin = (np.cumsum(lengths) - lengths)[order]
        left = lengths[order]
        state = np.tile(self.start, (n, 1))
        for j in range(int(left[0]) if n else 0):
            live = int(np.searchsorted(-left, -j, side="left"))
            d = state[:live]
            moved = d << np.uint64(1)
            moved[:, 1:] |= d[:, :-1] >> np.uint64(63)
            state[:live] = moved & self.symbols[index[begin[:live] + j]] | d & self.loops
        found = np.zeros((n, len(self.finals)), bool)
        for k, f in enumerate(self.finals):
            found[order, k] = (state[:, f // 64] >> np.uint64(f % 64) & np.uint64(1)).astype(bool)
        return found


def split_url(url: str | None) -> tuple[str, str]:
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    ends = [i for c in "/?#" if (i := rest.find(c)) >= 0]
    cut = min(ends, default=len(rest))
    stop = min([i for c in "?#" if (i := rest.find(c, cut)) >= 0], default=len(rest))
    host = rest[:cut]
    return (host.lower() if host.isascii() else "".join(c.lower() if "A" <= c <= "Z" else c for c in host)), rest[cut:stop]


def judge(df: DataFrame, url: str = "url", rules=RULES, globs=GLOBS) -> DataFrame:
    """``df`` plus ``host, path, rule, verdict``."""
    names = ("host", "path", "rule", "verdict")
    ranked = sorted(range(len(rules)), key=lambda i: -len(rules[i][1]))
    patterns = [rule_glob(rules[i][1]) for i in ranked] + [g for _, g in globs]
    verdicts = [rules[i][0] for i in ranked] + [v for v, _ in globs] + ["allow"]
    fits = [rules[i][1] for i in ranked] + [None] * (len(globs) + 1)
    schema = T.StructType([f for f in df.schema.fields if f.name not in names] + [T.StructField(c, T.StringType()) for c in names])

    def run(batches):
        automaton = Automaton(patterns)
        for batch in batches:
            parts = [split_url(u) for u in batch.column(url).to_pylist()]
            found = automaton.match([f".{h}#{p}" for h, p in parts])
            first = np.where(found.any(axis=1), found.argmax(axis=1), len(patterns)) if parts and patterns else np.full(len(parts), len(patterns))
            made = [[h for h, _ in parts], [p for _, p in parts], [fits[i] for i in first], [verdicts[i] for i in first]]
            keep = [c for c in batch.schema.names if c not in names]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *[pa.array(m, pa.string()) for m in made]], [*keep, *names])

    return df.mapInArrow(run, schema)


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.col("url"))).select("page_id", "host", "path", "rule", "verdict")


_AFTER = "CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END"
ORACLE = rf"""
WITH a AS (SELECT page_id, coalesce({_AFTER}, '') AS r FROM pages),
b AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
f AS (SELECT *, (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') AS n, (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') AS e,
    (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') AS c, (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') AS o FROM b)
SELECT page_id, host, path, CASE WHEN e THEN 'example.net/en/' WHEN c THEN 'example.com/de/' WHEN o THEN 'org/fr/' WHEN n THEN 'net/' END AS rule,
    CASE WHEN e THEN 'allow' WHEN c THEN 'block' WHEN o THEN 'allow' WHEN n THEN 'block'
    WHEN contains(host, 'spam') OR contains(host, 'cheap-') OR regexp_matches('.' || host, '\.casino.\.') OR contains(path, '/pills') THEN 'block' ELSE 'allow' END AS verdict FROM f
"""
