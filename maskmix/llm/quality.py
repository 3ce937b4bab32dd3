"""Host-level quality rules (DataFrame operations only).

Every document is judged by text rules; failures are aggregated by host (here the source), each host's failure
rate is shrunk by a beta prior fitted to all hosts by the method of moments, and the host's verdict is joined
back to its documents. Counting is a partial aggregate, so a hot host is a few rows per task. Verdicts come back by
broadcast: those of the hosts with more than a ``SHARE``-th of all documents, of which there are fewer than
``SHARE``, and the rejections of the other hosts if they are ``FEW`` at most. More rejections than that are joined
by host, with the documents of the large hosts dealt out over many keys, so no key holds more than a ``SHARE``-th of
the rows; texts are only shuffled there.

Defined cases: null or empty text has no words and fails; a null host is a host of its own; ties and repeated
rows are judged alike, row by row; an empty table gives no rows; other columns are carried along, whatever their
names, but columns named like the results are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskmix.llm.common import WORD, documents, let, packed, save, unpacked

SYMBOLS = r"[#*$%&|<>]"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Words of a window, and the limits of the rules.
WINDOW, LEAST_WORDS, REPEAT_PERCENT, SYMBOL_PERCENT, DUP_LINE_PERCENT = 5, 10, 20, 10, 30
#: A host is rejected when its shrunk failure rate is above this.
HOST_LIMIT = 0.6
#: Large hosts have more than this share of the documents; rejections that are broadcast; keys of a large host's rows.
SHARE, FEW, DEALT = 10_000, 100_000, 1024


def _repeated(words):
    """Words in windows found twice or more. Distinct hashes prove that no window repeats; the rest compare strings."""
    n = F.size(words) - (WINDOW - 1)
    starts = F.sequence(F.lit(0), n - 1)
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))
    clean = let(hashes, lambda h: F.size(F.array_distinct(h)) == F.size(h))
    grams = F.array_sort(F.transform(starts, lambda i: F.struct(F.array_join(F.slice(words, i + 1, WINDOW), " ").alias("g"), i.alias("p"))))

    def positions(g):
        same = lambda j, k: F.coalesce(F.get(g, j)["g"] == F.get(g, k)["g"], F.lit(False))
        at = F.filter(F.sequence(F.lit(0), F.size(g) - 1), lambda j: same(j, j - 1) | same(j, j + 1))
        return F.array_sort(F.transform(at, lambda j: F.get(g, j)["p"]))

    step = lambda acc, p: F.struct((acc["n"] + F.least(F.lit(WINDOW), p + WINDOW - acc["end"])).alias("n"), (p + WINDOW).alias("end"))
    covered = F.aggregate(let(grams, positions), F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("end")), step, lambda acc: acc["n"])
    return F.when(n < 2, F.lit(0)).when(clean, F.lit(0)).otherwise(covered)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus the five measures."""
    rows = packed(docs, body=F.coalesce(F.col(text), F.lit("")))
    lines = F.filter(F.split("body", "\n"), lambda x: x.rlike(WORD))
    values = let(
        F.regexp_extract_all("body", F.lit(WORD), F.lit(0)),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeated(w).cast("long").alias("n_repeat_words")),
    )
    rest = F.struct(F.regexp_count("body", F.lit(SYMBOLS)).cast("long").alias("n_symbols"), let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))
    rows = rows.select("row", values.alias("v"), rest.alias("r"))
    return rows.select(*unpacked(rows, MEASURES), *[F.col("r" if c in ("n_symbols", "n_dup_lines") else "v").getField(c).alias(c) for c in MEASURES])


def judge(measured: DataFrame) -> DataFrame:
    """``base_failed`` by length and repetition, and ``rule_failed`` by any rule."""
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    more = (100 * F.col("n_symbols") > SYMBOL_PERCENT * F.col("word_chars")) | (100 * F.col("n_dup_lines") > DUP_LINE_PERCENT * F.col("n_words"))
    return measured.withColumn("base_failed", base).withColumn("rule_failed", F.col("base_failed") | more)


def host_verdicts(judged: DataFrame, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """One row per host: documents, failures, shrunk rate, ``host_ok``. The prior is one row, joined by broadcast."""
    hosts = judged.groupBy(F.col(host).isNull().alias("_null"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("_host"))
    hosts = hosts.agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("rule_failed").cast("long")).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    prior = hosts.agg(F.avg(rate).alias("m"), F.var_pop(rate).alias("v"))
    strength = F.when(F.col("v") > 0, F.greatest(F.lit(1.0), F.least(F.lit(1000.0), F.col("m") * (1 - F.col("m")) / F.col("v") - 1))).otherwise(F.lit(1000.0))
    hosts = hosts.join(F.broadcast(prior.withColumn("k", strength)))
    hosts = hosts.withColumn("shrunk_rate", (F.col("n_failed") + F.col("m") * F.col("k")) / (F.col("n_docs") + F.col("k")))
    return hosts.withColumn("host_ok", F.col("shrunk_rate") <= limit).select("_null", "_host", "n_docs", "n_failed", "shrunk_rate", "host_ok")


def with_verdict(judged: DataFrame, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """``judged`` plus ``kept``."""
    verdicts = save(host_verdicts(judged, host, limit))
    total = verdicts.agg(F.coalesce(F.sum("n_docs"), F.lit(0))).first()[0]
    name = F.when(~F.col("_null"), F.col("_host")).alias("host")
    large = verdicts.where(F.col("n_docs") * SHARE > total).select(name, F.col("host_ok").alias("large_ok"))
    small = verdicts.where((F.col("n_docs") * SHARE <= total) & ~F.col("host_ok")).select(name.alias("bad_host"), F.lit(True).alias("bad"))
    rows = packed(judged.drop("kept"), own=F.col(host).cast("string"), failed=F.col("base_failed"))
    rows = rows.join(F.broadcast(large), F.col("own").eqNullSafe(F.col("host")), "left").drop("host")
    same = F.col("own").eqNullSafe(F.col("bad_host"))
    if small.limit(FEW + 1).count() <= FEW:
        rows = rows.join(F.broadcast(small), same, "left")
    else:
        # Rows of large hosts have their verdict: they get keys that match nothing.
        dealt = F.when(F.col("large_ok").isNull(), F.lit(0)).otherwise(1 + F.pmod(F.xxhash64(F.struct("row")), F.lit(DEALT)))
        rows = rows.withColumn("dealt", dealt).join(small.withColumn("none", F.lit(0)).hint("merge"), same & (F.col("dealt") == F.col("none")), "left")
    good = F.coalesce("large_ok", ~F.col("bad"), F.lit(True))
    return rows.select(*unpacked(rows), (~F.col("failed") & good).alias("kept"))


def keep_good(docs: DataFrame, text: str = "text", host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """The documents that stay, with their own columns."""
    rows = packed(docs, text=F.col(text), host=F.col(host))
    judged = save(judge(measure(rows)).select("row", "host", "base_failed", "rule_failed"))
    kept = with_verdict(judged, "host", limit).where("kept")
    return kept.select(*unpacked(kept))


def op6_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = save(judge(measure(documents(spark, sf_dir).select("doc_id", "text", "source"))).drop("text"))
    return with_verdict(judged).select("doc_id", *MEASURES, "base_failed", "kept")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT r, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
f AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
p AS (SELECT r, least(5, i - coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), -9)) AS n FROM f),
q AS (SELECT r, sum(n)::BIGINT AS n_repeat_words FROM p GROUP BY r),
m AS (SELECT doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN q USING (r)),
j AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
a AS (SELECT *, base_failed OR 100 * n_symbols > 10 * word_chars OR 100 * n_dup_lines > 30 * n_words AS rule_failed FROM j),
h AS (SELECT source, count(*)::DOUBLE AS n, sum(rule_failed::INT)::DOUBLE AS f FROM a GROUP BY source),
b AS (SELECT avg(f / n) AS m, var_pop(f / n) AS v FROM h),
k AS (SELECT m, CASE WHEN v > 0 THEN greatest(1::DOUBLE, least(1000::DOUBLE, m * (1 - m) / v - 1)) ELSE 1000::DOUBLE END AS k FROM b),
v AS (SELECT source, (f + m * k) / (n + k) <= 0.6::DOUBLE AS ok FROM h, k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND ok AS kept FROM a JOIN v ON a.source IS NOT DISTINCT FROM v.source
"""
