"""Repeated passages against brute force; shards, hot anchors and many words."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from maskmix.llm import repeats

SCHEMA = "doc_id long, text string, source string"


def brute(rows):
    """``(doc_id, words, kept words)`` of each row."""
    least = {}
    split = [(d, (t or "").encode().split()) for d, t, *_ in rows]
    for d, w in split:
        if d is not None:
            for i in range(len(w) - 12):
                g = tuple(w[i : i + 13])
                least[g] = min(d, least.get(g, d))
    out = Counter()
    for d, w in split:
        gone = {i + k for i in range(len(w) - 12) if d is not None and least[tuple(w[i : i + 13])] < d for k in range(13)}
        out[d, len(w), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()] += 1
    return out


def corpus():
    r = np.random.default_rng(0)
    words = lambda n, k: " ".join(f"v{i}" for i in r.integers(0, k, n))
    shared = [words(n, 10_000) for n in (13, 14, 60, 200)]
    common = "one two three four five six"  # six frequent words between passages that differ
    rows = []
    for i in range(220):
        parts = [words(r.integers(0, 30), 10_000)]
        for _ in range(r.integers(0, 4)):
            s = shared[r.integers(0, 4)].split()
            a = r.integers(0, max(1, len(s) - 12))
            parts += [" ".join(s[a : a + r.integers(12, 70)]), words(r.integers(0, 3), 10_000)]
        parts += [f"{words(0, 1)} l{i % 40} m{i % 40} n{i % 40} o{i % 40} {common} p{i % 40} q{i % 40} s{i % 40} t{i % 40} u{i % 40}", words(25, 3)]
        rows.append((int(r.integers(0, 150)) if i % 11 else None, "  ".join(parts).replace(" v1", "\n\tv1"), "s"))
    return rows + [(900, "aé " * 300, "s"), (901, "aé " * 40, "s"), (902, "x" * 300_000 + " " + shared[3], "s"), (3, None, "s"), (3, "", "s"), rows[1], rows[1]]


@pytest.mark.parametrize("hot", [False, True])
def test_remove_equals_brute_force(spark, monkeypatch, hot):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(6)
    # Names of the operator's own columns, and of its results.
    docs = docs.withColumns({"_row": F.lit("a"), "row": F.lit(1), "doc": F.lit(2), "key": F.lit(3), "starts": F.lit(4), "n_words": F.lit("x"), "_text": F.lit(5)})
    if hot:
        monkeypatch.setattr(repeats, "hot_hashes", lambda found, share=0, own=repeats.hot_hashes: own(found, 10**9))
    got = repeats.remove(docs, kept_text="kept")
    assert [c for c in docs.columns if c != "n_words"] == got.columns[: len(docs.columns) - 1]
    assert Counter((r.doc_id, r.n_words, r.kept) for r in got.collect()) == brute(rows)


def test_hot_anchors_are_few(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA)

    def of(data, offsets):
        h, row, *_ = repeats.anchors(data, offsets)
        return h, row

    found = repeats.recurring(docs.select("doc_id", "text"), 12, of)
    assert 0 < len(repeats.hot_hashes(found, 50)) <= 50 and len(repeats.hot_hashes(found.limit(0))) == 0


def test_shards_and_many_words(monkeypatch):
    """Small shards, and windows of numbers instead of letters, report alike."""
    r = np.random.default_rng(2)
    rows = []
    for k in range(300):
        words = " ".join(f"v{i}" for i in r.integers(0, 6, r.integers(13, 20)))
        ids = np.sort(r.integers(0, 50, r.integers(1, 4)))
        rows.append((k // 3, words.encode(), ids.tobytes(), (1000 + ids).tobytes(), np.arange(len(ids), dtype=np.int32).tobytes()))
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["anchor", "words", "docs", "rows", "starts"])

    def found():
        return sorted(tuple(x) for merged in repeats._shards([batch]) for f in repeats._find(merged) for x in zip(*f, strict=True))

    whole = found()
    monkeypatch.setattr(repeats, "LETTERS", 3)
    assert found() == whole
    monkeypatch.setattr(repeats, "SHARD", 100)
    assert len(list(repeats._shards([batch]))) > 3 and all(m for m in repeats._shards([batch]))


def test_full_bitmaps_let_little_through(spark, monkeypatch):
    """A bitmap at its largest size notes all of its hashes, and few others."""
    monkeypatch.setattr(repeats, "LARGEST", 18)
    r = np.random.default_rng(3)
    other = r.integers(0, 1 << 64, 50_000, np.uint64)
    for n, share in ((20_000, 0.04), (400_000, 0.85)):
        own = np.sort(r.integers(0, 1 << 64, n, np.uint64))
        rows = [(k, len(h), len(h), h.tobytes(), np.ones(len(h), np.int64).tobytes()) for k in range(1 << 10) if len(h := own[own >> np.uint64(54) == k])]
        bits = repeats.bitmap_of(spark.createDataFrame(rows, "slice int, kinds long, total long, h binary, n binary"), 10)
        assert repeats.noted(own, *bits).all() and repeats.noted(other, *bits).mean() < share


def test_automata_stay_small():
    """Many different passages go to many automata: the larger one is, the more each of its letters costs."""
    passages = [" ".join(f"w{k}_{i}" for i in range(16)).encode() for k in range(3000)]
    one = [np.zeros(1, t).tobytes() for t in (np.int64, np.int64, np.int32)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*[(k, p, *one) for k, p in enumerate(passages)], strict=True)], ["anchor", "words", "docs", "rows", "starts"])
    shards = list(repeats._shards([batch]))
    assert sorted(p for s in shards for p in s) == sorted(passages)
    assert max(sum(p.count(b" ") + 2 - repeats.WINDOW for p in s) for s in shards) < 4000


def test_ids_must_be_whole_numbers(spark):
    with pytest.raises(ValueError):
        repeats.remove(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_empty(spark):
    assert repeats.remove(spark.createDataFrame([], SCHEMA)).count() == 0


def test_anchors_serve_every_window_once_and_spread():
    """Texts with empty, null, repetitive and very long words; the same passage after different spacing."""
    passage = " ".join(f"p{i}" for i in range(40))
    texts = [" ".join(f"w{(i * 7919 + j) % 9973}" for j in range(300)) for i in range(50)] + [f"x \n\t {passage}", "y" * 300_000 + " " + passage, "", None, " ".join("a" * 100)]
    of, hashes = {}, set()
    for top, data, offsets in repeats.chunks(pa.array(texts, pa.string())):
        h, row, first, last, base, *_ = repeats.anchors(data, offsets)
        assert ((last >= first) & (last - first < repeats.SPAN)).all()
        hashes |= set(h.tolist())
        for k in range(len(offsets) - 1):
            words, mine = (texts[top + k] or "").encode().split(), row == k
            served = [(x, a) for f, t, a in zip((first - base[row])[mine].tolist(), (last - base[row])[mine].tolist(), h[mine].tolist(), strict=True) for x in range(f, t + 1)]
            assert [x for x, _ in served] == list(range(max(0, len(words) - repeats.WINDOW + 1)))
            assert all(of.setdefault(tuple(words[x : x + repeats.WINDOW]), a) == a for x, a in served)
    assert len({h >> 54 for h in hashes}) > 100
