"""Near-duplicate classes against all pairs, with the second pass reached; and what stays."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskmix.llm import neardup

SCHEMA = "doc_id long, text string, source string"


def corpus():
    """Chains of near copies around the threshold, in families that are close to each other but not linked."""
    r = np.random.default_rng(0)
    texts = []
    for family in range(6):
        base = [f"f{family}x{i}" for i in range(60)]
        for _ in range(90 if family else 420):
            words = list(base)
            for at in r.choice(56, r.integers(0, 3) if family else 1, replace=False):
                words[at + 2] = f"n{r.integers(0, 3)}"
            if r.random() < 0.2:
                words = words[: 60 - r.integers(1, 9)]
            texts.append(" ".join(words) if r.random() < 0.7 else "  ".join(words).upper())
    texts += ["one two", "ONE  two", "three", "", None, " \n", "one two three four five"]
    order = r.permutation(len(texts))
    return [(int(i), texts[k], "s") for i, k in enumerate(order)]


def brute(rows, size=5, percent=80):
    """``doc_id -> smallest id reachable`` over all pairs."""
    sets = {}
    for d, t, *_ in rows:
        w = (t or "").lower().split()
        sets[d] = {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def test_classes_equal_all_pairs(spark, monkeypatch):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    later = []

    def counted(open_, *rest, own=neardup.between):
        nodes = open_.select("node").distinct().count()
        made = own(open_, *rest)
        later.append((nodes, made.count()))
        return made

    monkeypatch.setattr(neardup, "between", counted)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.classes(docs).collect()}
    want = brute(rows)
    assert later and later[0][0] > 4 * neardup.BLOCK and later[0][1] > 0  # several blocks, and links that only they found
    linked = [d for d in want if want[d][1] != d]
    recall = np.mean([got[d] == want[d] for d in linked])
    assert recall == 1.0 and got == want and len(linked) > 300
    kept = neardup.drop_copies(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d in want if want[d][1] == d)


def test_small_sketch_differences_pass():
    """The prefilter keeps pairs at the threshold: 80 % of codes and the slack below it."""
    codes = np.zeros((2, neardup.BINS), np.uint8)
    codes[1, : int(neardup.BINS * 0.2)] = 1
    rows = [(i, i, 100, codes[i].tobytes(), 2) for i in range(2)]
    assert list(neardup._close(rows, 80)) == [(0, [1]), (1, [])]
    rows[1] = (1, 0, 100, codes[1].tobytes(), 2)  # one component already
    assert list(neardup._close(rows, 80)) == [(0, []), (1, [])]


def test_unlinked_rows_of_one_id_all_stay(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(30)) for c in "ab")
    rows = [(1, a, "s"), (1, b, "s"), (1, a, "s"), (1, a.upper(), "s"), (2, b + " x", "s"), (None, a, "s"), (None, a, "s"), (1, None, "s"), (1, "", "s"), (1, "", "s")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(c) for c in ("row", "id", "x", "node", "t", "kept", "component_id", "first")})
    got = neardup.drop_copies(docs)
    assert got.columns == docs.columns
    kept = [(r.doc_id, None if r.text is None else r.text.lower()) for r in got.collect()]
    assert sorted(kept, key=str) == sorted([(1, a), (1, b), (None, a), (None, a), (1, None), (1, "")], key=str)


def test_ids_must_be_whole_numbers(spark):
    with pytest.raises(ValueError):
        neardup.classes(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_batch_size_is_as_before(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    neardup.classes(spark.createDataFrame([(1, "a b", "s")], SCHEMA)).count()
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
