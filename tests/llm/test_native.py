"""The native operators, the chain of classifiers and the whole pipeline against plain Python."""

import base64
import hashlib
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from brute import base_spans, disclosing, good, measures, sanitised, shares
from pyspark.sql import functions as F
from test_neardup import brute as near

from maskmix.llm import bpe, mixing, pii, quality, toxicity
from maskmix.llm.common import discard, save, shared_dir

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(n=260):
    """Frequent and rare words, people near their addresses, copies, junk, nulls, one large host."""
    r = np.random.default_rng(3)
    rows, common = [], [f"w{i}" for i in range(40)]
    for i in range(n):
        words = [common[int(k)] for k in np.minimum(39, r.exponential(9, r.integers(12, 60)))] + [f"u{i}a", f"u{i}b"]
        if i % 9 == 0:
            p = int(r.integers(0, 4))
            who = [f"Name{p}x", f"boss{p}@corp{p}.com", f"10.0.{p}.{i % 300}", f"+1 (743) 555-38{p}4", "4111 1111 1111 1111", f"Al{p}", "é7"]
            for x in who:
                words.insert(int(r.integers(0, len(words))), x)
        if i % 13 == 0:
            words = [common[i % 5], "a", "b", "c"] * 9
        text = "\n".join(" ".join(words[k : k + 10]) for k in range(0, len(words), 10))
        rows.append((i, text if i % 17 else text[:20], "en", None if i % 29 == 0 else "hub" if i % 3 == 0 else f"h{i % 7}", len(text)))
    rows += [(1000 + i, rows[i][1], "en", "copies", 1) for i in range(0, 60, 2)] + [(2000, None, "en", "h1", None), (2001, "", "en", "h1", 0), (2002, rows[9][1] + " one more", "en", "z", 1)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def clashing(df, *names):
    return df.withColumns({n: F.lit(f"own {n}") for n in names})


def test_disclosure(docs, rows):
    names = ("t", "h", "_key", "row", "term", "x", "entities")
    df = clashing(docs, *names)
    told = disclosing([r[1] for r in rows], remove_at=0.8)
    got = pii.spans_of(df, remove_at=0.8)
    assert got.columns == [*df.columns, "base", "extra"]
    extra = 0
    for r in got.collect():
        want = told.get(r.text, [])
        assert [(s.k, s.s, s.e, s.m) for s in r.base] == base_spans(r.text or "") and r.t == "own t"
        assert [(s.s, s.e, s.action) for s in r.extra] == want
        extra += len(want)
    assert extra > 50 and {a for v in told.values() for _, _, a in v} == {"removed", "generalised"}
    clean = pii.sanitise(clashing(df, "base", "extra", "spans", "clean"), remove_at=0.8)
    assert Counter((r.doc_id, r.text, r.n_chars, r.base) for r in clean.collect()) == Counter((r[0], c := sanitised(r[1], told.get(r[1], [])), None if c is None else len(c), "own base") for r in rows)



@pytest.mark.parametrize("text", ["1.2.3.256 1.2.3.255 01.002.0003.4 1.2.3.4.5 a1.2.3.4", "4111111111111111 4111111111111112 41111111111111111111 4111-1111 1111-1111 0000000000000", "+1 2345678 +123456789 +1234567890123456 +1(2)3 4.5-678901 ++123456789", "a@b a@b.c a@b.c.d. a@b..c @b.c %+@x-y.z-w a@b.c@d.e é@b.cd", "+1 (743) 555-3824 4111 1111 1111 1111 192.168.0.1 x@y.zz 😀 a@b.cd"])
def test_base_spans(spark, text):
    got = pii.find_base(spark.createDataFrame([(text,)], "text string")).first().base
    assert [(s.k, s.s, s.e, s.m) for s in got] == base_spans(text)


def test_host_rules(docs, rows, monkeypatch):
    df = clashing(docs.drop("n_chars", "lang"), "base_failed", "rule_failed", "_v", "host", "own", "row", "body")
    want = good([(r[1], r[3]) for r in rows])
    kept = Counter(r[0] for r, (_, k) in zip(rows, want, strict=True) if k)
    assert 20 < sum(kept.values()) < len(rows) - 20
    for few, share in ((quality.FEW, quality.SHARE), (0, 4), (0, 10_000)):
        monkeypatch.setattr(quality, "FEW", few)
        monkeypatch.setattr(quality, "SHARE", share)
        found = quality.keep_good(df)
        assert found.columns == df.columns and Counter(r.doc_id for r in found.collect()) == kept
    judged = quality.with_verdict(quality.judge(quality.measure(docs))).collect()
    assert Counter((r.doc_id, tuple(r[m] for m in quality.MEASURES), r.base_failed, r.kept) for r in judged) == Counter((r[0], (m := measures(r[1]))[:2] + m[2:], *w) for r, w in zip(rows, want, strict=True))


def test_mix(docs, rows):
    df = clashing(docs, "rate_0", "_h", "size", "copy", "at", "row", "taken", "source_size")
    want = shares([(r[0], r[1], r[3]) for r in rows])
    rows_of = mixing.lay_out(mixing.sized(docs), text="text").collect()
    assert Counter((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in rows_of) == Counter((r[0], n, total, round(target, 6), sum(taken)) for r, (n, total, target, taken, *_) in zip(rows, want, strict=True))
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns and {r.size for r in mixed.select("size").distinct().collect()} == {"own size"}
    got = Counter((r.doc_id, len((r.text or "").split()), r.n_chars == len(r.text)) for r in mixed.collect())
    assert got == Counter((r[0], k, True) for r, w in zip(rows, want, strict=True) for k in w[3] if k)


def position(k, w):
    _, total, _, _, o, demand, (a, b) = w
    u = (k * total + o) / demand
    return u if a == b else ((a * a + 2 * (b - a) * u) ** 0.5 - a) / (b - a)


def test_order_of_the_mix(docs, rows):
    want = shares([(r[0], r[1], r[3]) for r in rows])
    places = sorted((position(k, w), r[0]) for r, w in zip(rows, want, strict=True) for k in (0, 1) if w[3][k])
    assert [r.doc_id for r in mixing.mix(docs).collect()] == [d for _, d in places] and all(0 <= p <= 1 for p, _ in places)


def test_schedules():
    assert mixing.scaled([(3, 1), (0, 2)]) == [(1.5, 0.5), (0, 2)]
    for bad in ([(-1, 3)], [(0, 0)]):
        with pytest.raises(ValueError):
            mixing.scaled(bad)


def test_ties_of_ids(spark):
    rows = [(1, "a b c", "s"), (1, "d e f", "s"), (None, "g h", "s"), (None, "i j", "s"), (None, None, "s"), (2, "k l m n", "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    runs = [Counter((r.doc_id, r.text) for r in mixing.mix(df.repartition(k)).collect()) for k in (1, 3, 5)]
    assert runs[0] == runs[1] == runs[2]


def test_chain_is_fitted_out_of_fold(spark):
    """Each model sees the earlier category's probability from models that had not seen the row; scores by hand."""
    texts = [f"some words number {i % 50} " + ("clown " * (i % 4 == 0)) + ("junk " * (i % 3 == 0)) for i in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(5, "zz later")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), int(i % 4 == 0)) for i in range(240)], "doc_id long, quality int, toxic int")
    assert toxicity.labelled(docs, labels).count() == 240
    chain = toxicity.fit_chain(docs, labels)
    seen = []

    def fit(rows, extra, y, size, own=toxicity.fit):
        seen.append((rows.n, extra.shape[1], extra.copy()))
        return own(rows, extra, y, size)

    vectors = [toxicity.vector(t, toxicity.Words()) for t in texts[:240]]
    y = np.array([[int(i % 3 == 0), int(i % 4 == 0)] for i in range(240)], float)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(toxicity, "fit", fit)
        toxicity.train(vectors, y)
    assert [(n, k) for n, k, _ in seen] == [(160, 0)] * 3 + [(240, 0)] + [(160, 1)] * 3 + [(240, 1)]
    # The second model's input is less sure than the first model is on its own training rows.
    first = toxicity.predict(toxicity.train(vectors, y[:, :1])["models"][0], toxicity.Rows(vectors), np.zeros((240, 0)))
    assert not np.allclose(seen[-1][2][:, 0], toxicity.odds(first))
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    for r in toxicity.score(clashing(docs, "p", "row"), chain).limit(40).collect():
        at, x = toxicity.vector(r.text, toxicity.Words())
        odds, p = [], 0.0
        for model in chain["models"]:
            p = sigmoid(sum(model["w"][a] * b for a, b in zip(at, x, strict=True)) + sum(v * o for v, o in zip(model["v"], odds, strict=True)) + model["b"])
            odds.append(float(toxicity.odds(np.array(p))))
        assert r.p_toxic == pytest.approx(p, rel=1e-3) and r.toxic == (p >= chain["limit"]) and r.row == "own row"


@pytest.fixture(scope="module")
def encoding():
    tiktoken = pytest.importorskip("tiktoken")
    path, pattern = bpe.vocabulary()
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def digests(text, encoding):
    ids = encoding.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_token_digests(docs, rows, encoding):
    got = bpe.digests(docs, *bpe.vocabulary()).collect()
    assert Counter(tuple(r) for r in got) == Counter((r[0], *digests(r[1], encoding)) for r in rows)


def test_idle_workers_give_tokenizers_back(docs):
    bpe.digests(docs, *bpe.vocabulary())
    time.sleep(bpe.IDLE + 3)

    def left(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([bpe.load.cache_info().currsize], pa.int64())], ["n"])

    assert {r.n for r in docs.select("doc_id").repartition(4).mapInArrow(left, "n long").collect()} == {0}


def test_slices_encode_alike(rows, encoding, monkeypatch):
    monkeypatch.setattr(bpe, "MERGED", 3)
    bpe.load.cache_clear()
    texts = [r[1] or "" for r in rows]
    assert bpe.load(*bpe.vocabulary()).encode_all(texts) == [encoding.encode_ordinary(x) for x in texts]


def test_pipeline_equals_plain_python(spark, rows, encoding, tmp_path):
    import corpus_pipeline

    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    left = [(r[0], r[1], r[3]) for r, (_, k) in zip(rows, good([(r[1], r[3]) for r in rows]), strict=True) if k]
    classes = near([(d, t) for d, t, _ in left])
    left = [x for x in left if classes[x[0]][1] == x[0]]
    told = disclosing([t for _, t, _ in left])
    left = [(d, sanitised(t, told.get(t, [])), s) for d, t, s in left]
    want = Counter()
    for (d, t, _), (n, _, _, taken, *_) in zip(left, shares(left), strict=True):
        for k in taken:
            if k:
                ends = [m.end() for m in __import__("re").finditer(r"[^\x20\x09-\x0D]+", t)]
                want[d, *digests(t if k == n else t[: ends[k - 1]], encoding)] += 1
    assert got == want and len(want) > 30


def test_saved_tables_go(spark):
    import os

    kept = save(spark.range(5))
    path = kept._saved_at
    assert path.startswith(shared_dir(spark)) and os.path.isdir(path) and kept.count() == 5
    discard(kept, spark.range(2))
    assert not os.path.isdir(path)


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        @staticmethod
        def get(key, default):
            return default

    class Context:
        master = "spark://host:7077"

        @staticmethod
        def getCheckpointDir():
            return None

    class Session:
        conf, sparkContext = Conf, Context

    with pytest.raises(ValueError):
        shared_dir(Session)
