"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns; and brute force."""

import base64
import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskmix.llm import bpe, mixing, neardup, pii, quality, toxicity, urls
from maskmix.llm.components import components

SCHEMA = "doc_id long, text string, source string"
LONG = "the quick brown fox jumps over the lazy dog and runs far away home " * 400


@pytest.fixture(scope="module")
def docs(spark):
    body = " ".join(f"w{i}" for i in range(60))
    rows = [(0, body, "a"), (1, body, "a"), (1, body, "a"), (2, None, None), (3, "", "b"), (4, "one two", "b"), (None, body, "a"), (5, LONG, "a"), (6, body.replace("w7 ", "x7 "), "b"), (7, "é" * 50 + " mail a@b.cd +1 (743) 555-3824", "b")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_quality(docs, empty):
    got = {(r.doc_id, r.n_words): r for r in quality.with_verdict(quality.judge(quality.measure(docs.withColumn("kept", F.lit(1))))).collect()}
    assert got[2, 0].base_failed and not got[2, 0].kept and got[5, 5600].n_repeat_words == 5600
    assert got[0, 60].n_repeat_words == 0
    assert quality.keep_good(empty).count() == 0 and quality.keep_good(docs).columns == docs.columns


def test_quality_lines(spark):
    rows = spark.createDataFrame([(0, "a b\n\na b\n \na b#$\nx a b c d e a b c d e", "s")], SCHEMA)
    got = quality.measure(rows).first()
    assert (got.n_dup_lines, got.n_symbols, got.n_words, got.n_repeat_words) == (1, 2, 17, 10)


def test_neardup(docs, empty):
    got = [(r.doc_id, r.component_id) for r in neardup.classes(docs.withColumn("node", F.lit("x"))).collect()]
    assert sorted(got, key=str) == sorted([(0, 0), (1, 0), (1, 0), (2, 2), (3, 3), (4, 4), (None, None), (5, 5), (6, 0), (7, 7)], key=str)
    assert neardup.classes(empty).count() == 0
    assert sorted(str(r.doc_id) for r in neardup.drop_copies(docs).collect()) == ["0", "2", "3", "4", "5", "7", "None"]


def test_sketch_estimates():
    r = np.random.default_rng(0)
    a = np.unique(r.integers(0, 1 << 62, 1000).astype(np.uint64))
    b = np.unique(np.concatenate([a[:900], r.integers(0, 1 << 62, 100).astype(np.uint64)]))
    s = neardup.sketches([a, b, a[:1]])
    assert not (s == neardup.FULL).any() and abs((s[0] == s[1]).mean() - 900 / 1100) < 0.15
    assert neardup.linked(a, a, 80) and not neardup.linked(a, a[:700], 80)


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (9, 8), (8, 7), (2, 2), (7, 9)], "u long, v long")
    assert {(r.node, r.root) for r in components(edges).collect()} == {(5, 2), (4, 2), (3, 2), (9, 7), (8, 7)}


def test_pii(docs, empty, spark):
    got = {(r.doc_id, r.text): [(s.k, s.s, s.e) for s in r.base] for r in pii.spans_of(docs.withColumn("base", F.lit(1))).collect()}
    assert got[7, "é" * 50 + " mail a@b.cd +1 (743) 555-3824"] == [("email", 56, 62), ("phone", 63, 80)]
    assert sum(map(len, got.values())) == 2 and pii.spans_of(docs).count() == 10 and pii.sanitise(empty).count() == 0
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert clean[7] == "é" * 50 + " mail [email] [phone]" and clean[5] == LONG
    # A rare term near one entity, in many contexts, gives it away; common words do not.
    rows = [(i, f"note {i} from zorblax person{i} via boss@corp.com today", "s") for i in range(6)] + [(10 + i, f"note {i} from a person via mail today", "s") for i in range(60)]
    spans = {r.doc_id: [(s.s, s.e) for s in r.extra] for r in pii.spans_of(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert spans[0] == [(12, 19)] and not any(spans[10 + i] for i in range(60))


def test_pii_rare_entities(spark):
    # One text with the entity is enough; words that other texts hold too, and the copies of a text, prove less.
    rows = [(i, f"note {i} from a person via mail today", "s") for i in range(1000)] + [(2000, "note from quuxley via one@corp.com today", "s")]
    rows += [(2001 + i, "note from blorptz via two@corp.com today", "s") for i in range(4)]
    got = {r.doc_id: [(r.text[x.s : x.e], x.action) for x in r.extra] for r in pii.spans_of(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[2000] == [("quuxley", "generalised")] and not any(got[i] for i in range(1000))
    assert all(got[2001 + i] == [("blorptz", "generalised")] for i in range(4))


def test_pii_whole_text(spark):
    # Telling terms are found and replaced far from the entity too, and at every place.
    far = "Quuxley via one@corp.com " + "note from a person " * 20 + "é quuxley and zorblax"
    rows = [(i, f"note {i} from a person and via mail", "s") for i in range(1000)] + [(2000, far, "s")]
    rows = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: [far[x.s : x.e] for x in r.extra] for r in pii.spans_of(rows).collect()}
    assert got[2000] == ["Quuxley", "é", "quuxley", "zorblax"] and not any(got[i] for i in range(1000))
    clean = {r.doc_id: r.text for r in pii.sanitise(rows).collect()}
    assert clean[2000] == "[name] via [email] " + "note from a person " * 20 + "[word] [word] and [word]"


@pytest.mark.parametrize("kind, pattern", [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")])
def test_patterns(spark, kind, pattern):
    r = np.random.default_rng(1)
    texts = ["".join(r.choice(list("ab@@..-_+12345 ()%")) for _ in range(60)) for _ in range(400)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.regexp_extract_all("t", F.lit(pii.PATTERNS[kind]), F.lit(0)).alias("m")).collect()
    for x in rows:
        want = [m[0] for m in re.finditer(pattern, x.t)]
        got = [m for m in x.m if kind != "phone" or len(re.sub("[^0-9]", "", m)) > 2]
        assert got == [m for m in want if kind != "phone" or len(re.sub("[^0-9]", "", m)) > 2]


def test_mixing(docs, empty):
    rows = mixing.lay_out(mixing.sized(docs)).collect()
    by = {}
    for r in rows:
        assert r.taken <= 2 * r.size
        by.setdefault(r.source, [0, r.target])[0] += r.taken
    assert all(abs(n - t) <= 1 for n, t in by.values()) and sum(t for _, t in by.values()) == pytest.approx(1.5 * sum(r.size for r in rows))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and sum(len((r.text or "").split()) for r in mixed.collect()) == sum(r.taken for r in rows)
    assert mixing.mix(empty).count() == 0


def test_bpe(docs, empty):
    tiktoken = pytest.importorskip("tiktoken")
    path, pattern = bpe.vocabulary()
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    other = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rows = bpe.decode(bpe.encode(docs.withColumn("ids", F.lit(1)), path, pattern), path, pattern).collect()
    assert len(rows) == 10 and all(r.ids == other.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode() for r in rows)
    assert bpe.digests(empty, path, pattern).count() == 0
    own, r = bpe.load(path, pattern), np.random.default_rng(0)
    for _ in range(300):
        t = "".join(r.choice(list("aabtheé '\n  01中s ")) for _ in range(40))
        assert own.encode_all([t]) == [other.encode_ordinary(t)]
    assert own.encode("ab" * 5000 + "the" * 5000) == other.encode_ordinary("ab" * 5000 + "the" * 5000)


def test_urls(spark):
    found = {r.u: r for r in urls.judge(spark.createDataFrame([(u,) for u in ("https://A.Example.NET/en/1?x#y", "http://net/", "http://a.net", "http://x.org/fr/a", "nothing", None, "http://my-spam.com/", "http://b.example.com/de/", "http://c.com/a.net/en/", "http://é.net/ü")], "u string"), "u").collect()}
    v = {u: (r.host, r.path, r.rule, r.verdict) for u, r in found.items()}
    assert v["https://A.Example.NET/en/1?x#y"] == ("a.example.net", "/en/1", "example.net/en/", "allow")
    assert v["http://net/"][2:] == ("net/", "block") and v["http://a.net"] == ("a.net", "", None, "allow")
    assert v["http://x.org/fr/a"][2:] == ("org/fr/", "allow") and v[None] == v["nothing"] == ("", "", None, "allow")
    assert v["http://my-spam.com/"][2:] == (None, "block") and v["http://b.example.com/de/"][3] == "block" and v["http://c.com/a.net/en/"][2] is None and v["http://é.net/ü"][2] == "net/"


def test_automaton_against_regex():
    r = np.random.default_rng(0)
    globs = ["".join(r.choice(list("ab*?")) for _ in range(r.integers(1, 7))) for _ in range(60)]
    texts = ["".join(r.choice(list("abcé")) for _ in range(r.integers(0, 9))) for _ in range(200)]
    found = urls.Automaton(globs).match(texts)
    for i, t in enumerate(texts):
        for k, g in enumerate(globs):
            assert found[i, k] == bool(re.fullmatch(g.replace("*", ".*").replace("?", "."), t))


def test_toxicity(spark, docs, empty):
    rows = [(i, f"some words number {i} " + ("you idiot clown" if i % 4 == 0 else "nice and kind"), "s") for i in range(200)]
    some = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), int(i % 4 == 0)) for i in range(120)] + [(None, 1, 1), (5, None, 1)], "doc_id long, quality int, toxic int")
    chain = toxicity.fit_chain(some, labels)
    got = toxicity.score(some.withColumn("toxic", F.lit("x")), chain).where("doc_id >= 120").collect()
    assert np.mean([r.toxic == (r.doc_id % 4 == 0) for r in got]) > 0.95
    assert toxicity.score(docs, chain).count() == 10 and toxicity.score(empty, toxicity.fit_chain(empty, labels)).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    body = [" ".join(f"{c}{(i * k) % 211}" for i in range(80)) for k, c in ((3, "a"), (5, "b"), (7, "c"))]
    rows = [(0, body[0], "en", "s", 1), (1, body[0] + " x", "en", "s", 1), (2, body[1] + " me@here.org", "en", "t", 1), (3, "short", "en", "t", 1), (4, body[2], "en", "u", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == {0, 2, 4} and len(corpus_pipeline.STAGES) == 5
    assert hashlib.sha256((body[1] + " [email]").encode()).hexdigest() in {r.decoded_sha256 for r in got if r.doc_id == 2}
