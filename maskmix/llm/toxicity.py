"""Toxicity by classifier chains.

The categories of ``labels`` are predicted in turn by linear models over hashed words: each later model sees the
earlier categories' probabilities. It is trained on out-of-fold predictions of the earlier ones, so that what it
sees in training is as uncertain as what it sees later. The decision threshold of the last category is the one
with the best F1 among the out-of-fold predictions.

Fitting uses at most ``SAMPLE`` labelled documents, the first in the order of a hash of their ids (all, if there
are fewer); scoring covers all documents in one pass without a shuffle. The model, a few arrays of ``BUCKETS``
numbers, travels as a broadcast.

Defined cases: null or empty text has no words and gets the models' intercepts; labels without a document or
with nulls are left out; without labels of both values a category's model is constant; repeated rows get equal
scores; an empty table gives no rows. ``score`` carries other columns along, whatever their names, and replaces
columns named like its results.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskmix.llm.common import documents

#: Bounds of what is fitted: labelled documents, words' buckets; and how.
SAMPLE, BUCKETS, FOLDS, LEAST_DF, STEPS, DECAY = 6000, 1 << 18, 3, 3, 40, 1e-4
#: Categories in the order of the chain: name, label column, value that counts as positive.
CATEGORIES = (("low_quality", "quality", 0), ("toxic", "toxic", 1))
_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+").findall


class Words(dict):
    """Bucket of a word."""

    def __missing__(self, word: bytes) -> int:
        at = zlib.crc32(word) % BUCKETS
        if len(self) < 500_000:
            self[word] = at
        return at


def vector(text: str | None, buckets: Words) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's words and their weights: 1 + log of the count, over the fourth root of their number."""
    found = _WORDS((text or "").encode().lower())
    at, n = np.unique(np.fromiter(map(buckets.__getitem__, found), np.int64, len(found)), return_counts=True)
    x = 1 + np.log(n)
    return at, x / max(1, len(at)) ** 0.25


class Rows:
    """Sparse rows."""

    def __init__(self, vectors):
        sizes = [len(a) for a, _ in vectors]
        self.at = np.concatenate([np.zeros(0, np.int64), *[a for a, _ in vectors]])
        self.x = np.concatenate([np.zeros(0), *[x for _, x in vectors]])
        self.row = np.repeat(np.arange(len(vectors)), sizes)
        self.n = len(vectors)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.x * w[self.at], self.n)

    def back(self, r: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.at, self.x * r[self.row], size)

    def take(self, mask: np.ndarray) -> Rows:
        out, keep = object.__new__(Rows), mask[self.row]
        out.at, out.x, out.n = self.at[keep], self.x[keep], int(mask.sum())
        out.row = (np.cumsum(mask) - 1)[self.row[keep]]
        return out


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit(rows: Rows, extra: np.ndarray, y: np.ndarray, size: int) -> dict:
    """Logistic regression by accelerated gradient steps, on words scaled by their log count ratio.

    ``extra`` are the earlier probabilities' log odds.
    """
    w, v, b = np.zeros(size), np.zeros(extra.shape[1]), 0.0
    p = float(np.clip(y.mean() if len(y) else 0.0, 1e-4, 1 - 1e-4))
    b = float(np.log(p / (1 - p)))
    if len(y) == 0 or y.min() == y.max():
        return {"w": w, "v": v, "b": b}
    yes, no = rows.back(y, size) + 1, rows.back(1 - y, size) + 1
    ratio = np.log(yes / yes.sum()) - np.log(no / no.sum())
    scaled = object.__new__(Rows)
    scaled.at, scaled.x, scaled.row, scaled.n = rows.at, rows.x * ratio[rows.at], rows.row, rows.n
    balance = np.where(y == 1, 0.5 / p, 0.5 / (1 - p))
    balance /= balance.mean()
    norm = np.bincount(scaled.row, scaled.x**2, scaled.n)
    rate = 4 / (norm.mean() + 1 + (extra**2).sum(1).mean())
    ow, ov, ob = w, v, b
    for t in range(STEPS):
        m = t / (t + 3)
        yw, yv, yb = w + m * (w - ow), v + m * (v - ov), b + m * (b - ob)
        ow, ov, ob = w, v, b
        r = (logistic(scaled.dot(yw) + extra @ yv + yb) - y) * balance / len(y)
        w = yw - rate * (scaled.back(r, len(w)) + DECAY * yw)
        v, b = yv - rate * (extra.T @ r), yb - rate * r.sum()
    return {"w": w * ratio, "v": v, "b": b}


def odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def predict(model: dict, rows: Rows, extra: np.ndarray) -> np.ndarray:
    return logistic(rows.dot(model["w"]) + extra @ model["v"] + model["b"])


def train(vectors, labels: np.ndarray) -> dict:
    """The chain's models and the last category's threshold. ``labels`` has a column per category."""
    rows, n = Rows(vectors), len(vectors)
    # Words of fewer than three documents teach nothing; the others are renumbered for the fit.
    df = np.bincount(rows.at, minlength=BUCKETS)
    used = np.flatnonzero(df >= LEAST_DF)
    place = np.full(BUCKETS, -1)
    place[used] = np.arange(len(used))
    rows.at = place[rows.at]
    known = rows.at >= 0
    rows.at, rows.x, rows.row = rows.at[known], rows.x[known], rows.row[known]
    fold = np.arange(n) % FOLDS
    models, outside = [], np.zeros((n, 0))
    p = np.zeros(n)
    for y in labels.T:
        p = np.zeros(n)
        for k in range(FOLDS):
            mask = fold != k
            p[~mask] = predict(fit(rows.take(mask), outside[mask], y[mask], len(used)), rows.take(~mask), outside[~mask])
        models.append(fit(rows, outside, y, len(used)))
        outside = np.column_stack([outside, odds(p)])
    y = labels[:, -1] if labels.size else np.zeros(0)
    limit = 0.5
    if len(y) and 0 < y.sum() < len(y):
        order = np.argsort(-p, kind="stable")
        hits = np.cumsum(y[order])
        f1 = 2 * hits / (np.arange(1, n + 1) + y.sum())
        best = int(f1.argmax())
        limit = float((p[order][best] + p[order][min(best + 1, n - 1)]) / 2)
    for m in models:
        w = np.zeros(BUCKETS)
        w[used] = m["w"]
        m["w"] = w
    return {"models": models, "limit": limit}


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, text`` and the categories' labels of the sample. Only its ids, a bounded number, are broadcast; of the
    texts that share an id, the first in order stands for it."""
    good = labels.dropna(subset=["doc_id", *[c for _, c, _ in CATEGORIES]]).dropDuplicates(["doc_id"])
    chosen = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    named = [F.when(F.col(c) == v, 1).otherwise(0).alias(f"is_{name}") for name, c, v in CATEGORIES]
    found = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id", *named)), "doc_id")
    return found.groupBy("doc_id", *[f"is_{name}" for name, _, _ in CATEGORIES]).agg(F.min("text").alias("text"))


def fit_chain(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    rows = labelled(docs, labels, sample)
    names = [f"is_{n}" for n, _, _ in CATEGORIES]

    def run(batches):
        buckets = Words()
        for batch in batches:
            d = batch.to_pydict()
            vs = [vector(t, buckets) for t in d["text"]]
            made = [pa.array(d["doc_id"], pa.int64()), pa.array([a.astype(np.int32).tobytes() for a, _ in vs], pa.binary()), pa.array([x.astype(np.float32).tobytes() for _, x in vs], pa.binary()), *[pa.array(d[n], pa.int32()) for n in names]]
            yield pa.RecordBatch.from_arrays(made, ["doc_id", "at", "x", *names])

    schema = "doc_id long, at binary, x binary, " + ", ".join(f"{n} int" for n in names)
    found = sorted(rows.mapInArrow(run, schema).collect(), key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id, bytes(r.at)))
    vectors = [(np.frombuffer(r.at, np.int32).astype(np.int64), np.frombuffer(r.x, np.float32).astype(float)) for r in found]
    return train(vectors, np.array([[r[n] for n in names] for r in found], float).reshape(len(found), len(names)))


def score(docs: DataFrame, chain: dict, text: str = "text") -> DataFrame:
    """``docs`` plus ``p_<category>`` for each category, and ``toxic``."""
    names = [f"p_{n}" for n, _, _ in CATEGORIES]
    shared = docs.sparkSession.sparkContext.broadcast({**chain, "models": [{**m, "w": m["w"].astype(np.float32)} for m in chain["models"]]})
    own = {*names, "toxic"}
    schema = T.StructType([f for f in docs.schema.fields if f.name not in own] + [T.StructField(n, T.DoubleType()) for n in names] + [T.StructField("toxic", T.BooleanType())])

    def run(batches):
        buckets, chain = Words(), shared.value
        for batch in batches:
            rows = Rows([vector(t, buckets) for t in batch.column(text).to_pylist()])
            extra, made = np.zeros((rows.n, 0)), []
            for m in chain["models"]:
                made.append(predict(m, rows, extra))
                extra = np.column_stack([extra, odds(made[-1])])
            keep = [c for c in batch.schema.names if c not in own]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *[pa.array(p, pa.float64()) for p in made], pa.array(made[-1] >= chain["limit"], pa.bool_())], [*keep, *names, "toxic"])

    return docs.mapInArrow(run, schema)


def op2_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    chain = fit_chain(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, chain).select("doc_id", *[f"p_{n}" for n, _, _ in CATEGORIES], "toxic")
