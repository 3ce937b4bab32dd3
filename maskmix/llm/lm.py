"""Language-model scores: a gated recurrent network with a class-factored softmax.

P(word | history) = P(class | state) P(member | class, state) P(word | member). The vocabulary of the network is the
end of a text, the most frequent words and groups of all other words by their last two characters. The end, the
``SINGLE`` most frequent words and the groups are classes of their own; the next words in frequency are the members
of ``SHARED`` classes. The network predicts class and member from its state, which is carried over the whole
document. Only the words of a group, whose number has no bound, are told apart by their smoothed counts.

Everything is learned from all training documents: word counts by aggregation, the network by one pass of truncated
backpropagation in every partition, averaged by tokens, from a start fitted on about ``WARM`` documents, a number
that only sets where the pass begins. As partitions learn apart, another layout of the input gives slightly other
scores. What reaches the driver is bounded: the words of the ``HEAD`` greatest counts are found by a histogram of
the counts first, and only they are collected and broadcast; the scores of all other words come from a join with the
counts.

Defined cases: null text is empty and scores its end only; a null id is read as an empty string, not held out;
repeated rows score alike; an empty table gives no rows, and without training documents every probability is the
smoothed one. ``score`` carries no other columns, so their names cannot clash.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskmix.llm import gru
from maskmix.llm.common import documents, save

#: Words with broadcast counts, at most; documents of the network's start, about.
HEAD, WARM = 1 << 18, 400
#: Classes: the end, single words, groups by ending, groups of the other endings, and classes of gru.MEMBERS words.
SINGLE, ENDINGS, OTHERS, SHARED = 39, 32, 16, 40
GROUPS = 1 + SINGLE
OWN = GROUPS + ENDINGS + OTHERS
CLASSES = OWN + SHARED
#: Documents taken together, and the learning rates of start and pass.
CHUNK, WARM_RATE, RATE = 3000, 0.02, 0.004
#: Steps of the histogram of counts for a factor of two.
STEPS = 64


def held_out(doc_id) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 1


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def _counts(batches):
    seen: Counter = Counter()

    def rows():
        keys = list(seen)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()).cast(pa.string()), pa.array([seen[k] for k in keys], pa.int64())], ["word", "n"])

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if not held_out(doc_id):
                seen.update(words(text))
                seen[b""] += 1  # the end
            if len(seen) > 500_000:
                yield rows()
                seen.clear()
    yield rows()


class Vocabulary:
    """The network's symbol of any word: 0 is the end."""

    def __init__(self, words: list[bytes], endings: list[str]):
        """``words`` by falling frequency; those beyond the network's symbols are left to the groups."""
        room = SINGLE + SHARED * gru.MEMBERS
        self.own = {w: 1 + i if i < SINGLE else OWN + i - SINGLE for i, w in enumerate(words[:room])}
        self.endings = {e: GROUPS + i for i, e in enumerate(endings)}

    def group(self, word: bytes) -> int:
        ending = word.decode()[-2:]
        found = self.endings.get(ending)
        return GROUPS + ENDINGS + zlib.crc32(ending.encode()) % OTHERS if found is None else found

    def of(self, word: bytes) -> int:
        return gru.END if not word else self.own.get(word) or self.group(word)

    def group_sql(self, word: str) -> Column:
        """``group`` as an expression."""
        ending = F.right(F.col(word), F.lit(2))
        other = F.lit(GROUPS + ENDINGS) + F.pmod(F.crc32(ending), F.lit(OTHERS))
        known = F.create_map(*[F.lit(x) for e, i in self.endings.items() for x in (e, i)])[ending] if self.endings else F.lit(None)
        return F.coalesce(known, other).cast("int")


class Model:
    """What travels to the executors."""

    def __init__(self, vocabulary: Vocabulary, head: list[tuple[bytes, int]], ends: int, total: int, distinct: int, sums: np.ndarray, kinds: np.ndarray):
        """``sums`` and ``kinds``: occurrences and distinct words of each group."""
        self.vocabulary, self.ends, self.total, self.distinct = vocabulary, ends, total, distinct
        self.index = {w: i for i, (w, _) in enumerate(head)}
        self.symbol = np.array([vocabulary.of(w) for w, _ in head], np.uint16)
        c = np.array([n for _, n in head], float)
        self.base_room, self.room = total + 0.5 * (distinct + 1), sums + 0.5 * (kinds + 1)
        self.base = np.log10((c + 0.5) / self.base_room)
        self.end_base = float(np.log10((ends + 0.5) / self.base_room))
        grouped = (self.symbol >= GROUPS) & (self.symbol < OWN)
        self.inner = np.zeros(len(head))
        self.inner[grouped] = np.log10((c[grouped] + 0.5) / self.room[self.symbol[grouped] - GROUPS])
        self.network = gru.fresh(OWN, SHARED)
        # The start of the softmax: the shares of the symbols.
        share = np.full(OWN + SHARED * gru.MEMBERS, 0.5)
        np.add.at(share, self.symbol[~grouped], c[~grouped])
        share[gru.END] += ends
        share[GROUPS:OWN] += sums
        members = share[OWN:].reshape(SHARED, gru.MEMBERS)
        classes = np.concatenate([share[:OWN], members.sum(axis=1)])
        self.network["o"] = np.log(classes / classes.sum()).astype(np.float32)
        self.network["q"] = np.log(members / members.sum(axis=1, keepdims=True)).astype(np.float32)

    def symbols(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Symbols with the end, indices of head words, and the other words."""
        get = self.index.get
        at = np.array([get(w, -1) for w in tokens], np.int64)
        out = np.empty(len(at) + 1, np.uint16)
        out[-1] = gru.END
        known = at >= 0
        out[:-1][known] = self.symbol[at[known]]
        gaps = np.flatnonzero(~known)
        rest = [tokens[i] for i in gaps]
        if rest:
            out[gaps] = [self.vocabulary.of(w) for w in rest]
        return out, at[known], rest


def most_frequent(counts: DataFrame, limit: int = HEAD) -> list[tuple[bytes, int]]:
    """Words by falling count, at most ``limit``; words of nearly equal count are all in or all out."""
    level = F.floor(F.log2("c") * STEPS).cast("int")
    words = counts.where("word <> ''")
    least, room = None, limit
    for r in sorted(words.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r.level):
        room -= r.n
        if room < 0:
            break
        least = r.level
    if least is None:
        return []
    return sorted([(r.word.encode(), r.c) for r in words.where(level >= least).collect()], key=lambda x: (-x[1], x[0]))


def statistics(docs: DataFrame) -> tuple[DataFrame, Model]:
    """``word, c`` of the training texts (the end is the empty word), and a model with an untrained network."""
    counts = docs.select("doc_id", "text").mapInArrow(_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("c"))
    counts = save(counts)
    whole = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.col("word") == "", F.col("c"))), F.lit(0))).first()
    head = most_frequent(counts)
    words = [w for w, _ in head]
    own = [w.decode() for w in words[: SINGLE + SHARED * gru.MEMBERS]]
    rest = counts.where(~F.col("word").isin(["", *own]))
    ends = rest.groupBy(F.right("word", F.lit(2)).alias("ending")).agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "ending").limit(ENDINGS)
    vocabulary = Vocabulary(words, [r.ending for r in ends.collect()])
    sums, kinds = np.zeros(ENDINGS + OTHERS), np.zeros(ENDINGS + OTHERS)
    for r in rest.groupBy(vocabulary.group_sql("word").alias("k")).agg(F.sum("c").alias("s"), F.count(F.lit(1)).alias("v")).collect():
        sums[r.k - GROUPS], kinds[r.k - GROUPS] = r.s, r.v
    return counts, Model(vocabulary, head, int(whole[2]), int(whole[0]), int(whole[1]), sums, kinds)


def first_documents(docs: DataFrame, model: Model) -> list[np.ndarray]:
    """Symbols of about ``WARM`` training documents: those whose hash is below a share of all hashes."""
    rows = docs.select("doc_id", "text").where(F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(5)) != 1)
    h = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40))
    bound = (1 << 40) if model.ends <= 2 * WARM else (1 << 40) * 2 * WARM // model.ends
    rows = rows.withColumn("h", h).where(F.col("h") < bound).orderBy("h", "doc_id").limit(WARM)
    return [model.symbols(words(r.text))[0] for r in rows.collect()]


def train(docs: DataFrame, model: Model) -> Model:
    """The network: a start on the driver, then a pass over all training documents in every partition."""
    spark = docs.sparkSession
    trainer = gru.Trainer(model.network, WARM_RATE)
    start = first_documents(docs, model)
    for _ in range(6):
        trainer.learn(start, 32)
    model.network = trainer.p
    shared = spark.sparkContext.broadcast(model)

    def learn(batches):
        gru.one_thread()
        model = shared.value
        trainer = gru.Trainer(model.network, RATE)
        held: list[np.ndarray] = []
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not held_out(doc_id):
                    held.append(model.symbols(words(text))[0])
                if len(held) >= CHUNK:
                    trainer.learn(held)
                    held = []
        trainer.learn(held)
        yield weighted(gru.flat(trainer.p).astype(float) * trainer.tokens, trainer.tokens)

    def weighted(x, n):
        return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()), pa.array([n], pa.int64())], ["x", "n"])

    def add(batches):
        total, tokens = 0.0, 0
        for batch in batches:
            for x, n in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                total, tokens = total + np.frombuffer(x), tokens + n
        if tokens:
            yield weighted(total, tokens)

    kind = "x binary, n long"
    found = docs.select("doc_id", "text").mapInArrow(learn, kind).where("n > 0").repartition(8).mapInArrow(add, kind).collect()
    tokens = sum(r.n for r in found)
    if tokens:
        model.network = gru.unflat(sum(np.frombuffer(r.x) for r in found) / tokens, model.network)
    return model


def _scored(doc_id: T.StructField) -> T.StructType:
    rest = T.ArrayType(T.StructType([T.StructField("word", T.StringType()), T.StructField("tf", T.IntegerType()), T.StructField("kind", T.IntegerType())]))
    kinds = {"held_out": T.BooleanType(), "n_tokens": T.LongType(), "n_head": T.LongType(), "base_head": T.DoubleType(), "score_head": T.DoubleType(), "rest": rest}
    return T.StructType([T.StructField("doc_id", doc_id.dataType), *[T.StructField(c, k) for c, k in kinds.items()]])


_REST = pa.list_(pa.struct([("word", pa.string()), ("tf", pa.int32()), ("kind", pa.int32())]))


def _rest(rows: list[Counter], vocabulary: Vocabulary) -> pa.Array:
    """The other words of each document, built by columns."""
    flat = [w for c in rows for w in c]
    values = pa.StructArray.from_arrays([pa.array(flat, pa.binary()).cast(pa.string()), pa.array([n for c in rows for n in c.values()], pa.int32()), pa.array([vocabulary.group(w) - GROUPS for w in flat], pa.int32())], ["word", "tf", "kind"])
    ends = np.concatenate([[0], np.cumsum([len(c) for c in rows])])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values).cast(_REST)


def score(docs: DataFrame, counts: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    schema = _scored(docs.schema["doc_id"])
    names = schema.names

    def run(batches):
        gru.one_thread()
        model = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                ids, seqs, rest, sums = part.column(0).to_pylist(), [], [], []
                for text in part.column(1).to_pylist():
                    symbols, head, others = model.symbols(words(text))
                    seqs.append(symbols)
                    rest.append(Counter(others))
                    sums.append((len(symbols), len(head), model.base[head].sum() + model.end_base, model.inner[head].sum()))
                neural = gru.log_likelihoods(model.network, seqs) / np.log(10)
                n, known, base, inner = (list(c) for c in zip(*sums, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([held_out(i) for i in ids], pa.bool_()), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(np.array(inner) + neural, pa.float64()), _rest(rest, model.vocabulary)],
                    names,
                )

    rows = save(docs.select("doc_id", "text").mapInArrow(run, schema).withColumn("_row", F.monotonically_increasing_id()))
    others = rows.select("_row", F.explode("rest").alias("r")).select("_row", "r.*")
    tail = counts.where("word <> ''").withColumnRenamed("word", "w")
    joined = others.join(tail.hint("shuffle_hash"), F.col("word") == F.col("w"), "left").withColumn("c", F.coalesce("c", F.lit(0)))
    room = F.element_at(F.array(*[F.lit(float(x)) for x in model.room]), F.col("kind") + 1)
    joined = joined.groupBy("_row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("more"),
        F.sum(F.col("tf") * F.log10((F.col("c") + 0.5) / F.lit(model.base_room))).alias("base"),
        F.sum(F.col("tf") * F.log10((F.col("c") + 0.5) / room)).alias("inner"),
    )
    out = rows.drop("rest").join(joined, "_row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    # The end is known if there is a training text at all.
    ends = 1 if model.ends > 0 else 0
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_head") + zero("more") + ends).cast("long").alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"), (F.col("base_head") + zero("base")).alias("base_score"), (F.col("score_head") + zero("inner")).alias("score"))


def op4_gated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    counts, model = statistics(docs)
    return score(docs, counts, train(docs, model))
