"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

Sketch: in round i every shingle falls by a hash into one of ``BINS`` bins, and a bin keeps the smallest value of
the first round that reaches it. Round BINS + j sends every shingle to bin j, so that after twice BINS rounds
every bin is full; documents leave as soon as theirs are. Matching bins estimate the Jaccard similarity with
the concentration of min-hashing.

Banding: ``BANDS`` keys of ``ROWS`` bins each. At similarity 0.8 no key agrees with a probability of 5e-8.
Documents with equal sets of shingles are one node from the start.

Verification is exact, on the sets of the whole texts, in two passes. First every node meets the first member of
its buckets, in blocks of ``BLOCK`` nodes, and the members of a block meet each other. What is linked then is
contracted. Second, buckets that still hold several components are joined to areas by the nodes they share, and
nodes of different components meet, in pairs of blocks of an area: first their sketches alone, then, with their
texts, the nodes of a pair of blocks that have a partner there. Pairs whose sketches are ``SLACK`` standard deviations
below the threshold are left out, the others are verified. No bucket has a cap, and no bucket is one task's alone.

Defined cases: null and empty texts have empty sets and are linked with nothing; rows with a null id are linked
with nothing and have a null component; rows with one id are one document as soon as their sets are linked, and
the smallest id counts; an empty table gives no rows; ids are whole numbers (others are an error, as the smallest
one names a class); ``classes`` ignores other columns, ``drop_copies`` carries them along, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskmix.llm.common import discard, documents, packed, save, small_batches, unpacked
from maskmix.llm.components import components

BINS, BANDS, ROWS, BLOCK, SLACK = 128, 32, 4, 64, 5.0
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    line = b" ".join(words)
    if len(words) <= size:
        return np.array([digest(line)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    first = [0, *ends[:-size].tolist()]
    return np.unique(np.array([digest(line[a:b]) for a, b in zip(first, (ends[size - 1 :] - 1).tolist(), strict=True)], np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """(documents, BINS) values; sets must not be empty."""
    n = len(sets)
    out = np.full(n * BINS, FULL)
    x = np.concatenate([np.zeros(0, np.uint64), *sets])
    d = np.repeat(np.arange(n), [len(s) for s in sets])
    for i in range(2 * BINS):
        if not len(x):
            break
        seed = np.uint64((i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        v = mix(x + seed)
        at = d * BINS + (v >> np.uint64(57)).astype(np.int64) if i < BINS else d * BINS + (i - BINS)
        got = np.full(n * BINS, FULL)
        np.minimum.at(got, at, mix(v + np.uint64(i)) >> np.uint64(1))
        out = np.where(out == FULL, got, out)
        open_ = (out.reshape(n, BINS) == FULL).any(axis=1)
        if not open_.any():
            break
        keep = open_[d]
        x, d = x[keep], d[keep]
    return out.reshape(n, BINS)


def band_keys(sketch: np.ndarray) -> np.ndarray:
    parts = sketch.reshape(len(sketch), BANDS, ROWS)
    key = np.tile(np.arange(BANDS, dtype=np.uint64), (len(sketch), 1))
    for r in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return key.view(np.int64)


def node_of(values: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(values.tobytes()) - (1 << 63)


def sketched(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id, t, n_shingles, node, bands, codes`` of ``docs`` (doc_id, t, text); codes are the low bytes of the sketch."""

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                sets = [shingles(t, size) for t in part.column(2).to_pylist()]
                some = [i for i, s in enumerate(sets) if len(s)]
                sketch = sketches([sets[i] for i in some])
                bands, codes = band_keys(sketch), (sketch & np.uint64(255)).astype(np.uint8)
                place = {i: k for k, i in enumerate(some)}
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([node_of(s) if len(s) else None for s in sets], pa.int64()),
                        pa.array([bands[place[i]] if i in place else None for i in range(len(sets))], pa.list_(pa.int64())),
                        pa.array([codes[place[i]].tobytes() if i in place else None for i in range(len(sets))], pa.binary()),
                    ],
                    ["doc_id", "t", "n_shingles", "node", "bands", "codes"],
                )

    return docs.select("doc_id", "t", "text").mapInArrow(run, "doc_id long, t long, n_shingles long, node long, bands array<long>, codes binary")


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _groups(batches, keys: int):
    """Rows of each run of equal first ``keys`` columns, as tuples."""
    now, rows = None, []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if row[:keys] != now:
                if rows:
                    yield now, rows
                now, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield now, rows


def verify(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Exact links ``u, v`` among ``pairs`` (center, node), and inside the blocks of a center.

    A center's text goes to each of its blocks, every other text once for each of its centers.
    """
    degree = pairs.groupBy("center").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    rows = pairs.join(degree, "center").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).select("center", "block", "node")
    heads = degree.select("center", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("center").alias("node"))
    wanted = rows.unionByName(heads).join(nodes.select("node", "first", "t"), "node")
    texts = docs.withColumnRenamed("doc_id", "first").join(wanted, ["first", "t"]).select("center", "block", "node", "text")
    texts = texts.repartition("center", "block").sortWithinPartitions("center", "block")

    def run(batches):
        u, v = [], []
        for (center, _), rows in _groups(batches, 2):
            sets = {}
            for node, text in rows:
                s = shingles(text, size)
                if len(s) and node_of(s) == node:
                    sets[node] = s
            if center not in sets:
                continue
            roots = {n: n for n in sets}

            def root(n, roots=roots):
                while roots[n] != n:
                    roots[n] = n = roots[roots[n]]
                return n

            for n in sets:
                if n != center and linked(sets[center], sets[n], percent):
                    roots[n] = center
            rest = sorted(sets, key=lambda n: len(sets[n]))
            for i, a in enumerate(rest):
                for b in rest[i + 1 :]:
                    if 100 * len(sets[a]) < percent * len(sets[b]):
                        break
                    if root(a) != root(b) and linked(sets[a], sets[b], percent):
                        roots[root(a)] = root(b)
            for n in sets:
                if root(n) != n:
                    u.append(n)
                    v.append(root(n))
            if len(u) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])
                u, v = [], []
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return texts.mapInArrow(run, "u long, v long")


def _close(rows, percent: int):
    """Places of a pair of blocks' rows (node, root, n, codes, side, ...) whose sketches are close enough, of different components."""
    s = percent / 100
    least = s - SLACK * (s * (1 - s) / BINS) ** 0.5
    # Bytes of different values agree by chance once in 256.
    least = (least + (1 - least) / 256) * BINS
    root = np.array([r[1] for r in rows], np.int64)
    n = np.array([r[2] for r in rows], np.int64)
    side = np.array([r[4] for r in rows], np.int64)
    codes = np.frombuffer(b"".join(r[3] for r in rows), np.uint8).reshape(len(rows), BINS)
    same = bool((side == 2).all())
    for i in range(len(rows)):
        if not same and side[i] == 1:
            continue
        other = np.arange(len(rows)) > i if same else side == 1
        at = np.flatnonzero(other & (root != root[i]) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])))
        yield i, at[(codes[at] == codes[i]).sum(axis=1) >= least].tolist()


def _partnered(batches, percent: int):
    """The rows of each pair of blocks that have a partner there."""
    for key, rows in _groups(batches, 3):
        some: set[int] = set()
        for i, at in _close(rows, percent):
            if at:
                some |= {i, *at}
        if some:
            cols = [pa.array([k] * len(some), pa.int64()) for k in key] + [pa.array(c, t) for c, t in zip(zip(*[rows[i] for i in sorted(some)], strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32()), strict=True)]
            yield pa.RecordBatch.from_arrays(cols, ["area", "lo", "hi", "node", "root", "n", "codes", "side"])


def _meet(batches, size: int, percent: int):
    """Exact links between nodes of different components in a pair of blocks, where the sketches are close enough."""
    u, v = [], []
    for _, rows in _groups(batches, 3):
        sets: dict[int, np.ndarray | None] = {}
        roots: dict[int, int] = {r[1]: r[1] for r in rows}

        def root(k, roots=roots):
            while roots[k] != k:
                roots[k] = k = roots[roots[k]]
            return k

        def of(i, rows=rows, sets=sets):
            if i not in sets:
                found = shingles(rows[i][5], size)
                sets[i] = found if len(found) and node_of(found) == rows[i][0] else None
            return sets[i]

        for i, at in _close(rows, percent):
            for j in at:
                a, b = root(rows[i][1]), root(rows[j][1])
                if a != b and of(i) is not None and of(j) is not None and linked(of(i), of(j), percent):
                    roots[a] = b
                    u.append(rows[i][0])
                    v.append(rows[j][0])
    yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def classes(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id``, a row for each row of ``docs``."""
    return classified(docs, size, percent, id_col, text).select("doc_id", "n_shingles", "component_id")


def classified(docs: DataFrame, size: int, percent: int, id_col: str, text: str) -> DataFrame:
    """``classes``, with the hash ``t`` of the text and ``kept``: one row of each class, or of its equals, stays."""
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise ValueError(f"{id_col} must hold whole numbers")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("t"), F.col(text).alias("text"))
    with small_batches(docs.sparkSession):
        rows = save(sketched(docs, size))
        nodes = rows.where("node is not null and doc_id is not null").groupBy("node").agg(F.min(F.struct("doc_id", "t")).alias("d"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("codes").alias("codes"))
        nodes = save(nodes.select("node", F.col("d.doc_id").alias("first"), F.col("d.t").alias("t"), "n", "bands", "codes"))
        keys = nodes.select("node", "first", F.explode("bands").alias("key"))
        buckets = keys.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("first", "node")).alias("c")).where("m > 1")
        members = save(keys.join(buckets, "key").select("key", "node", "m", "c"))
        centers = save(members.where(F.col("node") != F.col("c.node")).groupBy("node").agg(F.min("c").alias("c")).select(F.col("c.node").alias("center"), "node"))
        links = save(verify(centers, nodes, docs, size, percent))
        discard(centers)
        roots = components(links)

        known = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        mixed = known.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
        open_ = save(known.select("key", "node", "root").join(mixed.select("key"), "key"))
        discard(members)
        if not open_.isEmpty():
            more = save(between(open_, nodes, docs, size, percent))
            discard(roots)
            roots = components(links.unionByName(more))
            discard(more)
        discard(open_, links)

    # The class of a node, and the node that stands for it.
    named = nodes.select("node", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min(F.struct("first", "node")).alias("c"))
    named = named.join(least, "root").select("node", F.col("c.first").alias("component_id"), F.col("c.node").alias("stays"))
    out = rows.select("doc_id", "t", "n_shingles", "node").join(named, "node", "left")
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
    alone = F.col("node").isNull() | F.col("doc_id").isNull()
    # The sketches are no longer needed: what is left are a few numbers a row.
    out = save(out.withColumn("kept", alone | ((F.col("doc_id") == F.col("component_id")) & (F.col("node") == F.col("stays")))))
    discard(rows, nodes, roots)
    return out


def between(open_: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Exact links ``u, v`` between the components that share a bucket of ``open_`` (key, node, root)."""
    # Buckets that share nodes are one area, so that nodes meet once, not once a band.
    leads = open_.groupBy("key").agg(F.min("node").alias("lead"))
    areas = components(open_.join(leads, "key").select(F.col("node").alias("u"), F.col("lead").alias("v")))
    inside = open_.select("node", "root").distinct().join(areas.select("node", F.col("root").alias("area")), "node", "left").withColumn("area", F.coalesce("area", "node"))
    count = inside.groupBy("area").agg(F.ceil(F.count(F.lit(1)) / (4 * BLOCK)).alias("blocks"))
    inside = inside.join(count, "area").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    inside = inside.select("area", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "node", "root", F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1).alias("side"))
    blocks = ["area", "lo", "hi"]
    meeting = inside.join(nodes.select("node", "n", "codes"), "node").select(*blocks, "node", "root", "n", "codes", "side")
    meeting = meeting.repartition(*blocks).sortWithinPartitions(*blocks)
    close = save(meeting.mapInArrow(lambda b: _partnered(b, percent), "area long, lo long, hi long, node long, root long, n long, codes binary, side int"))
    wanted = close.join(nodes.select("node", "first", "t"), "node")
    texts = docs.withColumnRenamed("doc_id", "first").join(wanted, ["first", "t"]).select(*blocks, "node", "root", "n", "codes", "side", "text")
    texts = texts.repartition(*blocks).sortWithinPartitions(*blocks)
    return texts.mapInArrow(lambda b: _meet(b, size, percent), "u long, v long")


def drop_copies(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each class stays, the one with the smallest id; of rows equal in id and text, one.

    Rows of one id whose texts are not linked are different documents, which all stay.
    """
    found = classified(docs, size, percent, id_col, text).where("kept")
    # Of one id and node, texts that differ in case or spaces only are one document.
    alone = F.when(F.col("node").isNull() | F.col("doc_id").isNull(), F.col("t"))
    stay = found.groupBy("doc_id", "node", alone).agg(F.min("t").alias("t")).select(F.col("doc_id").alias("id"), F.col("t").alias("x")).distinct()
    rows = packed(docs, id=F.col(id_col).cast("long"), x=F.xxhash64(F.col(text)))
    first = rows.where("id is not null").join(stay.where("id is not null"), ["id", "x"], "left_semi").dropDuplicates(["id", "x"])
    whole = first.unionByName(rows.where("id is null"))
    return whole.select(*unpacked(whole))


def op8_fast_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(documents(spark, sf_dir), size=4, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: All pairs that share a shingle, and what is reachable from each document.
ORACLE = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM p JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * common >= 80 * (a.n + b.n - common)),
r(u, v) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u),
c AS (SELECT u AS doc_id, min(v) AS component_id FROM r GROUP BY u)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""
