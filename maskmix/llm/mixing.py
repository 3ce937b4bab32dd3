"""Mixing sources to target weights along a time-varying curriculum (DataFrame operations only).

Each source's weight schedule is a line over training time; its integral is the share of the source's
demand that is consumed by a time. Documents of a source are laid end to end in a hash order, so that each
copy has a token offset; inverting the integral at that offset gives the copy's training position.

Hot sources: the hash order is cut into 4096 buckets a source. Offsets are sums inside a bucket plus the
prefix sum of the source's earlier buckets, so no task ever holds a whole source.

Defined cases: null text has size 0; a null source is a source of its own and last in order; an empty text is
taken 0 words; rows without an id are ordered by their text; rows of one id and size are ordered by their text, and
rows equal in all of it may swap places, which changes no result; an empty table gives no rows; schedules must not be
negative and are scaled to an integral of 1; other columns are carried along, whatever their names (``sized`` and
``lay_out`` replace columns named like their results).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from maskmix.llm.common import WORD, documents, let, packed, save, unpacked

#: Relative rate of consumption at the start and the end of training, by place of the source's weight.
SCHEDULES = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))
OWN = ("source_size", "target", "demand", "offset", "taken", "rate_0", "rate_1")


def scaled(schedules) -> list[tuple[float, float]]:
    """Schedules with an integral of 1 over training."""
    if any(min(s) < 0 or sum(s) <= 0 for s in schedules):
        raise ValueError("a schedule must not be negative and needs a positive integral")
    return [(2 * a / (a + b), 2 * b / (a + b)) for a, b in schedules]


def source_targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0, schedules=SCHEDULES) -> DataFrame:
    """One row per source: its size, target and schedule. ``sizes`` has ``_null, _source, size``.

    Water filling in closed form: in order of cap/weight, a prefix of the sources stops at its cap and the
    rest share what is left by weight; the prefix ends at the first source whose share is below its cap.
    """
    schedules = scaled(schedules)
    every = W.partitionBy(F.lit(0))
    ordinal = F.row_number().over(every.orderBy("_null", "_source")) - 1
    pick = lambda values, kind: F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), (F.pmod(F.col("_ix"), F.lit(len(values))) + 1).cast("int"))
    rows = sizes.groupBy("_null", "_source").agg(F.sum("size").alias("source_size")).withColumn("_ix", ordinal)
    rows = rows.withColumns({"_w": pick(weights, "long"), "rate_0": pick([a for a, _ in schedules], "double"), "rate_1": pick([b for _, b in schedules], "double")})
    rows = rows.withColumn("_cap", F.col("source_size") * F.lit(float(cap)))
    fill = every.orderBy(F.col("_cap") / F.col("_w"), "_ix").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumns({"_before": F.coalesce(F.sum("_cap").over(fill), F.lit(0.0)), "_wb": F.coalesce(F.sum("_w").over(fill), F.lit(0)), "_all": F.sum("_w").over(every), "_total": F.sum("source_size").over(every)})
    rows = rows.withColumn("_level", (F.col("_total") * F.lit(float(share)) - F.col("_before")) / (F.col("_all") - F.col("_wb")))
    # The level of the first source that stays below its cap holds for all such sources.
    level = F.min(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.struct(F.col("_cap") / F.col("_w"), F.col("_ix"), F.col("_level")))).over(every)
    rows = rows.withColumn("_first", level)
    capped = F.col("_first").isNull() | (F.struct(F.col("_cap") / F.col("_w"), F.col("_ix")) < F.struct(F.col("_first.col1"), F.col("_first._ix")))
    rows = rows.withColumn("target", F.when(capped, F.col("_cap")).otherwise(F.col("_first._level") * F.col("_w")))
    return rows.select("_null", "_source", "source_size", "target", F.floor(F.col("target") + 0.5).cast("long").alias("demand"), "rate_0", "rate_1")


def words_of(text: str):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def sized(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus ``size``."""
    return docs.withColumn("size", words_of(text))


def order_key(id_col: str, text: str | None):
    """Places of rows in their source's order; the text stands in for a missing id."""
    named = F.col(id_col).cast("string")
    return F.md5(F.coalesce(named, F.concat(F.lit("text:"), F.md5(F.coalesce(F.col(text), F.lit("")))), F.lit("")) if text else F.coalesce(named, F.lit("")))


def laid_out(rows: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0, schedules=SCHEDULES) -> DataFrame:
    """``rows`` (row, size, source, h, tie) plus ``OWN``."""
    rows = rows.withColumns({"_null": F.col("source").isNull(), "_source": F.coalesce(F.col("source").cast("string"), F.lit("")), "_bucket": F.substring("h", 1, 3)})
    parts = rows.groupBy("_null", "_source", "_bucket").agg(F.sum("size").alias("size"))
    targets = source_targets(parts, weights, share, cap, schedules)
    before = W.partitionBy("_null", "_source").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumn("_prefix", F.coalesce(F.sum("size").over(before), F.lit(0))).drop("size").join(targets, ["_null", "_source"])
    inside = W.partitionBy("_null", "_source", "_bucket").orderBy("h", "size", "tie").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(parts, ["_null", "_source", "_bucket"])
    rows = rows.withColumn("offset", F.col("_prefix") + F.col("_inside"))
    taken = sum((copy_taken(k) for k in range(1, copies(cap))), copy_taken(0))
    return rows.withColumn("taken", taken).select("row", "size", *OWN)


def copies(cap: float) -> int:
    """Copies of a document that a source's target can take."""
    return -int(-cap // 1)


def lay_out(docs: DataFrame, id_col: str = "doc_id", source: str = "source", text: str | None = None, **options) -> DataFrame:
    """``docs`` (with ``size``) plus ``source_size, target, demand, offset, taken`` and the schedule.

    ``text`` orders rows without an id, and rows that share one.
    """
    tie = F.xxhash64(text) if text else F.lit(0)
    rows = laid_out(packed(docs, size=F.col("size"), source=F.col(source), h=order_key(id_col, text), tie=tie), **options)
    return rows.select(*unpacked(rows, ("size", *OWN)), "size", *OWN)


def copy_taken(k: int):
    """Words taken of the k-th copy of a document."""
    return F.greatest(F.lit(0), F.least("size", F.col("demand") - F.lit(k) * F.col("source_size") - F.col("offset"))).cast("long")


def position(k: int = 0):
    """Training time, 0 to 1, at which the k-th copy starts; null if no word of it is taken."""
    u = (F.lit(k) * F.col("source_size") + F.col("offset")) / F.col("demand").cast("double")
    a, d = F.col("rate_0"), F.col("rate_1") - F.col("rate_0")
    t = F.when(d == 0, u).otherwise((F.sqrt(a * a + F.lit(2.0) * d * u) - a) / d)
    return F.when(copy_taken(k) > 0, t)


def in_order(rows: DataFrame, *keys: str) -> DataFrame:
    """Range-sorted by training position."""
    return rows.repartitionByRange(*keys).sortWithinPartitions(*keys)


def mix(docs: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text", cap: float = 2.0, **options) -> DataFrame:
    """The mixed documents, one row per copy taken, range-sorted by training position.

    The copy that meets the end of its source's demand is cut after its last taken word.
    """
    rows = packed(docs, size=words_of(text), source=F.col(source), h=order_key(id_col, text), tie=F.xxhash64(text))
    rows = laid_out(rows, cap=cap, **options)
    taken = F.array(*[F.struct(position(k).alias("at"), copy_taken(k).alias("words")) for k in range(copies(cap))])
    rows = rows.withColumn("copy", F.explode(F.filter(taken, lambda c: c["words"] > 0))).withColumn("t", F.col("row").getField(text))
    # The gaps before the first words and those words, joined again.
    parts = let(F.struct(F.split("t", WORD).alias("g"), F.regexp_extract_all("t", F.lit(WORD), F.lit(0)).alias("w")), lambda p: F.array_join(F.transform(F.slice(p["w"], 1, F.col("copy.words").cast("int")), lambda w, k: F.concat(F.get(p["g"], k), w)), ""))
    rows = rows.withColumn("t", F.when(F.col("copy.words") < F.col("size"), parts).otherwise(F.col("t"))).withColumns({"at": F.col("copy.at"), "id": F.col("row").getField(id_col)})
    new = {text: F.col("t"), "n_chars": F.length("t").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    # Only the result's columns travel, as one struct beside the position.
    made = F.struct(*[(new[c] if c in new else F.col("row").getField(c)).alias(c) for c in docs.columns])
    rows = in_order(rows.select("at", "id", made.alias("row")), "at", "id")
    return rows.select(*unpacked(rows))


def op9_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = save(sized(documents(spark, sf_dir)).withColumn("h", order_key("doc_id", "text")).select("doc_id", "source", "size", "h"))
    rows = laid_out(packed(docs, size=F.col("size"), source=F.col("source"), h=F.col("h"), tie=F.lit(0)))
    ppm = [F.floor(position(k) * 1000000).cast("long") for k in range(copies(2.0))]
    rows = rows.withColumns({"at": position(), "doc_id": F.col("row.doc_id"), "position_ppm": ppm[0], "second_ppm": ppm[1]})
    return in_order(rows, "at", "doc_id").select("doc_id", "size", "source_size", "target", "taken", "position_ppm", "second_ppm")


ORACLE = r"""
WITH d AS (SELECT doc_id, source IS NULL AS sn, coalesce(source, '') AS s, md5(coalesce(CAST(doc_id AS VARCHAR), 'text:' || md5(coalesce(text, '')))) AS h,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT sn, s, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY sn, s) - 1 AS ix FROM d GROUP BY sn, s),
w AS (SELECT *, [5, 2, 1][(ix % 3 + 1)::INT]::BIGINT AS w, [1.5, 1.0, 0.5][(ix % 3 + 1)::INT]::DOUBLE AS r0, [0.5, 1.0, 1.5][(ix % 3 + 1)::INT]::DOUBLE AS r1, source_size * 2.0::DOUBLE AS cap FROM s),
f AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0::DOUBLE) AS cb,
    coalesce(sum(w) OVER (ORDER BY cap / w, ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS wb, sum(w) OVER () AS wa, sum(source_size) OVER () AS total FROM w),
l AS (SELECT *, (total::DOUBLE * 1.5::DOUBLE - cb) / (wa - wb)::DOUBLE AS level FROM f),
m AS (SELECT *, min(CASE WHEN level * w <= cap THEN row(cap / w, ix, level) END) OVER () AS first FROM l),
t AS (SELECT sn, s, source_size, r0, r1, CASE WHEN first IS NULL OR row(cap / w, ix) < row(first[1], first[2]) THEN cap ELSE first[3] * w END AS target FROM m),
o AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.r0, t.r1, floor(t.target + 0.5)::BIGINT AS demand,
    coalesce(sum(d.size) OVER (PARTITION BY d.sn, d.s ORDER BY d.h, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS o FROM d JOIN t ON d.sn = t.sn AND d.s = t.s)
SELECT doc_id, size, source_size, target, (greatest(0, least(size, demand - o)) + greatest(0, least(size, demand - source_size - o)))::BIGINT AS taken,
    CASE WHEN least(size, demand - o) > 0 THEN floor((CASE WHEN r1 = r0 THEN o / demand::DOUBLE ELSE (sqrt(r0 * r0 + 2.0::DOUBLE * (r1 - r0) * (o / demand::DOUBLE)) - r0) / (r1 - r0) END) * 1000000)::BIGINT END AS position_ppm,
    CASE WHEN least(size, demand - source_size - o) > 0 THEN floor((CASE WHEN r1 = r0 THEN (source_size + o) / demand::DOUBLE ELSE (sqrt(r0 * r0 + 2.0::DOUBLE * (r1 - r0) * ((source_size + o) / demand::DOUBLE)) - r0) / (r1 - r0) END) * 1000000)::BIGINT END AS second_ppm
FROM o
"""
