"""Dense ranks of any number of rows: buckets in the order of the key, ranked each by itself, behind the counts of the earlier ones.

No task sees more than a bucket, but for the table of the buckets' counts, which has at most ``BUCKETS`` rows a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Buckets of a digest (its first three digits), rows that one task may rank, and ordering keys that a split looks at.
BUCKETS, SMALL, LOOKED_AT = 4096, 1 << 17, 20_000


def _behind_counts(rows: DataFrame, order: Sequence, within: Sequence[str], rank: str, total: str | None) -> DataFrame:
    """``rows`` with ``_b``, ranked inside (within, _b) by ``order``, plus the rows of earlier buckets."""
    counts = rows.groupBy(*within, "_b").agg(F.count(F.lit(1)).alias("_c"))
    group = W.partitionBy(*within) if within else W.partitionBy(F.lit(0))
    found = [F.coalesce(F.sum("_c").over(group.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_c").over(group).alias("_all")]
    counts = counts.select(*[F.col(c).alias(f"_w{i}") for i, c in enumerate(within)], F.col("_b").alias("_bucket"), *found)
    rows = rows.withColumn("_inside", F.row_number().over(W.partitionBy(*within, "_b").orderBy(*order)) - 1)
    same = F.col("_b").eqNullSafe(F.col("_bucket"))
    for i, c in enumerate(within):
        same &= F.col(c).eqNullSafe(F.col(f"_w{i}"))
    rows = rows.join(counts if within else F.broadcast(counts), same)
    out = rows.withColumn(rank, (F.col("_before") + F.col("_inside")).cast("long"))
    if total:
        out = out.withColumn(total, F.col("_all"))
    return out.drop("_b", "_bucket", "_before", "_all", "_inside", *[f"_w{i}" for i in range(len(within))])


def rank_by_digest(rows: DataFrame, digest: Column, ties: Sequence[str] = (), within: Sequence[str] = (), rank: str = "rank", total: str | None = None) -> DataFrame:
    """``rows`` plus ``rank`` from 0 in the order of an md5 in hexadecimal (ties by columns), in each group of ``within``.

    ``total`` names a column for the group's number of rows.
    """
    rows = rows.withColumn("_h", digest).withColumn("_b", F.substring("_h", 1, 3))
    return _behind_counts(rows, ["_h", *ties], within, rank, total).drop("_h")


def splitters(keys: DataFrame, parts: int) -> list:
    """Keys that cut ``keys`` into about ``parts`` equal pieces, from those whose hash is below a bound."""
    n = keys.count()
    share = min(1.0, LOOKED_AT / max(n, 1))
    looked = keys.where(F.pmod(F.xxhash64(*keys.columns), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    found = looked.orderBy(*keys.columns).limit(4 * LOOKED_AT).collect()
    return [found[i * len(found) // parts] for i in range(1, parts)] if len(found) > parts else []


def cut_at(df: DataFrame, own: Column, cuts: Sequence[Column], name: str) -> DataFrame:
    """``df`` plus ``name``, how many of the sorted ``cuts`` are at most ``own``.

    By halving, a projection a step: a row looks at the logarithm of their number, in compiled code.
    """
    df, all_cuts = df.withColumn(name, F.lit(0)), F.array(*cuts)
    for k in reversed(range(len(cuts).bit_length())):
        df = df.withColumn(name, F.col(name) + F.when(F.get(all_cuts, F.col(name) + (1 << k) - 1) <= own, 1 << k).otherwise(0))
    return df


def rank_by_columns(df: DataFrame, order: Sequence[str], rank: str = "rank", small: int | None = None) -> DataFrame:
    """``df`` plus ``rank`` from 0 by the order columns, which must be unique.

    Up to ``SMALL`` rows are one sorted pass; more are cut at keys that a bounded look at the ordering columns gives.
    """
    keys = df.select(*order)
    if keys.limit((SMALL if small is None else small) + 1).count() <= (SMALL if small is None else small):
        return df.withColumn(rank, F.row_number().over(W.orderBy(*order)).cast("long") - 1)
    parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = splitters(keys, parts)
    if not cuts:
        return df.withColumn(rank, F.row_number().over(W.orderBy(*order)).cast("long") - 1)
    kinds = [f.dataType for f in keys.schema.fields]
    row = lambda values: [F.lit(v).cast(k).alias(f"c{i}") for i, (v, k) in enumerate(zip(values, kinds, strict=True))]
    own = [F.col(c).alias(f"c{i}") for i, c in enumerate(order)]
    key = F.struct if len(own) > 1 else lambda c: c
    return _behind_counts(cut_at(df, key(*own), [key(*row(c)) for c in cuts], "_b"), list(order), (), rank, None)
