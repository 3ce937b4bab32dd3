"""Class histograms and weights for imbalanced targets."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from maskmix.schema import TensorSpec, UnifiedSchema


def valid_classes(df: DataFrame, spec: TensorSpec, *carry: str) -> DataFrame:
    """``cls`` of every valid scalar or step, with the carried columns."""
    value, mask = F.col(spec.name), F.col(f"{spec.name}_mask")
    if spec.is_sequence:
        return df.select(*carry, F.explode(F.arrays_zip(value.alias("v"), mask.alias("m"))).alias("z")).where("z.m").select(*carry, F.col("z.v").cast("long").alias("cls"))
    return df.where(mask).select(*carry, value.cast("long").alias("cls"))


def class_histogram(df: DataFrame, schema: UnifiedSchema, target: str, num_classes: int | None = None) -> DataFrame:
    """``cls, n`` for every class from 0 to the largest (or ``num_classes`` - 1), also the empty ones.

    The number of classes is declared or one aggregate; ids outside are an error.
    """
    spec = schema.spec(target)
    rows = valid_classes(df, spec)
    if num_classes is None:
        top = rows.agg(F.max("cls")).first()[0]
        num_classes = 0 if top is None else int(top) + 1
    bad = F.raise_error(F.concat(F.lit("class id out of range: "), F.col("cls").cast("string"))).cast("long")
    rows = rows.select(F.when((F.col("cls") < 0) | (F.col("cls") >= num_classes), bad).otherwise(F.col("cls")).alias("cls"))
    # The union with one empty row a class keeps the order of magnitude of the aggregate and raises for any bad id.
    every = df.sparkSession.range(num_classes).select(F.col("id").alias("cls"), F.lit(0).cast("long").alias("n"))
    return rows.select("cls", F.lit(1).cast("long").alias("n")).unionByName(every).groupBy("cls").agg(F.sum("n").alias("n"))


def loss_weights(histogram: DataFrame, scheme: str = "inverse", beta: float = 0.999) -> DataFrame:
    """``cls, n, weight`` with mean 1 over all classes, 0 for empty ones. One row a class."""
    n = F.col("n").cast("double")
    if scheme == "inverse":
        raw = 1 / n
    elif scheme == "effective":
        raw = (1 - F.lit(beta)) / F.greatest(1 - F.pow(F.lit(beta), n), F.lit(1e-12))
    else:
        raise ValueError(f"unknown scheme {scheme!r}")
    rows = histogram.withColumn("raw", F.when(F.col("n") > 0, raw).otherwise(F.lit(0.0)))
    every = W.partitionBy(F.lit(0))
    total = F.sum("raw").over(every)
    return rows.withColumn("weight", F.when(total > 0, F.col("raw") * F.count(F.lit(1)).over(every) / total).otherwise(F.lit(0.0))).select("cls", "n", "weight")


def sample_classes(df: DataFrame, schema: UnifiedSchema, target: str, *ids: str) -> DataFrame:
    """``ids, cls``: the class of a sample, or its commonest valid step class (ties: the lowest id); null if none."""
    spec = schema.spec(target)
    if not spec.is_sequence:
        return df.select(*ids, F.when(F.col(f"{target}_mask"), F.col(target).cast("long")).alias("cls"))
    steps = F.transform(F.filter(F.arrays_zip(F.col(target).alias("v"), F.col(f"{target}_mask").alias("m")), lambda z: z["m"]), lambda z: z["v"].cast("long"))
    # In the row: among the distinct ids, the one with the most steps, smaller ids first.
    ranked = F.transform(F.array_distinct(F.col("_s")), lambda c: F.struct((-F.size(F.filter(F.col("_s"), lambda x: x == c))).alias("n"), c.alias("c")))
    return df.select(*ids, steps.alias("_s")).select(*ids, F.array_min(ranked)["c"].alias("cls"))


def sampler_weights(df: DataFrame, schema: UnifiedSchema, target: str, *ids: str) -> DataFrame:
    """``ids, cls, weight``: 1 over the number of samples of the class, 0 without a class.

    Counts are aggregated and joined back (one row a class), rather than windowed, so that a hot class is no
    task's alone.
    """
    rows = sample_classes(df, schema, target, *ids)
    counts = rows.where("cls is not null").groupBy("cls").agg(F.count(F.lit(1)).alias("_n"))
    return rows.join(counts, "cls", "left").select(*ids, "cls", F.coalesce(1 / F.col("_n"), F.lit(0.0)).alias("weight"))


def save_weights(weights: DataFrame, path: str, target: str, scheme: str) -> dict:
    rows = weights.orderBy("cls").collect()
    out = {"target": target, "scheme": scheme, "num_classes": len(rows), "counts": [r.n for r in rows], "weights": [r.weight for r in rows]}
    with open(path, "w") as f:
        json.dump(out, f, indent=2)
    return out
