"""The star schema's tables as annotated datasets: five datasets with partly disjoint keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskmix.operators.unify import concatenate, with_index
from maskmix.schema import DatasetSchema, TensorSpec, UnifiedSchema

EVENT_TYPES = "etype"

SCHEMAS = {
    "orders": DatasetSchema((TensorSpec("lines", time_dim=6, feature_dim=4, dtype="float64"),), (TensorSpec("total", dtype="float64", placeholder=-5.0), TensorSpec("priority", dtype="int64", placeholder=-1))),
    "users": DatasetSchema((TensorSpec("values", time_dim=64, dtype="float64"),), (TensorSpec("etype", time_dim=64, dtype="int64", placeholder=-1),)),
    "vectors": DatasetSchema((TensorSpec("emb", feature_dim=64),), (TensorSpec("label", dtype="int64", placeholder=-1),)),
    "docs": DatasetSchema((TensorSpec("n_chars", dtype="float64"),), (TensorSpec("quality", dtype="int64", placeholder=-1), TensorSpec("toxic", dtype="int64", placeholder=-1))),
    "chats": DatasetSchema((TensorSpec("turn_len", time_dim=8, dtype="float64"),)),
}
ORDERS = {"orders": "o_orderkey", "users": "user_id", "vectors": "vec_id", "docs": "doc_id", "chats": "conv_id"}


def _sequence(df: DataFrame, by: str, order: Sequence[str], **values) -> DataFrame:
    """Arrays by key, in the order of unique columns; one aggregate.

    A value is a column, or a function of a step's order columns, which then travel once.
    """
    carried = [v.alias(f"_{k}") for k, v in values.items() if not callable(v)]
    rows = df.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(*order, *carried))).alias("r"))
    return rows.select(by, *[(F.transform("r", v) if callable(v) else F.col(f"r._{k}")).alias(k) for k, v in values.items()])


def read(spark: SparkSession, sf_dir: str, name: str, index: bool = False) -> DataFrame:
    """A dataset's raw rows; with ``index`` they have ``local_ix``, ranked on the narrow table before the sequences join."""
    table = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    ranked = lambda df: with_index(df, [ORDERS[name]]) if index else df
    if name == "orders":
        step = lambda r: F.array(*[r[c].cast("double") for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")])
        lines = _sequence(table("lineitem"), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax"], lines=step)
        orders = ranked(table("orders").select("o_orderkey", F.col("o_totalprice").alias("total"), (F.substring("o_orderpriority", 1, 1).cast("long") - 1).alias("priority")))
        return orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left").drop("l_orderkey")
    if name == "users":
        events = table("events")
        kinds = events.select("event_type").distinct().agg(F.sort_array(F.collect_set("event_type")).alias("kinds"))  # one row, a few names
        events = events.join(F.broadcast(kinds))
        return ranked(_sequence(events, "user_id", ["ts", "event_id"], values=F.col("value"), etype=(F.array_position("kinds", F.col("event_type")) - 1)))
    if name == "vectors":
        return ranked(table("embeddings").select("vec_id", F.col("embedding").alias("emb"), F.col("label").cast("long").alias("label")))
    if name == "docs":
        labels = table("labels").select("doc_id", F.col("quality").cast("long").alias("quality"), F.col("toxic").cast("long").alias("toxic"))
        return ranked(table("documents").select("doc_id", F.col("n_chars").cast("double").alias("n_chars"))).join(labels, "doc_id", "left")
    if name == "chats":
        return ranked(_sequence(table("conversations"), "conv_id", ["turn"], turn_len=F.length("text").cast("double")))
    raise ValueError(f"unknown dataset {name!r}")


def size(spark: SparkSession, sf_dir: str, name: str) -> int:
    """Samples of a dataset, from its narrowest table."""
    source, key = {"orders": ("orders", None), "users": ("events", "user_id"), "vectors": ("embeddings", None), "docs": ("documents", None), "chats": ("conversations", "conv_id")}[name]
    rows = spark.read.parquet(f"{sf_dir}/{source}.parquet")
    return rows.select(key).distinct().count() if key else rows.count()


def union_schema(*names: str) -> UnifiedSchema:
    return UnifiedSchema([SCHEMAS[n] for n in names])


def unified(spark: SparkSession, sf_dir: str, *names: str, pad_features: bool = True, index: bool = True) -> tuple[DataFrame, UnifiedSchema]:
    schema = union_schema(*names)
    sets = [read(spark, sf_dir, n, index) for n in names]
    sizes = [size(spark, sf_dir, n) for n in names[:-1]] if index else None
    return concatenate(sets, schema, [[ORDERS[n]] for n in names], sizes, names, pad_features, index), schema
