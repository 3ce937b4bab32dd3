"""Datasets by configuration: adapters by name, schemas from dicts."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from maskmix.schema import DatasetSchema, TensorSpec
from maskmix.sources.hdf5 import read_hdf5
from maskmix.sources.npy import read_npy


def read_parquet(spark: SparkSession, path: str, keys: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*keys) if keys else df


def read_table(spark: SparkSession, name: str, keys: Sequence[str] | None = None) -> DataFrame:
    df = spark.table(name)
    return df.select(*keys) if keys else df


ADAPTERS: dict[str, Callable[..., DataFrame]] = {
    "hdf5": lambda spark, h5_path, subset, keys=None, cache_size=0, preload=False: _kept(read_hdf5(spark, h5_path, subset, keys), cache_size or preload),
    "npy": lambda spark, root, keys=None, mmap=True: read_npy(spark, root, keys),
    "parquet": read_parquet,
    "table": read_table,
}


def _kept(df: DataFrame, keep) -> DataFrame:
    """Repeated reads come from executors' storage, which spills and may be evicted."""
    return df.persist() if keep else df


def from_tensors(spark: SparkSession, tensors: Mapping[str, Sequence], metadata: Mapping[str, Sequence] | None = None) -> DataFrame:
    """An in-memory dataset from columns of one length, with ``local_ix``."""
    columns = {**tensors, **(metadata or {})}
    lengths = {len(v) for v in columns.values()}
    if not tensors or len(lengths) != 1 or lengths == {0}:
        raise ValueError("columns of one positive length are needed")
    plain = lambda v: v.tolist() if hasattr(v, "tolist") else v
    rows = list(zip(*[[plain(x) for x in v] for v in columns.values()], range(lengths.pop()), strict=True))
    return spark.createDataFrame(rows, [*columns, "local_ix"])


def spec_from_dict(data: Mapping) -> TensorSpec:
    args = dict(data)
    if args.get("shape") is not None:
        args["shape"] = tuple(args["shape"])
    return TensorSpec(**args)


def schema_from_dict(data: Mapping) -> DatasetSchema:
    """Features and targets, both empty if absent."""
    return DatasetSchema(*[tuple(spec_from_dict(s) for s in data.get(part) or ()) for part in ("features", "targets")])


def build_dataset(spark: SparkSession, entry: Mapping) -> tuple[DataFrame, DatasetSchema, list[str]]:
    """The dataset, its schema and its order columns, of ``{adapter, args, schema, order}``."""
    adapter = entry.get("adapter")
    if adapter not in ADAPTERS:
        raise ValueError(f"unknown adapter {adapter!r}; known: {', '.join(ADAPTERS)}")
    df = ADAPTERS[adapter](spark, **(entry.get("args") or {}))
    return df, schema_from_dict(entry.get("schema") or {}), list(entry.get("order") or (["local_ix"] if "local_ix" in df.columns else df.columns[:1]))


def build_datasets(spark: SparkSession, entries: Sequence[Mapping]) -> tuple[list[DataFrame], list[DatasetSchema], list[list[str]]]:
    made = [build_dataset(spark, e) for e in entries]
    return [d for d, _, _ in made], [s for _, s, _ in made], [o for _, _, o in made]


def materialise(df: DataFrame, path: str, *partition_by: str) -> DataFrame:
    """Write unified rows or a plan as parquet and read them back."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.parquet(path)
