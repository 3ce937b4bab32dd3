"""Folders of arrays: ``root/<sample>/<key>.npy``, read by a Python data source.

The driver lists the samples; a partition is a run of sample names, opened where it is read. For stores that only
Spark's readers reach, ``read_binary`` does the same over the ``binaryFile`` source.
"""

from __future__ import annotations

import io
import os
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SAMPLES_A_PARTITION = 256


def spark_type(kind: np.dtype, rank: int) -> T.DataType:
    """The column type of an array: at most two array levels, steps flattened."""
    kinds = {"b": T.BooleanType(), "i": T.LongType() if kind.itemsize > 4 else T.IntegerType(), "u": T.LongType(), "f": T.DoubleType() if kind.itemsize > 4 else T.FloatType()}
    out: T.DataType = kinds.get(kind.kind, T.StringType())
    for _ in range(min(rank, 2)):
        out = T.ArrayType(out)
    return out


def as_row(value: np.ndarray):
    """An array as nested lists of at most two levels; text is decoded."""
    if value.dtype.kind in "SO":
        value = np.vectorize(lambda x: x.decode() if isinstance(x, bytes) else str(x), otypes=[object])(value)
    return (value.reshape(value.shape[0], -1) if value.ndim > 2 else value).tolist()


class _Samples(InputPartition):
    def __init__(self, names: list[str], first: int):
        self.names, self.first = names, first


class _Reader(DataSourceReader):
    def __init__(self, root: str, schema: T.StructType, names: list[str]):
        self.root, self.schema, self.names = root, schema, names

    def partitions(self):
        return [_Samples(self.names[i : i + SAMPLES_A_PARTITION], i) for i in range(0, len(self.names), SAMPLES_A_PARTITION)]

    def read(self, partition):
        for i, name in enumerate(partition.names):
            row = []
            for f in self.schema.fields:
                path = os.path.join(self.root, name, f"{f.name}.npy")
                if f.name == "key":
                    row.append(name)
                elif f.name == "local_ix":
                    row.append(partition.first + i)
                else:
                    row.append(as_row(np.load(path, mmap_mode="r")) if os.path.exists(path) else None)
            yield tuple(row)


class NpyFolder(DataSource):
    """Format ``npy``: options ``path`` and ``keys`` (comma-separated; the first sample's if not given)."""

    @classmethod
    def name(cls):
        return "npy"

    def samples(self) -> list[str]:
        root = self.options["path"]
        names = sorted(d for d in os.listdir(root) if os.path.isdir(os.path.join(root, d))) if os.path.isdir(root) else []
        if not names:
            raise FileNotFoundError(f"no sample folders in {root}")
        return names

    def schema(self):
        root, names = self.options["path"], self.samples()
        keys = [k for k in self.options.get("keys", "").split(",") if k] or sorted(f[:-4] for f in os.listdir(os.path.join(root, names[0])) if f.endswith(".npy"))
        fields = []
        for k in keys:
            # The first sample that has the key gives its type.
            path = next((p for n in names if os.path.exists(p := os.path.join(root, n, f"{k}.npy"))), None)
            a = np.load(path, mmap_mode="r") if path else np.zeros(0, np.float32)
            fields.append(T.StructField(k, spark_type(a.dtype, a.ndim)))
        return T.StructType([*fields, T.StructField("key", T.StringType()), T.StructField("local_ix", T.LongType())])

    def reader(self, schema):
        return _Reader(self.options["path"], schema, self.samples())


def read_npy(spark: SparkSession, root: str, keys: Sequence[str] | None = None) -> DataFrame:
    """A row a sample: its arrays, ``key`` (the folder's name) and ``local_ix``."""
    spark.dataSource.register(NpyFolder)
    return spark.read.format("npy").option("path", root).option("keys", ",".join(keys or ())).load()


def read_binary(spark: SparkSession, root: str, types: dict[str, T.DataType]) -> DataFrame:
    """The same for declared keys over any path Spark can read: files are decoded and grouped by folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").option("recursiveFileLookup", "true").load(root)
    parts = F.split("path", "/")
    files = files.select(F.element_at(parts, -2).alias("key"), F.regexp_replace(F.element_at(parts, -1), r"\.npy$", "").alias("name"), "content").where(F.col("name").isin(list(types)))
    schema = T.StructType([T.StructField("key", T.StringType()), *[T.StructField(k, t) for k, t in types.items()]])

    def decode(frames):
        for frame in frames:
            rows = []
            for key, name, content in frame.itertuples(index=False):
                rows.append({"key": key, **dict.fromkeys(types), name: as_row(np.load(io.BytesIO(content)))})
            yield pd.DataFrame(rows, columns=["key", *types])

    rows = files.mapInPandas(decode, schema)
    return rows.groupBy("key").agg(*[F.first(k, ignorenulls=True).alias(k) for k in types])
