"""HDF5 files: ``<subset>/<sample>/<key>``, one group a sample. Needs the optional package h5py.

The driver lists the sample names; each partition opens the file itself, so nothing has to be pickled.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader

from maskmix.sources.npy import SAMPLES_A_PARTITION, _Samples, as_row, spark_type


def _h5py():
    try:
        import h5py
    except ImportError as e:
        raise ImportError("the hdf5 source needs the package h5py") from e
    return h5py


def decode(value):
    """A dataset's content as a plain value: text decoded, scalars unwrapped."""
    if isinstance(value, bytes):
        return value.decode()
    if isinstance(value, np.generic):
        return value.item()
    return as_row(np.asarray(value)) if isinstance(value, np.ndarray) else value


def _type(dataset) -> T.DataType:
    text = dataset.dtype.kind in "SO"
    return spark_type(np.dtype(str) if text else dataset.dtype, dataset.ndim)


class _Reader(DataSourceReader):
    def __init__(self, path: str, subset: str, schema: T.StructType, names: list[str]):
        self.path, self.subset, self.schema, self.names = path, subset, schema, names

    def partitions(self):
        return [_Samples(self.names[i : i + SAMPLES_A_PARTITION], i) for i in range(0, len(self.names), SAMPLES_A_PARTITION)]

    def read(self, partition):
        with _h5py().File(self.path, "r") as f:
            for i, name in enumerate(partition.names):
                group = f[self.subset][name]
                yield tuple(partition.first + i if c == "local_ix" else decode(group[c][()]) if c in group else None for c in self.schema.names)


class Hdf5(DataSource):
    """Format ``hdf5``: options ``path``, ``subset`` and ``keys`` (all of the first sample if not given)."""

    @classmethod
    def name(cls):
        return "hdf5"

    def samples(self) -> list[str]:
        with _h5py().File(self.options["path"], "r") as f:
            if self.options["subset"] not in f:
                raise KeyError(self.options["subset"])
            return sorted(f[self.options["subset"]])

    def schema(self):
        names = self.samples()
        with _h5py().File(self.options["path"], "r") as f:
            group = f[self.options["subset"]]
            keys = [k for k in self.options.get("keys", "").split(",") if k] or sorted({k for n in names[:1] for k in group[n]})
            fields = []
            for k in keys:
                holder = next((group[n] for n in names if k in group[n]), None)
                if holder is not None:
                    fields.append(T.StructField(k, _type(holder[k])))
        return T.StructType([*fields, T.StructField("local_ix", T.LongType())])

    def reader(self, schema):
        return _Reader(self.options["path"], self.options["subset"], schema, self.samples())


def read_hdf5(spark: SparkSession, path: str, subset: str, keys: Sequence[str] | None = None) -> DataFrame:
    """A row a sample of the subset, in the order of their names."""
    _h5py()
    spark.dataSource.register(Hdf5)
    return spark.read.format("hdf5").option("path", path).option("subset", subset).option("keys", ",".join(keys or ())).load()
