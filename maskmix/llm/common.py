"""Helpers shared by the training-data operators."""

from __future__ import annotations

import getpass
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space (Java and RE2 syntax).
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of an Arrow batch with texts, where ``small_batches`` holds.
BATCH = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, which the session names in ``spark.checkpoint.dir``.

    Only a local session, whose tasks run on this machine, gets a temporary folder where none is named.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"{tempfile.gettempdir()}/maskmix-{getpass.getuser()}"
        spark.sparkContext.setCheckpointDir(found)
    return found


def _file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def save(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage and survives lost executors.

    The folder goes when the application ends, or with ``discard``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/maskmix-{uuid.uuid4().hex}"
    df.write.parquet(path)
    system, where = _file_system(spark, path)
    system.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def discard(*saved: DataFrame) -> None:
    """Delete tables of ``save`` that nothing reads any more."""
    for df in saved:
        path = getattr(df, "_saved_at", None)
        if path:
            system, where = _file_system(df.sparkSession, path)
            system.delete(where, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@contextmanager
def small_batches(spark: SparkSession):
    """Inside, what runs hands Python at most ``BATCH`` rows at once (a smaller setting stays); afterwards the session
    is as before. A batch is held several times over, by the JVM outside its heap and by Python."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if not 0 < int(before) <= BATCH:
        spark.conf.set(key, BATCH)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def packed(docs: DataFrame, **columns: Column) -> DataFrame:
    """The row as the struct ``row`` beside ``columns``, so that no name of the input meets one of an operator."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[v.alias(k) for k, v in columns.items()])


def unpacked(rows: DataFrame, drop: tuple[str, ...] = ()) -> list[Column]:
    """The packed columns but ``drop``."""
    return [F.col("row").getField(c).alias(c) for c in rows.schema["row"].dataType.names if c not in drop]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    Inside a lambda an outer expression is evaluated again for every element; a lambda variable is not.
    """
    return F.transform(F.array(value), body).getItem(0)
