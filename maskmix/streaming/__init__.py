"""Unify and stateless transforms on streams.

Both are projections (and broadcast joins with small tables), so they run on an unbounded table as they are.
Plans and batch operators are for bounded tables only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from maskmix.operators.transforms import Transform
from maskmix.operators.unify import unify
from maskmix.schema import UnifiedSchema


def unified_stream(spark: SparkSession, path: str, like: DataFrame, schema: UnifiedSchema, transforms: Sequence[Transform] = (), training: bool = False, seed: int = 0, epoch: int = 0, pad_features: bool = True) -> DataFrame:
    """Files that arrive in ``path`` (parquet, columns as ``like``), unified and transformed.

    ``gix`` must be a column of the files where a transform draws.
    """
    rows = unify(spark.readStream.schema(like.schema).parquet(path), schema, pad_features)
    for t in transforms:
        rows = t(rows, training, seed, epoch)
    return rows
