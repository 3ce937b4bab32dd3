"""Disjoint random splits, plain or stratified."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskmix.functions.arrays import digest
from maskmix.operators.rank import rank_by_digest

NAMES = ("train", "valid", "test")


def split(df: DataFrame, id_col: str, ratios: Sequence[float] = (0.8, 0.1, 0.1), seed: int = 0, stratify: str | None = None, names: Sequence[str] = NAMES) -> DataFrame:
    """``df`` plus ``split``: rows in a seeded order are cut at rounded shares (half to even); the last takes the rest.

    Rows are ranked in buckets of their digest, so neither a stratum nor the whole is one task's.
    """
    names = list(names)[: len(ratios)]
    if len(names) != len(ratios):
        raise ValueError("one name a ratio is needed")
    if any(r < 0 for r in ratios) or sum(ratios) <= 0 or sum(ratios) > 1 + 1e-6:
        raise ValueError("ratios must not be negative and sum to 1 at most")
    within = [stratify] if stratify else []
    rows = rank_by_digest(df, digest(seed, "split", F.col(id_col)), [id_col], within, "_r", "_n")
    case, at = None, 0
    for name, ratio in zip(names[:-1], ratios[:-1], strict=True):
        # Each share is rounded by itself; cuts are their sums.
        cut = F.bround(F.col("_n") * F.lit(float(ratio))).cast("long")
        at = cut if isinstance(at, int) else at + cut
        case = F.when(F.col("_r") < at, name) if case is None else case.when(F.col("_r") < at, name)
    value = F.lit(names[-1]) if case is None else case.otherwise(names[-1])
    return rows.withColumn("split", value).drop("_r", "_n")


def save_split_info(splits: DataFrame, id_col: str, path: str, **meta) -> dict:
    """JSON of the ids of each split, sorted, and their counts. For indices of a size that a file can hold."""
    out: dict = {}
    for r in splits.groupBy("split").agg(F.sort_array(F.collect_list(id_col)).alias("ids")).collect():
        out[r.split] = list(r.ids)
    info = {"splits": out, "counts": {k: len(v) for k, v in out.items()}, **meta}
    with open(path, "w") as f:
        json.dump(info, f)
    return info


def load_split_info(path: str) -> dict[str, list[int]]:
    with open(path) as f:
        return json.load(f)["splits"]
