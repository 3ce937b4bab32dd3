"""Statistics over valid positions, as grouped aggregates.

Rows are exploded to ``(dataset, key, channel, x)`` and aggregated in two phases, so a hot dataset is a few rows
per task. Exact percentiles come from a count for each distinct value of a group, dealt out by value and narrowed
down in rounds, so no task reads all values of a group; ``accuracy`` switches to bounded sketches.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from maskmix.schema import UnifiedSchema

FIELDS = ("mean", "std", "min", "max", "median", "iqr")
QUARTILES = (0.25, 0.5, 0.75)
#: Cells of the first round for a factor of e, and of the second round for a cell of the first.
PER_FACTOR, PER_CELL = 64, 4096


def resolve_keys(schema: UnifiedSchema | None, keys: Sequence[str] | None, sequences: bool = False) -> list[str]:
    """Explicit keys, or the schema's features (only sequences, if asked)."""
    if keys is not None:
        return list(keys)
    if schema is None:
        raise ValueError("give keys or a schema")
    return [k for k in schema.feature_keys if not sequences or schema.spec(k).is_sequence]


def valid_values(df: DataFrame, schema: UnifiedSchema, keys: Sequence[str]) -> DataFrame:
    """``dataset, key, channel, x`` of every valid position."""
    parts = []
    for k in keys:
        spec, m = schema.spec(k), F.col(f"{k}_mask")
        rows = df.select("dataset" if "dataset" in df.columns else F.lit(None).cast("string").alias("dataset"), F.col(k).alias("v"), m.alias("m"))
        if spec.is_sequence:
            rows = rows.select("dataset", F.explode(F.arrays_zip("v", "m")).alias("z")).where("z.m").select("dataset", F.col("z.v").alias("v"))
        else:
            rows = rows.where("m").select("dataset", "v")
        if spec.width:
            rows = rows.select("dataset", F.posexplode("v").alias("channel", "x"))
        else:
            rows = rows.select("dataset", F.lit(0).alias("channel"), F.col("v").alias("x"))
        parts.append(rows.select("dataset", F.lit(k).alias("key"), "channel", F.col("x").cast("double").alias("x")))
    return reduce(DataFrame.unionByName, parts)


def feature_stats(df: DataFrame, schema: UnifiedSchema, keys: Sequence[str] | None = None, eps: float = 1e-6) -> DataFrame:
    """``key, channel, mean, std`` with the population deviation, at least ``eps``."""
    rows = valid_values(df, schema, resolve_keys(schema, keys))
    return rows.groupBy("key", "channel").agg(F.avg("x").alias("mean"), F.greatest(F.stddev_pop("x"), F.lit(eps)).alias("std"))


def _deviation(std: Column, n: Column, eps: float, single: str) -> Column:
    if single == "nan":
        return F.when(n == 1, F.lit(float("nan"))).otherwise(F.greatest(std, F.lit(eps)))
    return F.greatest(F.coalesce(std, F.lit(eps)), F.lit(eps))


def _ranks(n: Column) -> list[tuple[Column, Column, Column]]:
    """Position of each quartile in sorted values, and the ranks below and above it."""
    return [((n - 1) * F.lit(p), F.floor((n - 1) * F.lit(p)), F.ceil((n - 1) * F.lit(p))) for p in QUARTILES]


def _magnitude(x: Column) -> Column:
    """A cell number that never falls as ``x`` rises: by sign and rounded logarithm, so cells are narrow at any scale."""
    return F.when(x == 0, 0.0).otherwise(F.signum(x) * (F.rint(F.ln(F.abs(x)) * PER_FACTOR) + (1 << 20)))


def _narrowed(counts: DataFrame, by: Sequence[str], found: DataFrame | None, cell: Callable[[Column, Column], Column]) -> DataFrame:
    """A row a group: its moments, and in ``_t`` the cells that hold a quartile's ranks, with the rows before each.

    ``found`` is the same of the round before, whose cells are cut further; ``cell`` gives a value's cell in one of
    them. Every round reads the exchange of ``counts`` again, so nothing may be filtered here below its aggregate.
    """
    x, c = F.col("x"), F.col("_c")
    if found is None:
        rows = counts.withColumns({"_in": F.struct(F.lit(0).cast("long").alias("before"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi")), "_ss": F.lit(0.0)})
        moments = {"_n": F.sum("_s0"), "_mean": F.when(F.sum("_s0") > 0, F.sum("_s1") / F.sum("_s0")), "_min": F.min("lo"), "_max": F.max("hi")}
        carried = []
    else:
        named = found.select(*[F.col(k).alias(f"_by_{k}") for k in by], "_n", "_mean", "_min", "_max", "_t")
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_by_{k}")) for k in by])
        inside = F.get(F.filter("_t", lambda t: F.coalesce((x >= t["lo"]) & (x <= t["hi"]), F.lit(False))), F.lit(0))
        rows = counts.join(F.broadcast(named), same).withColumns({"_in": inside, "_ss": c * (x - F.col("_mean")) * (x - F.col("_mean"))})
        carried = ["_n", "_mean", "_min", "_max"]
        moments = {k: F.max(k) for k in carried}
    rows = rows.select(*by, *carried, "x", "_c", "_ss", F.col("_in.before").alias("_base"), F.col("_in.lo").alias("_within"), cell(x, F.col("_in")).alias("_cell"))
    cells = rows.groupBy(*by, "_within", "_base", "_cell").agg(F.sum("_c").alias("_s0"), F.sum(c * x).alias("_s1"), F.sum("_ss").alias("_ss"), F.min("x").alias("lo"), F.max("x").alias("hi"), *[F.max(k).alias(k) for k in carried])
    earlier = F.sum("_s0").over(W.partitionBy(*by, "_within").orderBy("lo").rowsBetween(W.unboundedPreceding, -1))
    n = F.sum("_s0").over(W.partitionBy(*by)) if found is None else F.col("_n")
    cells = cells.withColumns({"_before": F.col("_base") + F.coalesce(earlier, F.lit(0)), "_of": n})
    holds = lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_s0"))
    hit = reduce(lambda a, b: a | b, [holds(r) for _, below, above in _ranks(F.col("_of")) for r in (below, above)])
    kept = F.collect_list(F.when(hit, F.struct(F.col("_before").alias("before"), "lo", "hi", F.col("_s0").alias("c"))))
    return cells.groupBy(*by).agg(*[v.alias(k) for k, v in moments.items()], F.sum("_ss").alias("_ss"), kept.alias("_t"))


def _exactly(counts: DataFrame, by: Sequence[str], eps: float, single: str) -> DataFrame:
    """The measures of groups from ``by, x, _c``, a count for each of their values (0 for nulls)."""
    found = _narrowed(counts, by, None, lambda x, at: _magnitude(x))
    share = lambda x, at: (x - at["lo"]) / (at["hi"] - at["lo"])
    found = _narrowed(counts, by, found, lambda x, at: F.when(at["hi"] > at["lo"], F.floor(share(x, at) * PER_CELL)).otherwise(0))
    found = _narrowed(counts, by, found, lambda x, at: F.when(at["lo"].isNotNull(), x))
    at = lambda r: F.get(F.filter("_t", lambda t: (t["before"] <= r) & (r < t["before"] + t["c"])), F.lit(0))["lo"]
    n = F.col("_n")
    quartiles = [F.when((below == above) | (at(below) == at(above)), at(below)).otherwise((above - where) * at(below) + (where - below) * at(above)) for where, below, above in _ranks(n)]
    std = F.when(n > 1, F.sqrt(F.col("_ss") / (n - 1)))
    return found.select(*by, n.alias("n"), F.col("_mean").alias("mean"), _deviation(std, n, eps, single).alias("std"), F.col("_min").alias("min"), F.col("_max").alias("max"), F.array(*quartiles).alias("_q"))


def _measured(rows: DataFrame, by: Sequence[str], eps: float, single: str, accuracy: int | None, union: bool = False) -> DataFrame:
    """Measures of ``rows`` by ``by``; with ``union`` also by all but its first column, which is null there."""
    if accuracy:
        groups = rows.groupingSets([[F.col(k) for k in by[1:]], [F.col(k) for k in by]], *by) if union else rows.groupBy(*by)
        quartile = F.percentile_approx("x", list(QUARTILES), accuracy)
        found = groups.agg(F.count("x").alias("n"), F.avg("x").alias("mean"), _deviation(F.stddev_samp("x"), F.count("x"), eps, single).alias("std"), F.min("x").alias("min"), F.max("x").alias("max"), quartile.alias("_q"))
    else:
        counts = rows.groupBy(*by, "x").agg(F.count("x").alias("_c"))
        if union:
            counts = counts.select(F.explode(F.array(F.col(by[0]), F.lit(None))).alias(by[0]), *by[1:], "x", "_c")
        found = _exactly(counts, by, eps, single)
    return found.withColumns({"median": F.get("_q", F.lit(1)), "iqr": F.greatest(F.get("_q", F.lit(2)) - F.get("_q", F.lit(0)), F.lit(eps))}).drop("_q")


def full_stats(df: DataFrame, schema: UnifiedSchema, keys: Sequence[str] | None = None, eps: float = 1e-6, single: str = "nan", accuracy: int | None = None) -> DataFrame:
    """``key, channel, n, mean, std, min, max, median, iqr``; the deviation is the sample's."""
    rows = valid_values(df, schema, resolve_keys(schema, keys))
    return _measured(rows, ["key", "channel"], eps, single, accuracy)


def dataset_stats(df: DataFrame, schema: UnifiedSchema, keys: Sequence[str] | None = None, eps: float = 1e-6, single: str = "nan", accuracy: int | None = None, union: bool = False) -> DataFrame:
    """The same by ``dataset``; with ``union`` also over all datasets (a null dataset), in one pass."""
    rows = valid_values(df, schema, resolve_keys(schema, keys)).withColumn("dataset", F.coalesce("dataset", F.raise_error(F.lit("a row has no dataset name"))))
    return _measured(rows, ["dataset", "key", "channel"], eps, single, accuracy, union)


def collect_stats(stats: DataFrame, keys: Sequence[str] | None = None) -> dict:
    """``{key: {field: [by channel]}}``, below the dataset's name if there is one. One row per key and channel."""
    out: dict = {}
    names = [f for f in FIELDS if f in stats.columns]
    for r in stats.orderBy(*[c for c in ("dataset", "key", "channel") if c in stats.columns]).collect():
        at = out.setdefault(r.dataset, {}) if "dataset" in stats.columns else out
        for f in names:
            at.setdefault(r.key, {n: [] for n in names})[f].append(float(r[f]))
    for k in keys or ():
        if not any(k in (v if "dataset" in stats.columns else out) for v in (out.values() if "dataset" in stats.columns else (out,))):
            raise ValueError(f"{k!r} has no valid position")
    return out


def save_stats(stats: dict, path: str) -> None:
    with open(path, "w") as f:
        json.dump(stats, f, indent=2)


def load_stats(path: str) -> dict:
    with open(path) as f:
        return json.load(f)
