"""Projecting raw rows to the union: cast, pad or crop, mask, fill with placeholders.

The whole step is one ``select`` per dataset; a missing column is a constant. Rows carry ``dataset_ix, dataset,
subset, key, local_ix, gix`` in front of the declared columns.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskmix.functions import arrays as A
from maskmix.operators.rank import rank_by_columns
from maskmix.schema import TensorSpec, UnifiedSchema

META = ("dataset_ix", "dataset", "subset", "key", "local_ix", "gix")


def resolve(spec: TensorSpec, columns: set[str], pad_features: bool = True, mask_names=lambda n: f"{n}_mask") -> tuple[Column, Column]:
    """Value and mask expressions of one spec over a raw row with these columns."""
    if spec.name not in columns:
        return spec.placeholder_value().cast(spec.value_type), spec.placeholder_mask()
    raw = F.col(spec.name).cast(spec.value_type)
    given = F.col(mask_names(spec.name)) if mask_names(spec.name) in columns else None
    if not spec.is_sequence:
        mask = raw.isNotNull() if given is None else raw.isNotNull() & F.coalesce(given.cast("boolean"), F.lit(True))
        return F.coalesce(raw, spec.placeholder_value().cast(spec.value_type)), mask
    if pad_features:
        value = A.pad_or_crop(raw, spec.time_dim, spec.step_placeholder())
        mask = F.when(raw.isNotNull(), A.length_mask(raw, spec.time_dim))
        if given is not None:
            mask = F.when(given.isNull(), mask).otherwise(A.both(mask, A.pad_or_crop(given.cast("array<boolean>"), spec.time_dim, F.lit(False))))
    else:
        value = raw
        mask = F.transform(raw, lambda _: F.lit(True))
        if given is not None:
            mask = F.coalesce(given.cast("array<boolean>"), mask)
    # A missing key has the full length, with or without padding.
    return F.coalesce(value, spec.placeholder_value().cast(spec.value_type)), F.coalesce(mask, spec.placeholder_mask())


def with_index(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """``local_ix`` by the order columns, which must be unique; data that has it already is left as it is.

    Large data is ranked by ranges of the order columns: one exchange, and no task for all rows.
    """
    return df if "local_ix" in df.columns else rank_by_columns(df, order, "local_ix")


def unify(df: DataFrame, schema: UnifiedSchema, pad_features: bool = True) -> DataFrame:
    """The union's columns and masks, with the metadata columns that are present; undeclared columns go."""
    columns = set(df.columns)
    out = [F.col(c) for c in META if c in columns]
    for spec in schema.specs:
        value, mask = resolve(spec, columns, pad_features)
        about = spec.fields(schema.role(spec.name))[0].metadata
        out += [value.alias(spec.name, metadata=about), mask.alias(f"{spec.name}_mask")]
    return df.select(*out)


def concatenate(datasets: Sequence[DataFrame], schema: UnifiedSchema, orders: Sequence[Sequence[str]], sizes: Sequence[int] | None = None, names: Sequence[str] | None = None, pad_features: bool = True, index: bool = True) -> DataFrame:
    """All datasets as one relation, in order, with global indices.

    Offsets need the sizes of all datasets but the last; they are counted if not given, one aggregate a dataset, of
    which only the count reaches the driver. Without ``index`` nothing is counted or ranked, and the rows have no
    ``local_ix`` or ``gix``.
    """
    if index and sizes is None:
        sizes = [d.count() for d in datasets[:-1]]
    parts, offset = [], 0
    for i, (df, order) in enumerate(zip(datasets, orders, strict=True)):
        name = names[i] if names else f"dataset_{i}"
        if index:
            df = with_index(df, order).withColumn("gix", F.col("local_ix") + F.lit(offset))
        else:
            df = df.drop("local_ix", "gix")
        df = df.withColumns({"dataset_ix": F.lit(i), "dataset": F.coalesce(F.col("dataset").cast("string"), F.lit(name)) if "dataset" in df.columns else F.lit(name)})
        for c in ("subset", "key"):
            df = df.withColumn(c, F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string"))
        parts.append(unify(df, schema, pad_features))
        if index and i + 1 < len(datasets):
            offset += sizes[i]
    return reduce(DataFrame.unionByName, parts)


def locate(gix: int, sizes: Sequence[int]) -> tuple[int, int]:
    """Dataset and local index of a global index; negative ones count from the end."""
    total = sum(sizes)
    at = gix + total if gix < 0 else gix
    if not 0 <= at < total:
        raise IndexError(gix)
    for i, n in enumerate(sizes):
        if at < n:
            return i, at
        at -= n
    raise IndexError(gix)


def fetch(plan: DataFrame, samples: DataFrame) -> DataFrame:
    """Samples in the plan's rows: an equi join on ``gix``; an index drawn twice is there twice."""
    drop = [c for c in ("dataset_ix",) if c in plan.columns and c in samples.columns]
    return plan.drop(*drop).join(samples, "gix")


def sequence_lengths(df: DataFrame, key: str, spec: TensorSpec | None = None) -> Column:
    """Raw length of each row's value: 0 if missing or a scalar, the width of a vector."""
    if key not in df.columns or (spec is not None and not spec.value_shape):
        return F.lit(0)
    return F.coalesce(F.size(F.col(key)), F.lit(0))
