"""Coverage reports and validation of declared schemas against raw data."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskmix.operators.balance import valid_classes
from maskmix.operators.unify import concatenate
from maskmix.schema import DatasetSchema, UnifiedSchema


def valid_fractions(unified: DataFrame, schema: UnifiedSchema) -> DataFrame:
    """``dataset_ix, dataset, key, n_valid, n_total, fraction`` for every dataset and key, in one aggregate.

    Placeholders and padding count in the total.
    """
    sums = []
    for s in schema.specs:
        m = F.col(f"{s.name}_mask")
        valid = F.size(F.filter(m, lambda x: x)) if s.is_sequence else m.cast("int")
        total = F.size(m) if s.is_sequence else F.lit(1)
        sums.append(F.struct(F.lit(s.name).alias("key"), F.sum(valid.cast("long")).alias("n_valid"), F.sum(total.cast("long")).alias("n_total")))
    rows = unified.groupBy("dataset_ix").agg(F.min("dataset").alias("dataset"), F.array(*sums).alias("s"))
    rows = rows.select("dataset_ix", "dataset", F.explode("s").alias("s")).select("dataset_ix", "dataset", "s.*")
    return rows.withColumn("fraction", F.when(F.col("n_total") > 0, F.col("n_valid") / F.col("n_total")).otherwise(F.lit(0.0)))


def class_distribution(unified: DataFrame, schema: UnifiedSchema) -> DataFrame:
    """``dataset_ix, key, cls, n`` of the targets that are not floating-point."""
    parts = []
    for k in schema.target_keys:
        spec = schema.spec(k)
        if spec.element_type.typeName() in ("float", "double") or spec.width:
            continue
        parts.append(valid_classes(unified, spec, "dataset_ix").select("dataset_ix", F.lit(k).alias("key"), "cls"))
    if not parts:
        return unified.sparkSession.createDataFrame([], "dataset_ix int, key string, cls long, n long")
    return reduce(DataFrame.unionByName, parts).groupBy("dataset_ix", "key", "cls").agg(F.count(F.lit(1)).alias("n"))


@dataclass
class Report:
    """What a set of datasets covers."""

    names: list[str]
    sizes: list[int]
    keys: list[str]
    roles: dict[str, str]
    coverage: dict[int, set[str]]
    valid: dict[tuple[int, str], float] = field(default_factory=dict)
    classes: dict[tuple[int, str], dict[int, int]] = field(default_factory=dict)

    def __str__(self) -> str:
        width = max([len(k) for k in self.keys] + [3])
        lines = [f"{len(self.names)} datasets, {sum(self.sizes)} samples, {len(self.keys)} keys", " " * width + " role     " + " ".join(f"{n[:14]:>14}" for n in self.names)]
        for k in self.keys:
            cells = [f"{'✓' if k in self.coverage[i] else '·'} {100 * self.valid.get((i, k), 0.0):6.1f} %" for i in range(len(self.names))]
            lines.append(f"{k:<{width}} {self.roles[k]:<8} " + " ".join(f"{c:>14}" for c in cells))
        lines.append(" " * width + " size     " + " ".join(f"{n:>14}" for n in self.sizes))
        for (i, k), found in sorted(self.classes.items()):
            lines.append(f"{k} in {self.names[i]}: " + ", ".join(f"{c}: {n}" for c, n in sorted(found.items())))
        return "\n".join(lines)


def describe(datasets: Sequence[DataFrame], schemas: Sequence[DatasetSchema], orders: Sequence[Sequence[str]], names: Sequence[str] | None = None, max_samples: int | None = 64) -> Report:
    """Names, sizes, declared coverage, and over the first ``max_samples`` of each dataset what is valid."""
    schema = UnifiedSchema(schemas)
    sizes = [d.count() for d in datasets]
    unified = concatenate(datasets, schema, orders, sizes, names)
    if max_samples is not None:
        unified = unified.where(F.col("local_ix") < max_samples)
    found = valid_fractions(unified, schema).collect()
    named = {r.dataset_ix: r.dataset for r in found}
    report = Report([named.get(i, f"dataset_{i}") for i in range(len(datasets))], sizes, schema.keys, {k: schema.role(k) for k in schema.keys}, {i: set(s.keys) for i, s in enumerate(schemas)})
    report.valid = {(r.dataset_ix, r.key): r.fraction for r in found}
    for r in class_distribution(unified, schema).collect():
        report.classes.setdefault((r.dataset_ix, r.key), {})[r.cls] = r.n
    return report


def issues(df: DataFrame, schema: DatasetSchema, dataset_ix: int = 0, num_samples: int | None = 4) -> DataFrame:
    """``dataset_ix, local_ix, key, issue`` of rows (with ``local_ix``) that do not fit what is declared.

    Missing keys, wrong ranks and wrong trailing shapes; the length of a sequence and the element type are free.
    """
    rows = df.where(F.col("local_ix") < num_samples) if num_samples is not None else df
    checks = []
    for s in schema.specs:
        if s.name not in df.columns:
            checks.append(F.struct(F.lit(s.name).alias("key"), F.lit("missing").alias("issue")))
            continue
        value, kind = F.col(s.name), df.schema[s.name].dataType.simpleString()
        declared = int(s.is_sequence) + int(s.width is not None)
        if kind.count("array<") != declared:
            what = F.lit(f"rank {kind.count('array<')}, declared {declared}")
            issue = F.when(value.isNull(), F.lit("missing")).otherwise(what)
        else:
            issue = F.when(value.isNull(), F.lit("missing"))
            if s.width:
                wrong = F.exists(value, lambda x: F.size(x) != s.width) if s.is_sequence else F.size(value) != s.width
                issue = issue.when(wrong, F.lit(f"width differs from the declared {s.width}"))
        checks.append(F.struct(F.lit(s.name).alias("key"), issue.alias("issue")))
    if not checks:
        return rows.select(F.lit(dataset_ix).alias("dataset_ix"), "local_ix", F.lit("").alias("key"), F.lit("").alias("issue")).limit(0)
    return rows.select(F.lit(dataset_ix).alias("dataset_ix"), "local_ix", F.explode(F.array(*checks)).alias("c")).select("dataset_ix", "local_ix", "c.*").where("issue is not null")


def validate(datasets: Sequence[DataFrame], schemas: Sequence[DatasetSchema], num_samples: int | None = 4, strict: bool = False) -> list[str]:
    """Issues as text; ``strict`` raises on any. Also warns where one name is a feature and a target."""
    rows = reduce(DataFrame.unionByName, [issues(d, s, i, num_samples) for i, (d, s) in enumerate(zip(datasets, schemas, strict=True))])
    found = [f"dataset {r.dataset_ix}, sample {r.local_ix}, {r.key}: {r.issue}" for r in rows.orderBy("dataset_ix", "local_ix", "key").collect()]
    found += [f"{n}: a feature in one dataset and a target in another" for n in UnifiedSchema(schemas).clashes]
    if strict and found:
        raise ValueError("\n".join(found))
    return found
