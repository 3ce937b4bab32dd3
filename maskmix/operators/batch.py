"""Batches: fixed or bucketed, collated with fixed or dynamic padding, and mixed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from maskmix.functions import arrays as A
from maskmix.schema import TensorSpec, UnifiedSchema


def fixed_batches(df: DataFrame, batch_size: int, length: int | None = None, drop_last: bool = False) -> DataFrame:
    """``batch_id`` and ``slot`` from consecutive positions; no shuffle."""
    out = df.withColumns({"batch_id": F.floor(F.col("pos") / batch_size).cast("long"), "slot": F.pmod("pos", F.lit(batch_size)).cast("int")})
    return out.where(F.col("batch_id") < length // batch_size) if drop_last and length is not None else out


def evaluation_order(samples: DataFrame) -> DataFrame:
    """Every sample once, in order."""
    return samples.withColumn("pos", F.col("gix"))


def collate(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row a batch, each column as the array of its samples' values in slot order. Batches are small."""
    rows = df.groupBy("batch_id").agg(F.sort_array(F.collect_list(F.struct("slot", *columns))).alias("_rows"))
    return rows.select("batch_id", F.size("_rows").alias("batch_size"), *[F.col(f"_rows.{c}").alias(c) for c in columns])


def dynamic_padding(df: DataFrame, schema: UnifiedSchema, keys: Sequence[str] | None = None) -> DataFrame:
    """Pad the sequence keys to their batch's longest, values with the placeholder, masks with false."""
    names = keys if keys is not None else schema.keys
    specs = [s for s in map(schema.spec, names) if s.is_sequence]
    batch = W.partitionBy("batch_id")
    df = df.withColumns({f"_n_{s.name}": F.max(F.size(s.name)).over(batch) for s in specs})
    out = {}
    for s in specs:
        n = F.col(f"_n_{s.name}")
        out[s.name] = A.pad_or_crop(F.col(s.name), n, s.step_placeholder())
        out[f"{s.name}_mask"] = A.pad_or_crop(F.col(f"{s.name}_mask"), n, F.lit(False))
    return df.withColumns(out).drop(*[f"_n_{s.name}" for s in specs])


def mix_parameters(batches: DataFrame, alpha: float = 0.2, p: float = 1.0, seed: int = 0, epoch: int = 0) -> DataFrame:
    """``batch_id, size, lam, rel, drawn``: the blend of each batch, keyed by (seed, epoch, batch); 1 without a draw.

    A draw may round to 1 as well, so ``drawn`` tells the two apart.

    Beta(alpha, alpha) by Johnk's method on keyed uniforms, the first of 64 pairs that is accepted.
    """
    u = lambda *k: A.uniform(seed, epoch, "mix", F.col("batch_id"), *k)

    def pair(i):
        # In logarithms, as powers of 1/alpha underflow.
        x, y = F.ln(u("x", i) + 1e-300) / alpha, F.ln(u("y", i) + 1e-300) / alpha
        top = F.greatest(x, y)
        total = top + F.ln(F.exp(x - top) + F.exp(y - top))
        return F.struct((total <= 0).alias("ok"), F.exp(x - total).alias("lam"))

    draws = F.transform(F.sequence(F.lit(0), F.lit(63)), pair)
    first = F.get(F.filter(draws, lambda d: d["ok"]), F.lit(0))["lam"]
    drawn = (F.col("size") >= 2) & (u("gate") < p)
    lam = F.when(drawn, F.coalesce(first, F.lit(1.0))).otherwise(F.lit(1.0))
    return batches.select("batch_id", "size", lam.alias("lam"), u("rel").alias("rel"), drawn.alias("drawn"))


def partners(df: DataFrame, seed: int = 0, epoch: int = 0) -> DataFrame:
    """``batch_id, slot, mixup_index``: a seeded permutation of the slots of each batch."""
    order = W.partitionBy("batch_id").orderBy(A.digest(seed, epoch, "perm", F.col("batch_id"), F.col("slot")), "slot")
    return df.select("batch_id", "slot").withColumn("mixup_index", (F.row_number().over(order) - 1).cast("int"))


def _blend(a, b, lam, depth: int):
    if depth == 0:
        return lam * a.cast("double") + (1 - lam) * b.cast("double")
    return F.zip_with(a, b, lambda x, y: _blend(x, y, lam, depth - 1))


def _depth(spec: TensorSpec) -> int:
    return int(spec.is_sequence) + int(spec.width is not None)


def mix(df: DataFrame, schema: UnifiedSchema, alpha: float = 0.2, mode: str = "mixup", p: float = 1.0, seed: int = 0, epoch: int = 0) -> DataFrame:
    """Blend each sample's features with its partner's, and add ``<target>_b``, ``mixup_lambda``, ``mixup_index``.

    ``cutmix`` replaces a span of a sequence's steps instead. Masks stay the sample's own; the partner's are
    added for targets. The partner comes by an equi join on batch and slot.
    """
    if mode not in ("mixup", "cutmix"):
        raise ValueError(f"unknown mode {mode!r}")
    sizes = df.groupBy("batch_id").agg(F.count(F.lit(1)).alias("size"))
    parameters = mix_parameters(sizes, alpha, p, seed, epoch)
    rows = df.join(partners(df, seed, epoch), ["batch_id", "slot"]).join(parameters, "batch_id")
    # Without a draw the permutation is the identity.
    rows = rows.withColumn("mixup_index", F.when(F.col("drawn"), F.col("mixup_index")).otherwise(F.col("slot")))
    names = [*schema.feature_keys, *schema.target_keys, *[f"{t}_mask" for t in schema.target_keys]]
    other = df.select("batch_id", F.col("slot").alias("mixup_index"), *[F.col(n).alias(f"{n}__o") for n in names])
    rows = rows.join(other, ["batch_id", "mixup_index"])
    out = {}
    for k in schema.feature_keys:
        s, a, b = schema.spec(k), F.col(k), F.col(f"{k}__o")
        if mode == "cutmix" and s.is_sequence:
            n = F.size(a)
            cut = F.bround((1 - F.col("lam")) * n).cast("int")
            start = (F.col("rel") * (n - cut)).cast("int")
            out[k] = F.concat(F.slice(a, 1, start), F.slice(b, start + 1, cut), F.slice(a, start + cut + 1, n))
        else:
            out[k] = F.when(F.col("drawn"), _blend(a, b, F.col("lam"), _depth(s)).cast(s.value_type)).otherwise(a)
    for t in schema.target_keys:
        out[f"{t}_b"], out[f"{t}_mask_b"] = F.col(f"{t}__o"), F.col(f"{t}_mask__o")
    out["mixup_lambda"] = F.col("lam")
    return rows.withColumns(out).drop("lam", "rel", "size", "drawn", *[f"{n}__o" for n in names])
