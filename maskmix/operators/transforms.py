"""Mask-aware transforms: functions from DataFrame to DataFrame, used in list order after unify.

Each is a projection (per-dataset normalizing adds a broadcast join with the small statistics). Random ones draw
from a digest of (seed, epoch, gix, name), so a sample's draws do not depend on partitioning, and the same sample
drawn twice in an epoch gets the same ones.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskmix.functions import arrays as A
from maskmix.operators.stats import load_stats, resolve_keys
from maskmix.schema import TensorSpec, UnifiedSchema

Draw = Callable[..., Column]


class Transform:
    """Base: ``apply`` gives the new columns. ``train_only`` transforms are skipped in evaluation."""

    train_only = False

    def __init__(self, schema: UnifiedSchema, keys: Sequence[str] | None = None):
        self.schema, self.keys = schema, keys

    def apply(self, df: DataFrame, draw: Draw) -> DataFrame:
        raise NotImplementedError

    def __call__(self, df: DataFrame, training: bool = True, seed: int = 0, epoch: int = 0) -> DataFrame:
        if self.train_only and not training:
            return df
        return self.apply(df, lambda *parts: A.uniform(seed, epoch, F.col("gix"), type(self).__name__, *parts))

    def specs(self, sequences: bool = False) -> list[TensorSpec]:
        return [self.schema.spec(k) for k in resolve_keys(self.schema, self.keys, sequences) if not sequences or self.schema.spec(k).is_sequence]


class Compose(Transform):
    """Transforms in order; ``apply`` runs all of them, whatever their own gates."""

    def __init__(self, transforms: Sequence[Transform]):
        self.transforms = list(transforms)

    def apply(self, df, draw):
        for t in self.transforms:
            df = t.apply(df, draw)
        return df

    def __call__(self, df, training=True, seed=0, epoch=0):
        for t in self.transforms:
            df = t(df, training, seed, epoch)
        return df


def _masked(spec: TensorSpec, f: Callable[[Column, Column], Column], kind: str = "float") -> Column:
    return A.map_valid(F.col(spec.name), F.col(f"{spec.name}_mask"), spec.width, spec.is_sequence, f, kind)


class _Affine(Transform):
    """(x - a) / (b + eps) per channel, from collected statistics."""

    def __init__(self, stats: Mapping, schema: UnifiedSchema, eps: float = 1e-6, keys: Sequence[str] | None = None):
        super().__init__(schema, keys)
        self.eps = eps
        self.stats = {k: self.pair(v) for k, v in stats.items() if keys is None or k in keys}

    def pair(self, s) -> tuple[list[float], list[float]]:
        if isinstance(s, Mapping):
            a, b = self.scale({k: _listed(v) for k, v in s.items()})
        else:
            a, b = map(_listed, s)
        return a, b

    def scale(self, s: Mapping) -> tuple[list[float], list[float]]:
        return s["mean"], s["std"]

    def apply(self, df, draw):
        out = {}
        for k, (a, b) in self.stats.items():
            # A single pair holds for all channels.
            at = lambda xs, j: F.lit(xs[0]) if len(xs) == 1 else F.get(F.array(*map(F.lit, xs)), j)
            out[k] = _masked(self.schema.spec(k), lambda x, j, a=a, b=b, at=at: (x - at(a, j)) / (at(b, j) + self.eps))
        return df.withColumns(out)


def _listed(x) -> list[float]:
    return [float(v) for v in x] if isinstance(x, list | tuple) else [float(x)]


class Normalize(_Affine):
    pass


class MinMaxNormalize(_Affine):
    def scale(self, s):
        return s["min"], [b - a for a, b in zip(s["min"], s["max"], strict=True)]


class RobustNormalize(_Affine):
    def scale(self, s):
        return s["median"], s["iqr"]


def instance_expression(spec: TensorSpec, eps: float, single: str = "nan") -> Column:
    """The value scaled by its own valid positions: per channel over steps, or over a vector's elements.

    One position has no deviation: NaN, or ``eps`` with ``single="eps"``. The per-channel moments are bound
    once a row, with the deviation as it divides.
    """
    value, mask = F.col(spec.name), F.col(f"{spec.name}_mask")

    def moments(xs: Column) -> Column:
        def deviation(v: Column) -> Column:
            n = F.size(v)
            mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / n
            return A.let(mean, lambda m: F.struct(m.alias("m"), F.when(n > 1, F.greatest(F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)) / (n - 1)), F.lit(eps))).otherwise(F.lit(float("nan") if single == "nan" else eps)).alias("s")))

        return A.let(xs, deviation)

    scaled = lambda x, p: ((x - p["m"]) / p["s"]).cast("float")
    if not spec.is_sequence:
        if not spec.width:
            one = (value.cast("double") - value.cast("double")) / (F.lit(float("nan")) if single == "nan" else F.lit(eps))
            return F.when(mask, one.cast("float")).otherwise(value.cast("float"))
        return F.when(mask, A.let(moments(F.transform(value, lambda x: x.cast("double"))), lambda p: F.transform(value, lambda x: scaled(x.cast("double"), p)))).otherwise(value.cast("array<float>"))
    steps = F.transform(F.filter(F.arrays_zip(value.alias("v"), mask.alias("m")), lambda z: z["m"]), lambda z: z["v"])
    kind = "array<array<float>>" if spec.width else "array<float>"
    if spec.width:
        channels = A.let(steps, lambda s: F.transform(F.sequence(F.lit(0), F.lit(spec.width - 1)), lambda j: moments(F.transform(s, lambda x: F.get(x, j).cast("double")))))
        out = A.let(channels, lambda c: F.zip_with(value, mask, lambda s, m: F.when(m, F.zip_with(s, c, lambda x, p: scaled(x.cast("double"), p))).otherwise(s.cast("array<float>"))))
    else:
        out = A.let(moments(F.transform(steps, lambda x: x.cast("double"))), lambda p: F.zip_with(value, mask, lambda x, m: F.when(m, scaled(x.cast("double"), p)).otherwise(x.cast("float"))))
    return F.when(F.exists(mask, lambda m: m), out).otherwise(value.cast(kind))


class InstanceNormalize(Transform):
    def __init__(self, keys=None, eps: float = 1e-6, schema: UnifiedSchema | None = None, single: str = "nan"):
        super().__init__(schema, keys)
        self.eps, self.single = eps, single

    def apply(self, df, draw):
        return df.withColumns({s.name: instance_expression(s, self.eps, self.single) for s in self.specs()})


class PerDatasetNormalize(Transform):
    """Each row by its dataset's statistics; others by ``fallback``: instance, union or identity.

    The statistics are one row a dataset, held on the driver already, and joined by broadcast.
    """

    def __init__(self, stats: Mapping, schema: UnifiedSchema, fallback: str = "instance", union_stats: Mapping | None = None, dataset_key: str = "dataset", eps: float = 1e-6):
        if fallback not in ("instance", "union", "identity"):
            raise ValueError(f"unknown fallback {fallback!r}")
        if fallback == "union" and union_stats is None:
            raise ValueError("fallback 'union' needs union_stats")
        keys = list(dict.fromkeys(k for d in stats.values() for k in d))
        super().__init__(schema, keys)
        self.stats, self.fallback, self.union_stats, self.dataset_key, self.eps = stats, fallback, union_stats, dataset_key, eps

    def apply(self, df, draw):
        pair = Normalize({}, self.schema).pair
        fields = [f"`{k}` struct<a:array<double>,b:array<double>>" for k in self.keys]
        rows = [(name, *[pair(d[k]) if k in d else None for k in self.keys]) for name, d in self.stats.items()]
        table = df.sparkSession.createDataFrame([(r[0], tuple(r[1:])) for r in rows], f"_name string, _stats struct<{','.join(f.replace(' struct', ':struct', 1) for f in fields)}>")
        out = df.join(F.broadcast(table), F.col(self.dataset_key) == F.col("_name"), "left")
        made = {}
        for k in self.keys:
            spec, p = self.schema.spec(k), F.col("_stats")[k]
            kind = "float" if not spec.value_shape else "array<float>" if len(spec.value_type.simpleString().split("array")) == 2 else "array<array<float>>"
            at = lambda xs, j: F.when(F.size(xs) == 1, F.get(xs, F.lit(0))).otherwise(F.get(xs, j))
            own = _masked(spec, lambda x, j, p=p, at=at: (x - at(p["a"], j)) / (at(p["b"], j) + self.eps))
            if self.fallback == "instance":
                other = instance_expression(spec, self.eps)
            elif self.fallback == "union" and k in self.union_stats:
                a, b = pair(self.union_stats[k])
                lit = lambda xs, j: F.lit(xs[0]) if len(xs) == 1 else F.get(F.array(*map(F.lit, xs)), j)
                other = _masked(spec, lambda x, j, a=a, b=b, lit=lit: (x - lit(a, j)) / (lit(b, j) + self.eps))
            else:
                other = F.col(k).cast(kind)
            made[k] = F.when(p.isNotNull(), own).otherwise(other)
        return out.withColumns(made).drop("_name", "_stats")


class GaussianNoise(Transform):
    """Per key with probability ``p``: add noise of ``std`` where the mask holds."""

    train_only = True

    def __init__(self, keys=None, std: float = 0.1, p: float = 0.5, schema: UnifiedSchema | None = None):
        super().__init__(schema, keys)
        self.std, self.p = std, p

    def apply(self, df, draw):
        out = {}
        for s in self.specs():
            noise = lambda *at, s=s: F.sqrt(F.lit(-2.0) * F.ln(F.lit(1.0) - draw(s.name, "u1", *at))) * F.cos(F.lit(2.0) * F.pi() * draw(s.name, "u2", *at))
            if s.is_sequence:
                def step(x, i, noise=noise, s=s):
                    m = F.get(F.col(f"{s.name}_mask"), i)
                    one = lambda v, *at: F.when(m, v.cast("double") + self.std * noise(*at)).otherwise(v.cast("double")).cast(s.element_type)
                    return F.transform(x, lambda v, j: one(v, i, j)) if s.width else one(x, i)

                made = F.transform(F.col(s.name), lambda x, i: step(x, i))
            else:
                made = A.map_valid(F.col(s.name), F.col(f"{s.name}_mask"), s.width, False, lambda x, j, noise=noise: x + self.std * noise(j), s.element_type.simpleString())
            out[s.name] = F.when(draw(s.name, "gate") < self.p, made).otherwise(F.col(s.name))
        return df.withColumns(out)


class FeatureDropout(Transform):
    """Keys with any valid flag are dropped with probability ``p``: zeros and a false mask."""

    train_only = True

    def __init__(self, keys=None, p: float = 0.2, keep_at_least_one: bool = True, schema: UnifiedSchema | None = None):
        super().__init__(schema, keys)
        self.p, self.keep = p, keep_at_least_one

    def apply(self, df, draw):
        specs = self.specs()
        present = [F.exists(F.col(f"{s.name}_mask"), lambda m: m) if s.is_sequence else F.col(f"{s.name}_mask") for s in specs]
        drops = [p & (draw(s.name) < self.p) for s, p in zip(specs, present, strict=True)]
        df = df.withColumn("_drop", F.array(*drops)).withColumn("_there", F.array(*present))
        alive = F.exists(F.zip_with("_there", "_drop", lambda a, b: a & ~b), lambda x: x)
        spared = F.when(alive | F.lit(not self.keep), F.lit(-1)).otherwise(F.array_position("_there", F.lit(True)).cast("int") - 1)
        df = df.withColumn("_spared", spared)
        out = {}
        for i, s in enumerate(specs):
            gone = F.get("_drop", F.lit(i)) & (F.col("_spared") != i)
            zero = F.lit(0).cast(s.element_type)
            step = (lambda x, zero=zero: F.transform(x, lambda _: zero)) if s.width else (lambda x, zero=zero: zero)
            value = F.transform(F.col(s.name), lambda x: step(x)) if s.is_sequence else step(F.col(s.name))
            mask = F.transform(F.col(f"{s.name}_mask"), lambda _: F.lit(False)) if s.is_sequence else F.lit(False)
            out[s.name] = F.when(gone, value).otherwise(F.col(s.name))
            out[f"{s.name}_mask"] = F.when(gone, mask).otherwise(F.col(f"{s.name}_mask"))
        return df.withColumns(out).drop("_drop", "_there", "_spared")


class SpanMasking(Transform):
    """Zero ``num_spans`` spans of steps between the first and the last valid step; the mask stays."""

    train_only = True

    def __init__(self, keys=None, num_spans: int = 1, span_len: int = 5, p: float = 0.5, schema: UnifiedSchema | None = None):
        super().__init__(schema, keys)
        self.num_spans, self.span_len, self.p = num_spans, span_len, p

    def apply(self, df, draw):
        out = {}
        for s in self.specs(sequences=True):
            mask = F.col(f"{s.name}_mask")
            first = F.array_position(mask, F.lit(True)).cast("int") - 1
            last = F.size(mask) - F.array_position(F.reverse(mask), F.lit(True)).cast("int")
            starts = F.array(*[first + F.floor(draw(s.name, "start", k) * (last - first + 1)).cast("int") for k in range(self.num_spans)])
            zero = F.lit(0).cast(s.element_type)
            blank = (lambda x, zero=zero: F.transform(x, lambda _: zero)) if s.width else (lambda x, zero=zero: zero)
            bound = F.struct(starts.alias("s"), last.alias("l"))
            cut = A.let(bound, lambda b, s=s, blank=blank: F.transform(F.col(s.name), lambda x, i: F.when((i <= b["l"]) & F.exists(b["s"], lambda a: (i >= a) & (i < a + self.span_len)), blank(x)).otherwise(x)))
            out[s.name] = F.when((first >= 0) & (draw(s.name, "gate") < self.p), cut).otherwise(F.col(s.name))
        return df.withColumns(out)


def _reject_structured(specs: Sequence[TensorSpec], name: str) -> None:
    for s in specs:
        if s.is_structured:
            raise ValueError(f"{name} does not take the structured key {s.name!r}")


def resample(steps: Column, n_in: Column, n_out: Column, width: int | None) -> Column:
    """Linear interpolation with half-pixel centres; ends are held."""

    def at(i: Column, v: Column, n: Column, m: Column) -> Column:
        src = F.greatest(F.lit(0.0), (i + 0.5) * n / m - 0.5)
        lo = F.least(F.floor(src).cast("int"), n - 1)
        return A.let(F.struct(F.get(v, lo).alias("a"), F.get(v, F.least(lo + 1, n - 1)).alias("b"), (src - lo).alias("w")), lambda z: blend(z["a"], z["b"], z["w"]))

    def blend(a: Column, b: Column, w: Column) -> Column:
        one = lambda x, y: x.cast("double") * (1 - w) + y.cast("double") * w
        return F.zip_with(a, b, one) if width else one(a, b)

    bound = F.struct(steps.alias("v"), n_in.cast("int").alias("n"), n_out.cast("int").alias("m"))
    return A.let(bound, lambda z: F.transform(A.indices(z["m"]), lambda i: at(i, z["v"], z["n"], z["m"])))


class TimeWarp(Transform):
    """Stretch or squeeze sequences by one rate a sample and back to their length; masks stay."""

    train_only = True

    def __init__(self, min_rate: float = 0.8, max_rate: float = 1.25, keys=None, p: float = 0.5, schema: UnifiedSchema | None = None):
        super().__init__(schema, keys)
        if not 0 < min_rate <= max_rate:
            raise ValueError("rates must be positive and in order")
        _reject_structured(self.specs(sequences=True), "TimeWarp")
        self.min_rate, self.max_rate, self.p = min_rate, max_rate, p

    def apply(self, df, draw):
        rate = self.min_rate + draw("rate") * (self.max_rate - self.min_rate)
        out = {}
        for s in self.specs(sequences=True):
            n = F.size(F.col(s.name))
            m = F.greatest(F.lit(1), F.bround(n * rate).cast("int"))
            # The second pass reads its length from the bound first one.
            warped = A.let(resample(F.col(s.name), n, m, s.width), lambda v, n=n, s=s: resample(v, F.size(v), n, s.width))
            out[s.name] = F.when((draw("gate") < self.p) & (n > 0), warped.cast(s.value_type)).otherwise(F.col(s.name))
        return df.withColumns(out)


class FeatureMasking(Transform):
    """Zero bands of the last axis on all steps. On a sequence of scalars the last axis is time."""

    train_only = True

    def __init__(self, num_masks: int = 1, max_width: int = 4, keys=None, p: float = 0.5, schema: UnifiedSchema | None = None):
        super().__init__(schema, keys)
        _reject_structured(self.specs(), "FeatureMasking")
        self.num_masks, self.max_width, self.p = num_masks, max_width, p

    def apply(self, df, draw):
        out = {}
        for s in self.specs():
            if not s.value_shape:
                continue
            size = F.lit(s.width) if s.width else F.size(F.col(s.name))
            bands = []
            for k in range(self.num_masks):
                width = F.floor(draw(s.name, "width", k) * (self.max_width + 1)).cast("int")
                start = F.floor(draw(s.name, "start", k) * (size - width + 1)).cast("int")
                bands.append(F.struct(F.when((width == 0) | (width >= size), F.lit(0)).otherwise(width).alias("w"), start.alias("s")))
            zero = F.lit(0).cast(s.element_type)

            def band(x, b, zero=zero):
                return F.transform(x, lambda v, j: F.when(F.exists(b, lambda z: (j >= z["s"]) & (j < z["s"] + z["w"])), zero).otherwise(v))

            made = A.let(F.array(*bands), lambda b, s=s, band=band: F.transform(F.col(s.name), lambda x: band(x, b)) if s.is_sequence and s.width else band(F.col(s.name), b))
            out[s.name] = F.when(draw(s.name, "gate") < self.p, made).otherwise(F.col(s.name))
        return df.withColumns(out)


class _Crop(Transform):
    """A window of ``length`` steps at one offset for all sequence keys, padded back with 0 and a false mask."""

    def __init__(self, length: int, keys=None, schema: UnifiedSchema | None = None):
        super().__init__(schema, keys)
        if length <= 0:
            raise ValueError("length must be positive")
        self.length = length

    def offset(self, valid: Column, draw: Draw) -> Column:
        raise NotImplementedError

    def apply(self, df, draw):
        names = self.keys if self.keys is not None else self.schema.keys
        specs = [s for s in map(self.schema.spec, names) if s.is_sequence]
        if not specs:
            return df
        valid = A.valid_length([F.col(f"{s.name}_mask") for s in specs])
        df = df.withColumn("_at", self.offset(valid, draw).cast("int"))
        out = {}
        for s in specs:
            zero = F.lit(0).cast(s.element_type)
            pad = F.array_repeat(zero, s.width) if s.width else zero
            out[s.name] = A.pad_or_crop(F.slice(F.col(s.name), F.col("_at") + 1, self.length), self.length, pad)
            out[f"{s.name}_mask"] = A.pad_or_crop(F.slice(F.col(f"{s.name}_mask"), F.col("_at") + 1, self.length), self.length, F.lit(False))
        return df.withColumns(out).drop("_at")


class RandomCrop(_Crop):
    train_only = True

    def offset(self, valid, draw):
        return F.floor(draw("offset") * (F.greatest(F.lit(0), valid - self.length) + 1))


class CenterCrop(_Crop):
    def offset(self, valid, draw):
        return F.greatest(F.lit(0), F.floor((valid - self.length) / 2).cast("int"))


TRANSFORMS: dict[str, type[Transform]] = {
    "normalize": Normalize,
    "min_max_normalize": MinMaxNormalize,
    "robust_normalize": RobustNormalize,
    "instance_normalize": InstanceNormalize,
    "per_dataset_normalize": PerDatasetNormalize,
    "gaussian_noise": GaussianNoise,
    "feature_dropout": FeatureDropout,
    "span_masking": SpanMasking,
    "time_warp": TimeWarp,
    "feature_masking": FeatureMasking,
    "random_crop": RandomCrop,
    "center_crop": CenterCrop,
}


def build_transform(configs: Sequence[Mapping] | None, schema: UnifiedSchema) -> Compose | None:
    """Transforms of a list of ``{name, ...arguments}``; ``stats_path`` and ``union_stats_path`` are loaded."""
    made = []
    for config in configs or ():
        args = dict(config)
        name = args.pop("name")
        if name not in TRANSFORMS:
            raise ValueError(f"unknown transform {name!r}; known: {', '.join(TRANSFORMS)}")
        for key in ("stats", "union_stats"):
            path = args.pop(f"{key}_path", None)
            if path is not None and key not in args:
                args[key] = load_stats(path)
        made.append(TRANSFORMS[name](schema=schema, **args))
    return Compose(made) if made else None
