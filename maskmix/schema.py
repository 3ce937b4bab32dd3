"""Declared values, dataset schemas and their union.

All of this runs on the driver and is small; the specs become column expressions and field metadata.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from math import prod

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Element types by name. There is no half type: float16 is stored wider and named in the metadata.
DTYPES: dict[str, T.DataType] = {
    "float16": T.FloatType(),
    "float32": T.FloatType(),
    "float64": T.DoubleType(),
    "int32": T.IntegerType(),
    "int64": T.LongType(),
    "bool": T.BooleanType(),
}


def resolve_dtype(dtype: str | T.DataType) -> T.DataType:
    """The Spark type of a dtype name; types pass through."""
    if isinstance(dtype, T.DataType):
        return dtype
    if dtype not in DTYPES:
        raise ValueError(f"unknown dtype {dtype!r}; known: {', '.join(DTYPES)}")
    return DTYPES[dtype]


@dataclass(frozen=True)
class TensorSpec:
    """One value of a sample.

    ``time_dim`` makes it a sequence of that padded length; ``feature_dim`` a vector per step (or alone);
    ``shape`` a structured value, stored flat in row-major order.
    """

    name: str
    feature_dim: int | None = None
    shape: tuple[int, ...] | None = None
    time_dim: int | None = None
    dtype: str | T.DataType = "float32"
    placeholder: float = 0

    def __post_init__(self):
        if self.feature_dim is not None and self.shape is not None:
            raise ValueError(f"{self.name}: feature_dim and shape exclude each other")
        if self.shape is not None:
            object.__setattr__(self, "shape", tuple(self.shape))
            if not self.shape:
                raise ValueError(f"{self.name}: shape is empty")
        for n in (self.feature_dim, self.time_dim, *(self.shape or ())):
            if n is not None and n <= 0:
                raise ValueError(f"{self.name}: dimensions must be positive")
        resolve_dtype(self.dtype)

    @property
    def is_sequence(self) -> bool:
        return self.time_dim is not None

    @property
    def is_structured(self) -> bool:
        return self.shape is not None

    @property
    def trailing_shape(self) -> tuple[int, ...]:
        return self.shape or (() if self.feature_dim is None else (self.feature_dim,))

    @property
    def value_shape(self) -> tuple[int, ...]:
        return ((self.time_dim,) if self.is_sequence else ()) + self.trailing_shape

    @property
    def mask_shape(self) -> tuple[int, ...]:
        return (self.time_dim,) if self.is_sequence else ()

    @property
    def width(self) -> int | None:
        """Values of a step (or of the vector), None for scalars."""
        return prod(self.trailing_shape) if self.trailing_shape else None

    @property
    def element_type(self) -> T.DataType:
        return resolve_dtype(self.dtype)

    @property
    def step_type(self) -> T.DataType:
        return T.ArrayType(self.element_type) if self.width else self.element_type

    @property
    def value_type(self) -> T.DataType:
        return T.ArrayType(self.step_type) if self.is_sequence else self.step_type

    @property
    def mask_type(self) -> T.DataType:
        return T.ArrayType(T.BooleanType()) if self.is_sequence else T.BooleanType()

    def step_placeholder(self) -> Column:
        one = F.lit(self.placeholder).cast(self.element_type)
        return F.array_repeat(one, self.width) if self.width else one

    def placeholder_value(self) -> Column:
        """A constant, folded by the optimizer."""
        step = self.step_placeholder()
        return F.array_repeat(step, self.time_dim) if self.is_sequence else step

    def placeholder_mask(self) -> Column:
        return F.array_repeat(F.lit(False), self.time_dim) if self.is_sequence else F.lit(False)

    def fields(self, role: str) -> list[T.StructField]:
        """Value and mask fields, with the spec as metadata."""
        about = {"role": role, "time_dim": self.time_dim or 0, "shape": list(self.trailing_shape), "placeholder": float(self.placeholder), "dtype": self.dtype if isinstance(self.dtype, str) else self.dtype.simpleString()}
        return [T.StructField(self.name, self.value_type, True, about), T.StructField(f"{self.name}_mask", self.mask_type, True)]


@dataclass(frozen=True)
class DatasetSchema:
    """What one dataset declares; the role of a spec is the list it is in."""

    features: Sequence[TensorSpec] = field(default_factory=tuple)
    targets: Sequence[TensorSpec] = field(default_factory=tuple)

    @property
    def specs(self) -> list[TensorSpec]:
        return [*self.features, *self.targets]

    @property
    def keys(self) -> list[str]:
        return [s.name for s in self.specs]


def merge_specs(specs: Iterable[TensorSpec], kind: str) -> dict[str, TensorSpec]:
    """Specs by name in order of appearance; the first declaration wins, shapes and types must agree."""
    found: dict[str, TensorSpec] = {}
    for spec in specs:
        first = found.setdefault(spec.name, spec)
        if first.value_shape != spec.value_shape or first.element_type != spec.element_type or (first.dtype != spec.dtype and "float16" in (first.dtype, spec.dtype)):
            raise ValueError(f"{kind} {spec.name!r} is declared as {first.value_shape} {first.dtype} and as {spec.value_shape} {spec.dtype}")
    return found


class UnifiedSchema:
    """The ordered union of dataset schemas."""

    def __init__(self, schemas: Sequence[DatasetSchema]):
        self.features = merge_specs((s for d in schemas for s in d.features), "feature")
        targets = merge_specs((s for d in schemas for s in d.targets), "target")
        # A name that is a feature elsewhere stays one.
        self.targets = {n: s for n, s in targets.items() if n not in self.features}
        self.clashes = [n for n in targets if n in self.features]
        self._specs = {**self.features, **self.targets}

    @property
    def specs(self) -> list[TensorSpec]:
        return list(self._specs.values())

    @property
    def feature_keys(self) -> list[str]:
        return list(self.features)

    @property
    def target_keys(self) -> list[str]:
        return list(self.targets)

    @property
    def keys(self) -> list[str]:
        return list(self._specs)

    def role(self, name: str) -> str:
        return "feature" if name in self.features else "target"

    def spec(self, name: str) -> TensorSpec:
        if name not in self._specs:
            raise KeyError(name)
        return self._specs[name]

    def __len__(self) -> int:
        return len(self._specs)

    def __contains__(self, name: str) -> bool:
        return name in self._specs
