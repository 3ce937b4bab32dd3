"""Column expressions over sequences (arrays, or arrays of arrays) and their masks.

All stay inside the JVM. Arrays are bound to a lambda variable where they are used per element, so that they are
evaluated once a row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``."""
    return F.transform(F.array(value), lambda z: body(z)).getItem(0)


def indices(n: Column) -> Column:
    """0 .. n-1; empty for n = 0 (a plain sequence would run backwards)."""
    return F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array().cast("array<int>"))


def pad_or_crop(value: Column, target: int | Column, pad: Column) -> Column:
    """Cut after ``target`` steps, or append ``pad`` until there are so many."""
    target = F.lit(target) if isinstance(target, int) else target
    missing = F.greatest(target - F.size(value), F.lit(0))
    return F.slice(F.concat(value, F.array_repeat(pad, missing)), 1, target)


def length_mask(value: Column, target: int | Column) -> Column:
    """True for the steps that come from the value."""
    target = F.lit(target) if isinstance(target, int) else target
    return let(F.size(value), lambda n: F.transform(indices(target), lambda i: i < n))


def repeat_pad(value: Column, target: int) -> Column:
    """Append copies of the last step; never cuts; an empty value is an error where padding is needed."""
    missing = F.greatest(F.lit(target) - F.size(value), F.lit(0))
    last = F.when(F.size(value) == 0, F.raise_error(F.lit("cannot repeat the last step of an empty sequence"))).otherwise(F.get(value, F.size(value) - 1))
    return F.when(missing == 0, value).otherwise(F.concat(value, F.array_repeat(last, missing)))


def nonzero_steps(value: Column, width: int | None) -> Column:
    """Steps with any value other than zero."""
    return F.transform(value, (lambda s: F.exists(s, lambda x: x != 0)) if width else (lambda x: x != 0))


def fill_gaps(value: Column, valid: Column) -> Column:
    """Carry the last valid step forward, and the first one back over a leading gap.

    Each valid step is repeated up to the next one, which takes time in proportion to the length; without any valid
    step it is an error. An empty value stays as it is.
    """

    def fill(v: Column, m: Column) -> Column:
        def carried(at: Column) -> Column:
            until = lambda j: F.coalesce(F.get(at, j + 1), F.size(m))
            return F.flatten(F.transform(at, lambda i, j: F.array_repeat(F.get(v, i), until(j) - F.when(j == 0, F.lit(0)).otherwise(i))))

        at = F.filter(F.sequence(F.lit(0), F.size(m) - 1), lambda i: F.get(m, i))
        filled = let(at, lambda x: F.when(F.size(x) == 0, F.raise_error(F.lit("no valid step to fill from"))).otherwise(carried(x)))
        return F.when(F.size(v) == 0, v).otherwise(filled)

    return let(F.struct(value.alias("v"), valid.alias("m")), lambda z: fill(z["v"], z["m"]))


def both(a: Column, b: Column) -> Column:
    """AND of two masks of a length."""
    return F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(False)) & F.coalesce(y, F.lit(False)))


def map_valid(value: Column, mask: Column, width: int | None, sequence: bool, f: Callable[[Column, Column], Column], kind: str) -> Column:
    """``f(element, channel)`` where the mask holds, the element itself elsewhere; cast to ``kind``."""

    def step(s: Column, m: Column) -> Column:
        if width:
            return F.transform(s, lambda x, j: F.when(m, f(x.cast("double"), j)).otherwise(x.cast("double")).cast(kind))
        return F.when(m, f(s.cast("double"), F.lit(0))).otherwise(s.cast("double")).cast(kind)

    if not sequence:
        return step(value, mask)
    return F.zip_with(value, mask, step)


def valid_length(masks: list[Column]) -> Column:
    """The largest number of valid steps among sequence masks."""
    counts = [F.size(F.filter(m, lambda x: x)) for m in masks]
    return F.greatest(*counts) if len(counts) > 1 else counts[0]


def digest(*parts) -> Column:
    """The ordering key of seeded draws: an md5 of the parts, the same in any engine and any partitioning."""
    return F.md5(F.concat_ws(":", *[F.lit(p).cast("string") if not isinstance(p, Column) else p.cast("string") for p in parts]))


def uniform(*parts) -> Column:
    """A number in [0, 1) that depends on the parts only."""
    return F.conv(F.substring(digest(*parts), 1, 13), 16, 10).cast("bigint") / F.lit(4503599627370496.0)


def normal(*parts) -> Column:
    """A standard normal number (Box-Muller) that depends on the parts only."""
    return F.sqrt(F.lit(-2.0) * F.ln(F.lit(1.0) - uniform(*parts, "u1"))) * F.cos(F.lit(2.0) * F.pi() * uniform(*parts, "u2"))
