"""Number coercion, rounding and physical bounds as Column builders."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, functions as F

# The most a nutrient can measure per 100 g, by normalised unit.
BOUNDS = {"g": 100.0, "kJ": 4000.0, "kcal": 960.0, "%": 100.0}
KJ_PER_KCAL = 4.184
# Fixed value: last accepted epoch second.
LAST_EPOCH = 4102444800


def finite(c: Column) -> Column:
    """A double, or NULL for NaN and the infinities (``try_cast`` lets both through)."""
    d = c.try_cast("double")
    return F.when((d > float("-inf")) & (d < float("inf")), d)


def num_signed(c: Column) -> Column:
    return finite(F.trim(c.cast("string")))


def num_nonneg(c: Column) -> Column:
    v = F.trim(c.cast("string")).try_cast("double")
    return F.when((v >= 0) & (v < float("inf")), v)


def num_tolerant(c: Column) -> Column:
    """Accepts a decimal comma; only the first comma is read as one."""
    return finite(F.regexp_replace(F.trim(c.cast("string")), r"^([^,]*),", "$1."))


def within_bound(v: Column, unit: str) -> Column:
    ok = v.isNotNull() & (v >= 0)
    return ok & (v <= BOUNDS[unit]) if unit in BOUNDS else ok


def bounded(v: Column, unit: str) -> Column:
    return F.when(within_bound(v, unit), v)


def half_up(v: Column, digits: int = 0) -> Column:
    """Round as floor(x + 0.5): halves go up, also below zero."""
    if digits == 0:
        return F.floor(v + 0.5).cast("double")
    scale = float(10**digits)
    return F.floor(v * scale + 0.5).cast("double") / scale


def clamp(v: Column, low: float, high: float) -> Column:
    """NULL stays NULL; ``least`` and ``greatest`` alone would skip it."""
    return F.when(v.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), v)))


def count_true(conditions: list[Column]) -> Column:
    """How many conditions hold; NULL counts as false. Plain additions, so codegen keeps it."""
    return reduce(add, [F.coalesce(c, F.lit(False)).cast("int") for c in conditions])


def truthy(c: Column) -> Column:
    """Three spellings of yes; NULL reads as no."""
    return F.coalesce(F.lower(c.cast("string")).isin("1", "true", "on"), F.lit(False))


def truthy_null(c: Column) -> Column:
    return F.when(c.isNotNull(), truthy(c))


def epoch_millis(c: Column) -> Column:
    s = num_signed(c)
    return F.when((s > 0) & (s <= LAST_EPOCH), (s * 1000).cast("long"))
