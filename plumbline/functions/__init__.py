"""Column helpers shared by the operators; all stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a zone-less timestamp column."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {ts})")


def hours(ts: str) -> Column:
    return micros(ts) / F.lit(3.6e9)


def ratio(num: Column, den: Column) -> Column:
    """num / den as doubles; null where den is zero or null (ANSI mode would raise)."""
    den = den.cast("double")
    return F.when(den != 0.0, num.cast("double") / F.nullif(den, F.lit(0.0)))


def slope(y: Column, x: Column) -> Column:
    """Least-squares slope; null for a constant or single-point x."""
    return F.when(F.max(x) > F.min(x), F.regr_slope(y, x))
