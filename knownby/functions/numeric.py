"""Null-safe numeric expressions.

Missing is always SQL null: NaN and infinities are turned into null where data
enters an operator, and no expression divides by an unchecked denominator.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# A dispersion below this share of the values' magnitude is rounding noise around a constant series.
NOISE = 1e-14


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def finite(value: Column | str) -> Column:
    """The value as a double, null when it is not a finite number."""
    number = col(value).try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < F.lit(float("inf"))), number)


def ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """Quotient, null for a zero denominator or an overflow."""
    return F.try_divide(col(numerator), col(denominator))


def growth(now: Column | str, before: Column | str) -> Column:
    return ratio(now, before) - F.lit(1.0)


def clip(value: Column, low: Column | float, high: Column | float) -> Column:
    """Clamp a value and keep null as null (greatest and least skip nulls)."""
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return F.when(value.isNotNull(), F.greatest(F.least(value, high), low))


def positive(value: Column) -> Column:
    return F.when(value > 0, value)


def dispersed(value: Column, around: Column | str | None = None) -> Column:
    """A standard deviation, null when it is zero; with ``around`` (their mean), zero up to rounding of the values."""
    noise = F.lit(0.0) if around is None else F.coalesce(F.abs(col(around)), F.lit(0.0)) * F.lit(NOISE)
    return F.when(value > noise, value)


def deviation(value: Column, ddof: int) -> Column:
    """Standard deviation with any ddof as an aggregate or window-free expression."""
    n = F.count(value)
    if ddof == 1:
        return F.when(n > 1, F.stddev_samp(value))
    if ddof == 0:
        return F.stddev_pop(value)
    return F.when(n > ddof, F.sqrt(F.var_pop(value) * ratio(n.cast("double"), n - F.lit(ddof))))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def _halves(value: Column) -> tuple[Column, Column]:
    """A double as the exact sum of two short-mantissa doubles."""
    wide = value * F.lit(134217729.0)
    high = wide - (wide - value)
    return high, value - high


def fixed_digits(value: Column, digits: int) -> Column:
    """Round the exact binary value to decimals, ties to even.

    Text formatting in the JVM rounds the shortest decimal form of a double up at
    a tie; this rounds the number itself, which decides ties by the exact
    remainder of value times the power of ten. Valid below 2^53 after scaling.
    """
    scale = float(10**digits)
    magnitude = F.abs(value.cast("double"))
    product = magnitude * F.lit(scale)
    (a, b), (c, d) = _halves(magnitude), _halves(F.lit(scale))
    remainder = ((a * c - product) + a * d + b * c) + b * d
    whole = F.floor(product).cast("double")
    tie = (product - whole) - F.lit(0.5)
    up = (tie > 0) | (
        (tie == 0) & ((remainder > 0) | ((remainder == 0) & (whole % F.lit(2.0) == 1.0)))
    )
    # A product rounded up to a whole number may stand just below it; that is still nearest.
    rounded = (whole + F.when(up, 1.0).otherwise(0.0)) / F.lit(scale)
    return F.when(value < 0, -rounded).otherwise(rounded)
