"""Numbers where missing excludes: NULL is the only missing value, NaN and infinities count as missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def finite(x: Column | str) -> Column:
    """x as a double; NULL where it is NaN, infinite or not a number."""
    d = col(x).try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < F.lit(float("inf"))), d)


def ratio(num: Column | str, den: Column | str) -> Column:
    """num / den where den is positive, else NULL."""
    return F.when(col(den) > 0, col(num) / col(den))


def quotient(num: Column | str, den: Column | str) -> Column:
    """num / den as SQL has it for doubles: infinite where only den is zero, NaN where both are. Never raises."""
    n, zero = col(num), col(den) == 0
    sign = F.when(n > 0, F.lit(float("inf"))).when(n < 0, F.lit(float("-inf"))).when(n == 0, F.lit(float("nan")))
    return F.when(zero, F.when(F.isnan(n), n).otherwise(sign)).otherwise(n / F.when(~zero, col(den)))


def growth_pct(now: Column | str, before: Column | str) -> Column:
    """Growth in percent against a positive base."""
    return (ratio(now, before) - 1) * 100


def positive(x: Column | str) -> Column:
    return F.when(col(x) > 0, col(x))


def nonnegative(x: Column | str) -> Column:
    return F.when(col(x) >= 0, col(x))


def isclose(x: Column, y: Column) -> Column:
    """Equal within 1e-8 plus 1e-5 of the right side."""
    return F.abs(x - y) <= F.lit(1e-8) + F.lit(1e-5) * F.abs(y)


def label(x: Column | str) -> Column:
    """A category for comparison: trimmed, lower-cased, blank is missing."""
    return F.nullif(F.lower(F.trim(col(x).cast("string"))), F.lit(""))


def rounded(x: Column | str, digits: int = 6) -> Column:
    return F.round(col(x), digits)
