"""Business days (Monday to Friday) and epochs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A Monday.
MONDAY = "1970-01-05"


def weekday(day: Column) -> Column:
    """0 for Monday to 6 for Sunday."""
    return F.pmod(F.datediff(day, F.lit(MONDAY).cast("date")), F.lit(7))


def roll(day: Column, forward: bool = False) -> Column:
    """The day itself if it is a business day, else the one before, or after."""
    over = weekday(day) - 4
    step = F.when(over > 0, 3 - over if forward else -over).otherwise(0)
    return F.date_add(day, step)


def add_business_days(day: Column, n: Column | int) -> Column:
    """n business days on from a day, which is first rolled back to one."""
    start = roll(day)
    total = weekday(start) + n
    return F.date_add(start, (F.floor(total / 5) * 7 + F.pmod(total, F.lit(5)) - weekday(start)).cast("int"))


def business_days(start: Column, end: Column) -> Column:
    """Business days from a day on and before another; where the other is earlier, those after it up to the first, negative."""
    before = lambda d: F.floor(F.datediff(d, F.lit(MONDAY).cast("date")) / 7) * 5 + F.least(weekday(d), F.lit(5))
    return F.when(end < start, before(F.date_add(end, 1)) - before(F.date_add(start, 1))).otherwise(before(end) - before(start))


def epoch_date(seconds: Column) -> Column:
    """The UTC day of an epoch in seconds; NULL for what isn't a finite number."""
    x = seconds.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < 1e12), F.date_add(F.lit("1970-01-01").cast("date"), F.floor(x / 86400).cast("int")))
