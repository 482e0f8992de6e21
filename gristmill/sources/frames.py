"""Vendors' tables in the engine's layout."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.functions.numbers import finite

BARS = "ticker string, date date, open double, high double, low double, close double, volume double, split_close double, split double"
#: What vendors call the columns of bars, letters only and in lower case.
CALLED = {"ticker": ("ticker", "symbol"), "date": ("date", "datetime", "timestamp"), "open": ("open",), "high": ("high",), "low": ("low",), "close": ("close",), "adjusted": ("adjclose", "adjustedclose"), "volume": ("volume",), "split": ("stocksplits", "splits", "split")}


def empty_bars(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], BARS)


def normalised_bars(rows: DataFrame, ticker: str | None = None, order: str | None = None) -> DataFrame:
    """Bars under the engine's names, one for each ticker and day (the last by ``order``), prices scaled by the ratio of adjusted close to close.

    A missing ratio is that of the next day that has one, else 1; without an adjusted close prices count as adjusted already.
    ``split_close`` is the close as given. ticker: the name of a table's only ticker, where it has no column for it.
    """
    plain = {"".join(x for x in c.lower() if x.isalpha()): c for c in rows.columns}
    found = {k: next((plain[n] for n in names if n in plain), None) for k, names in CALLED.items()}
    number = lambda k: finite(F.col(f"`{found[k]}`")) if found[k] else F.lit(None).cast("double")
    named = F.upper(F.trim(F.col(f"`{found['ticker']}`"))) if found["ticker"] else F.lit(ticker)
    out = rows.select(named.alias("ticker"), F.to_date(F.col(f"`{found['date']}`")).alias("date"), *(number(k).alias(k) for k in ("open", "high", "low", "close", "adjusted", "volume", "split")), (F.col(order) if order else F.lit(0)).alias("__o"))
    last = Window.partitionBy("ticker", "date").orderBy(F.col("__o").desc())
    out = out.withColumn("__k", F.row_number().over(last)).where("__k = 1 and date is not null and ticker is not null")
    ratio = F.when(F.col("close") != 0, F.col("adjusted") / F.col("close"))
    later = Window.partitionBy("ticker").orderBy("date").rowsBetween(0, Window.unboundedFollowing)
    factor = F.coalesce(F.first(ratio, True).over(later), F.lit(1.0))
    out = out.withColumn("__f", factor)
    return out.select("ticker", "date", *((F.col(c) * F.col("__f")).alias(c) for c in ("open", "high", "low", "close")), "volume", F.col("close").alias("split_close"), F.coalesce("split", F.lit(0.0)).alias("split"))


@dataclass(frozen=True)
class Unit:
    """How a vendor's field becomes an engine's: scaled, its sign turned, and NULL where it isn't plausible."""

    field: str
    scale: float = 1.0
    negate: bool = False
    low: float | None = None
    high: float | None = None

    def column(self) -> Column:
        x = finite(self.field) * (-self.scale if self.negate else self.scale)
        ok = (x >= self.low if self.low is not None else F.lit(True)) & (x <= self.high if self.high is not None else F.lit(True))
        return F.when(ok, x)

    def pushed(self, op: str, value: float) -> tuple[str, float]:
        """A bound on the engine's value as one on the vendor's; a negative scale turns it round."""
        turned = {">": "<", "<": ">", ">=": "<=", "<=": ">="}
        factor = -self.scale if self.negate else self.scale
        return (turned.get(op, op) if factor < 0 else op), value / factor


def converted(rows: DataFrame, keys: list[str], units: dict[str, Unit]) -> DataFrame:
    """Keys and the engine's fields from a vendor's; fields that the vendor lacks are NULL."""
    return rows.select(*keys, *((u.column() if u.field in rows.columns else F.lit(None).cast("double")).alias(name) for name, u in units.items()))


def reindexed(frame: DataFrame, keys: DataFrame, columns: list[str], key: str = "ticker") -> DataFrame:
    """A row for each key that is asked for, with the columns that are; what the frame lacks is NULL. Keys that it has twice give one row, the last by its columns."""
    have = [c for c in columns if c in frame.columns]
    one = frame.groupBy(key).agg(F.max(F.struct(*have)).alias("__x")) if have else frame.select(key, F.lit(None).alias("__x")).distinct()
    rows = keys.select(key).distinct().join(one, key, "left")
    return rows.select(key, *((F.col(f"__x.{c}") if c in have else F.lit(None).cast("double")).alias(c) for c in columns))


def as_known(panel: DataFrame, date: str, column: str = "date") -> DataFrame:
    """What a panel held at a date: nothing after it."""
    return panel.where(F.col(column) <= F.lit(date).cast("date"))


def appended(panel: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """A panel with the columns of another that it lacks, rows of both; where both have a column the panel's stay."""
    new = [c for c in more.columns if c not in panel.columns]
    return panel.join(more.select(*keys, *new), keys, "full")
