"""Point-in-time rows: estimates blended to the next twelve months, caps, expiries, waterfalls over company facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ntm_weight(as_of: Column, next_year_end: Column, last_year_end: Column) -> Column:
    """The share of the current fiscal year that is still ahead; a half where neither year end is known."""
    end = F.coalesce(next_year_end, F.date_add(last_year_end, 365))
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.datediff(end, as_of) / 365.25)), F.lit(0.5))


def ntm_blend(this_year: Column, next_year: Column, weight: Column) -> Column:
    """An estimate for the next twelve months from those of two fiscal years; one of them alone counts where it is the heavier."""
    both = weight * this_year + (1 - weight) * next_year
    return F.coalesce(both, F.when(weight >= 0.5, this_year), F.when(weight <= 0.5, next_year))


def expiry(chains: DataFrame, key: str, as_of: Column, date: str = "expiry") -> DataFrame:
    """``key, expiry`` of each option chain: nearest to 30 days among those 20 to 45 days out (the earlier of two as near), else the first that is 7 days out or more. One aggregation."""
    days = F.datediff(F.col(date), as_of)
    near = F.when(days.between(20, 45), F.struct(F.abs(days - 30).alias("d"), days.alias("n"), F.col(date).alias("e")))
    found = chains.groupBy(key).agg(F.min(near).alias("near"), F.min(F.when(days >= 7, F.col(date))).alias("later"))
    return found.select(key, F.coalesce("near.e", "later").alias(date))


def market_cap(prices: DataFrame, shares: DataFrame, as_of: str, stale_days: int = 10) -> DataFrame:
    """``ticker, cap``: the last close at or before a date, not older than ``stale_days``, times the shares of the latest filing known then."""
    day = F.lit(as_of).cast("date")
    close = prices.where((F.col("date") <= day) & (F.datediff(day, F.col("date")) <= stale_days) & (F.col("close") > 0)).groupBy("ticker").agg(F.max_by("close", "date").alias("close"))
    known = shares.where((F.col("filed") <= day) & (F.col("shares") > 0)).groupBy("ticker").agg(F.max_by("shares", F.struct("filed", "end", "shares")).alias("shares"))
    return close.join(known, "ticker").select("ticker", (F.col("close") * F.col("shares")).alias("cap"))


def anchored_cap(caps: DataFrame, prices: DataFrame, dates: DataFrame, stale_days: int = 10) -> DataFrame:
    """``ticker, date, cap``: the cap of the last end of June or December before each date (``ticker, anchor, cap``), moved by the price since; the anchor's price may be ``stale_days`` old."""
    from gristmill.operators.asof import asof

    px = prices.select("ticker", F.col("date").alias("pdate"), "close")
    anchors = asof(caps, px, "anchor", "pdate", ["close"], ["ticker"], stale_days).withColumnRenamed("close", "anchor_price").where("anchor_price > 0")
    asked = px.join(dates.select(F.col("date").alias("pdate")).distinct(), "pdate").withColumnRenamed("pdate", "date")
    last = F.when(F.month("date") > 6, F.make_date(F.year("date"), F.lit(6), F.lit(30))).otherwise(F.make_date(F.year("date") - 1, F.lit(12), F.lit(31)))
    return asked.withColumn("anchor", last).join(anchors, ["ticker", "anchor"]).select("ticker", "date", (F.col("cap") * F.col("close") / F.col("anchor_price")).alias("cap"))


def total_debt(long_term: Column, current_part: Column, short_term: Column, current: Column, parts: list[tuple[Column, Column]], others: list[Column]) -> Column:
    """Debt on one balance sheet, the first that is told: all long-term debt and short-term borrowings (or the current debt beyond
    the current part); non-current debt and current debt, where that is told, or the current part and short-term borrowings;
    other kinds and current debt or short-term borrowings. NULL where nothing is told; a told zero is a zero."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    beyond = F.when(current >= current_part, current - current_part)
    ways = [long_term + F.coalesce(short_term, beyond, F.lit(0.0))]
    for noncurrent, its_current in parts:
        below = zero(its_current) + zero(short_term)
        ways.append(noncurrent + F.when(current.isNotNull(), F.greatest(current, below)).otherwise(below))
    told = F.coalesce(current, short_term, *others).isNotNull()
    rest = sum((zero(c) for c in others), F.lit(0.0)) + F.coalesce(current, short_term, F.lit(0.0))
    return F.coalesce(*ways, F.when(told, rest))


def sheet_date(instants: DataFrame, groups: list[list[str]], keys: str = "cik") -> DataFrame:
    """``cik, sheet``: the latest date among the first group of concepts (equity and cash, then debt, then assets) that a company has at all."""
    ends = [F.max(F.when(F.col("concept").isin(g), F.col("end"))) for g in groups]
    return instants.groupBy(keys).agg(F.coalesce(*ends).alias("sheet")).where("sheet is not null")


def value_near(instants: DataFrame, target: Column, days: int, keys: list[str]) -> DataFrame:
    """The value of the instant nearest a date (a year ago, a balance sheet's), within so many days; of two as near the earlier."""
    gap = F.abs(F.datediff("end", target))
    return instants.where(gap <= days).groupBy(*keys).agg(F.min(F.struct(gap.alias("d"), F.col("end"), F.col("val"))).alias("x")).select(*keys, "x.end", "x.val")


def shares_outstanding(cover: DataFrame, diluted: DataFrame, as_of: str) -> DataFrame:
    """``cik, shares``: the classes of the latest filing's cover summed, else the latest diluted count; only what was filed by the date."""
    day = F.lit(as_of).cast("date")
    seen = cover.where(F.col("filed") <= day)
    latest = F.max(F.struct("filed", "accn")).over(Window.partitionBy("cik"))
    cover_date = F.max("end").over(Window.partitionBy("cik"))
    first = seen.withColumn("__l", latest).where(F.struct("filed", "accn") == F.col("__l")).withColumn("__e", cover_date).where(F.col("end") == F.col("__e"))
    first = first.groupBy("cik").agg(F.sum("val").alias("a")).where("a > 0")
    second = diluted.where(F.col("filed") <= day).groupBy("cik").agg(F.max_by("val", F.struct("end", "filed")).alias("b"))
    return first.join(second, "cik", "full").select("cik", F.coalesce("a", "b").alias("shares"))


def fiscal_label(end: Column, year_end_month: Column | int) -> Column:
    """A quarter's name such as Q2 FY2026: months after the fiscal year end that the quarter ends in, three to a quarter, in the year that the fiscal year ends in."""
    last = F.lit(year_end_month) if isinstance(year_end_month, int) else year_end_month
    middle = F.date_sub(end, 15)  # ends a few days into the next month count for the month before
    months = F.pmod(F.month(middle) - last - 1, F.lit(12)) + 1
    year = F.year(middle) + (F.month(middle) > last).cast("int")
    return F.concat(F.lit("Q"), F.ceil(months / 3).cast("string"), F.lit(" FY"), year.cast("string"))


def filings(submissions: DataFrame) -> DataFrame:
    """A row for each filing from the parallel arrays that an index of filings has: ``cik, accn, filed, report_date, form, document, items``."""
    return submissions.select("cik", F.inline(F.arrays_zip("accn", "filed", "report_date", "form", "document", "items")))


def filings_between(rows: DataFrame, forms: list[str], start: str, end: str, limit: int) -> DataFrame:
    """The newest ``limit`` filings of some forms of each company, filed within a window; newest first."""
    w = Window.partitionBy("cik").orderBy(F.col("filed").desc(), F.col("accn").desc())
    on = F.col("form").isin(forms) & F.col("filed").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return rows.where(on).withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)


def last_results(rows: DataFrame, as_of: str) -> DataFrame:
    """``cik, released``: the latest 8-K with item 2.02 filed by a date; amendments don't count."""
    has = F.array_contains(F.transform(F.split("items", ","), lambda x: F.trim(x)), "2.02")
    return rows.where((F.col("form") == "8-K") & has & (F.col("filed") <= F.lit(as_of).cast("date"))).groupBy("cik").agg(F.max("filed").alias("released"))
