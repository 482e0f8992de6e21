"""Factor portfolios: two-by-three sorts, held from July to June or re-formed each month, weighted by the cap before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LABELS = {"bm": ("L", "M", "H"), "op": ("W", "N", "R"), "inv": ("C", "N", "A"), "mom": ("Down", "Mid", "Up")}


def monthly_panel(bars: DataFrame) -> DataFrame:
    """``ticker, month, close, carried``: the last known close of each month, and carried over months without one. A ticker's months are a sequence from its first to its last, so nothing is crossed."""
    known = F.when(F.col("close").isNotNull(), F.col("date"))
    own = bars.groupBy("ticker", F.trunc("date", "month").alias("month")).agg(F.max_by("close", known).alias("close"))
    grid = own.groupBy("ticker").agg(F.explode(F.sequence(F.min("month"), F.max("month"), F.expr("interval 1 month"))).alias("month"))
    w = Window.partitionBy("ticker").orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    return grid.join(own, ["ticker", "month"], "left").withColumn("carried", F.last("close", True).over(w))


def quantile(ordered: str, q: float, fused: bool = False) -> Column:
    """The q-quantile of a sorted array, between neighbours in proportion.

    Names that lie at a cut point fall by its last bit. By default it never leaves the neighbours' range and the nearer one wins between
    neighbours of one bit's distance. ``fused``: as DuckDB's ``quantile_cont``, low * (1 - x) + high * x, the first product not rounded before the sum.
    """
    at = (F.size(ordered) - 1) * F.lit(q)
    low, high = F.get(ordered, F.floor(at).cast("int")), F.get(ordered, F.ceil(at).cast("int"))
    x = at - F.floor(at)
    if not fused:
        return low + (high - low) * x
    some = lambda c: F.coalesce(c, F.lit(0.0))  # noqa: E731  (the method takes no nulls)
    between = F.java_method(F.lit("java.lang.Math"), F.lit("fma"), some(low), 1 - x, some(high * x)).cast("double")
    return F.when(x == 0, low).when(low.isNotNull() & high.isNotNull(), between)


def sort_two_by_three(rows: DataFrame, size: str = "size", char: str = "char", exchange: str | None = None, by: str = "formation", labels=LABELS["bm"], least: int = 20) -> DataFrame:
    """Adds ``port`` such as S/L or B/H: the median of size, 30 and 70 percent of the characteristic, among the NYSE names where ``least`` of them qualify, else among all. Names need a positive size and a characteristic."""
    ok = rows.where((F.col(size) > 0) & F.col(char).isNotNull() & ~F.isnan(char))
    main = F.upper(F.trim(F.col(exchange))).isin("NYSE", "N", "XNYS") if exchange else F.lit(False)
    ok = ok.withColumn("__main", F.coalesce(main, F.lit(False)))

    def values(prefix: str) -> list[Column]:
        on = F.col("__main") if prefix == "m" else F.lit(True)
        return [F.sort_array(F.collect_list(F.when(on, F.col(x)))).alias(f"{prefix}{n}") for n, x in (("s", size), ("c", char))]

    points = ok.groupBy(by).agg(F.sum(F.col("__main").cast("int")).alias("k"), *values("m"), *values("a"))
    points = points.select(by, *(F.when(F.col("k") >= least, F.col(f"m{n}")).otherwise(F.col(f"a{n}")).alias(f"__{n}") for n in "sc"))
    points = points.select(by, quantile("__s", 0.5, True).alias("__s"), F.array(quantile("__c", 0.3, True), quantile("__c", 0.7, True)).alias("__c"))
    placed = ok.join(points, by)  # a row for each formation
    s = F.when(F.col(size) <= F.col("__s"), "S").otherwise("B")
    c = F.when(F.col(char) <= F.col("__c")[0], labels[0]).when(F.col(char) <= F.col("__c")[1], labels[1]).otherwise(labels[2])
    return placed.withColumn("port", F.concat_ws("/", s, c)).drop("__s", "__c", "__main")


def formation_year(date: str | Column) -> Column:
    """The June that a month's portfolios were formed in: July to June of the next year."""
    return F.year(date) - (F.month(date) <= 6).cast("int")


def value_weighted(rows: DataFrame, *keys: str) -> DataFrame:
    """``ret, n`` of each group: returns weighted by the cap before; names without either are left out."""
    good = rows.where("ret is not null and prior_me > 0")
    return good.groupBy(*keys).agg((F.sum(F.col("prior_me") * F.col("ret")) / F.sum("prior_me")).alias("ret"), F.count("*").alias("n"))


def spreads(ports: DataFrame, date: str, labels=LABELS["bm"], least: int = 5) -> DataFrame:
    """``smb, spread`` by date from ``port, ret, n``; a portfolio of fewer than ``least`` names is missing, and so is what uses it."""
    names = [f"{s}/{c}" for s in "SB" for c in labels]
    wide = ports.withColumn("ret", F.when(F.col("n") >= least, F.col("ret"))).groupBy(date).pivot("port", names).agg(F.first("ret"))
    g = lambda n: F.col(f"`{n}`")
    smb = sum((g(f"S/{c}") for c in labels[1:]), g(f"S/{labels[0]}")) / 3 - sum((g(f"B/{c}") for c in labels[1:]), g(f"B/{labels[0]}")) / 3
    high, low = ((g(f"S/{c}") + g(f"B/{c}")) / 2 for c in (labels[2], labels[0]))
    return wide.select(date, smb.alias("smb"), (high - low).alias("spread"))


#: Columns of each model, and other names that a column goes by.
MODELS = {"capm": ("MKT",), "ff3": ("MKT-RF", "SMB", "HML"), "carhart4": ("MKT-RF", "SMB", "HML", "Mom"), "ff5": ("MKT-RF", "SMB", "HML", "RMW", "CMA")}
ALIASES = {"umd": "Mom", "wml": "Mom", "mom": "Mom", "mktrf": "MKT-RF", "mkt_rf": "MKT-RF", "mkt-rf": "MKT-RF"}


def plain_names(factors: DataFrame) -> DataFrame:
    """Factor columns under the names of the models."""
    return factors.withColumnsRenamed({c: ALIASES[c.strip().lower()] for c in factors.columns if c.strip().lower() in ALIASES})


def held(chars: DataFrame, char: str, labels, exchange: str | None, least: int, monthly: bool = False) -> DataFrame:
    """Returns of the names of each two-by-three portfolio: formed in June and held for twelve months, or formed by what was known the month before."""
    if monthly:
        before = Window.partitionBy("ticker").orderBy("month")
        late = chars.withColumn("__char_before", F.lag(char).over(before)).withColumn("__size_before", F.lag("size").over(before)).withColumn("formation", F.col("month"))
        return sort_two_by_three(late, "__size_before", "__char_before", exchange, "formation", labels, least)
    june = chars.where("month(month) = 6").withColumn("formation", F.year("month"))
    ports = sort_two_by_three(june, "size", char, exchange, "formation", labels, least).select("ticker", "formation", "port")
    return chars.withColumn("formation", formation_year("month")).join(ports, ["ticker", "formation"])


def factor_returns(chars: DataFrame, columns: dict[str, str], exchange: str | None = None, least: int = 20, thin: int = 5) -> DataFrame:
    """``month, mkt, smb`` and a spread for each characteristic (bm: hml, op: rmw, inv: cma, mom) that ``columns`` names.

    Chars are ``ticker, month, ret, prior_me, size`` and characteristics. The size factor is the mean over the annual sorts;
    investment is conservative less aggressive. A market or portfolio of under ``thin`` names is missing, and so is what uses it.
    """
    market = value_weighted(chars, "month")
    out = market.select("month", F.when(F.col("n") >= thin, F.col("ret")).alias("mkt"))
    sizes = []
    for kind, char in columns.items():
        rows = held(chars, char, LABELS[kind], exchange, least, kind == "mom")
        found = spreads(value_weighted(rows, "month", "port"), "month", LABELS[kind], thin)
        name = {"bm": "hml", "op": "rmw", "inv": "cma", "mom": "mom"}[kind]
        spread = -F.col("spread") if kind == "inv" else F.col("spread")
        out = out.join(found.select("month", F.col("smb").alias(f"__{kind}"), spread.alias(name)), "month", "left")
        sizes += [F.col(f"__{kind}")] if kind != "mom" else []
    smb = sum(sizes[1:], sizes[0]) / len(sizes)
    return out.withColumn("smb", smb).drop(*(f"__{k}" for k in columns))


def finer_rate(rates: DataFrame, unit: str) -> DataFrame:
    """``period, rf``: a daily or monthly riskless rate compounded over each calendar month, quarter or year."""
    return rates.where("rf is not null").groupBy(F.date_trunc(unit, "date").cast("date").alias("period")).agg((F.product(1 + F.col("rf")) - 1).alias("rf"))


def against_official(built: DataFrame, official: DataFrame, name: str, ppy: float = 12.0) -> DataFrame:
    """How a factor that was built compares with a published one over the dates that both have."""
    both = built.select("month", F.col(name).alias("a")).join(official.select("month", F.col(name).alias("b")), "month").where("a is not null and b is not null")
    return both.agg(F.count("*").alias("n"), F.corr("a", "b").alias("correlation"), (F.avg("a") * ppy * 100).alias("built_premium_pct"), (F.avg("b") * ppy * 100).alias("official_premium_pct"))
