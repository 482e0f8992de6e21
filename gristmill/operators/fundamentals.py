"""Fundamental and positioning cross-sections: guarded projections over left joins on the ticker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.numbers import finite, growth_pct, nonnegative, positive, ratio

COVERAGE_CAP = 100.0


def _column(frame: DataFrame):
    """Numbers by name; a column that a source doesn't have is missing throughout."""
    have = set(frame.columns)
    return lambda name: finite(name) if name in have else F.lit(None).cast("double")


def fundamental(frame: DataFrame, as_of: str) -> dict[str, Column]:
    """Features from one row for each ticker: market cap, price, fundamentals and estimates."""
    n = _column(frame)
    day = lambda name: F.col(name).cast("date") if name in frame.columns else F.lit(None).cast("date")
    cap, px, billion = positive(n("market_cap")), positive(n("price")), 1e9
    revenue, revenue_py, gross, operating, net = n("revenue_ttm"), n("revenue_ttm_prior_year"), n("gross_profit_ttm"), n("operating_income_ttm"), n("net_income_ttm")
    fcf = F.coalesce(n("fcf_ttm"), n("cfo_ttm") - nonnegative(n("capex_ttm")))
    debt, cash, equity, ebitda = nonnegative(n("total_debt")), nonnegative(n("cash_and_equivalents")), n("total_equity"), n("ebitda_ttm")
    net_debt, paid = debt - cash, nonnegative(n("interest_expense_ttm"))
    interest = F.when(paid.isNull() & (debt == 0), 0.0).otherwise(paid)
    eps, eps_3m, sales, sales_3m, assets = n("eps_ntm_est"), n("eps_ntm_est_3m_ago"), nonnegative(n("revenue_ntm_est")), nonnegative(n("revenue_ntm_est_3m_ago")), n("total_assets")
    pct = lambda a, b: ratio(a, b) * 100
    ev, today = cap + net_debt, F.lit(as_of).cast("date")
    since, until = F.datediff(today, F.coalesce(day("last_earnings_date"), day("report_date"))).cast("double"), F.datediff(day("next_earnings_date"), today).cast("double")
    return {
        "enterprise_value_usd_bn": ev / billion, "fcf_yield_pct": pct(fcf, cap), "ev_to_ebitda": ratio(ev, ebitda), "ev_to_sales": ratio(ev, revenue),
        "pe_ntm": ratio(px, eps), "earnings_yield_ntm_pct": pct(eps, px), "target_price_upside_pct": growth_pct(positive(n("target_price_mean")), px),
        "revenue_growth_yoy_pct": growth_pct(revenue, revenue_py), "revenue_growth_last_q_yoy_pct": growth_pct(n("revenue_last_q"), n("revenue_last_q_prior_year")),
        "revenue_growth_ntm_est_pct": growth_pct(sales, revenue), "eps_growth_ntm_est_pct": growth_pct(eps, n("eps_ttm")),
        "gross_margin_pct": pct(gross, revenue), "operating_margin_pct": pct(operating, revenue), "ebitda_margin_pct": pct(ebitda, revenue), "fcf_margin_pct": pct(fcf, revenue), "net_margin_pct": pct(net, revenue),
        "gross_margin_change_yoy_pp": pct(gross, revenue) - pct(n("gross_profit_ttm_prior_year"), revenue_py), "operating_margin_change_yoy_pp": pct(operating, revenue) - pct(n("operating_income_ttm_prior_year"), revenue_py),
        "fcf_conversion_pct": pct(fcf, net), "roe_pct": pct(net, equity), "net_debt_usd_bn": net_debt / billion, "net_debt_to_ebitda": ratio(net_debt, ebitda),
        "interest_coverage": F.when((interest == 0) & (operating > 0), COVERAGE_CAP).otherwise(F.when(interest > 0, F.least(operating / interest, F.lit(COVERAGE_CAP)) + operating * 0)),
        "cash_pct_market_cap": pct(cash, cap), "eps_revision_3m_pct": pct(eps - eps_3m, F.abs(eps_3m)), "revenue_revision_3m_pct": growth_pct(sales, sales_3m),
        "num_analysts": nonnegative(n("num_analysts")), "last_eps_surprise_pct": n("last_eps_surprise") * 100, "days_since_last_earnings": nonnegative(since), "days_to_next_earnings": nonnegative(until),
        "book_to_market": F.when(equity > 0, ratio(equity, cap)), "operating_profitability_pct": pct(operating - F.coalesce(paid, F.lit(0.0)), equity), "asset_growth_yoy_pct": growth_pct(positive(assets), n("total_assets_prior_year")),
        "gross_profitability_pct": pct(gross, assets), "earnings_yield_ttm_pct": pct(net, cap),
    }


def positioning(frame: DataFrame) -> dict[str, Column]:
    """Features from one row for each ticker: options, short interest, average volume and realised volatility."""
    n = _column(frame)
    nn = lambda name: nonnegative(n(name))
    iv, high, low, shorts = nn("iv_30d_atm"), nn("iv_30d_atm_1y_high"), nn("iv_30d_atm_1y_low"), nn("short_interest_shares")
    rank = ratio(iv - low, high - low) * 100
    return {
        "iv_30d_pct": iv * 100, "iv_rank_1y": F.when(rank.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), rank))), "iv_to_realized_vol_ratio": ratio(iv * 100, nn("volatility_20d_pct")),
        "put_call_volume_ratio": ratio(nn("put_volume"), nn("call_volume")), "put_call_oi_ratio": ratio(nn("put_open_interest"), nn("call_open_interest")),
        "short_interest_pct_float": ratio(shorts, nn("float_shares")) * 100, "days_to_cover": ratio(shorts, nn("avg_volume_20d")), "short_interest_change_1m_pct": growth_pct(shorts, nn("short_interest_shares_1m_ago")),
    }


def options_summary(chain: DataFrame, key: str = "ticker") -> DataFrame:
    """Of ``key, spot, strike, call_iv, put_iv, call_volume, put_volume, call_open_interest, put_open_interest``: implied volatility at the strike nearest to the spot (strikes with both preferred), volumes and open interest."""
    ok = lambda c: F.when((F.col(c) > 0.01) & (F.col(c) < 5), F.col(c))
    call, put = ok("call_iv"), ok("put_iv")
    rows = chain.withColumn("iv", F.when(call.isNotNull() & put.isNotNull(), (call + put) / 2).otherwise(F.coalesce(call, put))).withColumn("one", (call.isNull() | put.isNull()).cast("int"))
    near = F.min_by("iv", F.when(F.col("iv").isNotNull(), F.struct("one", F.abs(F.col("strike") - F.col("spot")), "strike")))
    return rows.groupBy(key).agg(near.alias("iv_30d_atm"), *(F.sum(c).alias(c) for c in ("call_volume", "put_volume", "call_open_interest", "put_open_interest")))
