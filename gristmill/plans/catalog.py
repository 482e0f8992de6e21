"""The closed vocabulary of screens."""

from __future__ import annotations

from gristmill.plans.screen import Feature

UNITS = {
    "USD": "price sma_20 sma_50 sma_200 high_52w low_52w macd_line macd_signal macd_histogram",
    "%": "price_vs_sma_50_pct price_vs_sma_200_pct sma_50_vs_sma_200_pct sma_200_slope_1m_pct return_1m_pct return_3m_pct return_6m_pct return_12m_pct return_12m_ex_1m_pct macd_histogram_pct_price drawdown_from_52w_high_pct above_52w_low_pct volatility_20d_pct volatility_60d_pct atr_14_pct iv_30d_pct short_interest_pct_float short_interest_change_1m_pct fcf_yield_pct earnings_yield_ntm_pct target_price_upside_pct revenue_growth_yoy_pct revenue_growth_last_q_yoy_pct revenue_growth_ntm_est_pct eps_growth_ntm_est_pct gross_margin_pct operating_margin_pct ebitda_margin_pct fcf_margin_pct net_margin_pct fcf_conversion_pct roe_pct cash_pct_market_cap eps_revision_3m_pct revenue_revision_3m_pct last_eps_surprise_pct operating_profitability_pct asset_growth_yoy_pct gross_profitability_pct earnings_yield_ttm_pct",
    "pp": "rel_strength_3m_pp rel_strength_6m_pp rel_strength_12m_pp gross_margin_change_yoy_pp operating_margin_change_yoy_pp",
    "x": "beta_1y rel_volume_5d rel_volume_20d max_volume_ratio_20d up_down_volume_ratio_50d iv_to_realized_vol_ratio put_call_volume_ratio put_call_oi_ratio ev_to_ebitda ev_to_sales pe_ntm net_debt_to_ebitda interest_coverage book_to_market",
    "USD bn": "market_cap_usd_bn enterprise_value_usd_bn net_debt_usd_bn",
    "USD mn": "avg_dollar_volume_20d_usd_mn",
    "0-100": "rsi_14 return_6m_percentile iv_rank_1y",
    "days": "days_to_cover days_since_last_earnings days_to_next_earnings",
    "sessions": "days_since_52w_high",
    "count": "num_analysts",
    "bool": "golden_cross_20d macd_bullish_cross_10d",
}
CATALOG = {n: Feature(n, unit) for unit, names in UNITS.items() for n in names.split()} | {n: Feature(n, "label", True) for n in ("gics_sector", "gics_industry", "exchange", "country", "security_type")}
