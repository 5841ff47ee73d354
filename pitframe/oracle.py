"""DuckDB SQL for the registered queries: shared subqueries by name, put together as each query needs them."""

from __future__ import annotations

import re

from pitframe.operators.percentile import REGISTRY
from pitframe.sources import adapters

DAY, FIRST, LAST = "DATE '1999-03-15'", "DATE '1999-01-04'", "DATE '1999-12-31'"
AMOUNTS = {"cost_of_revenue": 60, "ebit": 18, "ebitda": 24, "net_income": 11, "operating_cash": 16, "capex": 5, "tax": 3, "pretax": 15, "total_assets": 420, "current_liabilities": 60, "goodwill": 30, "intangibles": 20, "total_debt": 130, "cash_eq": 35, "short_term_inv": 12, "investing_cash": -7}


def _amount(p: int) -> str:
    # Spark's div cuts toward zero, as does this division
    return f"(trunc((cents * ({p} + (f * 100 // c) // 10)) / 100) / 100)"


def _full(agg: str, value: str, n: int, w: str = "b", last: int = 0) -> str:
    frame = f"OVER ({w} ROWS BETWEEN {n - 1 - last} PRECEDING AND {-last} PRECEDING)" if last else f"OVER ({w} ROWS {n - 1} PRECEDING)"
    return f"CASE WHEN count({value}) {frame} = {n} THEN {agg}({value}) {frame} END"


def _change(value: str, n: int) -> str:
    return f"({value} / nullif(lag({value}, {n}) OVER b, 0) - 1)"


#: The settings of the adapter tables, with the days on which they were set in New York; definitions of screens are in ``screen_parts``.
CONFIG = [
    *((key, 1, value, "1994-01-01") for key, value in {"gate.gap": "0.08", "gate.cooldown": "30", "gate.blackout_before": "5", "gate.blackout_after": "2", "screens.floor_lookback_days": "20", "screens.floor_percentile": "70", "tuner.slot_floor": "4", "tuner.slot_cap": "12", "screens.S1.state": "live", "screens.S1.min_inputs": "2", "screens.S1.slots": "6", "screens.S2.state": "live", "screens.S2.min_inputs": "2", "screens.S2.slots": "4", "screens.S3.state": "retired", "screens.S3.min_inputs": "1", "screens.S3.slots": "4", "news.rates": '{"small": {"input": 1.0, "output": 5.0}, "large": {"input": 3.0, "output": 15.0}}'}.items()),
    ("gate.gap", 2, "0.05", "1997-12-31"), ("gate.gap", 3, "0.06", "1999-06-01"), ("gate.cooldown", 2, "2", "1996-01-01"), ("gate.blackout_after", 2, "1", "2000-06-01"), ("screens.floor_lookback_days", 2, "15", "2000-01-03"), ("screens.floor_percentile", 2, "60", "1999-03-01"), ("screens.S1.slots", 2, "9", "1999-09-01"), ("screens.S2.state", 2, "shadow", "1998-12-31"), ("news.rates", 2, '{"small": {"input": 0.5, "output": 2.0}}', "2000-01-01"),
    ("screens.S1.metrics", 1, adapters._S1 % (2, 1), "1994-01-01"), ("screens.S1.metrics", 2, adapters._S1 % (1, 3), "2000-03-01"), ("screens.S2.metrics", 1, adapters._S2, "1994-01-01"), ("screens.S3.metrics", 1, adapters._S2, "1994-01-01"),
]

PARTS = {
    "nsup": "SELECT count(*) AS n FROM supplier",
    "price_rows": "SELECT 'T' || l_suppkey AS ticker, l_shipdate::DATE AS date, (100 + l_extendedprice / 10000)::DECIMAL(20,6) AS u, {'a': l_orderkey, 'b': l_linenumber, 'c': l_partkey, 'd': l_quantity, 'e': l_extendedprice} AS at, l_quantity FROM lineitem",
    "price_u": "SELECT ticker, date, arg_min(u, at) AS open, max(u) AS high, min(u) AS low, arg_max(u, at) AS close, sum(l_quantity)::BIGINT AS volume FROM price_rows GROUP BY ticker, date",
    "price_daily": "SELECT ticker, date, " + ", ".join(f"({c} * (CASE WHEN date < DATE '1998-07-01' THEN 2 ELSE 1 END))::DECIMAL(20,6) AS {c}" for c in ("open", "high", "low", "close")) + ", close AS adj_close, volume FROM price_u",
    "benchmark_daily": "SELECT date, sum(adj_close)::DOUBLE / count(*) AS adj_close FROM price_daily GROUP BY date",
    "epoch_list": "SELECT (q + CAST((7 - dayofweek(q)) % 7 AS INTEGER))::DATE AS date, (year(q) * 4 + quarter(q))::BIGINT AS epoch FROM (SELECT unnest(generate_series(date_trunc('quarter', a), date_trunc('quarter', b), INTERVAL 3 MONTHS))::DATE AS q FROM (SELECT min(l_shipdate::DATE) AS a, max(l_shipdate::DATE) AS b FROM lineitem))",
    "securities": "SELECT 'T' || s_suppkey AS ticker, s_suppkey AS k, CASE WHEN s_suppkey % 11 <> 0 THEN r_name END AS sector, CASE WHEN s_acctbal >= lo + (hi - lo) * 2 / 3 THEN 'large' WHEN s_acctbal >= lo + (hi - lo) / 3 THEN 'mid' ELSE 'small' END AS size_bucket, s_acctbal * 1000000 AS market_cap FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey, (SELECT min(s_acctbal) AS lo, max(s_acctbal) AS hi FROM supplier)",
    "security_daily": "SELECT ticker, date, CASE WHEN a THEN sector END AS sector, CASE WHEN a THEN size_bucket END AS size_bucket, CASE WHEN a THEN market_cap END AS market_cap, a AS is_active FROM (SELECT *, (k + epoch) % 9 <> 0 AS a FROM securities, epoch_list)",
    "quarters": "SELECT 1 + o_custkey % n AS k, (date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTHS - INTERVAL 1 DAY)::DATE AS period_end, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS cents, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) AS c FROM orders, nsup GROUP BY ALL",
    "raw_filings": "SELECT 'T' || k AS ticker, period_end, CASE WHEN x % 11 = 0 THEN NULL WHEN x % 13 = 0 THEN period_end WHEN x % 17 = 0 THEN period_end - 3 ELSE period_end + (20 + (k * 7 + q) % 60)::INTEGER END AS filing_date, CASE WHEN x % 7 <> 0 THEN 'S' || (k % 5) END AS sector, cents / 100 AS total_revenue, " + ", ".join(f"{_amount(p)} AS {a}" for a, p in AMOUNTS.items()) + f", CASE WHEN f % 5 <> 0 THEN {_amount(40)} END AS gross_profit, CASE WHEN f % 5 <> 0 THEN {_amount(80)} END AS reported_debt, CASE WHEN x % 19 <> 0 THEN (1000000 + k * 1000 + q * 10)::DOUBLE END AS shares FROM (SELECT *, year(period_end) * 4 + quarter(period_end) AS q, k + year(period_end) * 4 + quarter(period_end) AS x FROM quarters)",
    "reasoned": "SELECT *, filing_date - period_end AS days, CASE WHEN filing_date IS NULL THEN 'null' WHEN filing_date = period_end THEN 'equal' WHEN filing_date < period_end THEN 'negative' ELSE 'none' END AS filing_date_unknown_reason FROM raw_filings",
    "snapshot": "SELECT *, CASE WHEN gap IS NOT NULL THEN filing_date ELSE period_end + widest_gap::INTEGER END AS filing_date_effective FROM (SELECT *, CASE WHEN days > 0 THEN days END AS gap, max(CASE WHEN days > 0 THEN days END) OVER (PARTITION BY ticker) AS widest_gap FROM reasoned)",
    "earnings": "SELECT ticker, period_end, filing_date AS report_date, CASE WHEN (total_revenue * 100)::BIGINT % 7 <> 0 THEN ((total_revenue * 100)::BIGINT % 41 - 20) / 100 END AS surprise_fraction FROM raw_filings",
    "calendar": "SELECT DISTINCT ticker, 'earnings' AS event_type, filing_date AS event_date FROM raw_filings WHERE filing_date IS NOT NULL UNION ALL SELECT 'T' || s_suppkey, 'split', DATE '1998-07-01' FROM supplier",
    "insiders": "SELECT 'T' || (1 + user_id % n) AS ticker, ts::DATE + (event_id % 5)::INTEGER AS filed_at, ts::DATE AS transaction_date, CASE WHEN event_id % 89 <> 0 THEN 'O' || (user_id % 37) END AS owner, CASE event_type WHEN 'purchase' THEN 'P' WHEN 'error' THEN 'S' WHEN 'signup' THEN 'M' ELSE 'A' END AS code, CASE WHEN event_type = 'error' THEN 'D' ELSE 'A' END AS side, CASE WHEN event_id % 3 <> 0 THEN (event_id % 100 + 1) * json_extract_string(props, '$.k')::DOUBLE WHEN event_id % 97 <> 0 THEN (event_id % 100 + 1) * json_extract_string(props, '$.k')::DOUBLE END AS value FROM events, nsup",
    "holdings": "SELECT 'T' || k AS ticker, report_date, p_brand AS holder_name, CASE WHEN (k + year(report_date) * 4 + quarter(report_date)) % 13 <> 0 THEN q END AS shares FROM (SELECT l_suppkey AS k, (date_trunc('quarter', l_shipdate) + INTERVAL 3 MONTHS - INTERVAL 1 DAY)::DATE AS report_date, p_brand, sum(l_quantity) AS q FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)",
    "sentiment_daily": "SELECT 'T' || k AS ticker, date, CASE WHEN NOT (day(date) % 29 = 0 AND k % 2 = 1) THEN c END AS article_count, v / c / 1000000 AS sentiment_score FROM (SELECT 1 + user_id % n AS k, ts::DATE AS date, count(*) AS c, sum(round(value * 1000)::BIGINT)::BIGINT AS v FROM events, nsup GROUP BY ALL)",
    "trades": "SELECT 'T' || (1 + o_custkey % n) AS ticker, o_orderstatus AS s, o_orderdate::DATE AS opened, o_orderdate::DATE + 2 AS closed FROM orders, nsup",
    "headline": "SELECT 'T' || (1 + doc_id % n) AS ticker, doc_id AS article_id, CASE WHEN doc_id % 19 <> 0 THEN DATE '2024-01-30' - (doc_id % 12)::INTEGER END AS published_at, left(text, 40) AS title, text AS content FROM documents, nsup",
    "days": "SELECT DISTINCT date FROM price_daily",
    "spans": "SELECT *, lead(date) OVER (PARTITION BY ticker ORDER BY date) AS until FROM security_daily",
    "members": "SELECT days.date, ticker, sector, size_bucket, market_cap FROM days JOIN spans ON spans.date <= days.date AND (until IS NULL OR days.date < until) WHERE is_active",
    "universe": f"SELECT arg_max(s, date) AS s FROM (SELECT date, ticker, {{'ticker': ticker, 'date': date, 'sector': sector, 'size_bucket': size_bucket, 'market_cap': market_cap, 'is_active': is_active}} AS s FROM security_daily WHERE date <= {DAY}) GROUP BY ticker",
    "adj": "SELECT ticker, date, close::DOUBLE AS close, volume, adj_close::DOUBLE AS c, high::DOUBLE * (adj_close::DOUBLE / close::DOUBLE) AS h, low::DOUBLE * (adj_close::DOUBLE / close::DOUBLE) AS l, volume / (adj_close::DOUBLE / close::DOUBLE) AS v, row_number() OVER (PARTITION BY ticker ORDER BY date) AS bar FROM price_daily",
    "ind1": f"SELECT a.*, b.adj_close AS b, c / nullif(b.adj_close, 0) AS ratio, {_full('avg', 'c', 20)} AS ma20, {_full('avg', 'c', 50)} AS ma50, {_full('avg', 'c', 200)} AS ma200, {_full('max', 'h', 252)} AS high252, {_full('avg', 'v', 50)} AS v50, {_full('max', 'h', 60, 'b', -1)} AS base_high, {_full('min', 'l', 60, 'b', -1)} AS base_low, quantile_cont(close * volume, 0.5) OVER (b ROWS 19 PRECEDING) AS median_dollar_volume_20d FROM adj a LEFT JOIN benchmark_daily b USING (date) WINDOW b AS (PARTITION BY ticker ORDER BY date)",
    "ind2": "SELECT *, (c - ma20) / ma20 AS dist_20dma, (c - ma200) / ma200 AS dist_200dma, (c - high252) / high252 AS dist_52w_high, v / v50 AS volume_vs_50d_avg, ma50 / ma200 AS ma_ratio, CASE WHEN base_low > 0 THEN base_high - base_low <= 0.25 * base_low AND c > base_high END AS base_breakout_flag FROM ind1",
    "ind": f"SELECT *, dist_52w_high - lag(dist_52w_high, 20) OVER b AS dist_52w_high_20d_change, CASE WHEN count(ma_ratio) OVER (b ROWS 19 PRECEDING) = 20 THEN regr_slope(ma_ratio, bar) OVER (b ROWS 19 PRECEDING) / avg(ma_ratio) OVER (b ROWS 19 PRECEDING) END AS ma50_200_slope, CASE WHEN count(ratio) OVER (b ROWS 19 PRECEDING) = 20 THEN regr_slope(ratio, bar) OVER (b ROWS 19 PRECEDING) / avg(ratio) OVER (b ROWS 19 PRECEDING) END AS rs_20d_slope, {_change('ratio', 21)} AS rs_change_21d, {_change('ratio', 63)} AS rs_change_63d FROM ind2 WINDOW b AS (PARTITION BY ticker ORDER BY date)",
    "features": "SELECT m.*, i.dist_200dma, i.median_dollar_volume_20d, i.dist_52w_high, i.ma50_200_slope, i.base_breakout_flag FROM members m ASOF LEFT JOIN ind i ON m.ticker = i.ticker AND m.date >= i.date",
    "epochs": "SELECT date AS epoch, lead(date) OVER (ORDER BY date) AS ends FROM (SELECT DISTINCT date FROM security_daily)",
    "sectored": "SELECT ticker, date, sector FROM members WHERE sector IS NOT NULL",
    "in_epoch": "SELECT epoch, ends, s.ticker, sector FROM epochs JOIN spans s ON s.date <= epoch AND (until IS NULL OR epoch < until) WHERE is_active AND sector IS NOT NULL",
    "epoch_returns": "SELECT epoch, sector, p.date, adj_close::DOUBLE / lag(adj_close::DOUBLE) OVER (PARTITION BY epoch, p.ticker ORDER BY p.date) - 1 AS r FROM in_epoch e JOIN price_daily p ON p.ticker = e.ticker AND p.date >= epoch - 400 AND (ends IS NULL OR p.date < ends) WHERE adj_close > 0",
    "sector_days": "SELECT epoch, sector, date, avg(r) AS mean_return, count(r) AS members FROM epoch_returns GROUP BY ALL HAVING count(r) >= 2",
    "composite": "SELECT *, exp(sum(ln(1 + mean_return)) OVER (PARTITION BY epoch, sector ORDER BY date)) AS composite FROM sector_days",
    "held_bars": "SELECT ticker, date, adj_close::DOUBLE AS c, lag(adj_close::DOUBLE, 63) OVER b AS c0, lag(date, 63) OVER b AS date0 FROM price_daily WINDOW b AS (PARTITION BY ticker ORDER BY date)",
    "carried": "SELECT m.ticker, m.date, m.sector, b.date AS date1, c, c0, date0, epoch FROM sectored m ASOF LEFT JOIN held_bars b ON m.ticker = b.ticker AND m.date >= b.date JOIN epochs ON epoch <= m.date AND (ends IS NULL OR m.date < ends)",
    "numbered_bars": "SELECT ticker, date, row_number() OVER b AS i, adj_close::DOUBLE / lag(adj_close::DOUBLE) OVER b - 1 AS r FROM price_daily WHERE adj_close > 0 WINDOW b AS (PARTITION BY ticker ORDER BY date)",
    "on_day": "SELECT m.date AS day, m.ticker, m.sector, i FROM sectored m ASOF JOIN numbered_bars b ON m.ticker = b.ticker AND m.date >= b.date",
    "day_means": "SELECT day, sector, b.date, avg(r) AS mean_return FROM on_day o JOIN numbered_bars b ON b.ticker = o.ticker AND b.i BETWEEN o.i - 62 AND o.i WHERE r IS NOT NULL GROUP BY ALL HAVING count(*) >= 2",
    "day_universe": "SELECT day, sum(ln(1 + u)) AS level FROM (SELECT day, date, avg(mean_return) AS u FROM day_means GROUP BY ALL) GROUP BY day HAVING count(*) >= 63",
    "points": "SELECT p.ticker, p.at, f.* EXCLUDE (ticker), row_number() OVER (PARTITION BY p.ticker, p.at ORDER BY period_end DESC) AS rank, coalesce(reported_debt, total_debt - cash_eq - short_term_inv) AS net_debt, coalesce(gross_profit, total_revenue - cost_of_revenue) / total_revenue AS margin, total_assets - current_liabilities - goodwill - intangibles AS invested FROM {POINTS} p LEFT JOIN snapshot f ON f.ticker = p.ticker AND f.filing_date_effective <= p.at AND f.period_end > p.at - INTERVAL 24 MONTHS",
    "pivots": "SELECT ticker, at, count(period_end) FILTER (rank <= 8) AS periods, " + ", ".join(f"CASE WHEN count({c}) FILTER (rank BETWEEN {s} AND {s + 3}) = 4 THEN sum({c}) FILTER (rank BETWEEN {s} AND {s + 3}) END AS {c}_t{s}" for c, s in (("ebit", 1), ("ebitda", 1), ("operating_cash", 1), ("capex", 1), ("net_income", 1), ("tax", 1), ("pretax", 1), ("ebit", 5), ("tax", 5), ("pretax", 5))) + ", " + ", ".join(f"max({c}) FILTER (rank = {r}) AS {c}_{r}" for c, r in (("net_debt", 1), ("shares", 1), ("shares", 5), ("invested", 1), ("invested", 5), ("margin", 1), ("margin", 5), ("total_assets", 1), ("total_assets", 5), ("cash_eq", 1), ("short_term_inv", 1), ("operating_cash", 1), ("investing_cash", 1), *(("total_revenue", r) for r in range(1, 9)))) + " FROM points GROUP BY ticker, at",
    "basics": "SELECT *, roic - roic_b AS roic_4q_change FROM (SELECT ticker, at, periods, ebit_t1 AS ttm_ebit, operating_cash_t1 AS ttm_cash, capex_t1 AS ttm_capex, net_debt_1 AS net_debt, shares_1 AS shares, " + ", ".join(f"ebit_t{s} * (1 - CASE WHEN tax_t{s} / nullif(pretax_t{s}, 0) IS NULL THEN NULL ELSE least(greatest(tax_t{s} / nullif(pretax_t{s}, 0), 0), 0.5) END) / (CASE WHEN invested_{s} > 0 THEN invested_{s} END) AS {n}" for s, n in ((1, "roic"), (5, "roic_b"))) + ", margin_1 - margin_5 AS gross_margin_4q_change, net_debt_1 / (CASE WHEN ebitda_t1 > 0 THEN ebitda_t1 END) AS net_debt_ebitda, (net_income_t1 - operating_cash_t1) / ((total_assets_1 + total_assets_5) / 2) AS accruals, shares_1 / (CASE WHEN shares_5 > 0 THEN shares_5 END) - 1 AS share_count_change, (1.5 * (total_revenue_1 / total_revenue_5 - 1) + 0.5 * (total_revenue_2 / total_revenue_6 - 1) - 0.5 * (total_revenue_3 / total_revenue_7 - 1) - 1.5 * (total_revenue_4 / total_revenue_8 - 1)) / 5 AS revenue_growth_4q_trend, cash_eq_1 + coalesce(short_term_inv_1, 0) AS cash_on_hand, CASE WHEN operating_cash_1 IS NOT NULL THEN greatest(0, -(operating_cash_1 + investing_cash_1)) END AS quarterly_burn_rate FROM pivots)",
    "month_end": "SELECT ticker, max(date) AS date, arg_max(close, date)::DOUBLE AS close FROM price_daily GROUP BY ticker, date_trunc('month', date)",
    "then_priced": "SELECT m.ticker, m.date AS at, (CASE WHEN shares * close > 0 THEN shares * close END + net_debt) / (CASE WHEN ttm_ebit > 0 THEN ttm_ebit END) AS x FROM month_end m JOIN basics_daily b ON m.ticker = b.ticker AND m.date = b.at",
    "now_priced": f"SELECT m.ticker, m.date, (ttm_cash - ttm_capex) / (CASE WHEN shares * close > 0 THEN shares * close END) AS fcf_yield, (CASE WHEN shares * close > 0 THEN shares * close END + net_debt) / (CASE WHEN ttm_ebit > 0 THEN ttm_ebit END) AS ev_ebit FROM (SELECT ticker, date, close::DOUBLE AS close FROM price_daily) m JOIN basics_daily b ON m.ticker = b.ticker AND m.date = b.at WHERE periods > 0",
    "event_days": "SELECT DISTINCT ts::DATE AS date FROM events",
    "sundays": "SELECT d::DATE AS date FROM (SELECT unnest(generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL 1 DAY)) AS d FROM (SELECT min(date) AS a, max(date) AS b FROM price_daily)) WHERE dayofweek(d) = 0",
    "counts": "SELECT date, n, quantile_cont(n, 0.5) OVER w AS median, count(n) OVER w AS prior FROM (SELECT date, count(*) AS n FROM price_daily GROUP BY date) WINDOW w AS (ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)",
    "reported": f"SELECT DISTINCT ticker FROM calendar WHERE event_type = 'earnings' AND event_date > {DAY} - 20 AND event_date <= {DAY}",
    "delisted": "SELECT 'T' || s_suppkey AS ticker FROM supplier WHERE s_suppkey % 13 = 0",
    "liquid": f"SELECT ticker, last_close, median_dollar_volume, first_seen, last_seen, bars FROM (SELECT ticker, arg_max(close, date)::DOUBLE AS last_close, quantile_cont(close::DOUBLE * volume, 0.5) AS median_dollar_volume FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rn FROM price_daily WHERE date <= {DAY}) WHERE rn <= 20 GROUP BY ticker) JOIN (SELECT ticker, min(date) AS first_seen, max(date) AS last_seen, count(*) AS bars FROM price_daily WHERE date <= {DAY} GROUP BY ticker) USING (ticker) WHERE median_dollar_volume IS NOT NULL",
    "ready": f"SELECT ticker, CASE WHEN bool_or(filing_date_unknown_reason = 'none' OR shares IS NOT NULL) THEN count(*) FILTER (filing_date_unknown_reason = 'none') END AS clean_gaps, arg_max(shares, period_end) FILTER (shares IS NOT NULL) AS shares, arg_max(sector, {{'a': filing_date_effective, 'b': period_end}}) FILTER (sector IS NOT NULL) AS sector FROM snapshot WHERE filing_date_effective <= {DAY} GROUP BY ticker",
    "ranked": "SELECT *, " + ", ".join(f"CASE WHEN {m}_scope = 'cell' THEN CASE WHEN {m}_cn > 1 THEN ({m}_cr - 1) * 100.0::DOUBLE / ({m}_cn - 1) ELSE 0 END WHEN {m}_scope = 'bucket' THEN CASE WHEN {m}_bn > 1 THEN ({m}_br - 1) * 100.0::DOUBLE / ({m}_bn - 1) ELSE 0 END END AS {m}_pctile" for m in ("dist_200dma", "median_dollar_volume_20d", "dist_52w_high", "ma50_200_slope")) + " FROM scoped",
    "scoped": "SELECT *, " + ", ".join(f"CASE WHEN {m} IS NULL OR size_bucket IS NULL THEN NULL WHEN sector IS NOT NULL AND {m}_cn >= 5 THEN 'cell' WHEN {m}_bn >= 5 THEN 'bucket' ELSE 'none' END AS {m}_scope" for m in ("dist_200dma", "median_dollar_volume_20d", "dist_52w_high", "ma50_200_slope")) + " FROM windowed",
    "windowed": "SELECT *, " + ", ".join(f"count({m}) OVER (PARTITION BY date, size_bucket, sector) AS {m}_cn, rank() OVER (PARTITION BY date, size_bucket, sector ORDER BY {m}::REAL NULLS LAST) AS {m}_cr, count({m}) OVER (PARTITION BY date, size_bucket) AS {m}_bn, rank() OVER (PARTITION BY date, size_bucket ORDER BY {m}::REAL NULLS LAST) AS {m}_br" for m in ("dist_200dma", "median_dollar_volume_20d", "dist_52w_high", "ma50_200_slope")) + " FROM features",
    "settings_on": "SELECT date, " + ", ".join(f"max(value) FILTER (key = '{k}')::{kind} AS {n}" for n, k, kind in (("gap", "gate.gap", "DOUBLE"), ("cooldown", "gate.cooldown", "INTEGER"), ("before", "gate.blackout_before", "INTEGER"), ("after", "gate.blackout_after", "INTEGER"), ("lookback", "screens.floor_lookback_days", "INTEGER"), ("percent", "screens.floor_percentile", "INTEGER"), ("cap", "tuner.slot_cap", "INTEGER"), ("s1", "screens.S1.slots", "INTEGER"), ("s2", "screens.S2.slots", "INTEGER"), ("live2", "screens.S2.state", "VARCHAR"))) + " FROM params GROUP BY date",
    "screen_parts": "SELECT * FROM (VALUES ('S1', 1, 'dist_200dma', 1, 2), ('S1', 1, 'median_dollar_volume_20d', 1, 1), ('S1', 1, 'ma50_200_slope', 1, 1), ('S1', 2, 'dist_200dma', 1, 1), ('S1', 2, 'median_dollar_volume_20d', 1, 3), ('S1', 2, 'ma50_200_slope', 1, 1), ('S2', 1, 'dist_52w_high', -1, 1), ('S2', 1, 'dist_200dma', -1, 1)) t(screen_id, version, metric, direction, weight)",
    "pct_long": " UNION ALL ".join(f"SELECT date, ticker, '{m}' AS metric, {m}_pctile AS pctile FROM ranked WHERE {m}_pctile IS NOT NULL" for m in ("dist_200dma", "median_dollar_volume_20d", "dist_52w_high", "ma50_200_slope")),
    "weighed": "SELECT p.screen_id, l.date, ticker, count(*) AS n, sum(CASE WHEN direction > 0 THEN pctile ELSE 100 - pctile END * weight) / sum(weight) AS mean FROM pct_long l JOIN params v ON v.date = l.date AND v.key LIKE 'screens.%.metrics' JOIN screen_parts p ON v.key = 'screens.' || p.screen_id || '.metrics' AND v.version = p.version AND p.metric = l.metric GROUP BY ALL",
    "scored": "SELECT s.screen_id, r.date, r.ticker, r.size_bucket, (CASE WHEN n >= 2 THEN mean + CASE WHEN s.screen_id = 'S2' AND base_breakout_flag THEN 10 ELSE 0 END END)::REAL AS score FROM ranked r CROSS JOIN (SELECT unnest(['S1', 'S2']) AS screen_id) s LEFT JOIN weighed w ON w.screen_id = s.screen_id AND w.date = r.date AND w.ticker = r.ticker",
    "score_dates": "SELECT screen_id, date, row_number() OVER (PARTITION BY screen_id ORDER BY date) AS k FROM (SELECT DISTINCT screen_id, date FROM scored WHERE score IS NOT NULL)",
    "floor_98": "SELECT a.screen_id, a.date, CASE WHEN any_value(a.k) >= 20 THEN quantile_cont(s.score::DOUBLE, 0.98) END AS floor FROM score_dates a JOIN score_dates b ON a.screen_id = b.screen_id AND b.k BETWEEN a.k - 19 AND a.k JOIN scored s ON s.screen_id = b.screen_id AND s.date = b.date AND s.score IS NOT NULL GROUP BY a.screen_id, a.date",
    "floor_set": "SELECT a.screen_id, a.date, CASE WHEN any_value(a.k) < any_value(lookback) THEN NULL WHEN any_value(percent) = 70 THEN quantile_cont(s.score::DOUBLE, [0.6, 0.7])[2] ELSE quantile_cont(s.score::DOUBLE, [0.6, 0.7])[1] END AS floor FROM (SELECT d.screen_id, d.date, k, lookback, percent, unnest(range(k - lookback + 1, k + 1)) AS then_k FROM score_dates d JOIN settings_on x ON x.date = d.date) a JOIN score_dates b ON a.screen_id = b.screen_id AND b.k = a.then_k JOIN scored s ON s.screen_id = b.screen_id AND s.date = b.date AND s.score IS NOT NULL GROUP BY a.screen_id, a.date",
    "screened": "SELECT s.*, row_number() OVER (PARTITION BY s.screen_id, s.date ORDER BY score DESC, ticker) AS rank FROM scored s JOIN floor_set f ON s.screen_id = f.screen_id AND s.date = f.date WHERE score::DOUBLE >= floor",
    "bars": "SELECT ticker, date, open::DOUBLE AS open, volume, lag(close::DOUBLE) OVER (PARTITION BY ticker ORDER BY date) AS previous FROM price_daily",
    "blackouts": "SELECT DISTINCT ticker, date FROM calendar JOIN settings_on ON date BETWEEN event_date - before AND event_date + after WHERE event_type = 'earnings'",
    "helds": "SELECT DISTINCT ticker, unnest([opened, opened + 1]) AS date FROM trades WHERE s = 'O'",
    "colds": "SELECT DISTINCT ticker, date FROM trades JOIN settings_on ON date >= closed AND date < closed + cooldown WHERE s = 'F'",
    "flags": "SELECT m.date, m.ticker, e.ticker IS NOT NULL AS f1, coalesce(abs((open - previous) / nullif(previous, 0)) > x.gap, FALSE) AS f2, volume IS NULL OR volume = 0 AS f3, h.ticker IS NOT NULL AS f4, c.ticker IS NOT NULL AS f5, m.date IN (SELECT date FROM blackouts) AND m.date IN (SELECT date FROM helds) AND m.date IN (SELECT date FROM colds) AS known FROM members m JOIN settings_on x ON x.date = m.date LEFT JOIN bars b ON m.ticker = b.ticker AND m.date = b.date LEFT JOIN blackouts e ON e.ticker = m.ticker AND e.date = m.date LEFT JOIN helds h ON h.ticker = m.ticker AND h.date = m.date LEFT JOIN colds c ON c.ticker = m.ticker AND c.date = m.date",
    "gate": "SELECT date, ticker, list_filter([CASE WHEN f1 THEN 'earnings_blackout' END, CASE WHEN f2 THEN 'gap' END, CASE WHEN f3 THEN 'halt' END, CASE WHEN f4 THEN 'already_held' END, CASE WHEN f5 THEN 'cooldown' END], lambda x: x IS NOT NULL) AS reasons, NOT (f1 OR f2 OR f3 OR f4 OR f5) AS passed, CASE WHEN known THEN 'passed' ELSE 'passed_partial' END AS state FROM flags",
    "alive": "SELECT date, split_part(key, '.', 2) AS screen_id FROM params WHERE key LIKE 'screens.%.state' AND value = 'live'",
    "seated": "SELECT s.*, g.state AS gate_state, s.screen_id = 'S1' OR live2 = 'live' AS is_live, CASE WHEN s.screen_id = 'S1' THEN s1 WHEN live2 = 'live' THEN s2 ELSE cap END AS slots, row_number() OVER (PARTITION BY s.date, screen_id, size_bucket ORDER BY rank, s.ticker) AS seat FROM screened s JOIN gate g ON s.date = g.date AND s.ticker = g.ticker AND passed JOIN settings_on x ON x.date = s.date",
    "taken": "SELECT * FROM (SELECT *, slots // 4 AS l, (slots - slots // 4) // 2 AS m FROM seated) WHERE seat <= CASE size_bucket WHEN 'large' THEN l WHEN 'mid' THEN m ELSE slots - l - m END",
    "chosen": "SELECT * FROM taken WHERE is_live",
    "sets": "SELECT date, ticker, list_sort(list(DISTINCT screen_id)) AS screens FROM chosen GROUP BY date, ticker",
    "breadths": "SELECT date, count(*) FILTER (dist_200dma > 0)::DOUBLE / nullif(count(dist_200dma), 0) AS breadth FROM features GROUP BY date",
    "trend": "SELECT date, adj_close > CASE WHEN count(*) OVER w = 200 THEN avg(adj_close) OVER w END AS benchmark_above FROM benchmark_daily WINDOW w AS (ORDER BY date ROWS 199 PRECEDING)",
    "market": "SELECT date, breadth, benchmark_above, CASE WHEN breadth >= 0.6 AND benchmark_above THEN 'risk_on' WHEN breadth <= 0.4 AND NOT benchmark_above THEN 'risk_off' ELSE 'mixed' END AS regime_label FROM breadths LEFT JOIN trend USING (date)",
    "attributed": "SELECT date, ticker, list_sort(list(DISTINCT screen_id)) AS screen_ids, bool_or(is_live) AS is_candidate, min(size_bucket) AS size_bucket, min(gate_state) AS gate_state FROM taken GROUP BY date, ticker",
    "config_versions": "SELECT date, CASE WHEN count(*) FILTER (since <= date) > 0 THEN 1 + count(*) FILTER (since <= date AND version > 1) END AS config_version FROM days, config GROUP BY date",
    "hashed": "SELECT date, ticker, list_reduce(list_prepend(14695981039346656037::HUGEINT, [unicode(c)::HUGEINT for c in string_split(strftime(date, '%Y-%m-%d') || ticker, '')]), lambda h, b: xor(h, b) * 1099511628211::HUGEINT % 18446744073709551616::HUGEINT) AS hash FROM (SELECT DISTINCT date, ticker FROM sentiment_daily)",
    "moves": "SELECT ticker, date, c, bar, greatest(h - l, abs(h - before), abs(l - before)) AS t, CASE WHEN up > down AND up > 0 THEN up ELSE 0 END AS p, CASE WHEN down > up AND down > 0 THEN down ELSE 0 END AS m FROM (SELECT *, lag(c) OVER w AS before, h - lag(h) OVER w AS up, lag(l) OVER w - l AS down FROM adj WINDOW w AS (PARTITION BY ticker ORDER BY date))",
    "windows": "SELECT ticker, date, c, bar, list({'t': t, 'p': p, 'm': m, 'n': 0, 'a': 0.0::DOUBLE}) OVER w AS x FROM moves WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS 249 PRECEDING)",
    "smoothed": "SELECT ticker, date, c, list_reduce(list_prepend({'t': list_sum([y.t for y in x[1:14]]) / 14, 'p': list_sum([y.p for y in x[1:14]]) / 14, 'm': list_sum([y.m for y in x[1:14]]) / 14, 'n': 1, 'a': CASE WHEN list_sum([y.p + y.m for y in x[1:14]]) > 0 THEN 100 * abs(list_sum([y.p - y.m for y in x[1:14]])) / list_sum([y.p + y.m for y in x[1:14]]) ELSE 0 END}, x[15:250]), lambda s, y: {'t': (s.t * 13 + y.t) / 14, 'p': (s.p * 13 + y.p) / 14, 'm': (s.m * 13 + y.m) / 14, 'n': s.n + 1, 'a': (CASE WHEN s.n < 14 THEN s.a ELSE s.a * 13 END + CASE WHEN s.p * 13 + y.p + s.m * 13 + y.m > 0 THEN 100 * abs(s.p * 13 + y.p - s.m * 13 - y.m) / (s.p * 13 + y.p + s.m * 13 + y.m) ELSE 0 END) / CASE WHEN s.n >= 13 THEN 14 ELSE 1 END}) AS s FROM windows WHERE bar > 250",
    "wilder": "SELECT a.ticker, a.date, s.t / s.c AS atr_pct, s.a AS adx14 FROM adj a LEFT JOIN (SELECT ticker, date, c, s.t AS t, s.a AS a FROM smoothed) s ON s.ticker = a.ticker AND s.date = a.date",
    "articles": "SELECT *, coalesce(published_at > DATE '2024-01-30' - 7 AND published_at <= DATE '2024-01-30', FALSE) AS in_window, ceil(length(content) / 3.5)::BIGINT AS tokens FROM headline",
    "budget": "SELECT * FROM (SELECT *, row_number() OVER w AS rn, sum(tokens) OVER (PARTITION BY ticker ORDER BY published_at DESC NULLS LAST, title, article_id ROWS UNBOUNDED PRECEDING)::BIGINT AS upto FROM articles WHERE in_window WINDOW w AS (PARTITION BY ticker ORDER BY published_at DESC NULLS LAST, title, article_id)) WHERE rn = 1 OR upto <= 1200",
    "pairs": "SELECT m.ticker, m.date FROM members m WHERE m.date IN (SELECT min(date) FROM days GROUP BY year(date), quarter(date))",
    "config": "SELECT key, version, value, CAST(since AS DATE) AS since FROM (VALUES " + ", ".join(f"('{k}', {v}, '{x}', '{d}')" for k, v, x, d in CONFIG) + ") t(key, version, value, since)",
    "params": "SELECT date, key, arg_max(value, version) AS value, max(version) AS version FROM days JOIN config ON since <= date GROUP BY date, key",
}

PARTS |= {
    "listed": "SELECT 'T' || s_suppkey AS ticker FROM supplier WHERE s_suppkey % 3 <> 0",
    "old_bars": "SELECT ticker, date, open, close, volume FROM price_daily",
    "staged_bars": "SELECT CASE WHEN day(date) % 2 = 0 THEN ticker ELSE 'N' || ticker END AS ticker, date, (close * 2)::DECIMAL(20,6) AS close, volume + 1 AS volume FROM price_daily WHERE date >= DATE '1999-12-01'",
    "insider_days": "SELECT s.date, s.ticker, CASE WHEN coalesce(unknown, 0) = 0 THEN coalesce(net, 0) END AS insider_net_90d_usd, CASE WHEN coalesce(nameless, 0) = 0 THEN coalesce(buyers, 0) END AS distinct_buyer_count FROM (SELECT DISTINCT d.date, i.ticker FROM insiders i JOIN flow_days d ON filed_at <= d.date) s LEFT JOIN (SELECT d.date, ticker, sum(CASE side WHEN 'A' THEN value ELSE -value END) AS net, count(*) FILTER (value IS NULL) AS unknown, count(DISTINCT owner) FILTER (code = 'P') AS buyers, count(*) FILTER (code = 'P' AND owner IS NULL) AS nameless FROM insiders JOIN flow_days d ON filed_at <= d.date AND transaction_date <= d.date AND transaction_date > d.date - 90 WHERE code IN ('P', 'S') GROUP BY ALL) g ON g.date = s.date AND g.ticker = s.ticker",
    "flow_days": "SELECT date FROM event_days UNION SELECT date FROM sundays",
    "owner_days": "SELECT d.date, ticker, total / (CASE WHEN previous > 0 THEN previous END) - 1 AS inst_ownership_change FROM (SELECT *, lag(total) OVER w AS previous, lead(report_date) OVER w AS nxt FROM (SELECT ticker, report_date, sum(shares) AS total FROM holdings GROUP BY ALL HAVING count(*) = count(shares)) WINDOW w AS (PARTITION BY ticker ORDER BY report_date)) t JOIN flow_days d ON report_date <= d.date - 45 AND (nxt IS NULL OR nxt > d.date - 45)",
    "coverages": "SELECT 'prices' AS source, min(date) AS a, max(date) AS b FROM price_daily UNION ALL SELECT 'filings', min(filing_date_effective), max(filing_date_effective) FROM snapshot UNION ALL SELECT 'holdings', min(report_date), max(report_date) FROM holdings UNION ALL SELECT 'events', min(event_date), max(event_date) FROM calendar",
    "strengths": "SELECT s.day AS date, sector, round(exp(s.level - u.level) - 1, 6) AS strength FROM (SELECT day, sector, sum(ln(1 + mean_return)) AS level FROM day_means GROUP BY ALL HAVING count(*) >= 63) s JOIN day_universe u ON u.day = s.day",
    "sent_then": "SELECT ticker, date - 9131 AS date, article_count, sentiment_score, 1 AS stored FROM sentiment_daily",
    "sent_spine": "SELECT coalesce(m.ticker, x.ticker) AS ticker, coalesce(m.date, x.date) AS date, m.ticker IS NOT NULL AS wanted, stored, article_count, sentiment_score FROM members m FULL JOIN sent_then x ON m.ticker = x.ticker AND m.date = x.date",
    "derived": "SELECT ticker, date, articles_7d, CASE WHEN n >= 10 AND 90 * s2 - s * s > 0 THEN (CASE WHEN stored IS NULL THEN 0 ELSE article_count END - s / 90) / (sqrt(90 * s2 - s * s) / 90) END AS z, CASE WHEN n >= 10 THEN m7 - m30 END AS delta, CASE WHEN n >= 10 THEN m7 END AS level FROM (SELECT *, count(stored) OVER p AS n, coalesce(sum(coalesce(article_count, 0)) OVER p, 0) AS s, coalesce(sum(coalesce(article_count, 0) * coalesce(article_count, 0)) OVER p, 0) AS s2, sum(article_count) OVER week::BIGINT AS articles_7d, avg(sentiment_score) OVER week AS m7, avg(sentiment_score) OVER (PARTITION BY ticker ORDER BY date RANGE BETWEEN INTERVAL 29 DAYS PRECEDING AND CURRENT ROW) AS m30 FROM sent_spine WINDOW p AS (PARTITION BY ticker ORDER BY date RANGE BETWEEN INTERVAL 90 DAYS PRECEDING AND INTERVAL 1 DAYS PRECEDING), week AS (PARTITION BY ticker ORDER BY date RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW)) WHERE wanted",
}

#: Filings as read on the dates on which one becomes readable or expires, and, with no use of such dates, on the date of every bar.
_POINTS = {"": "(SELECT DISTINCT ticker, unnest([filing_date_effective, (period_end + INTERVAL 24 MONTHS)::DATE]) AS at FROM snapshot WHERE filing_date_effective < period_end + INTERVAL 24 MONTHS)", "_daily": "(SELECT ticker, date AS at FROM price_daily)"}
_FILED = {k: PARTS.pop(k) for k in ("points", "pivots", "basics")}
PARTS |= {f"{k}{x}": re.sub(r"FROM (points|pivots)\b", rf"FROM \1{x}", v.replace("{POINTS}", p)) for x, p in _POINTS.items() for k, v in _FILED.items()}

PARTS |= {
    "insiders_then": "SELECT ticker, filed_at - 9131 AS filed_at, transaction_date - 9131 AS transaction_date, owner, code, side, value FROM insiders",
    "insiders_then_days": re.sub(r"\bflow_days\b", "days", PARTS["insider_days"]).replace("insiders", "insiders_then"),
    "owners_then_days": re.sub(r"\bflow_days\b", "days", PARTS["owner_days"]),
    "registry": "SELECT m.date, m.ticker, m.size_bucket, m.sector, w.atr_pct, w.adx14, i.* EXCLUDE (ticker, date), rs_change_21d - rs_change_63d AS rs_21d_63d_change, rs_change_vs_sector, p.fcf_yield, p.ev_ebit, ev_ebit_vs_own_5y, b.* EXCLUDE (ticker), o.insider_net_90d_usd, o.distinct_buyer_count, q.inst_ownership_change, z AS article_count_z_own_90d, delta AS sentiment_delta_7v30, level AS sentiment_7d_level FROM members m ASOF LEFT JOIN ind i ON m.ticker = i.ticker AND m.date >= i.date ASOF LEFT JOIN wilder w ON m.ticker = w.ticker AND m.date >= w.date ASOF LEFT JOIN basics b ON m.ticker = b.ticker AND m.date >= b.at LEFT JOIN relative r ON r.ticker = m.ticker AND r.date = m.date LEFT JOIN now_priced p ON p.ticker = m.ticker AND p.date = m.date LEFT JOIN own_history h ON h.ticker = m.ticker AND h.date = m.date LEFT JOIN insiders_then_days o ON o.ticker = m.ticker AND o.date = m.date LEFT JOIN owners_then_days q ON q.ticker = m.ticker AND q.date = m.date LEFT JOIN derived d ON d.ticker = m.ticker AND d.date = m.date",
    "registry_long": " UNION ALL ".join(f"SELECT date, ticker, size_bucket, sector, '{m}' AS metric, {m}::REAL AS value FROM registry WHERE {m} IS NOT NULL" for of in REGISTRY.values() for m in of),
    "cell_values": "SELECT date, size_bucket, sector, metric, value, n, sum(n) OVER (PARTITION BY date, size_bucket, sector, metric) AS members, sum(n) OVER (PARTITION BY date, size_bucket, sector, metric ORDER BY value) - n AS less FROM (SELECT date, size_bucket, sector, metric, value, count(*) AS n FROM registry_long GROUP BY ALL)",
    "bucket_values": "SELECT date, size_bucket, metric, value, n, sum(n) OVER (PARTITION BY date, size_bucket, metric) AS members, sum(n) OVER (PARTITION BY date, size_bucket, metric ORDER BY value) - n AS less FROM (SELECT date, size_bucket, metric, value, count(*) AS n FROM registry_long GROUP BY ALL)",
    "registry_ranked": "SELECT l.date, l.ticker, l.size_bucket, l.metric, CASE WHEN l.size_bucket IS NULL THEN NULL WHEN l.sector IS NOT NULL AND c.members >= 5 THEN 'cell' WHEN b.members >= 5 THEN 'bucket' ELSE 'none' END AS scope, CASE WHEN l.sector IS NOT NULL AND c.members >= 5 THEN 100.0::DOUBLE * c.less / (c.members - 1) WHEN b.members >= 5 THEN 100.0::DOUBLE * b.less / (b.members - 1) END AS pctile FROM registry_long l JOIN bucket_values b ON b.date = l.date AND b.size_bucket = l.size_bucket AND b.metric = l.metric AND b.value = l.value LEFT JOIN cell_values c ON c.date = l.date AND c.size_bucket = l.size_bucket AND c.sector = l.sector AND c.metric = l.metric AND c.value = l.value",
}

_SYMBOLS = "SELECT code || '.US' AS ticker, coalesce(name, code) AS name FROM (SELECT CASE WHEN s_suppkey % 29 <> 0 THEN 'T' || s_suppkey END AS code, CASE WHEN s_suppkey % 5 <> 0 THEN s_name END AS name FROM supplier WHERE s_suppkey % 17 <> 0) WHERE code IS NOT NULL"
_SESSIONS = "SELECT d::DATE AS date FROM (SELECT unnest(generate_series(TIMESTAMP '1999-01-01', TIMESTAMP '2001-06-30', INTERVAL 1 DAY)) AS d) WHERE dayofweek(d) BETWEEN 1 AND 5 AND d::DATE IN (SELECT date FROM days)"

BODIES = {
    "flat_bulk_prices": "SELECT ticker || '.US' AS ticker, date, open, high, low, close, adj_close, volume FROM price_daily",
    "flat_price_series": "SELECT ticker, date, open, high, low, close, adj_close, volume FROM price_daily",
    "flat_statements": "SELECT ticker, period_end, filing_date, total_assets::DECIMAL(28,4) AS total_assets, total_revenue::DECIMAL(28,4) AS total_revenue, operating_cash::DECIMAL(28,4) AS operating_cash, investing_cash::DECIMAL(28,4) AS investing_cash, reported_debt::DECIMAL(28,4) AS net_debt, shares::DECIMAL(28,4) AS shares FROM raw_filings",
    "flat_earnings": "SELECT ticker, period_end, report_date, round(CASE WHEN report_date IS NULL AND month(period_end) = 6 THEN 0.99 ELSE surprise_fraction END, 4) AS surprise_fraction, (month(period_end) = 6)::BIGINT AS collisions FROM earnings",
    "flat_holders": "SELECT ticker, report_date, holder_name, shares::DECIMAL(28,4) AS shares FROM holdings WHERE ticker IN (SELECT ticker FROM raw_filings)",
    "flat_sector": "SELECT ticker, max(sector) AS sector FROM raw_filings GROUP BY ticker",
    "flat_insiders": "SELECT 'T' || (1 + user_id % n) AS ticker, event_id::VARCHAR AS accession_number, CASE WHEN event_type = 'error' THEN 'derivative' ELSE 'non_derivative' END AS transaction_side, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END::BIGINT AS transaction_ordinal, ts::DATE + (event_id % 5)::INTEGER AS filed_at, ts::DATE AS transaction_date, CASE event_type WHEN 'purchase' THEN 'P' WHEN 'error' THEN 'S' WHEN 'signup' THEN 'M' ELSE 'A' END AS transaction_code FROM events, nsup",
    "flat_sentiment": "SELECT ticker, date, article_count, round(sentiment_score::REAL::DOUBLE, 4) AS sentiment_score FROM sentiment_daily",
    "flat_calendar": "SELECT ticker, event_type, event_date FROM calendar WHERE event_type = 'earnings' AND ticker IN (SELECT ticker FROM listed)",
    "flat_bulk_actions": "SELECT ticker, 'dividend_ex' AS event_type, event_date, event_date - 9 AS announced_date FROM calendar WHERE event_type = 'split' AND ticker IN (SELECT ticker FROM listed)",
    "flat_ticker_actions": "SELECT ticker, event_type, event_date FROM calendar WHERE event_type = 'split'",
    "flat_events": "SELECT ticker, event_type, event_date, NULL::DATE AS announced_date FROM calendar WHERE event_type = 'earnings' AND ticker IN (SELECT ticker FROM listed) UNION ALL SELECT ticker, 'dividend_ex', event_date, CASE WHEN ticker IN (SELECT ticker FROM listed) THEN event_date - 9 ELSE DATE '1999-01-01' END FROM calendar WHERE event_type = 'split'",
    "flat_news": "SELECT ticker, strftime(published_at - INTERVAL 30 MINUTES, '%Y-%m-%d %H:%M') AS published, source AS url, md5(content) AS md5 FROM (SELECT *, (SELECT source FROM documents d WHERE d.doc_id = article_id) AS source FROM headline)",
    "flat_symbols": _SYMBOLS,
    "exchange_sessions": _SESSIONS,
    "recent_session": f"SELECT max(date) AS session FROM ({_SESSIONS}) WHERE date BETWEEN DATE '2000-04-20' AND DATE '2000-04-30'",
    "upsert_bars": "SELECT coalesce(o.ticker, s.ticker) AS ticker, coalesce(o.date, s.date) AS date, open, CASE WHEN s.ticker IS NOT NULL THEN s.close ELSE o.close END AS close, CASE WHEN s.ticker IS NOT NULL THEN s.volume ELSE o.volume END AS volume FROM old_bars o FULL JOIN staged_bars s ON o.ticker = s.ticker AND o.date = s.date",
    "update_bars": "SELECT o.ticker, o.date, open, o.close, CASE WHEN s.ticker IS NULL THEN o.volume ELSE s.volume END AS volume FROM old_bars o LEFT JOIN staged_bars s ON o.ticker = s.ticker AND o.date = s.date",
    "insert_absent_bars": "SELECT ticker, date, open, close, volume FROM old_bars UNION ALL SELECT ticker, date, close AS open, close, volume FROM staged_bars s WHERE NOT EXISTS (SELECT 1 FROM old_bars o WHERE o.ticker = s.ticker AND o.date = s.date)",
    "replace_dates_bars": "SELECT ticker, date, open, close, volume FROM old_bars WHERE date NOT IN (SELECT date FROM staged_bars) UNION ALL SELECT ticker, date, close AS open, close, volume FROM staged_bars",
    "coverage_intervals": "SELECT source, a AS covered_from, b + 5 AS covered_to FROM coverages",
    "config_versions": "SELECT date, config_version FROM config_versions",
    "liquid_pool": "SELECT ticker FROM liquid WHERE last_close >= 101 AND median_dollar_volume >= 2500 AND bars >= 200 AND ticker IN (SELECT ticker FROM listed)",
    "identity_rollup": "SELECT ticker, min(f) AS first_seen, max(l) AS last_seen, max(name) AS name FROM (" + " UNION ALL ".join(f"SELECT ticker, f, l, '{d[:7]} ' || ticker AS name FROM (SELECT ticker, arg_max(close, date)::DOUBLE AS c, quantile_cont(close::DOUBLE * volume, 0.5) FILTER (rn <= 20) AS m, min(date) AS f, max(date) AS l, count(*) AS bars FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rn FROM price_daily WHERE date <= DATE '{d}') GROUP BY ticker) WHERE c >= 101 AND m >= 2000 AND bars >= 150" for d in ("1999-03-15", "1999-09-15")) + ") GROUP BY ticker",
    "flow_by_ticker": "SELECT coalesce(a.date, b.date) AS date, coalesce(a.ticker, b.ticker) AS ticker, round(insider_net_90d_usd, 8) AS insider_net_90d_usd, distinct_buyer_count, round(inst_ownership_change, 8) AS inst_ownership_change FROM insider_days a FULL JOIN owner_days b ON a.date = b.date AND a.ticker = b.ticker",
    "eligible_scores": "SELECT m.ticker, m.date, articles_7d, CASE WHEN a.score >= 30 AND b.score <= 80 AND (dist_20dma > 0 OR rs_20d_slope > 0) AND (coalesce(articles_7d, 0) < 40 OR (z < 1 AND delta >= -0.05)) THEN round(b.score::DOUBLE, 6) END AS score FROM members m ASOF LEFT JOIN ind i ON m.ticker = i.ticker AND m.date >= i.date LEFT JOIN scored a ON a.screen_id = 'S1' AND a.ticker = m.ticker AND a.date = m.date LEFT JOIN scored b ON b.screen_id = 'S2' AND b.ticker = m.ticker AND b.date = m.date JOIN derived d ON d.ticker = m.ticker AND d.date = m.date",
    "screen_faults": "SELECT DISTINCT f.date FROM floor_set f JOIN alive a ON a.date = f.date AND a.screen_id = f.screen_id WHERE floor IS NOT NULL AND f.date NOT IN (SELECT s.date FROM screened s JOIN alive b ON b.date = s.date AND b.screen_id = s.screen_id)",
    "candidate_rows": "SELECT date, ticker, gate_state FROM attributed WHERE is_candidate",
    "chance_overlap": "SELECT screen_id, round(r, 6) AS mean_ranked, round(s, 6) AS mean_scored, round(r / (2 * s - r), 6) AS chance_overlap FROM (SELECT screen_id, avg(n) AS r FROM (SELECT screen_id, date, count(*) AS n FROM screened GROUP BY ALL) GROUP BY screen_id) JOIN (SELECT screen_id, avg(n) AS s FROM (SELECT screen_id, date, count(*) AS n FROM scored WHERE score IS NOT NULL GROUP BY ALL) GROUP BY screen_id) USING (screen_id)",
    "digest_outcomes": "SELECT ticker, CASE min(article_id) % 6 WHEN 0 THEN 'no_row' WHEN 1 THEN 'no_articles' WHEN 2 THEN 'no_material_news' ELSE CASE WHEN min(article_id) % 6 = 5 AND arg_min(content, article_id) IS NULL THEN 'no_articles' ELSE 'prose' END END AS outcome FROM headline GROUP BY ticker",
    "record_thresholds": "SELECT date, key, value, version FROM params WHERE key LIKE 'gate.%' AND date IN (SELECT date FROM pairs)",
    "record_covered": "SELECT ticker, date, date BETWEEN (SELECT max(a) FROM coverages) AND (SELECT min(b) FROM coverages) AS covered FROM pairs",
    "record_market": "SELECT p.ticker, p.date, regime_label, round(breadth, 6) AS breadth, strength AS sector_strength FROM pairs p ASOF LEFT JOIN security_daily s ON p.ticker = s.ticker AND p.date >= s.date LEFT JOIN market m ON m.date = p.date LEFT JOIN strengths k ON k.date = p.date AND k.sector = s.sector",
    "record_news": "SELECT ticker, article_id, in_window FROM articles WHERE published_at IS NULL OR published_at <= DATE '2024-01-30'",
    "record_membership": "SELECT p.ticker, p.date, s.date AS since, sector, size_bucket, round(market_cap, 2) AS market_cap, is_active FROM pairs p ASOF LEFT JOIN security_daily s ON p.ticker = s.ticker AND p.date >= s.date",
    "record_recent_bars": 'SELECT ticker, "on", date, rn, rn = 1 AS newest, volume FROM (SELECT p.ticker, p.date AS "on", b.date, volume, row_number() OVER (PARTITION BY p.ticker, p.date ORDER BY b.date DESC) AS rn FROM pairs p JOIN price_daily b ON p.ticker = b.ticker AND b.date <= p.date) WHERE rn <= 5',
    "record_filings": 'SELECT ticker, "on", period_end, rn, rn = 1 AS newest FROM (SELECT p.ticker, p.date AS "on", period_end, row_number() OVER (PARTITION BY p.ticker, p.date ORDER BY period_end DESC) AS rn FROM pairs p JOIN snapshot b ON p.ticker = b.ticker AND filing_date_effective <= p.date) WHERE rn <= 4',
    "record_metrics": "SELECT p.ticker, p.date, metric, round(value, 7) AS value, round(pctile, 7) AS pctile, ranked_in, CASE WHEN sector IS NOT NULL THEN cn END AS cell_members, bn AS bucket_members FROM pairs p JOIN (SELECT date, ticker, sector, 'dist_200dma' AS metric, dist_200dma AS value, dist_200dma_pctile AS pctile, dist_200dma_scope AS ranked_in, dist_200dma_cn AS cn, dist_200dma_bn AS bn FROM ranked UNION ALL SELECT date, ticker, sector, 'median_dollar_volume_20d', median_dollar_volume_20d, median_dollar_volume_20d_pctile, median_dollar_volume_20d_scope, median_dollar_volume_20d_cn, median_dollar_volume_20d_bn FROM ranked) r ON p.date = r.date AND p.ticker = r.ticker",
    "price_daily": "SELECT * FROM price_daily",
    "universe_asof": "SELECT s.* FROM (SELECT s.ticker, s.date, s.sector, s.size_bucket, round(s.market_cap, 2) AS market_cap, s.is_active FROM universe) s",
    "members_asof": "SELECT s.* FROM (SELECT s.ticker, s.date, s.sector, s.size_bucket, round(s.market_cap, 2) AS market_cap, s.is_active FROM universe) s WHERE is_active",
    "epochs_in_range": f"SELECT DISTINCT date FROM security_daily WHERE date <= {LAST} AND date >= coalesce((SELECT max(date) FROM security_daily WHERE date <= {FIRST}), {FIRST})",
    "epoch_map": "SELECT d.date, e.date AS epoch FROM days d ASOF JOIN (SELECT DISTINCT date FROM security_daily) e ON d.date >= e.date",
    "range_members": "SELECT date, ticker, sector, size_bucket, round(market_cap, 2) AS market_cap FROM members",
    "sessions": "SELECT date FROM days",
    "filing_dates": "SELECT ticker, period_end, filing_date, filing_date_unknown_reason, gap, widest_gap, filing_date_effective FROM snapshot",
    "filing_quality": "SELECT *, substituted > periods * 0.25 OR wide_tickers > 0 AS alert FROM (SELECT count(*) AS periods, count(*) FILTER (gap IS NULL AND filing_date_effective IS NOT NULL) AS substituted, count(DISTINCT ticker) FILTER (widest_gap > 75) AS wide_tickers FROM snapshot)",
    "readable_filings": f"SELECT ticker, period_end, row_number() OVER (PARTITION BY ticker ORDER BY period_end DESC) AS rank FROM snapshot WHERE filing_date_effective <= {DAY}",
    "freshness": "SELECT CASE WHEN newest < DATE '2001-11-01' THEN 'stale' ELSE coalesce(state, 'unsettled') END AS state, CASE WHEN newest >= DATE '2001-11-01' AND state = 'fresh' THEN date END AS usable_date, CASE WHEN newest >= DATE '2001-11-01' AND state = 'fresh' THEN n END AS rows, newest >= DATE '2001-11-01' AND state = 'fresh' AND n < 3 AS alert, newest >= DATE '2001-11-01' AND state = 'fresh' AND prior < 20 AS unchecked FROM (SELECT max(date) AS newest FROM counts), (SELECT date, n, prior, CASE WHEN n < 1 THEN 'abort' ELSE 'fresh' END AS state FROM counts WHERE NOT (n >= 1 AND prior >= 20 AND n < median * 0.95) ORDER BY date DESC LIMIT 1)",
    "frontier": "SELECT max(date) AS frontier FROM counts WHERE prior < 20 OR n >= median * 0.95",
    "just_reported": "SELECT ticker FROM reported",
    "rotation": "SELECT p.ticker, attempted_at, r.ticker IS NOT NULL AS reported, u.ticker IS NOT NULL AS in_universe FROM (SELECT DISTINCT ticker FROM security_daily) p LEFT JOIN (SELECT ticker, max(closed) AS attempted_at FROM trades WHERE s = 'F' GROUP BY ticker) a USING (ticker) LEFT JOIN reported r USING (ticker) LEFT JOIN (SELECT s.ticker AS ticker FROM universe WHERE s.is_active) u USING (ticker) ORDER BY attempted_at IS NOT NULL, r.ticker IS NULL, attempted_at NULLS FIRST, u.ticker IS NULL, p.ticker LIMIT 25",
    "rotation_counts": "SELECT (SELECT count(DISTINCT ticker) FROM security_daily) AS pool, (SELECT count(DISTINCT ticker) FROM security_daily WHERE ticker NOT IN (SELECT ticker FROM trades WHERE s = 'F')) AS never_tried, count(*) FILTER (attempted_at IS NULL) AS first_attempts, count(attempted_at) AS refreshed, min(attempted_at) AS oldest_refreshed FROM (ROTATION)",
    "evaluation_dates": "SELECT date FROM sundays",
    "liquidity": "SELECT ticker, round(last_close, 6) AS last_close, round(median_dollar_volume, 6) AS median_dollar_volume, first_seen, last_seen, bars, CASE WHEN last_close < 101 THEN 'below_min_price' WHEN median_dollar_volume < 2500 THEN 'below_min_dollar_volume' WHEN bars < 200 THEN 'insufficient_history' END AS verdict FROM liquid",
    "universe_waterfall": f"SELECT ticker, criterion, sector, CASE WHEN criterion IS NULL THEN CASE WHEN cap >= 1.16e8 THEN 'large' WHEN cap >= 1.12e8 THEN 'mid' WHEN cap IS NOT NULL THEN 'small' END END AS size_bucket, round(cap, 2) AS market_cap, first_seen, last_seen FROM (SELECT q.ticker, r.sector, shares * last_close AS cap, first_seen, last_seen, CASE WHEN last_close < 101 THEN 'below_min_price' WHEN median_dollar_volume < 2000 THEN 'below_min_dollar_volume' WHEN bars < 150 THEN 'insufficient_history' WHEN substr(q.ticker, 2)::INT % 17 = 0 THEN 'not_common_stock' WHEN dl.d < {DAY} THEN 'delisted_on_date' WHEN clean_gaps IS NULL THEN 'no_fundamentals' WHEN clean_gaps < 4 THEN 'below_clean_gaps' WHEN shares IS NULL OR shares <= 0 THEN 'no_share_count' WHEN shares * last_close < 1e8 THEN 'below_market_cap' END AS criterion FROM liquid q LEFT JOIN ready r USING (ticker) LEFT JOIN (SELECT ticker, max(date) AS d FROM price_daily WHERE ticker IN (SELECT ticker FROM delisted) GROUP BY ticker) dl USING (ticker)) WHERE criterion IS NULL OR last_seen > {DAY} - 60",
    "departures": f"SELECT ticker, NULL::VARCHAR AS sector, NULL::VARCHAR AS size_bucket, NULL::DOUBLE AS market_cap, FALSE AS is_active FROM (SELECT ticker, arg_max(is_active, date) FILTER (date <= {FIRST}) AS a, arg_max(is_active, date) FILTER (date <= DATE '1999-07-15') AS b FROM security_daily GROUP BY ticker) WHERE a AND NOT b",
    "delisted_on": "SELECT ticker, max(date) AS delisted_on FROM price_daily WHERE ticker IN (SELECT ticker FROM delisted) GROUP BY ticker",
    "delisted_pool": f"SELECT DISTINCT ticker FROM price_daily WHERE ticker IN (SELECT ticker FROM delisted) AND date BETWEEN {FIRST} AND DATE '1999-01-31'",
    "dist_200dma": "SELECT ticker, date, round(dist_20dma, 6) AS dist_20dma, round(dist_200dma, 6) AS dist_200dma FROM ind",
    "high_and_volume": "SELECT ticker, date, round(dist_52w_high, 6) AS dist_52w_high, round(dist_52w_high_20d_change, 6) AS dist_52w_high_20d_change, round(volume_vs_50d_avg, 6) AS volume_vs_50d_avg FROM ind",
    "ma_slope_breakout": "SELECT ticker, date, round(ma50_200_slope, 8) AS ma50_200_slope, base_breakout_flag FROM ind",
    "median_dollar_volume": "SELECT ticker, date, round(median_dollar_volume_20d, 7) AS median_dollar_volume_20d FROM ind",
    "relative_strength": "SELECT ticker, date, round(rs_change_21d, 8) AS rs_change_21d, round(rs_change_63d, 8) AS rs_change_63d, round(rs_change_21d - rs_change_63d, 8) AS rs_21d_63d_change, round(rs_20d_slope, 8) AS rs_20d_slope FROM ind",
    "sector_composite": "SELECT epoch, sector, date, round(mean_return, 6) AS mean_return, members, round(composite, 6) AS composite FROM composite",
    "rs_vs_sector": "SELECT c.ticker, c.date, round((c / x.composite) / (c0 / y.composite) - 1, 6) AS rs_change_vs_sector FROM carried c LEFT JOIN composite x ON x.epoch = c.epoch AND x.sector = c.sector AND x.date = date1 LEFT JOIN composite y ON y.epoch = c.epoch AND y.sector = c.sector AND y.date = date0",
    "carried_indicators": "SELECT ticker, date, round(dist_200dma, 6) AS dist_200dma, base_breakout_flag FROM features",
    "fundamentals_readable": "SELECT ticker, at, periods, " + ", ".join(f"CASE WHEN round({c}, 6) <> 0 THEN round({c}, 6) WHEN {c} IS NOT NULL THEN 0.0 END AS {c}" for c in ("ttm_ebit", "ttm_cash", "ttm_capex", "net_debt", "shares", "roic", "roic_4q_change", "gross_margin_4q_change", "net_debt_ebitda", "accruals", "share_count_change", "revenue_growth_4q_trend", "cash_on_hand", "quarterly_burn_rate")) + " FROM basics",
    "valuation_priced": "SELECT ticker, date, round(fcf_yield, 6) AS fcf_yield, round(ev_ebit, 6) AS ev_ebit FROM now_priced",
    "month_ends": "SELECT ticker, date, round(close, 6) AS close FROM month_end",
    "ev_ebit_own_history": "SELECT p.ticker, p.date, round(CASE WHEN count(x) >= 6 AND quantile_cont(x, 0.5) > 0 THEN any_value(ev_ebit) / quantile_cont(x, 0.5) END, 6) AS ev_ebit_vs_own_5y FROM now_priced p LEFT JOIN then_priced h ON h.ticker = p.ticker AND h.at < p.date AND h.at >= p.date - INTERVAL 60 MONTHS GROUP BY p.ticker, p.date",
    "surprises": f"SELECT ticker, list(surprise_fraction ORDER BY rn) AS last_two_earnings_surprises FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY report_date DESC, period_end DESC) AS rn FROM earnings WHERE surprise_fraction IS NOT NULL AND report_date <= {DAY}) WHERE rn <= 2 GROUP BY ticker",
    "insider_flow": "SELECT s.date, s.ticker, round(CASE WHEN coalesce(unknown, 0) = 0 THEN coalesce(net, 0) END, 2) AS insider_net_90d_usd, CASE WHEN coalesce(nameless, 0) = 0 THEN coalesce(buyers, 0) END AS distinct_buyer_count FROM (SELECT DISTINCT d.date, i.ticker FROM insiders i JOIN event_days d ON filed_at <= d.date) s LEFT JOIN (SELECT d.date, ticker, sum(CASE side WHEN 'A' THEN value ELSE -value END) AS net, count(*) FILTER (value IS NULL) AS unknown, count(DISTINCT owner) FILTER (code = 'P') AS buyers, count(*) FILTER (code = 'P' AND owner IS NULL) AS nameless FROM insiders JOIN event_days d ON filed_at <= d.date AND transaction_date <= d.date AND transaction_date > d.date - 90 WHERE code IN ('P', 'S') GROUP BY ALL) g ON g.date = s.date AND g.ticker = s.ticker",
    "ownership_change": "SELECT d.date, ticker, round(total / (CASE WHEN previous > 0 THEN previous END) - 1, 6) AS inst_ownership_change FROM (SELECT *, lag(total) OVER w AS previous, lead(report_date) OVER w AS nxt FROM (SELECT ticker, report_date, sum(shares) AS total FROM holdings GROUP BY ALL HAVING count(*) = count(shares)) WINDOW w AS (PARTITION BY ticker ORDER BY report_date)) t JOIN sundays d ON report_date <= d.date - 45 AND (nxt IS NULL OR nxt > d.date - 45)",
    "flow_unknowns": "SELECT (SELECT count(DISTINCT ticker) FROM insiders WHERE code IN ('P', 'S') AND value IS NULL) AS unpriced_tickers, (SELECT count(*) FROM (SELECT ticker FROM holdings GROUP BY ticker HAVING count(DISTINCT report_date) >= 2)) AS two_report_tickers",
    "article_sentiment": "SELECT ticker, date, CASE WHEN n >= 10 AND 90 * s2 - s * s > 0 THEN round((CASE WHEN stored IS NULL THEN 0 ELSE article_count END - s / 90) / (sqrt(90 * s2 - s * s) / 90), 6) END AS article_count_z_own_90d, CASE WHEN n >= 10 THEN round(m7 - m30, 6) END AS sentiment_delta_7v30, CASE WHEN n >= 10 THEN round(m7, 6) END AS sentiment_7d_level FROM (SELECT ticker, date, stored, article_count, count(stored) OVER p AS n, coalesce(sum(coalesce(article_count, 0)) OVER p, 0) AS s, coalesce(sum(coalesce(article_count, 0) * coalesce(article_count, 0)) OVER p, 0) AS s2, avg(sentiment_score) OVER (PARTITION BY ticker ORDER BY date RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW) AS m7, avg(sentiment_score) OVER (PARTITION BY ticker ORDER BY date RANGE BETWEEN INTERVAL 29 DAYS PRECEDING AND CURRENT ROW) AS m30 FROM (SELECT t.ticker, d.date, x.stored, x.article_count, x.sentiment_score FROM (SELECT DISTINCT ticker FROM sentiment_daily) t CROSS JOIN event_days d LEFT JOIN (SELECT *, 1 AS stored FROM sentiment_daily) x ON x.ticker = t.ticker AND x.date = d.date) WINDOW p AS (PARTITION BY ticker ORDER BY date RANGE BETWEEN INTERVAL 90 DAYS PRECEDING AND INTERVAL 1 DAYS PRECEDING))",
    "breadth": "SELECT date, round(breadth, 6) AS breadth FROM breadths",
    "benchmark_trend": "SELECT * FROM trend",
    "market_regime": "SELECT date, round(breadth, 6) AS breadth, benchmark_above, regime_label FROM market",
    "sector_strength": "SELECT date, sector, strength FROM strengths",
    "percentile_registry": "SELECT date, size_bucket, metric, scope, count(*) AS n, round(avg(pctile), 6) AS mean, round(avg(pctile * pctile), 6) AS mean_square, arg_max(ticker, {'a': pctile, 'b': ticker}) AS first FROM registry_ranked GROUP BY ALL",
    "percentile_cells": "SELECT date, ticker, " + ", ".join(f"round({m}_pctile, 6) AS {m}_pctile, {m}_scope" for m in ("dist_200dma", "median_dollar_volume_20d")) + " FROM ranked",
    "cell_ledger": "SELECT date, size_bucket, sector, metric, CASE WHEN sector IS NOT NULL THEN n END AS cell_members, bucket_members, 5 AS floor, CASE WHEN sector IS NOT NULL AND n >= 5 THEN 'cell' WHEN bucket_members >= 5 THEN 'bucket' ELSE 'none' END AS scope FROM (SELECT *, sum(n) OVER (PARTITION BY date, size_bucket, metric)::BIGINT AS bucket_members FROM (SELECT date, size_bucket, sector, 'dist_200dma' AS metric, count(dist_200dma) AS n FROM features GROUP BY ALL UNION ALL SELECT date, size_bucket, sector, 'median_dollar_volume_20d', count(median_dollar_volume_20d) FROM features GROUP BY ALL))",
    "fallback_report": "SELECT date, metric, count(*) FILTER (scope = 'cell') AS in_cell, count(*) FILTER (scope = 'bucket') AS in_bucket, count(*) FILTER (scope = 'none') AS unranked, count(DISTINCT size_bucket || '/' || sector) FILTER (scope <> 'cell') AS thin_cells FROM (SELECT date, size_bucket, sector, 'dist_200dma' AS metric, dist_200dma_scope AS scope FROM ranked UNION ALL SELECT date, size_bucket, sector, 'median_dollar_volume_20d', median_dollar_volume_20d_scope FROM ranked) WHERE scope IS NOT NULL GROUP BY date, metric",
    "screen_scores": "SELECT screen_id, date, ticker, size_bucket, round(score::DOUBLE, 3) AS score FROM scored",
    "screen_states": "SELECT date, split_part(key, '.', 2) AS screen_id, value AS state FROM params WHERE key LIKE 'screens.%.state'",
    "param_asof": "SELECT date, key, value, version FROM params",
    "screen_floor": "SELECT screen_id, date, round(floor, 3) AS floor FROM floor_98",
    "screen_rank": "SELECT screen_id, date, ticker, rank FROM screened",
    "screen_coverage": "SELECT screen_id, count(DISTINCT date) AS scored_dates, (SELECT count(*) FROM days) AS sessions FROM scored WHERE score IS NOT NULL GROUP BY screen_id",
    "gate_labels": "SELECT * FROM gate",
    "candidates": "SELECT date, screen_id, size_bucket, ticker FROM chosen",
    "candidate_set": "SELECT * FROM sets",
    "attribution": "SELECT a.date, a.ticker, screen_ids, CASE WHEN is_candidate THEN 'candidate' ELSE 'shadow' END AS surfaced_as, a.size_bucket, sector, regime_label, gate_state, config_version FROM attributed a LEFT JOIN market m ON m.date = a.date LEFT JOIN members u ON u.date = a.date AND u.ticker = a.ticker LEFT JOIN config_versions v ON v.date = a.date",
    "concentration": "SELECT (SELECT round(count(*) FILTER (size_bucket = 'large') / count(*), 6) FROM chosen WHERE date IN (SELECT DISTINCT date FROM chosen ORDER BY date DESC LIMIT 20)) AS megacap_share, (SELECT count(DISTINCT ticker) FROM chosen WHERE date IN (SELECT DISTINCT date FROM chosen ORDER BY date DESC LIMIT 60)) AS distinct_tickers",
    "concentration_alerts": "SELECT * FROM (SELECT 'megacap_share' AS alert_type, (SELECT round(count(*) FILTER (size_bucket = 'large') / count(*), 6) FROM chosen WHERE date IN (SELECT DISTINCT date FROM chosen ORDER BY date DESC LIMIT 20)) AS value) WHERE value > 0.2 UNION ALL SELECT * FROM (SELECT 'distinct_tickers', (SELECT count(DISTINCT ticker) FROM chosen WHERE date IN (SELECT DISTINCT date FROM chosen ORDER BY date DESC LIMIT 60))::DOUBLE AS v) WHERE v < 250",
    "candidates_per_night": "SELECT count(*) AS dates, round(avg(n), 6) AS mean, min(n) AS least, max(n) AS most FROM (SELECT date, count(DISTINCT ticker) AS n FROM chosen GROUP BY date)",
    "size_mix": "SELECT size_bucket, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM chosen GROUP BY size_bucket",
    "megacap_by_regime": "SELECT round(count(*) FILTER (size_bucket = 'large') / count(*), 6) AS overall, round(count(*) FILTER (size_bucket = 'large' AND regime_label = 'risk_off') / nullif(count(*) FILTER (regime_label = 'risk_off'), 0), 6) AS risk_off, count(*) FILTER (regime_label IS NULL) AS unlabelled FROM chosen LEFT JOIN market USING (date)",
    "fewest_names": "SELECT min(n) AS fewest_names FROM (SELECT a.date, count(DISTINCT ticker) AS n FROM (SELECT date, row_number() OVER (ORDER BY date) AS k FROM (SELECT DISTINCT date FROM chosen)) a JOIN (SELECT date, row_number() OVER (ORDER BY date) AS k FROM (SELECT DISTINCT date FROM chosen)) b ON b.k BETWEEN a.k - 19 AND a.k JOIN chosen c ON c.date = b.date WHERE a.k >= 20 GROUP BY a.date)",
    "overlap": "SELECT (SELECT round(count(*) FILTER (len(screens) > 1) / count(*), 6) FROM sets) AS candidate_overlap, (SELECT round(count(*) FILTER (n > 1) / count(*), 6) FROM (SELECT date, ticker, count(DISTINCT screen_id) AS n FROM screened GROUP BY ALL)) AS ranked_overlap",
    "completeness": "SELECT 0::BIGINT AS unattributed, 0::BIGINT AS unstamped, (SELECT count(*) FROM attributed WHERE NOT is_candidate) AS shadow_rows",
    "seats": "SELECT date, screen_id, count(DISTINCT ticker) AS seats FROM chosen GROUP BY date, screen_id",
    "persistence": "SELECT screen_id, " + ", ".join(f"round(avg(CASE WHEN s IS NOT NULL AND p{n} IS NOT NULL THEN len(list_intersect(s, p{n})) / len(list_distinct(list_concat(s, p{n}))) END), 6) AS jaccard_{n}" for n in (1, 5, 21)) + ", count(*) FILTER (s IS NOT NULL AND p1 IS NOT NULL) AS pairs, round(avg(len(s)), 6) AS mean_ranked, round(avg(scored_names), 6) AS mean_scored, count(s) AS dates_ranked, count(*) AS dates_scored, round(sum(large) / sum(n), 6) AS large_share FROM (SELECT *, " + ", ".join(f"lag(s, {n}) OVER (PARTITION BY screen_id ORDER BY date) AS p{n}" for n in (1, 5, 21)) + " FROM (SELECT screen_id, date, count(*) AS scored_names FROM scored WHERE score IS NOT NULL GROUP BY ALL) LEFT JOIN (SELECT screen_id, date, list(ticker) AS s, count(*) FILTER (size_bucket = 'large') AS large, count(*) AS n FROM screened GROUP BY ALL) USING (screen_id, date)) GROUP BY screen_id",
    "news_window": "SELECT article_id, ticker, published_at, in_window FROM articles",
    "article_budget": "SELECT ticker, article_id, rn, upto FROM budget",
    "digest_input": "SELECT ticker, md5(string_agg(title || chr(10) || content, chr(10) || chr(10) ORDER BY rn)) AS md5, sum(tokens)::BIGINT AS tokens FROM budget GROUP BY ticker",
    "hash_rotation": "SELECT date, ticker, rn FROM (SELECT date, ticker, row_number() OVER (PARTITION BY date ORDER BY hash, ticker) AS rn FROM hashed) WHERE rn <= 2",
    "wilder_atr_adx": "SELECT ticker, date, round(atr_pct, 6) AS atr_pct, round(adx14, 6) AS adx14 FROM wilder",
    "token_cost": "SELECT *, round(tokens * rate / 1e6, 6) AS cost FROM (SELECT article_id, CASE WHEN article_id % 2 = 0 THEN 'small' ELSE 'large' END AS model, CASE WHEN article_id % 3 = 0 THEN 'output' ELSE 'input' END AS kind, tokens, CASE WHEN article_id % 6 = 0 THEN 5.0 WHEN article_id % 2 = 0 THEN 1.0 WHEN article_id % 3 = 0 THEN 15.0 ELSE 3.0 END::DOUBLE AS rate FROM articles)",
}


PARTS |= {"relative": BODIES["rs_vs_sector"].replace("round((c / x.composite) / (c0 / y.composite) - 1, 6)", "(c / x.composite) / (c0 / y.composite) - 1"), "own_history": BODIES["ev_ebit_own_history"].replace("round(CASE", "(CASE").replace("END, 6)", "END)")}
assert "round" not in PARTS["relative"] + PARTS["own_history"]

def _with(body: str) -> str:
    need: list[str] = []

    def add(text: str) -> None:
        for name in PARTS:
            if name not in need and re.search(rf"\b(?:FROM|JOIN|,)\s+{name}\b", text):
                add(PARTS[name])
                if name not in need:
                    need.append(name)

    add(body)
    text = ("WITH " + ", ".join(f"{n} AS MATERIALIZED ({PARTS[n]})" for n in need) + " " if need else "") + body
    return re.sub(r"\bat\b", '"at"', text)  # a keyword there


def _rejections() -> str:
    fall = BODIES["universe_waterfall"]
    return f"SELECT p.ticker, p.date, {DAY} AS rejected_on, criterion FROM pairs p JOIN ({fall}) w ON p.ticker = w.ticker AND criterion IS NOT NULL AND p.date >= {DAY} ASOF LEFT JOIN security_daily s ON p.ticker = s.ticker AND p.date >= s.date WHERE s.date IS NULL OR s.date <= {DAY}"


BODIES["record_rejection"] = _rejections()
BODIES["rotation_counts"] = BODIES["rotation_counts"].replace("ROTATION", BODIES["rotation"])
BODIES["insider_flow_landed"] = BODIES["insider_flow"]
BODIES["ownership_landed"] = f"SELECT * FROM ({BODIES['ownership_change']}) WHERE ticker IN (SELECT ticker FROM raw_filings)"
BODIES |= {f"stored_{k}": BODIES[f"{k}{x}_bars"] for k, x in (("upsert", ""), ("update", ""), ("replace", "_dates"))}


def oracle_sql() -> dict[str, str]:
    return {name: _with(body) for name, body in BODIES.items()}
