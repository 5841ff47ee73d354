"""Closed-form answers, leaks, seams and null rules of the screening operators on small tables."""

import datetime as dt
import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitframe import queries
from pitframe.functions.series import jaccard, slot_quota, token_estimate
from pitframe.operators import asof, filings, flow, measure, news, percentile, screens, selection, technical, universe, valuation
from pitframe.operators.technical import wilder_arrays
from pitframe.plans import upsert as writes
from pitframe.sources import flatten, landing
from pitframe.sources.adapters import Tables

D = dt.date


def test_wilder_closed_forms():
    n = 300
    flat = np.full(n, 100.0)
    atr, adx = wilder_arrays(flat + 1, flat - 1, flat, 250, 14)
    assert atr[-1] == pytest.approx(0.02) and adx[-1] == 0 and np.isnan(atr[249])
    rising = 100.0 + np.arange(n)
    assert wilder_arrays(rising + 1, rising - 1, rising, 250, 14)[1][-1] == pytest.approx(100)
    gap = flat + 1
    gap[-40] = np.nan
    assert np.isnan(wilder_arrays(gap, flat - 1, flat, 250, 14)[0][-1])


def test_wilder_query_has_every_bar(spark):
    bars = queries.QUERIES["price_daily"](t := Tables(spark, "/root/testdata/sf0.001")).select("ticker", "date")
    rows = queries.QUERIES["wilder_atr_adx"](t).select("ticker", "date")
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, bars.collect()))


def test_wilder_recursion_by_hand():
    r = np.random.default_rng(3)
    c = 100 + r.normal(size=60).cumsum()
    h, low = c + r.random(60), c - r.random(60)
    tr = [max(h[i] - low[i], abs(h[i] - c[i - 1]), abs(low[i] - c[i - 1])) for i in range(1, 60)][-40:]
    x = sum(tr[:14]) / 14
    for v in tr[14:]:
        x = (x * 13 + v) / 14
    assert wilder_arrays(h, low, c, 40, 14)[0][-1] == pytest.approx(x / c[-1])


def test_small_rules(spark):
    assert [tuple(slot_quota(n).values()) for n in (4, 6, 8, 12)] == [(1, 1, 2), (1, 2, 3), (2, 3, 3), (3, 4, 5)]
    df = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], []), (None, ["a"])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(jaccard(F.col("a"), F.col("b"))).collect()] == [pytest.approx(1 / 3), None, None]
    assert spark.createDataFrame([("x" * 8,)], "t string").select(token_estimate(F.col("t"))).first()[0] == 3


def test_fnv_vectors(spark):
    texts = ["", "a", "foobar", None, "2024-01-30T7", "é漢🙂", "x" * 300]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [(r.h.high << 32) + r.h.low for r in df.select(news.fnv1a64(F.col("t")).alias("h")).collect()]
    want = []
    for t in texts:
        h = 0xCBF29CE484222325
        for b in (t or "").encode():
            h = (h ^ b) * 0x100000001B3 % (1 << 64)
        want.append(h)
    assert got == want and want[:3] == [0xCBF29CE484222325, 0xAF63DC4C8601EC8C, 0x85944171F73967E8]
    plan = news.rotate(spark.createDataFrame([(D(2020, 1, 1), "A")], "date date, ticker string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_filing_dates_and_leak(spark):
    rows = [("A", D(2020, 3, 31), D(2020, 5, 1)), ("A", D(2020, 6, 30), None), ("A", D(2020, 9, 30), D(2020, 9, 30)), ("A", D(2020, 12, 31), D(2020, 12, 1)), ("B", D(2020, 3, 31), None)]
    out = filings.resolve_filing_dates(spark.createDataFrame(rows, "ticker string, period_end date, filing_date date")).orderBy("ticker", "period_end").collect()
    assert [r.filing_date_unknown_reason for r in out] == ["none", "null", "equal", "negative", "null"]
    assert [r.filing_date_effective for r in out] == [D(2020, 5, 1), D(2020, 7, 31), D(2020, 10, 31), D(2021, 1, 31), None]
    seen = filings.readable_at(spark.createDataFrame(out), "2020-07-30").collect()
    assert [r.period_end for r in seen] == [D(2020, 3, 31)]


def test_as_of_before_active(spark):
    s = spark.createDataFrame([("A", D(2020, 1, 5), "x", True), ("A", D(2020, 1, 12), None, False), ("B", D(2020, 1, 12), "y", True)], "ticker string, date date, sector string, is_active boolean")
    assert [r.ticker for r in asof.members_as_of(s, "2020-01-20").collect()] == ["B"]
    assert [r.ticker for r in asof.members_as_of(s, "2020-01-11").collect()] == ["A"]
    days = spark.createDataFrame([("A", D(2020, 1, d)) for d in (4, 5, 11, 30)] + [("C", D(2020, 1, 9))], "ticker string, date date")
    got = {(r.ticker, r.date.day): (r.sector, r.is_active) for r in asof.as_of_join(days, s, ["ticker"], ["sector", "is_active"]).collect()}
    assert got == {("A", 4): (None, None), ("A", 5): ("x", True), ("A", 11): ("x", True), ("A", 30): (None, False), ("C", 9): (None, None)}


def test_evaluation_dates(spark):
    assert universe.evaluation_dates(spark, "2021-01-04", "2026-08-12").count() == 292
    assert universe.evaluation_dates(spark, "2021-01-04", "2021-01-09").count() == 0


def test_insider_rules(spark):
    columns = "ticker string, filed_at date, transaction_date date, owner string, transaction_code string, acquired_or_disposed string, shares_amount double, price_per_share double, total_value double"
    rows = [
        ("A", D(2020, 5, 1), D(2020, 4, 28), "o1", "P", "A", 10.0, 2.0, None), ("A", D(2020, 5, 2), D(2020, 4, 29), "o2", "S", "D", 5.0, None, 7.0), ("A", D(2020, 5, 30), D(2020, 4, 30), "o3", "P", "A", 1.0, 1.0, None),
        ("A", D(2019, 1, 2), D(2019, 1, 1), "o9", "P", "A", 9.0, 9.0, None), ("B", D(2020, 5, 1), D(2020, 4, 30), None, "S", "D", 1.0, None, None), ("C", D(2019, 1, 1), D(2019, 1, 1), "o", "P", "A", 1.0, 1.0, None),
    ]
    days = spark.createDataFrame([(D(2020, 5, 10),)], "date date")
    got = {r.ticker: (r.insider_net_90d_usd, r.distinct_buyer_count) for r in flow.insider(spark.createDataFrame(rows, columns), days).collect()}
    assert got == {"A": (13.0, 1), "B": (None, 0), "C": (0.0, 0)}


def test_percentile_fallback_and_seam(spark):
    rows = [(D(2020, 1, d), f"T{k}", "large", "x" if k < 6 else ("y" if k < 8 else None), float(k // 2)) for d in (1, 2) for k in range(10)] + [(D(2020, 1, 1), "S", "small", "x", 1.0)]
    df = spark.createDataFrame(rows, "date date, ticker string, size_bucket string, sector string, m double")
    out = {(r.date.day, r.ticker): (r.m_pctile, r.m_scope) for r in percentile.percentiles(df, ["m"], 5).collect()}
    assert out[1, "T0"] == (0.0, "cell") and out[1, "T1"] == (0.0, "cell") and out[1, "T5"] == (80.0, "cell")
    assert out[1, "T7"][1] == "bucket" and out[1, "T9"] == (pytest.approx(800 / 9), "bucket") and out[1, "S"] == (None, "none")
    one = percentile.percentiles(df.filter("date = '2020-01-02'"), ["m"], 5)
    both = percentile.percentiles(df, ["m"], 5).filter("date = '2020-01-02'")
    assert one.exceptAll(both).count() == both.exceptAll(one).count() == 0


def test_screens(spark):
    text = json.dumps([{"metric": "a", "direction": "high", "weight": 3}, {"metric": "b", "direction": "low", "weight": 1}, {"metric": "f", "kind": "bonus", "points": 5}])
    s = screens.parse_screen("S", text, {"a", "b", "f"}, 1)
    df = spark.createDataFrame([(80.0, 40.0, True), (80.0, None, None), (None, None, True)], "a_pctile double, b_pctile double, f boolean")
    assert [r[0] for r in df.select(screens.composite(s)).collect()] == [80.0, 80.0, None]
    for bad in ('[{"metric":"z","direction":"high","weight":1}]', '[{"metric":"a","direction":"up","weight":1}]', '[{"metric":"a","direction":"high","weight":0}]'):
        with pytest.raises(ValueError):
            screens.parse_screen("S", bad, {"a"}, 1)
    scored = spark.createDataFrame([("S", D(2020, 1, d), f"T{k}", float(10 * d + k)) for d in range(1, 6) for k in range(4)], "screen_id string, date date, ticker string, score float")
    f = {r.date.day: r.floor for r in screens.floors(scored, 3, 0.5).collect()}
    assert f == {1: None, 2: None, 3: 21.5, 4: 31.5, 5: 41.5}


def test_fewest_names_by_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = sorted({(D(2020, 1, int(d)), f"T{k}") for d, k in zip(rng.integers(1, 29, 80), rng.integers(0, 15, 80))})
    dates = sorted({d for d, _ in rows})
    expected = min(len({t for d, t in rows if d in dates[i - 4 : i + 1]}) for i in range(4, len(dates)))
    assert measure.fewest_names(spark.createDataFrame(rows, "date date, ticker string"), 5).first()[0] == expected


def test_upserts(spark):
    old = spark.createDataFrame([("A", 1, "x"), ("B", 2, "y")], "k string, v int, w string")
    new = spark.createDataFrame([("B", None), ("C", 3)], "k string, v int")
    once = writes.upsert(old, new, ["k"], ["v"])
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(once) == [("A", 1, "x"), ("B", None, "y"), ("C", 3, None)] == rows(writes.upsert(once, new, ["k"], ["v"]))
    assert rows(writes.insert_absent(old, spark.createDataFrame([("B", 9, "z"), ("D", 4, "d")], "k string, v int, w string"), ["k"])) == [("A", 1, "x"), ("B", 2, "y"), ("D", 4, "d")]
    with pytest.raises(ValueError):
        writes.upsert(old, new.drop("k"), ["k"], ["v"])


def _landed(spark, body, ticker="AAA.US", day=D(2020, 1, 2)):
    return spark.createDataFrame([(ticker, day, json.dumps(body))], "ticker string, request_date date, body string")


def test_flatten_prices(spark):
    bar = {"code": "AAA", "exchange_short_name": "US", "date": "2020-01-02", "open": 1.5, "high": 2, "low": "1", "close": 1.75, "adjusted_close": 1.75, "volume": 10.9}
    r = flatten.bulk_prices(_landed(spark, [bar])).collect()
    assert [(x.ticker, float(x.open), x.low, x.volume) for x in r] == [("AAA.US", 1.5, None, 10)]
    with pytest.raises(Exception, match="bad bar"):
        flatten.bulk_prices(_landed(spark, [{**bar, "date": "2020-01-03"}])).collect()
    for wrong in (7, "text", None, {**bar, "code": None}):
        with pytest.raises(Exception, match="bad bar"):
            flatten.bulk_prices(_landed(spark, [bar, wrong])).collect()
    for body in ({"a": 1}, "x", None):
        with pytest.raises(Exception, match="no array"):
            flatten.bulk_prices(_landed(spark, body)).collect()
    series = flatten.price_series(_landed(spark, [{**bar, "date": "2020-01-03"}, 7, None, bar])).collect()
    assert [x.date for x in series] == [D(2020, 1, 2), D(2020, 1, 3)]


def test_flatten_fundamentals(spark):
    body = {
        "General": {"Sector": "Tech"},
        "Financials": {"Balance_Sheet": {"quarterly": {"2020-03-31": {"filing_date": None, "totalAssets": "10.5"}, "bad": 3}}, "Income_Statement": {"quarterly": {"2020-03-31": {"filing_date": "2020-05-01", "totalRevenue": 7}}}, "Cash_Flow": {"quarterly": {"2020-06-30": {"filing_date": "2020-08-01", "capitalExpenditures": "x"}}}},
        "Earnings": {"History": {"a": {"date": "2020-03-31", "reportDate": "2020-05-01", "surprisePercent": 10}, "b": {"date": "2020-03-31", "reportDate": "2020-06-01", "surprisePercent": "-20"}, "c": {"date": "2020-03-31", "surprisePercent": 1}}},
        "Holders": {"Institutions": {"0": {"name": "H", "date": "2020-03-31", "currentShares": 5}, "1": {"name": "H", "date": "2020-03-31", "currentShares": 9}, "2": {"name": "H", "date": "2020-03-31"}, "3": "junk"}},
    }
    landed = _landed(spark, body)
    s = {r.period_end: r for r in flatten.statements(landed).collect()}
    assert s[D(2020, 3, 31)].filing_date == D(2020, 5, 1) and float(s[D(2020, 3, 31)].total_assets) == 10.5 and float(s[D(2020, 3, 31)].total_revenue) == 7
    assert s[D(2020, 6, 30)].capex is None
    e = flatten.earnings(landed).collect()
    assert [(r.report_date, round(r.surprise_fraction, 6), r.collisions) for r in e] == [(D(2020, 6, 1), -0.2, 2)]
    assert [float(r.shares) for r in flatten.holders(landed).collect()] == [9.0]
    assert flatten.sector(landed).first().sector == "Tech"


def test_flatten_others(spark):
    filing = {"accession_number": "n", "filed_at": "2020-01-05T10:00:00Z", "non_derivative": [3, {"transaction_code": "P", "shares_amount": "4", "transaction_date": "2020-01-03"}], "derivative": [{"transaction_code": " "}]}
    got = {(r.transaction_side, r.transaction_ordinal): (r.transaction_code, r.filed_at) for r in flatten.insiders(_landed(spark, [filing, "x"])).collect()}
    assert got == {("non_derivative", 1): ("P", D(2020, 1, 5)), ("derivative", 0): (None, D(2020, 1, 5))}
    assert [(r.ticker, r.article_count) for r in flatten.sentiment(_landed(spark, {"A.US": [{"date": "2020-01-01", "count": 3, "normalized": 0.5}, 1], "B.US": "no"})).collect()] == [("A.US", 3)]
    inside = spark.createDataFrame([("A.US",)], "ticker string")
    assert flatten.earnings_calendar(_landed(spark, {"earnings": [{"code": "A.US", "report_date": "2020-02-01"}, {"code": "Z.US", "report_date": "2020-02-01"}, {"code": "A.US"}, 5]}), inside).count() == 1
    one = flatten.bulk_actions(_landed(spark, [{"code": "A", "exchange": "US", "date": "2020-02-01", "declarationDate": "2020-01-20"}]), inside, "dividend_ex")
    two = flatten.ticker_actions(_landed(spark, [{"date": "2020-02-01"}], "A.US"), "dividend_ex")
    assert [r.announced_date for r in flatten.merge_events(one, two).collect()] == [D(2020, 1, 20)]
    assert flatten.symbols(_landed(spark, [{"Code": "A", "Type": "Common Stock"}, {"Code": "F", "Type": "Fund", "Name": "f"}])).collect()[0].ticker == "A.US"
    twice = [{"Code": "A", "Type": "Common Stock", "Name": "old"}, {"Type": "Common Stock", "Name": "no code"}, {"Code": "A", "Type": "Common Stock", "Name": "new"}]
    assert [tuple(x) for x in flatten.symbols(_landed(spark, twice)).collect()] == [("A.US", "new")]
    with pytest.raises(ValueError):
        flatten.symbols(_landed(spark, []))
    for hours in ({}, {"WorkingDays": " , "}):
        with pytest.raises(Exception, match="no working days"):
            flatten.exchange_sessions(_landed(spark, {"TradingHours": hours}), "2019-12-30", "2020-01-05").collect()
    calendar = _landed(spark, {"TradingHours": {"WorkingDays": "Mon,Tue,Wed,Thu,Fri"}, "ExchangeHolidays": {"0": {"Date": "2020-01-01"}}})
    days = flatten.exchange_sessions(calendar, "2019-12-30", "2020-01-05")
    assert sorted(r.date.day for r in days.collect()) == [2, 3, 30, 31]
    assert flatten.most_recent_session(days, "2020-01-05").first()[0] == D(2020, 1, 3)


def test_gates_reasons_and_state(spark):
    """All five reasons in their fixed order; a date without bars halts everybody; the state belongs to the date."""
    days = [D(2020, 1, d) for d in (2, 3, 6, 7)]
    members = spark.createDataFrame([(d, t) for d in days for t in ("A", "B")], "date date, ticker string")
    bars = [("A", D(2020, 1, 2), 10.0, 10.0, 5), ("A", D(2020, 1, 3), 12.0, 12.0, 0), ("B", D(2020, 1, 2), 10.0, 10.0, 5), ("B", D(2020, 1, 3), 10.0, 10.0, 5), ("A", D(2020, 1, 7), 12.0, 12.0, 9), ("B", D(2020, 1, 7), 10.0, 10.0, None)]
    prices = spark.createDataFrame(bars, "ticker string, date date, open double, close double, volume long")
    calendar = spark.createDataFrame([("A", "earnings", D(2020, 1, 5)), ("B", "split", D(2020, 1, 3))], "ticker string, event_type string, event_date date")
    positions = spark.createDataFrame([("A", D(2020, 1, 3), None), ("B", D(2020, 1, 3), D(2020, 1, 6))], "ticker string, opened date, closed date")
    outcomes = spark.createDataFrame([("A", D(2020, 1, 1))], "ticker string, exit_date date")
    got = {(r.date.day, r.ticker): (r.reasons, r.passed, r.state) for r in selection.gates(members, prices, calendar, positions, outcomes, cooldown=4).collect()}
    assert got[3, "A"] == (["earnings_blackout", "gap", "halt", "already_held", "cooldown"], False, "passed")
    assert got[3, "B"] == (["already_held"], False, "passed")
    assert got[2, "B"] == ([], True, "passed_partial")  # nothing is held on that date: that reason could not fire
    assert got[6, "B"] == (["halt"], False, "passed_partial") and "halt" in got[6, "A"][0]
    assert got[7, "A"] == (["earnings_blackout", "already_held"], False, "passed_partial") and got[7, "B"][0] == ["halt"]
    none = positions.limit(0)
    assert {r.state for r in selection.gates(members, prices, calendar, none, outcomes).collect()} == {"passed_partial"}


def test_digest_outcomes(spark):
    rows = [(False, None), (None, "x"), (True, None), (True, "NO MATERIAL NEWS"), (True, "no material news"), (True, "NO MATERIAL NEWS."), (True, "")]
    out = news.outcome(spark.createDataFrame(rows, "digest_exists boolean, digest string")).collect()
    assert [r.outcome for r in out] == ["no_row", "no_row", "no_articles", "no_material_news", "prose", "prose", "prose"]


def test_token_cost_by_model(spark):
    rates = spark.createDataFrame([('{"m": {"input": 2.0, "output": 8.0}}',)], "value string")
    usage = spark.createDataFrame([("m", "input", 500_000), ("m", "output", None)], "model string, kind string, tokens long")
    assert sorted(r.cost for r in news.token_cost(usage, rates).collect()) == [0.0, 1.0]
    for row in (("x", "input", 1), ("m", "cache", 1)):
        with pytest.raises(Exception, match="no rate for"):
            news.token_cost(spark.createDataFrame([row], "model string, kind string, tokens long"), rates).collect()


def test_range_members_by_brute_force(spark):
    r = np.random.default_rng(6)
    epochs = [D(2020, 1, 5), D(2020, 1, 12), D(2020, 1, 19)]
    rows = [(f"T{k}", d, bool(r.random() < 0.6)) for k in range(12) for d in epochs if r.random() < 0.7]
    s = spark.createDataFrame([(t, d, "x", "large", 1.0, a) for t, d, a in rows], "ticker string, date date, sector string, size_bucket string, market_cap double, is_active boolean")
    days = [D(2020, 1, d) for d in range(1, 29)]
    expected = set()
    for d in days:
        for t in {t for t, _, _ in rows}:
            seen = [(e, a) for u, e, a in rows if u == t and e <= d]
            if seen and max(seen)[1]:
                expected.add((d, t))
    got = asof.range_members(s, spark.createDataFrame([(d,) for d in days], "date date"))
    assert {(x.date, x.ticker) for x in got.collect()} == expected


def test_floors_by_brute_force(spark):
    r = np.random.default_rng(7)
    rows = [("S", D(2020, 1, 1) + dt.timedelta(int(d)), f"T{k}", None if r.random() < 0.1 else float(np.float32(r.choice([50.0, r.normal(50, 20)])))) for d in range(25) for k in range(int(r.integers(0, 9)))]
    scored = spark.createDataFrame(rows, "screen_id string, date date, ticker string, score float")
    dates = sorted({d for _, d, _, s in rows if s is not None})
    for lookback, q in ((5, 0.98), (7, 0.5), (3, 0.0), (4, 1.0)):
        got = {x.date: x.floor for x in screens.floors(scored, lookback, q).collect()}
        assert sorted(got) == dates
        for i, d in enumerate(dates):
            if i + 1 < lookback:
                assert got[d] is None
            else:
                own = [s for _, e, _, s in rows if s is not None and dates[i - lookback + 1] <= e <= d]
                assert got[d] == pytest.approx(np.quantile(own, q))


def test_percentile_registry_shares_one_pass(spark):
    assert sum(len(m) for m in percentile.REGISTRY.values()) == 30
    r = np.random.default_rng(8)
    rows = [(D(2020, 1, 1), f"T{k}", ["large", "small", None][k % 3], ["x", "y", None][k % 4 % 3], float(r.integers(0, 6)), None if k % 5 == 0 else float(k)) for k in range(60)]
    df = spark.createDataFrame(rows, "date date, ticker string, size_bucket string, sector string, a double, b double")
    got = {(x.ticker, x.metric): (x.pctile, x.scope) for x in percentile.long_percentiles(df, ["a", "b"], 6).collect()}
    for _, t, size, sector, *values in rows:
        for m, name in enumerate("ab"):
            if values[m] is None:
                assert (t, name) not in got
                continue
            cell = [x[4 + m] for x in rows if x[2] == size and x[3] == sector and x[4 + m] is not None]
            bucket = [x[4 + m] for x in rows if x[2] == size and x[4 + m] is not None]
            scope = None if size is None else "cell" if sector is not None and len(cell) >= 6 else "bucket" if len(bucket) >= 6 else "none"
            of = {"cell": cell, "bucket": bucket}.get(scope)
            assert got[t, name] == (pytest.approx(100 * sum(v < values[m] for v in of) / (len(of) - 1)) if of else None, scope)


def test_own_history_by_brute_force(spark):
    r = np.random.default_rng(9)
    start, rows = D(2013, 1, 1), []
    for k in range(2):
        d = start
        while d < D(2019, 12, 31):
            d += dt.timedelta(int(r.integers(1, 25)))
            rows.append((f"T{k}", d, round(float(r.uniform(50, 150)), 2)))
    prices = spark.createDataFrame(rows, "ticker string, date date, close double")
    basics = spark.createDataFrame([(f"T{k}", D(2012, 1, 1), 8, 10.0, 1.0, 0.0, 0.0, 0.0) for k in range(2)], "ticker string, at date, periods long, ttm_ebit double, shares double, net_debt double, ttm_cash double, ttm_capex double")
    got = {(x.ticker, x.date): x.ev_ebit_vs_own_5y for x in valuation.own_history(prices, basics, prices.select("ticker", "date"), 6).collect()}
    ends = {}
    for t, d, c in rows:
        ends[t, d.year, d.month] = max(ends.get((t, d.year, d.month), (d, c)), (d, c))
    for t, d, c in rows:
        edge = dt.date(d.year - 5, d.month, 28 if (d.month, d.day) == (2, 29) else d.day)
        own = [x / 10 for (u, _, _), (e, x) in ends.items() if u == t and edge <= e < d]
        assert got[t, d] == (pytest.approx(c / 10 / np.median(own)) if len(own) >= 6 else None)


def test_halt_on_fault(spark):
    floor = spark.createDataFrame([("S1", D(2020, 1, 1), 1.0), ("S2", D(2020, 1, 2), 1.0), ("S1", D(2020, 1, 3), None)], "screen_id string, date date, floor double")
    states = spark.createDataFrame([("S1", "live"), ("S2", "shadow")], "screen_id string, state string")
    ranked = spark.createDataFrame([("S2", D(2020, 1, 1))], "screen_id string, date date")
    assert [r.date for r in screens.unranked_dates(floor, ranked, states).collect()] == [D(2020, 1, 1)]
    with pytest.raises(ValueError, match="2020-01-01"):
        screens.halt_on_fault(floor, ranked, states)
    # S2 is live on its second day, so that it has a floor of its own and ranks nothing; S1 is retired from then on
    by_date = spark.createDataFrame([("S1", D(2020, 1, 1), "live"), ("S2", D(2020, 1, 1), "shadow"), ("S1", D(2020, 1, 2), "retired"), ("S2", D(2020, 1, 2), "live")], "screen_id string, date date, state string")
    assert sorted(r.date for r in screens.unranked_dates(floor, ranked, by_date).collect()) == [D(2020, 1, 1), D(2020, 1, 2)]
    again = ranked.union(spark.createDataFrame([("S1", D(2020, 1, 2)), ("S1", D(2020, 1, 1))], "screen_id string, date date"))
    assert [r.date for r in screens.unranked_dates(floor, again, by_date).collect()] == [D(2020, 1, 2)]  # what a retired screen ranks does not count
    screens.halt_on_fault(floor, ranked.unionByName(spark.createDataFrame([("S1", D(2020, 1, 1))], "screen_id string, date date")), states)
    with pytest.raises(ValueError, match="stands already"):
        selection.refuse_standing(ranked, "2020-01-01", "2020-01-31")
    selection.refuse_standing(ranked, "2021-01-01", "2021-01-31")


def test_range_equals_one_night(spark):
    """What a range gives for a date is what one night gives that knows nothing later."""
    t = Tables(spark, "/root/testdata/sf0.001")
    day = "1999-09-20"
    known = lambda df: df.filter(F.col("date") <= F.lit(day).cast("date"))
    prices = known(t.prices())
    members = asof.range_members(known(t.security_daily()), asof.sessions(prices, day, day))
    names = [*queries.METRICS, "base_breakout_flag"]
    night = technical.carry_forward(members, technical.indicators(prices, known(t.benchmark_daily())), names)
    night = screens.scores(percentile.percentiles(night, queries.METRICS, queries.FLOOR), [queries.S1, queries.S2])
    whole = queries._scored(t)
    same = whole.filter(F.col("date") == F.lit(day).cast("date"))
    assert night.count() == same.count() > 0
    assert night.exceptAll(same).count() == same.exceptAll(night).count() == 0
    floor = screens.floors(known(whole), 20, 0.7).filter(F.col("date") == F.lit(day).cast("date"))
    later = screens.floors(whole, 20, 0.7).filter(F.col("date") == F.lit(day).cast("date"))
    assert sorted(map(tuple, floor.collect())) == sorted(map(tuple, later.collect()))


def test_news_keeps_blank_and_very_long_texts(spark):
    rows = [(2, "", "", ""), (3, "  ", " ", "\n"), (4, None, None, None), (5, "a", "b", "x" * 20_000_001), (6, "a", "b", 'q"\\\0')]
    article = spark.createDataFrame([("T1", D(2024, 1, d), *x) for d, *x in rows], "ticker string, published_at date, title string, source string, content string")
    got = flatten.news(landing.news(article)).select(F.dayofmonth("published_at"), "title", "url", F.md5("content")).collect()
    md5 = lambda x: None if x is None else hashlib.md5(x.encode()).hexdigest()
    assert sorted(map(tuple, got)) == [(d - 1, title, link, md5(content)) for d, title, link, content in rows]  # instants are of the evening before, in UTC
