"""Keyed writes on stored tables: what they touch, what a second write and a dying job leave (A16-A19), and the repaired rules beside them."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from pitframe.operators import asof, flow, universe
from pitframe.plans import upsert as writes
from pitframe.plans.stored import Stored

D = datetime.date
ROWS = "ticker string, date date, v int, w string"


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def table_of(spark, path, grain="day"):
    old = spark.createDataFrame([(t, D(2020, m, d), 10 * m + d, "x") for t in "AB" for m in (1, 2) for d in (1, 2, 3)], ROWS)
    table = Stored(spark, str(path), old.schema, grain)
    table.write(old)
    return table, rows(old)


@pytest.mark.parametrize("grain", ["day", "month"])
def test_writes_touch_only_their_partitions(spark, tmp_path, grain):
    table, old = table_of(spark, tmp_path / "t", grain)
    assert rows(table.read()) == old
    before = files(table.path)
    new = spark.createDataFrame([("A", D(2020, 1, 2), None), ("C", D(2020, 1, 2), 7)], "ticker string, date date, v int")
    part = "2020-01-02" if grain == "day" else "2020-01"
    assert table.upsert(new, ["ticker", "date"], ["v"]) == [part]
    once = rows(table.read())
    assert once == sorted([("A", D(2020, 1, 2), None, "x") if r[:2] == ("A", D(2020, 1, 2)) else r for r in old] + [("C", D(2020, 1, 2), 7, None)], key=str)
    kept = {f: t for f, t in before.items() if f"part={part}/" not in f}
    assert kept.items() <= files(table.path).items() and kept
    table.upsert(new, ["ticker", "date"], ["v"])
    assert rows(table.read()) == once  # a second write changes nothing
    value = spark.createDataFrame([("A", D(2020, 2, 1), 99), ("Z", D(2020, 2, 1), 5)], "ticker string, date date, v int")
    table.update(value, ["ticker", "date"])
    changed = rows(table.read())
    assert set(changed) ^ set(once) == {("A", D(2020, 2, 1), 21, "x"), ("A", D(2020, 2, 1), 99, "x")}  # others of that date keep theirs, nothing comes
    table.insert(spark.createDataFrame([("A", D(2020, 2, 1), 0, "no"), ("E", D(2021, 5, 5), 1, "new")], ROWS), ["ticker", "date"])
    assert set(rows(table.read())) ^ set(changed) == {("E", D(2021, 5, 5), 1, "new")}
    days = spark.createDataFrame([(D(2021, 5, 5),), (D(2020, 1, 3),), (D(2020, 1, 1),)], "date date")
    table.replace(spark.createDataFrame([("F", D(2020, 1, 3), 3, "f")], ROWS), days)
    left = rows(table.read())
    assert {r for r in left if r[1] in (D(2021, 5, 5), D(2020, 1, 1), D(2020, 1, 3))} == {("F", D(2020, 1, 3), 3, "f")}
    assert len([r for r in left if r[1] == D(2020, 1, 2)]) == 3


def test_a_job_that_dies_leaves_the_old_rows(spark, tmp_path):
    table, old = table_of(spark, tmp_path / "t")
    before = files(table.path)
    dying = table.read().withColumn("v", F.when(F.col("ticker") == "B", F.raise_error(F.lit("lost"))).otherwise(F.lit(0)).cast("int"))
    with pytest.raises(Exception, match="lost"):
        table.write(dying)
    with pytest.raises(Exception, match="lost"):
        table.upsert(dying, ["ticker", "date"], ["v", "w"])
    assert files(table.path) == before and rows(table.read()) == old


def test_refused_writes(spark, tmp_path):
    table, old = table_of(spark, tmp_path / "t")
    twice = spark.createDataFrame([("A", D(2020, 1, 1), 1), ("A", D(2020, 1, 1), 2)], "ticker string, date date, v int")
    with pytest.raises(ValueError, match="staged twice"):
        table.upsert(twice, ["ticker", "date"], ["v"])
    with pytest.raises(ValueError, match="need a date"):
        table.update(spark.createDataFrame([("A", None, 1)], "ticker string, date date, v int"), ["ticker", "date"])
    with pytest.raises(ValueError, match="another date"):
        table.replace(table.read(), spark.createDataFrame([(D(2020, 1, 1),)], "date date"))
    assert table.update(twice.limit(0), ["ticker", "date"]) == [] and rows(table.read()) == old
    assert rows(Stored(spark, str(tmp_path / "none"), table.schema).read()) == []


def test_one_night_reads_its_window_only(spark, tmp_path):
    table, old = table_of(spark, tmp_path / "t", "day")
    night = table.look_back("2020-02-02", 1)
    assert rows(night) == [r for r in old if D(2020, 2, 1) <= r[1] <= D(2020, 2, 2)]
    read = {r.f.split("part=")[1].split("/")[0] for r in night.select(F.input_file_name().alias("f")).collect()}
    assert read == {"2020-02-01", "2020-02-02"}
    plan = night._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan and "2020-02-01" in plan


def test_update_without_staged_key_keeps_the_value(spark):
    old = spark.createDataFrame([("A", 1), ("B", 2), ("C", 3)], "k string, v int")
    assert rows(writes.update_columns(old, spark.createDataFrame([("A", None), ("B", 9), ("D", 4)], "k string, v int"), ["k"])) == [("A", None), ("B", 9), ("C", 3)]


def test_an_unpriced_row_of_any_side_makes_the_sum_unknown(spark):
    columns = "ticker string, filed_at date, transaction_date date, owner string, transaction_code string, acquired_or_disposed string, shares_amount double, price_per_share double, total_value double"
    day = D(2020, 5, 1)
    filings = spark.createDataFrame([("A", day, day, "o", "P", None, 3.0, None, None), ("B", day, day, "o", "S", "X", 3.0, 2.0, None), ("C", day, day, "o", "M", None, 3.0, None, None)], columns)
    got = {r.ticker: r.insider_net_90d_usd for r in flow.insider(filings, spark.createDataFrame([(day,)], "date date")).collect()}
    assert got == {"A": None, "B": 0.0, "C": 0.0}


def test_reasons_of_names_without_fundamentals(spark):
    d = D(2020, 6, 1)
    prices = spark.createDataFrame([(t, d - datetime.timedelta(i), 50.0, 100_000) for t in "ABCDEF" for i in range(30)], "ticker string, date date, close double, volume long")
    filings = [(t, d - datetime.timedelta(60 + 90 * i), reason, shares) for t, reason, shares in (("A", "none", 1e8), ("B", "null", None), ("C", "null", 1e8), ("D", "none", 0.0), ("E", "none", None)) for i in range(5)]
    filings = spark.createDataFrame(filings, "ticker string, period_end date, filing_date_unknown_reason string, shares double").withColumns({"filing_date_effective": F.date_add("period_end", 30), "sector": F.lit("S")})
    listing, gone = spark.createDataFrame([(t,) for t in "ABCDEF"], "ticker string"), spark.createDataFrame([], "ticker string, delisted_on date")
    got = {r.ticker: r.criterion for r in universe.waterfall(prices, filings, listing, gone, str(d), history=20).collect()}
    assert got == {"A": None, "B": "no_fundamentals", "C": "below_clean_gaps", "D": "no_share_count", "E": "no_share_count", "F": "no_fundamentals"}


def test_last_bars_do_not_depend_on_the_days_looked_at_first(spark):
    """Dense, thin and long silent names, and one without closes, against sorted lists."""
    d = D(2020, 6, 1)
    step = {"A": (1, 0), "B": (5, 3), "C": (2, 300), "D": (40, 0), "E": (1, 44), "N": (1, 0)}
    held = {t: [(d - datetime.timedelta(back + every * i), None if t == "N" or i % 7 == 3 else 5.0 + (i * 37 + every) % 11, 1000 * (i % 13)) for i in range(-3, 60)] for t, (every, back) in step.items()}
    prices = spark.createDataFrame([(t, *x) for t, xs in held.items() for x in xs], "ticker string, date date, close double, volume long").withColumn("date_", F.lit("clash"))
    want = {}
    for t, xs in held.items():
        seen = sorted((x for x in xs if x[0] <= d), reverse=True)
        pairs = sorted(c * v for _, c, v in seen[:20] if c is not None)
        if pairs:
            n = len(pairs)
            want[t] = (next((c for x, c, _ in seen[:1]), None), (pairs[(n - 1) // 2] + pairs[n // 2]) / 2, seen[-1][0], seen[0][0], len(seen))
    for days in (0, 1, 45, 120, 5000):
        got = {r.ticker: (r.last_close, r.median_dollar_volume, r.first_seen, r.last_seen, r.bars) for r in universe.liquidity(prices, str(d), days=days).collect()}
        assert got == want, days
    assert universe.liquidity(prices.limit(0), str(d)).isEmpty()


def test_members_of_sessions_against_each_date_on_its_own(spark):
    """Epochs of some names only, names that leave and come back, sessions before, on and after epochs."""
    first = D(2020, 1, 5)
    epochs = [first + datetime.timedelta(7 * i) for i in range(9)]
    rows = [(t, e, f"S{(i + k) % 3}", "large", float(i), (i + k) % 4 != 0) for k, t in enumerate("ABCDE") for i, e in enumerate(epochs) if (i * 5 + k) % 3 != 1]
    security = spark.createDataFrame(rows, "ticker string, date date, sector string, size_bucket string, market_cap double, is_active boolean")
    days = [first + datetime.timedelta(i) for i in range(-4, 75, 3)]
    want = set()
    for day in days:
        for t in "ABCDE":
            last = max((r for r in rows if r[0] == t and r[1] <= day), key=lambda r: r[1], default=None)
            if last and last[5]:
                want.add((day, t, last[2], last[3], last[4]))
    got = asof.range_members(security, spark.createDataFrame([(x,) for x in days + days[:3]], "date date")).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert asof.range_members(security.limit(0), spark.createDataFrame([(first,)], "date date")).isEmpty()


def test_freshness_states(spark):
    bars = lambda counts: spark.createDataFrame([(f"T{k}", D(2020, 1, 1) + datetime.timedelta(i)) for i, n in enumerate(counts) for k in range(n)], "ticker string, date date")
    one = lambda counts, day, **more: tuple(universe.freshness(bars(counts), day, 3, 6, 0.9, more.get("window", 3)).first())
    assert one([5, 5, 5, 5], "2020-01-04") == ("fresh", D(2020, 1, 4), 5, True, False)
    assert one([9, 9, 9, 9, 4], "2020-01-05") == ("fresh", D(2020, 1, 4), 9, False, False)
    assert one([9, 9, 9, 2], "2020-01-04")[0] == "abort" and one([9, 9], "2020-01-03")[0] == "stale"
    assert one([9, 9], "2020-01-02") == ("fresh", D(2020, 1, 2), 9, False, True)  # too few dates before it to tell
    assert universe.freshness(bars([]), "2020-01-02").first().state == "no_data"


def test_rotation_counts(spark):
    pool = spark.createDataFrame([(t,) for t in "ABCDE"], "ticker string")
    attempts = spark.createDataFrame([("A", D(2020, 1, 1)), ("B", D(2019, 1, 1)), ("C", D(2020, 3, 1))], "ticker string, attempted_at date")
    none = pool.limit(0)
    chosen = universe.rotation(pool, attempts, none, none, 3)
    assert tuple(universe.rotation_counts(pool, attempts, chosen).first()) == (5, 2, 2, 1, D(2019, 1, 1))


def test_features_of_landed_filings_equal_those_of_the_tables(spark):
    from pitframe.sources import contract, flatten, landing
    from pitframe.sources.adapters import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    days = t.read("events").select(F.to_date("ts").alias("date")).distinct()
    landed = flatten.insiders(landing.insiders(t.insider_transaction()))
    assert rows(flow.insider(flow.with_owner(landed), days)) == rows(flow.insider(t.insider_transaction(), days))
    with pytest.raises(ValueError, match="reporting_owner_cik is missing; filed_at is string, not day|filed_at is string, not day; reporting_owner_cik is missing"):
        contract.conform(landed.drop("reporting_owner_cik").withColumn("filed_at", F.col("filed_at").cast("string")), "insider_transaction")
    assert contract.conform(t.sentiment_daily().withColumn("article_count", F.col("article_count").cast("int")), "sentiment_daily").dtypes[2:] == [("article_count", "int"), ("sentiment_score", "double")]
