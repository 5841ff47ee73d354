"""One night over stored stages: its rows are those of the range, and it reads only its partitions."""

import datetime

import pytest
from pyspark.sql import functions as F

from pitframe import queries
from pitframe.operators import asof, flow, market, percentile, screens, sectors, sentiment, technical
from pitframe.plans.nightly import Night, trailing_bars
from pitframe.plans.stages import stage
from pitframe.plans.stored import Stored
from pitframe.sources.adapters import Tables

MINIMUM, FLOOR = 2, 2
SF = "/root/testdata/sf0.001"
NAMES = [m for m in percentile.REGISTRY["indicator_daily"] if m != "rs_change_vs_sector"]


def plain(df):
    return sorted((str(tuple(round(v, 9) if isinstance(v, float) else v for v in r)) for r in df.select(*sorted(df.columns)).collect()))


@pytest.fixture(scope="module")
def t(spark):
    return Tables(spark, SF)


@pytest.fixture(scope="module")
def stored(spark, t, tmp_path_factory):
    root = tmp_path_factory.mktemp("stored")

    def put(name, rows, grain="month"):
        table = Stored(spark, str(root / name), rows.schema, grain)
        table.write(rows)
        return table

    return root, put


def test_a_night_equals_the_range(spark, t, stored):
    root, put = stored
    prices, security, benchmark = put("price_daily", t.prices()), t.keep("security", t.security_daily), t.benchmark_daily()
    day = "2000-05-15"
    members = asof.range_members(security, asof.sessions(t.prices(), "2000-04-01", "2000-05-31"))
    filings, holdings, daily = queries._then(t.insider_transaction(), "filed_at", "transaction_date"), t.institutional_holding(), t.sentiment_daily().withColumn("date", F.date_sub("date", 8630))
    benchmark, filings, holdings, daily, members = (stage(x, "given") for x in (benchmark, filings, holdings, daily, members))
    bars = technical.indicators(t.prices(), benchmark).join(technical.wilder(t.prices()), ["ticker", "date"])
    composite = sectors.sector_composite(t.prices(), security, MINIMUM)
    whole = {"indicator_daily": technical.carry_forward(members, bars, [*NAMES, "base_breakout_flag"]).join(sectors.relative_to_sector(t.prices(), security, members, composite), ["ticker", "date"], "left")}
    whole["indicator_daily"] = stage(whole["indicator_daily"], "range")
    whole["flow_daily"] = flow.flow(filings, holdings, members.select("date").distinct())
    whole["sentiment_derived_daily"] = sentiment.sentiment(daily, members, min_days=3)
    whole["market_context_daily"] = market.market_context(whole["indicator_daily"], benchmark, sectors.sector_strength(t.prices(), security, members.select("date").distinct(), MINIMUM))
    whole["percentile_daily"] = stage(percentile.percentiles(whole["indicator_daily"], queries.METRICS, FLOOR), "range")
    on = queries._screens(t)
    whole["screen_score_daily"] = screens.scores_on(whole["percentile_daily"], on, queries.METRICS, ["base_breakout_flag"])
    whole = {name: stage(rows, "range") for name, rows in whole.items()}
    before = F.col("date") < F.lit(day).cast("date")
    night = Night(day, prices, security, {name: put(name, rows.filter(before)) for name, rows in whole.items()})
    night.indicators(benchmark, MINIMUM)
    night.flow(filings, holdings)
    night.sentiment(put("sentiment_daily", daily), 3)
    night.market(benchmark, MINIMUM)
    night.percentiles(queries.METRICS, FLOOR)
    night.scores(on, queries.METRICS, ["base_breakout_flag"])
    one = F.col("date") == F.lit(day).cast("date")
    for name, rows in whole.items():
        assert plain(night.of(name)) == plain(rows.filter(one).select(*night.stages[name].schema.fieldNames())), name
        assert not night.of(name).isEmpty()
    floors = screens.floors(whole["screen_score_daily"], 20, 0.7).filter(one)
    assert plain(night.floors(20, 0.7, 60)) == plain(floors) and floors.filter("floor is not null").count()
    again = plain(night.of("percentile_daily"))
    night.percentiles(queries.METRICS, FLOOR)
    assert plain(night.of("percentile_daily")) == again  # the same night twice


def test_a_night_reads_its_partitions(spark, stored):
    """Dense names come from the look-back alone; the one with too few bars there brings its own history, and no other name's."""
    _, put = stored
    days = [datetime.date(2018, 1, 1) + datetime.timedelta(i) for i in range(900)]
    rows = [(k, d, float(i)) for i, d in enumerate(days) for k in ("A", "B")] + [("S", d, 1.0) for d in days[::9]] + [("Q", d, 2.0) for d in days[:40]]
    table = put("some", spark.createDataFrame(rows, "ticker string, date date, close double"))
    got = trailing_bars(table, "2020-03-01", 300, 365)
    seen = {r.ticker: (r.a, r.n) for r in got.groupBy("ticker").agg(F.min("date").alias("a"), F.count("*").alias("n")).collect()}
    assert seen["A"] == seen["B"] == (datetime.date(2019, 3, 2), 366) and seen["S"] == (days[0], len([d for d in days[::9] if d <= datetime.date(2020, 3, 1)]))
    assert seen["Q"] == (days[0], 40)  # silent for the whole look-back, but its last bar is still carried forward
    parts = {r.f.split("part=")[1].split("/")[0] for r in table.look_back("2020-03-01", 31).select(F.input_file_name().alias("f")).distinct().collect()}
    assert parts == {"2020-01", "2020-02", "2020-03"}
