"""Steps that large tables failed on: what they move, and that cheaper ways give the rows of the plain ones."""

import datetime
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pitframe import queries
from pitframe.functions.series import change, full, normalised_slope, whole_keys
from pitframe.operators import percentile, screens, technical
from pitframe.sources.adapters import Tables

DAYS = [datetime.date(2020, 1, 1) + datetime.timedelta(i) for i in range(12)]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def names(spark):
    r = random.Random(5)
    value = lambda: r.choice([None, float("nan"), float("inf"), -0.0, 0.0, 1e300, *(r.uniform(-3, 3) for _ in range(6)), *map(float, range(4))])
    rows = [(d, f"T{k}", r.choice(["large", "mid", None]), r.choice(["x", "y", "z", None]), value(), value(), r.randrange(9)) for d in DAYS for k in range(60)]
    return spark.createDataFrame(rows, "date date, ticker string, size_bucket string, sector string, a double, b double, i int")


def test_percentiles_equal_those_one_row_a_metric_and_move_rows_once(spark, names):
    wide = percentile.percentiles(names, ["a", "b", "i"], 4)
    assert plan_of(wide).count("Exchange hashpartitioning") == 1 and "Join" not in plan_of(wide)
    got = {(r.date, r.ticker, m): (r[f"{m}_pctile"], r[f"{m}_scope"]) for r in wide.collect() for m in ("a", "b", "i")}
    want = {(r.date, r.ticker, r.metric): (r.pctile, r.scope) for r in percentile.long_percentiles(names, ["a", "b", "i"], 4).collect()}
    assert {k: v for k, v in got.items() if v != (None, None)} == {k: v for k, v in want.items() if v != (None, None)} and len(want) > 1000


def test_dates_stay_whole(spark):
    days = np.repeat(np.arange(7), [1, 9, 30, 2, 40, 1, 5]).astype(np.int32)
    batches = [pa.RecordBatch.from_arrays([pa.array(days[i : i + 4], pa.date32())], ["date"]) for i in range(0, len(days), 4)]
    got = [np.concatenate([b["date"].cast(pa.int32()).to_numpy() for b in chunk]) for chunk in whole_keys(iter(batches), "date", 12)]
    assert np.array_equal(np.concatenate(got), days) and len(got) > 3
    assert all(a[-1] != b[0] for a, b in zip(got, got[1:]))


def test_scores_are_plain_arithmetic(spark, names):
    ranked = percentile.percentiles(names.drop("i"), ["a", "b"], 4).withColumn("f", F.lit(True))
    part = "array<struct<metric:string,kind:string,direction:string,weight:double,points:double>>"
    on = spark.createDataFrame([(d, "S1", 1, [("a", None, "high", 2.0, None), ("b", None, "low", 1.0, None), ("f", "bonus", None, None, 5.0)]) for d in DAYS], f"date date, screen_id string, min_inputs int, parts {part}")
    out = screens.scores_on(ranked, on, ["a", "b"], ["f"])
    assert "lambda" not in plan_of(out) and "map(" not in plan_of(out)  # evaluated row by row outside of generated code
    one = {(r.date, r.ticker): r for r in ranked.collect()}
    for r in out.collect():
        x = one[r.date, r.ticker]
        held = [(v, w) for v, w in ((x.a_pctile, 2.0), (None if x.b_pctile is None else 100 - x.b_pctile, 1.0)) if v is not None]
        want = np.float32(sum(v * w for v, w in held) / sum(w for _, w in held) + 5.0) if held else None
        assert (r.score is None) if want is None else r.score == want


def test_floors_read_single_scores_only_near_the_quantile(spark):
    r = random.Random(2)
    rows = [("S1", d, f"T{k}", "mid", r.random() * 100) for d in DAYS for k in range(300)]
    scored = spark.createDataFrame(rows, "screen_id string, date date, ticker string, size_bucket string, score float")
    floors = screens.floors(scored, 3, 0.7)
    for x in floors.collect():
        i = DAYS.index(x.date)
        seen = [np.float32(s[4]) for s in rows if s[1] in DAYS[max(0, i - 2) : i + 1]]
        assert x.floor is None if i < 2 else x.floor == pytest.approx(np.quantile(np.array(seen, float), 0.7), abs=1e-9)
    assert "BroadcastHashJoin" in plan_of(floors)


def test_passing_gates_are_those_of_all_that_pass(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    key = lambda df: sorted(map(tuple, df.select("date", "ticker", "passed", "state").collect()))
    few = queries._gates(t, passing=True)
    assert key(few) == key(queries._gate(t).filter("passed")) and few.count()


def test_pairs_rank_their_own_dates_only(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    rows = queries._percentiles(queries._of_pairs(t))
    assert rows.select("date").distinct().count() == queries._pairs(t).select("date").distinct().count() < 40
    assert "ranked" not in t.kept and "features" not in t.kept


def test_indicators_are_those_of_windows_to_the_last_bit(spark):
    r = random.Random(8)
    some = lambda x, p=0.01: None if r.random() < p else x
    rows = [(f"T{k}", datetime.date(2020, 1, 1) + datetime.timedelta(i), *(some(100 + r.random(), p) for p in (0.001, 0.0005, 0.0005, 0.001)), some(r.randrange(0, 900))) for k, n in ((1, 700), (2, 30), (3, 450)) for i in range(n)]
    bars = spark.createDataFrame(rows, "ticker string, date date, close double, adj_close double, high double, low double, volume long")
    benchmark = bars.groupBy("date").agg(F.avg("adj_close").alias("adj_close")).filter("dayofyear(date) % 50 <> 0")
    by, c = technical.bars_of_ticker(), F.col("c")
    a = technical.adjusted(bars).join(benchmark.withColumnRenamed("adj_close", "b"), "date", "left")
    a = a.withColumns({**{f"ma{n}": full(F.avg, c, by, n) for n in (20, 50, 200)}, "top": full(F.max, F.col("h"), by, 252), "v50": full(F.avg, F.col("v"), by, 50), "hi": full(F.max, F.col("h"), by, 60, -1), "lo": full(F.min, F.col("l"), by, 60, -1), "ratio": F.try_divide(c, F.col("b"))})
    a = a.withColumns({"far": F.try_divide(c - F.col("top"), F.col("top")), "x": F.try_divide(F.col("ma50"), F.col("ma200"))})
    want = {
        "dist_20dma": F.try_divide(c - F.col("ma20"), F.col("ma20")), "dist_200dma": F.try_divide(c - F.col("ma200"), F.col("ma200")), "dist_52w_high": F.col("far"), "volume_vs_50d_avg": F.try_divide(F.col("v"), F.col("v50")),
        "dist_52w_high_20d_change": F.col("far") - F.lag("far", 20).over(by), "ma50_200_slope": normalised_slope(F.col("x"), F.col("bar"), by, 20), "base_breakout_flag": F.when(F.col("lo") > 0, (F.col("hi") - F.col("lo") <= 0.25 * F.col("lo")) & (c > F.col("hi"))),
        "rs_change_21d": change(F.col("ratio"), by, 21), "rs_change_63d": change(F.col("ratio"), by, 63), "rs_20d_slope": normalised_slope(F.col("ratio"), F.col("bar"), by, 20),
    }
    plain = technical.median_dollar_volume(a.withColumns({f"{k}": v for k, v in want.items()})).withColumn("rs_21d_63d_change", F.col("rs_change_21d") - F.col("rs_change_63d"))
    names = sorted(technical.WINDOWS)
    key = lambda df: {(x.ticker, x.date): tuple(x[n] for n in names) for x in df.collect()}
    got, expected = key(technical.indicators(bars, benchmark)), key(plain)
    assert got == expected and all(sum(x[i] is not None for x in got.values()) > 50 for i in range(len(names)))
    few = technical.indicators(bars, benchmark, only=["dist_200dma"])
    assert few.columns == ["ticker", "date", "dist_200dma"] and plan_of(few).count("Window") < 4


def test_summary_is_that_of_one_row_a_metric(spark, names):
    floor, rows = 5, names.filter("ticker < 'T2' or dayofmonth(date) < 6")  # some buckets are too thin
    got = percentile.percentile_summary(rows, ["a", "b", "i"], floor)
    assert plan_of(got).count("Exchange hashpartitioning") == 1
    of = ["date", "size_bucket", "metric", "scope"]
    want = percentile.long_percentiles(rows, ["a", "b", "i"], floor).groupBy(*of).agg(F.count("*").alias("n"), F.avg("pctile").alias("mean"), F.avg(F.col("pctile") * F.col("pctile")).alias("mean_square"), F.max_by("ticker", F.struct("pctile", "ticker")).alias("first"))
    key = lambda df: {tuple(x[k] for k in of): (x.n, *(None if x[k] is None else round(x[k], 6) for k in ("mean", "mean_square")), x["first"]) for x in df.collect()}
    assert key(got) == key(want) and {k[3] for k in key(got)} == {"cell", "bucket", "none", None}
    assert got.columns == want.columns
