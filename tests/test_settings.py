"""Settings that change within a range: versions as intervals, and every step that reads them."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from pitframe.functions.series import slot_quota
from pitframe.operators import asof, screens, selection, settings

D = datetime.date
CONFIG = "key string, version int, value string, set_at timestamp"
DAYS = [D(2020, 1, 1) + datetime.timedelta(i) for i in range(40)]


def config_of(spark, rows):
    return spark.createDataFrame([(k, v, x, datetime.datetime(2020, 1, 1, 17) + datetime.timedelta(d)) for k, v, x, d in rows], CONFIG)


@pytest.fixture(scope="module")
def days(spark):
    return spark.createDataFrame([(d,) for d in DAYS], "date date")


def test_intervals_give_what_each_date_resolves(spark, days):
    r = random.Random(3)
    for _ in range(3):
        rows = [(f"k{r.randrange(4)}", v, f"v{r.randrange(99)}", r.randrange(-3, 38)) for v in range(1, 12)]
        rows = list({(k, v): (k, v, x, d) for k, v, x, d in rows}.values())
        config = config_of(spark, rows)
        own = settings.versions(config).collect()
        got = {(d, i.key): (i.version, i.value) for d in DAYS for i in own if i.start <= d and (i.until is None or d < i.until)}
        assert len(got) == sum(i.start <= d and (i.until is None or d < i.until) for d in DAYS for i in own)  # intervals of a key are disjoint
        assert got == {(x.date, x.key): (x.version, x.value) for x in asof.params_on(config, days).collect()}


def test_a_date_without_a_setting_is_an_error(spark, days):
    config = config_of(spark, [("a", 1, "5", 10)])
    late = days.filter("date >= '2020-01-11'")
    assert {x.n for x in settings.on_dates(config, late, {"n": ("a", "int")}).collect()} == {5}
    with pytest.raises(Exception, match="no setting a on 2020-01"):
        settings.on_dates(config, days, {"n": ("a", "int")}).collect()


ONE = [{"metric": "a", "direction": "high", "weight": 3}, {"metric": "b", "direction": "low", "weight": 1}, {"metric": "f", "kind": "bonus", "points": 5}]
TWO = [{"metric": "b", "direction": "high", "weight": 1}]


def screen_config(spark, *more):
    rows = [("screens.S1.state", 1, "live", -1), ("screens.S1.metrics", 1, json.dumps(ONE), -1), ("screens.S1.min_inputs", 1, "1", -1), ("screens.S1.slots", 1, "4", -1)]
    rows += [("screens.S2.state", 1, "live", -1), ("screens.S2.metrics", 1, json.dumps(TWO), -1), ("screens.S2.min_inputs", 1, "1", -1), ("screens.S2.slots", 1, "5", -1), ("screens.floor_percentile", 1, "98", -1)]
    return config_of(spark, [*rows, *more])


def names(spark):
    r = random.Random(9)
    pct = lambda: None if r.random() < 0.2 else float(r.randrange(101))
    rows = [(d, f"T{k}", r.choice(["large", "mid", "small"]), pct(), pct(), r.choice([True, False, None])) for d in DAYS for k in range(12)]
    return spark.createDataFrame(rows, "date date, ticker string, size_bucket string, a_pctile double, b_pctile double, f boolean")


def test_scores_follow_the_definition_of_the_date(spark, days):
    ranked = names(spark)
    config = screen_config(spark, ("screens.S1.metrics", 2, json.dumps(TWO), 20), ("screens.S2.state", 2, "retired", 30))
    on = settings.screens_on(settings.check_screens(settings.screen_versions(config), {"a", "b", "f"}), days)
    got = {tuple(x)[:3]: x.score for x in screens.scores_on(ranked, on, ["a", "b"], ["f"]).collect()}
    first, later = (screens.parse_screen("S1", json.dumps(x), {"a", "b", "f"}, 1) for x in (ONE, TWO))
    other = screens.parse_screen("S2", json.dumps(TWO), {"b"}, 1)
    want = {tuple(x)[:3]: x.score for x in screens.scores(ranked.filter("date < '2020-01-21'"), [first]).unionByName(screens.scores(ranked.filter("date >= '2020-01-21'"), [later])).unionByName(screens.scores(ranked.filter("date < '2020-01-31'"), [other])).collect()}
    assert got == want


@pytest.mark.parametrize("row", [("screens.S1.min_inputs", 2, "3", 9), ("screens.S1.state", 2, "asleep", 9), ("screens.S1.metrics", 2, '[{"metric":"z","direction":"high","weight":1}]', 9), ("screens.S3.state", 1, "live", 9)])
def test_definitions_are_checked(spark, row):
    with pytest.raises(ValueError):
        settings.check_screens(settings.screen_versions(screen_config(spark, row)), {"a", "b", "f"})


def test_floors_read_lookback_and_quantile_of_the_date(spark, days):
    scored = screens.scores(names(spark), [screens.parse_screen("S1", json.dumps(ONE), {"a", "b", "f"}, 1)])
    config = config_of(spark, [("l", 1, "10", -1), ("l", 2, "6", 15), ("q", 1, "0.9", -1), ("q", 2, "0.5", 25)])
    own = settings.on_dates(config, days, {"lookback": ("l", "int"), "quantile": ("q", "double")})
    got = {x.date: x.floor for x in screens.floors(scored, settings=own).collect()}
    fixed = {(n, q): {x.date: x.floor for x in screens.floors(scored, n, q).collect()} for n, q in ((10, 0.9), (6, 0.9), (6, 0.5))}
    assert got == {d: fixed[10 if i < 15 else 6, 0.9 if i < 25 else 0.5][d] for i, d in enumerate(DAYS)}
    assert got[DAYS[8]] is None and got[DAYS[9]] is not None


def test_gates_read_the_thresholds_of_the_date(spark, days):
    r = random.Random(1)
    tickers = [f"T{k}" for k in range(6)]
    members = spark.createDataFrame([(d, t) for d in DAYS for t in tickers], "date date, ticker string")
    prices = spark.createDataFrame([(t, d, r.uniform(9, 11), r.uniform(9, 11), r.choice([0, 5, None])) for d in DAYS for t in tickers if r.random() < 0.9], "ticker string, date date, open double, close double, volume long")
    some = lambda: D(2020, 1, 1) + datetime.timedelta(r.randrange(-20, 60))
    calendar = spark.createDataFrame([(r.choice(tickers), "earnings", some()) for _ in range(6)], "ticker string, event_type string, event_date date")
    positions = spark.createDataFrame([(r.choice(tickers), a, a + datetime.timedelta(r.randrange(9))) for a in (some() for _ in range(6))] + [("T0", D(2000, 1, 1), None)], "ticker string, opened date, closed date")
    outcomes = spark.createDataFrame([(r.choice(tickers), some()) for _ in range(6)], "ticker string, exit_date date")
    rows = [("gap", 1, "0.02", -1), ("gap", 2, "0.1", 12), ("before", 1, "5", -1), ("before", 2, "0", 18), ("after", 1, "1", -1), ("after", 2, "4", 22), ("cooldown", 1, "1", -1), ("cooldown", 2, "9", 26)]
    wanted = {"gap": ("gap", "double"), "before": ("before", "int"), "after": ("after", "int"), "cooldown": ("cooldown", "int")}
    args = members, prices, calendar, positions, outcomes
    got = {(x.date, x.ticker): x for x in selection.gates(*args, settings=settings.on_dates(config_of(spark, rows), days, wanted)).collect()}
    assert len(got) == len(DAYS) * len(tickers)
    for i in (3, 11, 12, 17, 18, 21, 22, 25, 26, 39):
        at = {k: [float(x) for key, _, x, d in rows if key == k and d <= i][-1] for k in wanted}
        one = selection.gates(*args, gap=at["gap"], **{k: int(at[k]) for k in ("before", "after", "cooldown")}).filter(F.col("date") == DAYS[i])
        assert all(got[x.date, x.ticker] == x for x in one.collect())


def test_a_screen_that_turns_shadow_within_a_range(spark, days):
    """From its date on, and on no other, its names are no candidates, and it is recorded to the slot cap."""
    ranked = spark.createDataFrame([(s, d, f"T{k}", b, float(50 - k), k + 1) for s in ("S1", "S2") for d in DAYS for k in range(24) for b in ["small" if k % 2 else "mid"]], "screen_id string, date date, ticker string, size_bucket string, score float, rank int")
    gate = ranked.select("date", "ticker").distinct().withColumns({"passed": F.col("ticker") != "T3", "state": F.lit("passed")})
    limits = settings.on_dates(config_of(spark, [("lo", 1, "4", -1), ("hi", 1, "12", -1)]), days, {"slot_floor": ("lo", "int"), "slot_cap": ("hi", "int")})

    def taken(*more):
        on = settings.screens_on(settings.screen_versions(screen_config(spark, *more)), days)
        return selection.allocate(ranked, gate, settings.seats(on, limits))

    turned = taken(("screens.S2.state", 2, "shadow", 17), ("screens.S1.slots", 2, "8", 30))
    before, after = ({(x.date, x.screen_id, x.ticker) for x in selection.candidates(t).collect()} for t in (taken(), turned))
    changed = {d for d, s, _ in before ^ after if s == "S2"}
    assert changed == set(DAYS[17:]) and not any(s == "S2" and d >= DAYS[17] for d, s, _ in after)
    assert {d for d, s, _ in before ^ after if s == "S1"} == set(DAYS[30:])
    seats = {(x.date, x.screen_id, x.size_bucket): x["count"] for x in turned.groupBy("date", "screen_id", "size_bucket").count().collect()}
    for i, d in enumerate(DAYS):
        for s, n in (("S1", 4 if i < 30 else 8), ("S2", 5 if i < 17 else 12)):
            assert all(seats.get((d, s, b), 0) == slot_quota(n)[b] for b in ("mid", "small"))
    members = ranked.select("date", "ticker").distinct().withColumn("sector", F.lit("X"))
    market = days.withColumn("regime_label", F.lit("mixed"))
    version = asof.config_versions_on(screen_config(spark, ("screens.S2.state", 2, "shadow", 17)), days)
    rows = selection.attribution(turned, members, market, version).cache()
    got = {(x.date, x.ticker): x for x in rows.collect()}
    on = got[DAYS[20], "T11"]
    assert (on.surfaced_as, on.size_bucket, on.sector, on.regime_label, on.gate_state, on.config_version) == ("shadow", "small", "X", "mixed", "passed", 2) and set(on.screens) == {"S2"}
    both = got[DAYS[20], "T0"]
    assert both.surfaced_as == "candidate" and set(both.screens) == {"S1", "S2"} and both.screens["S1"].rank == 1 and got[DAYS[3], "T0"].config_version == 1
    assert {(x.date, x.ticker) for x in selection.candidate_view(rows).collect()} == {(d, t) for d, _, t in after}
    again = selection.freeze(rows.filter("date <> '2020-01-21'"), rows.withColumn("surfaced_as", F.lit("other")))
    assert {(x.date, x.ticker): x.surfaced_as for x in again.collect()} == {k: "other" if k[0] == DAYS[20] else x.surfaced_as for k, x in got.items()}
    with pytest.raises(Exception, match="outside the tuner's limits"):
        taken(("screens.S1.slots", 2, "40", 5)).collect()


def test_quiet_days_count_the_articles_of_the_week(spark):
    """A name without a row on the date has the articles of the days before; one without any row is unknown."""
    rows = spark.createDataFrame([("A", D(2020, 1, 1), 3), ("A", D(2020, 1, 4), 2), ("B", D(2020, 1, 1), None)], "ticker string, date date, article_count int")
    spine = spark.createDataFrame([(t, D(2020, 1, d)) for t in "ABC" for d in (4, 7, 8, 11)], "ticker string, date date")
    got = {(x.ticker, x.date.day): x.articles_7d for x in screens.article_counts(rows, spine).collect()}
    assert [got["A", d] for d in (4, 7, 8, 11)] == [5, 5, 2, None] and len(got) == 12
    assert got["B", 7] is None and got["C", 7] is None
    gate = screens.news_settled(5, 1.0, -0.05)
    quiet = spark.createDataFrame([(got["A", 7], 3.0, 0.0)], "articles_7d int, article_count_z_own_90d double, sentiment_delta_7v30 double")
    assert not quiet.select(gate).first()[0]  # an empty day does not pass a name with news
