"""Screens (J1-J9): definitions to weighted composites, trailing floors, ranks."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitframe.plans.stages import stage


def parse_screen(screen_id: str, text: str, metrics: set[str], min_inputs: int) -> dict:
    """A checked definition: inputs {metric, direction, weight} and bonuses {metric, kind: bonus, points}."""
    parts = json.loads(text)
    inputs = [p for p in parts if p.get("kind") != "bonus"]
    bonuses = [p for p in parts if p.get("kind") == "bonus"]
    for p in parts:
        if p["metric"] not in metrics:
            raise ValueError(f"{screen_id}: unknown metric {p['metric']}")
    for p in inputs:
        if p["direction"] not in ("high", "low") or not p["weight"] > 0:
            raise ValueError(f"{screen_id}: {p['metric']} needs a direction and a weight above zero")
    if not 1 <= min_inputs <= len(inputs):
        raise ValueError(f"{screen_id}: min_inputs must be from 1 to {len(inputs)}")
    return {"id": screen_id, "inputs": inputs, "bonuses": bonuses, "min_inputs": min_inputs}


def screen_states(params: DataFrame) -> DataFrame:
    """(screen_id, state), and the date where the parameters have one, from parameters named screens.<id>.state in force."""
    own = [c for c in ("date",) if c in params.columns]
    return params.filter("key rlike '^screens\\\\.[^.]+\\\\.state$'").select(*own, F.split("key", "\\.")[1].alias("screen_id"), F.col("value").alias("state"))


def composite(screen: dict) -> Column:
    """Weighted mean of the percentiles present, low ones turned round, plus bonuses; null below min_inputs."""
    points = [(F.col(f"{p['metric']}_pctile") if p["direction"] == "high" else 100 - F.col(f"{p['metric']}_pctile"), float(p["weight"])) for p in screen["inputs"]]
    present = sum((x.isNotNull().cast("int") for x, _ in points), F.lit(0))
    total = sum((F.coalesce(x * w, F.lit(0.0)) for x, w in points), F.lit(0.0))
    weight = sum((F.when(x.isNotNull(), w).otherwise(0.0) for x, w in points), F.lit(0.0))
    bonus = sum((F.when(F.col(b["metric"]), float(b["points"])).otherwise(0.0) for b in screen["bonuses"]), F.lit(0.0))
    return F.when(present >= screen["min_inputs"], F.try_divide(total, weight) + bonus).cast("float")


def gated(score: Column, *conditions: Column) -> Column:
    """The score where every condition is true; unknown counts as not true."""
    ok = F.lit(True)
    for c in conditions:
        ok &= c.eqNullSafe(True)
    return F.when(ok, score)


def price_stabilising() -> Column:
    """Above the 20-day mean, or relative strength rising; unknown if neither is known to be so."""
    return (F.col("dist_20dma") > 0) | (F.col("rs_20d_slope") > 0)


def news_settled(min_articles: int, z_max: float, delta_min: float) -> Column:
    """With fewer than ``min_articles`` articles in seven days, none counting as zero, the news tests are passed; else the count must
    be below ``z_max`` deviations of its own history and the sentiment not falling by more than ``delta_min``."""
    return (F.coalesce("articles_7d", F.lit(0)) < min_articles) | ((F.col("article_count_z_own_90d") < z_max) & (F.col("sentiment_delta_7v30") >= delta_min))


def eligible(quality: Column, quality_min: float, technical: Column, technical_max: float, *, min_articles: int, z_max: float, delta_min: float) -> list[Column]:
    """The conditions of the eligibility gate, for ``gated``: a good enough quality composite, a low enough technical one, a
    stabilising price, and settled news."""
    return [quality >= quality_min, technical <= technical_max, price_stabilising(), news_settled(min_articles, z_max, delta_min)]


def article_counts(sentiment: DataFrame, spine: DataFrame, days: int = 7) -> DataFrame:
    """(ticker, date, articles_7d) on every date of ``spine`` (ticker, date), whether the name has a row that day or not; null without any row in the days."""
    w = W.partitionBy("ticker").orderBy(F.unix_date("date")).rangeBetween(1 - days, 0)
    both = spine.select("ticker", "date").distinct().withColumn("asked", F.lit(True)).join(sentiment.select("ticker", "date", "article_count"), ["ticker", "date"], "full")
    return both.withColumn("articles_7d", F.sum("article_count").over(w)).filter("asked").select("ticker", "date", "articles_7d")


def scores_on(ranked: DataFrame, screens: DataFrame, metrics: list[str], flags: list[str]) -> DataFrame:
    """J3 with screens as data: (screen_id, date, ticker, size_bucket, score) under the definitions of each date (``settings.screens_on``).

    Definitions, one row a screen and date, are the broadcast side: names do not move. ``metrics`` have a column <metric>_pctile.
    """
    numbered = screens.select("date", "screen_id", "min_inputs", "parts").withColumn("no", F.dense_rank().over(W.orderBy("min_inputs", "parts")))  # one row a screen and date
    rows = ranked.select("date", "ticker", "size_bucket", *(F.col(f"{m}_pctile").cast("double").alias(f"{m}_pctile") for m in metrics), *flags)
    score = F.lit(None).cast("float")
    for d in numbered.select("no", "min_inputs", "parts").distinct().collect():  # few versions, so few definitions
        score = F.when(F.col("no") == d["no"], definition_score(d["min_inputs"], d["parts"], metrics, flags)).otherwise(score)
    return rows.join(F.broadcast(numbered.select("date", "screen_id", "no")), "date").select("screen_id", "date", "ticker", "size_bucket", score.alias("score"))


def definition_score(min_inputs: int, parts: list, metrics: list[str], flags: list[str]) -> Column:
    """The score under one definition; a metric that is not among ``metrics`` has no value, a flag not among ``flags`` is not set."""
    total, weight, points, held = F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0)
    for p in parts:
        if p["kind"] == "bonus":
            if p["metric"] in flags:
                points += F.when(F.col(p["metric"]), F.lit(p["points"]).cast("double")).otherwise(0.0)
        elif p["metric"] in metrics:
            value = F.col(f"{p['metric']}_pctile")
            there, value, w = value.isNotNull(), value if p["direction"] == "high" else 100 - value, F.lit(p["weight"]).cast("double")
            total, weight, held = total + F.when(there, value * w).otherwise(0.0), weight + F.when(there, w).otherwise(0.0), held + there.cast("int")
    return F.when(held >= F.lit(min_inputs).cast("int"), F.try_divide(total, weight) + points).cast("float")


def scores(ranked: DataFrame, screens: list[dict]) -> DataFrame:
    """(screen_id, date, ticker, size_bucket, score) of every screen in one pass."""
    each = F.array(*(F.struct(F.lit(s["id"]).alias("screen_id"), composite(s).alias("score")) for s in screens))
    return ranked.select("date", "ticker", "size_bucket", F.explode(each).alias("x")).select("x.screen_id", "date", "ticker", "size_bucket", "x.score")


def floors(scored: DataFrame, lookback: int = 250, quantile: float = 0.98, width: float = 0.5, settings: DataFrame | None = None) -> DataFrame:
    """(screen_id, date, floor): exact quantile of all scores on the last scored dates, this one included. ``settings`` (date, lookback,
    quantile), one row a date, gives the two that are in force on each date.

    In two passes. Scores are first counted by date and bin of ``width``; sliding sums over the dates of each bin tell in
    which bins the two neighbours of the quantile lie. Then only scores of these bins, on the dates that some quantile sees, are read again
    and counted one by one. What is kept of the first pass is a stage table, a few hundred rows a screen and date.
    """
    own = scored.filter("score is not null").select("screen_id", "date", F.col("score").cast("double").alias("score")).withColumn("bin", F.floor(F.col("score") / width))
    binned = stage(own.groupBy("screen_id", "date", "bin").agg(F.count("*").alias("n")), "bins")
    dates = binned.select("screen_id", "date").distinct().withColumn("k", F.row_number().over(W.partitionBy("screen_id").orderBy("date")))
    if settings is None:
        lookbacks, dates = [lookback], dates.withColumns({"lookback": F.lit(lookback), "quantile": F.lit(float(quantile))})
    else:  # few versions, so few lookbacks
        lookbacks, dates = [r.lookback for r in settings.select("lookback").distinct().collect()], dates.join(F.broadcast(settings.select("date", "lookback", "quantile")), "date")
    binned = binned.join(F.broadcast(dates.select("screen_id", "date", "k")), ["screen_id", "date"]).drop("date")  # one row a screen and date
    grid = dates.join(binned.select("screen_id", "bin").distinct(), "screen_id")  # dates by bins: no more with more names
    window = W.partitionBy("screen_id", "bin").orderBy("k")
    within = F.coalesce(*(F.when(F.col("lookback") == n, F.sum("n").over(window.rowsBetween(1 - n, 0))) for n in lookbacks), F.lit(0)) if lookbacks else F.lit(0)
    sums = grid.join(binned, ["screen_id", "k", "bin"], "left").withColumn("n", within)
    by = W.partitionBy("screen_id", "k")
    sums = sums.withColumns({"all": F.sum("n").over(by), "upto": F.sum("n").over(by.orderBy("bin"))}).withColumn("at", (F.col("all") - 1) * F.col("quantile"))
    holds = lambda r: (F.col("upto") - F.col("n") <= r) & (r < F.col("upto"))
    wanted = sums.filter((F.col("k") >= F.col("lookback")) & (holds(F.floor("at")) | holds(F.ceil("at")))).select("screen_id", "date", "k", "lookback", "bin", "at", (F.col("upto") - F.col("n")).alias("below"))
    wanted = stage(wanted, "quantiles")  # two bins a screen and date at most
    then = wanted.withColumn("then", F.explode(F.sequence(F.col("k") - F.col("lookback") + 1, F.col("k"))))
    asked = then.select("screen_id", F.col("then").alias("k"), "bin").distinct().join(dates.select("screen_id", F.col("date"), "k"), ["screen_id", "k"])
    counted = own.join(F.broadcast(asked), ["screen_id", "date", "bin"]).groupBy("screen_id", "k", "bin", "score").agg(F.count("*").alias("n"))
    rows = then.join(counted.select("screen_id", F.col("k").alias("then"), "bin", "score", "n"), ["screen_id", "then", "bin"])
    each = rows.groupBy("screen_id", "date", "bin", "at", "below", "score").agg(F.sum("n").alias("n"))
    each = each.withColumn("upto", F.col("below") + F.sum("n").over(W.partitionBy("screen_id", "date", "bin").orderBy("score")))
    value = lambda r: F.min(F.when(F.col("upto") > r, F.col("score")))
    f = each.groupBy("screen_id", "date").agg(F.first("at").alias("at"), value(F.floor("at")).alias("a"), value(F.ceil("at")).alias("b"))
    f = f.select("screen_id", "date", ((F.ceil("at") - F.col("at")) * F.col("a") + (F.col("at") - F.floor("at")) * F.col("b")).alias("mean"), "a", "b")
    return dates.select("screen_id", "date").join(f, ["screen_id", "date"], "left").select("screen_id", "date", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("mean")).alias("floor"))


def ranks(scored: DataFrame, floor: DataFrame) -> DataFrame:
    """Scored rows at or above the floor in force, ranked by score, then ticker."""
    above = scored.join(floor, ["screen_id", "date"]).filter(F.col("score").cast("double") >= F.col("floor"))
    return above.withColumn("rank", F.row_number().over(W.partitionBy("screen_id", "date").orderBy(F.desc("score"), "ticker")))


def unranked_dates(floor: DataFrame, ranked: DataFrame, states: DataFrame) -> DataFrame:
    """Dates on which some live screen had a floor and none of the live screens ranked anything; shadow screens do not count.

    ``states`` (screen_id, state), or with ``date`` where states change within the range: a screen then counts on the dates on which it is live.
    """
    keys = ["date", "screen_id"] if "date" in states.columns else ["screen_id"]
    live = F.broadcast(states.filter("state = 'live'").select(*keys).distinct())  # a few rows a date
    with_floor = floor.filter("floor is not null").join(live, keys, "left_semi").select("date").distinct()
    return with_floor.join(ranked.join(live, keys, "left_semi").select("date").distinct(), "date", "left_anti")


def halt_on_fault(floor: DataFrame, ranked: DataFrame, states: DataFrame) -> None:
    """A date of ``unranked_dates`` is a fault in the data and stops the run."""
    if (day := unranked_dates(floor, ranked, states).agg(F.min("date")).first()[0]) is not None:
        raise ValueError(f"every live screen with a floor ranked nothing on {day}")


def coverage(scored: DataFrame, sessions: DataFrame) -> DataFrame:
    """(screen_id, scored_dates, sessions): all sessions must be scored before any floor is drawn."""
    n = sessions.agg(F.count_distinct("date").alias("sessions"))
    return scored.groupBy("screen_id").agg(F.count_distinct("date").alias("scored_dates")).crossJoin(F.broadcast(n))
