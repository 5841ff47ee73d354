"""Universe construction (B11-B16, C1-C10): freshness, liquidity, the eligibility waterfall, departures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitframe.functions.series import size_bucket

from . import asof


def newest_first():
    return W.partitionBy("ticker").orderBy(F.desc("date"))


def evaluation_dates(spark, first: str, last: str) -> DataFrame:
    """Sundays of a range; a range without one gives no row."""
    one = spark.sql(f"SELECT next_day(date_sub(date'{first}', 1), 'SUN') AS a, date'{last}' AS b")
    return one.select("b", F.explode(F.expr("sequence(a, greatest(a, b), interval 7 days)")).alias("date")).filter("date <= b").select("date")


def liquidity(prices: DataFrame, day, bars: int = 20, min_price: float = 5, min_volume: float = 2e6, history: int = 250, days: int = 45) -> DataFrame:
    """Each ticker's last close, median dollar volume over its last bars, first and last bar and the first failed test.

    A ticker with no close and volume among its last bars has no row. The last bars are looked for within ``days`` days, and further back only for
    tickers that have fewer there; only dates are read of the whole history, for spans and counts, which tasks aggregate before the shuffle.
    """
    d = F.lit(day).cast("date")
    seen = prices.filter(F.col("date") <= d)
    read = seen.select("ticker", "date", "close", "volume")
    near = F.col("date") > F.date_sub(d, days)
    recent = asof.with_history(read.filter(near), read.filter(~near), bars).withColumn("rn", F.row_number().over(newest_first())).filter(F.col("rn") <= bars)
    pair = F.col("close").cast("double") * F.col("volume")
    r = recent.groupBy("ticker").agg(F.max_by("close", "date").cast("double").alias("last_close"), F.percentile(pair, 0.5).alias("median_dollar_volume")).filter("median_dollar_volume is not null")
    spans = seen.groupBy("ticker").agg(F.min("date").alias("first_seen"), F.max("date").alias("last_seen"), F.count("*").alias("bars"))
    verdict = F.when(F.col("last_close").isNull() | (F.col("last_close") < min_price), "below_min_price").when(F.col("median_dollar_volume") < min_volume, "below_min_dollar_volume").when(F.col("bars") < history, "insufficient_history")
    return r.join(spans, "ticker").withColumn("verdict", verdict)


def readiness(filings: DataFrame, day) -> DataFrame:
    """Usable filing dates, newest share count and newest sector of each ticker, all visible on the day. A ticker with neither a usable
    date nor a share count has no fundamentals: its ``clean_gaps`` is null, not zero."""
    seen = filings.filter(F.col("filing_date_effective") <= F.lit(day).cast("date"))
    clean = F.count_if(F.col("filing_date_unknown_reason") == "none")
    return seen.groupBy("ticker").agg(
        F.when((clean > 0) | (F.count("shares") > 0), clean).alias("clean_gaps"),
        F.max_by("shares", F.when(F.col("shares").isNotNull(), F.col("period_end"))).alias("shares"),
        F.max_by("sector", F.when(F.col("sector").isNotNull(), F.struct("filing_date_effective", "period_end"))).alias("sector"),
    )


def waterfall(prices: DataFrame, filings: DataFrame, listing: DataFrame, delisted: DataFrame, day, *, window: int = 7, min_cap: float = 300e6, min_gaps: int = 4, large: float = 10e9, mid: float = 2e9, **liquid) -> DataFrame:
    """Every ticker with its criterion, null for members; rejections count only where the ticker traded lately.

    ``listing`` holds the common stocks' tickers, ``delisted`` (ticker, delisted_on).
    """
    d = F.lit(day).cast("date")
    rows = liquidity(prices, day, **liquid).join(readiness(filings, day), "ticker", "left").join(listing.select("ticker", F.lit(True).alias("listed")).distinct(), "ticker", "left").join(delisted, "ticker", "left")
    rows = rows.withColumn("market_cap", F.col("shares") * F.col("last_close"))
    criterion = (
        F.when(F.col("verdict").isNotNull(), F.col("verdict")).when(F.col("listed").isNull(), "not_common_stock").when(F.col("delisted_on") < d, "delisted_on_date").when(F.col("clean_gaps").isNull(), "no_fundamentals")
        .when(F.col("clean_gaps") < min_gaps, "below_clean_gaps").when(F.col("shares").isNull() | (F.col("shares") <= 0), "no_share_count").when(F.col("market_cap") < min_cap, "below_market_cap")
    )
    rows = rows.withColumn("criterion", criterion).filter(F.col("criterion").isNull() | (F.col("last_seen") > F.date_sub(d, window)))
    return rows.select("ticker", "criterion", "sector", F.when(F.col("criterion").isNull(), size_bucket(F.col("market_cap"), large, mid)).alias("size_bucket"), "market_cap", "first_seen", "last_seen")


def departures(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Members before who are none now, with attributes gone and is_active false."""
    gone = previous.select("ticker").join(current.select("ticker"), "ticker", "left_anti")
    nothing = F.lit(None).cast("string")
    return gone.select("ticker", nothing.alias("sector"), nothing.alias("size_bucket"), F.lit(None).cast("double").alias("market_cap"), F.lit(False).alias("is_active"))


def identity(evaluations: DataFrame) -> DataFrame:
    """One row a ticker over (ticker, date, name, first_seen, last_seen)."""
    return evaluations.groupBy("ticker").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.max_by("name", "date").alias("name"))


def delisted_on(prices: DataFrame, delisted: DataFrame) -> DataFrame:
    """Last bar of the tickers on the delisted list."""
    return prices.join(delisted.select("ticker"), "ticker", "left_semi").groupBy("ticker").agg(F.max("date").alias("delisted_on"))


def delisted_pool(prices: DataFrame, delisted: DataFrame, first, last) -> DataFrame:
    """Delisted tickers with a bar in the window."""
    inside = prices.filter(F.col("date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    return inside.join(delisted.select("ticker"), "ticker", "left_semi").select("ticker").distinct()


def liquid_pool(prices: DataFrame, listing: DataFrame, day, **liquid) -> DataFrame:
    """Listed tickers without a failed liquidity test that are no index symbols."""
    return liquidity(prices, day, **liquid).filter("verdict is null and not startswith(ticker, '^')").join(listing.select("ticker"), "ticker", "left_semi").select("ticker")


def just_reported(calendar: DataFrame, day, days: int = 7) -> DataFrame:
    """Tickers with an earnings event in the last days."""
    d = F.lit(day).cast("date")
    return calendar.filter((F.col("event_type") == "earnings") & (F.col("event_date") > F.date_sub(d, days)) & (F.col("event_date") <= d)).select("ticker").distinct()


def rotation(pool: DataFrame, attempts: DataFrame, universe: DataFrame, reported: DataFrame, n: int) -> DataFrame:
    """The ``n`` tickers to refresh: never tried, just reported, longest ago, in the universe, then by name."""
    rows = pool.select("ticker").distinct().join(attempts.groupBy("ticker").agg(F.max("attempted_at").alias("attempted_at")), "ticker", "left")
    rows = rows.join(reported.select("ticker", F.lit(True).alias("reported")).distinct(), "ticker", "left").join(universe.select("ticker", F.lit(True).alias("inside")).distinct(), "ticker", "left")
    rows = rows.select("ticker", "attempted_at", F.coalesce("reported", F.lit(False)).alias("reported"), F.coalesce("inside", F.lit(False)).alias("in_universe"))
    return rows.orderBy(F.col("attempted_at").isNotNull(), ~F.col("reported"), "attempted_at", ~F.col("in_universe"), "ticker").limit(n)


def rotation_counts(pool: DataFrame, attempts: DataFrame, chosen: DataFrame) -> DataFrame:
    """One row: the size of the pool, its tickers never tried, and of the chosen ones the new, the refreshed, and the oldest attempt refreshed."""
    tried = attempts.select("ticker").distinct().withColumn("tried", F.lit(True))
    a = pool.select("ticker").distinct().join(tried, "ticker", "left").agg(F.count("*").alias("pool"), F.count_if(F.col("tried").isNull()).alias("never_tried"))
    b = chosen.agg(F.count_if(F.col("attempted_at").isNull()).alias("first_attempts"), F.count("attempted_at").alias("refreshed"), F.min("attempted_at").alias("oldest_refreshed"))
    return a.crossJoin(b)


def bar_counts(prices: DataFrame, window: int = 20) -> DataFrame:
    """Bars of each date with the median and number of the counts before; one row a date, so one window reads them."""
    w = W.partitionBy(F.lit(1)).orderBy("date").rowsBetween(-window, -1)
    return prices.groupBy("date").agg(F.count("*").alias("n")).withColumns({"median": F.percentile("n", 0.5).over(w), "prior": F.count("n").over(w)})


def freshness(prices: DataFrame, session, abort: int = 40_000, alert: int = 45_000, fraction: float = 0.95, window: int = 20) -> DataFrame:
    """One row (state, usable_date, rows, alert, unchecked): no_data, stale, abort, unsettled or fresh.

    Newest first, dates below the fraction of the median before them are passed over; the first other one is usable, or aborts if it is far too
    short. ``unchecked`` tells that it was taken without ``window`` dates before it. If all dates are still filling, none is usable and nothing aborts.
    """
    c = bar_counts(prices, window).withColumn("state", F.when(F.col("n") < abort, "abort").when((F.col("prior") >= window) & (F.col("n") < F.col("median") * fraction), "skip").otherwise("fresh"))
    newest = c.agg(F.max("date").alias("newest"))
    first = c.filter("state <> 'skip'").agg(F.max_by(F.struct("date", "n", "state", "prior"), "date").alias("x"))
    state = F.when(F.col("newest").isNull(), "no_data").when(F.col("newest") < F.lit(session).cast("date"), "stale").otherwise(F.coalesce("x.state", F.lit("unsettled")))
    fresh = state == "fresh"
    return newest.crossJoin(first).select(state.alias("state"), F.when(fresh, F.col("x.date")).alias("usable_date"), F.when(fresh, F.col("x.n")).alias("rows"), (fresh & (F.col("x.n") < alert)).alias("alert"), (fresh & (F.col("x.prior") < window)).alias("unchecked"))


def frontier(prices: DataFrame, fraction: float = 0.95, window: int = 20) -> DataFrame:
    """The newest date whose number of bars has settled; with too few dates before it, it is taken as it is."""
    c = bar_counts(prices, window)
    return c.filter((F.col("prior") < window) | (F.col("n") >= F.col("median") * fraction)).agg(F.max("date").alias("frontier"))
