"""Point-in-time access (B1-B6, B9, B10): what was in force on a date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def universe_as_of(security: DataFrame, day) -> DataFrame:
    """B1: each ticker's latest row on or before the day; inactive ones are still there, to be filtered after."""
    others = [c for c in security.columns if c != "ticker"]
    seen = security.filter(F.col("date") <= F.lit(day).cast("date"))
    return seen.groupBy("ticker").agg(F.max_by(F.struct(*others), "date").alias("r")).select("ticker", "r.*")


def members_as_of(security: DataFrame, day) -> DataFrame:
    """B2: the active rows of B1."""
    return universe_as_of(security, day).filter("is_active")


def epochs(security: DataFrame, first, last) -> DataFrame:
    """Evaluation dates that matter to a range, with the one in force at its start."""
    a, b = F.lit(first).cast("date"), F.lit(last).cast("date")
    days = security.select("date").distinct().filter(F.col("date") <= b)
    start = days.agg(F.max(F.when(F.col("date") <= a, F.col("date"))).alias("start"))
    return days.crossJoin(F.broadcast(start)).filter(F.col("date") >= F.coalesce("start", a)).select("date")


def sessions(prices: DataFrame, first=None, last=None) -> DataFrame:
    """Dates with a bar."""
    days = prices.select("date").distinct()
    return days if first is None else days.filter(F.col("date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def intervals(dates: DataFrame, keys: list[str], date: str = "date") -> DataFrame:
    """Adds ``until``: the next date of the same keys, from which the row is no longer in force."""
    return dates.withColumn("until", F.lead(date).over(W.partitionBy(*keys).orderBy(date)))


def in_force(day: Column, start: Column, until: Column) -> Column:
    return (start <= day) & (until.isNull() | (day < until))


def epoch_map(days: DataFrame, epoch_dates: DataFrame) -> DataFrame:
    """Each session with the newest epoch on or before it; epochs are few and become intervals."""
    spans = epoch_dates.select(F.col("date").alias("epoch")).distinct().withColumn("until", F.lead("epoch").over(W.orderBy("epoch")))
    return days.join(F.broadcast(spans), in_force(F.col("date"), F.col("epoch"), F.col("until"))).select("date", "epoch")


def as_of_join(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], date: str = "date") -> DataFrame:
    """Each left row with the right row of the same keys and greatest date on or before its own, or nulls.

    Both sides are put together and read in one window by key, so neither has to fit in memory.
    """
    rest = [c for c in left.columns if c not in (*keys, date)]
    a = left.select(*keys, date, F.struct(*(rest or [F.lit(1).alias("_")])).alias("l"), F.lit(None).cast(right.select(F.struct(*values).alias("x")).schema[0].dataType).alias("r"), F.lit(1).alias("side"))
    b = right.select(*keys, date, F.lit(None).cast(a.schema["l"].dataType).alias("l"), F.struct(*values).alias("r"), F.lit(0).alias("side"))
    last = F.last("r", ignorenulls=True).over(W.partitionBy(*keys).orderBy(date, "side").rowsBetween(W.unboundedPreceding, 0))
    both = a.unionByName(b).withColumn("found", last).filter("side = 1")
    return both.select(*keys, date, *(f"l.{c}" for c in rest), *(f"found.{v}" for v in values))


def with_history(near: DataFrame, far: DataFrame, need: int) -> DataFrame:
    """Recent bars of all names, and of ``far``, the bars before these, those of names with fewer than ``need`` recent ones or none at all."""
    full = near.groupBy("ticker").count().filter(F.col("count") >= need).select("ticker")
    return near.unionByName(far.join(full, "ticker", "left_anti"))


def range_members(security: DataFrame, days: DataFrame) -> DataFrame:
    """(date, ticker, sector, size_bucket, market_cap) of the members of every session.

    Epochs are one row with an array, in which both ends of a row's interval and each session have a place. A ticker's row is repeated for
    each epoch that it is in force, and sessions, one row a date, meet members by the place of their epoch: an equi-join in which members do
    not move. Sessions before the first epoch have no members.
    """
    known = F.broadcast(security.agg(F.sort_array(F.collect_set("date")).alias("epochs")))
    spans = intervals(security, ["ticker"]).filter("is_active").crossJoin(known)
    last = F.coalesce(F.array_position("epochs", F.col("until")) - 1, F.size("epochs").cast("long"))
    members = spans.select("ticker", "sector", "size_bucket", "market_cap", F.explode(F.sequence(F.array_position("epochs", F.col("date")), last)).alias("no"))
    placed = days.select("date").distinct().crossJoin(known).select("date", F.size(F.filter("epochs", lambda e: e <= F.col("date"))).cast("long").alias("no"))
    dealt = members.repartition(max(1, int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "ticker", "no")  # few bytes before, many rows after
    return dealt.join(F.broadcast(placed), "no").select("date", "ticker", "sector", "size_bucket", "market_cap")


def param_as_of(config: DataFrame, day, prefix: str = "", zone: str = "America/New_York") -> DataFrame:
    """The highest version of each key set by the day, the day being that of the exchange's time zone."""
    seen = config.filter(F.col("key").startswith(prefix) & (F.to_date(F.from_utc_timestamp("set_at", zone)) <= F.lit(day).cast("date")))
    return seen.groupBy("key").agg(F.max_by("value", "version").alias("value"), F.max("version").alias("version"))


def params_on(config: DataFrame, days: DataFrame, prefix: str = "", zone: str = "America/New_York") -> DataFrame:
    """B9 for every day: (date, key, value, version), the highest version of each key set by the day. Settings and days are few."""
    seen = config.filter(F.col("key").startswith(prefix)).withColumn("since", F.to_date(F.from_utc_timestamp("set_at", zone)))
    rows = days.select("date").distinct().join(F.broadcast(seen), F.col("since") <= F.col("date"))
    return rows.groupBy("date", "key").agg(F.max_by("value", "version").alias("value"), F.max("version").alias("version"))


def config_version(config: DataFrame, day, zone: str = "America/New_York") -> DataFrame:
    """One more than the number of revisions in force, or null if nothing is."""
    seen = F.to_date(F.from_utc_timestamp("set_at", zone)) <= F.lit(day).cast("date")
    return config.agg(F.when(F.count_if(seen) > 0, 1 + F.count_if(seen & (F.col("version") > 1))).alias("config_version"))


def config_versions_on(config: DataFrame, days: DataFrame, zone: str = "America/New_York") -> DataFrame:
    """B10 for every day: (date, config_version). Settings are few and come as one array of the days on which they were set."""
    since = F.to_date(F.from_utc_timestamp("set_at", zone))
    one = config.agg(F.collect_list(since).alias("any_set"), F.collect_list(F.when(F.col("version") > 1, since)).alias("revised"))
    by = lambda c: F.size(F.filter(c, lambda d: d <= F.col("date")))
    return days.select("date").distinct().crossJoin(F.broadcast(one)).select("date", F.when(by("any_set") > 0, (1 + by("revised")).cast("long")).alias("config_version"))
