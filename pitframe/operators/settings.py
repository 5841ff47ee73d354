"""Settings by date (B9, J1, J2): versions as intervals, joined into every step that reads a setting.

A setting is a row (key, version, value, set_at). On a date the highest version set by then is in force, the date being
that of the exchange's time zone. Settings are few: intervals, and rows of one a date, are the broadcast sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .asof import in_force

ZONE = "America/New_York"
PARTS = "array<struct<metric:string,kind:string,direction:string,weight:double,points:double>>"


def versions(config: DataFrame, prefix: str = "", zone: str = ZONE) -> DataFrame:
    """B9 as intervals: (key, version, value, start, until), each version over the dates on which it is the one in force."""
    rows = config.filter(F.col("key").startswith(prefix)).withColumn("start", F.to_date(F.from_utc_timestamp("set_at", zone)))
    by = W.partitionBy("key").orderBy("start", F.desc("version"))
    # a version that an older or equal date has overtaken is never in force
    rows = rows.withColumn("most", F.max("version").over(by.rowsBetween(W.unboundedPreceding, -1))).filter(F.col("most").isNull() | (F.col("version") > F.col("most")))
    return rows.select("key", "version", "value", "start", F.lead("start").over(W.partitionBy("key").orderBy("start")).alias("until"))


def on_dates(config: DataFrame, days: DataFrame, wanted: dict[str, tuple[str, str]], zone: str = ZONE) -> DataFrame:
    """One row a date with a column for each name in ``wanted``, {name: (key, type)}. A date on which a key has no value is an error, as nothing may
    be computed under a setting that was not there."""
    own = versions(config.filter(F.col("key").isin(*(k for k, _ in wanted.values()))), zone=zone)
    dates = days.select("date").distinct()
    rows = dates.join(F.broadcast(own), in_force(F.col("date"), F.col("start"), F.col("until")), "left").groupBy("date").agg(F.map_from_entries(F.collect_list(F.when(F.col("key").isNotNull(), F.struct("key", "value")))).alias("m"))

    def value(key: str, kind: str) -> Column:
        x = F.try_element_at("m", F.lit(key))
        return F.when(x.isNotNull(), x.cast(kind)).otherwise(F.raise_error(F.concat(F.lit(f"no setting {key} on "), F.col("date").cast("string"))).cast(kind))

    return rows.select("date", *(value(k, kind).alias(name) for name, (k, kind) in wanted.items()))


def screen_versions(config: DataFrame, zone: str = ZONE) -> DataFrame:
    """(screen_id, start, until, state, min_inputs, slots, parts): every stretch of dates over which a screen's settings stay the same.

    A screen is there from the first date on which it has a state; ``parts`` are its inputs and bonuses as data.
    """
    own = versions(config, "screens.", zone).withColumn("path", F.split("key", "\\.")).filter(F.size("path") == 3).select(F.col("path")[1].alias("screen_id"), F.col("path")[2].alias("name"), "value", "start", "until")
    starts = own.select("screen_id", "start").distinct()
    rows = starts.join(own.select("screen_id", "name", "value", F.col("start").alias("a"), F.col("until").alias("b")), "screen_id").filter(in_force(F.col("start"), F.col("a"), F.col("b")))
    of = lambda name: F.max(F.when(F.col("name") == name, F.col("value")))
    each = rows.groupBy("screen_id", "start").agg(of("state").alias("state"), of("min_inputs").cast("int").alias("min_inputs"), of("slots").cast("int").alias("slots"), F.from_json(of("metrics"), PARTS).alias("parts"), of("metrics").alias("text"))
    return each.withColumn("until", F.lead("start").over(W.partitionBy("screen_id").orderBy("start"))).filter("state is not null")


def check_screens(screens: DataFrame, metrics: set[str]) -> DataFrame:
    """The same rows, or an error that names the first definition in force at some time that cannot be scored. One row a screen and version."""
    from .screens import parse_screen

    for r in screens.orderBy("screen_id", "start").collect():
        if r.state not in ("live", "shadow", "retired"):
            raise ValueError(f"{r.screen_id}: unknown state {r.state}")
        if r.text is None or r.min_inputs is None or r.slots is None:
            raise ValueError(f"{r.screen_id}: metrics, min_inputs and slots must be set from {r.start} on")
        parse_screen(r.screen_id, r.text, metrics, r.min_inputs)
    return screens


def screens_on(screens: DataFrame, days: DataFrame) -> DataFrame:
    """(date, screen_id, state, min_inputs, slots, parts) of the screens that are scored on each date, live and shadow ones."""
    own = screens.filter("state <> 'retired'").drop("text")
    return days.select("date").distinct().join(F.broadcast(own), in_force(F.col("date"), F.col("start"), F.col("until"))).drop("start", "until")


def seats(screens: DataFrame, limits: DataFrame) -> DataFrame:
    """L1 by date: (date, screen_id, is_live, size_bucket, seats). Live screens have their own slots, which must lie within ``limits`` (date, slot_floor,
    slot_cap), shadow ones the cap: what they would have surfaced at most."""
    rows = screens.join(F.broadcast(limits), "date").withColumn("is_live", F.col("state") == "live")
    outside = F.col("is_live") & ~F.col("slots").between(F.col("slot_floor"), F.col("slot_cap"))
    n = F.when(outside, F.raise_error(F.concat("screen_id", F.lit(": slots outside the tuner's limits on "), F.col("date").cast("string"))).cast("int")).when(F.col("is_live"), F.col("slots")).otherwise(F.col("slot_cap"))
    rows = rows.withColumn("n", n).withColumn("large", F.floor(F.col("n") / 4).cast("int")).withColumn("mid", F.floor((F.col("n") - F.col("large")) / 2).cast("int"))
    each = F.explode(F.create_map(F.lit("large"), F.col("large"), F.lit("mid"), F.col("mid"), F.lit("small"), F.col("n") - F.col("large") - F.col("mid"))).alias("size_bucket", "seats")
    return rows.select("date", "screen_id", "is_live", each)
