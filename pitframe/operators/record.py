"""Everything known about (ticker, date) pairs (Q1-Q8): ``pairs`` is a frame, so one pair and a batch run alike."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .asof import as_of_join, param_as_of


def membership(pairs: DataFrame, security: DataFrame) -> DataFrame:
    """Q1: the membership row in force."""
    s = security.withColumn("since", F.col("date"))
    return as_of_join(pairs.select("ticker", "date"), s, ["ticker"], ["since", "sector", "size_bucket", "market_cap", "is_active"])


def rejection(pairs: DataFrame, rejections: DataFrame, security: DataFrame) -> DataFrame:
    """Q2: the latest rejection, unless a later membership row supersedes it."""
    r = as_of_join(pairs.select("ticker", "date"), rejections.withColumn("rejected_on", F.col("date")), ["ticker"], ["rejected_on", "criterion"])
    m = membership(pairs, security).select("ticker", "date", "since")
    return r.join(m, ["ticker", "date"]).filter(F.col("rejected_on").isNotNull() & (F.col("since").isNull() | (F.col("since") <= F.col("rejected_on")))).select("ticker", "date", "rejected_on", "criterion")


def thresholds(config: DataFrame, day, prefix: str = "") -> DataFrame:
    """Q3: settings in force."""
    return param_as_of(config, day, prefix)


def metrics(pairs: DataFrame, ranked: DataFrame, names: list[str], ledger: DataFrame) -> DataFrame:
    """Q4: one row a metric with its percentile, scope and cell figures; a null sector is a sector."""
    rows = pairs.select("ticker", "date").join(ranked, ["ticker", "date"])
    long = rows.select("ticker", "date", "size_bucket", "sector", F.expr(f"stack({len(names)}, {', '.join(f"'{m}', {m}, {m}_pctile, {m}_scope" for m in names)}) as (metric, value, pctile, ranked_in)"))
    c = ledger.alias("c")
    same = reduce(lambda a, b: a & b, (F.col(f"m.{k}").eqNullSafe(F.col(f"c.{k}")) for k in ("date", "size_bucket", "sector", "metric")))
    return long.alias("m").join(c, same, "left").select("m.ticker", "m.date", "m.metric", "value", "pctile", "ranked_in", "cell_members", "bucket_members")


def covered(pairs: DataFrame, coverage: DataFrame, sources: int = 4) -> DataFrame:
    """Q5: whether all sources cover the date: the intersection of their intervals, all of them being there."""
    both = coverage.agg(F.max("covered_from").alias("a"), F.min("covered_to").alias("b"), F.count_distinct("source").alias("n"))
    return pairs.select("ticker", "date").crossJoin(F.broadcast(both)).select("ticker", "date", ((F.col("n") >= sources) & F.col("date").between(F.col("a"), F.col("b"))).alias("covered"))


def recent(pairs: DataFrame, rows: DataFrame, n: int, seen: str = "date", order: str = "date") -> DataFrame:
    """Q6: each pair's newest ``n`` rows of its ticker visible on the date (``seen``), newest by ``order`` first and flagged."""
    p = pairs.select("ticker", F.col("date").alias("on"))
    both = p.join(rows, "ticker").filter(F.col(seen) <= F.col("on"))
    rn = F.row_number().over(W.partitionBy("ticker", "on").orderBy(F.desc(order)))
    return both.withColumn("rn", rn).filter(F.col("rn") <= n).withColumn("newest", F.col("rn") == 1)


def market(pairs: DataFrame, context: DataFrame, security: DataFrame) -> DataFrame:
    """Q7: the market row of the date with the strength of the ticker's sector."""
    rows = membership(pairs, security).select("ticker", "date", "sector").join(context, "date", "left")
    return rows.select("ticker", "date", "regime_label", "breadth", F.when(F.col("sector").isNotNull(), F.try_element_at("sector_relative_strength", F.col("sector"))).alias("sector_strength"))


def news_pool(pairs: DataFrame, articles: DataFrame, days: int = 7) -> DataFrame:
    """Q8: the ticker's articles, flagged if published in the days up to the date; without a date they are out."""
    p = pairs.select("ticker", "date")
    inside = (F.col("published_at") > F.date_sub("date", days)) & (F.col("published_at") <= F.col("date"))
    return p.join(articles, "ticker").filter(F.col("published_at").isNull() | (F.col("published_at") <= F.col("date"))).withColumn("in_window", F.coalesce(inside, F.lit(False)))
