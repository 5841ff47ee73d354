"""Filing dates (B8, B8b): which are usable, and what stands in for those that are not."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def resolve_filing_dates(periods: DataFrame) -> DataFrame:
    """Adds reason, gap, widest_gap and filing_date_effective to (ticker, period_end, filing_date, ...).

    A date is unusable when missing, equal to the period end or before it; the period end plus the ticker's widest usable
    gap takes its place, or nothing if the ticker has no usable gap. The window covers all periods of the load.
    """
    days = F.datediff("filing_date", "period_end")
    rows = periods.withColumn("filing_date_unknown_reason", F.when(F.col("filing_date").isNull(), "null").when(days == 0, "equal").when(days < 0, "negative").otherwise("none"))
    rows = rows.withColumn("gap", F.when(F.col("filing_date_unknown_reason") == "none", days))
    rows = rows.withColumn("widest_gap", F.max("gap").over(W.partitionBy("ticker")))
    return rows.withColumn("filing_date_effective", F.when(F.col("gap").isNotNull(), F.col("filing_date")).otherwise(F.expr("date_add(period_end, widest_gap)")))


def filing_quality(resolved: DataFrame, share: float = 0.25, widest: int = 180) -> DataFrame:
    """One row: periods, substituted periods, tickers whose widest gap exceeds ``widest`` days, and whether either is too much."""
    one = resolved.groupBy("ticker").agg(F.count("*").alias("n"), F.count_if(F.col("gap").isNull() & F.col("filing_date_effective").isNotNull()).alias("s"), F.max("widest_gap").alias("w"))
    total = one.agg(F.sum("n").alias("periods"), F.sum("s").alias("substituted"), F.count_if(F.col("w") > widest).alias("wide_tickers"))
    return total.withColumn("alert", (F.col("substituted") > F.col("periods") * share) | (F.col("wide_tickers") > 0))


def readable_at(filings: DataFrame, day) -> DataFrame:
    """Filings effective by the day, each ticker's newest period first as rank 1."""
    seen = filings.filter(F.col("filing_date_effective") <= F.lit(day).cast("date"))
    return seen.withColumn("rank", F.row_number().over(W.partitionBy("ticker").orderBy(F.desc("period_end"))))
