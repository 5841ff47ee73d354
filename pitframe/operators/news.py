"""News selection and its cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitframe.functions.series import token_estimate


def in_window(articles: DataFrame, day, days: int = 7) -> DataFrame:
    """Adds in_window: published within the days up to the day; without a date it is not."""
    d = F.lit(day).cast("date")
    return articles.withColumn("in_window", F.coalesce((F.col("published_at") > F.date_sub(d, days)) & (F.col("published_at") <= d), F.lit(False)))


def budgeted(articles: DataFrame, budget: int = 6000) -> DataFrame:
    """Each ticker's newest articles while they fit the token budget; the first is always taken."""
    by = W.partitionBy("ticker").orderBy(F.desc_nulls_last("published_at"), "title", "article_id")
    rows = articles.withColumn("tokens", F.coalesce(token_estimate(F.col("content")), F.lit(0)))
    rows = rows.withColumns({"rn": F.row_number().over(by), "upto": F.sum("tokens").over(by.rowsBetween(W.unboundedPreceding, 0))})
    return rows.filter((F.col("rn") == 1) | (F.col("upto") <= budget))


def rendered(selected: DataFrame) -> DataFrame:
    """One text a ticker from its selected articles, newest first."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct("rn", "title", "content"))), lambda x: F.concat_ws("\n", x["title"], x["content"]))
    return selected.groupBy("ticker").agg(F.array_join(parts, "\n\n").alias("digest_input"), F.sum("tokens").alias("tokens"))


#: Fixed values of 64-bit FNV-1a: both halves of the offset basis, and the prime, 2^40 + 435.
BASIS_HIGH, BASIS_LOW, PRIME_LOW = 0xCBF29CE4, 0x84222325, 435
_HALF = (1 << 32) - 1


def fnv1a64(text: Column) -> Column:
    """FNV-1a of the UTF-8 bytes as a struct of its two halves (high, low), which sorts like the unsigned number; null hashes as the empty text.

    The product wraps at 64 bits in halves of 32: low * 435 carries into high, and 2^40 moves low up by 8 bits there.
    """
    byte = F.regexp_extract_all(F.hex(F.encode(F.coalesce(text, F.lit("")), "UTF-8")), F.lit("(..)"), F.lit(1))

    def step(h: Column, pair: Column) -> Column:
        low = h["low"].bitwiseXOR(F.conv(pair, 16, 10).cast("long"))
        high = h["high"] * PRIME_LOW + F.shiftright(low * PRIME_LOW, 32) + F.shiftleft(low, 8)
        return F.struct(high.bitwiseAND(F.lit(_HALF)).alias("high"), (low * PRIME_LOW).bitwiseAND(F.lit(_HALF)).alias("low"))

    return F.aggregate(byte, F.struct(F.lit(BASIS_HIGH).cast("long").alias("high"), F.lit(BASIS_LOW).cast("long").alias("low")), step)


def rotate(candidates: DataFrame, k: int = 2) -> DataFrame:
    """The ``k`` tickers of each date with the least hash of date and ticker."""
    rows = candidates.select("date", "ticker").distinct().withColumn("hash", fnv1a64(F.concat(F.date_format("date", "yyyy-MM-dd"), "ticker")))
    return rows.withColumn("rn", F.row_number().over(W.partitionBy("date").orderBy("hash", "ticker"))).filter(F.col("rn") <= k)


#: Fixed value: the digest text that says that there was nothing to tell.
NO_MATERIAL_NEWS = "NO MATERIAL NEWS"


def outcome(rows: DataFrame) -> DataFrame:
    """Adds outcome to rows with digest_exists and digest. The text is compared as it is; an empty one is prose."""
    return rows.withColumn("outcome", F.when(~F.coalesce("digest_exists", F.lit(False)), "no_row").when(F.col("digest").isNull(), "no_articles").when(F.col("digest") == NO_MATERIAL_NEWS, "no_material_news").otherwise("prose"))


def token_cost(usage: DataFrame, rates: DataFrame) -> DataFrame:
    """Adds cost to (model, kind, tokens), null tokens being none.

    ``rates`` holds a JSON value {model: {kind: dollars a million tokens}}; a model, or a kind of a model, without rate is an error.
    """
    r = rates.select(F.explode(F.from_json("value", "map<string,map<string,double>>")).alias("model", "kinds")).select("model", F.explode("kinds").alias("kind", "rate"))
    rows = usage.join(F.broadcast(r), ["model", "kind"], "left")
    missing = F.raise_error(F.concat(F.lit("no rate for "), F.coalesce("model", F.lit("null")), F.lit(" "), F.coalesce("kind", F.lit("null"))))
    return rows.select("*", F.when(F.col("rate").isNull(), missing).otherwise(F.coalesce("tokens", F.lit(0)) * F.col("rate") / 1e6).alias("cost"))
