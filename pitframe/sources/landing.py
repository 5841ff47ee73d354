"""Landed responses made from the model tables, as a vendor would send them: input of the flatten jobs at any scale.

Each frame is (ticker, request_date, body). Bodies also hold what vendors send and nobody wants: elements of the wrong kind,
numbers in quotes, repeated entries, names outside the universe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .flatten import BLOCKS

DAY = "2002-01-02"


def _array(*parts: Column) -> Column:
    return F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))


def _landed(df: DataFrame, ticker: Column, day: Column, body: Column) -> DataFrame:
    return df.select(ticker.alias("ticker"), day.cast("date").alias("request_date"), body.alias("body"))


def _bar(*first: Column) -> Column:
    return F.to_json(F.struct(*first, F.col("date").cast("string").alias("date"), "open", "high", "low", "close", F.col("adj_close").alias("adjusted_close"), "volume"))


def bulk_prices(prices: DataFrame) -> DataFrame:
    """One response a date."""
    rows = prices.groupBy("date").agg(F.collect_list(_bar(F.col("ticker").alias("code"), F.lit("US").alias("exchange_short_name"))).alias("x"))
    return _landed(rows, F.lit(None).cast("string"), F.col("date"), _array(F.col("x")))


def price_series(prices: DataFrame) -> DataFrame:
    """One response a ticker, with a number and a null among its bars."""
    rows = prices.groupBy("ticker").agg(F.collect_list(_bar()).alias("x"))
    return _landed(rows, F.col("ticker"), F.lit(DAY), _array(F.lit("7"), F.col("x"), F.lit("null")))


def fundamentals(filings: DataFrame, earnings: DataFrame, holdings: DataFrame) -> DataFrame:
    """One response a ticker: sector, three statement blocks (cash flow quoted), earnings with an undated repeat, holders with a smaller repeat."""
    blocks = []
    for block, fields in BLOCKS.items():
        known = {f: c for f, c in fields.items() if c in filings.columns}
        value = lambda c, block=block: F.col(c).cast("decimal(28,4)").cast("string" if block == "Cash_Flow" else "decimal(28,4)")
        blocks.append(F.map_from_entries(F.collect_list(F.struct(F.col("period_end").cast("string"), F.struct(F.col("filing_date").cast("string").alias("filing_date"), *(value(c).alias(f) for f, c in known.items()))))).alias(block))
    a = filings.groupBy("ticker").agg(F.max("sector").alias("sector"), *blocks)
    entry = F.struct(F.col("period_end").cast("string").alias("date"), F.col("report_date").cast("string").alias("reportDate"), F.round(F.col("surprise_fraction") * 100).cast("int").alias("surprisePercent"))
    again = F.struct(F.col("period_end").cast("string").alias("date"), F.lit(None).cast("string").alias("reportDate"), F.lit(99).alias("surprisePercent"))
    e = earnings.groupBy("ticker").agg(F.map_from_entries(F.concat(F.collect_list(F.struct(F.concat(F.lit("a"), F.col("period_end").cast("string")), entry)), F.collect_list(F.when(F.month("period_end") == 6, F.struct(F.concat(F.lit("b"), F.col("period_end").cast("string")), again))))).alias("History"))
    holder = lambda share: F.struct(F.col("holder_name").alias("name"), F.col("report_date").cast("string").alias("date"), share.alias("currentShares"))
    h = holdings.groupBy("ticker").agg(F.concat(F.collect_list(holder(F.col("shares"))), F.collect_list(F.when(F.month("report_date") == 9, holder(F.col("shares") - 1)))).alias("h"))
    h = h.select("ticker", F.map_from_entries(F.transform("h", lambda x, i: F.struct(i.cast("string"), x))).alias("Institutions"))
    rows = a.join(e, "ticker", "left").join(h, "ticker", "left")
    body = F.struct(F.struct(F.col("sector").alias("Sector")).alias("General"), F.struct(*(F.struct(F.col(b).alias("quarterly")).alias(b) for b in BLOCKS)).alias("Financials"), F.struct("History").alias("Earnings"), F.struct("Institutions").alias("Holders"))
    return _landed(rows, F.col("ticker"), F.lit(DAY), F.to_json(body))


def insiders(transactions: DataFrame) -> DataFrame:
    """One response a ticker: each filing with a line of either side, whose owner has a CIK or else a name; the derivative side begins with a number, which counts as a place."""
    line = F.struct(F.col("transaction_date").cast("string").alias("transaction_date"), "transaction_code", F.when(F.col("accession_number") % 2 == 0, F.col("owner")).alias("reporting_owner_cik"), F.when(F.col("accession_number") % 2 == 1, F.col("owner")).when(F.col("owner").isNotNull(), "other").alias("reporting_owner_name"), "acquired_or_disposed", *(F.col(c).cast("string").alias(c) for c in ("shares_amount", "price_per_share", "total_value")))
    side = F.to_json(F.array(line))
    plain = F.col("acquired_or_disposed") == "A"
    filing = F.concat(F.lit('{"accession_number":"'), F.col("accession_number").cast("string"), F.lit('","filed_at":"'), F.col("filed_at").cast("string"), F.lit('T10:00:00Z","non_derivative":'), F.when(plain, side).otherwise("[]"), F.lit(',"derivative":'), F.when(plain, "[]").otherwise(F.concat(F.lit("[3,"), F.substr(side, F.lit(2)))), F.lit("}"))
    rows = transactions.groupBy("ticker").agg(F.collect_list(filing).alias("x"))
    return _landed(rows, F.col("ticker"), F.lit(DAY), _array(F.lit('"text"'), F.col("x")))


def sentiment(daily: DataFrame) -> DataFrame:
    """One response a date: an object of tickers to days."""
    day = F.array(F.struct(F.col("date").cast("string").alias("date"), F.col("article_count").alias("count"), F.col("sentiment_score").alias("normalized")))
    rows = daily.groupBy("date").agg(F.map_from_entries(F.collect_list(F.struct("ticker", day))).alias("x"))
    return _landed(rows, F.lit(None).cast("string"), F.col("date"), F.to_json("x"))


def calendar(events: DataFrame) -> DataFrame:
    """One response a month of earnings, with one name outside any universe."""
    entry = F.to_json(F.struct(F.col("ticker").alias("code"), F.col("event_date").cast("string").alias("report_date")))
    rows = events.filter("event_type = 'earnings'").groupBy(F.trunc("event_date", "month").alias("m")).agg(F.collect_list(entry).alias("x"))
    return _landed(rows, F.lit(None).cast("string"), F.col("m"), F.concat(F.lit('{"earnings":'), _array(F.lit('{"code":"ZZZ","report_date":"2000-01-01"}'), F.col("x")), F.lit("}")))


def bulk_actions(events: DataFrame) -> DataFrame:
    """One response a date of splits, keyed by code and exchange."""
    entry = F.to_json(F.struct(F.regexp_replace("ticker", "^T", "").alias("code"), F.lit("T").alias("exchange"), F.col("event_date").cast("string").alias("date"), F.date_sub("event_date", 9).cast("string").alias("declarationDate")))
    rows = events.filter("event_type = 'split'").groupBy("event_date").agg(F.collect_list(entry).alias("x"))
    return _landed(rows, F.lit(None).cast("string"), F.col("event_date"), _array(F.col("x"), F.lit("5")))


def ticker_actions(events: DataFrame) -> DataFrame:
    """One response a ticker of splits."""
    entry = F.to_json(F.struct(F.col("event_date").cast("string").alias("date"), F.lit("1999-01-01").alias("declarationDate")))
    rows = events.filter("event_type = 'split'").groupBy("ticker").agg(F.collect_list(entry).alias("x"))
    return _landed(rows, F.col("ticker"), F.lit(DAY), _array(F.col("x")))


def news(articles: DataFrame) -> DataFrame:
    """One response a ticker; instants carry an offset."""
    entry = F.to_json(F.struct(F.concat(F.col("published_at").cast("string"), F.lit("T01:30:00+02:00")).alias("date"), "title", F.col("source").alias("link"), "content"))
    rows = articles.groupBy("ticker").agg(F.collect_list(entry).alias("x"))
    return _landed(rows, F.col("ticker"), F.lit(DAY), _array(F.col("x"), F.lit("[]")))


def symbols(suppliers: DataFrame) -> DataFrame:
    """One response: the whole list, funds among it, names missing, one code twice."""
    k = F.col("s_suppkey")
    entry = F.to_json(F.struct(F.when(k % 29 != 0, F.concat(F.lit("T"), k)).alias("Code"), F.when(k % 17 == 0, "Fund").otherwise("Common Stock").alias("Type"), F.when(k % 5 != 0, F.col("s_name")).alias("Name")))
    rows = suppliers.agg(F.sort_array(F.collect_list(entry)).alias("x"))
    return _landed(rows, F.lit(None).cast("string"), F.lit(DAY), _array(F.col("x")))


def exchange(prices: DataFrame) -> DataFrame:
    """One response: weekdays, and as holidays the weekdays of the history on which nothing traded."""
    span = prices.agg(F.min("date").alias("a"), F.max("date").alias("b"))
    every = span.select(F.explode(F.sequence("a", "b")).alias("date")).filter("weekday(date) < 5")
    rows = every.join(prices.select("date").distinct(), "date", "left_anti").agg(F.map_from_entries(F.collect_list(F.struct(F.col("date").cast("string"), F.struct(F.col("date").cast("string").alias("Date"))))).alias("h"))
    return _landed(rows, F.lit(None).cast("string"), F.lit(DAY), F.to_json(F.struct(F.struct(F.lit("Mon, Tue,Wed,Thu,Fri").alias("WorkingDays")).alias("TradingHours"), F.col("h").alias("ExchangeHolidays"))))
