"""Model tables derived from a star schema of suppliers, orders and events, so that operators run at any scale."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitframe.plans.stages import stage

SPLIT = "1998-07-01"


class Tables:
    """The model tables over one folder of Parquet tables, each built when asked for; what ``keep`` is given is built once."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.kept: dict[str, DataFrame] = {}
        self._suppliers: int | None = None

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    def keep(self, name: str, build) -> DataFrame:
        """A stage table: written when first asked for, read after that."""
        if name not in self.kept:
            self.kept[name] = stage(build(), name)
        return self.kept[name]

    def suppliers(self) -> int:
        if self._suppliers is None:
            self._suppliers = self.read("supplier").count()
        return self._suppliers

    def prices(self) -> DataFrame:
        """The daily bars as a stage table, for queries that read them more than once."""
        return self.keep("price_daily", self.price_daily)

    def price_daily(self) -> DataFrame:
        """One bar a ticker and date, raw prices twice the adjusted ones before a two-for-one split."""
        u = (F.lit(100) + F.col("l_extendedprice") / 10000).cast("decimal(20,6)")
        rows = self.read("lineitem").select(F.concat(F.lit("T"), "l_suppkey").alias("ticker"), F.to_date("l_shipdate").alias("date"), u.alias("u"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice").alias("at"), "l_quantity")
        days = rows.groupBy("ticker", "date").agg(F.min_by("u", "at").alias("open"), F.max("u").alias("high"), F.min("u").alias("low"), F.max_by("u", "at").alias("close"), F.sum("l_quantity").cast("long").alias("volume"))
        times = F.when(F.col("date") < SPLIT, 2).otherwise(1)
        return days.select("ticker", "date", *((F.col(c) * times).cast("decimal(20,6)").alias(c) for c in ("open", "high", "low", "close")), F.col("close").alias("adj_close"), "volume")

    def sessions(self) -> DataFrame:
        """Dates with a bar, read from what bars are made of, so that no bar is made for them."""
        return self.keep("sessions", lambda: self.read("lineitem").select(F.to_date("l_shipdate").alias("date")).distinct())

    def benchmark_daily(self) -> DataFrame:
        """Mean adjusted close of all tickers on each date."""
        return self.prices().groupBy("date").agg((F.sum("adj_close").cast("double") / F.count("*")).alias("adj_close"))

    def epochs(self) -> DataFrame:
        """First Sunday of each quarter of the price history, numbered."""
        span = self.read("lineitem").agg(F.min(F.to_date("l_shipdate")).alias("a"), F.max(F.to_date("l_shipdate")).alias("b"))
        quarters = span.select(F.explode(F.expr("sequence(date_trunc('quarter', a), date_trunc('quarter', b), interval 3 months)")).alias("q"))
        days = quarters.select(F.next_day(F.date_sub(F.to_date("q"), 1), "SUN").alias("date"))
        return days.select("date", (F.year("date") * 4 + F.quarter("date")).cast("long").alias("epoch"))

    def security_daily(self) -> DataFrame:
        """Membership of each ticker at each epoch: sector, size bucket, cap, active or not."""
        s, n, r = self.read("supplier"), self.read("nation"), self.read("region")
        named = s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey, "left").join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"), "left")
        # thirds of the range of balances; one aggregate instead of a global sort
        span = s.agg(F.min("s_acctbal").alias("lo"), F.max("s_acctbal").alias("hi"))
        named = named.crossJoin(F.broadcast(span)).select(F.concat(F.lit("T"), "s_suppkey").alias("ticker"), F.col("s_suppkey").alias("k"), F.when(F.col("s_suppkey") % 11 != 0, F.col("r_name")).alias("sector"), F.when(F.col("s_acctbal") >= F.col("lo") + (F.col("hi") - F.col("lo")) * 2 / 3, "large").when(F.col("s_acctbal") >= F.col("lo") + (F.col("hi") - F.col("lo")) / 3, "mid").otherwise("small").alias("size_bucket"), (F.col("s_acctbal") * 1000000).alias("market_cap"))
        rows = named.crossJoin(F.broadcast(self.epochs()))
        active = (F.col("k") + F.col("epoch")) % 9 != 0
        return rows.select("ticker", "date", *(F.when(active, F.col(c)).alias(c) for c in ("sector", "size_bucket", "market_cap")), active.alias("is_active"))

    #: amount -> hundredths of the quarter's revenue
    AMOUNTS = {"cost_of_revenue": 60, "ebit": 18, "ebitda": 24, "net_income": 11, "operating_cash": 16, "capex": 5, "tax": 3, "pretax": 15, "total_assets": 420, "current_liabilities": 60, "goodwill": 30, "intangibles": 20, "total_debt": 130, "cash_eq": 35, "short_term_inv": 12, "investing_cash": -7}

    def raw_filings(self) -> DataFrame:
        """Quarterly statements with their filing dates as given; some dates are missing, equal to the period end or before it."""
        n = self.suppliers()
        o = self.read("orders")
        end = F.last_day(F.add_months(F.trunc(F.to_date("o_orderdate"), "quarter"), 2))
        g = o.groupBy((1 + F.col("o_custkey") % n).alias("k"), end.alias("period_end")).agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"), F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).alias("f"), F.count("*").alias("c"))
        q = (F.year("period_end") * 4 + F.quarter("period_end")).cast("long")
        x = F.col("k") + q
        filed = F.expr("date_add(period_end, cast(20 + (k * 7 + year(period_end) * 4 + quarter(period_end)) % 60 as int))")
        filing = F.when(x % 11 == 0, F.lit(None).cast("date")).when(x % 13 == 0, F.col("period_end")).when(x % 17 == 0, F.date_sub("period_end", 3)).otherwise(filed)
        amount = lambda p: (F.expr(f"(cents * ({p} + f * 100 div c div 10)) div 100") / 100).cast("double")
        reported = F.when(F.col("f") % 5 == 0, F.lit(None).cast("double"))
        return g.select(F.concat(F.lit("T"), "k").alias("ticker"), "period_end", filing.alias("filing_date"), F.when(x % 7 != 0, F.concat(F.lit("S"), (F.col("k") % 5).cast("string"))).alias("sector"), (F.col("cents") / 100).alias("total_revenue"), *(amount(p).alias(a) for a, p in self.AMOUNTS.items()), reported.otherwise(amount(40)).alias("gross_profit"), reported.otherwise(amount(80)).alias("net_debt"), F.when(x % 19 != 0, (1000000 + F.col("k") * 1000 + q * 10).cast("double")).alias("shares"))

    def fundamental_snapshot(self) -> DataFrame:
        from pitframe.operators.filings import resolve_filing_dates

        return resolve_filing_dates(self.raw_filings())

    def earnings_history(self) -> DataFrame:
        f = self.raw_filings()
        surprise = ((F.col("cents100") % 41 - 20) / 100).cast("double")
        rows = f.select("ticker", "period_end", F.col("filing_date").alias("report_date"), F.round(F.col("total_revenue") * 100).cast("long").alias("cents100"))
        return rows.select("ticker", "period_end", "report_date", F.when(F.col("cents100") % 7 != 0, surprise).alias("surprise_fraction"))

    def insider_transaction(self) -> DataFrame:
        n = self.suppliers()
        e = self.read("events")
        day = F.to_date("ts")
        code = F.when(F.col("event_type") == "purchase", "P").when(F.col("event_type") == "error", "S").when(F.col("event_type") == "signup", "M").otherwise("A")
        price = F.get_json_object("props", "$.k").cast("double")
        shares = (F.col("event_id") % 100 + 1).cast("double")
        return e.select(
            F.concat(F.lit("T"), 1 + F.col("user_id") % n).alias("ticker"), F.col("event_id").alias("accession_number"), F.expr("date_add(to_date(ts), cast(event_id % 5 as int))").alias("filed_at"), day.alias("transaction_date"),
            F.when(F.col("event_id") % 89 != 0, F.concat(F.lit("O"), F.col("user_id") % 37)).alias("owner"), code.alias("transaction_code"), F.when(F.col("event_type") == "error", "D").otherwise("A").alias("acquired_or_disposed"), shares.alias("shares_amount"),
            F.when(F.col("event_id") % 97 != 0, price).alias("price_per_share"), F.when(F.col("event_id") % 3 != 0, shares * price).alias("total_value"),
        )

    def institutional_holding(self) -> DataFrame:
        p = self.read("part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
        end = F.last_day(F.add_months(F.trunc(F.to_date("l_shipdate"), "quarter"), 2))
        g = self.read("lineitem").join(p, "l_partkey").groupBy("l_suppkey", end.alias("report_date"), F.col("p_brand").alias("holder_name")).agg(F.sum("l_quantity").alias("q"))
        unknown = (F.col("l_suppkey") + F.year("report_date") * 4 + F.quarter("report_date")) % 13 == 0
        return g.select(F.concat(F.lit("T"), "l_suppkey").alias("ticker"), "report_date", "holder_name", F.when(~unknown, F.col("q")).alias("shares"))

    def sentiment_daily(self) -> DataFrame:
        n = self.suppliers()
        g = self.read("events").groupBy((1 + F.col("user_id") % n).alias("k"), F.to_date("ts").alias("date")).agg(F.count("*").alias("c"), F.sum(F.round(F.col("value") * 1000).cast("long")).alias("v"))
        hidden = (F.dayofmonth("date") % 29 == 0) & (F.col("k") % 2 == 1)
        return g.select(F.concat(F.lit("T"), "k").alias("ticker"), "date", F.when(~hidden, F.col("c")).alias("article_count"), (F.col("v") / F.col("c") / 1000000).alias("sentiment_score"))

    def events_calendar(self) -> DataFrame:
        earnings = self.raw_filings().filter("filing_date is not null").select("ticker", F.lit("earnings").alias("event_type"), F.col("filing_date").alias("event_date"))
        splits = self.read("supplier").select(F.concat(F.lit("T"), "s_suppkey").alias("ticker"), F.lit("split").alias("event_type"), F.lit(SPLIT).cast("date").alias("event_date"))
        return earnings.distinct().unionByName(splits)

    def _trades(self) -> DataFrame:
        n = self.suppliers()
        o = self.read("orders")
        return o.select(F.concat(F.lit("T"), 1 + F.col("o_custkey") % n).alias("ticker"), F.col("o_orderkey").alias("trade_id"), "o_orderstatus", F.to_date("o_orderdate").alias("opened"), F.date_add(F.to_date("o_orderdate"), 2).alias("closed"))

    def position(self) -> DataFrame:
        return self._trades().filter("o_orderstatus = 'O'").select("ticker", "trade_id", "opened", "closed")

    def trade_outcome(self) -> DataFrame:
        return self._trades().filter("o_orderstatus = 'F'").select("ticker", "trade_id", F.col("closed").alias("exit_date"))

    def headline(self) -> DataFrame:
        n = self.suppliers()
        d = self.read("documents")
        return d.select(F.concat(F.lit("T"), 1 + F.col("doc_id") % n).alias("ticker"), F.col("doc_id").alias("article_id"), F.when(F.col("doc_id") % 19 != 0, F.expr("date_sub(date'2024-01-30', cast(doc_id % 12 as int))")).alias("published_at"), F.substring("text", 1, 40).alias("title"), "source", F.col("text").alias("content"))


_S1 = '[{"metric": "dist_200dma", "direction": "high", "weight": %d}, {"metric": "median_dollar_volume_20d", "direction": "high", "weight": %d}, {"metric": "ma50_200_slope", "direction": "high", "weight": 1}]'
_S2 = '[{"metric": "dist_52w_high", "direction": "low", "weight": 1}, {"metric": "dist_200dma", "direction": "low", "weight": 1}, {"metric": "base_breakout_flag", "kind": "bonus", "points": 10}]'
#: Settings with versions: key, version, value, set at (UTC). Several change within the price history, small enough that small tables still rank and gate.
CONFIG = [
    *((key, 1, value, "1994-01-01 12:00:00") for key, value in {
        "gate.gap": "0.08", "gate.cooldown": "30", "gate.blackout_before": "5", "gate.blackout_after": "2", "screens.floor_lookback_days": "20", "screens.floor_percentile": "70", "tuner.slot_floor": "4", "tuner.slot_cap": "12",
        "screens.S1.state": "live", "screens.S1.metrics": _S1 % (2, 1), "screens.S1.min_inputs": "2", "screens.S1.slots": "6", "screens.S2.state": "live", "screens.S2.metrics": _S2, "screens.S2.min_inputs": "2", "screens.S2.slots": "4",
        "screens.S3.state": "retired", "screens.S3.metrics": _S2, "screens.S3.min_inputs": "1", "screens.S3.slots": "4", "news.rates": '{"small": {"input": 1.0, "output": 5.0}, "large": {"input": 3.0, "output": 15.0}}',
    }.items()),
    ("gate.gap", 2, "0.05", "1998-01-01 03:00:00"), ("gate.gap", 3, "0.06", "1999-06-01 12:00:00"), ("gate.cooldown", 2, "2", "1996-01-01 12:00:00"), ("gate.blackout_after", 2, "1", "2000-06-01 12:00:00"),
    ("screens.floor_lookback_days", 2, "15", "2000-01-03 12:00:00"), ("screens.floor_percentile", 2, "60", "1999-03-01 12:00:00"), ("screens.S1.metrics", 2, _S1 % (1, 3), "2000-03-01 12:00:00"), ("screens.S1.slots", 2, "9", "1999-09-01 12:00:00"),
    ("screens.S2.state", 2, "shadow", "1999-01-01 04:30:00"), ("news.rates", 2, '{"small": {"input": 0.5, "output": 2.0}}', "2000-01-01 12:00:00"),
]


def config_rows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CONFIG, "key string, version int, value string, set_at string").withColumn("set_at", F.to_timestamp("set_at"))
