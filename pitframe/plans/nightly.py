"""One night over stored stages (D18, F6, G4, H5, I6, J9): each step reads its look-back by partition and writes the night's date only.

The same operators compute a range and a night; here their inputs are the partitions that a night can see, and their
output replaces one date of a stored table. Names that trade on few days need a longer look-back in days for the same
number of bars: the bars of those that have fewer than ``need`` within ``days``, or none, are read further back, and only theirs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitframe.operators import asof, flow, market, percentile, screens, sectors, sentiment, technical

from .stored import Stored

#: Bars behind the longest indicator, and the days that hold them for a name that trades daily.
NEED, DAYS = 272, 420


def trailing_bars(prices: Stored, day: str, need: int = NEED, days: int = DAYS) -> DataFrame:
    """Bars up to the day: ``days`` days of all names, and the whole history of those that have had fewer than ``need`` bars in them, or none."""
    first = F.date_sub(F.lit(day).cast("date"), days)
    far = prices.rows().filter((F.col("part") <= prices.part_of(first)) & (F.col("date") < first)).drop("part")
    return asof.with_history(prices.look_back(day, days), far, need)


@dataclass
class Night:
    """The stored tables of one night: prices, security, benchmark, filings and so on come in; stages go out by name."""

    day: str
    prices: Stored
    security: DataFrame
    stages: dict[str, Stored]

    def date(self) -> DataFrame:
        return self.prices.spark.createDataFrame([(self.day,)], "d string").select(F.to_date("d").alias("date"))

    def known(self, df: DataFrame, date: str = "date") -> DataFrame:
        return df.filter(F.col(date) <= F.lit(self.day).cast("date"))

    def members(self) -> DataFrame:
        return asof.range_members(self.known(self.security), self.date())

    def _put(self, stage: str, rows: DataFrame) -> Stored:
        table = self.stages[stage]
        table.replace(rows.filter(F.col("date") == F.lit(self.day).cast("date")).select(*table.schema.fieldNames()), self.date())
        return table

    def of(self, stage: str) -> DataFrame:
        """The night's rows of a stage."""
        return self.stages[stage].look_back(self.day, 0)

    def indicators(self, benchmark: DataFrame, minimum: int) -> Stored:
        """Indicators of the members, carried forward from their last bar."""
        bars, own = trailing_bars(self.prices, self.day), self.known(self.security)
        per_bar = technical.indicators(bars, self.known(benchmark)).join(technical.wilder(bars), ["ticker", "date"])
        names = [m for m in percentile.REGISTRY["indicator_daily"] if m != "rs_change_vs_sector"]
        rows = technical.carry_forward(self.members(), per_bar, [*names, "base_breakout_flag"])
        relative = sectors.relative_to_sector(bars, own, self.members(), sectors.sector_composite(bars, own, minimum))
        return self._put("indicator_daily", rows.join(relative, ["ticker", "date"], "left"))

    def flow(self, filings: DataFrame, holdings: DataFrame) -> Stored:
        """F6."""
        return self._put("flow_daily", flow.flow(self.known(filings, "filed_at"), self.known(holdings, "report_date"), self.date()))

    def sentiment(self, daily: Stored, min_days: int = 20) -> Stored:
        """The 90 days before the night."""
        return self._put("sentiment_derived_daily", sentiment.sentiment(daily.look_back(self.day, 90), self.members(), min_days=min_days))

    def market(self, benchmark: DataFrame, minimum: int) -> Stored:
        """H5 from the night's indicators and the bars that its members look back on."""
        strength = sectors.sector_strength(trailing_bars(self.prices, self.day), self.known(self.security), self.date(), minimum)
        return self._put("market_context_daily", market.market_context(self.of("indicator_daily"), self.known(benchmark), strength))

    def percentiles(self, metrics: list[str], floor: int) -> Stored:
        """Only the night's date is ranked."""
        return self._put("percentile_daily", percentile.percentiles(self.of("indicator_daily"), metrics, floor))

    def scores(self, on: DataFrame, metrics: list[str], flags: list[str]) -> Stored:
        """J3 of the night under the definitions in force on it."""
        return self._put("screen_score_daily", screens.scores_on(self.of("percentile_daily"), self.known(on), metrics, flags))

    def floors(self, lookback: int, quantile: float, days: int) -> DataFrame:
        """J6 of the night from the stored scores of the last ``days`` days, which must hold ``lookback`` scored dates."""
        rows = screens.floors(self.stages["screen_score_daily"].look_back(self.day, days), lookback, quantile)
        return rows.filter(F.col("date") == F.lit(self.day).cast("date"))
