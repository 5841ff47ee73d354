"""Keyed writes on stored tables (A16-A19), and what one night reads of them.

A stored table is a Parquet folder partitioned by ``part``, the day or the month of the date. A write reads only the
parts that it touches, and overwrites just these: Spark puts new files aside and swaps the partitions when all tasks are
done, so a job that dies leaves the old rows, and parts that are not touched keep their files.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from .stages import stage
from .upsert import insert_absent, replace_dates, update_columns, upsert

GRAINS = {"day": "yyyy-MM-dd", "month": "yyyy-MM"}


@dataclass(frozen=True)
class Stored:
    """A stored table: its folder, the schema of its rows, and whether a partition holds a day or a month."""

    spark: SparkSession
    path: str
    schema: StructType
    grain: str = "day"

    def part_of(self, date: Column) -> Column:
        return F.date_format(date, GRAINS[self.grain])

    def _at(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def rows(self) -> DataFrame:
        """All rows; a table that is not there yet is empty."""
        at, files = self._at(self.path)
        if not files.exists(at):
            return self.spark.createDataFrame([], StructType([*self.schema.fields]).add("part", StringType()))
        return self.spark.read.schema(StructType([*self.schema.fields]).add("part", StringType())).parquet(self.path)

    def read(self) -> DataFrame:
        return self.rows().drop("part")

    def look_back(self, day: str, days: int) -> DataFrame:
        """What one night reads: the ``days`` days up to and with ``day``; partitions that hold none of them are not read."""
        last = F.lit(day).cast("date")
        first = F.date_sub(last, days)
        return self.rows().filter(F.col("part").between(self.part_of(first), self.part_of(last)) & F.col("date").between(first, last)).drop("part")

    def write(self, rows: DataFrame) -> None:
        """The partitions of ``rows`` are overwritten, all others stay; each is written by one task."""
        rows.select(*self.schema.fieldNames()).withColumn("part", self.part_of(F.col("date"))).repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(self.path)

    def _parts(self, rows: DataFrame) -> list[str]:
        return sorted(r.part for r in rows.select(self.part_of(F.col("date")).alias("part")).distinct().collect())

    def _merge(self, staged: DataFrame, merge, keys: list[str] | None = None, dates: DataFrame | None = None) -> list[str]:
        staged = stage(staged, "staged")  # evaluated once, whatever it is made of
        if not staged.filter("date is null").isEmpty():
            raise ValueError("staged rows need a date")
        # a statement may not touch a row twice: which of two staged rows stays would be left to chance
        if keys and (twice := staged.groupBy(*keys).count().filter("count > 1").first()) is not None:
            raise ValueError(f"staged twice: {tuple(twice)[:-1]}")
        parts = self._parts(dates if dates is not None else staged)
        if parts:
            merged = stage(merge(self.rows().filter(F.col("part").isin(parts)).drop("part"), staged), "merged")
            self.write(merged)
            for part in sorted(set(parts) - set(self._parts(merged))):  # an overwrite leaves partitions alone for which nothing is written
                at, files = self._at(f"{self.path}/part={part}")
                files.delete(at, True)
        return parts

    def upsert(self, staged: DataFrame, keys: list[str], columns: list[str]) -> list[str]:
        """Gives the partitions that were rewritten. A second write of the same rows changes no value."""
        if "date" not in keys:
            raise ValueError("the date must be one of the keys")
        return self._merge(staged, lambda old, new: upsert(old, new, keys, columns), keys)

    def update(self, values: DataFrame, keys: list[str]) -> list[str]:
        """Columns set on rows that stand under a staged key; all other rows, of the same date too, keep theirs."""
        return self._merge(values, lambda old, new: update_columns(old, new, keys), keys)

    def insert(self, staged: DataFrame, keys: list[str]) -> list[str]:
        """Rows that stand are frozen."""
        return self._merge(staged, lambda old, new: insert_absent(old, new, keys), keys)

    def replace(self, staged: DataFrame, dates: DataFrame) -> list[str]:
        """All rows of ``dates`` go, staged ones, which must be of these dates, come."""
        stray = staged.select("date").distinct().join(dates.select("date").distinct(), "date", "left_anti").first()
        if stray is not None:
            raise ValueError(f"staged rows of another date: {stray.date}")
        return self._merge(staged, lambda old, new: replace_dates(old, new.select(old.columns), dates), dates=dates)
