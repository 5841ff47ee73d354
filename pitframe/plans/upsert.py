"""Keyed writes (A16-A20): merges of staged rows, idempotent on their key; ``stored`` applies them to partitioned tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(existing: DataFrame, staged: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Staged rows replace ``columns`` of rows with their key and add the others; unwritten columns stay. Nulls are values."""
    if missing := set(keys) - set(staged.columns):
        raise ValueError(f"staged rows lack {sorted(missing)}")
    s = staged.select(*keys, F.struct(*columns).alias("_new"))
    both = existing.join(s, keys, "full")
    # the struct is null only where nothing was staged for the key
    return both.select(*(F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in existing.columns))


def update_columns(existing: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    """Columns of ``values`` set on rows that exist under their key, nulls being values; other rows and other columns stay."""
    own = [c for c in values.columns if c not in keys]
    both = existing.join(values.select(*keys, F.struct(*own).alias("_new")), keys, "left")
    return both.select(*(F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in own else F.col(c) for c in existing.columns))


def insert_absent(existing: DataFrame, staged: DataFrame, keys: list[str]) -> DataFrame:
    """Staged rows whose key is new; standing rows are frozen."""
    return existing.unionByName(staged.join(existing.select(*keys), keys, "left_anti").select(existing.columns))


def replace_dates(existing: DataFrame, staged: DataFrame, dates: DataFrame) -> DataFrame:
    """Rows of these dates go, staged ones come."""
    return existing.join(F.broadcast(dates.select("date").distinct()), "date", "left_anti").select(existing.columns).unionByName(staged)


def coverage(existing: DataFrame, staged: DataFrame) -> DataFrame:
    """(source, covered_from, covered_to) widened by new intervals."""
    return existing.unionByName(staged).groupBy("source").agg(F.min("covered_from").alias("covered_from"), F.max("covered_to").alias("covered_to"))
