"""Cross-sectional percentiles within size and sector cells (I1-I6). Date is in every key, so a range is one job."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from pitframe.functions.series import whole_keys

CELL, BUCKET = ["date", "size_bucket", "sector"], ["date", "size_bucket"]


#: The metrics that are ranked, by the table they are on. Fixed values.
REGISTRY = {
    "indicator_daily": ["atr_pct", "adx14", "dist_20dma", "dist_200dma", "dist_52w_high", "dist_52w_high_20d_change", "rs_change_21d", "rs_change_63d", "rs_21d_63d_change", "rs_20d_slope", "rs_change_vs_sector", "volume_vs_50d_avg", "ma50_200_slope", "median_dollar_volume_20d"],
    "valuation_daily": ["fcf_yield", "ev_ebit", "ev_ebit_vs_own_5y", "roic", "roic_4q_change", "gross_margin_4q_change", "net_debt_ebitda", "accruals", "share_count_change", "revenue_growth_4q_trend"],
    "flow_daily": ["insider_net_90d_usd", "distinct_buyer_count", "inst_ownership_change"],
    "sentiment_derived_daily": ["article_count_z_own_90d", "sentiment_delta_7v30", "sentiment_7d_level"],
}


def long_percentiles(rows: DataFrame, metrics: list[str], floor: int = 15) -> DataFrame:
    """I2, I3 as one row a metric that has a value: (date, ticker, size_bucket, sector, metric, value, pctile, scope).

    All metrics share one shuffle, by date, size and metric, which serves cells and size buckets alike, and one sort for each of the two.
    """
    long = rows.select("date", "ticker", "size_bucket", "sector", F.expr(f"stack({len(metrics)}, {', '.join(f"'{m}', cast({m} as float)" for m in metrics)}) as (metric, value)")).filter("value is not null")
    bucket, cell = W.partitionBy(*BUCKET, "metric"), W.partitionBy(*BUCKET, "metric", "sector")
    long = long.withColumns({"_bn": F.count("value").over(bucket), "_br": F.rank().over(bucket.orderBy("value"))}).withColumns({"_cn": F.count("value").over(cell), "_cr": F.rank().over(cell.orderBy("value"))})
    known = F.col("size_bucket").isNotNull()
    scope = F.when(known & F.col("sector").isNotNull() & (F.col("_cn") >= floor), "cell").when(known & (F.col("_bn") >= floor), "bucket").when(known, "none")
    share = lambda r, n: F.when(F.col(n) > 1, (F.col(r) - 1) * 100.0 / (F.col(n) - 1)).otherwise(0.0)
    return long.withColumn("scope", scope).select("date", "ticker", "size_bucket", "sector", "metric", "value", F.when(F.col("scope") == "cell", share("_cr", "_cn")).when(F.col("scope") == "bucket", share("_br", "_bn")).alias("pctile"), "scope")


def percentiles(rows: DataFrame, metrics: list[str], floor: int = 15, adds: tuple[str, ...] = ("pctile", "scope")) -> DataFrame:
    """Adds m_pctile, and m_scope (cell, bucket, none), for each metric m of (date, ticker, size_bucket, sector, ...), one row a date and ticker.

    Rows move once, to their date, with all their columns: give it only those that are wanted. Sorted by date, they are ranked some whole dates at a
    time (at least 100,000 rows, or one date), so a task holds no more than that and the next date.
    """
    kinds, wide = dict(rows.dtypes), [(m, a) for m in metrics for a in adds]
    given = rows.select("*", *(F.col(m).cast("float").alias(f"_{m}") for m in metrics if kinds[m] not in ("float", "double")))
    read = {m: m if kinds[m] in ("float", "double") else f"_{m}" for m in metrics}
    columns = rows.columns
    schema = StructType([*rows.schema.fields, *(StructField(f"{m}_{a}", DoubleType() if a == "pctile" else StringType()) for m, a in wide)])
    names = [f.name for f in schema]

    def ranked(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches).combine_chunks()
        cells = Cells(*(_codes(t[c]) for c in CELL), floor)
        made = [cells.ranked(_floats(t[read[m]])) for m in metrics]
        out = [t[c] for c in columns]
        for pctile, scope in made:
            of = {"pctile": lambda x=pctile: pa.array(x, mask=np.isnan(x)), "scope": lambda x=scope: SCOPES.take(pa.array(x, mask=x < 0))}
            out += [of[a]() for a in adds]
        yield from pa.Table.from_arrays(out, names).to_batches(max_chunksize=20_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in whole_keys(batches, "date"):
            yield from ranked(chunk)

    return given.repartition("date").sortWithinPartitions("date").mapInArrow(run, schema)


def percentile_summary(rows: DataFrame, metrics: list[str], floor: int = 15) -> DataFrame:
    """I2, I3 summed up: (date, size_bucket, metric, scope, n, mean, mean_square, first) of the percentiles of each metric, ``first`` the ticker of the
    highest, of equals the last by name.

    A row moves once, to its date, with its values as one array of single floats; ranks are summed up where they are made and never are rows.
    """
    given = rows.select(*CELL, "ticker", F.array(*(F.col(m).cast("float") for m in metrics)).alias("values"))
    types = rows.select("date", "size_bucket", "ticker").schema
    schema = StructType([types["date"], types["size_bucket"], StructField("metric", StringType()), StructField("scope", StringType()), StructField("n", LongType()), StructField("mean", DoubleType()), StructField("mean_square", DoubleType()), StructField("first", types["ticker"].dataType)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in whole_keys(batches, "date"):
            t = pa.Table.from_batches(chunk).combine_chunks()
            cells = Cells(*(_codes(t[c]) for c in CELL), floor)
            flat = pa.chunked_array([x.flatten() for x in t["values"].chunks])
            value, there = (x.reshape(-1, len(metrics)) for x in _floats(flat))
            named = t["ticker"].combine_chunks().dictionary_encode()
            named = named.combine_chunks() if isinstance(named, pa.ChunkedArray) else named
            order = np.empty(len(named.dictionary), np.int64)
            order[pc.sort_indices(named.dictionary).to_numpy()] = np.arange(len(order))
            name = np.where(named.is_valid().to_numpy(zero_copy_only=False), order[named.indices.fill_null(0).to_numpy()], -1) if len(order) else np.full(len(t), -1)
            for k, metric in enumerate(metrics):
                pctile, scope = cells.ranked((np.ascontiguousarray(value[:, k]), np.ascontiguousarray(there[:, k])))
                own = np.flatnonzero(there[:, k])
                if not len(own):
                    continue
                own = own[np.lexsort((scope[own], cells.bucket[own]))]
                start = np.flatnonzero(np.r_[True, (np.diff(cells.bucket[own].astype(np.int64)) != 0) | (np.diff(scope[own]) != 0)])
                n = np.diff(np.r_[start, len(own)])
                x = np.nan_to_num(pctile[own], nan=-1.0)  # a scope has a percentile for all or none
                none = x[start] < 0
                best = np.where(x == np.repeat(np.maximum.reduceat(x, start), n), name[own], -2)
                top = np.flatnonzero(best == np.repeat(np.maximum.reduceat(best, start), n))
                top = own[top[np.searchsorted(top, start)]]
                mean = lambda y: pa.array(np.add.reduceat(y, start) / n, mask=none)  # noqa: B023, E731
                at = pa.array(own[start])
                yield pa.RecordBatch.from_arrays([t["date"].take(at).combine_chunks(), t["size_bucket"].take(at).combine_chunks(), pa.array([metric] * len(start)), SCOPES.take(pa.array(scope[own[start]], mask=scope[own[start]] < 0)), pa.array(n), mean(x), mean(x * x), t["ticker"].take(pa.array(top)).combine_chunks()], [f.name for f in schema])

    return given.repartition("date").sortWithinPartitions("date").mapInArrow(run, schema)


SCOPES = pa.array(["cell", "bucket", "none"])


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """Small whole numbers for values, in the order of their first rows, -1 for null."""
    x = column.combine_chunks().dictionary_encode()
    x = x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
    return x.indices.fill_null(-1).to_numpy().astype(np.int64)


def _floats(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values as single floats, and which of them are there."""
    there = column.is_valid().to_numpy()
    return column.fill_null(0).to_numpy().astype(np.float32), there


class Cells:
    """Cells of rows by date, size and sector, and their buckets by date and size."""

    def __init__(self, date: np.ndarray, size: np.ndarray, sector: np.ndarray, floor: int):
        bucket = date * (int(size.max(initial=0)) + 2) + size + 1
        self.known, self.sectored, self.floor = size >= 0, sector >= 0, floor
        self.bucket, self.cell = (self._small(x) for x in (bucket, bucket * (int(sector.max(initial=0)) + 2) + sector + 1))

    @staticmethod
    def _small(x: np.ndarray) -> np.ndarray:
        """Numbers without gaps, of 16 bits where they fit: these are sorted by counting."""
        kinds = np.flatnonzero(np.bincount(x - x.min())) if len(x) and x.max() - x.min() < 8 * len(x) + 1000 else None
        if kinds is None:
            return np.unique(x, return_inverse=True)[1]
        place = np.zeros(int(x.max() - x.min()) + 1, np.uint16 if len(kinds) < 65536 else np.int64)
        place[kinds] = np.arange(len(kinds))
        return place[x - x.min()]

    @staticmethod
    def _places(order: np.ndarray, v: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank less one, equals sharing the least, and rows of its group, for each of ``order`` (by value), in the order of the values given."""
        own = order[np.argsort(group[order], kind="stable")]
        g, x = group[own], v[own]
        new = np.r_[True, g[1:] != g[:-1]]
        start = np.flatnonzero(new)
        n = np.diff(np.r_[start, len(g)])
        tie = np.r_[True, (x[1:] != x[:-1]) & ~(np.isnan(x[1:]) & np.isnan(x[:-1]))] | new
        at = np.arange(len(g))
        first = np.maximum.accumulate(np.where(tie, at, 0))
        rank, count = np.empty(len(v), np.int64), np.zeros(len(v), np.int64)
        rank[own] = first - np.repeat(start, n)
        count[own] = np.repeat(n, n)
        return rank, count

    def ranked(self, values: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Percentile, NaN for none, and the place of its scope in SCOPES, -1 for none."""
        v, there = values
        out, scope = np.full(len(v), np.nan), np.full(len(v), -1, np.int8)
        rows = np.flatnonzero(there)
        if not len(rows):
            return out, scope
        order = rows[np.argsort(v[rows], kind="stable")]
        (br, bn), (cr, cn) = self._places(order, v, self.bucket), self._places(order, v, self.cell)
        known = there & self.known
        cell = known & self.sectored & (cn >= self.floor)
        bucket = known & ~cell & (bn >= self.floor)
        scope[known], scope[cell], scope[bucket] = 2, 0, 1
        for at, r, n in ((cell, cr, cn), (bucket, br, bn)):
            out[at] = np.where(n[at] > 1, r[at] * 100.0 / np.maximum(n[at] - 1, 1), 0.0)
        return out, scope


def cell_ledger(rows: DataFrame, metrics: list[str], floor: int = 15) -> DataFrame:
    """I4: members of each cell and of its bucket with a value, for each metric, and where the cell is ranked."""
    long = rows.select(*CELL, F.expr(f"stack({len(metrics)}, {', '.join(f"'{m}', {m}" for m in metrics)}) as (metric, value)"))
    cells = long.groupBy(*CELL, "metric").agg(F.count("value").alias("n"))
    cells = cells.withColumn("bucket_members", F.sum("n").over(W.partitionBy(*BUCKET, "metric")))
    known = F.col("sector").isNotNull()
    return cells.select(*CELL, "metric", F.when(known, F.col("n")).alias("cell_members"), "bucket_members", F.lit(floor).alias("floor"), F.when(known & (F.col("n") >= floor), "cell").when(F.col("bucket_members") >= floor, "bucket").otherwise("none").alias("scope"))


def fallback_report(ranked: DataFrame, metrics: list[str]) -> DataFrame:
    """For each metric and date the rows ranked in their cell, in their bucket or not, and the cells that were too thin."""
    long = ranked.select(*CELL, F.expr(f"stack({len(metrics)}, {', '.join(f"'{m}', {m}_scope" for m in metrics)}) as (metric, scope)")).filter("scope is not null")
    of = lambda k: F.count_if(F.col("scope") == k)
    return long.groupBy("date", "metric").agg(of("cell").alias("in_cell"), of("bucket").alias("in_bucket"), of("none").alias("unranked"), F.count_distinct(F.when((F.col("scope") != "cell") & F.col("sector").isNotNull(), F.struct("size_bucket", "sector"))).alias("thin_cells"))
