"""Technical indicators (D1-D18): one row a bar, computed once for all dates, carried forward to sessions by an as-of join."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from pitframe.functions.series import whole_keys


def bars_of_ticker():
    return W.partitionBy("ticker").orderBy("date")


def adjusted(bars: DataFrame) -> DataFrame:
    """Adjusted close, high, low and volume as doubles; a bar whose close is missing or not above zero has no factor, so only its adjusted close."""
    factor = F.when(F.col("close") > 0, F.col("adj_close").cast("double") / F.col("close").cast("double"))
    return bars.select("ticker", "date", F.col("close").cast("double").alias("close"), F.col("volume"), F.col("adj_close").cast("double").alias("c"), (F.col("high").cast("double") * factor).alias("h"), (F.col("low").cast("double") * factor).alias("l"), F.try_divide(F.col("volume").cast("double"), factor).alias("v"), F.row_number().over(bars_of_ticker()).alias("bar"))


def median_dollar_volume(bars: DataFrame, n: int = 20) -> DataFrame:
    """Exact median of close times volume over the last ``n`` bars; bars lacking either are dropped after that."""
    return bars.withColumn("median_dollar_volume_20d", F.percentile(F.col("close").cast("double") * F.col("volume"), 0.5).over(bars_of_ticker().rowsBetween(1 - n, 0)))


#: Indicator to the columns that come from windows, see ``window_columns``.
WINDOWS = {
    "dist_20dma": ["ma20"], "dist_200dma": ["ma200"], "dist_52w_high": ["high252"], "volume_vs_50d_avg": ["v50"], "dist_52w_high_20d_change": ["high252", "dist_before"], "ma50_200_slope": ["ma_slope"], "base_breakout_flag": ["base_high", "base_low"],
    "median_dollar_volume_20d": ["median"], "rs_change_21d": ["ratio_21"], "rs_change_63d": ["ratio_63"], "rs_21d_63d_change": ["ratio_21", "ratio_63"], "rs_20d_slope": ["ratio_slope"],
}
RELATIVE = ("rs_change_21d", "rs_change_63d", "rs_21d_63d_change", "rs_20d_slope")


def indicators(bars: DataFrame, benchmark: DataFrame | None = None, base: int = 60, base_range: float = 0.25, only: list[str] | None = None) -> DataFrame:
    """D5-D15 for every bar: only full windows give a value. ``only`` names the indicators wanted; without it, all.

    Spark adds up each window anew for each row, some 600 additions a bar; here whole columns are added, in the same order, so sums are the same to
    the last bit. Bars are sorted by ticker and date, and some whole tickers are taken at a time.
    """
    names = [n for n in (WINDOWS if only is None else only) if benchmark is not None or n not in RELATIVE]
    wanted = list(dict.fromkeys(w for n in names for w in WINDOWS[n]))
    relative = any(n in RELATIVE for n in names)
    a = adjusted(bars)
    if relative:
        a = a.join(F.broadcast(benchmark.select("date", F.col("adj_close").alias("b"))), "date", "left")  # one row a date
    a = a.select("ticker", "date", F.col("close").cast("double").alias("close"), F.col("volume").cast("double").alias("volume"), "c", "h", "l", "v", F.col("bar").cast("double").alias("bar"), *["b"] * relative)
    kept = ["ticker", "date", "c", "v", *["b"] * relative]
    schema = StructType([*(a.schema[k] for k in kept), *(StructField(w, DoubleType()) for w in wanted)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in whole_keys(batches, "ticker"):
            t = pa.Table.from_batches(chunk).combine_chunks()
            made = window_columns({k: Column(t[k].fill_null(0).to_numpy(), t[k].is_valid().to_numpy()) for k in t.column_names if k not in ("ticker", "date")}, base, wanted)
            yield from pa.Table.from_arrays([*(t[k] for k in kept), *(pa.array(made[w].value, mask=~made[w].there) for w in wanted)], [f.name for f in schema]).to_batches(max_chunksize=20_000)

    a = a.sortWithinPartitions("ticker", "date").mapInArrow(run, schema)
    c, over = F.col("c"), lambda x, y: F.try_divide(x, F.col(y))
    ratio = over(c, "b")
    value = {
        "dist_20dma": lambda: over(c - F.col("ma20"), "ma20"),
        "dist_200dma": lambda: over(c - F.col("ma200"), "ma200"),
        "dist_52w_high": lambda: over(c - F.col("high252"), "high252"),
        "volume_vs_50d_avg": lambda: over(F.col("v"), "v50"),
        "dist_52w_high_20d_change": lambda: over(c - F.col("high252"), "high252") - F.col("dist_before"),
        "ma50_200_slope": lambda: F.col("ma_slope"),
        "base_breakout_flag": lambda: F.when(F.col("base_low") > 0, (F.col("base_high") - F.col("base_low") <= base_range * F.col("base_low")) & (c > F.col("base_high"))),
        "median_dollar_volume_20d": lambda: F.col("median"),
        "rs_change_21d": lambda: over(ratio, "ratio_21") - 1,
        "rs_change_63d": lambda: over(ratio, "ratio_63") - 1,
        "rs_21d_63d_change": lambda: (over(ratio, "ratio_21") - 1) - (over(ratio, "ratio_63") - 1),
        "rs_20d_slope": lambda: F.col("ratio_slope"),
    }
    return a.select("ticker", "date", *(value[n]().alias(n) for n in names))


class Column(NamedTuple):
    """Doubles, and which of them are there; the others are any number."""

    value: np.ndarray
    there: np.ndarray

    def over(self, other: Column) -> Column:
        """Quotient, none where the divisor is zero."""
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            return Column(self.value / other.value, self.there & other.there & (other.value != 0))


def window_columns(of: dict[str, Column], base: int, wanted: list[str]) -> dict[str, Column]:
    """Results of windows over rows sorted by ticker and date, ``bar`` counting from 1 in each ticker."""
    place, size = of["bar"].value.astype(np.int64) - 1, len(of["bar"].value)

    def moved(x: Column, n: int) -> Column:
        value, there = np.zeros(size), np.zeros(size, bool)
        value[n:], there[n:] = x.value[: max(size - n, 0)], x.there[: max(size - n, 0)]
        return Column(value, there & (place >= n))

    def whole(x: Column, n: int) -> np.ndarray:
        seen = np.r_[0, np.cumsum(x.there)]
        out = place >= n - 1
        out[n - 1 :] &= seen[n:] - seen[: max(size + 1 - n, 0)] == n
        return out

    def mean(x: Column, n: int) -> Column:
        total = np.zeros(size)
        for k in range(n if size >= n else 0):
            total[n - 1 :] += x.value[k : size - n + 1 + k]
        return Column(total / n, whole(x, n))

    def extreme(x: Column, n: int, best) -> Column:
        value, width = x.value.copy(), 1
        while width < n:
            step = min(width, n - width)
            value[step:] = best(value[step:], value[:-step].copy())
            width += step
        return Column(value, whole(x, n))

    def slope(x: Column, n: int) -> Column:
        """Least-squares slope over the place of the bar, divided by the mean; sums as Spark's regr_slope makes them."""
        average, there = mean(x, n), whole(x, n)
        m = max(size - n + 1, 0)
        bar_mean, x_mean, both, square = (np.zeros(m) for _ in range(4))
        for k in range(n if m else 0):
            bar, y = of["bar"].value[k : m + k], x.value[k : m + k]
            d, e = bar - bar_mean, y - x_mean
            bar_mean, x_mean = bar_mean + d / (k + 1.0), x_mean + e / (k + 1.0)
            both, square = both + d * (y - x_mean), square + d * (d - d / (k + 1.0))
        out = np.zeros(size)
        with np.errstate(divide="ignore", invalid="ignore"):
            out[n - 1 :] = both / square
        return Column(out, there).over(average)

    def median(x: Column, n: int) -> Column:
        """Of the values that are there among the last ``n``, fewer at the start."""
        padded = np.r_[np.full(n - 1, np.nan), np.where(x.there, x.value, np.nan)]
        rows = np.array(np.lib.stride_tricks.sliding_window_view(padded, n))
        rows[np.arange(n)[None, ::-1] > place[:, None]] = np.nan  # of the ticker before
        seen = np.r_[0, np.cumsum(x.there)]
        count = seen[1:] - seen[np.arange(size) - np.minimum(place, n - 1)]
        rows.sort(axis=1)
        low, high = (rows[np.arange(size), np.maximum(i, 0)] for i in ((count - 1) // 2, count // 2))
        return Column(np.where((count % 2 == 1) | (low == high), low, 0.5 * low + 0.5 * high), count > 0)

    c, h = of["c"], of["h"]
    with np.errstate(invalid="ignore", over="ignore", divide="ignore"):
        less = lambda x, y: Column(x.value - y.value, x.there & y.there)
        ratio = c.over(of["b"]) if "b" in of else None
        make = {
            "ma20": lambda: mean(c, 20), "ma50": lambda: mean(c, 50), "ma200": lambda: mean(c, 200), "v50": lambda: mean(of["v"], 50), "high252": lambda: extreme(h, 252, np.maximum),
            "base_high": lambda: moved(extreme(h, base, np.maximum), 1), "base_low": lambda: moved(extreme(of["l"], base, np.fmin), 1),
            "dist_before": lambda: moved(less(c, top := extreme(h, 252, np.maximum)).over(top), 20), "ma_slope": lambda: slope(mean(c, 50).over(mean(c, 200)), 20),
            "median": lambda: median(Column(of["close"].value * of["volume"].value, of["close"].there & of["volume"].there), 20),
            "ratio_21": lambda: moved(ratio, 21), "ratio_63": lambda: moved(ratio, 63), "ratio_slope": lambda: slope(ratio, 20),
        }
        return {w: make[w]() for w in wanted}


def wilder(bars: DataFrame, warmup: int = 250, n: int = 14) -> DataFrame:
    """(ticker, date, atr_pct, adx14) for every bar.

    Each date starts from the mean of the first ``n`` of its last ``warmup`` true ranges, so the seed moves with the date: the
    dates of a ticker are smoothed together, one step of the recursion for all of them at a time.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        atr, adx = wilder_arrays(*(pdf[k].to_numpy(float) for k in "hlc"), warmup, n)
        return pd.DataFrame({"ticker": pdf["ticker"], "date": pdf["date"], "atr_pct": atr, "adx14": adx})

    return adjusted(bars).select("ticker", "date", "h", "l", "c").groupBy("ticker").applyInPandas(run, "ticker string, date date, atr_pct double, adx14 double")


def wilder_arrays(h: np.ndarray, low: np.ndarray, c: np.ndarray, warmup: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    size = len(c)
    atr_out, adx_out = np.full(size, np.nan), np.full(size, np.nan)
    if size <= warmup:
        return atr_out, adx_out
    before, up, down = c[:-1], h[1:] - h[:-1], low[:-1] - low[1:]
    tr = np.maximum(h[1:] - low[1:], np.maximum(np.abs(h[1:] - before), np.abs(low[1:] - before)))
    plus, minus = np.where((up > down) & (up > 0), up, 0.0), np.where((down > up) & (down > 0), down, 0.0)
    bad = np.isnan(tr) | np.isnan(up) | np.isnan(down)
    tr, plus, minus = (np.where(bad, np.nan, x) for x in (tr, plus, minus))
    view = lambda x: np.lib.stride_tricks.sliding_window_view(x, warmup)
    t, p, m = view(tr), view(plus), view(minus)
    st, sp, sm = (x[:, :n].mean(axis=1) for x in (t, p, m))
    with np.errstate(divide="ignore", invalid="ignore"):

        def dx():
            total = sp / st + sm / st
            return np.where(total > 0, 100 * np.abs(sp - sm) / st / total, 0.0)

        zero, seeds, adx = st == 0, [dx()], None
        for k in range(n, warmup):
            st, sp, sm = ((x * (n - 1) + y[:, k]) / n for x, y in ((st, t), (sp, p), (sm, m)))
            zero |= st == 0
            if adx is None:
                seeds.append(dx())
                if len(seeds) == n:
                    adx = np.mean(seeds, axis=0)
            else:
                adx = (adx * (n - 1) + dx()) / n
        atr_out[warmup:] = np.where(c[warmup:] > 0, st / c[warmup:], np.nan)
        if adx is not None:
            adx_out[warmup:] = np.where(zero, np.nan, adx)
    return atr_out, adx_out


def carry_forward(spine: DataFrame, per_bar: DataFrame, values: list[str]) -> DataFrame:
    """Indicators of members on sessions from their last bar on or before it, traded or not."""
    from .asof import as_of_join

    return as_of_join(spine, per_bar, ["ticker"], values)


__all__ = ["adjusted", "carry_forward", "indicators", "median_dollar_volume", "wilder", "wilder_arrays"]
