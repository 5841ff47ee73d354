"""Column functions over windows and arrays, and small business rules."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def full(agg, value: Column, window: WindowSpec, n: int, last: int = 0) -> Column:
    """The aggregate over the last ``n`` rows, or null unless all of them have a value."""
    frame = window.rowsBetween(last - n + 1, last)
    return F.when(F.count(value).over(frame) == n, agg(value).over(frame))


def normalised_slope(value: Column, at: Column, window: WindowSpec, n: int) -> Column:
    """Slope of a least-squares line through the last ``n`` values, divided by their mean."""
    mean = full(F.avg, value, window, n)
    return F.when(mean != 0, F.when(mean.isNotNull(), F.regr_slope(value, at).over(window.rowsBetween(1 - n, 0))) / mean)


def change(value: Column, window: WindowSpec, n: int) -> Column:
    """Value over that of ``n`` rows ago, less one."""
    return F.try_divide(value, F.lag(value, n).over(window)) - 1


def size_bucket(cap: Column, large: float = 10e9, mid: float = 2e9) -> Column:
    return F.when(cap >= large, "large").when(cap >= mid, "mid").when(cap.isNotNull(), "small")


def regime(breadth: Column, above: Column, high: float = 0.6, low: float = 0.4) -> Column:
    return F.when((breadth >= high) & above, "risk_on").when((breadth <= low) & ~above, "risk_off").otherwise("mixed")


def slot_quota(slots: int) -> dict[str, int]:
    """Seats of each size: a quarter large, half of the rest mid, the remainder small."""
    large = slots // 4
    mid = (slots - large) // 2
    return {"large": large, "mid": mid, "small": slots - large - mid}


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct elements; null if either is null or both are empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)))


def chance_overlap(size: Column, pool: Column) -> Column:
    return F.try_divide(size.cast("double"), 2 * pool - size)


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 3.5)


def whole_keys(batches: Iterator[pa.RecordBatch], key: str, enough: int = 100_000) -> Iterator[list[pa.RecordBatch]]:
    """Batches sorted by ``key``, put together until they hold at least ``enough`` rows with all rows of their keys."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n < enough:
            continue
        last, cut = b[key][-1], b.num_rows - 1  # where the last key, which may go on, begins
        low = 0
        while low < cut:  # rows are sorted, so its own come last
            mid = (low + cut) // 2
            low, cut = (low, mid) if b[key][mid].equals(last) else (mid + 1, cut)
        if not cut and len(held) > 1 and held[-2][key][-1].equals(last):
            continue
        held[-1] = b.slice(0, cut)
        if chunk := [x for x in held if x.num_rows]:
            yield chunk
        held, n = [b.slice(cut)], b.num_rows - cut
    if held:
        yield held
