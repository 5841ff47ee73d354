"""Exact repeats of long windows across a corpus: the plan that operators 3 and 9 share.

1. Rows with equal content become one content with a count, so that groups of copies cost one row each.
2. Each window of a content picks its minimiser, the least hash of the short grams inside it. Consecutive windows with one
   minimiser form a run. Equal windows have equal minimisers, so only runs whose minimiser occurs twice can repeat.
3. Such a run travels as one packed string. Equal strings fall together before the shuffle; strings that occur twice are
   repeated throughout, and the distinct strings of a minimiser meet in one bucket, where sorting finds equal windows.
4. The verdicts go back to the places of each string, and from there to their contents and rows.

A minimiser whose runs hold more than ``heavy`` bytes, each content counted once, is no bucket for one task: its windows go to
all tasks, each by a 128-bit digest of itself, and are counted there. The sides of the join on strings are plain
shuffles, so that adaptive execution splits the partition of a frequent string; in the join on minimisers and in the last
one it does not, as their other sides are aggregates. Long texts are read in blocks of ``BLOCK`` symbols. Every step is a join or an aggregate that combines before the shuffle; nothing is dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Bytes of a minimiser's runs above which its windows are counted one by one, over all tasks.
HEAVY = 8 << 20
#: Symbols of a text that are looked at together.
BLOCK = 1 << 17
#: Bytes of distinct strings that are sorted together.
CHUNK = 256_000
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2^64."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def span_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the symbols of each span, equal for equal symbols wherever they stand."""
    up, down = _power(len(symbols) + 1)
    sums = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum((symbols.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return _mix((sums[ends] - sums[starts]) * down[starts])


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of each ``width`` consecutive ones, by running minima within blocks of that width."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    square = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(square, axis=1).ravel()
    behind = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def runs(symbols: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimiser, first window and number of windows of each run of windows that share a minimiser at one place.

    Runs end where blocks of ``BLOCK`` windows end; that cuts a string in two and changes no verdict.
    """
    parts = [(np.zeros(0, np.int64),) * 3]
    for at in range(0, len(symbols) - window + 1, BLOCK):
        part = symbols[at : at + BLOCK + window - 1]
        starts = np.arange(len(part) - gram + 1)
        grams = span_hashes(part, starts, starts + gram)
        # the upper half of the hash, then the place: the first of the least grams, alike in equal windows wherever they stand
        least = window_minima(grams & np.uint64(0xFFFFFFFF00000000) | starts.astype(np.uint64), window - gram + 1)
        first = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
        place = (least[first] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        parts.append((grams[place].view(np.int64), first + at, np.diff(np.append(first, len(least)))))
    return tuple(np.concatenate([p[i] for p in parts]) for i in range(3))


@dataclass(frozen=True)
class Units:
    """How a content is measured: symbols for minimisers, packed strings, repeated windows of strings, and the result."""

    window: int
    gram: int
    #: content -> symbols, and where each begins and ends in bytes (None: one byte each)
    symbols: Callable[[bytes], tuple[np.ndarray, np.ndarray | None, np.ndarray | None]]
    #: content, [(first window, windows)] -> packed strings
    pack: Callable[[bytes, list[tuple[int, int]]], list[bytes]]
    #: packed strings -> for each its repeated windows, as sorted offsets
    repeated: Callable[[list[bytes]], list[np.ndarray]]
    #: content, removed intervals (sorted, apart) -> values of ``columns``
    finish: Callable[[bytes, list[tuple[int, int]], int], tuple]
    columns: str


def digest(x: bytes) -> bytes:
    return hashlib.blake2b(x, digest_size=16).digest()


def merged(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted intervals, with those that overlap or touch put together."""
    out: list[list[int]] = []
    for a, b in sorted(intervals):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def covered(starts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Intervals covered by windows at sorted offsets."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > window)
    return list(zip(starts[np.append(0, cut + 1)].tolist(), (starts[np.append(cut, len(starts) - 1)] + window).tolist(), strict=True))


def _batch(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(types)
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def remove_repeats(docs: DataFrame, units: Units, *, id_col: str = "doc_id", text_col: str = "text", heavy: int = HEAVY, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, the columns in ``carry``, then ``units.columns``) of every row of ``docs``, a null text being empty."""
    common.session(docs)
    # never null, so that no use of the contents gets a filter of its own and one shuffle of the texts serves all
    key = F.coalesce(F.expr("substring(unhex(sha2(content, 256)), 1, 16)"), F.lit(bytearray(b"")))
    own = [F.col(c).alias(f"carried_{c}") for c in carry]
    rows = docs.select(F.col(id_col).alias("id"), *own, F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("content")).withColumn("digest", key)
    contents = rows.groupBy("digest").agg(F.first("content").alias("content"), F.count("*").alias("copies"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, rows = [], 0
            for k, text in enumerate(batch.column("content")):
                symbols, begin, end = units.symbols(text.as_py())
                h, first, n = runs(symbols, units.window, units.gram)
                size = n + (units.window - 1) if begin is None else end[first + n + units.window - 2] - begin[first]
                parts.append((h, np.full(len(h), k), first, n, size))
                rows += len(h)
                if rows > 100_000 or k + 1 == len(batch):
                    h, which, *rest = (np.concatenate([p[i] for p in parts]) for i in range(5))
                    yield pa.record_batch([pa.array(h), batch.column("digest").take(pa.array(which)), *(pa.array(x.astype(np.int32)) for x in rest)], ["h", "digest", "first", "n", "size"])
                    parts, rows = [], 0

    parts = common.partitions(docs.sparkSession)
    found = contents.mapInArrow(find, "h long, digest binary, first int, n int, size int")
    twice = found.groupBy("h").agg(F.count("*").alias("seen"), F.sum("size").alias("bytes")).filter("seen > 1").select("h", (F.col("bytes") > heavy).alias("hot"))
    candidates = found.drop("size").join(twice.repartition(parts, "h"), "h").select("digest", F.struct("first", "n", "h", "hot").alias("run"))
    candidates = candidates.groupBy("digest").agg(F.sort_array(F.collect_list("run")).alias("runs"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h", "sid", "string", "windows", "digest", "first"]
        types = [pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.int32()]
        out: list[tuple] = []
        size = 0
        for batch in batches:
            own = batch.column("runs")
            ends = own.offsets.to_numpy() - own.offsets[0].as_py()
            flat = own.flatten()
            first, n, h, hot = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("first", "n", "h", "hot"))
            for k, (key, text) in enumerate(zip(batch.column("digest"), batch.column("content"), strict=True)):
                key, text, at = key.as_py(), text.as_py(), slice(ends[k], ends[k + 1])
                warm = ~hot[at]
                fs, ns = first[at][warm].tolist(), n[at][warm].tolist()
                for s, x, f, m in zip(units.pack(text, list(zip(fs, ns, strict=True))), h[at][warm].tolist(), fs, ns, strict=True):
                    out.append((x, digest(s), s, m, key, f))
                    size += 200 + len(s)
                    if size > 8 << 20:
                        yield _batch(out, types, names)
                        out, size = [], 0
                if hot[at].any():
                    single = [(f, 1) for a, m in zip(first[at][~warm].tolist(), n[at][~warm].tolist(), strict=True) for f in range(a, a + m)]
                    for s, (f, _) in zip(units.pack(text, single), single, strict=True):
                        out.append((None, digest(s), None, 1, key, f))
                        size += 200
                        if size > 8 << 20:
                            yield _batch(out, types, names)
                            out, size = [], 0
        if out:
            yield _batch(out, types, names)

    strings = contents.join(candidates, "digest").mapInArrow(pack, "h long, sid binary, string binary, windows int, digest binary, first int")
    distinct = strings.filter("string is not null").groupBy("h", "sid").agg(F.first("string").alias("string"), F.first("windows").alias("windows"), F.count("*").alias("seen"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def judge() -> pa.RecordBatch:
            out = [(sid, *zip(*covered(at, units.window), strict=True)) if len(at) else None for (_, sid, _, seen), at in zip(held, units.repeated([x[2] for x in held]), strict=True) if seen == 1]
            return _batch([x for x in out if x], [pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32())], ["sid", "a", "b"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("h", "sid", "string", "seen")), strict=True):
                if size > CHUNK and row[0] != held[-1][0]:  # only between minimisers
                    yield judge()
                    held, size = [], 0
                held.append(row)
                size += len(row[2])
        if held:
            yield judge()

    bucketed = distinct.select("h", "sid", "string", "seen").repartition(parts, "h").sortWithinPartitions("h")
    partly = bucketed.mapInArrow(meet, "sid binary, a array<int>, b array<int>")
    wholly = distinct.filter("seen > 1").select("sid", F.array(F.lit(0)).alias("a"), F.array(F.col("windows") + (units.window - 1)).alias("b"))
    counted = strings.filter("string is null").groupBy("sid").agg(F.count("*").alias("seen")).filter("seen > 1").select("sid", F.array(F.lit(0)).alias("a"), F.array(F.lit(units.window)).alias("b"))
    verdicts = partly.unionByName(wholly).unionByName(counted)
    removed = strings.select("sid", "digest", "first").join(verdicts, "sid")
    removed = removed.groupBy("digest").agg(F.collect_list("first").alias("firsts"), F.collect_list("a").alias("a"), F.collect_list("b").alias("b"))

    names = [c.split()[0] for c in units.columns.split(",")]
    kinds = {"long": pa.int64(), "string": pa.string()}
    types = [kinds[c.split()[1]] for c in units.columns.split(",")]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, copies, firsts, a, b in zip(*(batch.column(c) for c in ("content", "copies", "firsts", "a", "b")), strict=True):
                firsts, a, b = (x.as_py() or [] for x in (firsts, a, b))
                gone = [(f + x, f + y) for f, xs, ys in zip(firsts, a, b, strict=True) for x, y in zip(xs, ys, strict=True)]
                out.append(units.finish(text.as_py(), merged(gone), copies.as_py()))
            yield pa.record_batch([batch.column("digest"), *(pa.array([r[i] for r in out], t) for i, t in enumerate(types))], ["digest", *names])

    done = contents.join(removed, "digest", "left").mapInArrow(finish, f"digest binary, {units.columns}")
    back = [F.col(f"carried_{c}").alias(c) for c in carry]
    return rows.drop("content").join(done, "digest").select(F.col("id").alias(id_col), *back, *names)
