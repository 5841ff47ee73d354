"""Target-distribution importance resampling over hashed n-grams (operator 13).

How much likelier a hashed n-gram is among the target texts than among all documents is its gain; a document's weight is
the mean gain of its n-grams, and the highest weights after Gumbel noise are a draw without replacement in proportion to
importance.

Both passes over the texts intern the n-grams of a batch in an open-addressed NumPy table: the XXH64 of an n-gram says
where its probing starts, a slot belongs to the n-gram whose bytes it was claimed for, and equal hashes are settled by
comparing bytes. A slot holds bucket and count, so a bucket is hashed once for each distinct n-gram of a batch. The
first pass sums counts by bucket, the second lets the slot of each occurrence gather its bucket's gain. What reaches the
driver are two arrays of ``buckets`` numbers. Texts of any length go through in parts of ``PART`` occurrences.

The draw needs no global sort: counts by score (whole numbers of a narrow range) say where each score's ranks begin, and
rows are ranked within their score.

Defined cases: null and empty texts have no n-grams and weight 0; a null id is an empty string in the noise and comes
last among equal scores; repeated rows are drawn one by one, as in any table with repeated ids; without target texts or without documents the
gains are those of the smoothing alone; an empty table gives no rows; columns other than id and text are not carried.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

#: Only A-Z is lower-cased; every other ASCII character that is neither lower-case letter nor digit parts words.
PARTS = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))
#: Occurrences that one table interns.
PART = 1 << 17


class Grams:
    """The n-grams of a batch of texts as byte ranges of one buffer of words joined by single spaces."""

    def __init__(self, texts: list[str | None], longest: int):
        split = [(t or "").encode().lower().translate(PARTS).split() for t in texts]
        self.n_words = np.array([len(w) for w in split], np.int64)
        self.buffer = b" ".join([b" ".join(words) for words in split if words])
        self.bytes = np.frombuffer(self.buffer, np.uint8)
        spaces = np.flatnonzero(self.bytes == 0x20)
        some = len(self.buffer) > 0
        starts, ends = np.concatenate([[0] * some, spaces + 1]).astype(np.int64), np.concatenate([spaces, [len(self.buffer)] * some]).astype(np.int64)
        doc = np.repeat(np.arange(len(texts)), self.n_words)
        found = [(starts, ends, doc)]
        for n in range(2, longest + 1):
            inside = doc[: 1 - n] == doc[n - 1 :]  # no run crosses texts
            found.append((starts[: 1 - n][inside], ends[n - 1 :][inside], doc[: 1 - n][inside]))
        self.starts, self.ends, self.doc = (np.concatenate(c) for c in zip(*found, strict=True))

    def parts(self, buckets: int) -> Iterator[tuple[np.ndarray, Table]]:
        """Text of each occurrence and the table that interned them, ``PART`` occurrences at a time."""
        for a in range(0, len(self.starts), PART):
            yield self.doc[a : a + PART], Table(self, slice(a, a + PART), buckets)


#: The fixed values of XXH64.
PRIMES = [np.uint64(p) for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)]


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def xxh64(grams: Grams, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """XXH64, seed 0, of byte ranges: those below 32 bytes all together, the rest by the library."""
    p1, p2, p3, p4, p5 = PRIMES
    length = ends - starts
    h = p5 + length.astype(np.uint64)
    lanes = np.lib.stride_tricks.sliding_window_view(np.concatenate([grams.bytes, np.zeros(8, np.uint8)]), 8)
    for lane in range(3):
        at = np.flatnonzero(length >= 8 * (lane + 1))
        k = lanes[starts[at] + 8 * lane].view("<u8")[:, 0]
        h[at] = _turn(h[at] ^ (_turn(k * p2, 31) * p1), 27) * p1 + p4
    at = np.flatnonzero(length & 4)
    k = lanes[starts[at] + (length[at] & ~7)].view("<u4")[:, 0].astype(np.uint64)
    h[at] = _turn(h[at] ^ (k * p1), 23) * p2 + p3
    for last in range(3):
        at = np.flatnonzero((length & 3) > last)
        k = grams.bytes[starts[at] + (length[at] & ~3) + last].astype(np.uint64)
        h[at] = _turn(h[at] ^ (k * p5), 11) * p1
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    h ^= h >> np.uint64(32)
    for i in np.flatnonzero(length >= 32).tolist():
        h[i] = xxhash.xxh64_intdigest(grams.buffer[starts[i] : ends[i]])
    return h


class Table:
    """Open addressing with linear probing: ``owner`` is the occurrence whose bytes a slot stands for, -1 in free slots."""

    def __init__(self, grams: Grams, part: slice, buckets: int):
        self.bytes, self.starts, self.ends = grams.bytes, grams.starts[part], grams.ends[part]
        self.keys = xxh64(grams, self.starts, self.ends)
        size = 1 << max(1, (2 * len(self.keys) - 1).bit_length())
        self.owner = np.full(size, -1, np.int64)
        self.slots = self._intern(size)
        self.taken = np.flatnonzero(self.owner >= 0)
        self.count = np.bincount(self.slots, minlength=size)
        self.bucket = np.zeros(size, np.int64)
        owners, buffer, crc = self.owner[self.taken], grams.buffer, zlib.crc32
        self.bucket[self.taken] = [crc(buffer[a:b]) for a, b in zip(self.starts[owners].tolist(), self.ends[owners].tolist(), strict=True)]
        self.bucket[self.taken] %= buckets

    def _intern(self, size: int) -> np.ndarray:
        """The slot of each occurrence. Each round looks at one slot for all occurrences still without one."""
        slots, todo = np.empty(len(self.keys), np.int64), np.arange(len(self.keys))
        at = (self.keys & np.uint64(size - 1)).astype(np.int64)
        while len(todo):
            here = at[todo]
            free = self.owner[here] < 0
            self.owner[here[free]] = todo[free]  # of several that claim a slot the last one holds it
            held = self.owner[here]
            same = self._equal(held, todo)
            slots[todo[same]] = here[same]
            todo = todo[~same]
            at[todo] = (at[todo] + 1) & (size - 1)
        return slots

    def _equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether pairs of occurrences are the same n-gram: equal keys, lengths and bytes."""
        length = self.ends[b] - self.starts[b]
        same = (self.keys[a] == self.keys[b]) & (self.ends[a] - self.starts[a] == length)
        check = np.flatnonzero(same & (a != b))
        for i in range(0, len(check), PART // 8):
            c = check[i : i + PART // 8]
            n = length[c]
            first = np.cumsum(n) - n
            offset = np.arange(int(n.sum())) - np.repeat(first, n)
            differs = self.bytes[np.repeat(self.starts[a[c]], n) + offset] != self.bytes[np.repeat(self.starts[b[c]], n) + offset]
            same[c] &= ~np.logical_or.reduceat(differs, first)
        return same


def bucket_counts(texts: DataFrame, buckets: int, longest: int) -> np.ndarray:
    """Occurrences of n-grams by bucket over a frame with a column ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, table in Grams(batch.column("text").to_pylist(), longest).parts(buckets):
                np.add.at(total, table.bucket[table.taken], table.count[table.taken])
        held = np.flatnonzero(total)
        yield pa.record_batch([pa.array(held, pa.int32()), pa.array(total[held], pa.int64())], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in texts.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most ``buckets`` rows
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed bucket shares, rounded down."""
    k, all_s, all_t = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (all_s + k) / ((s + 1) * (all_t + k)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(seed: int, doc_id: int | None) -> int:
    """Gumbel noise in thousandths, fixed by seed and id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _weigher(shared, buckets: int, longest: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            ids = batch.column("id").to_pylist()
            grams = Grams(batch.column("text").to_pylist(), longest)
            sums, n = np.zeros(len(ids), np.int64), np.bincount(grams.doc, minlength=len(ids))
            for doc, table in grams.parts(buckets):
                by_slot = gain[table.bucket]
                np.add.at(sums, doc, by_slot[table.slots])
            weight = [s // k if k else 0 for s, k in zip(sums.tolist(), n.tolist(), strict=True)]
            score = [w + noise(seed, i) for w, i in zip(weight, ids, strict=True)]
            yield pa.record_batch([pa.array(c, pa.int64()) for c in (ids, grams.n_words, n, weight, score)], ["id", "n_words", "n_features", "weight", "score"])

    return run


def resample(docs: DataFrame, target: DataFrame, *, percent: int = 10, longest: int = 2, buckets: int = 10_000, min_words: int = 20, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """(id, n_features, weight, score, rank) of every document: rank in the draw of ``percent`` of the documents with at
    least ``min_words`` words, null if not drawn."""
    spark = common.session(docs)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    gain = gains(bucket_counts(texts.select("text"), buckets, longest), bucket_counts(target.select(F.col(target_text_col).alias("text")), buckets, longest))
    scored = common.cut(texts.mapInArrow(_weigher(spark.sparkContext.broadcast(gain), buckets, longest, seed), "id long, n_words long, n_features long, weight long, score long"))
    fit = F.col("n_words") >= min_words
    drawn = percent * scored.filter(fit).count() // 100
    # scores are whole numbers of a narrow range (gains and noise are logarithms), so one row each is little
    above = W.orderBy(F.desc("s")).rowsBetween(W.unboundedPreceding, -1)
    counted = scored.filter(fit).groupBy(F.col("score").alias("s")).agg(F.count("*").alias("n"))
    begins = counted.select("s", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("before")).filter(F.col("before") < drawn)
    placed = scored.join(begins, fit & (F.col("score") == F.col("s")), "left")
    rank = F.col("before") + F.row_number().over(W.partitionBy("score").orderBy(F.col("id").asc_nulls_last()))
    ranked = placed.filter("before is not null").withColumn("rank", rank).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = placed.filter("before is null").withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select(F.col("id").alias(id_col), "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))
