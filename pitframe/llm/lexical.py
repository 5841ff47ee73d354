"""Ranked lexical search by exact inner products over sparse ball trees (operator 12).

A document is the sparse vector of its term values, an item the vector of its term weights by repeats; a score is their
inner product, in whole numbers. One pass counts the collection (documents, terms, document frequencies) and keeps each
document's counts of the terms that items ask for. In a second pass every task builds ball trees over blocks of its
documents: a level at a time each ball is halved between two far members, and keeps its centroid and radius. An item
walks the balls best-first by ``weights . centroid + |weights| * radius``, rounded up by more than the floating error,
and leaves when no ball left can reach its worst kept score; members of the leaves reached are scored in 64-bit
integers. What the tasks keep, k rows an item each, is merged. Bounds only skip, so the result is exact.

Only coordinates that some item weighs are kept: the others add nothing to any product. Items come in blocks of bounded
text, so vocabulary, weights and centroids are bounded whatever the number of items.

Defined cases: null and empty texts have no terms; documents without terms count neither in N nor in L; items without
terms have no rows; equal scores go by ascending id; rows that repeat an id are ranked one by one; rows with a null id
count in the statistics but are not ranked; items that repeat id and text are one item; an empty table gives no rows;
columns other than id and text are not carried, so their names cannot clash.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

#: Every ASCII character that is neither letter nor digit parts terms; only A-Z is lower-cased.
PARTS = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))
#: Characters of the items of one block; documents and coordinates of one tree; documents of a leaf, up to twice as many.
BLOCK_CHARS, TREE_ROWS, TREE_VALUES, LEAF = 500_000, 8192, 2_000_000, 32

_VECTORS = "stats boolean, id long, n long, terms array<int>, counts array<int>"
_KEPT = "item int, id long, score long"


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().translate(PARTS).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def values(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """The value of a term that occurs ``tf`` times among the ``n`` terms of a document."""
    m = 100 - 75 + (75 * n * n_docs) // n_terms
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def _vectors(vocabulary: dict[bytes, int]):
    """Rows of counts, and at the end of a task one row of its statistics: documents, terms, document frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_docs = n_terms = 0
        df = np.zeros(len(vocabulary), np.int64)
        schema = pa.schema([("stats", pa.bool_()), ("id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))])
        for batch in batches:
            rows = []
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                words = terms(text.as_py())
                n_docs += bool(words)
                n_terms += len(words)
                found = Counter(map(vocabulary.get, words))
                found.pop(None, None)
                if found:
                    held = np.fromiter(found, np.int32, len(found))
                    df[held] += 1
                    if i is not None:
                        rows.append((False, i, len(words), held, np.fromiter(found.values(), np.int32, len(found))))
            if rows:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        held = np.flatnonzero(df).astype(np.int32)
        yield pa.record_batch([pa.array([c], f.type) for c, f in zip((True, n_docs, n_terms, held, df[held].astype(np.int32)), schema, strict=True)], schema=schema)

    return run


class BallTree:
    """Balls over sparse rows of whole numbers above zero; there is a row, and each has a value."""

    def __init__(self, lengths: np.ndarray, cols: np.ndarray, vals: np.ndarray, width: int, leaf: int = LEAF):
        m = len(lengths)
        depth = max(0, math.floor(math.log2(m / leaf)))  # no ball is empty
        self.width, order, floats = width, np.arange(m), vals.astype(np.float64)
        at = np.concatenate([[0], np.cumsum(lengths)])
        of = np.repeat(np.arange(m), lengths)  # row of each value
        square = np.bincount(of, floats * floats, m)
        bounds, self.centroids, self.radii, self.spans = np.array([0, m]), [], [], []
        for level in range(depth + 1):
            size = np.diff(bounds)
            ball = np.empty(m, np.int64)  # ball of each row
            ball[order] = np.repeat(np.arange(len(size)), size)
            dot = lambda dense: np.bincount(of, floats * dense[ball[of], cols], m)
            centroid = np.bincount(ball[of] * width + cols, floats, len(size) * width).reshape(-1, width) / np.maximum(size, 1)[:, None]
            far = square - 2 * dot(centroid) + (centroid * centroid).sum(axis=1)[ball]
            # what rounding takes from a squared distance is far below this share of the squares it is made of
            safe = np.sqrt(np.maximum(far, 0) + 1e-9 * (square + (centroid * centroid).sum(axis=1)[ball]) + 1e-9)
            self.centroids.append(centroid)
            self.radii.append(np.maximum.reduceat(safe[order], bounds[:-1]))
            self.spans.append(bounds)
            if level == depth:
                break
            one = self._farthest(far, order, bounds)
            to_one = square - 2 * dot(self._dense(one, at, cols, floats)) + square[one][ball]
            two = self._farthest(to_one, order, bounds)
            to_two = square - 2 * dot(self._dense(two, at, cols, floats)) + square[two][ball]
            order = np.lexsort((to_one - to_two, ball))
            halves = bounds[:-1] + (size + 1) // 2
            bounds = np.concatenate([np.stack([bounds[:-1], halves], axis=1).ravel(), [m]])
        self.order, self.centroids, self.radii = order, np.concatenate(self.centroids), np.concatenate(self.radii)
        # values in the order of the leaves
        lengths = lengths[order]
        self.at = np.concatenate([[0], np.cumsum(lengths)])
        pick = np.repeat(at[order] - self.at[:-1], lengths) + np.arange(len(vals))
        self.cols, self.vals = cols[pick], vals[pick]
        self.first_leaf = (1 << depth) - 1

    @staticmethod
    def _farthest(distance: np.ndarray, order: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The row of each ball with the largest distance."""
        most = np.maximum.reduceat(distance[order], bounds[:-1])
        hits = np.flatnonzero(distance[order] == np.repeat(most, np.diff(bounds)))
        return order[hits[np.searchsorted(hits, bounds[:-1])]]

    def _dense(self, rows: np.ndarray, at: np.ndarray, cols: np.ndarray, floats: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), self.width))
        for k, r in enumerate(rows):
            out[k, cols[at[r] : at[r + 1]]] = floats[at[r] : at[r + 1]]
        return out

    def bounds(self, cols: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """For each ball a whole number that no product with a member exceeds."""
        upper = self.centroids[:, cols] @ weights.astype(np.float64) + math.sqrt(float((weights.astype(np.float64) ** 2).sum())) * self.radii
        return np.floor(upper * (1 + 1e-9)) + 1

    def search(self, cols: np.ndarray, weights: np.ndarray, dense: np.ndarray, ids: np.ndarray, best: list[tuple[int, int]], k: int) -> int:
        """Adds to ``best``, a heap of the k best (score, -id), and returns the number of rows scored. ``dense`` holds the weights by coordinate."""
        upper, scored = self.bounds(cols, weights), 0
        balls = [(-upper[0], 0)]
        while balls:
            bound, ball = heapq.heappop(balls)
            # a ball that only ties may hold a smaller id
            if len(best) == k and -bound < best[0][0]:
                break
            if ball < self.first_leaf:
                for child in (2 * ball + 1, 2 * ball + 2):
                    if len(best) < k or upper[child] >= best[0][0]:
                        heapq.heappush(balls, (-upper[child], child))
                continue
            a, b = self.spans[-1][ball - self.first_leaf : ball - self.first_leaf + 2]
            x, y = self.at[a], self.at[b]
            scores = np.add.reduceat(dense[self.cols[x:y]] * self.vals[x:y], self.at[a:b] - x)
            scored += b - a
            least = best[0][0] if len(best) == k else 1
            for i in np.flatnonzero(scores >= least):
                entry = (int(scores[i]), -int(ids[self.order[a + i]]))
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
        return scored


def _searcher(shared, k: int):
    """Keeps the k best rows of every item over all trees of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_docs, n_terms, width, items = shared.value
        best: list[list[tuple[int, int]]] = [[] for _ in items]
        dense = np.zeros(width, np.int64)

        def tree(parts: list[tuple]) -> None:
            ids, n, lengths, cols, tf = (np.concatenate(c) for c in zip(*parts, strict=True))
            vals = values(tf.astype(np.int64), np.repeat(n, lengths), n_docs, n_terms)
            balls = BallTree(lengths, cols.astype(np.int64), vals, width)
            for (_, cols_of, weights), kept in zip(items, best, strict=True):
                if len(cols_of):
                    dense[cols_of] = weights
                    balls.search(cols_of, weights, dense, ids, kept, k)
                    dense[cols_of] = 0

        parts, rows, size = [], 0, 0
        for batch in batches:
            held, counts = batch.column("terms"), batch.column("counts")
            lengths = np.diff(held.offsets.to_numpy())
            parts.append((batch.column("id").to_numpy(zero_copy_only=False), batch.column("n").to_numpy(zero_copy_only=False), lengths, held.flatten().to_numpy(), counts.flatten().to_numpy()))
            rows, size = rows + len(lengths), size + int(lengths.sum())
            if rows >= TREE_ROWS or size >= TREE_VALUES:
                tree(parts)
                parts, rows, size = [], 0, 0
        if rows:
            tree(parts)
        out = [(i, -d, s) for i, kept in enumerate(best) for s, d in kept]
        if out:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int64()), strict=True)], ["item", "id", "score"])

    return run


def search(docs: DataFrame, items: DataFrame, *, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(item, rank, id, score): the k documents of highest score of every item, scores above 0 only."""
    spark = common.session(docs)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    asked = items.select(F.col(item_col).cast("long").alias("i"), F.col(item_text_col).alias("t")).filter("i is not null and t is not null")
    total = asked.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks, found = 1 + total // block_chars, []
    for block in range(blocks):
        own = sorted((r.i, r.t) for r in asked.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == block).distinct().collect())  # about block_chars characters
        found.append(_block(spark, texts, own, k))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")


def _block(spark, texts: DataFrame, items: list[tuple[int, str]], k: int) -> DataFrame:
    counted = [(i, Counter(terms(t))) for i, t in items]
    vocabulary = {t: n for n, t in enumerate(sorted({t for _, c in counted for t in c}))}
    path = common.new_path(spark, "term-counts")
    texts.mapInArrow(_vectors(vocabulary), _VECTORS).write.parquet(path)
    stored = spark.read.schema(_VECTORS).parquet(path)
    stats = stored.filter("stats")
    n_docs, n_terms = stats.agg(F.coalesce(F.sum("id"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    pairs = stats.select(F.explode(F.arrays_zip("terms", "counts")).alias("p")).groupBy(F.col("p.terms").alias("t")).agg(F.sum("p.counts").alias("df"))
    df = {r.t: r.df for r in pairs.collect()}  # at most one row for each term of the block's items
    asked = []
    for i, counts in counted:
        cols = [(vocabulary[t], n * weight(n_docs, df[vocabulary[t]])) for t, n in counts.items() if vocabulary[t] in df]
        asked.append((i, np.array([c for c, _ in cols], np.int64), np.array([w for _, w in cols], np.int64)))
    shared = spark.sparkContext.broadcast((n_docs, n_terms, max(1, len(vocabulary)), asked))
    kept = stored.filter("not stats").select("id", "n", "terms", "counts").mapInArrow(_searcher(shared, k), _KEPT)
    best = kept.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= k)
    names = spark.createDataFrame([(n, i) for n, (i, _) in enumerate(items)], "item int, name long")
    return best.join(F.broadcast(names), "item").select(F.col("name").alias("item"), "rank", "id", "score")
