"""Toxicity by a subsequence string kernel, a support vector machine and Nyström landmarks (operator 5).

The method asks for a machine over sentences. Taken as whole sentences, with the best sentence of a document as its score and the
positive sentences of toxic documents found in rounds, the same kernel and machine did not give right results (see the README), so
the machine works on the words of the labelled sentences. The kernel of two words is the sum over common character subsequences of length three of the product of their weights;
an occurrence weighs ``DECAY`` to the power of its span, and may skip up to ``GAP`` characters at each step. Inserted
characters and dots inside an insult therefore leave most of its subsequences in place. Words carry a mark at each end.
Runs of single letters ("i d i o t") are one word.

Training takes a bounded sample of labelled rows. Words are weighed by how far the documents that hold them are toxic;
landmarks are the most telling and the commonest words, the Nyström map sends a word to its kernel values with them, and
a squared-hinge machine separates telling words from words of clean documents. As the machine's value is a sum of kernels
with landmarks, it folds into one weight for each subsequence, so that scoring a word is a sum over its own
subsequences over its norm. A document's score is a logistic function of its three highest word values and its length,
fitted on sample rows that the machine did not see.

Defined cases: null and empty texts have no words and get the score of a text without any telling word; a word that shares
no subsequence with a landmark has value zero; repeated rows get equal scores; without labelled rows of both kinds the
score is the share of toxic rows, or zero; labels that are null are left out; a null id is not held out; columns of the input stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Fixed alphabet of the kernel: end mark, then letters; any other character only widens a gap.
ALPHABET = "^abcdefghijklmnopqrstuvwxyzàáâäæçèéêëìíîïñòóôöœßùúûüÿåøš"
SIZE, GAP, DECAY = 64, 2, 0.6
LANDMARKS = 600
#: Word values below this need no exact norm: they count as this or as their bound, if that is less.
EXACT_ABOVE = 1.0
#: Bounds of the training sample: labelled rows, telling words and other words.
SAMPLE_ROWS, TOXIC_WORDS, CLEAN_WORDS = 9000, 400, 3000
KEEP_WORDS = 100_000
_code = {c: i + 1 for i, c in enumerate(ALPHABET)}
_spaced = re.compile(r"(?<!\S)\S(?:[ \t]\S){2,}(?!\S)")
STEPS = [(a, b) for a in range(1, GAP + 2) for b in range(1, GAP + 2)]
WEIGHTS = np.array([DECAY ** (a + b + 1) for a, b in STEPS])
_table = np.zeros(0x180, np.int32)
for _c, _i in _code.items():
    if _c != "^":
        _table[ord(_c)] = _i


def words_of(text: str | None) -> list[str]:
    """Lower-cased words, without punctuation at their ends; a run of single letters is one word."""
    text = (text or "").lower()
    if _spaced.search(text):
        text = _spaced.sub(lambda m: re.sub(r"[ \t]", "", m[0]), text)
    return [x for w in text.split() if (x := w.strip(".,;:!?\"'()[]|#*$%&<>-_"))]


def occurrences(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the subsequence occurrences of words of like length, a row a word, a column a place and step; 0 where none.

    Also each word's norm, the root of the sum of its occurrences' squared weights.
    """
    width = max(map(len, words)) + 2
    letters = np.zeros((len(words), width - 2), np.uint32)
    letters[:] = np.array(words, f"<U{width - 2}").view(np.uint32).reshape(len(words), -1)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    chars = np.zeros((len(words), width + 2 * GAP + 2), np.int32)
    chars[:, 1 : width - 1] = _table[np.minimum(letters, len(_table) - 1)]
    chars[:, 0] = 1
    chars[np.arange(len(words)), sizes + 1] = 1
    codes = np.zeros((len(words), len(STEPS) * width), np.int32)
    square = np.zeros(len(words))
    for k, (a, b) in enumerate(STEPS):
        n = chars.shape[1] - a - b
        n = min(n, width)
        x, y, z = chars[:, :n], chars[:, a : a + n], chars[:, a + b : a + b + n]
        there = (x > 0) & (y > 0) & (z > 0)
        codes[:, k * width : k * width + n] = there * ((x * SIZE + y) * SIZE + z)
        square += there.sum(axis=1) * WEIGHTS[k] ** 2
    return codes, np.sqrt(square)


def norms(codes: np.ndarray) -> np.ndarray:
    """Root of each word's kernel with itself: equal occurrences add up before they are squared."""
    weights = np.repeat(WEIGHTS, codes.shape[1] // len(STEPS))[None, :] * (codes > 0)
    order = np.argsort(codes, axis=1)
    c, w = np.take_along_axis(codes, order, 1), np.take_along_axis(weights, order, 1)
    start = np.ones_like(c, bool)
    start[:, 1:] = c[:, 1:] != c[:, :-1]
    sums = np.add.reduceat(w.ravel(), np.flatnonzero(start.ravel()))
    return np.sqrt(np.bincount(np.nonzero(start)[0], sums * sums, len(c)))


def features(words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each word's distinct codes with their normed values."""
    out = []
    for w in words:
        codes, norm = occurrences([w])
        keys, where = np.unique(codes[0], return_inverse=True)
        values = np.bincount(where, np.repeat(WEIGHTS, len(codes[0]) // len(STEPS)))
        keys, values = keys[keys > 0], values[keys > 0]
        norm = np.sqrt((values**2).sum())
        out.append((keys, values / norm if norm else values))
    return out


def kernel(a: list[tuple[np.ndarray, np.ndarray]], b: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Normed kernel values between two lists of words."""
    table, out = np.zeros(SIZE**3), np.zeros((len(a), len(b)))
    for j, (keys, values) in enumerate(b):
        table[keys] = values
        out[:, j] = [x @ table[k] for k, x in a]
        table[keys] = 0
    return out


@dataclass
class Model:
    """Weights of the subsequences, the machine's offset, and the logistic function of a document's features."""

    table: np.ndarray
    coefficients: np.ndarray

    def values(self, words: list[str]) -> np.ndarray:
        """Value of each word, at least 0."""
        out = np.zeros(len(words))
        by_length = sorted(range(len(words)), key=lambda i: len(words[i]))
        at = 0
        while at < len(by_length):  # blocks of like length, of bounded size
            longest = len(words[by_length[at]]) * 5 // 4 + 8
            to = at
            while to < len(by_length) and len(words[by_length[to]]) <= longest and (to - at) * longest < 1 << 16:
                to += 1
            block = by_length[at:to]
            codes, norm = occurrences([words[i] for i in block])
            raw = self.table[codes].reshape(len(block), len(STEPS), -1).sum(axis=2) @ WEIGHTS
            value = np.maximum(raw, 0) / np.maximum(norm, 1e-9)  # at least the true one
            if len(high := np.flatnonzero(value > EXACT_ABOVE)):
                value[high] = np.maximum(raw[high] / norms(codes[high]), EXACT_ABOVE)
            out[block] = value
            at = to
        return out

    def score(self, top: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(top @ self.coefficients[:-1] + self.coefficients[-1], -30, 30)))


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 300.0) -> np.ndarray:
    """Squared-hinge linear machine with an offset by Newton steps; the last entry is the offset."""
    x = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    w = np.zeros(x.shape[1])
    for _ in range(50):
        active = y * (x @ w) < 1
        a, b = x[active], weight[active, None] * x[active]
        new = np.linalg.solve(ridge + c * a.T @ b, c * b.T @ y[active])
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return w


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        ridge = np.diag([*[0.02] * (x.shape[1] - 1), 1e-6])
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _fit(bad: list[str], counts: np.ndarray, good: list[str], marks: list[str]) -> np.ndarray:
    """Weights of the subsequences, from a machine between telling and other words in the Nyström space of the landmarks."""
    f_marks = features(marks)
    values, vectors = np.linalg.eigh(kernel(f_marks, f_marks))
    kept = values > 1e-5 * values.max()
    to_space = vectors[:, kept] / np.sqrt(values[kept])
    x = kernel(features(bad + good), f_marks) @ to_space
    y = np.r_[np.ones(len(bad)), -np.ones(len(good))]
    w = _machine(x, y, np.r_[counts / counts.mean() * len(good) / len(bad) * 0.5, np.ones(len(good))])
    table = np.zeros(SIZE**3)
    for (keys, v), c in zip(f_marks, to_space @ w[:-1], strict=True):
        table[keys] += c * v
    return table.astype(np.float32)


def _top(model: Model, known: dict[str, float], text: str | None) -> tuple[float, float, float, float]:
    """A document's features: its three highest word values and the logarithm of its length."""
    words = words_of(text)
    distinct = set(words)
    if len(known) > KEEP_WORDS:
        known.clear()
    if new := list(distinct.difference(known)):
        known.update(zip(new, model.values(new).tolist(), strict=True))
    best = sorted((v for w in distinct if (v := known[w]) > 0), reverse=True)[:3]
    return (*best, *[0.0] * (3 - len(best)), float(np.log1p(len(words))))


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(w, y) for t, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True) for w in set(words_of(t))]
        yield pa.record_batch([pa.array([w for w, _ in rows], pa.string()), pa.array([y for _, y in rows], pa.int64())], ["word", "y"])


def held_out(id_col: str = "doc_id"):
    """True for the quarter of the ids from which no label is learnt; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fits on at most ``sample_rows`` labelled rows that are not held out, the first by a hash of their id."""
    spark = common.session(docs)
    empty = Model(np.zeros(SIZE**3), np.array([0.0, 0, 0, 0, -30.0]))
    chosen = labels.filter(~held_out(id_col) & F.col(label_col).isNotNull()).select(id_col, F.col(label_col).cast("long").alias("y"), F.xxhash64(id_col).alias("h")).orderBy("h", id_col, "y").limit(sample_rows)
    chosen = spark.createDataFrame(chosen.toPandas(), f"doc {dict(labels.dtypes)[id_col]}, y long, h long")  # at most sample_rows rows of 24 bytes
    sample = common.cut(docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "doc").repartition(8, "doc"))
    first = sample.filter(F.pmod("h", F.lit(3)) > 0)
    n = {r.y: r.n for r in first.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        share = n.get(1, 0) / max(1, sum(n.values()))
        return Model(empty.table, np.array([0.0, 0, 0, 0, np.log(share / (1 - share)) if 0 < share < 1 else 30.0 * (2 * share - 1)]))
    counted = first.select("text", "y").mapInArrow(_word_rows, "word string, y long").groupBy("word").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    counted = common.cut(counted.withColumn("share", (F.col("pos") / n[1]) / (F.col("pos") / n[1] + (F.col("neg") + 0.5) / n[0])))
    telling = counted.filter("pos >= 2 and share > 0.8").orderBy(F.desc(F.col("pos") * (F.col("share") - 0.5)), "word").limit(TOXIC_WORDS).toPandas()
    common_words = counted.filter("share < 0.6").orderBy(F.desc("neg"), "word").limit(CLEAN_WORDS // 4).toPandas()
    others = counted.filter("pos = 0").orderBy(F.xxhash64("word"), "word").limit(CLEAN_WORDS).toPandas()
    if telling.empty:
        share = n[1] / (n[0] + n[1])
        return Model(empty.table, np.array([0.0, 0, 0, 0, np.log(share / (1 - share))]))
    bad, good = telling["word"].tolist(), list(dict.fromkeys([*common_words["word"], *others["word"]]))
    table = _fit(bad, telling["pos"].to_numpy(), good, bad[: LANDMARKS // 2] + good[: LANDMARKS // 4])

    for _ in range(2):  # words of clean documents that this machine takes for insults teach the next one

        def confusable(batches: Iterator[pa.RecordBatch], judge: Model = Model(table, empty.coefficients)) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.record_batch([batch.column("word"), pa.array(judge.values(batch.column("word").to_pylist()))], ["word", "value"])

        hard = counted.filter("neg > 0 and share < 0.6").select("word").mapInArrow(confusable, "word string, value double").orderBy(F.desc("value"), "word").limit(CLEAN_WORDS).toPandas()["word"].tolist()
        good = list(dict.fromkeys([*hard, *good]))
        table = _fit(bad, telling["pos"].to_numpy(), good, bad[: LANDMARKS // 2] + good[: LANDMARKS // 2])
    model = Model(table, empty.coefficients)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for batch in batches:
            rows = [_top(model, known, t) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([pa.array([r[i] for r in rows], pa.float64()) for i in range(4)] + [batch.column("y")], ["a", "b", "c", "d", "y"])

    seen = sample.filter(F.pmod("h", F.lit(3)) == 0).select("text", "y").mapInArrow(measure, "a double, b double, c double, d double, y long").toPandas()
    if seen["y"].nunique() < 2:
        seen = sample.select("text", "y").mapInArrow(measure, "a double, b double, c double, d double, y long").toPandas()
    return Model(model.table, _logistic(seen[["a", "b", "c", "d"]].to_numpy(), seen["y"].to_numpy()))


def score(docs: DataFrame, model: Model, *, threshold: float = 0.3, text_col: str = "text", score_col: str = "_score", predicted_col: str = "_predicted") -> DataFrame:
    """``docs`` with score and predicted added; other columns stay as they are, and those that have the names of the new ones are replaced."""
    spark = common.session(docs)
    shared = spark.sparkContext.broadcast(model)  # a megabyte, whatever the input

    @F.arrow_udf("double")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        known: dict[str, float] = {}  # of this task only, so that later stages of the worker have the memory
        for t in texts:
            rows = np.array([_top(model, known, x.as_py()) for x in t], float).reshape(-1, 4)
            yield pa.array(model.score(rows))

    out = docs.withColumn(score_col, run(F.col(text_col)))
    return out.withColumn(predicted_col, (F.col(score_col) >= threshold).cast("int"))
