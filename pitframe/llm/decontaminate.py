"""Benchmark passages in documents by pigeonhole pieces and Myers' bit-parallel distance (operator 10).

An item of n characters may differ by at most n // ``per_error`` edits. Cut into one piece more than that, each
approximate occurrence keeps at least one piece whole, so exact hits of the pieces (an Aho-Corasick machine over all
items) find every candidate place; Myers' algorithm then measures the least distance of the whole item to any stretch of
text around the place. Texts are compared in lower case with every run of other characters than letters and digits as
one space.

Items go to the tasks in blocks of about ``block_chars`` characters, one block after the other against all documents: between
blocks the rows are written to the shared folder, so that a worker holds the machine of one block only (about 60 bytes for each
character of items) and memory is bounded whatever the number of items.

Defined cases: null and empty texts and items match nothing; an item of fewer characters than ``per_error`` must occur
exactly, between word ends; repeated items each give their row; repeated rows are searched one by one; empty tables give an
empty result. ``with_matches`` keeps all columns, and one that has the name of the new column is replaced; ``contaminated``
carries ids only. Texts are never cut.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

PER_ERROR = 16
BLOCK_CHARS = 2_000_000
_other = re.compile(r"[\W_]+")


def normalise(text: str | None) -> str:
    return _other.sub(" ", (text or "").lower()).strip()


def distance(pattern: str, text: str, most: int) -> tuple[int, int] | None:
    """Least edit distance of the pattern to any stretch of the text, and the first end where it is reached; or None."""
    n = len(pattern)
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        masks[c] |= 1 << i
    full, high = (1 << n) - 1, 1 << (n - 1)
    up, down, score, best = full, 0, n, None
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        x = eq | down
        d0 = (((x & up) + up) ^ up) | x
        plus, minus = down | ~(d0 | up) & full, up & d0
        if plus & high:
            score += 1
        elif minus & high:
            score -= 1
        plus, minus = plus << 1 & full, minus << 1 & full
        up, down = minus | ~(d0 | plus) & full, plus & d0
        if score <= most and (best is None or score < best[0]):
            best = (score, j + 1)
    return best


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """The item cut into ``errors`` + 1 pieces of nearly equal length, with their places."""
    cuts = [len(item) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Matcher:
    def __init__(self, items: list[tuple[int, str]], per_error: int):
        import ahocorasick

        self.items = [(i, t, len(t) // per_error) for i, t in items]
        found: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for k, (_, text, errors) in enumerate(self.items):
            for at, piece in pieces(text, errors) if errors else [(-1, f" {text} ")]:
                found[piece].append((k, at))
        self.machine = ahocorasick.Automaton()
        for piece, where in found.items():
            self.machine.add_word(piece, (len(piece), where))
        if found:
            self.machine.make_automaton()
        self.any = bool(found)

    def matches(self, text: str) -> list[tuple[int, int, int]]:
        """(item id, least distance, end of its first place) for every item that the normalised text holds."""
        if not self.any or not text:
            return []
        text = f" {text} "
        places: dict[int, set[int]] = defaultdict(set)
        for end, (n, where) in self.machine.iter(text):
            for k, at in where:
                places[k].add(end + 1 - n - at)  # where the item would begin
        out = []
        for k, starts in places.items():
            item_id, item, errors = self.items[k]
            spans: list[list[int]] = []
            for s in sorted(starts):
                a, b = max(0, s - errors), min(len(text), s + len(item) + errors)
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], b)
                else:
                    spans.append([a, b])
            best = None
            for a, b in spans:
                part = text[a:b]
                exact = part.find(item)
                if exact >= 0:
                    got = (0, exact + len(item))
                elif not errors:
                    continue
                else:
                    got = distance(item, part, errors)
                if got and (best is None or got[0] < best[0]):
                    best = (got[0], a + got[1] - 1)
            if best:
                out.append((item_id, *best))
        return sorted(out)


_MATCH = pa.struct([("item", pa.int64()), ("distance", pa.int32()), ("match_end", pa.int64())])


def _searcher(shared, per_error: int):
    @F.arrow_udf("array<struct<item:long,distance:int,match_end:long>>")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        matcher = Matcher(shared.value, per_error)
        for t in texts:
            yield pa.array([[dict(zip(("item", "distance", "match_end"), m, strict=True)) for m in matcher.matches(normalise(x))] for x in t.to_pylist()], pa.list_(_MATCH))

    return run


def with_matches(docs: DataFrame, benchmark: DataFrame, *, per_error: int = PER_ERROR, block_chars: int = BLOCK_CHARS, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", to: str = "matches") -> DataFrame:
    """``docs`` with an array of (item, distance, match_end) added: the items that each text holds; no row moves."""
    spark = common.session(docs)
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text_col).alias("t")).filter("i is not null and t is not null")
    total = items.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = 1 + total // block_chars
    for block in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == block).distinct().collect()  # about block_chars characters
        shared = spark.sparkContext.broadcast(sorted((r.i, x) for r in own if (x := normalise(r.t))))
        found = _searcher(shared, per_error)(F.col(text_col))
        docs = docs.withColumn(to, F.concat(to, found) if block else found)
        if blocks > 1:
            docs = common.cut(docs)
            shared.destroy()
    return docs


def contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", **settings) -> DataFrame:
    """(id, item, distance, match_end): each document and benchmark item that it holds within the item's error budget."""
    rows = with_matches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), benchmark, item_col=item_col, **settings)
    rows = rows.select("id", F.explode("matches").alias("m"))
    return rows.select(F.col("id").alias(id_col), F.col("m.item").alias(item_col), "m.distance", "m.match_end")
