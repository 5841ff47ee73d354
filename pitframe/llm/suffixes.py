"""Suffix-array dedup over bytes by two-stage sorting (operator 3).

Runs of 400-byte windows that share a minimiser travel to its bucket. There the strings are put end to end and their
suffixes sorted in two stages: only suffixes smaller than their successors are sorted directly, the others follow from
one scan over the buckets of first bytes. Neighbours in that order with a common prefix of a whole window are repeats.
Every byte under a window that starts twice or more anywhere is removed; windows are judged on the input.

Defined cases: a null or empty text has no bytes; texts shorter than a window lose nothing; repeated rows count as documents
of their own; overlapping repeats within one text count; matches never cross documents; an empty table gives an empty
result; other columns are not carried. Texts are never cut; what is left may begin or end inside a character.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from .repeats import Units, remove_repeats, span_hashes

#: Bytes of a minimiser's runs that one task compares; the windows of a heavier one are counted over all tasks.
HEAVY = 256 << 20
#: Bytes whose hashes are made at once, and bytes of one minimiser's strings beyond which classes of hashes take turns.
BLOCK, LARGE = 1 << 20, 8 << 20


def suffix_order(text: bytes, depth: int) -> np.ndarray:
    """Starts of all suffixes, ordered by at least their first ``depth`` bytes."""
    n = len(text)
    raw = np.frombuffer(text, np.uint8)
    if n < 2:
        return np.arange(n)
    # smaller than its successor: the next different byte is greater; at the end of the text it is not
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(raw[1:].astype(np.int16) - raw[:-1])
    known = np.flatnonzero(step)
    after = np.searchsorted(known, np.arange(n))
    rising = np.where(after < len(known), step[known[np.minimum(after, max(0, len(known) - 1))]] if len(known) else 0, -1) > 0
    direct = np.array(sorted(np.flatnonzero(rising).tolist(), key=lambda i: text[i : i + depth]), np.int64)
    # one bucket for each first byte; within it those that are not rising come first
    counts = np.bincount(raw, minlength=256)
    begin = np.concatenate([[0], np.cumsum(counts)])
    order = np.full(n, -1, np.int64)
    heads = begin[:-1].copy()
    first = raw[direct]
    sizes = np.bincount(first, minlength=256)
    at = 0
    for c in np.flatnonzero(sizes):
        order[begin[c + 1] - sizes[c] : begin[c + 1]] = direct[at : at + sizes[c]]
        at += sizes[c]

    def place(found: np.ndarray) -> None:
        """Suffixes before those found, if they are not rising, go to the heads of their buckets in the same order."""
        before = found[found > 0] - 1
        before = before[~rising[before]]
        bytes_ = raw[before]
        by = np.argsort(bytes_, kind="stable")
        before, bytes_ = before[by], bytes_[by]
        many = np.bincount(bytes_, minlength=256)
        offset = np.arange(len(before)) - np.concatenate([[0], np.cumsum(many)[:-1]])[bytes_]
        order[heads[bytes_] + offset] = before
        heads[:] += many

    place(np.array([n - 1]) + 1)  # the empty suffix is the least
    for c in range(256):
        at, end = begin[c], begin[c + 1]
        while at < heads[c]:  # runs of this byte extend the bucket while it is scanned
            to = heads[c]
            place(order[at:to])
            at = to
        if at < end:
            place(order[at:end])
    return order


def _blocks(strings: list[bytes]):
    """Strings put end to end in blocks of some megabytes: (number of the first, text, ends)."""
    at = 0
    while at < len(strings):
        to, size = at, 0
        while to < len(strings) and (size == 0 or size + len(strings[to]) <= BLOCK):
            size += len(strings[to])
            to += 1
        yield at, b"".join(strings[at:to]), np.cumsum([len(x) for x in strings[at:to]])
        at = to


def _twice(strings: list[bytes], window: int, part: int, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of one class of hashes whose hash occurs twice or more: string, offset, hash. Others cannot be repeated."""
    found = []
    for first, text, ends in _blocks(strings):
        raw = np.frombuffer(text, np.uint8)
        at = np.arange(max(0, len(raw) - window + 1))
        whose = np.searchsorted(ends, at, side="right")
        at, whose = at[inside := at + window <= ends[whose]], whose[inside]  # none crosses into the next string
        h = span_hashes(raw, at, at + window)
        if parts > 1:
            at, whose, h = (x[own] for own in [h % np.uint64(parts) == part] for x in (at, whose, h))
        found.append((whose + first, at - np.concatenate([[0], ends])[whose], h))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    whose, at, h = (np.concatenate([f[i] for f in found]) for i in range(3))
    order = np.sort(h)
    again = np.unique(order[1:][order[1:] == order[:-1]])
    keep = again[np.minimum(np.searchsorted(again, h), max(0, len(again) - 1))] == h if len(again) else np.zeros(len(h), bool)
    return whose[keep], at[keep], h[keep]


def _sorted_repeats(strings: list[bytes], window: int) -> list[np.ndarray]:
    """Repeated windows of distinct strings by their suffix order and the common prefixes of neighbours."""
    text = b"".join(strings)
    ends = np.cumsum([len(s) for s in strings])
    order = suffix_order(text, window)
    order = order[order + window <= ends[np.searchsorted(ends, order, side="right")]]
    found = np.zeros(len(text), bool)
    raw = np.frombuffer(text, np.uint8)
    if len(order) > 1:
        a, b = order[:-1], order[1:]
        for i in np.flatnonzero((raw[a] == raw[b]) & (raw[a + window - 1] == raw[b + window - 1])).tolist():
            x, y = int(a[i]), int(b[i])
            if text[x : x + window] == text[y : y + window]:  # the common prefix is a window or more
                found[x] = found[y] = True
    starts = ends - np.array([len(s) for s in strings])
    return [np.flatnonzero(found[s:e]) for s, e in zip(starts, ends, strict=True)]


def _repeated(window: int):
    def repeated(strings: list[bytes]) -> list[np.ndarray]:
        """Stretches of windows whose hash occurs twice are cut out, equal ones put together, and the rest is suffix-sorted.

        Strings of one minimiser that are too many for that are compared window by window in classes of hashes.
        """
        parts = 1 + sum(map(len, strings)) // LARGE
        found: list[list] = [[] for _ in strings]
        for part in range(parts):
            whose, at, h = _twice(strings, window, part, parts)
            if parts == 1:
                cuts = np.flatnonzero((np.diff(at) != 1) | (np.diff(whose) != 0)) + 1
                places: dict[bytes, list[tuple[int, int]]] = {}
                for k, run in zip(np.split(whose, cuts), np.split(at, cuts), strict=True):
                    if len(run):
                        places.setdefault(strings[k[0]][run[0] : run[-1] + window], []).append((int(k[0]), int(run[0])))
                for (piece, where), own in zip(places.items(), _sorted_repeats(list(places), window) if places else [], strict=True):
                    own = np.arange(len(piece) - window + 1) if len(where) > 1 else own
                    for k, start in where:
                        found[k].append(own + start)
                continue
            order = np.argsort(h, kind="stable")
            for i, j in zip(order[:-1].tolist(), order[1:].tolist(), strict=True):
                if h[i] == h[j] and strings[whose[i]][at[i] : at[i] + window] == strings[whose[j]][at[j] : at[j] + window]:
                    found[whose[i]].append(at[i : i + 1])
                    found[whose[j]].append(at[j : j + 1])
        return [np.unique(np.concatenate(x)) if x else np.zeros(0, np.int64) for x in found]

    return repeated


def _finish(window: int):
    def finish(text: bytes, gone: list[tuple[int, int]], copies: int) -> tuple[int, int, int, str]:
        if copies > 1 and len(text) >= window:
            gone = [(0, len(text))]
        kept, at = hashlib.sha256(), 0
        for a, b in gone:
            kept.update(text[at:a])
            at = b
        kept.update(text[at:])
        return len(text), sum(b - a for a, b in gone), len(gone), kept.hexdigest()

    return finish


def units(window: int = 400, gram: int = 32) -> Units:
    return Units(window, gram, lambda text: (np.frombuffer(text, np.uint8), None, None), lambda text, runs: (text[a : a + n + window - 1] for a, n in runs), _repeated(window), _finish(window), "n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeated_bytes(docs: DataFrame, *, window: int = 400, gram: int = 32, id_col: str = "doc_id", text_col: str = "text", heavy: int = HEAVY) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    return remove_repeats(docs, units(window, gram), id_col=id_col, text_col=text_col, heavy=heavy)
