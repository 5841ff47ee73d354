"""Substring dedup over windows of words by super-k-mers (operator 9).

Consecutive windows of ``window`` words that share a minimiser travel as one packed string to the minimiser's bucket,
where the windows are sorted and equal neighbours counted exactly. Every word under a window that starts twice or more
anywhere is removed; windows are judged on the input.

Defined cases: a null or empty text has no words and keeps the empty string; texts shorter than a window lose nothing;
repeated rows count as documents of their own; overlapping repeats within one text count; an empty table gives an empty
result; other columns are not carried. Texts are never cut.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from .repeats import HEAVY, Units, digest, merged, remove_repeats, span_hashes

#: Bytes of a text whose words are hashed together; a longer word is hashed by itself.
BLOCK = 1 << 17
_gap = re.compile(rb"[\x20\x09-\x0D]")
_space = np.zeros(256, bool)
_space[[9, 10, 11, 12, 13, 32]] = True


def word_spans(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The text's bytes, and where each word starts and ends."""
    raw = np.frombuffer(text, np.uint8)
    word = np.concatenate([[False], ~_space[raw], [False]])
    edges = np.flatnonzero(word[1:] != word[:-1])
    return raw, edges[::2], edges[1::2]


def _symbols(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A hash of each word, and where it begins and ends, block by block."""
    hashes, begin, end, at = [], [], [], 0
    while True:
        to = at + BLOCK
        if to < len(text):
            to = gap.start() if (gap := _gap.search(text, to)) else len(text)
        raw, starts, ends = word_spans(text[at:to])
        if len(starts) and ends[-1] - starts[-1] > BLOCK:  # only the last word of a block can be so long
            hashes += [span_hashes(raw[: starts[-1]], starts[:-1], ends[:-1]), np.frombuffer(digest(raw[starts[-1] : ends[-1]].tobytes())[:8], np.uint64)]
        else:
            hashes.append(span_hashes(raw, starts, ends))
        begin.append(starts + at)
        end.append(ends + at)
        at = to
        if at >= len(text):
            return tuple(x[0] if len(x) == 1 else np.concatenate(x) for x in (hashes, begin, end))


def kept_text(text: bytes, gone: list[tuple[int, int]]) -> bytes:
    """The words outside the intervals, joined by one space."""
    kept, at = [], 0
    if len(text) <= BLOCK:
        words = text.split()
        for a, b in merged(gone):
            kept += words[at:a]
            at = b
        return b" ".join(kept + words[at:])
    _, starts, ends = word_spans(text)
    for a, b in [*merged(gone), (len(starts), len(starts))]:
        if at < a:
            kept += text[starts[at] : ends[a - 1]].split()
        at = b
    return b" ".join(kept)


def _finish(window: int):
    def finish(text: bytes, gone: list[tuple[int, int]], copies: int) -> tuple[int, int, str]:
        n = len(text.split()) if len(text) <= BLOCK else len(word_spans(text)[1])
        if copies > 1 and n >= window:
            gone = [(0, n)]
        return n, sum(b - a for a, b in gone), hashlib.sha256(kept_text(text, gone)).hexdigest()

    return finish


def _pack(window: int):
    def pack(text: bytes, runs: list[tuple[int, int]]) -> Iterator[bytes]:
        if len(text) <= BLOCK:
            words = text.split()
            return (b" ".join(words[a : a + n + window - 1]) for a, n in runs)
        _, starts, ends = word_spans(text)  # no list of all words of a long text
        return (b" ".join(text[starts[a] : ends[a + n + window - 2]].split()) for a, n in runs)

    return pack


def _window_hashes(symbols: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """Hashes of the windows that begin at these places (sorted), in blocks."""
    parts = [np.zeros(0, np.uint64)]
    for lo in range(0, len(symbols), BLOCK):
        own = at[np.searchsorted(at, lo) : np.searchsorted(at, lo + BLOCK)] - lo
        parts.append(span_hashes(symbols[lo : lo + BLOCK + window], own, own + window))
    return np.concatenate(parts)


def _repeated(window: int):
    def repeated(strings: list[bytes]) -> list[np.ndarray]:
        """Sorts all windows of the strings by a hash of their words; equal neighbours with equal bytes are repeated."""
        text = b" ".join(strings)
        hashes, starts, ends = _symbols(text)
        sizes = np.fromiter((s.count(b" ") + 1 for s in strings), np.int64, len(strings))
        begin = np.cumsum(sizes) - sizes
        whose = np.repeat(np.arange(len(strings)), sizes)
        at = np.flatnonzero(np.arange(len(whose)) - begin[whose] + window <= sizes[whose])
        h = _window_hashes(hashes, at, window)
        order = np.argsort(h, kind="stable")
        at, h = at[order], h[order]
        same = np.flatnonzero(h[1:] == h[:-1]) + 1
        found = np.zeros(len(whose), bool)
        a, b = starts[at], ends[at + window - 1]
        group: dict[bytes, int] = {}  # windows of one hash, should they differ, are told apart by their bytes
        last = -1
        for i in same.tolist():
            if i - 1 != last:
                group = {text[a[i - 1] : b[i - 1]]: i - 1}
            last = i
            if (first := group.setdefault(text[a[i] : b[i]], i)) != i:
                found[at[i]] = found[at[first]] = True
        return [np.flatnonzero(found[x : x + n]) for x, n in zip(begin.tolist(), sizes.tolist(), strict=True)]

    return repeated


def units(window: int = 35, gram: int = 4, text: bool = False) -> Units:
    base = Units(window, gram, _symbols, _pack(window), _repeated(window), _finish(window), "n_words long, n_removed long, kept_sha256 string")
    if not text:
        return base

    def finish(content: bytes, gone: list[tuple[int, int]], copies: int) -> tuple[str]:
        n = len(content.split())
        if copies > 1 and n >= window:
            gone = [(0, n)]
        return (kept_text(content, gone).decode() if gone else content.decode(),)

    return Units(window, gram, _symbols, _pack(window), _repeated(window), finish, "kept_text string")


def remove_repeated_words(docs: DataFrame, *, window: int = 35, gram: int = 4, id_col: str = "doc_id", text_col: str = "text", heavy: int = HEAVY, text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, carry, n_words, n_removed, kept_sha256) of every row, or with ``text`` (id, carry, kept_text).

    Kept words are joined by one space; with ``text`` a row that loses nothing keeps its text as it is.
    """
    return remove_repeats(docs, units(window, gram, text), id_col=id_col, text_col=text_col, heavy=heavy, carry=carry)
