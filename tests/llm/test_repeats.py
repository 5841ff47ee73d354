"""Operators 3 and 9 against brute force, on small fixtures and on a whole small table."""

import hashlib
import random
from collections import Counter

import pytest

from pitframe.llm import repeats
from pitframe.llm.substrings import remove_repeated_words
from pitframe.llm.suffixes import remove_repeated_bytes, suffix_order

SCHEMA = "doc_id long, text string, digest string, h long"


def brute(texts, window, words):
    units = [(t or "").encode().split() if words else (t or "").encode() for t in texts]
    seen = Counter(tuple(u[i : i + window]) if words else u[i : i + window] for u in units for i in range(len(u) - window + 1))
    out = []
    for u in units:
        gone = [False] * len(u)
        for i in range(len(u) - window + 1):
            if seen[tuple(u[i : i + window]) if words else u[i : i + window]] > 1:
                gone[i : i + window] = [True] * window
        kept = [x for x, g in zip(u, gone) if not g]
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        digest = hashlib.sha256(b" ".join(kept) if words else bytes(kept)).hexdigest()
        out.append((len(u), sum(gone), digest) if words else (len(u), sum(gone), spans, digest))
    return out


def fixture(seed, words):
    r = random.Random(seed)
    vocabulary = ["a", "bé", "c", "dd", "e\u0000x", "漢"]
    text = lambda n: " ".join(r.choices(vocabulary, k=n))
    shared, base = text(30), text(60)
    out = [None, "", "a", " \n\t", base, base, base + " z", "y " + base, text(20) + " " + shared + " " + text(25), text(9) + "\n" + shared, "a " * 80, "abc" * 40, text(300)]
    for _ in range(15):  # near copies
        w = base.split()
        w[r.randrange(len(w))] = r.choice(vocabulary)
        out.append(" ".join(w))
    return out


def compare(spark, texts, words, window, gram, heavy):
    df = spark.createDataFrame([(i, t, "clash", 7) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    run = remove_repeated_words if words else remove_repeated_bytes
    got = run(df, window=window, gram=gram, heavy=heavy)
    assert [tuple(r)[1:] for r in got.orderBy("doc_id").collect()] == brute(texts, window, words)


@pytest.mark.parametrize("words,window,gram", [(True, 8, 2), (False, 20, 4)])
@pytest.mark.parametrize("heavy,block", [(1 << 20, 1 << 18), (60, 16)])
def test_small(spark, words, window, gram, heavy, block, monkeypatch):
    from pitframe.llm import substrings

    monkeypatch.setattr(repeats, "CHUNK", 500)
    monkeypatch.setattr(repeats, "BLOCK", block)
    monkeypatch.setattr(substrings, "BLOCK", block)
    compare(spark, fixture(1, words), words, window, gram, heavy)


def test_hot_contents_passages_and_strings(spark):
    """One content, one passage and one string of windows in most rows."""
    r = random.Random(8)
    word = lambda: "".join(r.choices("abcdefgh", k=5))
    passage = " ".join(word() for _ in range(14))
    texts = ["copy " * 3 + passage + " end"] * 60 + [f"{word()} {passage} {word()}" for _ in range(60)] + [f"{word()} {word()} {passage} {word()} {word()}" for _ in range(20)] + [None] * 30
    for words, window, gram in ((True, 8, 2), (False, 40, 6)):
        for heavy in (1 << 20, 200):
            compare(spark, texts, words, window, gram, heavy)


def test_words_longer_than_a_block(spark, monkeypatch):
    from pitframe.llm import substrings

    monkeypatch.setattr(substrings, "BLOCK", 10)
    long = "a b c " + "x" * 50 + " d e f g h i"
    compare(spark, [long, "q " + long + " z", "x" * 51 + " d e f g h i", long.replace("x", "y")], True, 4, 2, 1 << 20)


def test_many_strings_of_one_minimiser(monkeypatch):
    from pitframe.llm import substrings, suffixes

    r = random.Random(5)
    strings = ["".join(r.choices("ab", k=r.randint(5, 60))).encode() for _ in range(40)]
    seen = Counter(s[i : i + 12] for s in strings for i in range(len(s) - 11))
    expected = [[i for i in range(len(s) - 11) if seen[s[i : i + 12]] > 1] for s in strings]
    for block, large in ((1 << 20, 1 << 20), (100, 200)):
        monkeypatch.setattr(suffixes, "BLOCK", block)
        monkeypatch.setattr(suffixes, "LARGE", large)
        assert [x.tolist() for x in suffixes._repeated(12)(strings)] == expected
    words = [b" ".join(bytes([c]) for c in s) for s in strings]
    assert [x.tolist() for x in substrings._repeated(12)(words)] == expected
    monkeypatch.setattr(substrings, "span_hashes", lambda symbols, starts, ends: (starts * 0).astype("uint64"))  # all hashes collide
    assert [x.tolist() for x in substrings._repeated(12)(words)] == expected


def test_production_windows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    for run, window, words in ((remove_repeated_words, 35, True), (remove_repeated_bytes, 400, False)):
        got = {r[0]: tuple(r)[1:] for r in run(docs).collect()}
        expected = brute([t for _, t in rows], window, words)
        assert sum(e[1] for e in expected) > 0
        assert got == {i: e for (i, _), e in zip(rows, expected)}


def test_empty_table_and_repeated_rows(spark):
    for run, text in ((remove_repeated_words, "w " * 40), (remove_repeated_bytes, "x" * 450)):
        assert run(spark.createDataFrame([], "doc_id long, text string")).collect() == []
        got = run(spark.createDataFrame([(1, text), (1, text), (None, "short")], "doc_id long, text string")).collect()
        assert sorted((r[0] or 0, r[2]) for r in got) == [(0, 0), (1, 40 if run is remove_repeated_words else 450), (1, 40 if run is remove_repeated_words else 450)]


def test_suffix_order():
    r = random.Random(2)
    for n in (0, 1, 2, 3, 10, 60, 300):
        for letters in ("ab", "a", "abcd\x00\xff"):
            text = "".join(r.choices(letters, k=n)).encode("latin-1")
            assert suffix_order(text, 1000).tolist() == sorted(range(n), key=lambda i: text[i:])


def test_window_minima():
    import numpy as np

    x = np.random.default_rng(1).integers(0, 50, 97).astype(np.uint64)
    for width in (1, 2, 7, 96, 97):
        assert repeats.window_minima(x, width).tolist() == [x[i : i + width].min() for i in range(len(x) - width + 1)]
