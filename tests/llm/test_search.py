"""Nearest neighbours, lexical search and importance resampling against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pitframe.llm import importance, lexical, neighbours
from pitframe.llm.queries import op11_nearest_neighbours, op12_ranked_lexical_search, op13_importance_resampling

SMALL = "/root/testdata/sf0.001"
ODD = [None, "", " \n\t ", "a", "same same SAME same", "x" * 5000, "é漢 🙂\u0000 end", "A1-b2_c3 ÀÉ ß", "w " * 600, "tail " * 40_000]
DOCS = "doc_id long, text string, id long, n long, score string, rank string, terms string, s long, before string"


def frame(spark, texts, copies=1):
    rows = [(i if i != 3 else None, t, i, i, "a", "b", "c", i, "d") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[4:5] * copies, DOCS).repartition(3)


# 11
def brute_nearest(rows, k, is_query):
    """{query: [(distance, id)]} over (id, vector) rows, by the definition."""
    out = {}
    rows = list({(i, tuple(v)) for i, v in rows})
    for i in {i for i, _ in rows if is_query(i)}:
        best = {}
        for q in (v for j, v in rows if j == i):
            for j, v in rows:
                if j != i:
                    best[j] = min(best.get(j, math.inf), math.dist(q, v))
        out[i] = sorted((d, j) for j, d in best.items())[:k]
    return out


def by_query(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_probes_come_in_order_of_their_chance_and_reach_the_goal():
    r = np.random.default_rng(5)
    family = neighbours.Family(1.0, 6, 16)
    hits = total = 0
    for q in r.standard_normal((40, 16)):
        probes = family.probes(q)
        assert all(len(set(p.tolist())) == len(p) for p in probes)
        assert all(family.codes(q[None])[0, t] in p for t, p in enumerate(probes))
        step = r.standard_normal((50, 16))
        near = q + step / np.linalg.norm(step, axis=1)[:, None]
        codes = family.codes(near)
        hits += sum(any(c in set(p.tolist()) for c, p in zip(row, probes, strict=True)) for row in codes)
        total += len(near)
        at = (q @ family.a[0] + family.b[0]) / family.width
        all_cells = {}
        for steps in np.ndindex(*[3] * 6):
            edges = (np.array(steps) - 1 - (at - np.floor(at))) * neighbours.WIDTH
            chance = math.prod(0.5 * math.erfc(-(e + neighbours.WIDTH) / 2**0.5) - 0.5 * math.erfc(-e / 2**0.5) for e in edges)
            all_cells[int(((np.floor(at).astype(np.int64) + np.array(steps) - 1) * family.mix[0]).sum())] = chance
        seen = [all_cells[int(c)] for c in probes[0]]
        assert seen == sorted(seen, reverse=True) and np.isclose(seen, sorted(all_cells.values(), reverse=True)[: len(seen)]).all()
    assert hits / total >= 0.93


def test_recall_and_scores(spark):
    """Clusters, one vector that a third of the rows share, and queries far from all others."""
    r = np.random.default_rng(3)
    centres = r.standard_normal((12, 24))
    rows = [(i, (centres[i % 12] + 0.6 * r.standard_normal(24)).tolist()) for i in range(2600)]
    rows += [(i, rows[7][1]) for i in range(2600, 3900)]
    rows += [(i, (30 * r.standard_normal(24)).tolist()) for i in range(3900, 3920)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6)
    got, want = by_query(neighbours.nearest(df, F.col("id") % 20 == 0)), brute_nearest(rows, 10, lambda i: i % 20 == 0)
    assert set(got) == set(want) and all(len(got[q]) == 10 for q in want)
    held = {i: v for i, v in rows}
    assert all(np.isclose(s, math.dist(held[q], held[i]), rtol=1e-12) for q, near in got.items() for s, i in near)
    found = [len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want]
    assert sum(found) / (10 * len(want)) >= 0.9
    copies = [q for q in want if q >= 2600 and q < 3900]
    assert len(copies) == 65 and all([i for _, i in got[q]] == [i for _, i in want[q]] for q in copies)  # ties to the smallest ids
    assert got[3900] == [(s, i) for s, i in got[3900]] and {i for _, i in got[3900]} == {i for _, i in want[3900]}


def test_neighbours_defined_cases(spark):
    nan, inf = math.nan, math.inf
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (100, [0.0, 1.0]), (200, [0.5, nan]), (300, [inf, 1.0]), (400, None), (500, [0.0, 0.0]), (600, []), (700, [1.0, None]), (None, [1.0, 1.0]), (800, [1.0, 2.0, 3.0]), (3, [1.0, 0.0]), (4, [-1.0, 0.5]), (0, [3.0, 3.0]), (100, [-0.0, 1.0])]
    df = spark.createDataFrame([(i, v, 1, 2.0, "x", "y") for i, v in rows], "vec_id long, embedding array<double>, node long, score double, query string, vec string").repartition(3)
    got = by_query(neighbours.nearest(df, F.col("id") % 100 == 0))
    usable = [(i, v) for i, v in rows if i in (0, 3, 4, 100)]
    want = brute_nearest(usable, 10, lambda i: i % 100 == 0)
    assert {q: [i for _, i in near] for q, near in got.items()} == {q: [i for _, i in near] for q, near in want.items()}
    assert [s for s, _ in got[0]] == [s for s, _ in want[0]]
    for none in (df.limit(0), df.filter("vec_id = 500"), df.filter("vec_id = 100")):
        assert neighbours.nearest(none, F.col("id") % 100 == 0).collect() == []


def test_query_recall(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got, want = by_query(op11_nearest_neighbours(spark, sf)), brute_nearest(rows, 10, lambda i: i % 100 == 0)
    assert set(got) == set(want)
    assert sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want) >= 0.9 * 10 * len(want)


# 12
def brute_search(docs, items, k=10):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    split = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in pattern.findall(t or "")]
    held = [(i, split(t)) for i, t in docs]
    n_docs, n_terms = sum(bool(w) for _, w in held), sum(len(w) for _, w in held)
    df = Counter(t for _, w in held for t in set(w))
    out = []
    for item, text in sorted({(i, t) for i, t in items if i is not None and t is not None}):
        scored = []
        for i, w in held:
            tf, s = Counter(w), 0
            for t in split(text):
                if tf[t]:
                    m = 100 - 75 + (75 * len(w) * n_docs) // n_terms
                    s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * tf[t]) // (1000 * tf[t] + 8 * m))
            if s > 0 and i is not None:
                scored.append((-s, i))
        out += [(item, rank, i, -s) for rank, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def test_search_query(spark):
    docs, items = ([(r[0], r[1]) for r in spark.read.parquet(f"{SMALL}/{t}.parquet").select(c, "text").collect()] for t, c in (("documents", "doc_id"), ("benchmark", "item_id")))
    assert sorted((r.item_id, r["rank"], r.doc_id, r.score) for r in op12_ranked_lexical_search(spark, SMALL).collect()) == brute_search(docs, items)


def test_search_defined_cases(spark, monkeypatch):
    monkeypatch.setattr(lexical, "TREE_ROWS", 5)
    r = np.random.default_rng(1)
    texts = ODD + [" ".join(r.choice(["a", "b", "Same", "éÀ", "w", "x9", "tail"], 6)) for _ in range(60)]
    docs = frame(spark, texts, 3)
    items = [(1, "same a w"), (1, "same a w"), (1, "tail"), (2, None), (None, "a"), (3, ""), (4, "absent"), (5, "X9 b b é漢 éÀ a1"), (6, "z" * 50 + " w")]
    asked = spark.createDataFrame([(i, t, 5, "c") for i, t in items], "item_id long, text string, rank long, id string")
    rows = [(x.doc_id, x.text) for x in docs.collect()]
    want = brute_search(rows, items)
    for chars in (500_000, 20):  # one block of items, and several
        got = lexical.search(docs, asked, block_chars=chars)
        assert sorted((x.item_id, x["rank"], x.doc_id, x.score) for x in got.collect()) == want
    assert lexical.search(docs.limit(0), asked).collect() == [] == lexical.search(docs, asked.limit(0)).collect()


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 300), st.integers(1, 12), st.integers(1, 9))
def test_balls_lose_no_document(seed, m, width, leaf):
    r = np.random.default_rng(seed)
    lengths = r.integers(1, width + 1, m)
    cols = np.concatenate([r.permutation(width)[:n] for n in lengths])
    vals = r.integers(1, 10 ** int(r.integers(1, 7)), len(cols))
    tree = lexical.BallTree(lengths, cols, vals, width, leaf)
    dense = np.zeros((m, width), np.int64)
    dense[np.repeat(np.arange(m), lengths), cols] = vals
    assert sorted(tree.order.tolist()) == list(range(m)) and tree.spans[-1][-1] == m
    asked = r.permutation(width)[: int(r.integers(1, width + 1))]
    weights, by_col, best = r.integers(0, 9000, len(asked)), np.zeros(width, np.int64), []
    by_col[asked] = weights
    scores = dense @ by_col
    upper = tree.bounds(asked, weights)
    level = 0
    for bounds in tree.spans:
        for j in range(len(bounds) - 1):
            assert upper[level + j] >= scores[tree.order[bounds[j] : bounds[j + 1]]].max()
        level += len(bounds) - 1
    tree.search(asked, weights, by_col, np.arange(m), best, 10)
    assert sorted(best, reverse=True) == sorted(((int(s), -i) for i, s in enumerate(scores) if s > 0), reverse=True)[:10]


def test_balls_prune():
    """Groups within groups: only leaves of the group that the item asks for are scored."""
    r = np.random.default_rng(2)
    group = r.permutation(np.arange(1600) % 16)
    # one coordinate for each group at each of four levels
    cols = np.stack([(1 << level) - 1 + (group >> (4 - level)) for level in range(1, 5)], axis=1).ravel()
    tree = lexical.BallTree(np.full(1600, 4), cols, np.tile([900, 700, 500, 300], 1600) + r.integers(0, 9, 6400), 31, 25)
    weights, asked = np.zeros(31, np.int64), np.array([1, 4, 9, 20])
    weights[asked] = 7
    best: list = []
    assert tree.search(asked, np.full(4, 7), weights, np.arange(1600), best, 10) <= 400
    assert len(best) == 10 and all(group[-i] == 5 for _, i in best)


# 13
def brute_draw(docs, target, longest, buckets=10_000, percent=10, min_words=20, seed=2024):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def grams(t):
        w = pattern.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    held = [(i, *grams(t)) for i, t in docs]
    s, t = Counter(b for *_, g in held for b in g), Counter(b for x in target for b in grams(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    rows = []
    for i, n_words, g in held:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(map(gain, g)) // len(g) if g else 0
        rows.append([i, len(g), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n_words])
    fit = sorted((r for r in rows if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(fit[: percent * len(fit) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in rows), key=str)


def as_rows(df):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()), key=str)


def test_draw_query(spark):
    docs, items = ([tuple(r) for r in spark.read.parquet(f"{SMALL}/{t}.parquet").select(c, "text").collect()] for t, c in (("documents", "doc_id"), ("benchmark", "item_id")))
    assert as_rows(op13_importance_resampling(spark, SMALL)) == brute_draw(docs, [t for _, t in items], 1)


def test_draw_defined_cases(spark, monkeypatch):
    monkeypatch.setattr(importance, "PART", 64)
    r = np.random.default_rng(4)
    texts = ODD[:9] + [" ".join(r.choice(["a", "b", "Same", "éÀ", "w", "x9", "tail"], int(r.integers(1, 60)))) for _ in range(80)]
    docs = frame(spark, texts, 40)
    target = spark.createDataFrame([("Same a tail", 1), (None, 2), ("éÀ éÀ b", 3)], "text string, doc_id long")
    rows, wanted = [(x.doc_id, x.text) for x in docs.collect()], ["Same a tail", None, "éÀ éÀ b"]
    for longest, percent in ((1, 10), (3, 60)):
        assert as_rows(importance.resample(docs, target, longest=longest, percent=percent, buckets=500, min_words=4)) == brute_draw(rows, wanted, longest, 500, percent, 4)
    assert importance.resample(docs.limit(0), target).collect() == []
    assert as_rows(importance.resample(docs, target.limit(0), longest=1)) == brute_draw(rows, [], 1)


def test_keys_are_those_of_the_library():
    words = ["x" * n for n in range(1, 70)] + ["é漢" * n for n in range(1, 20)]
    grams = importance.Grams([" ".join(words)], 2)
    want = [xxhash.xxh64_intdigest(grams.buffer[a:b]) for a, b in zip(grams.starts.tolist(), grams.ends.tolist(), strict=True)]
    assert importance.xxh64(grams, grams.starts, grams.ends).tolist() == want


def test_equal_hashes_are_settled_by_bytes(monkeypatch):
    """All n-grams of a length under one hash: slots still belong to one n-gram each."""
    monkeypatch.setattr(importance, "xxh64", lambda grams, starts, ends: (ends - starts).astype(np.uint64))
    grams = importance.Grams(["ab cd ab ef cd ab", "ef gh ab", None, "abc"], 1)
    (doc, table), = grams.parts(10_000)
    words = [grams.buffer[a:b] for a, b in zip(grams.starts.tolist(), grams.ends.tolist(), strict=True)]
    assert doc.tolist() == [0] * 6 + [1] * 3 + [3]
    assert len(table.taken) == 5 and {w: int(table.count[s]) for w, s in zip(words, table.slots, strict=True)} == Counter(words)
    assert all(table.bucket[s] == zlib.crc32(w) % 10_000 for w, s in zip(words, table.slots, strict=True))
