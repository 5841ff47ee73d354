"""The remaining text operators against brute force, the tokenizer libraries, or held-out labels."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pitframe.llm import decontaminate, html_text, sentencepiece_stream, simhash, toxicity
from pitframe.llm.components import components
from pitframe.llm.quality import base_counts, quality
from pitframe.llm.queries import tokenizer_path
from pitframe.llm.token_counts import token_counts

SMALL = "/root/testdata/sf0.001"
ODD = [None, "", " \n\t ", "a", "same same same same", "x" * 5000, "é漢 🙂\u0000 end", "line one\nline one\n\nline two", "<|endoftext|> A  b\r\nC", "w " * 600]
SCHEMA = "doc_id long, text string, lang string, source string, fp string, id long, h long, y long, digest string"


def frame(spark, texts):
    rows = [(i if i != 3 else None, t, None if i % 4 == 0 else "en", f"s{i % 2}", "clash", i, i, i, "d") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[4:5], SCHEMA).repartition(3)  # one row twice


# 1
def test_pieces_equal_the_library():
    codec = sentencepiece_stream.Codec(tokenizer_path("piece_bpe_32k.model"), "bpe")
    r = random.Random(1)
    texts = ["".join(r.choices("abcdefghij eee▁  \né漢", k=r.randint(1, 80))) for _ in range(400)] + ["".join(r.choices(list(codec.ids), k=r.randint(1, 9))) for _ in range(400)]
    for text in [t for t in ODD if t] + texts + ["ab" * 700, " " * 70]:
        ids = codec.library.encode(text)
        assert codec.encode(text) == ids
        assert codec.decode(ids) == codec.library.decode(ids)
        assert [i for part in codec.stream(iter(codec.library.normalize(text))) for i in part] == ids  # the whole text as one stream


def test_pieces_stay_apart_as_merging_says():
    codec = sentencepiece_stream.Codec(tokenizer_path("piece_bpe_32k.model"), "bpe")
    names = {k: codec.texts[i] for k, (i,) in enumerate(codec.arrays.ids)}
    r = random.Random(7)
    joins = [divmod(int(k), codec.arrays.size) for k in r.sample(codec.arrays.join_keys[:-1].tolist(), 1500)]
    pairs = joins + [(r.randrange(len(names)), r.randrange(len(names))) for _ in range(3000)] + [(k, k) for k in r.sample(range(len(names)), 300)]
    got = codec.arrays.apart(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))
    assert got.tolist() == [codec.merges(names[a] + names[b]) == [names[a], names[b]] for a, b in pairs]


def test_stretches_and_the_stream_agree(monkeypatch):
    codec = sentencepiece_stream.Codec(tokenizer_path("piece_bpe_32k.model"), "bpe")
    texts = [r * 3 for r in ("two words\n\nthree  words ", "漢字かな交じり文", "ab\u200bcd 🙂", "x" * 40 + " y")]
    expected = [codec.library.encode(t) for t in texts]
    assert codec.encode_all(texts) == expected and codec.encode_all(texts[::-1]) == expected[::-1]
    monkeypatch.setattr(sentencepiece_stream, "REMEMBERED", 2)
    assert codec.encode_all(texts) == expected  # after forgetting
    codec.arrays, codec.words, codec.older = None, {}, {}
    assert codec.encode_all(texts) == expected  # every stretch through the window that commits by tracing back


def test_stretches_are_encoded_once(monkeypatch):
    """A vocabulary of 250,000 stretches, read three times, goes through the window once."""
    codec = sentencepiece_stream.Codec(tokenizer_path("piece_bpe_32k.model"), "bpe")
    seen = Counter()
    monkeypatch.setattr(type(codec.arrays), "encode", lambda self, part: seen.update(part) or [b"\0\0\0\0"] * len(part))
    for _ in range(3):
        for at in range(0, 250_000, 5_000):
            codec.encode_all([" ".join(f"w{k}" for k in range(at, at + 5_000))])
    assert len(seen) == 250_000 and set(seen.values()) == {1}


def test_table_of_numbers():
    r = np.random.default_rng(3)
    for n, top in ((0, 9), (1, 9), (3, 9), (500, 1000), (20_000, 1 << 60)):
        keys = r.choice(top, n, replace=False) if top < 1 << 20 else np.unique(r.integers(0, top, n))
        table = sentencepiece_stream.Table(keys, np.arange(len(keys)))
        known = dict(zip(keys.tolist(), range(len(keys))))
        asked = np.concatenate([keys, r.integers(0, top, 2000), keys + 1])
        assert table.find(asked).tolist() == [known.get(k, -1) for k in asked.tolist()]
    full = sentencepiece_stream.Table(np.arange(8) << 60, np.arange(8))  # all keys begin at one slot or few
    assert full.find(np.arange(8) << 60).tolist() == list(range(8))


def test_pieces_over_several_words(tmp_path):
    import sentencepiece

    r = random.Random(5)
    texts = [" ".join(r.choice(["of the", "in the", "a cat", "to be", "sat"]) for _ in range(12)) for _ in range(300)]
    sentencepiece.SentencePieceTrainer.train(sentence_iterator=iter(texts), model_prefix=str(tmp_path / "over"), model_type="bpe", vocab_size=60, split_by_whitespace=False, hard_vocab_limit=False, minloglevel=2)
    codec = sentencepiece_stream.Codec(str(tmp_path / "over.model"), "bpe")
    assert any("▁" in p.lstrip("▁") for p in codec.ids) and not codec.by_word
    for text in [*texts, "of the of the", "a cat sat " * 300]:
        assert codec.encode(text) == codec.library.encode(text)
    assert sentencepiece_stream.Codec(tokenizer_path("piece_bpe_32k.model"), "bpe").by_word


def test_unigram_is_the_best_path_and_windows_are_bounded():
    codec = sentencepiece_stream.Codec(tokenizer_path("piece_bpe_32k.model"), "unigram")
    r = random.Random(2)
    for _ in range(40):
        text = "".join(r.choices("thean", k=r.randint(1, 60)))
        best = [0.0] + [-np.inf] * len(text)
        for e in range(1, len(text) + 1):
            best[e] = max(best[e - n] + codec.scores[codec.ids[text[e - n : e]]] for n in range(1, min(e, codec.longest) + 1) if text[e - n : e] in codec.ids)
        ids = [i for part in codec.stream(iter(text)) for i in part]
        assert sum(codec.scores[i] for i in ids) == pytest.approx(best[-1]) and "".join(codec.texts[i] for i in ids) == text
    assert sum(1 for _ in codec.stream(iter("then" * 500))) > 10  # committed on the way


def test_pieces_in_spark(spark):
    model = tokenizer_path("piece_bpe_32k.model")
    out = sentencepiece_stream.decode(sentencepiece_stream.encode(frame(spark, ODD), model), model).collect()
    assert len(out) == len(ODD) + 1 and all(r.decoded == (r.text or "") for r in out)
    rows = sentencepiece_stream.round_trip(frame(spark, ODD), model).collect()
    assert all(r.exact for r in rows)
    assert sentencepiece_stream.round_trip(frame(spark, []).limit(0), model).collect() == []


# 2
def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    tri = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if tri[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality(spark):
    rows = [(r.id, r) for r in base_counts(frame(spark, ODD).withColumn("doc", F.col("id")), "doc").withColumnRenamed("doc", "id").collect()]
    for i, r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_counts(ODD[i])
    out = quality(frame(spark, ODD)).collect()
    assert len(out) == len(ODD) + 1 and all(not r.kept for r in out if r.base_failed)
    assert quality(frame(spark, []).limit(0)).collect() == []


def test_limits_follow_the_group(spark):
    """Symbols are odd where few texts have any, and usual where all have; a text far out of its own group goes."""
    r = random.Random(9)
    word = lambda: "".join(r.choices("abcdefgh", k=r.randint(3, 7)))
    text = lambda symbols: " ".join([word() for _ in range(100 - symbols)] + ["|"] * symbols if symbols else [word() for _ in range(100)])
    mixed = lambda symbols: " ".join(w for _ in range(symbols) for w in (word(), word(), word() + "|")) + " " + " ".join(word() for _ in range(100 - 3 * symbols))
    rows = [(i, text(0), "en", "prose") for i in range(300)] + [(1000 + i, mixed(10), "en", "prose") for i in range(20)]
    rows += [(2000 + i, mixed(8 + i % 5), "en", "code") for i in range(300)] + [(3000, mixed(33).replace("|", "||||||"), "en", "code")]
    kept = {x.doc_id for x in quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect() if x.kept}
    assert not kept & set(range(1000, 1020)) and 3000 not in kept
    assert len(kept & set(range(300))) > 290 and len(kept & set(range(2000, 2300))) > 290


# 5
def test_kernel_tolerates_gaps():
    value = lambda a, b: toxicity.kernel(toxicity.features([a]), toxicity.features([b]))[0, 0]
    assert value("idiot", "idiot") == pytest.approx(1)
    assert value("id.iot", "idiot") > 0.6 and value("idxiot", "idiot") > 0.6 and value("window", "idiot") < 0.2
    assert toxicity.words_of("you i d i o t now") == ["you", "idiot", "now"]


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    scored = toxicity.score(docs.join(labels, "doc_id"), model).filter(toxicity.held_out()).collect()
    right = sum(r._predicted == r.toxic for r in scored)
    toxic = [r._predicted for r in scored if r.toxic == 1]
    clean = [r._predicted for r in scored if r.toxic == 0]
    assert sum(toxic) / len(toxic) > 0.83 and sum(clean) / len(clean) < 0.03  # calling everything clean, or toxic, fails
    assert right / len(scored) > 0.96
    odd = toxicity.score(frame(spark, ODD), model).collect()
    assert len(odd) == len(ODD) + 1 and all(0 <= r._score <= 1 for r in odd)
    assert toxicity.score(frame(spark, []).limit(0), model).collect() == []


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(frame(spark, ODD), none)
    assert all(r._score < 1e-9 for r in toxicity.score(frame(spark, ODD), model).collect())


# 6
def test_token_counts_and_cache(spark, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    from pitframe.llm import token_counts as token_counts_module

    path, cache = tokenizer_path("word_bpe_49k.json"), str(tmp_path / "cache")
    library = Tokenizer.from_file(path)
    texts = ODD + [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").limit(60).collect()]
    count = lambda: {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(frame(spark, texts), path, cache, limit=50, by_word=True).collect()}
    expected = set()
    for i, t in enumerate(texts):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        expected.add((i if i != 3 else None, len((t or "").encode()), n, n > 50))
    assert count() == expected
    stored = spark.read.parquet(cache).count()
    monkeypatch.setattr(token_counts_module.Counter, "count", None)
    monkeypatch.setattr(token_counts_module, "_counter", None)  # nothing is encoded again: no encoder is there
    assert count() == expected and spark.read.parquet(cache).count() == stored
    monkeypatch.undo()
    monkeypatch.setattr(token_counts_module, "FEW", 0)  # by a shuffle
    more = texts + ["one more"]
    got = token_counts(frame(spark, more), path, cache, limit=50, by_word=True).collect()
    assert {tuple(r) for r in got if r.doc_id != len(texts)} == expected and spark.read.parquet(cache).count() == stored + 1
    assert token_counts(frame(spark, []).limit(0), path, str(tmp_path / "none"), limit=50, by_word=True).collect() == []


# 7
def test_main_text():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href="/a">menu</a></ul></nav><div class="ad">buy</div>
    <article><h1>Head &amp; more</h1><p><b>Bold start.<br><p>One  two\n three &lt;x&gt;</p><p>Be.</p><div class="comments"><p>reader says</p></div><form><input>f</form><script>var t="</p>";</script></article><footer>&copy; foot</footer>"""
    assert html_text.main_text(page) == "Head & more\n\nBold start.\n\nOne two three <x>\n\nBe."
    assert html_text.main_text(None) == html_text.main_text("<p></p>") == ""
    assert html_text.main_text("just text") == "just text"
    plain = "<body><div><a href=x>l1</a> <a href=y>l2</a></div><div><p>" + "long text here. " * 20 + "</p><p>" + "more of it. " * 20 + "</p></div></body>"
    assert html_text.main_text(plain).startswith("long text here.") and "l1" not in html_text.main_text(plain)
    assert html_text.main_text("<div>" * 3000 + "deep" + "</div>") == "deep"


def test_main_text_of_pages_without_article():
    long = lambda k: f"{k} " + "plain words of a section " * 8
    section = lambda k: "<section>" + "".join(f"<p>{long(f'{k}{i}')}</p>" for i in range(5)) + "</section>"
    links = "<div><a href=x>one</a> | <a href=y>two</a></div><ul><li><a href=z>three</a><li><a href=w>four</a></ul>"
    shown = [long(f"{k}{i}").strip() for k in "AB" for i in range(5)]
    for head in ("", "<h1>Head</h1>", "<h1>Head</h1><p>By me.</p>"):
        lead = re.findall(r">([^<]+)<", head)
        assert html_text.main_text(f"<body><div>{head}{section('A')}{section('B')}</div></body>").split("\n\n") == lead + shown
        for page in (f"{head}{section('A')}<p>Be.</p>{section('B')}", f"<div>{head}{section('A')}<p>Be.</p>{section('B')}</div>"):
            assert html_text.main_text(f"<body>{links}{page}{links}</body>").split("\n\n") == [*lead, *shown[:5], "Be.", *shown[5:]]
    assert html_text.main_text(f"<body><div>{section('A')}{section('B')}<p>End.</p>{links}</div></body>").split("\n\n") == [*shown, "End."]
    assert html_text.main_text(f"<body>{links}<article>{section('A')}</article><div>{section('B')}</div></body>").split("\n\n") == shown
    own = "Own words, with <a href=x>a link</a>, " + "of the node. " * 20
    assert html_text.main_text(f"<body><div>{section('A')}{own}{section('B')}</div></body>").split("\n\n") == [*shown[:5], re.sub("<.*?>", "", own).strip(), *shown[5:]]


def test_main_text_under_names_of_other_parts():
    words = "plain words of a page " * 20
    text = words.strip()
    for page in (
        f"<div class='content has-sidebar'><article><p>{words}</p></article></div>",
        f"<div class='content sidebar'><div id=widget><main><p>{words}</p></main></div></div><div class=related><p>other</p></div>",
        f"<div id=header><p>{words}</p></div><div class='ad'>buy</div>",
        f"<div class=widget><p>{words}</p></div><div class='related'><article>card</article><a href=x>{words}{words}</a></div>",
        f"<article><p>{words}</p></article><div class=related><article>card</article></div><div class=comments>{words}{words}</div>",
    ):
        assert text in html_text.main_text(f"<body>{page}</body>")
        assert not re.search("buy|other", html_text.main_text(f"<body>{page}</body>"))
    assert html_text.main_text(f"<body><article><p>{words}</p></article><div class=related><article>card</article></div><div class=comments>{words}{words}</div></body>") == text
    assert html_text.main_text("<body><article><p>Brief.</p></article><div class=ad>a much longer advert</div></body>") == "Brief."
    inside = f"<article><p>{words}</p><h2 id='related-work'>Related work</h2><section id=share-price><p>Price.</p></section><div class=share>tell</div></article>"
    assert html_text.main_text(f"<body>{inside}</body>").split("\n\n") == [text, "Related work", "Price."]


def brute_density(page, body):
    """Densities from the definition, each node by itself over its whole subtree."""

    def walk(i):
        chars = tags = link_chars = link_tags = 0
        for x in page.content[i]:
            if isinstance(x, str):
                chars += len(" ".join(x.split()))
            elif not page.dropped[x]:
                c, t, lc, lt = walk(x)
                chars, tags, link_chars, link_tags = chars + c, tags + t + 1, link_chars + lc, link_tags + lt + (page.tags[x] == "a")
        return chars, tags, chars if page.tags[i] == "a" else link_chars, link_tags

    import math

    c0, _, l0, _ = walk(body)
    out = []
    for i in range(len(page.tags)):
        c, t, lc, lt = walk(i)
        if page.dropped[i] or not c:
            out.append(0.0)
            continue
        inner = math.log(c / max(1, c - lc) * lc + l0 / max(1, c0) * c + math.e)
        base = math.log(inner + 1e-9) if inner > 1.0001 else 1.0
        out.append(c / max(1, t) * math.log(max(c / max(1, lc) * max(1, t) / max(1, lt), 1.0) + 1e-9) / max(1e-9, base))
    return out


def test_densities_by_brute_force():
    r = random.Random(11)

    def part(depth):
        if depth == 0 or r.random() < 0.3:
            return "".join(r.choices("abc  ", k=r.randint(0, 40)))
        tag = r.choice(["div", "p", "a", "ul", "li", "section", "b"])
        return f"<{tag}>" + "".join(part(depth - 1) for _ in range(r.randint(0, 4))) + f"</{tag}>"

    for _ in range(60):
        page = html_text.parse("<body>" + "".join(part(4) for _ in range(4)) + "</body>")
        body = page.tags.index("body")
        density, sums, _, _ = html_text._densities(page, body)
        expected = brute_density(page, body)
        assert density == pytest.approx(expected)
        assert sums == pytest.approx([sum(expected[x] for x in c if not isinstance(x, str)) for c in page.content])


def test_density_finds_the_article_without_names(spark):
    """Adverts that carry no name leave by their density alone, and an article needs no tag of its own."""
    pages = [x.html for x in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    named = [html_text.main_text(x) for x in pages]
    bare = [re.sub("<(/?)article", r"<\1div", re.sub(' class="ad"', "", x)) for x in pages]
    assert all(' class="ad"' in x for x in pages)
    assert sum(html_text.main_text(x) == y for x, y in zip(bare, named)) >= 0.98 * len(pages)


def test_lead_named_header_stays_in_an_article():
    words = "plain words of a page " * 20
    page = f"<body><div class=header>site</div><article><section class='header'><p>Lead.</p></section><p>{words}</p><div id=share-prices>Shares.</div></article></body>"
    assert html_text.main_text(page).split("\n\n") == ["Lead.", words.strip(), "Shares."]


# 8
def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(spark):
    for t in ODD + ["A B c", "É É b", "one two"]:
        assert simhash.fingerprint(t) == brute_fingerprint(t)


@pytest.mark.parametrize("bucket", [2048, 8])
def test_links_lose_no_pair(spark, bucket):
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(4)]
    fps = list(dict.fromkeys(base + [b ^ sum(1 << k for k in r.sample(range(64), r.randint(1, 5))) for b in base for _ in range(12)] + [0, 1, 3, 7, 15, 31]))
    nodes = spark.createDataFrame([(i, simhash._signed(f)) for i, f in enumerate(fps)], "node long, fp long")
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    got = {x.node: x.component for x in components(simhash.links(nodes, 3, bucket)).collect()}
    assert [got.get(i, i) for i in range(len(fps))] == label


def test_near_duplicates_cases(spark):
    out = {(r.doc_id, r.component) for r in simhash.near_duplicates(frame(spark, ODD)).collect()}
    assert (0, 0) in out and (1, 0) in out and (2, 0) in out  # empty ones link
    assert simhash.near_duplicates(frame(spark, []).limit(0)).collect() == []


# 10
@settings(deadline=None, max_examples=200)
@given(st.text("ab", min_size=1, max_size=9), st.text("abc", max_size=25))
def test_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern):
        new = [i + 1]
        for j, c in enumerate(text):
            new.append(min(row[j + 1] + 1, new[-1] + 1, row[j] + (p != c)))
        row = new
    least = min(row[1:], default=len(pattern))
    got = decontaminate.distance(pattern, text, len(pattern))
    if text and least <= len(pattern):
        assert got == (least, row[1:].index(least) + 1)


def test_matches_by_brute_force(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choices("abcdefgh", k=r.randint(2, 6)))
    items = [" ".join(word() for _ in range(14)) for _ in range(6)]
    docs = [None, "", "too short"]
    for item in items:
        for edits in (0, 1, 3, 9):
            text = list(item)
            for _ in range(edits):
                text[r.randrange(len(text))] = r.choice("xyz")
            docs.append(" ".join(word() for _ in range(20)) + " " + "".join(text).upper().replace(" ", ",  ") + " " + word())
    expected = set()
    for i, d in enumerate(docs):
        for k, item in enumerate(items):
            text, most = decontaminate.normalise(d), len(item) // 16
            found = decontaminate.distance(item, f" {text} ", most) if text else None
            if found:
                expected.add((i, k, found[0]))
    b = spark.createDataFrame([*enumerate(items), (90, None), (91, "")], "item_id long, text string")
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "doc_id long, text string")
    for block in (10_000, 100):
        got = {(x.doc_id, x.item_id, x.distance) for x in decontaminate.contaminated(df, b, block_chars=block).collect()}
        assert got == expected
    assert decontaminate.contaminated(df.limit(0), b).collect() == decontaminate.contaminated(df, b.limit(0)).collect() == []


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    now = docs
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, SMALL)
        if name != "sentencepiece":
            assert out.columns == docs.columns
        now = spark.createDataFrame(out.collect(), out.schema)
        counts.append(now.count())
    assert docs.count() >= counts[0] > counts[1] == counts[2] >= counts[3] == counts[4] > 0
    rows = now.collect()
    assert all(r.exact for r in rows) and len({r.doc_id for r in rows}) == len(rows)
    whole = corpus_pipeline.run(spark, SMALL).select("doc_id", "n_pieces").collect()
    assert sorted(map(tuple, whole)) == sorted((r.doc_id, r.n_pieces) for r in rows)


def test_pipeline_defined_cases(spark):
    """Null, empty and long texts, repeated rows, null ids, an empty table, and columns with clashing names."""
    import corpus_pipeline

    own = "doc_id long, text string, lang string, source string, n_chars long, _rows long, _score string, _matches string, kept_text string, piece_ids string, decoded long, digest string, h long"
    texts = [None, "", " \n ", "a b", "lone words " * 9 + "end", "tale " * 30_000, "é漢 🙂 x", "lone words " * 9 + "end"]
    rows = [(i, t, None, "s", 1, 2, "x", "y", "z", "p", 3, "d", 4) for i, t in enumerate(texts)]
    rows += [rows[4], (4, "another text of that id", None, "s", 1, 2, "x", "y", "z", "p", 3, "d", 4), (None, "no id", None, None, None, 2, "x", "y", "z", "p", 3, "d", 4)]
    docs = spark.createDataFrame(rows, own).repartition(3)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        none = stage(spark, docs.limit(0), SMALL)
        if name != "sentencepiece":
            assert out.columns == none.columns == docs.columns
        got = out.collect()
        assert none.collect() == [] and all(r._rows == 2 and r.kept_text == "z" and r.decoded == 3 and r.h == 4 for r in got)
        if name in ("toxicity", "benchmark_decontamination", "sentencepiece"):
            assert sorted((str(r.doc_id), str(r.text)) for r in got) == sorted((str(r[0]), str(r[1])) for r in rows)
        if name == "simhash_near_dedup":
            ids = [r.doc_id for r in got]
            assert len(ids) == len(set(ids)) and {0, 3, 5, 6, None} <= set(ids) and not {1, 2, 7} & set(ids)
        if name == "substring_dedup":
            assert len(got) == len(rows) and {r.doc_id: r.text for r in got}[5] == "" and {r.doc_id: r.text for r in got}[None] == "no id"
    assert got[0].piece_ids is not None and all(r.exact for r in got)


def test_sha_of_kept_text_is_that_of_words():
    from pitframe.llm.substrings import kept_text

    assert kept_text(b"a b\nc d", [(1, 2)]) == b"a c d" and hashlib.sha256(b"").hexdigest().startswith("e3b0")
