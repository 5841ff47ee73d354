"""Chat formatting: exact round trip, each prefix once, positions and attention by brute force."""

import hashlib

from hypothesis import given
from hypothesis import strategies as st

from pitframe.llm import chat
from pitframe.llm.queries import op4_chat_formatting

SCHEMA = "conv_id long, turn long, role string, text string, tokens string"
texts = st.text(alphabet="\\#<>/turn: \n ok", max_size=30)


@given(texts, texts)
def test_turn_round_trip(role, text):
    tokens, a, b = chat.format_turn(role, text)
    assert chat.parse_turn(tokens) == (role, text)
    assert chat.unescape(tokens[a:b]) == text


def expected(rows):
    out = {}
    for conv, _, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        role, text = role or "", text or ""
        n, turns, loss, chars = out.get(conv, (0, "", "", 0))
        out[conv] = (n + 1, turns + f"{role}\n{text}\n", loss + text * (role == "assistant"), chars + len(chat.format_turn(role, text)[0]))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return {c: (n, sha(t), len(x), sha(x), f) for c, (n, t, x, f) in out.items()}


ROWS = [
    *[(c, 0, "user", "same") for c in range(6)], *[(c, 1, "assistant", f"answer {c % 2}") for c in range(5)], (1, 2, "user", "more"), (3, 2, "user", "more"), (3, 3, "assistant", None),
    (10, 0, "system", "x"), (11, 0, None, "\\### Assistant: </turn> ok"), (12, 0, "assistant", ""), (12, 0, "assistant", ""), (12, None, "a:b", "###"), (None, 1, "user", "lost"), (13, 5, "assistant", "é漢 🙂"),
]


def test_small(spark):
    df = spark.createDataFrame([(*r, "clash") for r in ROWS], SCHEMA).repartition(3)
    segments, members = chat.prefix_tree(df)
    segments = segments.cache()
    got = {r[0]: tuple(r)[1:] for r in chat.read_back(segments, members).collect()}
    assert got == expected(ROWS)
    rows = sorted(segments.collect(), key=lambda r: r.seq_start)
    own = {}
    for conv in got:  # distinct prefixes
        turns = [(r[2] or "", r[3] or "") for r in sorted((x for x in ROWS if x[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))]
        for n in range(1, len(turns) + 1):
            own[tuple(turns[:n])] = "".join(chat.format_turn(*t)[0] for t in turns[: n - 1])
    assert len(rows) == len(own)
    assert [r.seq_start for r in rows] == [0, *(r.seq_end for r in rows[:-1])]  # no gap, nothing twice
    stream = "".join(r.tokens for r in rows)
    by_node = {bytes(r.node): r for r in rows}
    for r in rows:
        before = "".join(stream[a.start : a.end] for a in r.attends)
        assert len(before) == r.position_start == sum(a.end - a.start for a in r.attends)
        parent, chain = bytes(r.parent), ""
        while parent:
            chain, parent = by_node[parent].tokens + chain, bytes(by_node[parent].parent)
        assert before == chain and all(a.end <= r.seq_start for a in r.attends)


def test_whole_table_and_empty(spark):
    chats = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    probe = "\\### Assistant: </turn> ok"
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in chats.collect()] + [(-7, 0, "user", probe), (-7, 1, "assistant", probe)]
    got = {r[0]: tuple(r)[1:] for r in op4_chat_formatting(spark, "/root/testdata/sf0.001").collect()}
    assert got == expected(rows)
    empty = spark.createDataFrame([], SCHEMA)
    assert chat.read_back(*chat.prefix_tree(empty)).collect() == []
