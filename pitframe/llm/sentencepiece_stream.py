"""SentencePiece encoding and decoding by a streaming Viterbi search (operator 1).

The normalised text runs through a window bounded by the longest piece. Each boundary in the window keeps one surviving
path: for unigram models the one of highest score, for byte-pair models the one whose neighbouring pieces stay apart when
their joint text is merged, which is the library's segmentation. As soon as the surviving paths of the whole window go back
to one boundary, the ids up to it are committed and forgotten, so memory is bounded by the longest piece wherever paths
converge, whatever the length of the text.

In models where no piece holds a mark after another character (and none a line end with others), every surviving path goes
through the boundary before a mark or at a line end: there ids are committed without tracing paths back. Between two such
boundaries lies a stretch. The stretches of a batch that fit the window (twice the longest piece) advance side by side, one
boundary of each at a time, over an automaton of the pieces in an open-addressed table; ids committed for a stretch are remembered, as the same
stretch always gives the same. Longer stretches, and with other models whole texts, advance one character at a time and
commit by tracing back. The library normalises each whole text first.

Decoding turns ids to pieces and runs of byte pieces to characters.

Defined cases: null and empty texts have no ids and decode to the empty string; characters that no piece covers become
byte pieces, or the unknown id in models without them; repeated rows are treated alike; an empty table gives an empty result;
other columns stay as they are, and one that has the name of the new column is replaced. Texts are never cut.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MARK = "▁"
#: Stretches and pairs of pieces that a worker remembers, beyond which the older half goes; stretches that run side by side.
REMEMBERED, TOGETHER = 300_000, 4096
_ONE = (1,)
_codecs: dict[tuple[str, str], Codec] = {}


class Codec:
    """Encodes and decodes with the pieces of one model file; ``kind`` is the model's: bpe or unigram."""

    def __init__(self, path: str, kind: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.library.get_piece_size()
        plain = [i for i in range(n) if not (self.library.is_byte(i) or self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_unused(i))]
        self.kind, self.unknown = kind, self.library.unk_id()
        self.ids = {self.library.id_to_piece(i): i for i in plain}
        self.scores = {i: self.library.get_score(i) for i in plain}
        self.texts = {i: p for p, i in self.ids.items()}
        self.bytes = {int(self.library.id_to_piece(i)[1:-1], 16): i for i in range(n) if self.library.is_byte(i)}
        self.values = {i: b for b, i in self.bytes.items()}
        self.controls = {i for i in range(n) if self.library.is_control(i)}
        self.longest = max(map(len, self.ids))
        #: whether no piece goes over the start of a word, so that words can be encoded one by one; the same of line ends
        self.by_word = not any(MARK in p.lstrip(MARK) for p in self.ids)
        self.by_line = not any("\n" in p for p in self.ids)
        self.penalty = min(self.scores.values()) - 10.0
        #: what each id decodes to, as bytes
        self.raw = [self.texts[i].replace(MARK, " ").encode() if i in self.texts else bytes([self.values[i]]) if i in self.values else b"" if i in self.controls else " ⁇ ".encode() for i in range(n)]
        #: lengths of the pieces by their last two characters, the longest first, as those fit most often
        self.lengths: dict[str, list[int]] = {}
        for p in self.ids:
            if len(p) > 1:
                own = self.lengths.setdefault(p[-2:], [])
                if len(p) not in own:
                    own.append(len(p))
        self.lengths = {k: (*sorted(v, reverse=True), 1) for k, v in self.lengths.items()}
        #: ids of stretches, as little-endian 32-bit numbers
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        #: stretches between boundaries through which all paths go
        self.cut = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n" if self.by_line else f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        self.arrays = Arrays(self) if kind == "bpe" and all(c in self.ids for p in self.ids for c in p) else None

    def unmatched(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode()] if self.bytes else [self.unknown]

    def halves(self, piece: str) -> tuple[str, str] | None:
        """The two parts that the last merge of the piece's characters joins, or None if merging does not make it."""
        steps: list[tuple[str, str]] = []
        return steps[-1] if self.merges(piece, steps) == [piece] and steps else None

    def merges(self, text: str, steps: list | None = None) -> list[str]:
        """Pieces of a short text by merging neighbours, the best scored first, the leftmost among equals."""
        parts = list(text)
        while True:
            best, where = None, -1
            for i in range(len(parts) - 1):
                k = self.ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or self.scores[k] > best):
                    best, where = self.scores[k], i
            if best is None:
                return parts
            if steps is not None:
                steps.append((parts[where], parts[where + 1]))
            parts[where : where + 2] = [parts[where] + parts[where + 1]]

    def fit(self, left: str, right: str) -> bool:
        """Whether these neighbours stay apart when their joint text is merged."""
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > REMEMBERED:
                self.pairs.clear()
            known = self.pairs[key] = self.merges(left + right) == [left, right]
        return known

    def _survivor(self, text: str, window: list, end: int, boundary: int) -> tuple[float, str, int] | None:
        """The path that survives at ``end`` of the text: its score, last piece, and the boundary before that piece.

        ``window`` holds the survivors of earlier ends; boundaries are counted from ``boundary`` ends before this one.
        """
        best = None
        ids, pairs, bpe = self.ids, self.pairs, self.kind == "bpe"
        for n in self.lengths.get(text[end - 2 : end], _ONE):
            if n > end or (before := window[end - n]) is None:
                continue
            piece = text[end - n : end]
            if (k := ids.get(piece)) is None:
                if n > 1:
                    continue
                score = before[0] + self.penalty  # a character without a piece stands alone
            elif bpe:
                if before[1] and not (known if (known := pairs.get((before[1], piece))) is not None else self.fit(before[1], piece)):
                    continue
                return (0.0, piece, boundary + end - n)  # at most one fits
            else:
                score = before[0] + self.scores[k]
            if best is None or score > best[0]:
                best = (score, piece, boundary + end - n)
        return best

    def stream(self, chars: Iterator[str]) -> Iterator[list[int]]:
        """Ids of a normalised text, committed as soon as all surviving paths agree on them."""
        base, text = 0, ""
        window: list[tuple[float, str, int] | None] = [(0.0, "", -1)]
        for char in chars:
            text += char
            window.append(self._survivor(text, window, len(text), base))
            if len(window) > 2 * self.longest:
                # paths that can still grow end at the last ``longest`` boundaries
                alive = {k for k in range(len(window) - self.longest, len(window)) if window[k] is not None}
                meet = self._meet(window, base, alive)
                if meet > base:
                    yield self._ids(window, base, meet)
                    text = text[meet - base :]
                    last = window[meet - base]
                    window = [(last[0], last[1], -1), *window[meet - base + 1 :]]
                    base = meet
        if text:
            yield self._ids(window, base, base + len(text))

    @staticmethod
    def _meet(window: list, base: int, alive: set[int]) -> int:
        """The last boundary through which every surviving path goes."""
        at = set(alive)
        while len(at) > 1:
            k = max(at)
            at.remove(k)
            at.add(window[k][2] - base)
        return base + at.pop()

    def _ids(self, window: list, base: int, end: int) -> list[int]:
        out: list[list[int]] = []
        while end > base:
            _, piece, before = window[end - base]
            out.append([self.ids[piece]] if piece in self.ids else self.unmatched(piece))
            end = before
        return [i for ids in reversed(out) for i in ids]

    def encode(self, text: str | None) -> list[int]:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text; the stretches of all of them that are not known yet go through the window together."""
        return [np.frombuffer(x, "<i4").tolist() for x in self.encode_bytes(texts)]

    def encode_bytes(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers."""
        plain = [self.library.normalize(t) if t else "" for t in texts]
        if not self.by_word:
            return [self._streamed(t) for t in plain]
        stretches = [self.cut.findall(t) for t in plain]
        if len(self.words) > REMEMBERED:
            self.older, self.words = self.words, {}
        fresh, long = [], set()
        for x in set(chain.from_iterable(stretches)).difference(self.words):
            if (ids := self.older.get(x)) is not None:
                self.words[x] = ids
            elif len(x) > 2 * self.longest or self.arrays is None:
                long.add(x)
            else:
                fresh.append(x)
        fresh.sort(key=len)  # so that stretches side by side end together
        for at in range(0, len(fresh), TOGETHER):
            part = fresh[at : at + TOGETHER]
            self.words.update(zip(part, self.arrays.encode(part), strict=True))
        if not long:
            return [b"".join(map(self.words.__getitem__, x)) for x in stretches]
        return [b"".join([self._streamed(x) if x in long else self.words[x] for x in own]) for own in stretches]

    def _streamed(self, text: str) -> bytes:
        return b"".join([np.array(ids, "<i4").tobytes() for ids in self.stream(iter(text))])

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


class Table:
    """Numbers by key, neither below 0, in an open-addressed table that is read for many keys at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        at = self._slot(keys)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]
            own = self.keys[at] == keys  # of several for one slot the last has it
            self.values[at[own]] = values[own]
            keys, values, at = keys[~own], values[~own], (at[~own] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 for those that are not there."""
        at = self._slot(keys)
        met, out = self.keys[at], self.values[at]
        other = met != keys
        out[other] = -1
        live = np.flatnonzero(other & (met >= 0))  # another key stands there: on to the next slot
        at = at[live]
        while len(live):
            at = (at + 1) & self.mask
            met = self.keys[at]
            own = met == keys[live]
            out[live[own]] = self.values[at[own]]
            on = ~own & (met >= 0)
            live, at = live[on], at[on]
        return out


class Arrays:
    """The pieces as an automaton in arrays, and the window of many stretches side by side, for byte-pair models.

    Pieces are numbered in the order in which merging makes them: characters first. ``left`` and ``right`` are what a piece
    was merged from, itself for characters; pieces that merging never makes are left out.
    """

    def __init__(self, codec: Codec):
        chars = sorted(p for p in codec.ids if len(p) == 1)
        made = sorted((p for p in codec.ids if len(p) > 1), key=lambda p: -codec.scores[codec.ids[p]])
        halves = {p: h for p in made if (h := codec.halves(p))}
        order = chars + [p for p in made if p in halves]
        number = {p: k for k, p in enumerate(order)}
        self.size, self.longest = len(order) + 1, codec.longest
        self.ids = [(codec.ids[p],) for p in order]
        self.own = np.array([i for i, in self.ids], "<i4")
        self.unmatched = codec.unmatched
        #: when merging makes a piece: 0 for characters, then by falling score, alike for equal scores
        scores = sorted({codec.scores[codec.ids[p]] for p in halves}, reverse=True)
        turn = {x: k + 1 for k, x in enumerate(scores)}
        self.turn = np.array([turn[codec.scores[codec.ids[p]]] if p in halves else 0 for p in order])
        self.left = np.array([number[halves[p][0]] if p in halves else k for k, p in enumerate(order)])
        self.right = np.array([number[halves[p][1]] if p in halves else k for k, p in enumerate(order)])
        joins = sorted((number[p[:i]] * self.size + number[p[i:]], number[p]) for p in halves for i in range(1, len(p)) if p[:i] in number and p[i:] in number)
        self.join_keys, joined = np.array([k for k, _ in joins] + [1 << 62]), np.array([v for _, v in joins] + [0], np.int64)
        #: the turn of what two neighbours are merged to
        self.joins = Table(self.join_keys[:-1], self.turn[joined[:-1]])
        nodes: dict[tuple[int, int], int] = {}
        piece = [-1]
        for k, p in enumerate(order):
            at = 0
            for c in p:
                key = (at, ord(c))
                if key not in nodes:
                    nodes[key] = len(piece)
                    piece.append(-1)
                at = nodes[key]
            piece[at] = k
        self.edges = Table(np.array([a << 21 | c for a, c in nodes], np.int64), np.array(list(nodes.values()), np.int64))
        self.piece = np.array(piece)

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether neighbours stay apart: undoing the later merge of the two sides step by step, none of the pairs that met
        at their border would have been merged before the step that was just undone."""
        out, limit = np.ones(len(a), bool), np.full(len(a), self.size + 1)
        live = np.arange(len(a))
        while len(live):
            turn = self.joins.find(a * self.size + b)
            joined = (turn >= 0) & (turn < limit)
            out[live[joined]] = False
            next_a, next_b = self.right[a], self.left[b]
            can_a, can_b = next_a != a, next_b != b
            go_a = can_a & ((self.turn[a] > self.turn[b]) | ~can_b)
            go_b = can_b & ~go_a
            limit = np.where(go_a, self.turn[a], self.turn[b] + 1)
            a, b = np.where(go_a, next_a, a), np.where(go_b, next_b, b)
            on = ~joined & (go_a | go_b)
            live, a, b, limit = live[on], a[on], b[on], limit[on]
        return out

    def encode(self, stretches: list[str]) -> list[bytes]:
        sizes = np.fromiter(map(len, stretches), np.int64, len(stretches))
        chars = np.frombuffer("".join(stretches).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        begin = np.cumsum(sizes) - sizes
        whose = np.repeat(np.arange(len(stretches)), sizes)
        place = np.arange(len(chars)) - begin[whose]
        room = sizes[whose] - place
        # every occurrence of a piece: first character, length, number
        first, length, number = [], [], []
        live, state = np.arange(len(chars)), np.zeros(len(chars), np.int64)
        for n in range(1, self.longest + 1):
            on = room[live] >= n
            live, state = live[on], state[on]
            target = self.edges.find(state << 21 | chars[live + (n - 1)])
            on = target >= 0
            if n == 1 and not on.all():  # a character without a piece stands alone
                lost = live[~on]
                first.append(lost)
                length.append(np.ones(len(lost), np.int64))
                number.append(np.full(len(lost), -1))
            live, state = live[on], target[on].astype(np.int64)
            if not len(live):
                break
            hit = (k := self.piece[state]) >= 0
            first.append(live[hit])
            length.append(np.full(int(hit.sum()), n))
            number.append(k[hit])
        first, length, number = (np.concatenate(x) for x in (first, length, number))
        by_end = np.argsort((place[first] + length).astype(np.int16), kind="stable")
        first, length, number = first[by_end], length[by_end], number[by_end]
        ends = place[first] + length
        # survivors at each boundary: number of the last piece (-1: none or a lone character) and its length (0: no path)
        source = first + whose[first]
        target = source + length
        last, back = np.full(len(chars) + len(stretches), -1), np.zeros(len(chars) + len(stretches), np.int64)
        back[begin + np.arange(len(stretches))] = 1
        bounds = np.searchsorted(ends, np.arange(1, int(sizes.max()) + 2))
        for a, b in zip(bounds, bounds[1:], strict=False):
            own = np.flatnonzero(back[source[a:b]] > 0) + a
            before, piece = last[source[own]], number[own]
            check = np.flatnonzero((before >= 0) & (piece >= 0))
            fits = np.ones(len(own), bool)
            fits[check] = self.apart(before[check], piece[check])
            own = own[fits]
            last[target[own]], back[target[own]] = number[own], length[own]
        # back from the ends, all stretches at once
        heads, at, live = begin + np.arange(len(stretches)), begin + np.arange(len(stretches)) + sizes, np.arange(len(stretches))
        found, owner = [], []
        while len(live):
            found.append(at[live])
            owner.append(live)
            at[live] -= back[at[live]]
            live = live[at[live] > heads[live]]
        found, owner = np.concatenate(found)[::-1], np.concatenate(owner)[::-1]
        order = np.argsort(owner, kind="stable")
        found, counts = found[order], np.bincount(owner, minlength=len(stretches))
        number = last[found]
        lone = np.flatnonzero(number < 0)
        ids, sizes = self.own[number], np.ones(len(number), np.int64)
        if len(lone):
            others = [self.unmatched(c) for c in map(chr, chars[found[lone] - owner[order[lone]] - 1].tolist())]
            sizes[lone] = [len(x) for x in others]
            ids = np.repeat(ids, sizes)
            ids[np.repeat(number < 0, sizes)] = list(chain.from_iterable(others))
        ends = np.append(0, np.cumsum(sizes))[np.cumsum(counts)] * 4
        flat, begin, out = ids.tobytes(), 0, []
        for end in ends.tolist():
            out.append(flat[begin:end])
            begin = end
        return out


def codec(path: str, kind: str) -> Codec:
    if (path, kind) not in _codecs:
        _codecs[path, kind] = Codec(path, kind)
    return _codecs[path, kind]


def _lists(ids: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4")))


def encode(docs: DataFrame, model: str, *, kind: str = "bpe", text_col: str = "text", ids_col: str = "piece_ids") -> DataFrame:
    """``docs`` with the ids of each text added."""
    common.session(docs)

    @F.arrow_udf("array<int>")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(model, kind)
        for t in texts:
            yield _lists(own.encode_bytes(t.to_pylist()))

    return docs.withColumn(ids_col, run(F.col(text_col)))


def decode(docs: DataFrame, model: str, *, kind: str = "bpe", ids_col: str = "piece_ids", text_col: str = "decoded") -> DataFrame:
    """``docs`` with the text of each list of ids added; a null list is the empty text."""
    common.session(docs)

    @F.arrow_udf("string")
    def run(lists: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(model, kind)
        for x in lists:
            yield pa.array([own.decode(ids or []) for ids in x.to_pylist()], pa.string())

    return docs.withColumn(text_col, run(F.col(ids_col)))


def encode_checked(docs: DataFrame, model: str, *, kind: str = "bpe", text_col: str = "text", to: str = "encoded") -> DataFrame:
    """``docs`` with a struct (ids, exact) of each text added: its ids, and whether decoding them gives the text back. One worker does both."""
    common.session(docs)
    row = pa.struct([("ids", pa.list_(pa.int32())), ("exact", pa.bool_())])

    @F.arrow_udf("struct<ids:array<int>,exact:boolean>")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(model, kind)
        for t in texts:
            plain = t.to_pylist()
            ids = own.encode_bytes(plain)
            exact = [own.decode(np.frombuffer(i, "<i4").tolist()) == (x or "") for x, i in zip(plain, ids, strict=True)]
            yield pa.StructArray.from_arrays([_lists(ids), pa.array(exact, pa.bool_())], fields=list(row))

    return docs.withColumn(to, run(F.col(text_col)))


def round_trip(docs: DataFrame, model: str, *, kind: str = "bpe", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_pieces, ids_sha256, decoded_sha256, n_chars, exact) of every row.

    ids_sha256 is over the ids as little-endian 32-bit numbers; ``exact`` tells whether decoding gives the text back.
    """
    common.session(docs)
    kept = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model, kind)
        for batch in batches:
            rows = []
            texts = batch.column("text").to_pylist()
            for text, ids in zip(texts, own.encode_bytes(texts), strict=True):
                back = own.decode(np.frombuffer(ids, "<i4").tolist())
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), len(back), back == (text or "")))
            yield pa.record_batch([batch.column("id"), *(pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_())))], ["id", "n_pieces", "ids_sha256", "decoded_sha256", "n_chars", "exact"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kept}, n_pieces long, ids_sha256 string, decoded_sha256 string, n_chars long, exact boolean").withColumnRenamed("id", id_col)
