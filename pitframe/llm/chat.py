"""Chat formatting over a prefix tree of conversations (operator 4).

Conversations that begin with the same turns share those nodes of a tree; a node's key is a digest of its parent's key, role
and text. Depth-first order is the order of the sorted root-to-leaf paths, in which each path adds only the nodes that
the path before it did not have. Every node is emitted once, as a segment of one long token stream (a token is a code
point of the formatted turn), with the position of its first token along its own conversation and the intervals of the
stream that its tokens attend to besides the earlier tokens of the segment itself: those of its ancestors.

Template: ``### role: text</turn>`` and a line end. Inside, a backslash goes before each backslash, ``###`` and
``</turn>``, and in roles before each colon; taking it away gives the original back. Loss is on assistants' texts.

Paths are range-partitioned and each partition is walked as a stream; what crosses a border is the last path before it,
one a partition.

Defined cases: null texts and roles are empty; a null conversation id is one conversation; rows with the same turn go by role
and text; repeated rows are turns of their own; an empty table gives an empty result; other columns are not carried.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

END = "</turn>\n"
_controls = re.compile(r"\\|###|</turn>")
_role_controls = re.compile(r"\\|###|</turn>|:")
_escaped = re.compile(r"\\(.)", re.S)
_turn = re.compile(r"### ((?:[^\\:]++|\\.)*+): ((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.S)
SEGMENT = "node binary, parent binary, depth int, seq_start long, seq_end long, position_start long, attends array<struct<start:long,end:long>>, tokens string, loss_start int, loss_end int"


def escape(text: str, controls: re.Pattern = _controls) -> str:
    return controls.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _escaped.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and where its text begins and ends in it."""
    head, body = f"### {escape(role, _role_controls)}: ", escape(text)
    return head + body + END, len(head), len(head) + len(body)


def parse_turn(tokens: str) -> tuple[str, str]:
    m = _turn.fullmatch(tokens)
    if m is None:
        raise ValueError("not a formatted turn")
    return unescape(m[1]), unescape(m[2])


def _turns(chats: DataFrame) -> DataFrame:
    """Rows by conversation and turn, each conversation within one partition."""
    rows = chats.select("conv", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartition(common.partitions(chats.sparkSession), "conv").sortWithinPartitions("conv", "turn", "role", "text")


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a turn: its node, its parent, and its formatted text."""
    names = ["conv", "depth", "node", "parent", "position", "tokens", "loss_start", "loss_end"]
    types = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.string(), pa.int32(), pa.int32()]
    now, depth, node, position = ("none",), 0, b"", 0
    for batch in batches:
        out = []
        for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "role", "text")), strict=True):
            if (conv,) != now:
                now, depth, node, position = (conv,), 0, b"", 0
            tokens, a, b = format_turn(role, text)
            key = hashlib.blake2b(node + len(role).to_bytes(8, "big") + role.encode() + text.encode(), digest_size=16).digest()
            out.append((conv, depth, key, node, position, tokens, *((a, b) if role == "assistant" else (0, 0))))
            depth, node, position = depth + 1, key, position + len(tokens)
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * len(types), types, strict=True)], names)


_PATH = "leaf binary, path array<struct<node:binary,n:int>>"
_path_type = pa.list_(pa.struct([("node", pa.binary()), ("n", pa.int32())]))


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a conversation: its path from the first turn on."""
    now, path = ("none",), []
    for batch in batches:
        out = []
        for conv, node, tokens in zip(*(batch.column(c).to_pylist() for c in ("conv", "node", "tokens")), strict=True):
            if (conv,) != now:
                if path:
                    out.append(path)
                now, path = (conv,), []
            path.append({"node": node, "n": len(tokens)})
        yield pa.record_batch([pa.array([p[-1]["node"] for p in out], pa.binary()), pa.array(out, _path_type)], ["leaf", "path"])
    if path:
        yield pa.record_batch([pa.array([path[-1]["node"]], pa.binary()), pa.array([path], _path_type)], ["leaf", "path"])


def _joined(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in intervals:
        if out and out[-1][1] == a:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def _walk(last: dict[int, list[tuple[bytes, int]]], starts: dict[bytes, int], bases: dict[int, int]):
    """Walks the sorted paths of a partition depth-first and gives each new node its place in the stream.

    ``last``: the path before each partition; ``starts``: the places of those paths' nodes; ``bases``: where each
    partition's tokens begin. With the latter two empty, places count from the partition's own beginning.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[tuple[bytes, int, int]] | None = None  # node, start, end
        at = 0
        for batch in batches:
            out = []
            for part, path in zip(batch.column("part").to_pylist(), batch.column("path").to_pylist(), strict=True):
                if stack is None:
                    stack = [(node, starts.get(node, 0), starts.get(node, 0) + n) for node, n in last.get(part, [])]
                    at = bases.get(part, 0)
                same = 0
                while same < len(stack) and same < len(path) and stack[same][0] == path[same]["node"]:
                    same += 1
                del stack[same:]
                for x in path[same:]:
                    attends = _joined([(a, b) for _, a, b in stack])
                    out.append((part, x["node"], at, at + x["n"], [{"start": a, "end": b} for a, b in attends]))
                    stack.append((x["node"], at, at + x["n"]))
                    at += x["n"]
            yield pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))))], ["part", "node", "seq_start", "seq_end", "attends"])

    return run


_PLACE = "part int, node binary, seq_start long, seq_end long, attends array<struct<start:long,end:long>>"


def prefix_tree(chats: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(segments, members): every node once with its place, position and attention, and the nodes of each conversation."""
    spark = common.session(chats)
    named = chats.select(F.col(id_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    turns = common.cut(_turns(named).mapInArrow(_nodes, "conv long, depth int, node binary, parent binary, position long, tokens string, loss_start int, loss_end int"))
    nodes = turns.groupBy("node").agg(*(F.first(c).alias(c) for c in ("parent", "depth", "position", "tokens", "loss_start", "loss_end")))
    leaves = turns.mapInArrow(_paths, _PATH).groupBy("leaf").agg(F.first("path").alias("path"))
    ordered = leaves.select("path").repartitionByRange(common.partitions(spark), "path").sortWithinPartitions("path")
    ordered = common.cut(ordered.select(F.spark_partition_id().alias("part"), "path"))
    # one path a partition comes to the driver, and the places of its nodes
    ends = {r.part: [(bytes(x.node), x.n) for x in r.path] for r in ordered.groupBy("part").agg(F.max("path").alias("path")).collect()}
    parts = sorted(ends)
    last = {b: ends[a] for a, b in zip(parts, parts[1:], strict=False)}
    rough = common.cut(ordered.mapInArrow(_walk(last, {}, {}), _PLACE).drop("attends"))
    sizes = {r.part: r.n for r in rough.groupBy("part").agg(F.sum(F.col("seq_end") - F.col("seq_start")).alias("n")).collect()}
    bases, total = {}, 0
    for p in parts:
        bases[p], total = total, total + (sizes.get(p) or 0)
    border = spark.createDataFrame([(bytearray(n),) for n in {n for path in last.values() for n, _ in path}], "node binary")
    starts = {bytes(r.node): r.seq_start + bases[r.part] for r in rough.join(F.broadcast(border), "node").collect()}
    places = ordered.mapInArrow(_walk(last, starts, bases), _PLACE)
    segments = places.join(nodes, "node").withColumnRenamed("position", "position_start").select(*(c.split()[0] for c in SEGMENT.replace("array<struct<start:long,end:long>>", "x").split(", ")))
    return segments, turns.select(F.col("conv").alias(id_col), "depth", "node")


def read_back(segments: DataFrame, members: DataFrame, *, id_col: str = "conv_id") -> DataFrame:
    """(id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of each conversation, parsed from the segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = ("none",), None

        def row() -> tuple:
            n, turns, chars, loss, formatted = state
            return now[0], n, turns.hexdigest(), chars, loss.hexdigest(), formatted

        def pack(out: list[tuple]) -> pa.RecordBatch:
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], ["id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            out = []
            for conv, tokens, a, b in zip(*(batch.column(c).to_pylist() for c in ("id", "tokens", "loss_start", "loss_end")), strict=True):
                if (conv,) != now:
                    if state:
                        out.append(row())
                    now, state = (conv,), (0, hashlib.sha256(), 0, hashlib.sha256(), 0)
                n, turns, chars, loss, formatted = state
                role, text = parse_turn(tokens)
                turns.update(f"{role}\n{text}\n".encode())
                masked = unescape(tokens[a:b])
                loss.update(masked.encode())
                state = (n + 1, turns, chars + len(masked), loss, formatted + len(tokens))
            yield pack(out)
        if state:
            yield pack([row()])

    spark = common.session(segments)
    shared = common.frequent(members.groupBy("node").agg(F.count("*").alias("n")), "node", "n")  # a first turn may be in most conversations
    rows = common.join_unique(members, segments.select("node", "tokens", "loss_start", "loss_end"), "node", shared).withColumnRenamed(id_col, "id")
    rows = rows.select("id", "depth", "tokens", "loss_start", "loss_end").repartition(common.partitions(spark), "id").sortWithinPartitions("id", "depth")
    return rows.mapInArrow(run, "id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").withColumnRenamed("id", id_col)
