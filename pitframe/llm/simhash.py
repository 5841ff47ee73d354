"""SimHash near duplicates by covering locality-sensitive hashing (operator 8).

Each bit position carries a nonzero vector of r+1 bits, and each of the 2^(r+1)-1 tables v keeps the positions whose
vector has an odd product with v. Up to r differing positions span at most r dimensions, so some v is orthogonal to all
of them: in that table the two fingerprints keep equal bits and collide. No pair within the radius is missed.

Equal fingerprints are one node. A bucket with more members than ``BUCKET`` is covered again on the bits that its table
left out, which again loses no pair and ends, as each level fixes about half of the remaining bits.

Defined cases: null and empty texts have fingerprint zero and link like any other; texts of fewer words than a shingle
use their whole word sequence; repeated rows and ties fall together; an empty table gives an empty result; columns
other than id and text are not carried. Ids are whole numbers. Rows with a null id take the component of their fingerprint, or null if only
such rows have it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

BITS = 64
#: Members of one bucket that a task compares with each other; larger buckets are covered again.
BUCKET = 2048
SEED = 42


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """SimHash of lower-cased word shingles, unsigned."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        starts = [0, *(e + 1 for e in ends[:-shingle])]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :], strict=True)]
    bits = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[i : i + (1 << 16)], np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the fingerprint as a signed long."""
    common.session(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in batch.column("text")], np.uint64).view(np.int64)
            yield pa.record_batch([batch.column("id"), pa.array(fp)], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, fp long")


def covering(positions: list[int], radius: int) -> list[int]:
    """Masks over these bit positions such that any ``radius`` of them are all outside some mask."""
    full = (1 << (radius + 1)) - 1
    vectors = {p: 1 + k % full for k, p in enumerate(positions)}
    return [sum(1 << p for p, m in vectors.items() if (m & v).bit_count() & 1) for v in range(1, full + 1)]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def _in_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links that connect the members of each bucket as the radius does: from a group's least node to each other one."""
    for batch in batches:
        a, b = [], []
        for nodes, fps, radius in zip(*(batch.column(k).to_pylist() for k in ("nodes", "fps", "radius")), strict=True):
            order = np.argsort(np.array(nodes), kind="stable")
            node, fp = np.array(nodes)[order], np.array(fps, np.int64).view(np.uint64)[order]
            near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= radius
            label = np.arange(len(node))
            while True:
                low = np.where(near, label[None, :], len(node)).min(axis=1)
                low = low[low]
                if (low == label).all():
                    break
                label = low
            far = label != np.arange(len(node))
            a += node[label[far]].tolist()
            b += node[far].tolist()
        yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def links(nodes: DataFrame, radius: int = 3, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) that connect (node, fp) rows, distinct in fp, whenever a chain of pairs within the radius does."""
    spark = common.session(nodes)
    bucket = max(bucket, 1 << radius)
    masks = [(t, _signed(m)) for t, m in enumerate(covering(list(range(BITS)), radius))]
    fixed = dict(enumerate(covering(list(range(BITS)), radius)))
    members = nodes.select("node", "fp", F.explode(F.array(*(F.struct(F.lit(t).cast("long").alias("t"), F.lit(m).cast("long").alias("mask")) for t, m in masks))).alias("x"))
    members = members.select("node", "fp", F.col("x.t").alias("t"), F.col("fp").bitwiseAND(F.col("x.mask")).alias("key"))
    found = []
    while True:
        sizes = members.groupBy("t", "key").agg(F.count("*").alias("n"), F.min(F.struct("node", "fp")).alias("lo"), F.max(F.struct("node", "fp")).alias("hi")).filter("n > 1")
        sizes = common.cut(sizes)
        found.append(sizes.filter((F.col("n") == 2) & (F.bit_count(F.col("lo.fp").bitwiseXOR(F.col("hi.fp"))) <= radius)).select(F.col("lo.node").alias("a"), F.col("hi.node").alias("b")))
        some = members.join(sizes.filter((F.col("n") > 2) & (F.col("n") <= bucket)).select("t", "key"), ["t", "key"])
        packed = some.groupBy("t", "key").agg(F.collect_list("node").alias("nodes"), F.collect_list("fp").alias("fps")).select("nodes", "fps", F.lit(radius).alias("radius"))
        found.append(packed.mapInArrow(_in_bucket, "a long, b long"))
        large = sizes.filter(F.col("n") > bucket).select("t", "key")
        hot = [r.t for r in large.select("t").distinct().collect()]  # at most one row for each mask
        if not hot:
            break
        deeper, rows = {}, []
        for t in hot:
            # more members than 2^radius differ in more than radius of the bits left
            for m in covering([p for p in range(BITS) if not fixed[t] >> p & 1], radius):
                rows.append((t, len(deeper), _signed(fixed[t] | m)))
                deeper[len(deeper)] = fixed[t] | m
        again = spark.createDataFrame(rows, "t long, t2 long, mask long")
        members = members.join(large, ["t", "key"]).join(F.broadcast(again), "t").select("node", "fp", F.col("t2").alias("t"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
        members, fixed = common.cut(members), deeper
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out.distinct()


def near_duplicates(docs: DataFrame, *, radius: int = 3, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component): component is the least id reachable over pairs within ``radius`` differing bits."""
    prints = common.cut(fingerprints(docs, shingle, id_col, text_col))
    nodes = common.cut(prints.groupBy("fp").agg(F.min("id").alias("node"), F.count("*").alias("rows")))
    parts = components(links(nodes.filter("node is not null"), radius))
    classes = nodes.join(parts, "node", "left").select("fp", F.coalesce("component", "node").alias("component"))
    return common.join_unique(prints, classes, "fp", common.frequent(nodes, "fp", "rows")).select(F.col("id").alias(id_col), "fp", "component")
