"""Conversation prefix trie by splitter paths.

Conversations become paths of fixed-width turn keys and are range-partitioned by path. In a sorted
shard the members of a trie node lie side by side, so one pass with a stack finishes every node
that lies in a single shard. Nodes in several shards are prefixes of the paths at which shards
part: that skeleton is broadcast, and only for its nodes do shards hand in partial aggregates.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions.ranking import sort_into_slices
from termloom.storage import materialize

DIGEST_BYTES = 16
LENGTH_BYTES = 4
KEY_BYTES = DIGEST_BYTES + LENGTH_BYTES


def turn_keys(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, key): 128 bits of SHA-256 over role and text, then the text's code points, in hex."""
    known = turns.where(F.col("conv_id").isNotNull())
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * DIGEST_BYTES)
    points = F.lpad(F.lower(F.hex(F.length(text))), 2 * LENGTH_BYTES, "0")
    return known.select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", F.concat(digest, points).alias("key"))


def rebuilt_paths(turns: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """(conv_id, path binary): the keys of every rebuilt conversation, one after the other.

    The first turns of a conversation are those of the first one of its block of ``every`` ids, as many
    as the crc32 of its id modulo ``most`` says. Turns are ordered by (turn, null first; key).
    """
    # A null turn comes before all others, also before the smallest number.
    placed = turn_keys(turns).select(
        "conv_id", F.struct(F.col("turn").isNotNull().alias("known"), "turn").alias("at"), "key"
    )
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("at", "key"))), lambda t: t["key"])
    own = materialize(placed.groupBy("conv_id").agg(in_order.alias("keys")), "conversations")
    heads = own.select(
        F.col("conv_id").alias("base"), F.slice("keys", 1, most - 1).alias("head")
    ).where(F.col("base") % every == 0)
    taken = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    block = own.withColumns({"base": F.col("conv_id") - F.col("conv_id") % every, "h": taken})
    joined = block.join(heads, "base", "left")
    head = F.slice(F.coalesce("head", F.array().cast("array<string>")), F.lit(1), F.col("h"))
    rest = F.slice("keys", F.col("h") + 1, F.size("keys"))
    path = F.unhex(F.concat(F.array_join(head, ""), F.array_join(rest, "")))
    return joined.select("conv_id", path.alias("path"))


def _common_turns(a: bytes, b: bytes) -> int:
    """Leading turns that two paths share."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // KEY_BYTES
    differ = np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)
    return int(differ.argmax()) // KEY_BYTES


@dataclass
class Skeleton:
    """Trie of the prefixes that neighbouring shards share; node 0 is the root."""

    children: dict[tuple[int, bytes], int] = field(default_factory=dict)
    parent: list[int] = field(default_factory=lambda: [-1])
    depth: list[int] = field(default_factory=lambda: [0])
    points: list[int] = field(default_factory=lambda: [0])

    def add(self, path: bytes) -> None:
        node = 0
        for at in range(0, len(path), KEY_BYTES):
            key = path[at : at + KEY_BYTES]
            child = self.children.get((node, key))
            if child is None:
                child = self.children[node, key] = len(self.parent)
                self.parent.append(node)
                self.depth.append(self.depth[node] + 1)
                self.points.append(int.from_bytes(key[DIGEST_BYTES:], "big"))
            node = child


def splitter_skeleton(sliced: DataFrame) -> Skeleton:
    """The trie of what the last path of a shard shares with the first path of the next.

    A node lies in two shards only if it lies in two neighbouring ones, as shards are sorted. There are
    at most as many such paths as shards; equal ones, of a hot conversation, are read once.
    """

    @F.arrow_udf("binary")
    def shared(first: pa.Array, last: pa.Array) -> pa.Array:
        pairs = zip(first.to_pylist(), last.to_pylist())
        return pa.array([a[: _common_turns(a, b) * KEY_BYTES] for a, b in pairs], pa.binary())

    ends = sliced.groupBy("_slice").agg(F.min("path").alias("first"), F.max("path").alias("last"))
    before = F.lag("last").over(Window.partitionBy(F.lit(0)).orderBy("_slice"))  # a row per shard
    borders = ends.withColumn("before", before).where("before is not null")
    skeleton = Skeleton()
    for row in borders.select(shared("first", "before").alias("path")).distinct().orderBy("path").toLocalIterator():
        skeleton.add(bytes(row.path))
    return skeleton


ROWS = (
    "kind string, node int, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, "
    "n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
)
_ARROW = pa.schema(
    [("kind", pa.string()), ("node", pa.int32())]
    + [(n, pa.int64()) for n in "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens".split()]
    + [("ends_sha256", pa.string())]
)


class _Open:
    """A node on the stack: what is known of it while its members pass by."""

    __slots__ = ("skeleton", "points", "least", "convs", "children", "leaves", "saved", "ends", "waiting")

    def __init__(self, skeleton: int, points: int):
        self.skeleton, self.points = skeleton, points
        self.least = None
        self.convs = self.children = self.leaves = self.saved = 0
        self.ends = None
        self.waiting: list[tuple] = []


def shard_nodes(skeleton: Skeleton, sorted_rows: Iterator[tuple[int, int, bytes]]) -> Iterator[tuple]:
    """Rows of ``ROWS`` for (slice, conv_id, path) sorted by slice, path and conv_id.

    ``node``: a finished node (``node`` is -1, or its parent in the skeleton where that id is not known
    yet); ``part``: what a shard holds of a skeleton node; ``end``: a conversation that ends at one.
    The stack is as deep as a path. A finished node waits for its parent's smallest member.
    """
    stack: list[_Open] = []
    empty = hashlib.sha256(b"").hexdigest()

    def close() -> Iterator[tuple]:
        node = stack.pop()
        depth, above = len(stack), stack[-1] if stack else None
        if above is not None:
            above.convs += node.convs
            above.least = node.least if above.least is None else min(above.least, node.least)
        if node.skeleton >= 0:
            yield ("part", node.skeleton, node.least, depth, None, node.convs, node.children, node.leaves, node.saved, None)
            return
        saved = node.saved + (node.convs - 1) * node.points
        leaves = node.leaves if node.children else 1
        digest = node.ends.hexdigest() if node.ends else empty
        row = (node.least, depth, node.convs, node.children, leaves, saved, digest)
        above.children += 1
        above.leaves += leaves
        above.saved += saved
        for kid in node.waiting:
            yield ("node", -1, kid[0], kid[1], node.least, *kid[2:])
        if above.skeleton >= 0:
            yield ("node", above.skeleton, *row[:2], None, *row[2:])
        else:
            above.waiting.append(row)

    current, before = None, b""
    for shard, conv_id, path in sorted_rows:
        if shard != current:
            while stack:
                yield from close()
            current, before = shard, b""
            stack.append(_Open(0, 0))
        common = _common_turns(before, path)
        while len(stack) > common + 1:
            yield from close()
        for at in range(common * KEY_BYTES, len(path), KEY_BYTES):
            key = path[at : at + KEY_BYTES]
            above = stack[-1].skeleton
            own = skeleton.children.get((above, key), -1) if above >= 0 else -1
            stack.append(_Open(own, int.from_bytes(key[DIGEST_BYTES:], "big")))
        top = stack[-1]
        top.convs += 1
        top.least = conv_id if top.least is None else min(top.least, conv_id)
        if top.skeleton >= 0:
            yield ("end", top.skeleton, conv_id, None, None, None, None, None, None, None)
        elif top.ends is None:
            top.ends = hashlib.sha256(b"%d" % conv_id)
        else:
            top.ends.update(b",%d" % conv_id)
        before = path
    while stack:
        yield from close()


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 5000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def ends_digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of rows (node, conv_id), hashed as a stream in the order of the ids.

    SHA-256 takes its input in sequence, so the ids of a node pass through one task; it holds a batch.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            node, state = None, None
            for batch in batches:
                for own, conv_id in zip(batch["node"].to_pylist(), batch["conv_id"].to_pylist()):
                    if own == node:
                        state.update(b",%d" % conv_id)
                        continue
                    if state is not None:
                        yield node, state.hexdigest()
                    node, state = own, hashlib.sha256(b"%d" % conv_id)
            if state is not None:
                yield node, state.hexdigest()

        yield from _batches(rows(), pa.schema([("node", pa.int32()), ("ends_sha256", pa.string())]))

    dealt = ends.repartition("node").sortWithinPartitions("node", "conv_id")
    return dealt.mapInArrow(digest, "node int, ends_sha256 string")


def _finish_skeleton(skeleton: Skeleton, parts: DataFrame) -> list[tuple]:
    """(node, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens) of its nodes.

    The shards' parts are reduced by Spark to a row per node; from there children, which have larger
    numbers than their parents, are added to their parents. No more rows than the skeleton has.
    """
    reduced = parts.groupBy("node").agg(
        F.min("conv_id").alias("least"),
        *[F.sum(name).alias(name) for name in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
    )
    found = {r.node: r for r in reduced.toLocalIterator()}
    if not found:
        return []
    size = len(skeleton.parent)
    children = [found[k].n_children for k in range(size)]
    for k in range(1, size):
        children[skeleton.parent[k]] += 1
    leaves = [found[k].n_leaves + (children[k] == 0) for k in range(size)]
    saved = [found[k].saved_tokens + (found[k].n_convs - 1) * skeleton.points[k] for k in range(size)]
    for k in range(size - 1, 0, -1):
        leaves[skeleton.parent[k]] += leaves[k]
        saved[skeleton.parent[k]] += saved[k]
    return [
        (k, found[k].least, skeleton.depth[k], found[skeleton.parent[k]].least if k else None,
         found[k].n_convs, children[k], leaves[k], saved[k])
        for k in range(size)
    ]


def prefix_trie(turns: DataFrame) -> DataFrame:
    """One row per distinct sequence of leading turns of the rebuilt conversations (``rebuilt_paths``).

    ``turns`` has conv_id, turn, role, text; other columns are not read. Columns: conv_id (smallest
    member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256. Rows without a conv_id belong to no conversation and are left out; null role or text
    count as empty. Rows of equal turn, and rows with none, which come first, are ordered by their key
    (role and text hashed); repeated rows are repeated turns. No conversations give no rows. A node's
    text is told apart by 128 bits of a hash. A conversation's path, 20 bytes a turn, is one value.
    """
    spark = turns.sparkSession
    sliced = sort_into_slices(rebuilt_paths(turns), [], [F.asc("path"), F.asc("conv_id")])
    skeleton = splitter_skeleton(sliced)
    shared = spark.sparkContext.broadcast(skeleton)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*[batch[name].to_pylist() for name in ("_slice", "conv_id", "path")])

        yield from _batches(shard_nodes(shared.value, rows()), _ARROW)

    shards = sliced.repartition("_slice").sortWithinPartitions("_slice", "path", "conv_id")
    nodes = materialize(shards.mapInArrow(work, ROWS), "trie")
    measures = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
    columns = ["conv_id", "depth", "parent_conv_id", *measures, "ends_sha256"]
    top = spark.createDataFrame(
        _finish_skeleton(skeleton, nodes.where("kind = 'part'")),
        "node int, conv_id bigint, depth bigint, parent_conv_id bigint, " + ", ".join(f"{m} bigint" for m in measures),
    )
    ends = ends_digests(nodes.where("kind = 'end'").select("node", "conv_id"))
    none = F.sha2(F.lit(""), 256)
    skeletal = top.join(ends, "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", none))
    finished = nodes.where("kind = 'node' and node < 0")
    above = F.broadcast(top.select("node", F.col("conv_id").alias("_above")))
    hanging = nodes.where("kind = 'node' and node >= 0").join(above, "node").withColumn("parent_conv_id", F.col("_above"))
    return finished.select(*columns).unionByName(hanging.select(*columns)).unionByName(skeletal.select(*columns))
