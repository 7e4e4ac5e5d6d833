"""Near-duplicate embeddings: iterative quantisation, multi-index Hamming tables, exact reranking.

A rotation is learned that makes the signs of the rotated coordinates balanced, faithful bits. The
bits are cut into disjoint substrings, one table each; codes that agree in a whole substring meet
in a bucket, where the Hamming distance of the whole codes tells who may be near whom. Only what has such
a partner is joined with its original vector and compared by cosine. Links are counted inside the
buckets, each pair only in the first table in which it meets, so no pair leaves a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from math import acos, asin, ceil, log, log2, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm.components import connected_components
from termloom.llm.streams import complete_groups
from termloom.storage import materialize


@dataclass(frozen=True)
class Search:
    """``recall`` is what a pair of just the least cosine may expect; closer pairs find each other surer.

    The rotation is learned from the ``sample`` vectors with the smallest hashes; all vectors are
    indexed. Buckets above ``block`` vectors are compared block by block in several tasks. Substrings are at
    most so long that the mean bucket of the largest label holds ``bucket`` codes; ``row_cost`` is what a row of
    a table costs, in comparisons of codes. A pair of just the least cosine is within the Hamming radius
    unless its distance lies ``deviations`` above what is to expect; codes of ``code_bits`` bits at least tell
    such pairs from others.
    """

    least_cosine: float = 0.93
    recall: float = 0.995
    bucket: int = 12
    least_bits: int = 6
    sample: int = 8_192
    rounds: int = 30
    block: int = 1_024
    seed: int = 5
    near: float = 0.01
    row_cost: int = 200
    code_bits: int = 256
    deviations: float = 4.0


@dataclass(frozen=True)
class Layout:
    """``count`` substrings of ``bits`` bits, and the Hamming distance up to which codes are near.

    A code has ``length`` bits, of which the substrings are the first.
    """

    bits: int
    count: int
    radius: int
    length: int

    @property
    def words(self) -> int:
        """64-bit words of a packed code."""
        return -(-self.length // 64)

    def pack(self, signs: np.ndarray) -> np.ndarray:
        """rows x words, the bits of each code packed."""
        padded = np.zeros((len(signs), self.words * 64), dtype=bool)
        padded[:, : signs.shape[1]] = signs
        return np.packbits(padded, axis=1).view(np.uint64)

    def keys(self, codes: np.ndarray) -> np.ndarray:
        """rows x tables, the substring of each table as a number."""
        bits = np.unpackbits(codes.view(np.uint8), axis=1, count=self.bits * self.count)
        weights = 1 << np.arange(self.bits, dtype=np.int64)
        return bits.reshape(len(codes), self.count, self.bits) @ weights

    def unpack(self, column: pa.Array) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), self.words)


@dataclass(frozen=True)
class Tables:
    """The rotations, as many as the substrings need, and the layout of the codes they give."""

    layout: Layout
    mean: np.ndarray
    rotation: np.ndarray  # dimension x length

    @property
    def count(self) -> int:
        return self.layout.count

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        return self.layout.pack((vectors - self.mean) @ self.rotation >= 0)

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        return self.layout.keys(self.codes(vectors))


def learn_rotation(sample: np.ndarray, rounds: int, seed: int) -> np.ndarray:
    """Iterative quantisation of centred vectors: an orthogonal matrix whose signs fit them best."""
    values, axes = np.linalg.eigh(sample.T @ sample)
    turned = sample @ axes
    rotation = np.linalg.qr(np.random.default_rng(seed).normal(size=(axes.shape[1],) * 2))[0]
    for _ in range(rounds):
        signs = np.where(turned @ rotation >= 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(turned.T @ signs)
        rotation = left @ right
    return axes @ rotation


def equal_bit(sample: np.ndarray, search: Search) -> tuple[np.ndarray, float]:
    """(centre of the signs, chance that a pair of just the least cosine agrees in one of them).

    From the mean of unit vectors the pair is seen at a wider angle than from the origin: widest if
    both are near the mean, so the norm is the low quantile ``near`` of the sample. Where that
    angle is no longer acute, signs are taken about the origin.
    """
    mean = sample.mean(axis=0)
    apart = sqrt((1 - search.least_cosine) / 2)  # half the distance of the pair
    norm = float(np.quantile(np.linalg.norm(sample - mean, axis=1), search.near))
    if apart < norm * sqrt(0.5):
        return mean, 1 - 2 * asin(apart / norm) / pi
    return np.zeros_like(mean), 1 - acos(search.least_cosine) / pi


def learn_tables(sample: np.ndarray, largest: int, search: Search) -> Tables:
    """Tables for labels of at most ``largest`` vectors."""
    mean, same = equal_bit(sample, search)
    most = max(search.least_bits, min(40, ceil(log2(max(largest, 2) / search.bucket))))
    # Rare equal bits ask for many tables of long substrings; fewer, larger buckets may cost less.
    counts = {b: ceil(log(1 - search.recall) / log(1 - same**b)) for b in range(search.least_bits, most + 1)}
    bits = min(counts, key=lambda b: counts[b] * (search.row_cost + largest / 2**b))
    count = counts[bits]
    length = max(bits * count, search.code_bits)
    radius = ceil(length * (1 - same) + search.deviations * sqrt(length * same * (1 - same)))
    dimension = sample.shape[1]
    rotations = [
        learn_rotation(sample - mean, search.rounds, search.seed + k)
        for k in range(ceil(length / dimension))
    ]
    return Tables(Layout(bits, count, radius, length), mean, np.concatenate(rotations, axis=1)[:, :length])


def usable(embedding: Column) -> Column:
    """True for vectors without null or non-finite components that are not zero."""
    value = F.coalesce(embedding, F.array().cast("array<float>"))
    fine = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return fine & F.exists(value, lambda x: x != 0)


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # no square over- or underflows
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _vectors(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def bucket_links(
    vectors: np.ndarray, keys: np.ndarray, copies: np.ndarray, side: np.ndarray, table: int, least: float
) -> tuple[np.ndarray, np.ndarray]:
    """(links of each vector that this table counts, smallest place reachable by links in the bucket).

    ``side`` splits the rows of a large bucket: if both 0 and 1 occur, only pairs across are meant.
    """
    places = np.arange(len(vectors))
    near = vectors @ vectors.T >= least
    np.fill_diagonal(near, False)
    if side.any() and not side.all():
        near &= side[:, None] != side[None, :]
    reach = places
    a, b = np.nonzero(near)
    counts = np.zeros(len(vectors), dtype=np.int64)
    if not len(a):
        return counts, reach
    first = np.ones(len(a), dtype=bool)
    for earlier in range(table):
        first &= keys[a, earlier] != keys[b, earlier]
    np.add.at(counts, a[first], copies[b[first]])
    while True:
        least_near = reach.copy()
        np.minimum.at(least_near, a, reach[b])
        least_near = least_near[least_near]
        if (least_near == reach).all():
            return counts, reach
        reach = least_near


LINKS = "vec_id bigint, links bigint, linked_to bigint"
_GROUP = ["label", "dimension", "table", "key", "low", "high"]


def near_codes(codes: np.ndarray, keys: np.ndarray, side: np.ndarray, table: int, radius: int) -> np.ndarray:
    """Which codes of a bucket have a partner within the radius that they do not meet in an earlier table."""
    distance = np.zeros((len(codes), len(codes)), dtype=np.uint16)
    for word in codes.T:
        distance += np.bitwise_count(word[:, None] ^ word[None, :])
    near = np.triu(distance <= radius, 1)
    if side.any() and not side.all():
        near &= side[:, None] != side[None, :]
    a, b = np.nonzero(near)
    for earlier in range(table):
        new = keys[a, earlier] != keys[b, earlier]
        a, b = a[new], b[new]
        if not len(a):
            break
    found = np.zeros(len(codes), dtype=bool)
    found[a] = found[b] = True
    return found


def _buckets(rows: pa.Table, starts: np.ndarray, layouts: dict[int, Layout]):
    """(rows, layout, codes, side, table) of each group with two rows or more; ``side`` as in ``bucket_links``."""
    tables, low, block = (np.asarray(rows[c]) for c in ("table", "low", "block"))
    sizes = np.asarray(rows["dimension"])
    for start, end in zip(starts.tolist(), np.r_[starts[1:], len(rows)].tolist()):
        if end - start > 1:
            layout = layouts[int(sizes[start])]
            codes = layout.unpack(rows["code"].slice(start, end - start))
            side = (block[start:end] != low[start]).astype(np.int8)
            yield slice(start, end), layout, codes, side, int(tables[start])


def candidates(grouped: DataFrame, layouts: dict[int, Layout]) -> DataFrame:
    """The rows of sorted buckets, without their codes, that have a near code beside them."""

    def work(rows: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        kept = np.zeros(len(rows), dtype=bool)
        for own, layout, codes, side, table in _buckets(rows, starts, layouts):
            kept[own] = near_codes(codes, layout.keys(codes), side, table, layout.radius)
        yield from rows.drop_columns(["code"]).take(pa.array(np.flatnonzero(kept))).to_batches()

    schema = grouped.drop("code").schema
    return grouped.mapInArrow(complete_groups(_GROUP, work), schema)


def count_links(grouped: DataFrame, layouts: dict[int, Layout], least: float) -> DataFrame:
    """Partial link counts of sorted buckets of vectors, each compared as soon as it is complete."""

    def work(rows: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids, copies = np.asarray(rows["vec_id"]), np.asarray(rows["copies"])
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for own, layout, codes, side, table in _buckets(rows, starts, layouts):
            part = rows["embedding"].slice(own.start, own.stop - own.start).combine_chunks()
            counts, reach = bucket_links(_unit(_vectors(part)), layout.keys(codes), copies[own], side, table, least)
            linked = np.flatnonzero((reach != np.arange(len(reach))) | (counts > 0))
            if len(linked):
                found.append((ids[own][linked], counts[linked], ids[own][reach[linked]]))
        columns = [np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]) for k in range(3)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["vec_id", "links", "linked_to"])

    return grouped.mapInArrow(complete_groups(_GROUP, work), LINKS)


def vector_classes(embeddings: DataFrame) -> DataFrame:
    """One row per distinct usable vector of a label: vec_id (the smallest), copies, label, embedding."""
    fit = embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding")))
    return fit.groupBy("label", "embedding").agg(
        F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies")
    )


def _with_codes(classes: DataFrame, tables: dict[int, Tables]) -> DataFrame:
    """Add ``coded``: the packed code of each vector, and its keys."""
    kind = pa.struct([("code", pa.binary()), ("keys", pa.list_(pa.int64()))])

    @F.arrow_udf("code binary, keys array<bigint>")
    def encode(embeddings: pa.Array) -> pa.Array:
        sizes = np.asarray(embeddings.value_lengths())
        out: list = [None] * len(embeddings)
        for size in np.unique(sizes):
            rows, of = np.flatnonzero(sizes == size), tables[int(size)]
            codes = of.codes(_unit(_vectors(embeddings.take(pa.array(rows)))))
            for row, code, key in zip(rows.tolist(), codes, of.layout.keys(codes).tolist()):
                out[row] = {"code": code.tobytes(), "keys": key}
        return pa.array(out, kind)

    return classes.withColumn("coded", encode.asNondeterministic()(F.col("embedding")))


def _learn(classes: DataFrame, search: Search) -> dict[int, Tables]:
    """Tables for every dimension that occurs. A dimension that the sample lacks gets random rotations."""
    sizes = classes.groupBy("label", F.size("embedding").alias("dimension")).agg(F.count(F.lit(1)).alias("n"))
    largest = {r["dimension"]: r["n"] for r in sizes.groupBy("dimension").agg(F.max("n").alias("n")).collect()}
    sample = classes.orderBy(F.xxhash64(F.lit(search.seed), "vec_id"), "vec_id").limit(search.sample)
    by_size: dict[int, list] = {size: [] for size in largest}
    for row in sample.select("embedding").collect():
        by_size[len(row.embedding)].append(row.embedding)
    learned = {}
    for size, rows in by_size.items():
        vectors = _unit(np.array(rows)) if rows else np.zeros((1, size))
        rounds = search.rounds if len(rows) > size else 0
        learned[size] = learn_tables(vectors, largest[size], replace(search, rounds=rounds))
    return learned


def near_duplicates(embeddings: DataFrame, search: Search = Search()) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of ``embeddings`` (vec_id, embedding, label).

    Rows whose label or vec_id is null, and vectors that are null, empty, zero or hold a null or
    non-finite component, link with nothing, and so do vectors of different dimensions. Equal vectors
    of a label are searched once and count as links of each other. ``vec_id`` should be unique: rows that share one
    share their links. Other columns are dropped. An empty table gives an empty result.
    """
    rows = embeddings.select("vec_id", "embedding", "label")
    classes = materialize(vector_classes(rows), "vector-classes")
    tables = _learn(classes, search)
    layouts = {size: of.layout for size, of in tables.items()}
    narrow = ["label", F.size("embedding").alias("dimension"), "vec_id", "coded"]
    coded = materialize(_with_codes(classes, tables).select(*narrow), "vector-codes")
    spread = coded.select(
        "label", "dimension", "vec_id", F.col("coded.code").alias("code"), F.posexplode("coded.keys").alias("table", "key")
    )
    bucket = ["label", "dimension", "table", "key"]
    large = spread.groupBy(*bucket).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > search.block)
    blocks = large.withColumn("blocks", F.ceil(F.col("_n") / search.block).cast("int")).drop("_n")
    # A bucket of several blocks becomes a task for each pair of blocks.
    parted = spread.join(blocks, bucket, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    parted = parted.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    parted = parted.withColumn("_other", F.explode(F.expr("sequence(0, blocks - 1)")))
    paired = parted.select(
        *bucket, F.least("block", "_other").alias("low"), F.greatest("block", "_other").alias("high"),
        "block", "vec_id", "code",
    )
    met = candidates(paired.repartition(*_GROUP).sortWithinPartitions(*_GROUP), layouts)
    originals = classes.select("vec_id", "copies", "embedding").join(
        coded.select("vec_id", F.col("coded.code").alias("code")), "vec_id"
    )
    fetched = materialize(met, "vector-candidates").join(originals, "vec_id")
    grouped = fetched.repartition(*_GROUP).sortWithinPartitions(*_GROUP)
    links = materialize(count_links(grouped, layouts, search.least_cosine), "vector-links")
    counts = links.groupBy("vec_id").agg(F.sum("links").alias("links"))
    components = connected_components(links.select(F.col("vec_id").alias("a"), F.col("linked_to").alias("b")))
    # Equal vectors find their class by 128 bits of hashes, so that no vector moves for it.
    names = ["label", "_hash", "_other_hash"]
    hashes = {"_hash": F.xxhash64("embedding"), "_other_hash": F.xxhash64(F.lit(search.seed), "embedding")}
    found = (
        classes.withColumns(hashes).select("vec_id", "copies", *names).join(counts, "vec_id", "left")
        .join(components.withColumnRenamed("node", "vec_id"), "vec_id", "left")
        .select(
            *names,
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("_links"),
            F.coalesce("component", "vec_id").alias("_component"),
        )
    )
    searched = F.col("vec_id").isNotNull() & usable(F.col("embedding"))
    keyed = rows.select("vec_id", *[F.when(searched, c).alias(n) for n, c in {"label": F.col("label"), **hashes}.items()])
    return keyed.join(found, names, "left").select(
        "vec_id",
        F.coalesce("_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("_component", "vec_id").alias("component_id"),
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
