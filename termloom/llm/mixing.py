"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

The documents of a source, shuffled by a hash, form one stream of words that is cut into blocks of
equal size. The schedule has as many slots as blocks are wanted. Slot k has the golden-ratio point
frac(k g / K), where K is the number of slots and g the number next to K / golden ratio that shares
no factor with K. Mapped through the cumulative weights of the sources, the point names the slot's
source. Since g and K share no factor, the points hit every multiple of 1 / K once, so each source
gets exactly its number of slots, evenly spread at every scale. The n-th slot of a source takes the
n-th block of its stream, which starts again when it ends.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.functions.ranking import with_rank
from termloom.llm.running import with_running_sums
from termloom.llm.words import WORD
from termloom.storage import materialize


@dataclass(frozen=True)
class Mix:
    """Weights are given to the sources in code point order, null last, and repeat.

    ``share`` times all words are taken; no source is taken more than ``most`` times over.
    """

    weights: tuple[int, ...] = (5, 2, 1)
    share: float = 1.5
    most: float = 2.0
    block_words: int = 1024
    seed: int = 11


# Slots made by one task from one row of the sources.
CHUNK_SLOTS = 65_536


def word_count(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """One row per source: source, place (1, 2, … in code point order), weight, source_size, target.

    Targets are proportional to the weights, but stop at ``most`` times the source's size; what is
    over goes to the others by weight. So target = min(limit, level x weight) with one level for
    all, and sources reach their limit in the order of limit / weight.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = with_rank(sources, [], [F.col("source").asc_nulls_last()], "place", "bigint")
    weights = F.array(*[F.lit(float(w)) for w in mix.weights])
    placed = placed.withColumn("weight", F.get(weights, (F.col("place") - 1) % len(mix.weights)))
    placed = placed.withColumn("limit", F.col("source_size") * F.lit(float(mix.most)))
    placed = materialize(placed.withColumn("full_at", F.col("limit") / F.col("weight")), "mix-sources")
    before = with_running_sums(
        placed, [], [F.col("full_at"), F.col("place")], {"limits": "limit", "weights": "weight"}
    )
    totals = placed.agg(
        (F.sum("source_size") * F.lit(float(mix.share))).alias("wanted"), F.sum("weight").alias("all_weights")
    )
    # The level if just the sources before this one are full; right if this one is not full then.
    level = (F.col("wanted") - F.col("limits")) / (F.col("all_weights") - F.col("weights"))
    levels = before.crossJoin(F.broadcast(totals)).select(
        F.max(F.when(level <= F.col("full_at"), level)).alias("level")
    )
    level = F.coalesce("level", F.lit(float("inf")))
    return placed.crossJoin(F.broadcast(levels)).select(
        "source", "place", "weight", "source_size",
        F.least(F.col("limit"), level * F.col("weight")).alias("target"),
    )


def _blocks(sources: DataFrame, mix: Mix) -> DataFrame:
    """How many slots each source needs: whole passes over its blocks, then the blocks of a part."""
    size, words = F.col("source_size"), F.floor(F.col("target") + 0.5).cast("bigint")
    per_pass = F.ceil(size / mix.block_words).cast("bigint")
    passes = F.when(size > 0, F.expr("words div source_size")).otherwise(0).cast("bigint")
    counted = sources.withColumn("words", words).withColumn("passes", passes)
    counted = counted.withColumn("per_pass", per_pass)
    counted = counted.withColumn("rest", F.col("words") - F.col("passes") * size)
    last = F.ceil(F.col("rest") / mix.block_words).cast("bigint")
    return counted.withColumn("slots", F.col("passes") * F.col("per_pass") + last)


def golden_step(slots: int) -> int:
    """The number next to slots / golden ratio without a factor in common with ``slots``."""
    near = max(1, round(slots * 0.6180339887498949))
    return next(g for d in range(slots + 1) for g in (near + d, near - d) if g > 0 and gcd(g, slots) == 1)


def schedule(sources: DataFrame, mix: Mix) -> DataFrame:
    """One row per slot: slot (its place in the mix), place (source), pass, block, block_taken.

    ``block_taken`` is the number of words taken from the block: all, but for the last slot of a
    source, which takes what its target still lacks.
    """
    needed = with_running_sums(_blocks(sources, mix), [], [F.col("place")], {"first_slot": "slots"})
    needed = materialize(needed, "mix-slots")
    total = needed.agg(F.sum("slots")).first()[0] or 0
    step = golden_step(total) if total else 1
    back = pow(step, -1, total) if total > 1 else 0
    chunks = needed.where("slots > 0").withColumn(
        "chunk", F.explode(F.expr(f"sequence(0L, (slots - 1) div {CHUNK_SLOTS})"))
    )
    own = F.expr(
        f"sequence(chunk * {CHUNK_SLOTS}, least(slots, (chunk + 1) * {CHUNK_SLOTS}) - 1)"
    )
    # Which k has the point (first_slot + own) / K? The factors may exceed 64 bits.
    slot = F.expr(
        f"cast(cast(first_slot + own as decimal(19,0)) * cast({back} as decimal(18,0)) % {max(total, 1)} as bigint)"
    )
    slots = chunks.repartition("place", "chunk").withColumn("own", F.explode(own)).withColumn("slot", slot)
    ranked = with_rank(
        slots.select("place", "slot", "per_pass", "passes", "rest", "source_size"),
        ["place"], [F.col("slot")], "nth", "bigint",
    )
    nth = F.col("nth") - 1
    placed = ranked.withColumn("pass", F.floor(nth / F.col("per_pass")).cast("bigint"))
    placed = placed.withColumn("block", nth - F.col("pass") * F.col("per_pass"))
    end = F.when(F.col("pass") < F.col("passes"), F.col("source_size")).otherwise(F.col("rest"))
    taken = F.least(F.lit(mix.block_words), end - F.col("block") * mix.block_words)
    return placed.select("slot", "place", "pass", "block", taken.cast("bigint").alias("block_taken"))


def stream_documents(sizes: DataFrame, sources: DataFrame, mix: Mix) -> DataFrame:
    """Add ``place``, ``source_size``, ``target`` and ``start``, the document's place in its stream."""
    # Sources are few rows beside the documents; adaptive execution broadcasts them if they are small.
    known = sources.select(F.col("source").alias("_source"), "place", "source_size", "target")
    joined = sizes.join(known, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    shuffled = joined.withColumn("_shuffle", F.xxhash64(F.lit(mix.seed), "doc_id"))
    order = [F.col("_shuffle"), F.col("doc_id"), F.col("size")]
    return with_running_sums(shuffled, ["place"], order, {"start": "size"}).drop("_shuffle")


def mix_documents(
    docs: DataFrame, mix: Mix = Mix(), text: str = "text", size: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(documents with size, source_size, target and taken; schedule of the mix).

    ``docs`` needs doc_id, source and the text column, or instead of it a column ``size`` of sizes counted
    already; other columns are dropped. Every row is in the result. A null or empty text has size 0 and nothing is taken of it; a
    null source is a source; repeated rows are documents of their own. ``taken`` counts the words
    that the mix takes, a word taken twice twice. An empty table gives empty tables.
    """
    words = F.col(size) if size else word_count(F.col(text))
    sizes = materialize(docs.select("doc_id", "source", words.alias("size")), "mix-sizes")
    sources = materialize(source_targets(sizes, mix), "mix-targets")
    slots = materialize(schedule(sources, mix), "mix-schedule")
    stream = materialize(stream_documents(sizes, sources, mix), "mix-stream")
    block = mix.block_words
    pieces = stream.where("size > 0").select(
        "place",
        "start",
        "size",
        F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")).alias("block"),
    )
    first = F.greatest(F.lit(0), F.col("start") - F.col("block") * block)
    end = F.least(F.lit(block), F.col("start") + F.col("size") - F.col("block") * block)
    overlap = F.greatest(F.lit(0), F.least(end, F.col("block_taken")) - first)
    taken = (
        pieces.join(slots.select("place", "block", "block_taken"), ["place", "block"])
        .groupBy("place", "start")
        .agg(F.sum(overlap).cast("bigint").alias("taken"))
    )
    # Documents without words share their start with others; nothing is taken of them.
    keyed = stream.withColumn("_start", F.when(F.col("size") > 0, F.col("start")))
    taken = taken.withColumnsRenamed({"place": "_place", "start": "_at"})
    match = (F.col("place") == F.col("_place")) & (F.col("_start") == F.col("_at"))
    mixed = keyed.join(taken, match, "left").select(
        "doc_id", "source", "size", "source_size", "target",
        F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"),
    )
    return mixed, slots
