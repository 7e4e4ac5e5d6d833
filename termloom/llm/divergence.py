"""Source divergence audit: how far the vocabulary of each source stands from the rest of its language.

Shares and divergences are whole numbers, so every sum is exact. The many terms that share a pair of
counts share a divergence too: it is evaluated once for each cell (count in the group, count in the
language), cells are ranked by how many terms they hold, and only the cells that reach into the report
are expanded to terms.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.llm.ragged import ranges
from termloom.storage import materialize

SCALE = 1_000_000_000

# Bytes of a term stay (A-Z in lower case, a-z and all of a character beyond ASCII), others part terms.
_TERM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_PIECE = 1 << 20  # bytes of a text that are split at a time
_HELD = 300_000  # terms counted, or pairs of sources summed, before a task passes its sums on


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, a stretch of it at a time."""
    blank = text.translate(_TERM_BYTES)
    at = 0
    while at < len(blank):
        end = blank.find(b" ", at + _PIECE)
        end = len(blank) if end < 0 else end
        yield blank[at:end].split()
        at = end


def _text_arrays(*columns: list[bytes]) -> list[pa.Array]:
    """Spark's strings as they came, without another look at their bytes."""
    return [pa.array(values, pa.binary()).view(pa.string()) for values in columns]


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, count, docs) of (lang, source, text); the same term may come several times."""
    occurrences: dict[tuple[bytes, bytes], Counter] = {}
    holders: dict[tuple[bytes, bytes], Counter] = {}
    held = 0

    def passed_on() -> Iterator[pa.RecordBatch]:
        for key, counts in occurrences.items():
            found = holders[key]
            names = list(counts)
            for start in range(0, len(names), 20_000):
                part = names[start : start + 20_000]
                texts = _text_arrays([key[0]] * len(part), [key[1]] * len(part), part)
                sums = [pa.array(map(c.__getitem__, part), pa.int64()) for c in (counts, found)]
                yield pa.RecordBatch.from_arrays([*texts, *sums], ["lang", "source", "term", "count", "docs"])

    for batch in batches:
        columns = [batch[name].cast(pa.binary()) for name in ("lang", "source", "text")]
        for lang, source, text in zip(*columns):
            key = lang.as_py(), source.as_py()
            counts = occurrences.setdefault(key, Counter())
            known = len(counts)
            seen: set[bytes] = set()
            for words in _pieces(text.as_py()):
                counts.update(words)
                seen.update(words)
            held += len(counts) - known
            holders.setdefault(key, Counter()).update(seen)
            if held > _HELD:
                yield from passed_on()
                occurrences, holders, held = {}, {}, 0
    yield from passed_on()


def kept_terms(docs: DataFrame, least_docs: int) -> DataFrame:
    """Stored rows (lang, source, term, count, total, holders, first): terms in enough documents of a lang.

    ``total`` counts the term in the lang, ``holders`` the sources that have it, and ``first`` is 1 in
    one row of each (lang, term). One exchange by (lang, term) serves the counts and the totals.
    """
    schema = "lang string, source string, term string, count bigint, docs bigint"
    partial = docs.mapInArrow(count_terms, schema).repartition("lang", "term")
    counts = partial.groupBy("lang", "term", "source").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    one = F.row_number().over(term.orderBy("source")) == 1
    placed = counts.withColumns(
        {
            "total": F.sum("count").over(term),
            "_docs": F.sum("docs").over(term),
            "holders": F.count(F.lit(1)).over(term),
            "first": one.cast("int"),
        }
    )
    return materialize(placed.where(F.col("_docs") >= least_docs).drop("docs", "_docs"), "terms")


def source_sizes(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Stored rows (lang, source, n, terms, lang_n, v, least): what shares are taken of.

    ``least`` is the share of a term that the source lacks; null where the lang keeps no term.
    """
    own = kept.groupBy("lang", "source").agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("terms"))
    lang = kept.groupBy("lang").agg(F.sum("count").alias("lang_n"), F.sum("first").alias("v"))
    zero = F.lit(0).cast("bigint")
    sizes = docs.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(lang, "lang", "left")
    sizes = sizes.withColumns({name: F.coalesce(name, zero) for name in ("n", "terms", "lang_n", "v")})
    return materialize(sizes.withColumn("least", share(zero, F.col("n"), F.col("v"))), "sources")


def share(count: Column, n: Column, v: Column) -> Column:
    """Smoothed share in billionths; decimals, since a billion times a count may pass 64 bits."""
    wide, of = (count + 1).cast("decimal(20,0)"), F.nullif(n + v, F.lit(0).cast("bigint")).cast("decimal(20,0)")
    scaled = F.lit(SCALE).cast("decimal(10,0)") * wide
    return F.call_function("div", scaled, of) + 1


def divergence(p: Column, q: Column) -> Column:
    """Whole part of (p - q)² / q; shares are about 10^9 at most, so the square fits 64 bits."""
    return F.call_function("div", (p - q) * (p - q), q)


def term_report(kept: DataFrame, sizes: DataFrame, ranks: int) -> DataFrame:
    """(lang, source, item, value, rank): terms that a group uses more than its lang does.

    A group's cells are merged by value. As a level holds one term at least, the first ``ranks`` levels
    hold the whole report; those that begin within it are expanded. Spark cuts the ranked rows to
    ``ranks`` a group before it exchanges them, so that a hot group is not gathered.
    """
    group = ["lang", "source"]
    cells = kept.groupBy(*group, "count", "total").agg(F.count(F.lit(1)).alias("terms"))
    sized = cells.join(sizes.select(*group, "n", "lang_n", "v"), group)
    p, q = share(F.col("count"), F.col("n"), F.col("v")), share(F.col("total"), F.col("lang_n"), F.col("v"))
    shares = sized.withColumns({"p": p, "q": q}).where("p > q")
    valued = materialize(
        shares.select(*group, "count", "total", "terms", divergence(F.col("p"), F.col("q")).alias("value")), "cells"
    )
    levels = valued.groupBy(*group, "value").agg(F.sum("terms").alias("terms"))
    down = Window.partitionBy(*group).orderBy(F.desc("value"))
    reached = levels.withColumn("_level", F.row_number().over(down)).where(F.col("_level") <= ranks)
    before = F.coalesce(F.sum("terms").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begun = reached.withColumn("before", before).where(F.col("before") < ranks).select(*group, "value", "before")
    open_cells = valued.select(*group, "count", "total", "value").join(begun, [*group, "value"])
    terms = kept.select(*group, "count", "total", "term").join(open_cells, [*group, "count", "total"])
    level = Window.partitionBy(*group, "value").orderBy("term")
    placed = terms.withColumn("_nth", F.row_number().over(level)).where(F.col("_nth") <= ranks)
    ranked = placed.withColumn("rank", (F.col("before") + F.col("_nth")).cast("int")).where(F.col("rank") <= ranks)
    return ranked.select(*group, F.col("term").alias("item"), "value", "rank")


def _shared_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, item, value) of rows (lang, term, source, p, least) sorted by lang and term.

    For every two sources with a term, by how much its divergence differs from what it would be if
    each source were judged without the other's count. Sums of a pair may come several times.
    """
    codes: dict[tuple[bytes, bytes], int] = {}
    sums: Counter = Counter()
    waiting: list[pa.Table] = []

    def passed_on() -> Iterator[pa.RecordBatch]:
        names = list(codes)
        keys = [(names[pair >> 32], names[pair & 0xFFFFFFFF]) for pair in sums]
        texts = _text_arrays([a[0] for a, _ in keys], [a[1] for a, _ in keys], [b[1] for _, b in keys])
        value = pa.array(sums.values(), pa.int64())
        yield pa.RecordBatch.from_arrays([*texts, value], ["lang", "source", "item", "value"])
        codes.clear()
        sums.clear()

    def changes(column: pa.ChunkedArray) -> np.ndarray:
        return np.asarray(pc.not_equal(column[1:], column[:-1]).combine_chunks())

    def add(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.r_[True, changes(rows["lang"]) | changes(rows["term"])])
        size = np.diff(np.r_[starts, len(rows)])
        # Numbers of (lang, source), by way of their distinct values.
        keys = zip(rows["lang"].cast(pa.binary()).to_pylist(), rows["source"].cast(pa.binary()).to_pylist())
        at = np.array([codes.setdefault(key, len(codes)) for key in keys], dtype=np.int64)
        p, least = np.asarray(rows["p"]), np.asarray(rows["least"])
        partners = np.repeat(size, size)
        first = np.repeat(starts, size)
        # As many rows at a time as make about a million pairs, or one row.
        cuts = np.searchsorted(np.cumsum(partners), np.arange(0, partners.sum(), 1 << 20))
        for low, high in zip(cuts, np.r_[cuts[1:], len(rows)]):
            if low == high:
                continue
            mine = np.repeat(np.arange(low, high), partners[low:high])
            other = ranges(first[low:high], partners[low:high])
            apart = mine != other
            mine, other = mine[apart], other[apart]
            if not len(mine):
                continue
            pa_, pb, qa, qb = p[mine], p[other], least[mine], least[other]
            own, lacks = pa_ - pb, qa - pb
            value = own * own // pb - lacks * lacks // pb
            own, lacks = pa_ - qb, qa - qb
            value += lacks * lacks // qb - own * own // qb
            pair = (at[mine] << 32) | at[other]
            order = np.argsort(pair, kind="stable")
            pair, value = pair[order], value[order]
            edges = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
            for key, total in zip(pair[edges].tolist(), np.add.reduceat(value, edges).tolist()):
                sums[key] += total
        if len(sums) > _HELD:
            yield from passed_on()

    for batch in batches:
        if not batch.num_rows:
            continue
        waiting.append(pa.Table.from_batches([batch]))
        last = waiting[-1]
        # Only the last term may go on in the next batch.
        whole = len(last) - 1
        while whole >= 0 and all(last[k][whole] == last[k][len(last) - 1] for k in ("term", "lang")):
            whole -= 1
        if whole >= 0:
            yield from add(pa.concat_tables([*waiting[:-1], last.slice(0, whole + 1)]))
            waiting = [last.slice(whole + 1)]
    if waiting:
        yield from add(pa.concat_tables(waiting))
    yield from passed_on()


def pair_report(kept: DataFrame, sizes: DataFrame) -> DataFrame:
    """(lang, source, item, value, rank): how far each source stands from each other one of its lang.

    The terms of a source fall into cells of equal count, each evaluated once against a source without
    the term; what two sources share is a correction, summed inside tasks term by term. So neither
    the terms that a pair lacks nor pairs of rows are ever listed.
    """
    group = ["lang", "source"]
    here = sizes.select(*group, "n", "terms", "v", "least")
    there = sizes.select("lang", F.col("source").alias("item"), F.col("terms").alias("_terms"), F.col("least").alias("q"))
    apart = here.join(there, "lang").where("source != item")
    neither = (F.col("v") - F.col("terms") - F.col("_terms")) * divergence(F.col("least"), F.col("q"))
    wide = "decimal(38,0)"
    lacking = apart.select(*group, "item", F.coalesce(neither, F.lit(0)).cast(wide).alias("value"))

    counts = kept.groupBy(*group, "count").agg(F.count(F.lit(1)).alias("cell"))
    cells = counts.join(here.select(*group, "n", "v"), group).select(
        *group, "cell", share(F.col("count"), F.col("n"), F.col("v")).alias("p")
    )
    against = cells.join(there.select("lang", "item", "q"), "lang").where("source != item")
    one_sided = against.groupBy(*group, "item").agg(
        F.sum((F.col("cell") * divergence(F.col("p"), F.col("q"))).cast(wide)).alias("mine"),
        F.sum((F.col("cell") * divergence(F.col("q"), F.col("p"))).cast(wide)).alias("theirs"),
    )
    mine = one_sided.select(*group, "item", F.col("mine").alias("value"))
    theirs = one_sided.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("theirs").alias("value"))

    shared = kept.where("holders > 1").select(*group, "term", "count").join(here, group)
    by_term = (
        shared.select("lang", "term", "source", share(F.col("count"), F.col("n"), F.col("v")).alias("p"), "least")
        .repartition("lang", "term")
        .sortWithinPartitions("lang", "term")
    )
    both = by_term.mapInArrow(_shared_terms, "lang string, source string, item string, value bigint")
    parts = lacking.unionByName(mine).unionByName(theirs).unionByName(both.withColumn("value", F.col("value").cast(wide)))
    summed = parts.groupBy(*group, "item").agg(F.sum("value").cast("bigint").alias("value"))
    down = Window.partitionBy(*group).orderBy(F.desc("value"), "item")
    return summed.withColumn("rank", F.row_number().over(down))


def audit_sources(docs: DataFrame, least_docs: int = 3, ranks: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank) for every (lang, source) that occurs in ``docs``.

    Part ``pair`` has the divergence of a source from each other source of its lang, part ``term`` the
    first ``ranks`` terms that it uses more than the lang does. A lang keeps the terms that are in
    ``least_docs`` of its rows; each row counts, whether or not others repeat it. Null text, lang and
    source count as empty texts. A text without terms still makes its group occur; a lang that keeps
    no term has pairs of value 0 and no terms. Ties rank by the bytes of the item. No rows give no
    rows. Columns other than text, lang and source are not read. Long texts are split by stretches.
    """
    empty = F.lit("")
    known = docs.select(*[F.coalesce(name, empty).alias(name) for name in ("lang", "source", "text")])
    kept = kept_terms(known, least_docs)
    sizes = source_sizes(known, kept)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    pairs = pair_report(kept, sizes).withColumn("part", F.lit("pair"))
    terms = term_report(kept, sizes, ranks).withColumn("part", F.lit("term"))
    return pairs.select(*columns).unionByName(terms.select(*columns))
