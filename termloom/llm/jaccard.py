"""Exact Jaccard join on word n-grams: T-occurrence search with DivideSkip on candidate groups.

Only sets that can reach the required overlap ever meet. Any two sets that link share n-grams in
their prefixes, the part of each set that comes first in one global order; the order puts n-grams
that many documents share last. A set goes to the group of the set with which it shares most, and a
T-occurrence search over whole sets finds the links inside each group. What may link across groups
is then counted and checked pair by pair. A class of sets that is linked already is left alone, so
groups of near copies never become all their pairs.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from heapq import merge

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm.components import connected_components
from termloom.llm.streams import complete_groups
from termloom.llm.sums import sum_over_partitions
from termloom.llm.words import WHITE_SPACE
from termloom.storage import materialize, tables_folder, working_tables


@dataclass(frozen=True)
class Join:
    """Sets of ``words``-word shingles link if 100 x intersection >= ``percent`` x union.

    The others are physical: the sizes, fixed whatever the corpus, of the table of counts that orders
    n-grams and of the filter of document ids, and how many shingles a search group of one task holds.
    """

    words: int = 5
    percent: int = 75
    cell_bits: int = 18
    filter_bits: int = 22
    group_shingles: int = 400_000


_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE_VALUES = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[ord(c) for c in WHITE_SPACE]] = True


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


@lru_cache(maxsize=64)
def _powers(steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, for texts of up to 2^steps bytes."""
    both = []
    for base in (_MULTIPLIER, _INVERSE):
        powers = np.full(1 << steps, base, dtype=np.uint64)
        powers[0] = 1
        both.append(np.cumprod(powers))
    return both[0], both[1]


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word, A-Z in lower case.

    A word's hash is a polynomial of its bytes, the difference of two running sums over the text; so
    all words are hashed at once and none is looked up.
    """
    raw = np.frombuffer((text or "").encode().lower(), dtype=np.uint8)
    if not len(raw):
        return np.zeros(0, dtype=np.uint64)
    space = np.empty(len(raw) + 2, dtype=bool)
    space[0] = space[-1] = True
    space[1:-1] = _IS_SPACE[raw]
    starts = np.flatnonzero(space[:-1] & ~space[1:])
    ends = np.flatnonzero(~space[:-1] & space[1:])
    powers, inverses = _powers(max(12, len(raw).bit_length()))
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_VALUES[raw] * powers[: len(raw)], out=sums[1:])
    words = (sums[ends] - sums[starts]) * inverses[starts]
    return _mixed(words + (ends - starts).astype(np.uint64))


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; a text of fewer words is one, without words none."""
    hashes = word_hashes(text)
    if not len(hashes):
        return np.zeros(0, dtype=np.int64)
    width = min(size, len(hashes))
    count = len(hashes) - width + 1
    # A polynomial of the word hashes: different word sequences agree by chance alone.
    total = hashes[:count] + np.uint64(width)
    for k in range(1, width):
        total *= _MULTIPLIER
        total += hashes[k : k + count]
    total = np.sort(_mixed(total).view(np.int64))
    return total[np.r_[True, total[1:] != total[:-1]]]


def set_number(hashes: np.ndarray) -> int:
    """A 64-bit number of the whole set: copies have the same."""
    value = xxhash.xxh64_intdigest(hashes.tobytes())
    return value - (1 << 64) if value >> 63 else value


def prefix_size(n: int, percent: int) -> int:
    """Of n shingles, how many must be looked at so that no link is missed."""
    return n - -(-percent * n // 100) + 1


def _cells(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)


def count_cells(docs: DataFrame, join: Join) -> np.ndarray:
    """How many (document, shingle) pairs fall in each cell of a table of fixed size, over all documents.

    A shingle that many documents share lifts its cell above the others. Which order the counts give
    is a matter of speed alone.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(1 << join.cell_bits)
        held: list[np.ndarray] = []

        def add() -> None:
            if held:
                total[:] += np.bincount(_cells(np.concatenate(held), join.cell_bits), minlength=len(total))
                held.clear()

        for batch in batches:
            for k, text in enumerate(batch["text"]):
                held.append(shingles(text.as_py(), join.words))
                if k % 512 == 511:
                    add()
            add()
        return total

    total = sum_over_partitions(docs.select("text"), partial, np.float32)
    return np.zeros(1 << join.cell_bits, np.float32) if total is None else total


_SETS = "doc_id bigint, n bigint, set_id bigint, cut bigint, prefix array<bigint>"


def _order_numbers(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Numbers that follow the order by (count, hash), but for hashes alike in their upper half."""
    high = counts.astype(np.float32).view(np.int32).astype(np.int64) << 32
    return high | ((hashes >> 32) + (1 << 31))


def document_sets(docs: DataFrame, join: Join, shared: Broadcast) -> DataFrame:
    """One row per document: n shingles, the number of its set, and the prefix of the set.

    ``shared`` are the counts of ``count_cells``. A column text_hash of ``docs`` is handed on.

    ``cut`` tells where in the order the prefix ends. Of copies in the same task only the first carries the prefix, which is empty in the others: a
    set that very many documents have makes a few rows per token, not one for each copy.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, met = shared.value, set()
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                sizes, numbers, cuts, prefixes = [], [], [], []
                for text in batch["text"]:
                    own = shingles(text.as_py(), join.words)
                    sizes.append(len(own))
                    numbers.append(set_number(own))
                    # The hashes are sorted, so a stable sort by count orders by (count, hash).
                    own_counts = counts[_cells(own, join.cell_bits)]
                    order = np.argsort(own_counts, kind="stable")
                    order = order[: prefix_size(len(own), join.percent) if len(own) else 0]
                    last = order[-1:]
                    cuts.append(int(_order_numbers(own[last], own_counts[last])[0]) if len(own) else 0)
                    prefixes.append(own[order[: 0 if numbers[-1] in met else None]])
                    met.add(numbers[-1])
                ends = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(prefixes)))
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"], *[pa.array(c, pa.int64()) for c in (sizes, numbers, cuts)], lists]
                    + [batch[c] for c in carried],
                    ["doc_id", "n", "set_id", "cut", "prefix", *carried],
                )

    carried = [c for c in docs.columns if c == "text_hash"]
    schema = ", ".join([_SETS, *[f"{c} bigint" for c in carried]])
    return docs.select(F.col("doc_id").cast("bigint"), "text", *carried).mapInArrow(run, schema)


def shared_entries(sets: DataFrame) -> DataFrame:
    """(token, set_id, n, centre) of the prefix tokens that at least two different sets have.

    ``centre`` is the smallest set of the token. Rows of a token stream by in order of their set, so
    a token of any frequency needs no memory.
    """
    entries = sets.select(F.explode("prefix").alias("token"), "set_id", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 3), dtype=np.int64)  # first and last row of the token so far
        sent = 0  # how many of the held rows were passed on already
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([np.asarray(batch.column(k)) for k in range(3)], axis=1)
            rows = np.concatenate([held, rows])
            new = np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)]
            new[: len(held)] = True
            rows = rows[new]
            first = np.r_[True, rows[1:, 0] != rows[:-1, 0]]
            starts = np.flatnonzero(first)
            sizes = np.diff(np.r_[starts, len(rows)])
            live = np.repeat(sizes > 1, sizes)
            centre = np.repeat(rows[starts, 1], sizes)
            live[:sent] = False
            out = [rows[live, 0], rows[live, 1], rows[live, 2], centre[live]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], ["token", "set_id", "n", "centre"])
            last = rows[starts[-1] :]
            held = last if len(last) == 1 else last[[0, -1]]
            sent = len(held) if len(last) > 1 else 0

    by_token = entries.repartition("token").sortWithinPartitions("token", "set_id")
    return by_token.mapInArrow(run, "token bigint, set_id bigint, n bigint, centre bigint")


def _ceil_div(a: Column, by: int) -> Column:
    return F.ceil(a / F.lit(by)).cast("bigint")


def least_overlap(n: Column, m: Column, percent: int) -> Column:
    """The smallest intersection with which sets of n and m shingles link."""
    return _ceil_div((n + m) * percent, 100 + percent)


def _rest(n: Column, percent: int) -> Column:
    """Shingles outside the prefix."""
    return _ceil_div(n * percent, 100) - 1


def least_shared(n: Column, cut_n: Column, m: Column, cut_m: Column, percent: int) -> Column:
    """How many tokens the prefixes of two sets share at least if the sets link.

    Of the set whose prefix ends first, whatever the other set shares with the prefix lies in the
    other's prefix too; only what is outside this prefix can be shared besides.
    """
    rest_n, rest_m = _rest(n, percent), _rest(m, percent)
    rest = F.when(cut_n < cut_m, rest_n).when(cut_m < cut_n, rest_m).otherwise(F.greatest(rest_n, rest_m))
    return F.greatest(F.lit(1), least_overlap(n, m, percent) - rest)


def sizes_fit(n: Column, m: Column, percent: int) -> Column:
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def whole_sets(docs: DataFrame, sets: DataFrame, wanted: DataFrame, join: Join) -> DataFrame:
    """(set_id, n, shingles) of the ``wanted`` sets, each taken from one document that has it.

    Documents are picked by a bit filter of fixed size over their ids, so the texts of the others
    are neither cut nor shuffled; what the filter lets through in error the join removes.
    """
    carriers = materialize(
        sets.join(wanted.select("set_id").distinct(), "set_id", "left_semi")
        .groupBy("set_id").agg(F.min("doc_id").alias("doc_id")),
        "carriers",
    )
    bits = 1 << join.filter_bits

    def places(ids: pa.Array) -> np.ndarray:
        numbers = np.asarray(ids.fill_null(0), dtype=np.int64).view(np.uint64)
        return (_mixed(numbers * _MULTIPLIER) % np.uint64(bits)).astype(np.int64)

    def partial(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        flags = np.zeros(bits, dtype=bool)
        for batch in batches:
            flags[places(batch["doc_id"])] = True
        return np.packbits(flags)

    packed = sum_over_partitions(carriers.select("doc_id"), partial, np.uint8, np.bitwise_or)
    if packed is None:
        packed = np.zeros(bits // 8, dtype=np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(packed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.unpackbits(shared.value).astype(bool)
        for whole in batches:
            picked = whole.filter(pa.array(flags[places(whole["doc_id"])]))
            for start in range(0, picked.num_rows, 256):
                batch = picked.slice(start, 256)
                found = [shingles(t.as_py(), join.words) for t in batch["text"]]
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"],
                        pa.array([set_number(f) for f in found], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found))),
                    ],
                    ["_doc", "set_id", "shingles"],
                )

    cut = docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
        run, "_doc bigint, set_id bigint, shingles array<bigint>"
    )
    match = (cut["set_id"] == carriers["set_id"]) & cut["_doc"].eqNullSafe(carriers["doc_id"])
    kept = cut.join(carriers, match, "left_semi").dropDuplicates(["set_id"])
    return kept.select("set_id", F.size("shingles").cast("bigint").alias("n"), "shingles")


def divide_skip(lists: list[list[int]], needed: int) -> dict[int, int]:
    """How many of the sorted ``lists`` hold each number, for numbers in at least ``needed`` of them.

    The longest lists, fewer than ``needed``, are put aside. A number in enough lists must be in
    enough of the short ones, which are merged by a heap; only those numbers are looked up in the
    long lists by binary search, and given up as soon as too few lists are left.
    """
    lists = sorted(lists, key=len)
    aside = min(needed - 1, len(lists))
    short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
    counts: dict[int, int] = {}
    for number in merge(*short):
        counts[number] = counts.get(number, 0) + 1
    found = {}
    for number, count in counts.items():
        left = len(long)
        if count + left < needed:
            continue
        for own in long:
            at = bisect_left(own, number)
            left -= 1
            if at < len(own) and own[at] == number:
                count += 1
            elif count + left < needed:
                break
        if count >= needed:
            found[number] = count
    return found


def search_group(members: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that connect whatever links connect among ``members``, the first of which goes first.

    Every member is a query against the inverted lists of all; members of the class that is largest
    after the first query are not asked again, since any link leads to a member that is.
    """
    places = np.repeat(np.arange(len(members)), [len(m) for m in members])
    tokens = np.concatenate(members)
    order = np.argsort(tokens, kind="stable")
    tokens, places = tokens[order], places[order]
    starts = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
    index = dict(zip(tokens[starts].tolist(), np.split(places, starts[1:])))
    classes = np.arange(len(members))
    links: list[tuple[int, int]] = []

    def ask(place: int) -> None:
        own, n = members[place], len(members[place])
        lists = [index[token] for token in own.tolist()]
        # Lists without what is in the query's class already.
        lists = [x[classes[x] != classes[place]] for x in lists if len(x) > 1]
        lists = [x.tolist() for x in lists if len(x)]
        needed = -(-percent * n // 100)  # the least overlap with any size that fits
        if len(lists) < needed:
            return
        for other, shared in divide_skip(lists, needed).items():
            union = n + len(members[other]) - shared
            if 100 * shared >= percent * union and classes[other] != classes[place]:
                classes[classes == classes[other]] = classes[place]
                links.append((place, other))

    ask(0)
    largest = np.bincount(classes).argmax()
    for place in np.flatnonzero(classes != largest).tolist():
        ask(place)
    return links


def group_members(chosen: DataFrame, join: Join) -> DataFrame:
    """(centre, part, set_id) of ``chosen`` (set_id, n, centre): a large group is cut by a hash."""
    parts = chosen.groupBy("centre").agg(
        F.ceil(F.sum("n") / F.lit(join.group_shingles)).cast("int").alias("parts")
    )
    return chosen.join(parts, "centre").select(
        "centre", F.pmod(F.xxhash64("set_id"), F.col("parts")).cast("int").alias("part"), "set_id"
    )


def group_links(members: DataFrame, whole: DataFrame, join: Join) -> DataFrame:
    """Links (a, b) inside the parts of ``members``; each part is searched together with the centre.

    The links of the parts to the centre keep the group together.
    """
    centres = members.select("centre", "part").distinct()
    rows = members.withColumn("later", F.lit(1)).unionByName(
        centres.withColumn("set_id", F.col("centre")).withColumn("later", F.lit(0))
    )
    filled = rows.join(whole.select("set_id", "shingles"), "set_id")
    keys = ["centre", "part"]
    placed = filled.repartition(*keys).sortWithinPartitions(*keys, "later", "set_id")

    def work(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        numbers = np.asarray(table["set_id"])
        column = table["shingles"].combine_chunks()
        flat, ends = np.asarray(column.flatten()), np.asarray(column.value_lengths()).cumsum()
        sets = np.split(flat, ends[:-1])
        a, b = [], []
        for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(numbers)]):
            for x, y in search_group(sets[start:end], join.percent):
                a.append(numbers[start + x])
                b.append(numbers[start + y])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return placed.select(*keys, "set_id", "shingles").mapInArrow(complete_groups(keys, work), "a bigint, b bigint")


def pairs_across(entries: DataFrame, placed: DataFrame, percent: int) -> DataFrame:
    """(a, b, n_a, n_b, shared): sets of different classes that share enough prefix tokens to link.

    ``entries`` has token and set_id, and ``placed`` for each set n, cut, class and group. Only tokens of
    several classes matter, and only sets that have enough of them. Two sets that were searched in
    the same group and are in different classes do not link.
    """
    classed = entries.select("token", "set_id").join(placed.select("set_id", "class"), "set_id")
    by_class = classed.repartition("token").sortWithinPartitions("token", "class")

    def mixed(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        kind, ends = np.asarray(table["class"]), np.r_[starts[1:], len(table)]
        several = np.repeat(kind[starts] != kind[ends - 1], ends - starts)
        yield from table.select(["token", "set_id"]).filter(pa.array(several)).to_batches()

    left = by_class.mapInArrow(complete_groups(["token"], mixed), "token bigint, set_id bigint")
    left = materialize(left, "mixed-tokens")
    lists = left.groupBy("set_id").agg(F.count(F.lit(1)).alias("lists")).join(placed, "set_id")
    rows = left.join(lists, "set_id").repartition("token").sortWithinPartitions("token", "n")
    names = ["a", "b", "n_a", "n_b", "needed"]

    def ceil_div(a: np.ndarray, by: int) -> np.ndarray:
        return -(-a // by)

    def work(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        columns = ("set_id", "n", "cut", "class", "lists", "group")
        number, n, cut, kind, lists, group = (np.asarray(table[c]) for c in columns)
        rest = ceil_div(n * percent, 100) - 1
        end = np.repeat(np.r_[starts[1:], len(n)], np.diff(np.r_[starts, len(n)]))
        one, step = np.arange(len(n)), 1
        # Every row with the one that is ``step`` rows further in its group, for step 1, 2, … Rows come
        # by size, so a row is done as soon as a partner is too large.
        while len(one):
            one = one[one + step < end[one]]
            one = one[100 * n[one] >= percent * n[one + step]]
            other = one + step
            step += 1
            apart = (kind[one] != kind[other]) & (group[one] != group[other])
            x, y = one[apart], other[apart]
            overlap = ceil_div((n[x] + n[y]) * percent, 100 + percent)
            # As in least_shared.
            outside = np.where(cut[x] < cut[y], rest[x], np.where(cut[y] < cut[x], rest[y], np.maximum(rest[x], rest[y])))
            needed = np.maximum(1, overlap - outside)
            may = np.minimum(lists[x], lists[y]) >= needed
            x, y, needed = x[may], y[may], needed[may]
            if len(x):
                first, second = np.where(number[x] < number[y], x, y), np.where(number[x] < number[y], y, x)
                columns = [number[first], number[second], n[first], n[second], needed]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    pairs = rows.select("token", "set_id", "n", "cut", "class", "lists", "group").mapInArrow(
        complete_groups(["token"], work), ", ".join(f"{name} bigint" for name in names)
    )
    counted = pairs.groupBy(*names).agg(F.count(F.lit(1)).alias("shared"))
    return counted.where(F.col("shared") >= F.col("needed"))


def checked_pairs(pairs: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets link."""
    sets = whole.select("set_id", "shingles")
    both = pairs.join(sets.withColumnsRenamed({"set_id": "a", "shingles": "_a"}), "a").join(
        sets.withColumnsRenamed({"set_id": "b", "shingles": "_b"}), "b"
    )
    shared = F.size(F.array_intersect("_a", "_b"))
    return both.where(100 * shared >= percent * (F.col("n_a") + F.col("n_b") - shared)).select("a", "b")


def set_links(docs: DataFrame, sets: DataFrame, entries: DataFrame, join: Join) -> DataFrame:
    """Stored links (a, b) of set numbers that connect exactly the sets that links connect."""
    percent = join.percent
    # One row per set: its shared tokens, and the centre that most of them have.
    cuts = sets.groupBy("set_id").agg(F.max("cut").alias("cut"))
    centre = F.mode(F.when(F.col("set_id") != F.col("centre"), F.col("centre")), True)
    lists = entries.groupBy("set_id").agg(
        F.count(F.lit(1)).alias("lists"), F.max("n").alias("n"), centre.alias("centre")
    )
    lists = materialize(lists.join(cuts, "set_id"), "token-counts")
    of_centre = lists.select(
        F.col("set_id").alias("centre"), F.col("n").alias("_n"), F.col("lists").alias("_lists"), F.col("cut").alias("_cut")
    )
    needed = least_shared(F.col("n"), F.col("cut"), F.col("_n"), F.col("_cut"), percent)
    chosen = lists.join(of_centre, "centre").where(
        sizes_fit(F.col("n"), F.col("_n"), percent) & (F.least("lists", "_lists") >= needed)
    )
    chosen = materialize(chosen.select("set_id", "n", "centre"), "centres")
    members = materialize(group_members(chosen, join), "groups")
    wanted = members.select("set_id").union(members.select("centre"))
    whole = materialize(whole_sets(docs, sets, wanted, join), "whole-sets")
    first = materialize(group_links(members, whole, join), "links")
    searched = members.select("set_id", F.xxhash64("centre", "part").alias("_group"))
    alone = F.xxhash64("set_id", F.lit(0))  # a centre that is in no other group
    classes = connected_components(first).withColumnsRenamed({"node": "set_id", "component": "_class"})
    placed = lists.select("set_id", "n", "cut").join(searched, "set_id", "left").join(classes, "set_id", "left")
    placed = placed.select(
        "set_id", "n", "cut",
        F.coalesce("_group", alone).alias("group"), F.coalesce("_class", "set_id").alias("class"),
    )
    pairs = materialize(pairs_across(entries, materialize(placed, "classes"), percent), "pairs")
    more = materialize(
        whole_sets(docs, sets, pairs.select(F.col("a").alias("set_id")).union(pairs.select("b")), join), "whole-sets"
    )
    return materialize(first.union(checked_pairs(pairs, more, percent)), "links")


def shingle_components(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text); other columns are dropped.

    Copies have the same set and the same component. A null, empty or wordless text has no shingles
    and links with nothing. ``component_id`` is the smallest doc_id that links reach; a null doc_id
    is reached but never the smallest, unless there is no other. Repeated rows stay repeated. An
    empty table gives an empty result. Shingles and sets are told apart by 64-bit hashes. The result is
    a stored table; all tables on the way to it are removed.
    """
    folder = tables_folder(docs.sparkSession)
    with working_tables(docs.sparkSession):
        return materialize(_components(docs, join), "shingle-components", folder)


def near_copies(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """(doc_id, text_hash, first) for each pair of them in ``docs`` (doc_id, text) whose text has words.

    text_hash is xxhash64 of the text. ``first`` is true for one pair of all that links connect: that
    with the smallest doc_id, null last, then the smallest hash. A stored table, as of ``shingle_components``.
    """
    folder = tables_folder(docs.sparkSession)
    with working_tables(docs.sparkSession):
        hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
        order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
        sets, components = _set_components(hashed, join, order)
        joined = sets.where("n > 0").join(components, "set_id")
        first = F.col("doc_id").eqNullSafe(F.col("component.doc_id")) & (F.col("text_hash") == F.col("component.text_hash"))
        return materialize(joined.select("doc_id", "text_hash", first.alias("first")).distinct(), "near-copies", folder)


def _components(docs: DataFrame, join: Join) -> DataFrame:
    sets, components = _set_components(docs.select("doc_id", "text"), join, F.col("doc_id"))
    keyed = sets.withColumn("set_id", F.when(F.col("n") > 0, F.col("set_id")))
    return keyed.join(components, "set_id", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")
    )


def _set_components(docs: DataFrame, join: Join, order: Column) -> tuple[DataFrame, DataFrame]:
    """The stored sets of ``docs``, and for each set (set_id, component), the least ``order`` that links reach."""
    shared = docs.sparkSession.sparkContext.broadcast(count_cells(docs, join))
    cut = document_sets(docs, join, shared)
    # Prefixes are made twice rather than stored: they are large, and shingling is cheap.
    sets = materialize(cut.drop("prefix"), "shingle-sets")
    full = sets.where("n > 0")
    entries = materialize(shared_entries(cut.where("n > 0")), "shared-tokens")
    links = set_links(docs, full, entries, join)
    found = connected_components(links).withColumnsRenamed({"node": "set_id", "component": "_class"})
    first = full.groupBy("set_id").agg(F.min(order).alias("first"))
    classed = first.join(found, "set_id", "left").withColumn("_class", F.coalesce("_class", "set_id"))
    smallest = classed.groupBy("_class").agg(F.min("first").alias("component"))
    return sets, classed.join(smallest, "_class").select("set_id", "component")
