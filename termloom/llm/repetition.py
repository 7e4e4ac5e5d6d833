"""Repetition inside a document, from the suffix array of its words.

The words of several documents are put into one array and sorted together; since a word's number
names the document too, nothing ever matches across documents. Longest common prefixes of
neighbours in the suffix array give every maximal repeated substring.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm.ragged import offsets
from termloom.llm.words import WHITE_SPACE, words

# The symbols that the base rule counts.
SYMBOLS = "#*$%&|<>"
BASE_WINDOW = 3
# Words sorted together: a bound of working memory that changes no result.
GROUP_WORDS = 150_000


@dataclass(frozen=True)
class Limits:
    """A text passes if it has enough words and repeats little.

    ``min_words`` and ``max_window_percent`` are the base rule. ``repeat_words`` is the shortest
    repeat that counts for ``max_covered``, the largest share of words inside such repeats, and
    ``max_longest`` is the longest repeat allowed, in words.
    """

    min_words: int = 50
    max_window_percent: int = 50
    repeat_words: int = 10
    max_covered: float = 0.5
    max_longest: int = 50


def suffix_array(symbols: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(start of each suffix in sorted order, classes of windows of 1, 2, 4, … symbols).

    Prefix doubling, in which only suffixes that still tie are sorted again.
    """
    size = len(symbols)
    order = np.argsort(symbols, kind="stable")
    first = np.r_[True, symbols[order][1:] != symbols[order][:-1]]
    starts = np.flatnonzero(first)
    rank = np.empty(size + 1, dtype=np.int64)
    rank[order] = np.repeat(starts, np.diff(np.r_[starts, size]))
    rank[size] = -1
    levels, width = [rank.copy()], 1
    slots = np.flatnonzero(~first | np.r_[~first[1:], False])
    while len(slots):
        tied = order[slots]
        follow = rank[np.minimum(tied + width, size)]
        key = rank[tied] * (size + 1) + follow + 1
        by_key = np.argsort(key, kind="stable")
        tied, key = tied[by_key], key[by_key]
        order[slots] = tied
        first = np.r_[True, key[1:] != key[:-1]]
        starts = np.flatnonzero(first)
        rank[tied] = np.repeat(slots[starts], np.diff(np.r_[starts, len(slots)]))
        levels.append(rank.copy())
        width *= 2
        slots = slots[~first | np.r_[~first[1:], False]]
    return order, levels


def common_prefixes(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Longest common prefix of each suffix in sorted order with the one before it (first: 0)."""
    size = len(order)
    lcp = np.zeros(size, dtype=np.int64)
    near = np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]]) + 1
    left, right = order[near - 1], order[near]
    found = np.zeros(len(near), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        a, b = left + found, right + found
        inside = (a < size) & (b < size)
        same = levels[k][np.minimum(a, size)] == levels[k][np.minimum(b, size)]
        found += (inside & same).astype(np.int64) << k
    lcp[near] = found
    return lcp


def longest_repeats(symbols: np.ndarray) -> np.ndarray:
    """For each place, the length of the longest substring that starts there and occurs again."""
    if not len(symbols):
        return np.zeros(0, dtype=np.int64)
    order, levels = suffix_array(symbols)
    lcp = common_prefixes(order, levels)
    longest = np.empty(len(symbols), dtype=np.int64)
    longest[order] = np.maximum(lcp, np.r_[lcp[1:], 0])
    return longest


def covered(starts: np.ndarray, lengths: np.ndarray, size: int) -> np.ndarray:
    """True for the places inside the union of the spans."""
    change = np.bincount(starts, minlength=size + 1) - np.bincount(starts + lengths, minlength=size + 1)
    return np.cumsum(change[:size]) > 0


def measure_words(documents: list[list[bytes]], least: int) -> np.ndarray:
    """Rows of (n_repeat_words, covered_words, longest_repeat)."""
    sizes = np.array([len(d) for d in documents], dtype=np.int64)
    ends = offsets(sizes)
    symbols = np.empty(ends[-1], dtype=np.int64)
    for document, start in zip(documents, ends[:-1].tolist()):
        # A word's number is the place where its document has it first.
        place = {}.setdefault
        symbols[start : start + len(document)] = list(map(place, document, count(start)))
    longest = longest_repeats(symbols)

    def inside(spans: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        total = offsets(covered(spans, lengths, len(symbols)))
        return np.diff(total[ends])

    windows = np.flatnonzero(longest >= BASE_WINDOW)
    in_windows = inside(windows, np.full(len(windows), BASE_WINDOW))
    # A repeat is left-maximal where it is no mere tail of the repeat one place before.
    before = np.r_[0, longest[:-1]]
    maximal = np.flatnonzero((longest >= least) & (before <= longest))
    in_repeats = inside(maximal, longest[maximal])
    top = np.zeros(len(documents), dtype=np.int64)
    full = sizes > 0
    if full.any():
        top[full] = np.maximum.reduceat(longest, ends[:-1][full])
    return np.stack([in_windows, in_repeats, top], axis=1)


def _plain_counts(text: str, found: list[bytes]) -> tuple[int, int, int, int]:
    lines = [line for line in text.encode().split(b"\n") if line.strip()]
    return (
        len(found),
        len(text) - sum(map(text.count, WHITE_SPACE)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
    )


FIELDS = "n_words word_chars n_symbols n_dup_lines n_repeat_words covered_words longest_repeat".split()


def repetition(text: Column, limits: Limits = Limits()) -> Column:
    """struct of the counts in ``FIELDS`` for each text; a null text counts as empty."""
    least = limits.repeat_words

    @F.arrow_udf(", ".join(f"{name} bigint" for name in FIELDS))
    def measure(texts: pa.Array) -> pa.Array:
        counts: list[tuple[int, ...]] = []
        repeats: list[np.ndarray] = [np.zeros((0, 3), dtype=np.int64)]
        group: list[list[bytes]] = []
        size = 0
        for item in texts:
            text = item.as_py() or ""
            found = words(text)
            if group and size + len(found) > GROUP_WORDS:
                repeats.append(measure_words(group, least))
                group, size = [], 0
            group.append(found)
            size += len(found)
            counts.append(_plain_counts(text, found))
        repeats.append(measure_words(group, least))
        table = np.concatenate([np.array(counts, np.int64).reshape(-1, 4), np.concatenate(repeats)], axis=1)
        return pa.StructArray.from_arrays([pa.array(c) for c in table.T.copy()], FIELDS)

    return measure.asNondeterministic()(text)


def judge_repetition(docs: DataFrame, limits: Limits = Limits(), text: str = "text") -> DataFrame:
    """Add the counts, ``base_failed`` and ``kept`` to every row.

    A null or empty text has zero words and fails the base rule. Repeated rows are judged alike.
    Columns that have one of the new names are replaced.
    """
    counted = docs.withColumn("_repetition", repetition(F.col(text), limits))
    counted = counted.withColumns({name: F.col(f"_repetition.{name}") for name in FIELDS}).drop("_repetition")
    failed = (F.col("n_words") < limits.min_words) | (
        100 * F.col("n_repeat_words") > limits.max_window_percent * F.col("n_words")
    )
    quiet = (F.col("covered_words") <= limits.max_covered * F.col("n_words")) & (
        F.col("longest_repeat") <= limits.max_longest
    )
    return counted.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & quiet)
