"""The words and terms of whole Arrow batches of pages, scored with numpy inside tasks.

``functions/text.py`` defines the scoring as expressions over one page, which Spark interprets value by value.
Here the words of many pages become whole numbers, and equal terms are found by sorting these; no phrase
is built unless it is kept. The rows are the same. A batch is worked off in pieces, so that memory holds
one piece of numbers, or one page, beside the batch itself.

Texts come in lower case, by Spark's ``lower``; the characters of tokens are those of ``TOKEN_SEPARATOR``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from termloom.params import Params

# Bytes of text that are turned into numbers at once; a longer page is a piece of its own.
PIECE_BYTES = 1 << 20

# 1: a letter of a word, 2: a character that tokens may hold beside these, 0: others.
_BYTE_KIND = np.zeros(256, dtype=np.uint8)
_BYTE_KIND[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), ord("_")]] = 2
_BYTE_KIND[ord("a") : ord("z") + 1] = 1


@dataclass(frozen=True)
class Words:
    """The usable words of several pages, in text order."""

    page: np.ndarray
    pos: np.ndarray  # place among all tokens of the page
    at: np.ndarray  # place among its usable words
    code: np.ndarray  # place in ``names``
    names: pa.Array
    tokens: np.ndarray  # tokens of each page


@dataclass(frozen=True)
class Terms:
    """The distinct terms of several pages. ``first`` and ``code`` say where a term first occurs and of which words."""

    page: np.ndarray
    n: np.ndarray
    order: np.ndarray  # the score in tenths, negative
    at: np.ndarray
    count: np.ndarray
    first: np.ndarray


def pieces(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Stretches of the texts (or lists of their chunks) of about ``PIECE_BYTES``, each with its first place."""
    if pa.types.is_list(texts.type):
        chunks = np.append(0, np.cumsum(np.asarray(pc.binary_length(texts.flatten()), dtype=np.int64)))
        ends = chunks[np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(texts), 0), dtype=np.int64))]
    else:
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64))
    begin = 0
    while begin < len(texts):
        most = (ends[begin - 1] if begin else 0) + PIECE_BYTES
        end = max(begin + 1, int(np.searchsorted(ends, most, side="right")))
        yield begin, texts.slice(begin, end - begin)
        begin = end


def _starts(groups: np.ndarray, size: int) -> np.ndarray:
    """Where each of the groups 0, 1, … begins in the sorted numbers ``groups``, and where the last one ends."""
    return np.searchsorted(groups, np.arange(size + 1))


def _characters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a piece, where its pages begin and end in them, and where a token ends whatever follows."""
    if pa.types.is_list(texts.type):
        size = np.asarray(pc.fill_null(pc.list_value_length(texts), 0), dtype=np.int64)
        values, first = texts.flatten(), np.append(0, np.cumsum(size))
    else:
        values, first = pc.fill_null(texts, ""), np.arange(len(texts) + 1)
    values = values.cast(pa.large_string())
    offsets = np.frombuffer(values.buffers()[1], dtype=np.int64)[values.offset : values.offset + len(values) + 1]
    data = values.buffers()[2]
    if data is None or not len(values):
        return np.zeros(0, dtype=np.uint8), np.zeros(len(first), dtype=np.int64), np.zeros(0, dtype=np.int64)
    text = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    return text, offsets[first], offsets[:-1]


def find_words(texts: pa.Array, stop_words: pa.Array, params: Params) -> Words:
    """The words of a piece of texts, or of lists of chunks that end where a token ends."""
    pages = len(texts)
    text, offsets, heads = _characters(texts)
    kind = _BYTE_KIND[text]
    inside = kind > 0
    if len(text) and text.max() >= 0xD0:  # Cyrillic letters from U+0410 to U+044F have two bytes
        after = np.append(text[1:], 0)
        lead = ((text == 0xD0) & (after >= 0x90) & (after <= 0xBF)) | ((text == 0xD1) & (after >= 0x80) & (after <= 0x8F))
        inside |= lead
        inside[1:] |= lead[:-1]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    heads = heads[heads < len(text)]
    opens[heads] = inside[heads]
    closes = inside.copy()
    closes[:-1] &= opens[1:] | ~inside[1:]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    of_page = np.searchsorted(start, offsets)
    page = np.repeat(np.arange(pages), np.diff(of_page))
    size = end - start
    usable = size >= max(params.min_word_length, 2)
    if len(start):
        usable &= ~np.logical_or.reduceat(inside & (kind != 1), start)
    edges = np.zeros(len(text) + 1, dtype=np.int8)
    edges[start[usable]] = 1
    edges[end[usable]] -= 1
    spelled = np.compress(np.cumsum(edges[:-1], dtype=np.int8).view(bool), text).tobytes()
    ends = np.append(0, np.cumsum(size[usable])).astype(np.int64)
    listed = pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(spelled)).dictionary_encode()
    code = np.asarray(listed.indices, dtype=np.int64)
    names = listed.dictionary.cast(pa.string())
    kept = ~np.asarray(pc.is_in(names, value_set=stop_words), dtype=bool)[code]
    place = np.flatnonzero(usable)[kept]
    mine = page[place]
    return Words(
        mine, place - of_page[mine], np.arange(len(place)) - _starts(mine, pages)[mine], code[kept], names, np.diff(of_page)
    )


def _grouped(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first place of each distinct key, how often it occurs, and for each place the number of its key.

    Key and place are sorted as one number if 63 bits hold both, which is several times as fast.
    """
    bits = len(key).bit_length()
    if int(key.max(initial=0)).bit_length() + bits < 64:
        both = np.sort((key << bits) | np.arange(len(key)))
        in_order, order = both >> bits, both & ((1 << bits) - 1)
    else:
        order = np.argsort(key, kind="stable")
        in_order = key[order]
    fresh = np.ones(len(key), dtype=bool)
    fresh[1:] = in_order[1:] != in_order[:-1]
    begin = np.flatnonzero(fresh)
    number = np.empty(len(key), dtype=np.int64)
    number[order] = np.cumsum(fresh) - 1
    return order[begin], np.diff(np.append(begin, len(key))), number


def word_tenths(words: Words, plain: pa.Array, params: Params) -> np.ndarray:
    """Score of each word occurrence, in tenths."""
    size = np.asarray(pc.binary_length(words.names), dtype=np.int64)
    of_name = params.base_tenths + np.minimum(size * params.length_tenths, params.length_cap_tenths)
    of_name += np.where(np.asarray(pc.is_in(words.names, value_set=plain), dtype=bool), 0, params.noun_tenths)
    early = np.where(words.pos < params.early_position, params.early_tenths, 0)
    return of_name[words.code] + early + np.where(words.pos < params.intro_position, params.intro_tenths, 0)


def count_terms(words: Words, plain: pa.Array, params: Params, own: np.ndarray | None = None) -> Terms:
    """All distinct words, and the phrases that occur often enough.

    Only occurrences that are ``own`` count; the others, if any, follow them in their page and end phrases.
    """
    two, three = params.bigram_min_freq, params.trigram_min_freq
    names, size = max(len(words.names), 1), len(words.code)
    own = np.ones(size, dtype=bool) if own is None else own
    first, times, number = _grouped(words.page * names + words.code)
    count = np.bincount(number, weights=own, minlength=len(first)).astype(np.int64)
    # Exact: sums of whole numbers far below 2^53.
    tenths = np.bincount(number, weights=word_tenths(words, plain, params) * own, minlength=len(first)).astype(np.int64)
    kept = count > 0
    found = [(1, first[kept], count[kept], tenths[kept])]
    # A phrase is no more frequent than each word of it, nor a phrase of three than those of two.
    often = times[number] >= min(two, three)
    next_too = np.zeros(size, dtype=bool)
    next_too[:-1] = often[:-1] & often[1:] & (words.page[:-1] == words.page[1:])
    pair = np.full(size, -1, dtype=np.int64)
    place = np.flatnonzero(next_too)
    head, times, number_2 = _grouped(number[place] * names + words.code[place + 1])
    pair[place] = np.where(times[number_2] >= three, number_2, -1)
    count = np.bincount(number_2, weights=own[place], minlength=len(head)).astype(np.int64)
    kept = count >= two
    found.append((2, place[head[kept]], count[kept], count[kept] * params.bigram_tenths))
    place = np.flatnonzero((pair[:-1] >= 0) & (pair[1:] >= 0) & own[:-1]) if size else place
    head, count, _ = _grouped(pair[place] * names + words.code[place + 2])
    kept = count >= three
    found.append((3, place[head[kept]], count[kept], count[kept] * params.trigram_tenths))
    first = np.concatenate([f for _, f, _, _ in found])
    n = np.concatenate([np.full(len(f), k, dtype=np.int64) for k, f, _, _ in found])
    counts = np.concatenate([c for _, _, c, _ in found])
    order = -np.concatenate([t for _, _, _, t in found])
    return Terms(words.page[first], n, order, words.at[first], counts, first)


def term_names(words: Words, terms: Terms, chosen: np.ndarray) -> pa.Array:
    """The chosen terms as texts."""
    n, first = terms.n[chosen], terms.first[chosen]
    parts, places = [], []
    for k in (1, 2, 3):
        mine = np.flatnonzero(n == k)
        parts.append(pc.binary_join_element_wise(*[words.names.take(pa.array(words.code[first[mine] + i])) for i in range(k)], " "))
        places.append(mine)
    return pa.concat_arrays(parts).take(pa.array(np.argsort(np.concatenate(places))))


def _best_first(terms: Terms, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The terms by page and rank, and each one's rank in its page, from 0.

    What they are sorted by is one number if 63 bits hold it, which is several times as fast.
    """
    if not len(order):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    least = int(order.min())
    keys = ((terms.page, 0), (order, least), (terms.n, 0), (terms.at, 0))
    bits = [(int(values.max()) - low).bit_length() for values, low in keys]
    if sum(bits) < 64:
        one = np.zeros(len(order), dtype=np.int64)
        for (values, low), wide in zip(keys, bits):
            one = (one << wide) | (values.astype(np.int64) - low)
        chosen = np.argsort(one)
    else:
        chosen = np.lexsort((terms.at, terms.n, order, terms.page))
    page = terms.page[chosen]
    return chosen, np.arange(len(page)) - _starts(page, int(page[-1]) + 1)[page]


def _listed(page: np.ndarray, pages: int, columns: dict[str, pa.Array]) -> pa.Array:
    """A list of structs for each page, from values that are sorted by page."""
    values = pa.StructArray.from_arrays(list(columns.values()), list(columns))
    return pa.ListArray.from_arrays(pa.array(_starts(page, pages), pa.int32()), values)


Rows = Callable[[Words, Terms, int, Params], pa.Array]


def best_rows(words: Words, terms: Terms, pages: int, params: Params) -> pa.Array:
    """Each page's best terms, ranked."""
    chosen, rank = _best_first(terms, terms.order)
    kept = rank < params.max_keywords
    chosen, rank = chosen[kept], rank[kept]
    return _ranked(terms.page[chosen], pages, term_names(words, terms, chosen), terms.n[chosen], terms.order[chosen], rank, terms.at[chosen])


def _ranked(
    page: np.ndarray, pages: int, names: pa.Array, n: np.ndarray, order: np.ndarray, rank: np.ndarray, at: np.ndarray
) -> pa.Array:
    columns = {
        "keyword": names,
        "n": pa.array(n, pa.int32()),
        "score": pa.array((5 - order) // 10, pa.int64()),
        "rank": pa.array(rank + 1, pa.int32()),
        "first_pos": pa.array(at, pa.int32()),
    }
    return _listed(page, pages, columns)


def _contending(terms: Terms, params: Params, loss: int) -> tuple[np.ndarray, np.ndarray]:
    """Which terms may be among a page's best if any of its words may lose ``loss`` each time it occurs.

    In page order, and what each term may lose. If every word lost it, the last of the best would have some
    rank; a term behind that as it stands cannot be among them.
    """
    bonus = np.where(terms.n == 1, terms.count * loss, 0)
    lowest = terms.order + bonus
    chosen, rank = _best_first(terms, lowest)
    last = chosen[rank == params.max_keywords - 1]
    bound = np.full(int(terms.page.max(initial=-1)) + 1, -1, dtype=np.int64)
    bound[terms.page[last]] = last
    of = bound[terms.page]
    order, n, at = lowest[of], terms.n[of], terms.at[of]
    tied = (terms.n < n) | ((terms.n == n) & (terms.at <= at))
    kept = np.flatnonzero((of < 0) | (terms.order < order) | ((terms.order == order) & tied))
    return kept[np.argsort(terms.page[kept], kind="stable")], bonus


def contending_rows(words: Words, terms: Terms, pages: int, params: Params) -> pa.Array:
    """Each page's terms that may be among its best, whichever words are no nouns."""
    chosen, bonus = _contending(terms, params, params.noun_tenths)
    return _listed(
        terms.page[chosen],
        pages,
        {
            "order": pa.array(terms.order[chosen], pa.int64()),
            "n": pa.array(terms.n[chosen], pa.int32()),
            "at": pa.array(terms.at[chosen], pa.int32()),
            "term": term_names(words, terms, chosen),
            "bonus": pa.array(bonus[chosen], pa.int64()),
        },
    )


def _counted(words: Words, terms: Terms, pages: int, chosen: np.ndarray) -> pa.Array:
    return _listed(
        terms.page[chosen],
        pages,
        {
            "term": term_names(words, terms, chosen),
            "n": pa.array(terms.n[chosen], pa.int32()),
            "tenths": pa.array(-terms.order[chosen], pa.int64()),
            "count": pa.array(terms.count[chosen], pa.int64()),
            "first_pos": pa.array(terms.at[chosen], pa.int64()),
        },
    )


def counted_rows(words: Words, terms: Terms, pages: int, params: Params) -> pa.Array:
    """Each page's terms with their counts."""
    return _counted(words, terms, pages, np.argsort(terms.page, kind="stable"))


def counted_best(words: Words, terms: Terms, pages: int, params: Params) -> pa.Array:
    """``counted_rows`` of each page's best terms."""
    return _counted(words, terms, pages, _contending(terms, params, 0)[0])


def counted_contenders(words: Words, terms: Terms, pages: int, params: Params) -> pa.Array:
    """``counted_rows`` of the terms that may be among a page's best, whichever words are no nouns."""
    return _counted(words, terms, pages, _contending(terms, params, params.noun_tenths)[0])


COUNTED = "array<struct<term:string,n:int,tenths:bigint,count:bigint,first_pos:bigint>>"
KEPT = "array<struct<word:string,pos:int>>"
SIZES = "struct<tokens:bigint,kept:bigint,head:array<string>>"


def _by_pieces(texts: pa.Array, body: Callable[[int, pa.Array], pa.Array]) -> pa.Array:
    return pa.concat_arrays([body(begin, piece) for begin, piece in pieces(texts)])


def scored_column(
    lower: Column, rows: Rows, kind: str, stop_words: Iterable[str], non_nouns: Iterable[str], params: Params
) -> Column:
    """``rows`` of each text of the column, or of each list of chunks; a null has none."""
    stop, plain = (pa.array(sorted(w), pa.string()) for w in (stop_words, non_nouns))

    @F.arrow_udf(kind)
    def scored(texts: pa.Array) -> pa.Array:
        def of_piece(begin: int, piece: pa.Array) -> pa.Array:
            words = find_words(piece, stop, params)
            return rows(words, count_terms(words, plain, params), len(piece), params)

        return _by_pieces(texts, of_piece)

    return scored(lower)


def settled_column(terms: Column, plain: Column, kind: str, params: Params) -> Column:
    """Each page's best terms, ranked, of its ``contending_rows`` once the words in ``plain`` lost their bonus."""

    @F.arrow_udf(kind)
    def settled(terms: pa.Array, plain: pa.Array) -> pa.Array:
        pages = len(terms)
        page, plain_page = (np.repeat(np.arange(pages), np.asarray(pc.list_value_length(x))) for x in (terms, plain))
        order, n, at, names, bonus = terms.flatten().flatten()
        code = pa.concat_arrays([names, plain.flatten()]).dictionary_encode()
        listed, code = max(len(code.dictionary), 1), np.asarray(code.indices, dtype=np.int64)
        is_plain = np.isin(page * listed + code[: len(page)], plain_page * listed + code[len(page) :])
        found = Terms(page, np.asarray(n), np.asarray(order) + np.where(is_plain, np.asarray(bonus), 0), np.asarray(at), page, page)
        chosen, rank = _best_first(found, found.order)
        kept = rank < params.max_keywords
        chosen, rank = chosen[kept], rank[kept]
        return _ranked(page[chosen], pages, names.take(pa.array(chosen)), found.n[chosen], found.order[chosen], rank, found.at[chosen])

    return settled(terms, plain)


def part_column(
    chunks: Column,
    before: tuple[Column, Column],
    after: Column,
    stop_words: Iterable[str],
    non_nouns: Iterable[str],
    params: Params,
) -> Column:
    """``counted_rows`` of a part of a page, every phrase that starts in it included.

    ``before`` says how many tokens and words of the page come before the part; ``after`` is the number of words
    that its last chunk holds beyond its own, which only end phrases.
    """
    stop, plain = (pa.array(sorted(w), pa.string()) for w in (stop_words, non_nouns))
    every = replace(params, bigram_min_freq=1, trigram_min_freq=1)

    @F.arrow_udf(COUNTED)
    def counted(texts: pa.Array, tokens: pa.Array, kept: pa.Array, extra: pa.Array) -> pa.Array:
        def of_piece(begin: int, piece: pa.Array) -> pa.Array:
            inside = slice(begin, begin + len(piece))
            words = find_words(piece, stop, every)
            own = words.at < (np.bincount(words.page, minlength=len(piece)) - np.asarray(extra)[inside])[words.page]
            placed = replace(
                words,
                pos=words.pos + np.asarray(tokens)[inside][words.page],
                at=words.at + np.asarray(kept)[inside][words.page],
            )
            return counted_rows(placed, count_terms(placed, plain, every, own), len(piece), every)

        return _by_pieces(texts, of_piece)

    return counted(chunks, *before, after)


def kept_column(lower: Column, stop_words: Iterable[str], params: Params) -> Column:
    """array<struct<word, pos>>: the usable words of each text with their place among its tokens."""
    stop = pa.array(sorted(stop_words), pa.string())

    @F.arrow_udf(KEPT)
    def kept(texts: pa.Array) -> pa.Array:
        def of_piece(begin: int, piece: pa.Array) -> pa.Array:
            words = find_words(piece, stop, params)
            columns = {"word": words.names.take(pa.array(words.code)), "pos": pa.array(words.pos, pa.int32())}
            return _listed(words.page, len(piece), columns)

        return _by_pieces(texts, of_piece)

    return kept(lower)


def sizes_column(chunks: Column, stop_words: Iterable[str], params: Params) -> Column:
    """struct<tokens, kept, head> of each list of chunks: its tokens, its usable words, and the first two of these."""
    stop = pa.array(sorted(stop_words), pa.string())

    @F.arrow_udf(SIZES)
    def sizes(texts: pa.Array) -> pa.Array:
        def of_piece(begin: int, piece: pa.Array) -> pa.Array:
            words = find_words(piece, stop, params)
            first = np.flatnonzero(words.at < 2)
            heads = pa.ListArray.from_arrays(
                pa.array(_starts(words.page[first], len(piece)), pa.int32()), words.names.take(pa.array(words.code[first]))
            )
            kept = np.bincount(words.page, minlength=len(piece))
            columns = {"tokens": pa.array(words.tokens, pa.int64()), "kept": pa.array(kept, pa.int64()), "head": heads}
            return pa.StructArray.from_arrays(list(columns.values()), list(columns))

        return _by_pieces(texts, of_piece)

    return sizes(chunks)
