"""Column functions that score the terms of one page inside its own row.

A page's terms depend on nothing but the page, so no shuffle is needed to rank them: the page's
word occurrences become an array, equal terms are brought together by sorting that array, and the
best runs are kept. Memory is bounded by one page, and nothing spills. Whole tables are scored by
``functions/scoring.py``, which does the same for many pages at once; tests hold both to one definition.

Every step takes its input as a lambda argument (see ``let``). An expression that named a column
from inside a lambda could be re-evaluated per element once the optimizer inlines that column.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from termloom.params import Params

# Characters that separate tokens (everything but word characters and Cyrillic
# letters), what a usable word looks like, and the white space of HTML text.
# The intersection form of the first runs about eight times faster than one merged class.
TOKEN_SEPARATOR = r"[\W&&[^А-я]]+"
TOKEN_CHARACTER = r"[\wА-я]"
WORD_SHAPE = r"^[a-z][a-z'-]*[a-z]$"
WHITE_SPACE = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+"

KEYWORD_STRUCT = "array<struct<keyword:string,n:int,score:bigint,rank:int,first_pos:int>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and pass it to ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def tokenize(text: Column) -> Column:
    """Lower-case tokens in text order, without empty ones."""
    return F.array_remove(F.split(F.lower(text), TOKEN_SEPARATOR), "")


def is_keyword_word(token: Column, stop_words: Iterable[str], params: Params) -> Column:
    """True for tokens long enough, shaped like a word and not in the stop list."""
    return (
        (F.length(token) >= params.min_word_length)
        & token.rlike(WORD_SHAPE)
        & ~token.isin(*sorted(stop_words))
    )


def _usable(tokens: Column, stop_words: Iterable[str], params: Params) -> Column:
    placed = F.transform(tokens, lambda w, i: F.struct(w.alias("word"), i.cast("int").alias("pos")))
    return F.filter(placed, lambda e: is_keyword_word(e["word"], stop_words, params))


def kept_words(text: Column, stop_words: Iterable[str], params: Params) -> Column:
    """array<struct<word, pos>>: usable words with their index in the *unfiltered* token list."""
    return _usable(tokenize(text), stop_words, params)


def counted_words(text: Column, stop_words: Iterable[str], params: Params) -> Column:
    """struct<tokens, words>: how many tokens a text has, and its ``kept_words``."""
    return let(
        tokenize(text),
        lambda tokens: F.struct(
            F.size(tokens).cast("bigint").alias("tokens"), _usable(tokens, stop_words, params).alias("words")
        ),
    )


def text_chunks(text: Column, chars: int) -> Column:
    """The text in lower case, cut into stretches of ``chars`` characters that end where a token ends.

    Both quantifiers are possessive, so that the cuts take one pass whatever the text holds.
    """
    return F.regexp_extract_all(F.lower(text), F.lit(rf"(?s).{{1,{chars}}}+{TOKEN_CHARACTER}*+"), F.lit(0))


def word_tenths(word: Column, pos: Column, is_noun: Column | None, params: Params) -> Column:
    """Score of one word occurrence, in tenths."""
    tenths = (
        F.lit(params.base_tenths)
        + F.least(F.length(word) * params.length_tenths, F.lit(params.length_cap_tenths))
        + F.when(pos < params.early_position, params.early_tenths).otherwise(0)
        + F.when(pos < params.intro_position, params.intro_tenths).otherwise(0)
    )
    if is_noun is None:
        return tenths + params.noun_tenths
    return tenths + F.when(is_noun, params.noun_tenths).otherwise(0)


def rounded(tenths: Column) -> Column:
    """Tenths to whole points, half up."""
    return F.floor((tenths + 5) / 10).cast("bigint")


def occurrences(words: Column, non_nouns: Iterable[str], params: Params) -> Column:
    """array<struct<w0, w1, w2, at, tenths>>: each kept word with the two that follow, sorted.

    Sorting by three words at once brings equal words, equal bigrams and equal trigrams together, so
    one sort of the words serves all three, and no phrase is built unless it is kept.
    """
    plain = sorted(non_nouns)

    def chain(e: Column, i: Column) -> Column:
        noun = ~e["word"].isin(*plain) if plain else None
        return F.struct(
            e["word"].alias("w0"),
            F.get(words, i + 1)["word"].alias("w1"),
            F.get(words, i + 2)["word"].alias("w2"),
            i.cast("int").alias("at"),
            word_tenths(e["word"], e["pos"], noun, params).cast("int").alias("tenths"),
        )

    return F.sort_array(F.transform(words, chain))


def shared_words(occ: Column) -> Column:
    """For each sorted occurrence, how many leading words (0 to 3) it shares with the one before."""

    def shared(e: Column, i: Column) -> Column:
        before = F.get(occ, i - 1)
        differs = [~F.coalesce(before[w] == e[w], F.lit(False)) for w in ("w0", "w1", "w2")]
        return F.when(differs[0], 0).when(differs[1], 1).when(differs[2], 2).otherwise(3)

    return F.transform(occ, shared)


def _runs(occ: Column, shared: Column, index: Column, n: int, params: Params) -> Column:
    """array<struct<order, n, at, term>>: the distinct n-word terms that are frequent enough."""
    least = {1: 1, 2: params.bigram_min_freq, 3: params.trigram_min_freq}[n]

    def same_as_before(i: Column) -> Column:
        return F.coalesce(F.get(shared, i) >= n, F.lit(False))

    def complete(i: Column) -> Column:
        return F.lit(True) if n == 1 else F.get(occ, i)[f"w{n - 1}"].isNotNull()

    # A run is long enough exactly when the occurrences next to its end belong to it too.
    def starts(i: Column) -> Column:
        inside = [same_as_before(i + k) for k in range(1, least)]
        return reduce(and_, inside, ~same_as_before(i)) & complete(i)

    def ends(i: Column) -> Column:
        inside = [same_as_before(i - k) for k in range(least - 1)]
        return reduce(and_, inside, ~same_as_before(i + 1)) & complete(i)

    def collapse(first: Column, last: Column) -> Column:
        places = F.sequence(first, last)
        if n == 1:
            tenths = F.aggregate(
                places, F.lit(0).cast("bigint"), lambda total, i: total + F.get(occ, i)["tenths"]
            )
        else:
            weight = params.bigram_tenths if n == 2 else params.trigram_tenths
            tenths = (last - first + 1).cast("bigint") * weight
        start = F.get(occ, first)
        return F.struct(
            (-tenths).alias("order"),
            F.lit(n).alias("n"),
            F.array_min(F.transform(places, lambda i: F.get(occ, i)["at"])).alias("at"),
            F.concat_ws(" ", *[start[f"w{k}"] for k in range(n)]).alias("term"),
            # What a word's score falls by if it is no noun.
            ((last - first + 1).cast("bigint") * (params.noun_tenths if n == 1 else 0)).alias("bonus"),
        )

    return F.zip_with(F.filter(index, starts), F.filter(index, ends), collapse)


def all_terms(occ: Column, params: Params) -> Column:
    """array<struct<order, n, at, term, bonus>> of all words and supported phrases.

    The first three fields sort by rank: score, then words before phrases, then first occurrence.
    """
    index = F.when(F.size(occ) > 0, F.sequence(F.lit(0), F.size(occ) - 1)).otherwise(
        F.array().cast("array<int>")
    )

    def terms(shared: Column, index: Column, paired: Column) -> Column:
        runs = [_runs(occ, shared, index, 1, params)]
        for n, least in ((2, params.bigram_min_freq), (3, params.trigram_min_freq)):
            runs.append(_runs(occ, shared, index if least == 1 else paired, n, params))
        return F.concat(*runs)

    def repeats(shared: Column, index: Column) -> Column:
        """The few occurrences that share two words or more with a neighbour."""
        return F.filter(
            index,
            lambda i: (F.get(shared, i) >= 2) | F.coalesce(F.get(shared, i + 1) >= 2, F.lit(False)),
        )

    return let(
        shared_words(occ),
        lambda shared: let(
            index, lambda i: let(repeats(shared, i), lambda paired: terms(shared, i, paired))
        ),
    )


def best_terms(terms: Column, params: Params) -> Column:
    """The first of ``all_terms`` as ranked keywords."""
    best = F.slice(F.sort_array(terms), 1, params.max_keywords)
    return F.transform(
        best,
        lambda t, i: F.struct(
            t["term"].alias("keyword"),
            t["n"].alias("n"),
            rounded(-t["order"]).alias("score"),
            (i + 1).cast("int").alias("rank"),
            t["at"].alias("first_pos"),
        ),
    )


def contending_terms(terms: Column, params: Params) -> Column:
    """Those of ``all_terms`` that may be among the best, whichever of the words are no nouns.

    ``terms`` are scored with every word a noun. If every word lost its bonus, the last of the best would
    have some rank; a term behind that even with its bonus cannot be among them.
    """
    lowest = F.transform(terms, lambda t: F.struct((t["order"] + t["bonus"]).alias("order"), t["n"], t["at"]))
    last = F.get(F.sort_array(lowest), F.lit(params.max_keywords - 1))
    return let(
        last,
        lambda bound: F.filter(
            terms, lambda t: bound.isNull() | (F.struct(t["order"], t["n"].alias("n"), t["at"].alias("at")) <= bound)
        ),
    )


def page_terms(
    text: Column, stop_words: Iterable[str], non_nouns: Iterable[str], params: Params, body: Callable[[Column], Column]
) -> Column:
    """``body`` of ``all_terms`` of one text."""
    return let(
        kept_words(text, stop_words, params),
        lambda words: let(
            occurrences(words, non_nouns, params), lambda occ: let(all_terms(occ, params), body)
        ),
    )


def page_keywords(
    text: Column, stop_words: Iterable[str], non_nouns: Iterable[str], params: Params
) -> Column:
    """The ranked keywords of one text as array<struct<keyword, n, score, rank, first_pos>>."""
    return page_terms(text, stop_words, non_nouns, params, lambda terms: best_terms(terms, params))


TERM_STRUCT = "array<struct<order:bigint,n:int,at:int,term:string,bonus:bigint>>"


def collapse_white_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, WHITE_SPACE, " "))
