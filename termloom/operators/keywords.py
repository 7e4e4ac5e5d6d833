"""Ranked keywords per page.

``analyze_pages`` gives one row per page with its keywords as an array. Page work is then a
projection, with no shuffle; only steps across pages exchange rows.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions import scoring
from termloom.functions import text as tx
from termloom.functions.membership import mark_possible_members
from termloom.operators.content import gate_content, succeeded
from termloom.params import DEFAULT_PARAMS, Params
from termloom.storage import materialize
from termloom.vocab import STOP_WORDS

# Columns of the input that tell a page's size without its text. They route pages only.
SIZE_HINTS = ("size_hint", "html_chars")
SPACE = " "
# Chunks are counted together in one row up to about so many characters.
PART_CHARS = 1_000_000


def _rows(df: DataFrame, array: Column, *columns: str) -> DataFrame:
    """Explode ``array`` to a struct column ``e`` beside ``columns``.

    The outer form with a later filter: for the inner form the optimizer derives a filter on the
    array's size and may move it, array expression and all, down to the scan.
    """
    return df.select(*columns, F.explode_outer(array).alias("e")).where(F.col("e").isNotNull())


def page_words(
    texts: DataFrame, stop_words: Iterable[str] = STOP_WORDS, params: Params = DEFAULT_PARAMS
) -> DataFrame:
    """``(ord, pos, token)``: every usable word with its index in the unfiltered token list."""
    words = scoring.kept_column(F.lower("text"), stop_words, params)
    return _rows(texts, words, "ord").select("ord", F.col("e.pos").alias("pos"), F.col("e.word").alias("token"))


def _by_key(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(ord, text)`` of the pages that have an ``ord`` of their own, and of the others.

    Equal keys, and null ones, are found on the keys alone; a filter of them then divides the pages inside the
    scan, so no text moves. Chance may put a page with the others, whose form is right for it, too.
    """
    shared = texts.groupBy("ord").agg(F.count(F.lit(1)).alias("_pages"))
    shared = shared.where((F.col("_pages") > 1) | F.col("ord").isNull())
    marked = mark_possible_members(texts.select("ord", "text"), shared.select("ord"), ["ord"], "_shared")
    return tuple(marked.where(is_).select("ord", "text") for is_ in (~F.col("_shared"), F.col("_shared")))


def term_counts(
    texts: DataFrame,
    stop_words: Iterable[str] = STOP_WORDS,
    non_nouns: Iterable[str] = (),
    params: Params = DEFAULT_PARAMS,
) -> DataFrame:
    """``(ord, term, n, tenths, count, first_pos)``: every word and every supported phrase.

    A page's terms are counted inside its own row and then become rows, so neither text nor terms are
    exchanged, and a page must fit a task's memory (``chunked_term_counts`` cuts larger ones). Pages that share
    an ``ord`` count as one; only these are exchanged.
    """
    own, shared = _by_key(texts)
    counted = scoring.scored_column(
        F.lower("text"), scoring.counted_rows, scoring.COUNTED, stop_words, tuple(non_nouns), params
    )
    counts = _rows(own, counted, "ord").select("ord", "e.*")
    found = counts.withColumn("first_pos", F.col("first_pos").cast("int"))
    return found.unionByName(_term_counts_by_key(shared, stop_words, non_nouns, params))


def _term_counts_by_key(
    texts: DataFrame, stop_words: Iterable[str], non_nouns: Iterable[str], params: Params
) -> DataFrame:
    """``term_counts`` with the pages of equal ``ord`` as one: terms become rows, are grouped and can spill.

    The text is partitioned by page before it is exploded; that exchange moves text, not terms, and
    serves the grouping and the ranking after it.
    """
    by_page = texts.select("ord", "text").repartition("ord")
    words = by_page.select("ord", tx.kept_words(F.col("text"), stop_words, params).alias("words"))
    placed = words.select("ord", "words", F.posexplode_outer("words").alias("at", "e"))
    chained = placed.where(F.col("e").isNotNull()).select(
        "ord",
        "at",
        F.col("e.pos").alias("pos"),
        F.col("e.word").alias("w0"),
        F.get("words", F.col("at") + 1)["word"].alias("w1"),
        F.get("words", F.col("at") + 2)["word"].alias("w2"),
    )
    return _count_terms(chained, non_nouns, params)


def _count_terms(chained: DataFrame, non_nouns: Iterable[str], params: Params) -> DataFrame:
    """``term_counts`` of rows (ord, at, pos, w0, w1, w2): each word with the two that follow."""
    plain = sorted(non_nouns)
    noun = ~F.col("w0").isin(*plain) if plain else None

    def term(value: Column, n: int, tenths: Column) -> Column:
        return F.struct(value.alias("term"), F.lit(n).alias("n"), tenths.cast("bigint").alias("tenths"))

    space = F.lit(SPACE)
    terms = chained.select(
        "ord",
        "at",
        F.explode(
            F.array(
                term(F.col("w0"), 1, tx.word_tenths(F.col("w0"), F.col("pos"), noun, params)),
                term(F.concat("w0", space, "w1"), 2, F.lit(params.bigram_tenths)),
                term(F.concat("w0", space, "w1", space, "w2"), 3, F.lit(params.trigram_tenths)),
            )
        ).alias("t"),
    ).select("ord", "at", "t.*")
    named = terms.where(F.col("term").isNotNull()).withColumnRenamed("at", "first_pos")
    return _supported(_sums(named, F.count(F.lit(1))), params)


def _sums(terms: DataFrame, count: Column) -> DataFrame:
    sums = [F.sum("tenths").alias("tenths"), count.alias("count"), F.min("first_pos").alias("first_pos")]
    return terms.groupBy("ord", "n", "term").agg(*sums).select("ord", "term", "n", "tenths", "count", "first_pos")


def _supported(counts: DataFrame, params: Params) -> DataFrame:
    """Words, and the phrases that occur often enough."""
    n, count = F.col("n"), F.col("count")
    return counts.where(
        (n == 1)
        | ((n == 2) & (count >= params.bigram_min_freq))
        | ((n == 3) & (count >= params.trigram_min_freq))
    )


def chunked_term_counts(
    texts: DataFrame,
    stop_words: Iterable[str] = STOP_WORDS,
    non_nouns: Iterable[str] = (),
    params: Params = DEFAULT_PARAMS,
    rows: scoring.Rows = scoring.counted_rows,
) -> DataFrame:
    """``term_counts`` for pages larger than a task should hold.

    A text is cut into chunks that end with a token. Neighbouring chunks of about ``PART_CHARS`` characters form
    a part, in whose row the terms of its chunks are counted: the places of tokens and words are carried from
    chunk to chunk, and phrases lie across the seams. A page of one part is then done; ``rows`` may keep the terms
    that matter of it. The parts of a larger one are dealt over the tasks, and a window over one narrow row
    per part carries on what is local to it: the tokens and words before it, and the next two words after it, which
    phrases across the seam need. Its terms then group by term, not by page.

    Pages that share an ``ord``, or have none, take the form that groups by ``ord`` throughout.
    """
    plain = tuple(non_nouns)
    own, shared = _by_key(texts)
    per = max(1, PART_CHARS // params.chunk_chars)
    cut = own.select("ord", tx.text_chunks(F.col("text"), params.chunk_chars).alias("chunks"))
    small = F.size("chunks") <= per
    counted = scoring.scored_column(F.col("chunks"), rows, scoring.COUNTED, stop_words, plain, params)
    whole = _rows(cut.where(small), counted, "ord").select("ord", "e.*")

    places = F.sequence(F.lit(0), F.floor((F.size("chunks") - 1) / per).cast("int"))
    parts = F.transform(places, lambda i: F.slice("chunks", i * per + 1, per))
    dealt = cut.where(~small).select("ord", F.posexplode(parts).alias("part", "chunks")).repartition("ord", "part")
    sizes = dealt.select("ord", "part", scoring.sizes_column(F.col("chunks"), stop_words, params).alias("s"))
    in_order = Window.partitionBy("ord").orderBy("part")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    placed = sizes.select("ord", "part", "s.*").withColumns(
        {
            "pos_before": F.coalesce(F.sum("tokens").over(before), F.lit(0)),
            "at_before": F.coalesce(F.sum("kept").over(before), F.lit(0)),
        }
    ).where("kept > 0")
    # A part left has a word at least, so the heads of two hold the next two words.
    none = F.array().cast("array<string>")
    heads = [F.coalesce(F.lead("head", k).over(in_order), none) for k in (1, 2)]
    seams = placed.select("ord", "part", "pos_before", "at_before", F.slice(F.concat(*heads), 1, 2).alias("after"))
    joined = dealt.join(seams, ["ord", "part"])
    of_part = scoring.part_column(
        F.concat("chunks", "after"),
        (F.col("pos_before"), F.col("at_before")),
        F.size("after").cast("bigint"),
        stop_words,
        plain,
        params,
    )
    terms = _rows(joined, of_part, "ord").select("ord", "e.*")
    found = _supported(_sums(terms, F.sum("count")), params)
    return whole.unionByName(found).unionByName(_chunked_counts_by_key(shared, stop_words, plain, params))


def _chunked_counts_by_key(
    texts: DataFrame, stop_words: Iterable[str], non_nouns: Iterable[str], params: Params
) -> DataFrame:
    """``chunked_term_counts`` by way of one row per word and phrase; chunks and terms are told apart by ``ord``."""
    cut = F.posexplode(tx.text_chunks(F.col("text"), params.chunk_chars)).alias("chunk", "text")
    dealt = texts.select("ord", cut).repartition("ord", "chunk")
    found = dealt.select("ord", "chunk", tx.counted_words(F.col("text"), stop_words, params).alias("found"))
    words = found.select("ord", "chunk", F.col("found.tokens").alias("tokens"), F.col("found.words").alias("words"))
    in_order = Window.partitionBy("ord").orderBy("chunk")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    head = F.transform(F.slice("words", 1, 2), lambda e: e["word"])
    sizes = words.select("ord", "chunk", "tokens", F.size("words").cast("bigint").alias("kept"), head.alias("head"))
    placed = sizes.withColumns(
        {
            "pos_before": F.coalesce(F.sum("tokens").over(before), F.lit(0)),
            "at_before": F.coalesce(F.sum("kept").over(before), F.lit(0)),
        }
    ).where("kept > 0")
    # A chunk left has a word at least, so the heads of two hold the next two words.
    none = F.array().cast("array<string>")
    heads = [F.coalesce(F.lead("head", k).over(in_order), none) for k in (1, 2)]
    seams = placed.select("ord", "chunk", "pos_before", "at_before", F.slice(F.concat(*heads), 1, 2).alias("after"))

    def chain(words: Column, following: Column) -> Column:
        return F.transform(
            words,
            lambda e, i: F.struct(
                i.cast("bigint").alias("at"),
                e["pos"].alias("pos"),
                e["word"].alias("w0"),
                F.get(following, i + 1).alias("w1"),
                F.get(following, i + 2).alias("w2"),
            ),
        )

    joined = words.select("ord", "chunk", "words").join(seams, ["ord", "chunk"])
    following = F.concat(F.transform("words", lambda e: e["word"]), F.col("after"))
    chains = tx.let(
        F.struct(F.col("words").alias("words"), following.alias("following")),
        lambda both: chain(both["words"], both["following"]),
    )
    rows = joined.select("ord", "pos_before", "at_before", F.explode_outer(chains).alias("e"))
    chained = rows.where(F.col("e").isNotNull()).select(
        "ord",
        (F.col("at_before") + F.col("e.at")).alias("at"),
        (F.col("pos_before") + F.col("e.pos")).alias("pos"),
        "e.w0",
        "e.w1",
        "e.w2",
    )
    return _count_terms(chained, non_nouns, params)


def take_noun_bonus(counts: DataFrame, non_nouns: DataFrame, params: Params) -> DataFrame:
    """Take the noun bonus from words listed in ``non_nouns(word)``, a table of any size.

    A frequent word has a row in nearly every page; adaptive execution broadcasts a small word list and
    splits the rows of such a word otherwise.
    """
    listed = non_nouns.select(F.col("word").alias("term"), F.lit(True).alias("_plain"))
    less = F.when(F.col("_plain"), F.col("count") * params.noun_tenths).otherwise(0)
    return counts.join(listed, "term", "left").select(
        "ord", "term", "n", (F.col("tenths") - less).alias("tenths"), "count", "first_pos"
    )


def rank_terms(counts: DataFrame, params: Params = DEFAULT_PARAMS) -> DataFrame:
    """The best terms of each page: score, then words before phrases, then first occurrence."""
    best = Window.partitionBy("ord").orderBy(F.desc("tenths"), "n", "first_pos")
    return (
        counts.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= params.max_keywords)
        .select(
            "ord",
            F.struct(
                F.col("term").alias("keyword"),
                "n",
                tx.rounded(F.col("tenths")).alias("score"),
                "rank",
                F.col("first_pos").cast("int").alias("first_pos"),
            ).alias("keyword"),
        )
    )


def _keywords_by_rows(
    pages: DataFrame,
    carried: list[str],
    stop_words: Iterable[str],
    non_nouns: DataFrame | None,
    params: Params,
) -> DataFrame:
    """The answer of ``analyze_pages`` by way of ``chunked_term_counts``."""
    # Of a page whose terms are counted in one row, those that cannot be among the best go no further.
    rows = scoring.counted_best if non_nouns is None else scoring.counted_contenders
    counts = chunked_term_counts(pages.where(succeeded()), stop_words, (), params, rows)
    if non_nouns is not None:
        counts = take_noun_bonus(counts, non_nouns, params)
    # At most max_keywords structs per page are gathered.
    best = rank_terms(counts, params).groupBy("ord").agg(F.collect_list("keyword").alias("k"))
    in_order = F.array_sort("k", lambda a, b: a["rank"] - b["rank"])
    found = best.select("ord", in_order.cast(tx.KEYWORD_STRUCT).alias("keywords"))
    none = F.array().cast(tx.KEYWORD_STRUCT)
    return pages.join(found, "ord", "left").select(
        *carried, F.coalesce("keywords", none).alias("keywords")
    )


def _settle_nouns(contenders: DataFrame, carried: list[str], non_nouns: DataFrame, params: Params) -> DataFrame:
    """Rank the terms that may be among a page's best once the lexicon has said which are no nouns.

    Only those words meet the lexicon, whatever its size, and only (page, word) pairs are exchanged for it.
    A frequent word is on nearly every page: adaptive execution sends a small lexicon to all tasks and
    splits the rows of such a word otherwise.
    """
    stored = materialize(contenders, "contenders")
    words = _rows(stored, F.filter("terms", lambda t: t["bonus"] > 0), "ord").select("ord", F.col("e.term").alias("word"))
    listed = words.join(non_nouns, "word", "left_semi")
    plain = listed.groupBy("ord").agg(F.collect_list("word").alias("plain"))  # at most a page's contenders
    none = F.array().cast("array<string>")
    best = scoring.settled_column(F.col("terms"), F.coalesce("plain", none), tx.KEYWORD_STRUCT, params)
    return stored.join(plain, "ord", "left").select(*carried, best.alias("keywords"))


def _is_huge(pages: DataFrame, params: Params) -> Column:
    """Whether a page takes the relational form. A size that is not known may be any.

    ``size_hint`` is compared bare, so that the statistics of a Parquet table rule out its row groups.
    """
    most = params.in_row_max_chars
    if "size_hint" in pages.columns:
        return F.col("size_hint").isNull() | (F.col("size_hint") > most)
    size = F.col("html_chars") if "html_chars" in pages.columns else F.length("text")
    return F.coalesce(size, F.lit(0)) > most


def analyze_pages(
    texts: DataFrame,
    stop_words: Iterable[str] = STOP_WORDS,
    lexicon: DataFrame | None = None,
    params: Params = DEFAULT_PARAMS,
) -> DataFrame:
    """Gate and score ``texts(ord, url, text, …)``; ``ord`` is unique.

    Returns every page once, with ``n_chars``, ``error`` and
    ``keywords ARRAY<STRUCT<keyword, n, score, rank, first_pos>>`` beside its other columns; a page
    with an error has no keywords. ``lexicon(word, is_noun)`` says which words are nouns; a word it
    does not list counts as one, and one listed both ways as none. Rows with a null are ignored.

    Pages are scored inside their own row, up to ``in_row_max_chars``; larger ones take the relational form,
    which gives the same rows. Both are always part of the plan: sizes come from a column of the source
    if it has one (see ``SIZE_HINTS``) and from the lengths otherwise. With a lexicon, of any size, the
    terms that may be among a page's best are stored, and only their words are looked up.
    """
    gated = gate_content(texts, params)
    carried = [c for c in gated.columns if c not in ("text", *SIZE_HINTS)]
    huge = None if params.in_row_max_chars is None else _is_huge(gated, params)
    in_row = gated if huge is None else gated.where(~huge)

    def scored(rows: scoring.Rows, kind: str, name: str) -> DataFrame:
        text = F.when(succeeded(), F.lower("text"))
        found = scoring.scored_column(text, rows, kind, stop_words, (), params)
        return in_row.select(*carried, found.alias(name))

    non_nouns = None
    if lexicon is None:
        found = scored(scoring.best_rows, tx.KEYWORD_STRUCT, "keywords")
    else:
        listed = lexicon.where(~F.col("is_noun") & F.col("word").isNotNull())
        # Both forms read it.
        non_nouns = materialize(listed.select(F.lower("word").alias("word")).distinct(), "lexicon")
        terms = scored(scoring.contending_rows, tx.TERM_STRUCT, "terms")
        found = _settle_nouns(terms, carried, non_nouns, params)
    if huge is None:
        return found
    return found.unionByName(_keywords_by_rows(gated.where(huge), carried, stop_words, non_nouns, params))


def keywords(analysis: DataFrame, *extra: str) -> DataFrame:
    """The keywords as rows ``(ord, url, …extra, keyword, n, score, rank, first_pos)``."""
    return _rows(analysis, F.col("keywords"), "ord", "url", *extra).select(
        "ord", "url", *extra, "e.*"
    )


def extract_keywords(
    texts: DataFrame,
    stop_words: Iterable[str] = STOP_WORDS,
    lexicon: DataFrame | None = None,
    params: Params = DEFAULT_PARAMS,
) -> DataFrame:
    """``keywords`` of ``analyze_pages``."""
    return keywords(analyze_pages(texts, stop_words, lexicon, params))
