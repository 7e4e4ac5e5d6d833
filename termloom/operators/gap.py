"""Keyword gaps between pages, as rows.

Each section ranks whole tables and keeps the best ``gap_items`` per group. Spark prunes to that
many rows per task before any exchange, so a hot group does not gather in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions.joins import join_on
from termloom.functions.text import let
from termloom.operators.aggregate import common_keywords, common_lists, with_stats
from termloom.operators.content import succeeded
from termloom.params import DEFAULT_PARAMS, Params
from termloom.storage import materialize
from termloom.vocab import GAP_SECTIONS, PAGE_SECTION


def _best(df: DataFrame, group: Sequence[str], order: Sequence[Column], params: Params) -> DataFrame:
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.where(F.col("rank") <= params.gap_items)


def _below_threshold(totals: DataFrame, stats: DataFrame, group: Sequence[str]) -> DataFrame:
    return with_stats(totals, stats, ["threshold"], group).where(F.col("df") < F.col("threshold"))


def gap_common(
    totals: DataFrame,
    stats: DataFrame,
    group_cols: Sequence[str] = (),
    params: Params = DEFAULT_PARAMS,
) -> DataFrame:
    """``(…group, item, rank, df, total)``: the common keywords most pages share."""
    common = common_keywords(totals, stats, group_cols).drop("rank")
    best = _best(common, group_cols, [F.desc("df"), F.desc("total"), F.asc("keyword")], params)
    return best.select(*group_cols, F.col("keyword").alias("item"), "rank", "df", "total")


def gap_underutilized(
    totals: DataFrame,
    stats: DataFrame,
    group_cols: Sequence[str] = (),
    params: Params = DEFAULT_PARAMS,
) -> DataFrame:
    """``(…group, item, rank, df, total, mean_score)``: few pages use it, but those lean on it."""
    rare = _below_threshold(totals, stats, group_cols)
    order = [F.desc(F.col("total") / F.col("df")), F.asc("df"), F.asc("keyword")]
    return _best(rare, group_cols, order, params).select(
        *group_cols,
        F.col("keyword").alias("item"),
        "rank",
        "df",
        "total",
        F.round(F.col("total") / F.col("df"), 6).alias("mean_score"),
    )


def gap_long_tail(
    totals: DataFrame,
    stats: DataFrame,
    group_cols: Sequence[str] = (),
    params: Params = DEFAULT_PARAMS,
) -> DataFrame:
    """``(…group, item, rank, df, total, n)``: long phrases that are not common."""
    phrases = _below_threshold(totals.where(F.col("n") >= 2), stats, group_cols)
    order = [F.desc("n"), F.desc("total"), F.asc("keyword")]
    return _best(phrases, group_cols, order, params).select(
        *group_cols, F.col("keyword").alias("item"), "rank", "df", "total", "n"
    )


def _lists_of_groups(totals: DataFrame, stats: DataFrame, group: Sequence[str]) -> DataFrame:
    """``common_lists``, stored.

    The size of the table is then known before the pages are read, and a small one goes to all tasks: pages
    are not exchanged by group, where the largest group would be one task. It may be read twice.
    """
    return materialize(common_lists(totals, stats, group), "lists")


def _page_names() -> Column:
    return F.transform("keywords", lambda k: k["keyword"])


def _common_that_page_lacks() -> Column:
    """The entries of ``common`` that the page lacks.

    The names the page shares with the list come from one intersection of hash sets; only these
    few are searched for each entry.
    """
    named = F.transform("common", lambda c: c["keyword"])
    return let(
        F.array_intersect(_page_names(), named),
        lambda names: F.filter("common", lambda c: ~F.array_contains(names, c["keyword"])),
    )


def _places_of_common() -> Column:
    """The places, from 1, of the page's keywords in ``common``."""
    return let(
        F.transform("common", lambda c: c["keyword"]),
        lambda named: F.transform(
            F.array_intersect(_page_names(), named), lambda name: F.array_position(named, name).cast("int")
        ),
    )


def gap_semantic(
    analysis: DataFrame,
    totals: DataFrame,
    stats: DataFrame,
    group_cols: Sequence[str] = (),
    params: Params = DEFAULT_PARAMS,
    min_pages: int = 2,
) -> DataFrame:
    """``(…group, item, seed, rank, df, n_ab, lift)``: terms that keep company with common keywords.

    ``lift`` is pages x shared / (pages with the term x pages with the seed), over pages that have
    both at least ``min_pages`` times; a term is listed with its best seed. Pairs are made inside a
    page, of its other keywords and the places of its common ones in the list, and are combined before
    they are shuffled; the list names the seeds of those left.
    """
    group = list(group_cols)
    lists = _lists_of_groups(totals, stats, group)
    names = ["shared", "common", "processed_urls"]
    pages = with_stats(analysis.where(succeeded()), lists, names, group)
    words = pages.select(
        *group, _places_of_common().alias("seeds"), F.array_except(_page_names(), "shared").alias("others")
    )
    # Outer explodes: the inner form would evaluate the arrays once more in a derived filter.
    pairs = (
        words.select(*group, "seeds", F.explode_outer("others").alias("keyword"))
        .select(*group, "keyword", F.explode_outer("seeds").alias("place"))
        .where(F.col("keyword").isNotNull() & F.col("place").isNotNull())
    )
    counted = pairs.groupBy(*group, "keyword", "place").agg(F.count(F.lit(1)).alias("n_ab"))
    # A term meets at most max_keywords / common_ratio seeds, so no join key is hot.
    terms = totals.select(*group, "keyword", "df").where(F.col("df") >= min_pages)
    met = join_on(counted.where(F.col("n_ab") >= min_pages), terms, [*group, "keyword"], "inner")
    seed = F.element_at("common", F.col("place"))
    met = with_stats(met, lists, names, group).withColumns({"seed": seed["keyword"], "seed_df": seed["df"]})
    lift = (F.col("processed_urls") * F.col("n_ab")) / (F.col("df") * F.col("seed_df"))
    scored = met.withColumn("lift", lift)
    best_seed = Window.partitionBy(*group, "keyword").orderBy(F.desc("lift"), F.desc("n_ab"), "seed")
    one = scored.withColumn("_seed_rank", F.row_number().over(best_seed)).where(
        F.col("_seed_rank") == 1
    )
    order = [F.desc("lift"), F.desc("n_ab"), F.asc("keyword")]
    return _best(one, group, order, params).select(
        *group,
        F.col("keyword").alias("item"),
        "seed",
        "rank",
        "df",
        "n_ab",
        F.round("lift", 6).alias("lift"),
    )


def gap_missing(
    analysis: DataFrame,
    totals: DataFrame,
    stats: DataFrame,
    group_cols: Sequence[str] = (),
) -> DataFrame:
    """``(…group, ord, url, item, rank, df, total)``: the common keywords each page lacks.

    The bounded list of common keywords stands beside each page and loses what the page has.
    """
    lists = _lists_of_groups(totals, stats, group_cols)
    pages = with_stats(analysis.where(succeeded()), lists, ["common"], group_cols)
    lacks = _common_that_page_lacks()
    return (
        pages.select(*group_cols, "ord", "url", F.posexplode_outer(lacks).alias("i", "k"))
        .where(F.col("k").isNotNull())
        .select(
            *group_cols,
            "ord",
            "url",
            F.col("k.keyword").alias("item"),
            (F.col("i") + 1).alias("rank"),
            F.col("k.df").alias("df"),
            F.col("k.total").alias("total"),
        )
    )


def gap_recommendations(
    totals: DataFrame,
    stats: DataFrame,
    group_cols: Sequence[str] = (),
    params: Params = DEFAULT_PARAMS,
) -> DataFrame:
    """``(…group, item, rank, df, total, lacking)``: the common keywords that most pages lack."""
    common = common_keywords(totals, stats, group_cols).drop("rank")
    counted = with_stats(common, stats, ["processed_urls"], group_cols)
    lacking = counted.withColumn("lacking", F.col("processed_urls") - F.col("df")).where(F.col("lacking") > 0)
    best = _best(lacking, group_cols, [F.desc("lacking"), F.desc("total"), F.asc("keyword")], params)
    return best.select(*group_cols, F.col("keyword").alias("item"), "rank", "df", "total", "lacking")


def keyword_gap(
    analysis: DataFrame,
    totals: DataFrame,
    stats: DataFrame,
    group_cols: Sequence[str] = (),
    params: Params = DEFAULT_PARAMS,
) -> DataFrame:
    """All sections stacked: ``(…group, section, item, ord, url, rank, df, total)``.

    The five sections concern the group; the section ``PAGE_SECTION`` holds up to ``gap_items`` rows for
    each page, with its ``ord`` and ``url``.
    """
    group = list(group_cols)
    common, under, tail, semantic, advice = GAP_SECTIONS
    no_text, no_total = F.lit(None).cast("string"), F.lit(None).cast("bigint")

    def section(df: DataFrame, name: str, url: Column = no_text, total: Column | None = None):
        return df.select(
            *group,
            F.lit(name).alias("section"),
            "item",
            (F.col("ord") if name == PAGE_SECTION else F.lit(None)).cast("bigint").alias("ord"),
            url.alias("url"),
            F.col("rank").cast("int").alias("rank"),
            "df",
            (F.col("total") if total is None else total).alias("total"),
        )

    parts = [
        section(gap_common(totals, stats, group, params), common),
        section(gap_underutilized(totals, stats, group, params), under),
        section(gap_long_tail(totals, stats, group, params), tail),
        section(gap_semantic(analysis, totals, stats, group, params), semantic, total=no_total),
        section(gap_recommendations(totals, stats, group, params), advice),
        section(
            gap_missing(analysis, totals, stats, group).where(F.col("rank") <= params.gap_items),
            PAGE_SECTION,
            url=F.col("url"),
        ),
    ]
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part)
    return stacked
