"""Steps across pages: totals, the common-keyword threshold, common keywords, run counters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.functions.joins import join_to_groups
from termloom.functions.text import let
from termloom.operators.content import succeeded
from termloom.operators.keywords import keywords
from termloom.operators.topics import DEFAULT_TAXONOMY, Taxonomy
from termloom.params import DEFAULT_PARAMS, Params


def page_counters(analysis: DataFrame, taxonomy: Taxonomy = DEFAULT_TAXONOMY) -> DataFrame:
    """``(ord, url, n_chars, error, n_keywords, n_topics)`` per page."""
    topics = F.array_distinct(F.transform("keywords", lambda k: taxonomy.order_of(k["keyword"])))
    return analysis.select(
        "ord",
        "url",
        "n_chars",
        "error",
        F.size("keywords").alias("n_keywords"),
        F.size(topics).alias("n_topics"),
    )


def page_stats(
    pages: DataFrame, group_cols: Sequence[str] = (), params: Params = DEFAULT_PARAMS
) -> DataFrame:
    """``(…group, total_urls, processed_urls, failed_urls, threshold)``, one row per group.

    Counts pages, never keywords: a page without keywords is still a processed page.
    """
    good = F.count_if(succeeded())
    return pages.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("total_urls"),
        good.alias("processed_urls"),
        F.count_if(~succeeded()).alias("failed_urls"),
        threshold_of(good, params).alias("threshold"),
    )


def threshold_of(processed: Column, params: Params = DEFAULT_PARAMS) -> Column:
    """How many pages must share a keyword to make it common."""
    return F.greatest(
        F.lit(params.common_floor).cast("bigint"),
        F.ceil(processed * F.lit(params.ratio)).cast("bigint"),
    )


def keyword_totals(analysis: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """``(…group, keyword, n, total, df, first_ord, first_rank)`` over the pages' top keywords.

    All buffers are of fixed width, so this is a hash aggregation that combines before it shuffles;
    a keyword found on every page arrives as one row per task. The merged order is
    ``total DESC, first_ord, first_rank``; apply it where the rows are written.
    """
    rows = keywords(analysis, *group_cols)
    return (
        rows.groupBy(*group_cols, "keyword")
        .agg(
            F.min("n").alias("n"),
            F.sum("score").alias("total"),
            F.count(F.lit(1)).alias("df"),
            F.min("ord").alias("first_ord"),
            F.min_by("rank", "ord").alias("first_rank"),
        )
    )


def with_stats(
    df: DataFrame,
    stats: DataFrame,
    names: Sequence[str],
    group_cols: Sequence[str] = (),
) -> DataFrame:
    """Add columns of the per-group ``stats`` to every row of ``df``.

    Without groups they are fields of one scalar subquery, which runs once; with groups this is a join.
    """
    if group_cols:
        return join_to_groups(df, stats.select(*group_cols, *names), group_cols)
    row = stats.select(F.struct(*names)).scalar()
    return df.withColumns({name: row[name] for name in names})


def common_lists(
    totals: DataFrame,
    stats: DataFrame,
    group_cols: Sequence[str] = (),
) -> DataFrame:
    """One row per group: ``processed_urls``, ``shared`` and ``common``, the lists in rank order.

    ``shared`` names all keywords at or above the threshold; ``common`` holds, as structs, those left
    after single words that occur inside a shared phrase are dropped. A page has at most ``max_keywords``
    keywords and the threshold is at least ``common_ratio`` of the pages, so a group has at most
    ``max_keywords / common_ratio`` shared keywords: the arrays are small whatever the data size.
    """
    reached = with_stats(totals, stats, ["threshold", "processed_urls"], group_cols).where(
        F.col("df") >= F.col("threshold")
    )
    entry = F.struct(
        (-F.col("df")).alias("order"), "first_ord", "first_rank", "keyword", "n", "df", "total"
    )
    shared = reached.groupBy(*group_cols).agg(
        F.array_sort(F.collect_list(entry)).alias("entries"),
        F.max("processed_urls").alias("processed_urls"),
    )
    phrases = F.filter("entries", lambda k: k["n"] > 1)
    inside = F.array_distinct(
        F.flatten(F.transform(phrases, lambda k: F.split(k["keyword"], " ")))
    )
    common = let(
        inside,
        lambda words: F.filter(
            "entries", lambda k: (k["n"] > 1) | ~F.array_contains(words, k["keyword"])
        ),
    )
    return shared.select(
        *group_cols,
        "processed_urls",
        F.transform("entries", lambda k: k["keyword"]).alias("shared"),
        common.alias("common"),
    )


def common_keywords(
    totals: DataFrame, stats: DataFrame, group_cols: Sequence[str] = ()
) -> DataFrame:
    """``(…group, keyword, df, total, rank)``: ``rank`` is the place in the final list."""
    lists = common_lists(totals, stats, group_cols)
    return lists.select(*group_cols, F.posexplode_outer("common").alias("i", "k")).where(
        F.col("k").isNotNull()
    ).select(
        *group_cols,
        F.col("k.keyword").alias("keyword"),
        F.col("k.df").alias("df"),
        F.col("k.total").alias("total"),
        (F.col("i") + 1).alias("rank"),
    )


def run_stats(
    pages: DataFrame,
    totals: DataFrame,
    common: DataFrame,
    group_cols: Sequence[str] = (),
    params: Params = DEFAULT_PARAMS,
) -> DataFrame:
    """Counters of a run, one row per group: page counts, threshold, keyword counts.

    The three sources are counted separately, stacked and summed, so nothing needs joining.
    """
    names = ["total_urls", "processed_urls", "failed_urls", "n_keywords", "n_common"]

    def counts(df: DataFrame, **given: Column) -> DataFrame:
        zero = F.lit(0).cast("bigint")
        part = df.groupBy(*group_cols).agg(*[c.alias(n) for n, c in given.items()])
        return part.select(*group_cols, *[F.col(n) if n in given else zero.alias(n) for n in names])

    rows = F.count(F.lit(1))
    parts = counts(
        pages,
        total_urls=rows,
        processed_urls=F.count_if(succeeded()),
        failed_urls=F.count_if(~succeeded()),
    )
    parts = parts.unionByName(counts(totals, n_keywords=rows))
    parts = parts.unionByName(counts(common, n_common=rows))
    summed = parts.groupBy(*group_cols).agg(*[F.sum(n).alias(n) for n in names])
    return summed.withColumn("threshold", threshold_of(F.col("processed_urls"), params))
