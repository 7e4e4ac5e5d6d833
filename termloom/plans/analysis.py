"""The whole analysis: pages in, report tables out."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.functions.text import KEYWORD_STRUCT
from termloom.operators.aggregate import (
    common_keywords,
    keyword_totals,
    page_stats,
    run_stats,
)
from termloom.operators.content import extract_text
from termloom.operators.gap import keyword_gap
from termloom.operators.keywords import analyze_pages, keywords
from termloom.operators.prompts import gap_prompts, page_blocks
from termloom.operators.topics import DEFAULT_TAXONOMY, Taxonomy, keyword_topics, merged_topics
from termloom.params import DEFAULT_PARAMS, Params
from termloom.sinks.reports import common_report, url_report
from termloom.sources.pages import listed_pages, look_up_pages
from termloom.storage import materialize
from termloom.vocab import STOP_WORDS


def analyze_url_list(
    urls: DataFrame,
    pages: DataFrame,
    params: Params = DEFAULT_PARAMS,
    stop_words: Iterable[str] = STOP_WORDS,
    lexicon: DataFrame | None = None,
) -> DataFrame:
    """The page table of ``analyze_pages`` for ``urls(ord, url, …)`` over ``pages(url, html)``.

    A page is parsed and scored once however often the list names it; only its keywords are copied
    to every place in the list. Pages that nobody lists are neither moved nor parsed. Of a URL that was
    crawled more than once one page is used (see ``one_page_per_url``).
    """
    listed = listed_pages(urls, pages)
    # Here the URL is the page's key: a generated number could change when a task is run again.
    keyed = listed.withColumn("ord", F.col("url"))
    found = analyze_pages(extract_text(keyed, params), stop_words, lexicon, params).drop("place")
    none = F.array().cast(KEYWORD_STRUCT)
    return look_up_pages(urls, found).withColumns(
        {
            "keywords": F.coalesce("keywords", none),
            "n_chars": F.coalesce("n_chars", F.lit(0).cast("bigint")),
        }
    )


def run_analysis(
    pages: DataFrame,
    params: Params = DEFAULT_PARAMS,
    group_cols: Sequence[str] = (),
    stop_words: Iterable[str] = STOP_WORDS,
    lexicon: DataFrame | None = None,
    taxonomy: Taxonomy = DEFAULT_TAXONOMY,
) -> dict[str, DataFrame]:
    """Analyse ``pages(ord, url, html | text, [error], …group)`` and return the result tables.

    ``pages`` may also be a page table that ``analyze_url_list`` made.

    The pages are parsed and scored once. The page table, a few kilobytes per page, and the keyword
    totals are written to shared storage; everything else derives from these two.
    """
    if pages.isEmpty():
        raise ValueError("no pages to analyse")
    if "keywords" in pages.columns:
        scored = pages
    else:
        texts = extract_text(pages, params) if "html" in pages.columns else pages
        scored = analyze_pages(texts, stop_words, lexicon, params)
    analysis = materialize(scored, "pages")
    totals = materialize(keyword_totals(analysis, group_cols), "totals")
    stats = page_stats(analysis, group_cols, params)
    common = common_keywords(totals, stats, group_cols)
    blocks = page_blocks(analysis, taxonomy, group_cols, params)
    return {
        "analysis": analysis,
        "page_status": analysis.drop("keywords"),
        "keywords": keywords(analysis, *group_cols),
        "keyword_topics": keyword_topics(analysis, taxonomy),
        "keyword_totals": totals,
        "common_keywords": common,
        "merged_topics": merged_topics(totals, taxonomy, group_cols),
        "run_stats": run_stats(analysis, totals, common, group_cols, params),
        "prompts": gap_prompts(blocks, group_cols, params=params),
        "gap": keyword_gap(analysis, totals, stats, group_cols, params),
        "url_report": url_report(analysis, taxonomy, group_cols),
        "common_report": common_report(totals, stats, group_cols),
    }
