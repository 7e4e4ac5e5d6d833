"""Keyword extraction and keyword-gap analysis on Spark."""

from termloom.operators.aggregate import (
    common_keywords,
    keyword_totals,
    page_counters,
    page_stats,
    run_stats,
)
from termloom.operators.content import extract_text, gate_content
from termloom.operators.gap import (
    gap_common,
    gap_long_tail,
    gap_missing,
    gap_recommendations,
    gap_semantic,
    gap_underutilized,
    keyword_gap,
)
from termloom.operators.keywords import analyze_pages, extract_keywords, keywords
from termloom.operators.prompts import gap_prompts, page_blocks, parse_gap_responses, response_items
from termloom.operators.topics import (
    Taxonomy,
    assign_topics,
    assign_topics_by_table,
    keyword_topics,
    merged_topics,
)
from termloom.params import Params
from termloom.plans.analysis import analyze_url_list, run_analysis
from termloom.session import ship_package
from termloom.sinks.reports import common_report, gap_report, url_report, write_reports
from termloom.sources.crawl import resolve_crawl
from termloom.sources.pages import (
    look_up_pages,
    read_documents,
    read_html_files,
    read_page_table,
)
from termloom.sources.urls import read_urls
from termloom.storage import working_tables

__all__ = [
    "Params",
    "Taxonomy",
    "analyze_pages",
    "analyze_url_list",
    "assign_topics",
    "assign_topics_by_table",
    "common_keywords",
    "common_report",
    "extract_keywords",
    "extract_text",
    "gap_common",
    "gap_long_tail",
    "gap_missing",
    "gap_recommendations",
    "gap_prompts",
    "gap_report",
    "gap_semantic",
    "gap_underutilized",
    "gate_content",
    "keyword_gap",
    "keyword_topics",
    "keyword_totals",
    "keywords",
    "look_up_pages",
    "merged_topics",
    "page_blocks",
    "page_counters",
    "page_stats",
    "parse_gap_responses",
    "read_documents",
    "read_html_files",
    "read_page_table",
    "read_urls",
    "resolve_crawl",
    "response_items",
    "run_analysis",
    "run_stats",
    "ship_package",
    "url_report",
    "working_tables",
    "write_reports",
]
