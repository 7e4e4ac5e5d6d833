"""Every registered query against its SQL, on the smallest tables."""

import re

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check_queries import compare
from termloom.plans.catalog import QUERIES

TABLES = "/root/testdata/sf0.001"


def test_every_query_has_sql():
    assert set(QUERIES) <= set(oracle_sql())
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["ord", "url", "keyword", "n", "score", "rank", "first_pos"]
    assert not df.isEmpty()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, name):
    good, note = compare(spark, TABLES, name)
    assert good, note


@pytest.mark.parametrize(
    "name",
    ["common_keywords", "common_by_lang", "common_report", "gap_common", "gap_underutilized", "gap_long_tail",
     "gap_recommendations", "prompt_blocks", "gap_prompt", "gap_semantic", "gap_missing"],
)
def test_texts_are_read_once(spark, name):
    """The texts were read for the stored page table; the query itself reads that table only."""
    plan = QUERIES[name](spark, TABLES)._jdf.queryExecution().executedPlan().toString()
    assert "/documents.parquet" not in plan


def test_pages_meet_the_lists_of_their_group_without_an_exchange(spark):
    """The lists of common keywords are small and of known size, so pages are not gathered by lang."""
    plan = QUERIES["gap_semantic_by_lang"](spark, TABLES)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(coalesce\(lang#\d+, \), isnull\(lang#\d+\), \d+\)", plan)
