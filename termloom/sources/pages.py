"""Tables and files of crawled pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions.charset import decoded
from termloom.functions.membership import keep_possible_members
from termloom.functions.partitioning import spread_scan
from termloom.sources.crawl import NO_RESPONSE_ERROR


def read_page_table(spark: SparkSession, path: str, key: str = "page_id") -> DataFrame:
    """``(ord, url, html)`` from a Parquet table of pages."""
    scan = spark.read.parquet(path).select(F.col(key).alias("ord"), "url", "html")
    return spread_scan(scan, "ord")


def read_html_files(spark: SparkSession, path: str) -> DataFrame:
    """``(url, html)`` from a folder with one page per file; the file path stands for the URL.

    Files may have any encoding of the web (see ``decode_page``). Spark passes over empty files.
    """
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("_metadata.file_path").alias("url"), decoded(F.col("content")).alias("html"))


def read_documents(spark: SparkSession, path: str, *extra: str) -> DataFrame:
    """``(ord, url, text, size_hint, …)`` from a Parquet table of plain texts."""
    scan = spark.read.parquet(path).select(
        F.col("doc_id").alias("ord"), "text", F.col("n_chars").alias("size_hint"), *extra
    )
    url = F.concat(F.lit("doc:"), F.col("ord").cast("string")).alias("url")
    return spread_scan(scan, "ord").select("ord", url, "text", "size_hint", *extra)


def _ordered(pages: DataFrame) -> DataFrame:
    order = F.col("ord") if "ord" in pages.columns else F.xxhash64(*pages.columns)
    return pages.withColumn("_order", order)


def one_page_per_url(pages: DataFrame) -> DataFrame:
    """Of a URL that was crawled more than once keep the page with the largest ``ord``, the last crawled.

    Without a column ``ord`` the page with the largest hash of its columns stays. Only URLs and that one
    number are grouped; a URL with a single page passes unchanged.
    """
    ranked = _ordered(pages)
    last = ranked.groupBy("url").agg(F.max("_order").alias("_order"))
    return ranked.join(last, ["url", "_order"], "left_semi").drop("_order")


def listed_pages(urls: DataFrame, pages: DataFrame) -> DataFrame:
    """``one_page_per_url`` of the pages that the list names.

    URLs and orders alone find the pages to use; what they are is then known to the scan of the pages, which
    passes on hardly any other. So the HTML of pages that are not listed, or crawled again, does not move.
    """
    ranked = _ordered(pages)
    listed = urls.select("url").distinct()
    named = keep_possible_members(ranked.select("url", "_order"), listed, ["url"]).join(listed, "url", "left_semi")
    last = named.groupBy("url").agg(F.max("_order").alias("_order"))
    keys = ["url", "_order"]
    return keep_possible_members(ranked, last, keys).join(last, keys, "left_semi").drop("_order")


def look_up_pages(urls: DataFrame, pages: DataFrame) -> DataFrame:
    """Every listed URL with the columns of its page, and an ``error`` where there is no page.

    ``pages`` are raw pages, or pages already analysed; of a URL with several one is used (see
    ``one_page_per_url``). A URL may be listed many times; the join is left to Spark, whose adaptive
    execution splits a hot URL on the list side.
    """
    pages = one_page_per_url(pages)
    values = [c for c in pages.columns if c not in ("ord", "url", "error")]
    before = F.col("error") if "error" in pages.columns else F.lit(None).cast("string")
    crawled = pages.select("url", *values, before.alias("_error"), F.lit(True).alias("_crawled"))
    missing = F.concat(F.lit(NO_RESPONSE_ERROR), F.col("url"))
    return urls.join(crawled, "url", "left").select(
        *urls.columns,
        *values,
        F.when(F.col("_crawled").isNull(), missing).otherwise(F.col("_error")).alias("error"),
    )
