"""URL lists from CSV files."""

from __future__ import annotations

import csv
from functools import reduce

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

from termloom.functions.ranking import smallest, with_rank
from termloom.params import DEFAULT_PARAMS, Params


def _csv(spark: SparkSession, multi_line: bool) -> DataFrameReader:
    return (
        spark.read.option("header", True)
        .option("multiLine", multi_line)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", True)
        .option("ignoreTrailingWhiteSpace", True)
        .option("mode", "FAILFAST")
        # Every field is parsed, so a row with too few fields fails even if its URL is present.
        .option("columnPruning", False)
    )


def _files_by_header(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """The files of ``path`` by their first line, since each file may order its columns its own way."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("place"),
        "value",
    )
    heads = lines.where(F.trim("value") != "").groupBy("file").agg(F.min_by("value", "place").alias("head"))
    found: dict[str, list[str]] = {}
    for row in heads.orderBy("file").collect():
        found.setdefault(row.head, []).append(row.file)
    return found


def _listed(spark: SparkSession, header: str, files: list[str], multi_line: bool) -> DataFrame:
    names = [name.strip() for name in next(csv.reader([header.lstrip("\ufeff")]))]
    columns = [f"c{i}" for i in range(len(names))]
    raw = _csv(spark, multi_line).schema(", ".join(f"{c} string" for c in columns)).csv(files)
    upper, lower = (
        F.col(columns[names.index(n)]) if n in names else F.lit(None).cast("string")
        for n in ("URL", "url")
    )
    return raw.select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"),
        choose_urls(upper, lower).alias("url"),
    )


def choose_urls(upper: Column, lower: Column) -> Column:
    """``URL`` unless it is empty, then ``url``, then the empty text."""
    return F.coalesce(F.nullif(upper, F.lit("")), F.nullif(lower, F.lit("")), F.lit(""))


def keep_http(urls: DataFrame) -> DataFrame:
    return urls.where(F.col("url").startswith("http"))


def first_urls(urls: DataFrame, params: Params = DEFAULT_PARAMS) -> DataFrame:
    """The first ``max_urls`` in list order; 0 keeps all. Equal places are taken by URL."""
    return smallest(urls, "ord", params.max_urls, ["url"]) if params.max_urls else urls


def read_urls(
    spark: SparkSession,
    path: str,
    params: Params = DEFAULT_PARAMS,
    multi_line: bool = True,
    require: bool = True,
) -> DataFrame:
    """``urls(ord, url)`` from a CSV file with a header, or from a folder of such files.

    Each file's own header tells its columns; files with the same header are read together.
    ``ord`` is the place in the list (file path, then position). ``multi_line`` allows quoted line
    breaks but reads a file in one task; pass False for very large files without them, which Spark
    then splits. A missing path or a malformed row is an error, and so is an empty list unless
    ``require`` is False.
    """
    parts = [_listed(spark, head, files, multi_line) for head, files in _files_by_header(spark, path).items()]
    if not parts:
        raise ValueError(f"no header in {path}")
    listed = reduce(DataFrame.unionByName, parts)
    found = keep_http(listed)
    numbered = with_rank(found, [], [F.col("_file"), F.col("_block"), F.col("_line")], "ord", "bigint")
    urls = numbered.select((F.col("ord") - 1).alias("ord"), "url")
    if params.max_urls:
        urls = urls.where(F.col("ord") < params.max_urls)  # the places have no gaps
    if require and urls.isEmpty():
        raise ValueError(f"no URLs found in {path}")
    return urls
