"""Report tables and their JSON files."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.operators.aggregate import common_lists
from termloom.operators.content import succeeded
from termloom.operators.topics import DEFAULT_TAXONOMY, Taxonomy, page_topics
from termloom.storage import materialize
from termloom.vocab import GAP_SECTIONS, PAGE_SECTION


def url_report(
    analysis: DataFrame, taxonomy: Taxonomy = DEFAULT_TAXONOMY, group_cols: Sequence[str] = ()
) -> DataFrame:
    """``(…group, ord, url, keyword_frequency_map, topic_clusters)`` of the successful pages.

    Map entries are in rank and topic order. A projection of the page rows.
    """
    scores = F.map_from_arrays(
        F.transform("keywords", lambda k: k["keyword"]), F.transform("keywords", lambda k: k["score"])
    )
    return (
        analysis.where(succeeded())
        .withColumn("_topics", page_topics(F.col("keywords"), taxonomy))
        .select(
            *group_cols,
            "ord",
            "url",
            scores.alias("keyword_frequency_map"),
            F.map_from_arrays(
                F.transform("_topics", lambda t: t["topic"]),
                F.transform("_topics", lambda t: t["keywords"]),
            ).alias("topic_clusters"),
        )
    )


def common_report(
    totals: DataFrame, stats: DataFrame, group_cols: Sequence[str] = ()
) -> DataFrame:
    """``(…group, common_keywords)``: one row per group; the list is bounded by the threshold rule."""
    lists = common_lists(totals, stats, group_cols)
    names = F.transform("common", lambda k: k["keyword"])
    if group_cols:
        return lists.select(*group_cols, names.alias("common_keywords"))
    # Without groups there is one row even if nothing is common.
    empty = F.array().cast("array<string>")
    found = lists.select(names.alias("k"))
    return found.agg(F.coalesce(F.first("k"), empty).alias("common_keywords"))


def gap_report(gap: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """``(…group, <one array per section>)`` from the gap rows that concern the group as a whole.

    Sections hold at most ``gap_items`` rows per group. Per-page rows (section ``PAGE_SECTION``) are as
    many as there are pages and stay rows; see ``write_gap``.
    """
    rows = gap.where(F.col("section").isin(*GAP_SECTIONS))

    def items(section: str):
        entry = F.when(F.col("section") == section, F.struct("rank", "item"))
        in_order = F.array_sort(F.collect_list(entry))
        return F.transform(in_order, lambda e: e["item"]).alias(section)

    return rows.groupBy(*group_cols).agg(*[items(s) for s in GAP_SECTIONS])


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines, UTF-8; replaces what is there and creates the folder."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_url_analysis(report: DataFrame, out_dir: str) -> None:
    """One line per page, files in page order."""
    write_json(report.orderBy("ord").drop("ord"), f"{out_dir}/url_analysis")


def write_common_keywords(
    report: DataFrame, merged: DataFrame, totals: DataFrame, out_dir: str, group_cols: Sequence[str] = ()
) -> None:
    """The common keywords, the merged topics in order, and the totals table.

    A topic may hold millions of keywords, so merged topics are written as sorted lines
    ``(topic, keyword, …)`` instead of one array.
    """
    write_json(report, f"{out_dir}/common_keywords")
    write_json(merged.orderBy(*group_cols, "topic_rank", "rank"), f"{out_dir}/topic_clusters")
    ordered = totals.orderBy(*group_cols, F.desc("total"), "first_ord", "first_rank")
    ordered.write.mode("overwrite").parquet(f"{out_dir}/keyword_totals")


def write_gap(gap: DataFrame, out_dir: str, group_cols: Sequence[str] = ()) -> None:
    """The sections as arrays, and the recommendations per page as lines. The gap is computed once."""
    stored = materialize(gap, "gap")
    write_json(gap_report(stored, group_cols), f"{out_dir}/gap_analysis")
    per_page = stored.where(F.col("section") == PAGE_SECTION)
    write_json(per_page.orderBy(*group_cols, "ord", "rank"), f"{out_dir}/ranking_recommendations")


MANIFEST = "current.json"


def _place(spark: SparkSession, path: str):
    """A path and its file system."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def report_folder(spark: SparkSession, out_dir: str) -> str | None:
    """The folder of the reports that stand in ``out_dir``, as the manifest says; None before the first run."""
    manifest, files = _place(spark, f"{out_dir}/{MANIFEST}")
    if not files.exists(manifest):
        return None
    text = spark.read.text(str(manifest.toString()), wholetext=True).first().value
    return f"{out_dir}/{json.loads(text)['run']}"


def _commit(spark: SparkSession, out_dir: str, run: str) -> None:
    """Let the manifest name ``run``: one small file, written aside and renamed over the old one."""
    jvm = spark._jvm
    target, files = _place(spark, f"{out_dir}/{MANIFEST}")
    written, _ = _place(spark, f"{out_dir}/_{uuid.uuid4().hex}.json")
    out = files.create(written, True)
    out.write(bytearray(json.dumps({"run": run}).encode()))
    out.close()
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    context.rename(files.makeQualified(written), files.makeQualified(target), overwrite)


def write_reports(
    tables: Mapping[str, DataFrame], out_dir: str, group_cols: Sequence[str] = ()
) -> str:
    """Write every report of a run (see ``plans.analysis.run_analysis``) and return their folder.

    The reports appear together: they are written to a folder of their own, and the manifest of ``out_dir``
    names it once all are there (see ``report_folder``). A run that fails leaves the old reports as they
    were, and removes its own. The reports of the run before the last are removed.
    """
    spark = tables["gap"].sparkSession
    run = f"runs/{uuid.uuid4().hex}"
    folder, before = f"{out_dir}/{run}", report_folder(spark, out_dir)

    def remove(path: str) -> None:
        place, files = _place(spark, path)
        files.delete(place, True)

    try:
        write_url_analysis(tables["url_report"], folder)
        write_common_keywords(
            tables["common_report"], tables["merged_topics"], tables["keyword_totals"], folder, group_cols
        )
        write_gap(tables["gap"], folder, group_cols)
        _commit(spark, out_dir, run)
    except BaseException:
        remove(folder)
        raise
    if before:
        remove(before)
    return folder
