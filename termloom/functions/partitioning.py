"""Use of all cores on files that Spark cannot split."""

from __future__ import annotations

from pyspark.sql import DataFrame

# A session setting for local runs over small files of one row group: into how many tasks page rows
# are dealt after the scan. It is not set on a cluster, where a table has splits enough, and then no
# text is shuffled.
SPREAD_KEY = "spark.termloom.spreadTasks"


def spread_scan(scan: DataFrame, key: str) -> DataFrame:
    """Deal the rows of a scan out as ``SPREAD_KEY`` says; unset, the scan stays as it is."""
    tasks = int(scan.sparkSession.conf.get(SPREAD_KEY, "0"))
    return scan.repartition(tasks, key) if tasks else scan
