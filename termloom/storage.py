"""Durable intermediate tables.

A step that reads one expensive frame several times, or that must see the very same row numbers
twice, writes it to shared storage first. The copy outlives any executor. ``working_tables`` names the
folder and removes what a run has written there.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
_FOLDER: ContextVar[str | None] = ContextVar("termloom_folder", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the session names; a private one only in local mode with nothing set."""
    named = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="termloom-")
    spark.sparkContext.setCheckpointDir(made)
    return made


@contextmanager
def working_tables(spark: SparkSession, folder: str | None = None) -> Iterator[str]:
    """Intermediate tables of the block go to a new folder under ``folder``, which is removed at its end.

    ``folder`` is the session's shared folder if it is not given. Use or write the results inside the block:
    frames that read the tables are of no use after it.
    """
    path = f"{(folder or shared_dir(spark)).rstrip('/')}/run-{uuid.uuid4().hex}"
    before = _FOLDER.set(path)
    try:
        yield path
    finally:
        _FOLDER.reset(before)
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def tables_folder(spark: SparkSession) -> str:
    """Where ``materialize`` writes at this point."""
    return (_FOLDER.get() or shared_dir(spark)).rstrip("/")


def materialize(df: DataFrame, label: str, folder: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder (or ``folder``) and return the table read back."""
    spark = df.sparkSession
    path = f"{folder or tables_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
