"""Sums of large numeric arrays over all partitions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from termloom.storage import materialize

SCHEMA = "total binary"


def _row(total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])


def sum_over_partitions(
    rows: DataFrame,
    partial: Callable[[Iterator[pa.RecordBatch]], np.ndarray],
    kind: type = np.float64,
    combine: np.ufunc = np.add,
) -> np.ndarray | None:
    """Add up (or ``combine``) ``partial`` of every partition; None if there is no partition.

    ``partial`` gives a flat array whose size does not depend on the data. The arrays are written to
    the shared folder, so nothing is shuffled; a task adds up those of one split of the files, and
    the driver reads one array per split, one after the other.
    """

    def of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _row(np.asarray(partial(batches), dtype=kind))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for item in batch.column(0):
                values = np.frombuffer(item.as_py(), dtype=kind)
                total = values.copy() if total is None else combine(total, values)
        if total is not None:
            yield _row(total)

    stored = materialize(rows.mapInArrow(of_partition, SCHEMA), "partial-sums")
    total = None
    for row in stored.mapInArrow(add, SCHEMA).toLocalIterator(prefetchPartitions=True):
        values = np.frombuffer(row.total, dtype=kind)
        total = values.copy() if total is None else combine(total, values)
    return total
