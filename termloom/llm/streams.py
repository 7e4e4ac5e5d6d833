"""Groups of sorted rows inside a task, without a call of Python for each small group."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa


def group_starts(rows: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Where each run of equal keys (integers without null) starts."""
    change = np.zeros(len(rows), dtype=bool)
    if len(rows):
        change[0] = True
    for key in keys:
        values = np.asarray(rows[key])
        change[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(change)


def complete_groups(
    keys: Sequence[str], work: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]]
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow`` over partitions sorted by ``keys``: pass on tables that hold whole groups only.

    ``work`` gets such a table and the starts of its groups. Only the last group of a batch waits
    for the next, so memory holds one batch and the largest group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.Table] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            starts = group_starts(table, keys)
            if waiting and any(waiting[-1][key][-1] != table[key][0] for key in keys):
                done = pa.concat_tables(waiting).combine_chunks()
                yield from work(done, group_starts(done, keys))
                waiting = []
            if len(starts) > 1:
                cut = int(starts[-1])
                done = pa.concat_tables([*waiting, table.slice(0, cut)]).combine_chunks()
                yield from work(done, group_starts(done, keys))
                waiting = [table.slice(cut)]
            else:
                waiting.append(table)
        if waiting:
            done = pa.concat_tables(waiting).combine_chunks()
            yield from work(done, group_starts(done, keys))

    return run
