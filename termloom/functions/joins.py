"""Joins on group columns, in which a null group is a group like any other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join on ``keys``, nulls equal; the result has the columns of ``left``, then the rest."""
    renamed = right.withColumnsRenamed({key: f"_right_{key}" for key in keys})
    match = None
    for key in keys:
        same = F.col(key).eqNullSafe(F.col(f"_right_{key}"))
        match = same if match is None else match & same
    return left.join(renamed, match, how).drop(*[f"_right_{key}" for key in keys])


def join_to_groups(
    rows: DataFrame, groups: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """Put the columns of ``groups``, one row per group, beside every row of the group.

    A group may hold a third of all rows. The join is left to adaptive execution, which knows the
    sizes: it broadcasts ``groups`` if they are small, and otherwise splits the rows of a partition that
    is much larger than the others, each part with the group's one row. No cold group is copied.
    """
    return join_on(rows, groups, keys)
