"""Running sums over a global order, without gathering a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions.joins import join_on
from termloom.functions.ranking import sort_into_slices


def with_running_sums(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], sums: dict[str, str]
) -> DataFrame:
    """Add, for each ``new: value`` of ``sums``, the sum of ``value`` over the earlier rows of the group.

    Rows are cut by range into slices; each slice is summed on its own and shifted by what earlier
    slices hold of its group. Only the first group of a slice reaches back, so there are at most as
    many shifts as slices, which bounds their broadcast. Rows that tie in ``order`` get some order.
    """
    sliced = sort_into_slices(df, group, order)
    earlier = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    per_slice = sliced.groupBy(*group, "_slice").agg(
        *[F.sum(value).alias(f"_sum_{new}") for new, value in sums.items()]
    )
    shifts = per_slice.select(
        *group,
        "_slice",
        F.min("_slice").over(Window.partitionBy(*group)).alias("_first"),
        *[F.sum(f"_sum_{new}").over(earlier).alias(f"_shift_{new}") for new in sums],
    ).where("_slice > _first")
    within = (
        Window.partitionBy(*group, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    zero = F.lit(0)
    summed = sliced.withColumns({new: F.sum(value).over(within) for new, value in sums.items()})
    shifted = join_on(summed, F.broadcast(shifts.drop("_first")), [*group, "_slice"])
    return shifted.withColumns(
        {new: F.coalesce(new, zero) + F.coalesce(f"_shift_{new}", zero) for new in sums}
    ).drop("_slice", *[f"_shift_{new}" for new in sums])
