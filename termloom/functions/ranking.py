"""Exact row numbers without gathering a group in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions.joins import join_on
from termloom.storage import materialize


# Into how many slices a histogram cuts a range of keys.
_SLICES = 4096


def sort_into_slices(df: DataFrame, group: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Range-partition on group *and* order, so that one hot group spreads over many tasks.

    ``_slice`` numbers the partitions. The rows are written to shared storage: slices computed a
    second time, after a lost executor say, could be cut elsewhere.
    """
    sort = [F.col(c).asc() for c in group] + list(order)
    cut = df.repartitionByRange(*sort).sortWithinPartitions(*sort)
    return materialize(cut.withColumn("_slice", F.spark_partition_id()), "slices")


def number_slices(
    sliced: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    name: str,
    kind: str = "int",
    sums: Mapping[str, str] | None = None,
) -> DataFrame:
    """Replace ``_slice`` by ``name`` = 1, 2, … per group, and add running sums.

    For each ``new: value`` of ``sums`` the column ``new`` is the sum of ``value`` over the earlier rows of the
    group. A slice is numbered on its own and shifted by the rows of its group in earlier slices. Only the
    first group of a slice can reach back, so there are at most as many shifts as slices: that
    bounds the broadcast, and with it the running sums.
    """
    sums = sums or {}
    earlier = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        sliced.groupBy(*group, "_slice")
        .agg(F.count(F.lit(1)).alias("_rows"), *[F.sum(value).alias(f"_sum_{new}") for new, value in sums.items()])
        .select(
            *group,
            "_slice",
            F.sum("_rows").over(earlier).alias("_shift"),
            *[F.sum(f"_sum_{new}").over(earlier).alias(f"_shift_{new}") for new in sums],
        )
        .where(F.col("_shift") > 0)
    )
    within = Window.partitionBy(*group, "_slice").orderBy(*order)
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    places = {"_place": F.row_number().over(within)} | {new: F.sum(value).over(before) for new, value in sums.items()}
    shifted = join_on(sliced.withColumns(places), F.broadcast(shifts), [*group, "_slice"])
    zero = F.lit(0)
    done = {name: (F.col("_place") + F.coalesce("_shift", zero)).cast(kind)} | {
        new: F.coalesce(new, zero) + F.coalesce(f"_shift_{new}", zero) for new in sums
    }
    return shifted.withColumns(done).drop("_slice", "_place", "_shift", *[f"_shift_{new}" for new in sums])


def with_rank(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str, kind: str = "int"
) -> DataFrame:
    """Number the rows of each group in ``order``, which must be unique within the group."""
    return number_slices(sort_into_slices(df, group, order), group, order, name, kind)


def smallest(df: DataFrame, key: str, count: int, ties: Sequence[str] = ()) -> DataFrame:
    """The ``count`` rows with the smallest ``key`` (bigint, not null), without sorting or storing the rows.

    Histograms of the key close in on the last key that is taken: each counts the rows in slices of the
    range in which it must lie, until a slice is a single key. From then on it is a filter, which reaches
    the scan. Rows that tie at that key are taken in the order of ``ties``, in full if all fit.
    """
    values = df.select(F.col(key).alias("_key"))
    low, high, rows = values.agg(F.min("_key"), F.max("_key"), F.count("_key")).first()
    if not rows or rows <= count:
        return df.where(F.col(key).isNotNull())
    wanted = count  # of the rows from ``low`` on
    while low < high:
        width = (high - low) // _SLICES + 1
        # Decimals, since the range of keys may pass 64 bits.
        wide = F.col("_key").cast("decimal(20,0)") - F.lit(low).cast("decimal(20,0)")
        place = F.call_function("div", wide, F.lit(width).cast("decimal(20,0)"))
        inside = values.where(F.col("_key").between(low, high))
        sizes = inside.groupBy(place.alias("slice")).agg(F.count(F.lit(1)).alias("rows")).orderBy("slice")
        for part in sizes.collect():  # no more than _SLICES rows
            if part.rows >= wanted:
                break
            wanted -= part.rows
        low, high = low + part.slice * width, min(high, low + (part.slice + 1) * width - 1)
    tied = values.where(F.col("_key") == low).count()
    if tied == wanted:
        return df.where(F.col(key) <= low)
    last = df.where(F.col(key) == low).orderBy(*ties).limit(wanted)
    return df.where(F.col(key) < low).unionByName(last)
