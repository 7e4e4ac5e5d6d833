"""Early tests of membership: drop most rows that a later exact join would drop, before they move."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Bits of one bitmap of Spark's bitmap functions, as a power of two: 4 KB.
_BITMAP = 15


def mark_possible_members(
    rows: DataFrame, members: DataFrame, keys: Sequence[str], name: str, bits: int = 27
) -> DataFrame:
    """Add ``name``: whether a row's ``keys`` may occur in ``members``. It is true for all that do occur.

    The hashes of the members set bits of a filter of 2^``bits`` bits. It is broadcast in bitmaps of 4 KB, so
    its size is at most 16 MB as it stands, however many members there are; they only decide how many others
    are marked: a share of members / 2^bits, all in the limit. The test is part of the scan's stage.
    """
    place = F.xxhash64(*keys).bitwiseAND(F.lit((1 << bits) - 1))
    number, bit = F.shiftright(place, _BITMAP), place.bitwiseAND(F.lit((1 << _BITMAP) - 1))
    bitmaps = (
        members.select(number.alias("_map"), bit.alias("_bit"))
        .groupBy("_map")
        .agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    )
    found = rows.withColumns({"_map": number, "_bit": bit}).join(F.broadcast(bitmaps), "_map", "left")
    byte = F.conv(F.hex(F.expr("substring(_bits, cast(shiftright(_bit, 3) as int) + 1, 1)")), 16, 10).cast("int")
    of_byte = F.expr("cast(shiftleft(1, cast(_bit & 7 as int)) as int)")
    is_set = F.coalesce(byte.bitwiseAND(of_byte) != 0, F.lit(False))
    return found.withColumn(name, is_set).drop("_map", "_bit", "_bits")


def keep_possible_members(rows: DataFrame, members: DataFrame, keys: Sequence[str], bits: int = 27) -> DataFrame:
    """The ``rows`` whose ``keys`` may occur in ``members`` (see ``mark_possible_members``)."""
    return mark_possible_members(rows, members, keys, "_possible", bits).where("_possible").drop("_possible")
