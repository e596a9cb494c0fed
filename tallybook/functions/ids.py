"""Row numbers without gaps that no single task gives out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallybook.session import cut_lineage

C, L = F.col, F.lit


def with_dense_ids(rows: DataFrame, name: str, keys: list[str], first: int = 1) -> DataFrame:
    """Rows with `name`: first, first + 1, ... in the order of `keys`, nulls first.

    A row's id is its rank, so it is equal on every evaluation if the keys tell rows apart (rows
    equal in all keys share out their ranks in any way). Rows are dealt by ranges of the keys and
    sorted within them; a range's offset is the number of rows in the ranges before it, summed over
    one row per range.
    """
    position = F.monotonically_increasing_id().bitwiseAND(L((1 << 33) - 1))
    dealt = cut_lineage(rows.repartitionByRange(*[C(k).asc_nulls_first() for k in keys])
                        .sortWithinPartitions(*[C(k).asc_nulls_first() for k in keys])
                        .withColumn("_range", F.spark_partition_id())
                        .withColumn("_position", position))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("_range").agg(F.count(L(1)).alias("_n")).select(
        "_range", F.coalesce(F.sum("_n").over(before), L(0)).alias("_offset"))
    return dealt.join(offsets, "_range").select(
        (C("_offset") + C("_position") + L(first)).alias(name), *rows.columns)
