"""Places in orders of any size: no group and no order is one task.

Rows are dealt to range partitions of the whole order and sorted there; the sizes of the
partitions, one row each, say what lies ahead of each of them. Ties of the leading columns do
no harm as long as the order ends with a column that tells rows apart: ranges are cut between
whole sort keys, so that a value or a group that holds most rows is spread over many ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.session import cut, shuffle_width

#: Bits of monotonically_increasing_id() that number the rows of a partition.
ROW_BITS = 33


def positions(df: DataFrame, *order: Column | str, name: str = "pos") -> DataFrame:
    """``df`` with its place from 0 in the order.

    The sorted rows are written once to the checkpoint folder, so that their places do not
    change when an executor is lost; what is broadcast is one number per partition.
    """
    ranged = df.repartitionByRange(shuffle_width(df.sparkSession), *order).sortWithinPartitions(*order)
    held = cut(ranged.withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", ROW_BITS))
    sizes = held.groupBy("_part").agg(F.count("*").alias("_rows"))
    ahead = sizes.select("_part", (F.sum("_rows").over(Window.orderBy("_part")) - F.col("_rows")).alias("_ahead"))
    place = F.col("_ahead") + F.col("_at").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return held.join(F.broadcast(ahead), "_part").withColumn(name, place.cast("long")).drop("_part", "_at", "_ahead")


def in_groups(df: DataFrame, group: str, *order: Column | str, name: str = "_rank") -> DataFrame:
    """``df`` with its rank from 1 in its group, and ``_n``, the size of the group. Rows without a group are one group."""
    placed = positions(df, group, *order, name="_place")
    groups = placed.groupBy(group).agg(F.min("_place").alias("_first"), F.count("*").alias("_n")).withColumnRenamed(group, "_group")
    return placed.join(groups, F.col(group).eqNullSafe(F.col("_group"))).withColumn(name, F.col("_place") - F.col("_first") + 1).drop("_group", "_place", "_first")
