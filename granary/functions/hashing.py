"""Seeded orders: every random choice is the order of md5(seed:id), which any engine repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_key(seed: int | Column, id: Column | str, salt: str | Column = "") -> Column:
    part = F.lit(seed) if isinstance(seed, int) else seed
    return F.md5(F.concat_ws(":", part.cast("string"), F.lit(salt) if isinstance(salt, str) else salt.cast("string"), (F.col(id) if isinstance(id, str) else id).cast("string")))


def draw(seed: int, id: Column, n: Column) -> Column:
    """A number from 0 to n - 1 from the first 32 bits of the key."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), id.cast("string"))), 1, 8), 16, 10).cast("long") % n


def ranked(df: DataFrame, key: str, *ties: str, name: str = "pos") -> DataFrame:
    """``df`` with its rank from 0 in the order of a hash column and the ties.

    The order is cut by the first three hex digits of the key; the sizes of these 4096 ranges
    give each its first rank, so no task sorts more than one range.
    """
    cut = df.withColumn("_range", F.substring(key, 1, 3))
    sizes = cut.groupBy("_range").agg(F.count("*").alias("_n"))
    ahead = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_ahead"))
    order = Window.partitionBy("_range").orderBy(key, *ties)
    return cut.join(F.broadcast(ahead), "_range").withColumn(name, F.col("_ahead") + F.row_number().over(order) - 1).drop("_range", "_ahead")
