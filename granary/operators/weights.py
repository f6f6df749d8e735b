"""Sizes of groups and the weights that undo a balanced selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MODES = ("inv", "sqrt_inv", "prop", "none")


def group_sizes(df: DataFrame, group: str) -> DataFrame:
    """(group, n, share, size_ratio): size, share of all and multiple of the smallest group; one row per group."""
    counts = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n"))
    everything = Window.partitionBy()  # over one row per group
    return counts.withColumn("share", F.col("n") / F.sum("n").over(everything)).withColumn("size_ratio", F.col("n") / F.min("n").over(everything))


def rank_weights(sizes: DataFrame, group: str, weighted: bool = True) -> DataFrame:
    """(group, n, rank_weight): K * n / N, so that their mean is 1; all 1 when not weighted."""
    everything = Window.partitionBy()
    value = F.count("*").over(everything) * F.col("n") / F.sum("n").over(everything) if weighted else F.lit(1.0)
    return sizes.select(group, "n", value.alias("rank_weight"))


def mode_weight(share: Column, mode: str) -> Column:
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    return {"inv": 1 / share, "sqrt_inv": 1 / F.sqrt(share), "prop": share, "none": F.lit(1.0)}[mode]


def row_weights(selected: DataFrame, sizes: DataFrame, group: str, mode: str, rule: str | None = None) -> DataFrame:
    """``selected`` with ``row_weight``: the weight of its group, divided by the mean over the selected rows (with multiplicity).

    Under the selection rule "none" every row weighs 1, whatever the mode.
    """
    by_group = sizes.select(group, mode_weight(F.col("share"), "none" if rule == "none" else mode).alias("_w"))
    weighted = selected.join(by_group, group)
    mean = weighted.agg(F.avg("_w")).first()[0]
    return weighted.withColumn("row_weight", F.col("_w") / F.lit(mean)).drop("_w")
