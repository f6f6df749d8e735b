"""The whole way from instruction rows to a worker-striped, weighted training order."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.vectors import normalized
from granary.operators import grouping, ordering, selection, weights
from granary.operators.grouping import Grouping
from granary.operators.selection import Plan


@dataclass(frozen=True)
class Pipeline:
    grouping: Grouping
    plan: Plan = field(default_factory=Plan)
    mode: str = "interleaved"
    normalize: bool = True


def balanced_order(df: DataFrame, id: str, vector: str, p: Pipeline) -> tuple[DataFrame, DataFrame]:
    """(order, weights): (pos, id, group_no, slot, dist) and (group_no, n, rank_weight).

    With the rule "badge" groups have no capacity and the order is a shuffle of all rows.
    With fewer than two groups the order is by id and all weights are 1. Rows without a vector
    are in no group. What reaches the driver are the centers and one size per group.
    """
    rows = df.where(F.col(vector).isNotNull() & F.col(id).isNotNull()).select(id, (normalized(vector) if p.normalize else F.col(vector)).alias("features"))
    if p.grouping.k <= 1:
        single = ordering.in_id_order(rows.select(id), id).withColumn("group_no", F.lit(0)).withColumn("slot", F.col("pos") + 1).withColumn("dist", F.lit(0.0))
        return single, weights.rank_weights(weights.group_sizes(single, "group_no"), "group_no", False)
    greedy = p.plan.rule == "badge"
    groups = grouping.grouped(rows, id, "features", replace(p.grouping, trigger=math.inf) if greedy else p.grouping)
    kept = selection.selected(groups.join(rows, id) if greedy else groups, id, "group_no", "dist", p.plan, vector="features")
    order = ordering.ordered(kept, "group_no", "rand" if greedy else p.mode, id, p.plan.seed)
    return order.select("pos", id, "group_no", "slot", "dist"), weights.rank_weights(weights.group_sizes(groups, "group_no"), "group_no")


def uniform_order(groups: DataFrame, id: str, p: Pipeline) -> DataFrame:
    """The baseline: every group brought to the largest group's size, interleaved, all weights 1."""
    return ordering.ordered(selection.oversampled(groups, id, "group_no", p.plan), "group_no", p.mode, id, p.plan.seed)
