"""Balanced selection: equally many rows of each group, by distance, norm or chance.

Groups may be of any size, also one that holds most rows: ranks come from range partitions of
the order by group and value.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions import ranks
from granary.functions.hashing import draw, order_key
from granary.functions.vectors import RANK_DECIMALS, dot, squared_distance
from granary.session import cut

#: What a rule throws away names it: "far" keeps the nearest rows.
RULES = ("far", "close", "mix", "rand", "big", "none", "badge")


@dataclass(frozen=True)
class Plan:
    """How many rows of each group are kept: the smallest size, scaled by ``ratio`` percent, in whole multiples of ``micro``."""

    rule: str = "close"
    ratio: int = 100
    micro: int = 1
    drop_last: bool = False
    seed: int = 42

    def keep(self, least: int) -> int:
        part = least * self.ratio // 100
        return part // self.micro * self.micro if self.drop_last else part


def smallest(df: DataFrame, group: str) -> int:
    """Size of the smallest group: one number from one row per group."""
    row = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n")).agg(F.min("n").alias("m")).first()
    return int(row["m"] or 0) if row else 0


def selected(df: DataFrame, id: str, group: str, distance: str, plan: Plan, norm: str | None = None, vector: str | None = None) -> DataFrame:
    """Rows of ``df`` that the plan keeps, with ``slot``: their shuffled place from 1 inside the group.

    The rule "badge" keeps the rows that the greedy k-center choice over ``vector`` takes.

    Rows without a group, a distance or an id are left out. Ties are broken by id. Where the
    plan keeps no row (a low ratio, a large ``micro``) the result is empty for every rule.
    """
    if plan.rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    rows = df.where(F.col(id).isNotNull() & F.col(group).isNotNull() & F.col(distance).isNotNull())
    keep = None if plan.rule == "none" else plan.keep(smallest(rows, group))
    if plan.rule == "badge":
        if vector is None:
            raise ValueError("the rule badge needs a vector")
        taken = farthest_first(rows, id, group, vector, keep)
        return slotted(rows.join(taken.select(id, group), [id, group], "left_semi"), id, group, plan.seed)
    return slotted(pruned(rows, id, group, distance, plan, keep, norm), id, group, plan.seed)


def pruned(rows: DataFrame, id: str, group: str, distance: str, plan: Plan, keep: int | None, norm: str | None) -> DataFrame:
    """The rows that the rule keeps."""
    if keep is None:
        return rows
    near = F.round(distance, RANK_DECIMALS)
    if plan.rule == "rand":
        valued, order = rows.withColumn("_value", order_key(plan.seed, id, F.col(group))), ["_value", id]
    else:
        valued, order = rows.withColumn("_value", F.round(norm or distance, RANK_DECIMALS) if plan.rule == "big" else near), ["_value", near, id]
    head = {"far": keep, "rand": keep, "mix": keep // 2}.get(plan.rule, 0)
    tail = 0 if plan.rule in ("far", "rand") else keep - head
    ranked = ranks.in_groups(valued, group, *order)
    return ranked.where((F.col("_rank") <= head) | (F.col("_rank") > F.col("_n") - tail)).select(*rows.columns)


def slotted(df: DataFrame, id: str, group: str, seed: int) -> DataFrame:
    """``df`` with ``slot``: the rank from 1 in a shuffle inside each group, seeded with seed + group."""
    keyed = df.withColumn("_key", order_key(F.lit(seed) + F.col(group), id))
    return ranks.in_groups(keyed, group, "_key", id, name="slot").select(*df.columns, "slot")


def oversampled(df: DataFrame, id: str, group: str, plan: Plan) -> DataFrame:
    """(id, group, slot, copy): every group brought to the size of the largest by drawing rows again.

    Slots up to the group's size are its rows in shuffled order; further ones draw a row by
    hash. ``ratio`` has no effect; with ``drop_last`` the target is a whole multiple of
    ``micro``. The draws explode one row per group in ranges, so no group is one task.
    """
    rows = slotted(df.where(F.col(id).isNotNull() & F.col(group).isNotNull()).select(id, group), id, group, plan.seed)
    sizes = rows.groupBy(group).agg(F.count("*").alias("n"))
    most = int(sizes.agg(F.max("n")).first()[0] or 0)
    target = most // plan.micro * plan.micro if plan.drop_last else most
    span = 1 << 16
    starts = sizes.where(F.col("n") < target).withColumn("_from", F.explode(F.sequence((F.col("n") / span).cast("long"), F.lit(target // span).cast("long"))))
    extra = starts.select(group, "n", F.explode(F.sequence(F.greatest(F.col("_from") * span + 1, F.col("n") + 1), F.greatest(F.least((F.col("_from") + 1) * span, F.lit(target)), F.col("_from") * span + 1))).alias("slot")).where((F.col("slot") > F.col("n")) & (F.col("slot") <= target))
    base = F.concat_ws(":", F.col(group).cast("string"), F.col("slot").cast("string"))
    drawn = extra.withColumn("_slot", draw(plan.seed, base, F.col("n")) + 1)
    again = drawn.join(rows.withColumnRenamed("slot", "_slot"), [group, "_slot"]).select(id, group, F.col("slot").cast("long"), F.lit(True).alias("copy"))
    return rows.where(F.col("slot") <= target).select(id, group, "slot", F.lit(False).alias("copy")).unionByName(again)


def farthest_first(df: DataFrame, id: str, group: str, vector: str, keep: int, most: int = 200_000) -> DataFrame:
    """(id, group, step): ``keep`` rows of each group by k-center greedy: the longest vector, then always the farthest from those taken.

    The method is sequential. Groups of up to ``most`` rows are one task each; larger ones are
    worked on where their rows lie, with one pass over them for each step, and give the same
    rows. Ties go to the lower id, and no row is taken twice. Rows without an id, a group or a
    vector are left out.
    """
    held = df.where(F.col(id).isNotNull() & F.col(group).isNotNull() & F.col(vector).isNotNull()).select(id, group, vector)
    kinds = dict(df.dtypes)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(id, kind="stable").reset_index(drop=True)
        x = np.stack(rows[vector].to_numpy()).astype(np.float64)
        least = np.full(len(x), np.inf)
        free = np.ones(len(x), dtype=bool)
        taken: list[int] = []
        score = np.round((x * x).sum(axis=1), RANK_DECIMALS)
        for _ in range(min(keep, len(x))):
            k = int(np.argmax(np.where(free, score, -np.inf)))
            taken.append(k)
            free[k] = False
            least = np.minimum(least, ((x - x[k]) ** 2).sum(axis=1))
            score = np.round(least, RANK_DECIMALS)
        return pd.DataFrame({id: rows[id].iloc[taken].to_numpy(), group: rows[group].iloc[taken].to_numpy(), "step": np.arange(1, len(taken) + 1, dtype=np.int64)})

    schema = f"`{id}` {kinds[id]}, `{group}` {kinds[group]}, step long"
    large = cut(held.groupBy(group).agg(F.count("*").alias("_n")).where(F.col("_n") > most).select(group))
    if large.isEmpty():
        return held.groupBy(group).applyInPandas(run, schema)
    small = held.join(large, group, "left_anti").groupBy(group).applyInPandas(run, schema)
    return small.unionByName(farthest_in_place(held.join(large, group, "left_semi"), id, group, vector, keep))


def farthest_in_place(held: DataFrame, id: str, group: str, vector: str, keep: int) -> DataFrame:
    """The same for groups of any size: a step finds the farthest free row of each group and brings it to the rows of its group."""
    rows = cut(held.withColumn("_least", F.lit(float("inf"))).withColumn("_score", F.round(dot(vector, vector), RANK_DECIMALS)).withColumn("_free", F.lit(True)))
    chosen = []
    for step in range(1, keep + 1):
        best = F.max_by(F.struct(F.col(id).alias("_id"), F.col(vector).alias("_v")), F.struct(F.col("_score"), -F.col(id)))
        picks = cut(rows.where("_free").groupBy(group).agg(best.alias("_p")).select(group, "_p.*"))
        if picks.isEmpty():
            break
        chosen.append(picks.select(F.col("_id").alias(id), group, F.lit(step).cast("long").alias("step")))
        near = F.least("_least", squared_distance(vector, "_v"))
        rows = rows.join(picks, group, "left").select(id, group, vector, F.coalesce(near, "_least").alias("_least"), (F.col("_free") & ~F.coalesce(F.col("_id") == F.col(id), F.lit(False))).alias("_free"))
        rows = cut(rows.withColumn("_score", F.round("_least", RANK_DECIMALS)))
    return reduce(DataFrame.unionByName, chosen)


def diagnostics(df: DataFrame, group: str, plan: Plan) -> DataFrame:
    """One row: groups, rows, smallest group, kept rows, pruned rows; with the rule "none" all rows are kept."""
    sizes = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n"))
    part = F.floor(F.min("n") * plan.ratio / 100)
    keep = F.floor(part / plan.micro) * plan.micro if plan.drop_last else part
    kept = F.sum("n") if plan.rule == "none" else F.count("*") * keep
    return sizes.agg(
        F.count("*").alias("n_groups"), F.sum("n").alias("n_rows"), F.min("n").alias("smallest"), F.max("n").alias("largest"), keep.cast("long").alias("per_group"), kept.cast("long").alias("kept"), (F.sum("n") - kept).cast("long").alias("pruned")
    )
