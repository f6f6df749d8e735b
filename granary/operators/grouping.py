"""Groups of feature vectors: k-means, nearest centers, and assignment under a capacity."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from granary.functions import ranks
from granary.functions.vectors import RANK_DECIMALS, doubles, squared_distance
from granary.session import cut

#: Numbers of all centers up to which the distances are plain expressions.
EXPRESSION_NUMBERS = 2048


@dataclass(frozen=True)
class Grouping:
    """k groups by the best of ``tries`` k-means runs; groups above ``trigger`` times the mean size are assigned again under a capacity."""

    k: int
    seed: int = 42
    tries: int = 3
    max_iter: int = 50
    eps: float = 0.5
    nearest: int = 8
    trigger: float = 1.5


def fit_centers(df: DataFrame, vector: str, g: Grouping) -> list[list[float]]:
    """Centers of the run with the least cost; k vectors are all that reaches the driver."""
    points = df.where(F.col(vector).isNotNull()).select(array_to_vector(doubles(vector)).alias("features")).persist()
    best = None
    for attempt in range(g.tries):
        model = KMeans(k=g.k, seed=g.seed + 1000 * attempt, maxIter=g.max_iter, featuresCol="features").fit(points)
        if best is None or model.summary.trainingCost < best.summary.trainingCost:
            best = model
    points.unpersist()
    return [[float(x) for x in c] for c in best.clusterCenters()]


def distances(vector: str, centers: list[list[float]]):
    """Array of struct(dist, group_no) to each center, nearest first; distances rounded before they rank."""
    each = [F.struct(F.round(squared_distance(vector, F.array(*[F.lit(x) for x in c])), RANK_DECIMALS).alias("dist"), F.lit(k).alias("group_no")) for k, c in enumerate(centers)]
    return F.array_sort(F.array(*each))


def nearest_centers(df: DataFrame, id: str, vector: str, centers: list[list[float]], n: int = 1) -> DataFrame:
    """(id, choice, group_no, dist): the ``n`` nearest centers of each row with a vector, nearest first from choice 1."""
    rows = df.where(F.col(vector).isNotNull() & F.col(id).isNotNull())
    if len(centers) * len(centers[0]) > EXPRESSION_NUMBERS:
        return nearest_by_matrix(rows.select(F.col(id), doubles(vector).alias("_v")), id, centers, n)
    near = F.slice(distances(vector, centers), 1, n)
    return rows.select(id, F.posexplode(near).alias("_p", "_s")).select(id, (F.col("_p") + 1).alias("choice"), F.col("_s.group_no").alias("group_no"), F.col("_s.dist").alias("dist"))


def nearest_by_matrix(rows: DataFrame, id: str, centers: list[list[float]], n: int) -> DataFrame:
    """The same for many or long centers: one matrix product per Arrow batch, exact distances for the ``n`` + 4 closest.

    The centers are broadcast: k vectors, whose number is a parameter.
    """
    shared = rows.sparkSession.sparkContext.broadcast(np.asarray(centers, dtype=np.float64))
    schema = StructType([rows.schema[id], StructField("choice", IntegerType()), StructField("group_no", IntegerType()), StructField("dist", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        wide = min(len(c), n + 4)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("_v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            rough = (c * c).sum(axis=1)[None, :] - 2 * (x @ c.T)
            close = np.sort(np.argpartition(rough, wide - 1, axis=1)[:, :wide], axis=1)
            dist = np.round(((x[:, None, :] - c[close]) ** 2).sum(axis=2), RANK_DECIMALS)
            order = np.argsort(dist, axis=1, kind="stable")[:, : min(n, wide)]
            k = order.shape[1]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(id).take(pa.array(np.repeat(np.arange(batch.num_rows), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), batch.num_rows)),
                    pa.array(np.take_along_axis(close, order, axis=1).reshape(-1).astype(np.int32)),
                    pa.array(np.take_along_axis(dist, order, axis=1).reshape(-1)),
                ],
                names=[id, "choice", "group_no", "dist"],
            )

    return rows.mapInArrow(run, schema)


def capacity(rows: int, k: int, eps: float) -> int:
    return math.ceil((1 + eps) * rows / k)


def assign_under_capacity(candidates: DataFrame, id: str, cap: int, everywhere: DataFrame | None = None) -> DataFrame:
    """(id, group_no, dist): each row in the nearest center with room, where closer pairs go first.

    candidates: (id, choice, group_no, dist), the nearest centers of each row. Rows and centers
    rank each other by the same distance, so the greedy result is the stable matching, and
    rounds of proposals reach it: every free row asks its next candidate, every center keeps
    its ``cap`` closest and the rest go on. Rows that no candidate keeps are placed, in the
    order of their ids, in the nearest center with room, from ``everywhere`` (all centers of a
    row, like candidates). Each round's lineage is cut.
    """
    rows = cut(candidates.select(id).distinct())
    held = cut(matched(candidates, id, cap, ["dist", id]))
    left = cut(rows.join(held, id, "left_anti"))
    if everywhere is None or left.isEmpty():
        return held.select(id, "group_no", "dist")
    # one number per center, as many as the plan has groups
    room = held.groupBy("group_no").agg(F.count("*").alias("taken"))
    rest = everywhere.join(left, id, "left_semi").join(F.broadcast(room), "group_no", "left").withColumn("room", cap - F.coalesce("taken", F.lit(0))).where("room > 0")
    order = Window.partitionBy(id).orderBy("choice")
    later = matched(rest.withColumn("choice", F.row_number().over(order)), id, None, [id])
    return held.select(id, "group_no", "dist").unionByName(later.select(id, "group_no", "dist"))


def matched(candidates: DataFrame, id: str, cap: int | None, order: list[str]) -> DataFrame:
    """(id, choice, group_no, dist): deferred acceptance; ``cap`` of None takes the column ``room``.

    A round counts what each center is asked (one row per center reaches the driver) and ranks
    the rows of overfull centers alone, in range partitions, however many ask one center.
    """
    options = cut(candidates)
    asking = options.where("choice = 1")
    room = F.first("room") if cap is None else F.lit(cap)
    while True:
        asked = asking.groupBy("group_no").agg(F.count("*").alias("n"), room.alias("room")).where("n > room").collect()
        if not asked:
            return asking
        full = F.col("group_no").isin([r["group_no"] for r in asked])
        ranked = ranks.in_groups(asking.where(full), "group_no", *order).drop("_n")
        limit = F.col("room") if cap is None else F.lit(cap)
        kept = asking.where(~full).unionByName(ranked.where(F.col("_rank") <= limit).drop("_rank"))
        onward = ranked.where(F.col("_rank") > limit).select(id, (F.col("choice") + 1).alias("choice")).join(options, [id, "choice"])
        asking = cut(kept.unionByName(onward.select(asking.columns)))


def grouped(df: DataFrame, id: str, vector: str, g: Grouping) -> DataFrame:
    """(id, group_no, dist): k-means groups, assigned again under a capacity where the largest is too large."""
    centers = fit_centers(df, vector, g)
    near = cut(nearest_centers(df, id, vector, centers, 1).select(id, "group_no", "dist"))
    rows = near.count()
    largest = near.groupBy("group_no").count().agg(F.max("count")).first()[0] or 0
    if largest <= g.trigger * rows / g.k:
        return near
    everywhere = nearest_centers(df, id, vector, centers, g.k)
    return assign_under_capacity(everywhere.where(F.col("choice") <= g.nearest), id, capacity(rows, g.k, g.eps), everywhere)
