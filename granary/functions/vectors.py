"""Vector arithmetic on array columns, inside the JVM and in double precision."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Decimals to which distances and norms are rounded before they rank rows, since the order of a float sum is not fixed.
RANK_DECIMALS = 6


def doubles(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def with_value(v: Column, value: Column, f: Callable[[Column, Column], Column]) -> Column:
    """f(x, value) for each x. The value is computed once, not for each x as it would be inside the lambda of transform()."""
    return F.zip_with(v, F.array_repeat(value, F.size(v)), f)


def dot(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(v: Column | str) -> Column:
    return F.sqrt(dot(v, v))


def squared_distance(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)))


def normalized(v: Column | str, least: float = 1e-12) -> Column:
    """The vector divided by its norm; a zero vector stays zero."""
    return with_value(doubles(v), F.greatest(norm(v), F.lit(least)), lambda x, length: x / length)


def log_softmax(v: Column | str) -> Column:
    low = with_value(doubles(v), F.array_max(doubles(v)), lambda x, top: x - top)
    return with_value(low, F.log(total(F.transform(low, lambda x: F.exp(x)))), lambda x, rest: x - rest)


def masked_mean(values: Column, mask: Column) -> Column:
    """Mean of the values where the mask holds; 0 where it holds nowhere."""
    kept = F.zip_with(values, mask, lambda v, m: F.when(m, v).otherwise(F.lit(0.0)))
    return total(kept) / F.greatest(F.size(F.filter(mask, lambda m: m)), F.lit(1))


def proxy_gradient(chance: Column, hidden: Column, labels: Column, ignored: int = -100) -> Column:
    """Mean over the labelled tokens t of (chance_t - 1) * hidden_t, for arrays by token; hidden is an array of vectors."""
    width = F.size(F.element_at(hidden, 1))
    held = F.filter(F.arrays_zip(chance.alias("p"), hidden.alias("h"), labels.alias("y")), lambda t: t["y"] != ignored)
    zero = F.array_repeat(F.lit(0.0), width)
    added = F.aggregate(held, zero, lambda a, t: F.zip_with(a, doubles(t["h"]), lambda x, h: x + (t["p"] - 1.0) * h))
    return with_value(added, F.greatest(F.size(held), F.lit(1)), lambda x, n: x / n)


def by_dimension(df: DataFrame, vector: str, *keys: str) -> DataFrame:
    """(keys..., dim, value): one row per component; partial sums per dimension need no further shuffle than the groups."""
    return df.select(*keys, F.posexplode(doubles(vector)).alias("dim", "value"))


def centroids(df: DataFrame, vector: str, group: str) -> DataFrame:
    """(group, center, n): the mean vector of each group; null vectors do not count."""
    held = df.where(F.col(vector).isNotNull() & F.col(group).isNotNull())
    mean = by_dimension(held, vector, group).groupBy(group, "dim").agg(F.avg("value").alias("value"), F.count("*").alias("n"))
    return mean.groupBy(group).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("dim", "value"))), lambda x: x["value"]).alias("center"), F.max("n").alias("n")
    )


def mean_vector(df: DataFrame, vector: str) -> DataFrame:
    """(center): the mean of all vectors as one row of as many values as there are dimensions."""
    mean = by_dimension(df.where(F.col(vector).isNotNull()), vector).groupBy("dim").agg(F.avg("value").alias("value"))
    return mean.agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "value"))), lambda x: x["value"]).alias("center"))


def mean_centered(df: DataFrame, vector: str) -> DataFrame:
    """``df`` with the mean of all vectors taken from each; the mean, one number per dimension, passes the driver."""
    mean = mean_vector(df, vector).first()["center"] or []
    center = F.array(*[F.lit(x) for x in mean]).cast("array<double>")
    return df.withColumn(vector, F.zip_with(doubles(vector), center, lambda x, c: x - c))


def diversity(df: DataFrame, vector: str, *groups: str) -> DataFrame:
    """Sum of squared norms over the squared norm of the sum, for each group."""
    parts = by_dimension(df.where(F.col(vector).isNotNull()), vector, *groups)
    sums = parts.groupBy(*groups, "dim").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    return sums.groupBy(*groups).agg((F.sum("q") / (F.sum(F.col("s") * F.col("s")) + 1e-12)).alias("diversity"))


def weighted_mean(df: DataFrame, vector: str, weight: str) -> DataFrame:
    """(dim, value): the mean of the vectors with the rows' weights, by dimension."""
    rows = df.where(F.col(vector).isNotNull() & F.col(weight).isNotNull())
    parts = rows.select(F.col(weight).alias("w"), F.posexplode(doubles(vector)).alias("dim", "value"))
    return parts.groupBy("dim").agg((F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias("value"))


def best_scale(a: Column | str, b: Column | str, least: float = 1e-12) -> dict[str, Column]:
    """How well ``b`` is a multiple of ``a``: the factor, what remains, the cosine, the explained share."""
    aa, bb, ab = dot(a, a), dot(b, b), dot(a, b)
    factor = F.when(aa < least, F.lit(0.0)).otherwise(ab / aa)
    remains = F.when(aa < least, F.sqrt(bb)).otherwise(F.sqrt(F.greatest(bb - 2 * factor * ab + factor * factor * aa, F.lit(0.0))))
    cosine = F.when(aa < least, F.lit(0.0)).otherwise(ab / (F.sqrt(aa) * F.sqrt(bb) + least))
    explained = F.when(aa < least, F.lit(0.0)).otherwise(1 - remains * remains / ((F.sqrt(bb) + least) * (F.sqrt(bb) + least)))
    return {"factor": factor, "remains": remains, "cosine": cosine, "explained": explained}
