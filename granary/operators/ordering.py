"""Orders of selected rows over workers, and samplers over such orders. Positions count from 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import ranks
from granary.functions.hashing import order_key, ranked

MODES = ("interleaved", "seq", "rand")


def sizes_by_group(df: DataFrame, group: str) -> list[tuple[object, int]]:
    """(group, size) in the order of the groups; there are as many groups as workers."""
    return [(r[0], int(r[1])) for r in df.groupBy(group).agg(F.count("*").alias("n")).orderBy(group).collect()]


def ordered(df: DataFrame, group: str, mode: str, id: str, seed: int = 42) -> DataFrame:
    """``df`` (with ``slot`` from 1 inside each group) with ``pos``.

    interleaved: one row of each group in turn, exhausted groups skipped; seq: group after
    group; rand: all rows shuffled. The first two follow in closed form from the sizes of the
    groups, so no sort over all rows is needed.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if mode == "rand":
        return ranked(df.withColumn("_key", order_key(seed, id, "order")), "_key", id, "slot").drop("_key")
    sizes = sizes_by_group(df, group)
    if not sizes:
        return df.withColumn("pos", F.lit(0).cast("long"))
    names, counts = F.array(*[F.lit(g) for g, _ in sizes]), [n for _, n in sizes]
    place = (F.array_position(names, F.col(group)) - 1).cast("int")
    if mode == "seq":
        starts = F.array(*[F.lit(sum(counts[:k])).cast("long") for k in range(len(counts))])
        pos = F.element_at(starts, place + 1) + F.col("slot") - 1
    elif min(counts) == max(counts):
        pos = (F.col("slot") - 1) * len(counts) + place
    else:
        held = F.array(*[F.lit(n).cast("long") for n in counts])
        earlier = F.aggregate(held, F.lit(0).cast("long"), lambda a, n: a + F.least(n, F.col("slot") - 1))
        pos = earlier + F.size(F.filter(F.slice(held, F.lit(1), place), lambda n: n >= F.col("slot")))
    return df.withColumn("pos", pos.cast("long"))


def worker(pos: Column | str, workers: int) -> Column:
    return F.pmod(F.col(pos) if isinstance(pos, str) else pos, F.lit(workers))


def epoch_order(df: DataFrame, workers: int, seed: int, epoch: int, id: str, mode: str = "interleaved") -> DataFrame:
    """``df`` with ``new_pos``: rows are shuffled among the positions of their worker, or among all with the mode "rand"."""
    if mode == "rand":
        return ranked(df.withColumn("_key", order_key(seed + epoch, id, F.col("pos"))), "_key", id, "pos", name="new_pos").drop("_key")
    shared = df.withColumn("_share", worker("pos", workers))
    keyed = shared.withColumn("_key", order_key(F.lit(seed + epoch + 12345) + F.col("_share"), id, F.col("pos")))
    inside = ranks.in_groups(keyed, "_share", "_key", id, "pos", name="_inside")
    return inside.withColumn("new_pos", ((F.col("_inside") - 1) * workers + F.col("_share")).cast("long")).select(*df.columns, "new_pos")


def shard(df: DataFrame, workers: int, rank: int, drop_last: bool = True) -> DataFrame:
    """Rows of one worker: every ``workers``-th position from ``rank`` on.

    With drop_last all workers have floor(n / workers) rows. Without it all have as many as the
    first one: a worker that lacks a row repeats its own last one, or the last of all if it has none.
    """
    n = df.count()
    if drop_last:
        return df.where((worker("pos", workers) == rank) & (F.col("pos") < n // workers * workers))
    own = df.where(worker("pos", workers) == rank)
    if not n % workers or rank < n % workers:
        return own
    last = rank + (n // workers - 1) * workers if n >= workers else n - 1
    return own.unionByName(df.where(F.col("pos") == last))


def range_shards(df: DataFrame, id: str, workers: int) -> DataFrame:
    """``df`` with ``rank`` and ``step``: consecutive runs of ceil(n / workers) ids for each worker."""
    n = df.count()
    each = max(1, -(-n // workers))
    placed = in_id_order(df, id)
    return placed.withColumn("rank", F.floor(F.col("pos") / each)).withColumn("step", F.col("pos") % each)


def in_id_order(df: DataFrame, id: str) -> DataFrame:
    """``df`` with ``pos``, its rank by id."""
    return ranks.positions(df, id)


def special_turns(df: DataFrame, id: str, workers: int, seed: int, special: int = 1) -> DataFrame:
    """``df`` with ``pos``: after workers - 1 ordinary rows comes a special one; rows with id mod workers >= workers - special are special.

    The order ends with the kind that lasts longer; without specials it is a shuffle.
    """
    marked = df.withColumn("is_special", F.pmod(id, F.lit(workers)) >= workers - special).withColumn("_key", order_key(seed, id, "turn"))
    if not special:
        return ranked(marked, "_key", id).drop("_key")
    plain = ranked(marked.where("not is_special"), "_key", id, name="_i")
    extra = ranked(marked.where("is_special"), "_key", id, name="_i")
    n_plain, n_extra = (x.count() for x in (plain, extra))
    width = workers - 1
    turns = min(n_plain // width if width else n_extra, n_extra)
    first = F.when(F.col("_i") < turns * width, F.col("_i") + F.floor(F.col("_i") / max(width, 1))).otherwise(F.col("_i") + turns)
    second = F.when(F.col("_i") < turns, F.col("_i") * workers + width).otherwise(F.lit(n_plain) + F.col("_i"))
    return plain.withColumn("pos", first.cast("long")).unionByName(extra.withColumn("pos", second.cast("long"))).drop("_key", "_i")


def last_worker_apart(df: DataFrame, id: str, workers: int, seed: int) -> DataFrame:
    """``df`` with ``rank`` and ``step``: the last worker owns the ids that are -1 mod workers, the others stride through the shuffled rest."""
    own = F.pmod(id, F.lit(workers)) == workers - 1
    keyed = df.withColumn("_key", order_key(seed, id, "apart"))
    last = ranked(keyed.where(own), "_key", id, name="step").withColumn("rank", F.lit(workers - 1).cast("long"))
    rest = ranked(keyed.where(~own), "_key", id, name="_i")
    others = max(1, workers - 1)
    return last.unionByName(rest.withColumn("rank", F.pmod("_i", F.lit(others)).cast("long")).withColumn("step", F.floor(F.col("_i") / others)).drop("_i")).drop("_key")


def ratio_batches(df: DataFrame, id: str, size: str, ratios: list[int], per_worker: int, seed: int, epoch: int = 0) -> DataFrame:
    """``df`` with ``part``, ``pos`` and ``batch_no``: batches that hold rows of all parts in the given ratios.

    Rows are dealt by their place in the order of ids to sum(ratios) workers in turn, and part k
    owns ratios[k] of the workers. A part is sorted from long to short (ties by worker and
    place) and cut into blocks of ratios[k] rows. One shuffled order of the blocks holds for all
    parts, rows are shuffled inside their block, and each batch takes ratios[k] * per_worker
    rows of each part. Only whole batches are made, so up to a batch of rows is left out.
    """
    workers = sum(ratios)
    starts = [sum(ratios[:k]) for k in range(len(ratios))]
    rows = in_id_order(df, id).withColumnRenamed("pos", "_i").withColumn("_w", worker("_i", workers))
    n = rows.count()
    part, width, start = (F.lit(x) for x in (0, ratios[0], 0))
    for k in range(1, len(ratios)):
        later = F.col("_w") >= starts[k]
        part, width, start = F.when(later, k).otherwise(part), F.when(later, ratios[k]).otherwise(width), F.when(later, starts[k]).otherwise(start)
    named = rows.withColumn("part", part).withColumn("_width", width).withColumn("_start", start)
    sized = ranks.in_groups(named, "part", F.col(size).desc(), "_w", "_i").withColumn("_block", F.floor((F.col("_rank") - 1) / F.col("_width"))).where(F.col("_block") < n // workers)
    blocks = df.sparkSession.range(n // workers).withColumnRenamed("id", "_block")
    turns = ranked(blocks.withColumn("_key", order_key(seed + epoch, "_block", "blocks")), "_key", "_block", name="_turn").drop("_key")
    inside = F.row_number().over(Window.partitionBy("part", "_block").orderBy(order_key(seed + epoch, id, F.col("_block")), id)) - 1
    turned = sized.withColumn("_inside", inside).join(turns, "_block").withColumn("_q", F.col("_turn") * F.col("_width") + F.col("_inside"))
    batch = F.col("_width") * per_worker
    placed = turned.withColumn("batch_no", F.floor(F.col("_q") / batch)).where(F.col("batch_no") < n // (workers * per_worker))
    pos = F.col("batch_no") * (workers * per_worker) + F.col("_start") * per_worker + F.col("_q") % batch
    return placed.withColumn("pos", pos.cast("long")).select(*df.columns, "part", "pos", "batch_no")


def length_grouped(df: DataFrame, id: str, size: str, bucket: int, seed: int) -> DataFrame:
    """``df`` with ``pos``: a shuffle whose runs of ``bucket`` rows are sorted by length."""
    shuffled = ranked(df.withColumn("_key", order_key(seed, id, "length")), "_key", id, name="_i").drop("_key")
    runs = shuffled.withColumn("_run", F.floor(F.col("_i") / bucket))
    inside = F.row_number().over(Window.partitionBy("_run").orderBy(F.col(size).desc(), id)) - 1
    return runs.withColumn("pos", (F.col("_run") * bucket + inside).cast("long")).drop("_i", "_run")


def split(df: DataFrame, id: str, test: float, seed: int) -> DataFrame:
    """``df`` with ``part``: exactly the asked share (up to 1) or number (above) of rows is "test", drawn by hash."""
    n = df.count()
    size = int(round(test * n)) if test <= 1 else min(int(test), n)
    placed = ranked(df.withColumn("_key", order_key(seed, id, "split")), "_key", id, name="_i").drop("_key")
    return placed.withColumn("part", F.when(F.col("_i") < size, "test").otherwise("train")).drop("_i")


def fetched(order: DataFrame, data: DataFrame, id: str) -> DataFrame:
    """Rows of the data in an order in which an id may stand more than once."""
    return order.join(data, id)


def active(order: DataFrame, subset: DataFrame, id: str) -> DataFrame:
    """The order of the rows whose id is in the subset, numbered again from 0: what is striped over the workers is the subset."""
    kept = order.join(subset.select(id).distinct(), id, "left_semi").withColumnRenamed("pos", "_old")
    return ranks.positions(kept, "_old", id).drop("_old").select(*order.columns)
