"""Queries over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import text, tokens, vectors
from granary.operators import generation, grouping, ordering, selection, weights
from granary.operators.grouping import Grouping
from granary.operators.selection import Plan
from granary.plans import pipeline
from granary.session import scratch
from granary.sources import jsonl
from granary.sources.registry import FAMILIES, Decoding
from granary.streaming import scoring

Query = Callable[[SparkSession, str], DataFrame]

#: Folder of the public vocabulary files, under the same path on every executor.
TOKENIZERS = os.environ.get("GRANARY_TOKENIZERS", "/opt/tokenizers")

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name, with its SQL where SQL can express it."""

    def add(run: Query) -> Query:
        QUERIES[run.__name__] = run
        if sql is not None:
            ORACLES[run.__name__] = sql
        return run

    return add


def register(name: str, run: Query, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql is not None:
        ORACLES[name] = sql


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# Selection. Groups and distances are those of row_features.

SEED = 42
R = "r AS (SELECT row_id, group_no, dist, round(dist, 6) AS d FROM row_features WHERE group_no IS NOT NULL AND dist IS NOT NULL)"


def keep_sql(ratio: int, micro: int = 1) -> str:
    return f"k AS (SELECT (min(n) * {ratio} // 100) // {micro} * {micro} AS k FROM (SELECT count(*) AS n FROM r GROUP BY group_no))"


def slot_sql(kept: str) -> str:
    return f"s AS (SELECT *, row_number() OVER (PARTITION BY group_no ORDER BY md5(concat_ws(':', {SEED} + group_no, '', row_id)), row_id) AS slot FROM ({kept}))"


ORDER_SQL = {
    "far": "d ASC, row_id ASC",
    "close": "d DESC, row_id DESC",
    "rand": f"md5(concat_ws(':', {SEED}, group_no, row_id)), row_id",
}


def selected(spark: SparkSession, d: str, plan: Plan) -> DataFrame:
    rows = table(spark, d, "row_features").select("row_id", "group_no", "dist")
    return selection.selected(rows, "row_id", "group_no", "dist", plan)


def select_sql(rule: str, ratio: int, micro: int = 1) -> str:
    ranked = f"SELECT *, row_number() OVER (PARTITION BY group_no ORDER BY {ORDER_SQL[rule]}) AS rk FROM r"
    return f"WITH {R}, {keep_sql(ratio, micro)}, {slot_sql(f'SELECT q.* FROM ({ranked}) q, k WHERE rk <= k')}"


def add_selections() -> None:
    for rule in ("far", "rand"):
        register(f"select_{rule}", lambda s, d, r=rule: selected(s, d, Plan(rule=r, ratio=75)).select("row_id", "group_no", "slot"), select_sql(rule, 75) + " SELECT row_id, group_no, slot FROM s")
    register(
        "select_drop_last",
        lambda s, d: selected(s, d, Plan(rule="close", ratio=50, micro=4, drop_last=True)).select("row_id", "group_no", "slot"),
        select_sql("close", 50, 4) + " SELECT row_id, group_no, slot FROM s",
    )
    both = "SELECT *, row_number() OVER (PARTITION BY group_no ORDER BY d, row_id) AS a, row_number() OVER (PARTITION BY group_no ORDER BY d DESC, row_id DESC) AS b FROM r"
    register(
        "select_mix",
        lambda s, d: selected(s, d, Plan(rule="mix", ratio=75)).select("row_id", "group_no", "slot"),
        f"WITH {R}, {keep_sql(75)}, {slot_sql(f'SELECT q.* FROM ({both}) q, k WHERE a <= k // 2 OR b <= k - k // 2')} SELECT row_id, group_no, slot FROM s",
    )
    register("select_none", lambda s, d: selected(s, d, Plan(rule="none")).select("row_id", "group_no", "slot"), f"WITH {R}, {slot_sql('SELECT * FROM r')} SELECT row_id, group_no, slot FROM s")


INTERLEAVED = "row_number() OVER (ORDER BY slot, group_no) - 1"


def closest_left_out(spark: SparkSession, d: str, ratio: int) -> DataFrame:
    kept = selected(spark, d, Plan(rule="close", ratio=ratio))
    return ordering.ordered(kept, "group_no", "interleaved", "row_id", SEED).select("row_id", "group_no", "slot", "pos", "dist")


@query(select_sql("close", 75) + f" SELECT row_id, group_no, slot, {INTERLEAVED} AS pos, dist FROM s")
def select_close(spark: SparkSession, d: str) -> DataFrame:
    return closest_left_out(spark, d, 75)


NORM = "sqrt(list_sum([x::DOUBLE * x::DOUBLE for x in features]))"


@query(
    "WITH r AS (SELECT row_id, group_no, round(dist, 6) AS d, round(" + NORM + ", 6) AS g FROM row_features WHERE group_no IS NOT NULL AND dist IS NOT NULL AND features IS NOT NULL), "
    + keep_sql(50)
    + f", {slot_sql('SELECT q.* FROM (SELECT *, row_number() OVER (PARTITION BY group_no ORDER BY g DESC, d DESC, row_id DESC) AS rk FROM r) q, k WHERE rk <= k')} SELECT row_id, group_no, slot FROM s"
)
def select_big(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "row_features").where("features IS NOT NULL").withColumn("norm", vectors.norm("features"))
    return selection.selected(rows, "row_id", "group_no", "dist", Plan(rule="big", ratio=50), "norm").select("row_id", "group_no", "slot")


@query(
    f"""WITH {R}, n AS (SELECT group_no, count(*) AS n FROM r GROUP BY group_no),
    s AS (SELECT *, row_number() OVER (PARTITION BY group_no ORDER BY md5(concat_ws(':', {SEED} + group_no, '', row_id)), row_id) AS slot FROM r),
    x AS (SELECT group_no, n, unnest(range(n + 1, (SELECT max(n) FROM n) + 1)) AS slot FROM n),
    y AS (SELECT group_no, slot, ('0x' || substr(md5(concat_ws(':', {SEED}, concat_ws(':', group_no, slot))), 1, 8))::BIGINT % n + 1 AS f FROM x)
    SELECT row_id, group_no, slot, false AS copy FROM s UNION ALL SELECT s.row_id, y.group_no, y.slot, true FROM y JOIN s ON s.group_no = y.group_no AND s.slot = y.f"""
)
def oversample_uniform(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "row_features").where("dist IS NOT NULL")
    return selection.oversampled(rows, "row_id", "group_no", Plan(seed=SEED))


@query(
    f"WITH {R}, n AS (SELECT count(*) AS n FROM r GROUP BY group_no) SELECT count(*) AS n_groups, sum(n)::BIGINT AS n_rows, min(n) AS smallest, max(n) AS largest, (min(n) * 75 // 100)::BIGINT AS per_group, (count(*) * (min(n) * 75 // 100))::BIGINT AS kept, (sum(n) - count(*) * (min(n) * 75 // 100))::BIGINT AS pruned FROM n"
)
def group_diag(spark: SparkSession, d: str) -> DataFrame:
    return selection.diagnostics(table(spark, d, "row_features").where("dist IS NOT NULL"), "group_no", Plan(ratio=75))


def greedy_sql(steps: str, where: str = "true") -> str:
    """k(row_id, group_no, step): the greedy choice; a round takes the best row left of each group and brings the others' distances up to date."""
    apart = "list_sum([(a[1] - a[2]) * (a[1] - a[2]) for a in list_zip(v, taken_v)])"
    best = "PARTITION BY group_no ORDER BY step IS NOT NULL, round(score, 6) DESC, row_id"
    return f"""WITH RECURSIVE v AS (SELECT row_id, group_no, [x::DOUBLE for x in features] AS v FROM row_features WHERE group_no IS NOT NULL AND features IS NOT NULL AND {where}),
    m AS ({steps}),
    k AS (SELECT 0 AS turn, row_id, group_no, v, 'Infinity'::DOUBLE AS least, list_sum([x * x for x in v]) AS score, NULL::BIGINT AS step FROM v
    UNION ALL SELECT turn + 1, row_id, group_no, v, least(least, {apart}), least(least, {apart}), CASE WHEN step IS NULL AND row_id = taken THEN turn + 1 ELSE step END
    FROM (SELECT k.*, first_value(row_id) OVER w AS taken, first_value(v) OVER w AS taken_v FROM k, m WHERE turn < m.m WINDOW w AS ({best})))"""


@query(greedy_sql("SELECT 10 AS m") + " SELECT row_id, group_no, step FROM k WHERE turn = 10 AND step IS NOT NULL")
def kcenter_select(spark: SparkSession, d: str) -> DataFrame:
    return selection.farthest_first(table(spark, d, "row_features"), "row_id", "group_no", "features", 10)


@query(
    greedy_sql("SELECT min(n) * 25 // 100 AS m FROM (SELECT count(*) AS n FROM v GROUP BY group_no)", "dist IS NOT NULL")
    + f""", {slot_sql("SELECT row_id, group_no FROM k, m WHERE turn = m.m AND step IS NOT NULL")}
    SELECT row_id, group_no, slot, row_number() OVER (ORDER BY md5(concat_ws(':', {SEED}, 'order', row_id)), row_id, slot) - 1 AS pos FROM s"""
)
def select_badge(spark: SparkSession, d: str) -> DataFrame:
    """The greedy choice as a rule of the selection; its order is always a shuffle of all rows."""
    rows = table(spark, d, "row_features").where("features IS NOT NULL").select("row_id", "group_no", "dist", "features")
    kept = selection.selected(rows, "row_id", "group_no", "dist", Plan(rule="badge", ratio=25), vector="features")
    return ordering.ordered(kept, "group_no", "rand", "row_id", SEED).select("row_id", "group_no", "slot", "pos")


# Weights

SIZES = "n AS (SELECT group_no, count(*) AS n FROM row_features WHERE group_no IS NOT NULL GROUP BY group_no)"


def sizes(spark: SparkSession, d: str) -> DataFrame:
    return weights.group_sizes(table(spark, d, "row_features"), "group_no")


@query(f"WITH {SIZES} SELECT group_no, n, round(n / (SELECT sum(n) FROM n), 9) AS share, round(n / (SELECT min(n) FROM n), 9) AS size_ratio FROM n")
def group_shares(spark: SparkSession, d: str) -> DataFrame:
    return sizes(spark, d).select("group_no", "n", F.round("share", 9).alias("share"), F.round("size_ratio", 9).alias("size_ratio"))


@query(f"WITH {SIZES} SELECT group_no, n, round((SELECT count(*) FROM n) * n / (SELECT sum(n) FROM n), 9) AS rank_weight FROM n")
def rank_weights(spark: SparkSession, d: str) -> DataFrame:
    return weights.rank_weights(sizes(spark, d), "group_no").withColumn("rank_weight", F.round("rank_weight", 9))


@query(f"WITH {SIZES} SELECT group_no, n, 1.0::DOUBLE AS rank_weight FROM n")
def rank_weights_unweighted(spark: SparkSession, d: str) -> DataFrame:
    return weights.rank_weights(sizes(spark, d), "group_no", False)


@query(select_sql("rand", 75).replace("WHERE rk <= k", "WHERE true") + " SELECT row_id, group_no, 1.0::DOUBLE AS row_weight FROM s")
def row_weights_unpruned(spark: SparkSession, d: str) -> DataFrame:
    """Without pruning all rows weigh the same, whatever the mode."""
    return weights.row_weights(selected(spark, d, Plan(rule="none")), sizes(spark, d), "group_no", "inv", rule="none").select("row_id", "group_no", "row_weight")


def add_row_weights() -> None:
    forms = {"inv": "1 / share", "sqrt_inv": "1 / sqrt(share)", "prop": "share", "none": "1.0"}
    for mode, form in forms.items():
        register(
            f"row_weights_{mode}",
            lambda s, d, m=mode: weights.row_weights(selected(s, d, Plan(rule="rand", ratio=75)), sizes(s, d), "group_no", m).select("row_id", "group_no", F.round("row_weight", 6).alias("row_weight")),
            select_sql("rand", 75) + f", {SIZES}, w AS (SELECT group_no, ({form})::DOUBLE AS w FROM (SELECT group_no, n / (SELECT sum(n) FROM n) AS share FROM n)) SELECT s.row_id, s.group_no, round(w.w / (SELECT avg(w2.w) FROM s s2 JOIN w w2 ON s2.group_no = w2.group_no), 6) AS row_weight FROM s JOIN w ON s.group_no = w.group_no",
        )


# Orders

NONE = f"WITH {R}, {slot_sql('SELECT * FROM r')}"


def all_rows(spark: SparkSession, d: str) -> DataFrame:
    return selected(spark, d, Plan(rule="none"))


def interleaved(spark: SparkSession, d: str) -> DataFrame:
    return ordering.ordered(all_rows(spark, d), "group_no", "interleaved", "row_id", SEED).select("row_id", "group_no", "slot", "pos")


def add_orders() -> None:
    places = {"interleaved": INTERLEAVED, "seq": "row_number() OVER (ORDER BY group_no, slot) - 1", "rand": f"row_number() OVER (ORDER BY md5(concat_ws(':', {SEED}, 'order', row_id)), row_id, slot) - 1"}
    for mode, place in places.items():
        register(
            f"order_{mode}",
            lambda s, d, m=mode: ordering.ordered(all_rows(s, d), "group_no", m, "row_id", SEED).select("row_id", "group_no", "slot", "pos"),
            f"{NONE} SELECT row_id, group_no, slot, {place} AS pos FROM s",
        )


POS = f"{NONE}, o AS (SELECT row_id, group_no, slot, {INTERLEAVED} AS pos FROM s)"


@query(
    f"{POS} SELECT row_id, pos, (row_number() OVER (PARTITION BY pos % 8 ORDER BY md5(concat_ws(':', {SEED} + 3 + 12345 + pos % 8, pos, row_id)), row_id, pos) - 1) * 8 + pos % 8 AS new_pos FROM o"
)
def epoch_residue_shuffle(spark: SparkSession, d: str) -> DataFrame:
    return ordering.epoch_order(interleaved(spark, d), 8, SEED, 3, "row_id").select("row_id", "pos", "new_pos")


@query(f"{POS} SELECT row_id, pos, row_number() OVER (ORDER BY md5(concat_ws(':', {SEED} + 3, pos, row_id)), row_id, pos) - 1 AS new_pos FROM o")
def epoch_full_shuffle(spark: SparkSession, d: str) -> DataFrame:
    return ordering.epoch_order(interleaved(spark, d), 8, SEED, 3, "row_id", "rand").select("row_id", "pos", "new_pos")


@query(f"{POS} SELECT row_id, pos, pos % 8 AS worker FROM o")
def worker_of_position(spark: SparkSession, d: str) -> DataFrame:
    return interleaved(spark, d).select("row_id", "pos", ordering.worker("pos", 8).alias("worker"))


@query(f"{POS} SELECT row_id, pos FROM o WHERE pos % 8 = 3 AND pos < (SELECT count(*) FROM o) // 8 * 8")
def shard_by_worker(spark: SparkSession, d: str) -> DataFrame:
    return ordering.shard(interleaved(spark, d), 8, 3).select("row_id", "pos")


@query(f"{POS} SELECT row_id, pos FROM o WHERE pos % 8 = 7 UNION ALL SELECT row_id, pos FROM o WHERE pos = (SELECT max(pos) FROM o WHERE pos % 8 = 7) AND (SELECT count(*) FROM o) % 8 BETWEEN 1 AND 7")
def shard_padded(spark: SparkSession, d: str) -> DataFrame:
    return ordering.shard(interleaved(spark, d), 8, 7, drop_last=False).select("row_id", "pos")


@query("WITH p AS (SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS pos, (SELECT (count(*) + 7) // 8 FROM row_features) AS each FROM row_features) SELECT row_id, pos, (pos // each)::BIGINT AS rank, (pos % each)::BIGINT AS step FROM p")
def sampler_range(spark: SparkSession, d: str) -> DataFrame:
    return ordering.range_shards(table(spark, d, "row_features").select("row_id"), "row_id", 8).select("row_id", "pos", F.col("rank").cast("long"), F.col("step").cast("long"))


@query("SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS pos FROM row_features")
def sampler_sequential(spark: SparkSession, d: str) -> DataFrame:
    return ordering.in_id_order(table(spark, d, "row_features").select("row_id"), "row_id")


@query(
    f"""WITH m AS (SELECT row_id, row_id % 8 >= 7 AS sp, md5(concat_ws(':', {SEED}, 'turn', row_id)) AS h FROM row_features),
    i AS (SELECT row_id, sp, row_number() OVER (PARTITION BY sp ORDER BY h, row_id) - 1 AS i FROM m),
    c AS (SELECT count(*) FILTER (NOT sp) AS p, count(*) FILTER (sp) AS e, least(count(*) FILTER (NOT sp) // 7, count(*) FILTER (sp)) AS t FROM m)
    SELECT row_id, sp AS is_special, (CASE WHEN NOT sp THEN CASE WHEN i < t * 7 THEN i + i // 7 ELSE i + t END ELSE CASE WHEN i < t THEN i * 8 + 7 ELSE p + i END END)::BIGINT AS pos FROM i, c"""
)
def sampler_special(spark: SparkSession, d: str) -> DataFrame:
    return ordering.special_turns(table(spark, d, "row_features").select("row_id"), "row_id", 8, SEED).select("row_id", "is_special", "pos")


@query(
    f"""WITH m AS (SELECT row_id, row_id % 8 = 7 AS own, md5(concat_ws(':', {SEED}, 'apart', row_id)) AS h FROM row_features),
    i AS (SELECT row_id, own, row_number() OVER (PARTITION BY own ORDER BY h, row_id) - 1 AS i FROM m)
    SELECT row_id, CASE WHEN own THEN 7 ELSE i % 7 END AS rank, CASE WHEN own THEN i ELSE i // 7 END AS step FROM i"""
)
def sampler_last_apart(spark: SparkSession, d: str) -> DataFrame:
    return ordering.last_worker_apart(table(spark, d, "row_features").select("row_id"), "row_id", 8, SEED).select("row_id", "rank", F.col("step").cast("long"))


@query(
    f"""WITH t AS (SELECT row_id, len(input_ids) AS size, row_number() OVER (ORDER BY row_id) - 1 AS i FROM tokenized_rows), n AS (SELECT count(*) AS n FROM t),
    g AS (SELECT *, i % 4 AS w, CASE WHEN i % 4 < 1 THEN 0 ELSE 1 END AS part, CASE WHEN i % 4 < 1 THEN 1 ELSE 3 END AS wide, CASE WHEN i % 4 < 1 THEN 0 ELSE 1 END AS first FROM t),
    r AS (SELECT *, (row_number() OVER (PARTITION BY part ORDER BY size DESC, w, i) - 1) // wide AS block FROM g),
    b AS (SELECT r.* FROM r, n WHERE block < n // 4),
    o AS (SELECT block, row_number() OVER (ORDER BY md5(concat_ws(':', {SEED}, 'blocks', block)), block) - 1 AS turn FROM (SELECT DISTINCT block FROM b)),
    q AS (SELECT b.*, turn * wide + row_number() OVER (PARTITION BY part, b.block ORDER BY md5(concat_ws(':', {SEED}, b.block, row_id)), row_id) - 1 AS q FROM b JOIN o ON o.block = b.block)
    SELECT row_id, part, (q // (wide * 8))::BIGINT AS batch_no, (q // (wide * 8) * 32 + first * 8 + q % (wide * 8))::BIGINT AS pos FROM q, n WHERE q // (wide * 8) < n // 32"""
)
def sampler_ratio(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "tokenized_rows").select("row_id", F.size("input_ids").alias("size"))
    return ordering.ratio_batches(rows, "row_id", "size", [1, 3], 8, SEED).select("row_id", "part", "batch_no", "pos")


@query(
    f"""WITH t AS (SELECT row_id, len(input_ids) AS size FROM tokenized_rows), i AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws(':', {SEED}, 'length', row_id)), row_id) - 1 AS i FROM t)
    SELECT row_id, ((i // 64) * 64 + row_number() OVER (PARTITION BY i // 64 ORDER BY size DESC, row_id) - 1)::BIGINT AS pos FROM i"""
)
def sampler_length_grouped(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "tokenized_rows").select("row_id", F.size("input_ids").alias("size"))
    return ordering.length_grouped(rows, "row_id", "size", 64, SEED).select("row_id", "pos")


@query(f"WITH i AS (SELECT row_id, row_number() OVER (ORDER BY md5(concat_ws(':', {SEED}, 'split', row_id)), row_id) - 1 AS i FROM row_features) SELECT row_id, CASE WHEN i < (SELECT round(0.1 * count(*)) FROM row_features) THEN 'test' ELSE 'train' END AS part FROM i")
def train_test_split(spark: SparkSession, d: str) -> DataFrame:
    return ordering.split(table(spark, d, "row_features").select("row_id"), "row_id", 0.1, SEED)


@query(f"{POS}, a AS (SELECT row_id, row_number() OVER (ORDER BY pos) - 1 AS pos FROM o WHERE row_id IN (SELECT row_id FROM tokenized_rows WHERE exceeding_length)) SELECT row_id, pos, pos % 8 AS worker FROM a")
def active_subset(spark: SparkSession, d: str) -> DataFrame:
    subset = table(spark, d, "tokenized_rows").where("exceeding_length")
    return ordering.active(interleaved(spark, d), subset, "row_id").select("row_id", "pos", ordering.worker("pos", 8).alias("worker"))


@query(f"{POS} SELECT o.pos, o.row_id, len(t.input_ids)::INT AS n_tokens FROM o JOIN tokenized_rows t ON t.row_id = o.row_id")
def order_fetch(spark: SparkSession, d: str) -> DataFrame:
    data = table(spark, d, "tokenized_rows").select("row_id", F.size("input_ids").alias("n_tokens"))
    return ordering.fetched(interleaved(spark, d).select("row_id", "pos"), data, "row_id")


# Vectors

E = "e AS (SELECT vec_id, label, [x::DOUBLE for x in embedding] AS v FROM embeddings WHERE embedding IS NOT NULL)"
C = "x AS (SELECT vec_id, label, unnest(v) AS value, generate_subscripts(v, 1) - 1 AS dim FROM e), c AS (SELECT label, dim, avg(value) AS m FROM x GROUP BY label, dim)"


def embeddings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings")


@query("SELECT vec_id, unnest([round(x::DOUBLE / greatest(sqrt(list_sum([y::DOUBLE * y::DOUBLE for y in embedding])), 1e-12), 6) for x in embedding]) AS value, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings")
def l2_normalize(spark: SparkSession, d: str) -> DataFrame:
    rows = embeddings(spark, d).select("vec_id", vectors.normalized("embedding").alias("v"))
    return vectors.by_dimension(rows, "v", "vec_id").select("vec_id", F.round("value", 6).alias("value"), F.col("dim").cast("long").alias("dim"))


@query(f"WITH {E}, {C}, m AS (SELECT dim, avg(value) AS m FROM x GROUP BY dim) SELECT x.vec_id, x.dim, round(x.value - m.m, 6) AS value FROM x JOIN m ON m.dim = x.dim")
def mean_center(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors.mean_centered(embeddings(spark, d).select("vec_id", "embedding"), "embedding")
    return vectors.by_dimension(rows, "embedding", "vec_id").select("vec_id", F.col("dim").cast("long").alias("dim"), F.round("value", 6).alias("value"))


@query(f"WITH {E}, {C} SELECT label, dim, round(m, 6) AS value FROM c")
def group_centers(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors.centroids(embeddings(spark, d), "embedding", "label")
    return vectors.by_dimension(rows, "center", "label").select("label", F.col("dim").cast("long").alias("dim"), F.round("value", 6).alias("value"))


@query(f"WITH {E}, {C} SELECT x.vec_id, round(sum((x.value - c.m) * (x.value - c.m)), 6) AS dist FROM x JOIN c ON c.label = x.label AND c.dim = x.dim GROUP BY x.vec_id")
def center_distance(spark: SparkSession, d: str) -> DataFrame:
    rows = embeddings(spark, d)
    joined = rows.join(F.broadcast(vectors.centroids(rows, "embedding", "label").select("label", "center")), "label")
    return joined.select("vec_id", F.round(vectors.squared_distance("embedding", "center"), 6).alias("dist"))


def first_centers(spark: SparkSession, d: str) -> list[list[float]]:
    """The group centers as numbers, in the order of the labels."""
    rows = vectors.centroids(embeddings(spark, d), "embedding", "label").orderBy("label").collect()
    return [list(r["center"]) for r in rows]


@query(
    f"""WITH {E}, {C}, q AS (SELECT x.vec_id, c.label, round(sum((x.value - c.m) * (x.value - c.m)), 6) AS dist FROM x JOIN c ON c.dim = x.dim GROUP BY x.vec_id, c.label)
    SELECT vec_id, choice, label AS group_no, dist FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, label) AS choice FROM q) WHERE choice <= 3"""
)
def topk_centers(spark: SparkSession, d: str) -> DataFrame:
    near = grouping.nearest_centers(embeddings(spark, d), "vec_id", "embedding", first_centers(spark, d), 3)
    return near.select("vec_id", F.col("choice").cast("long").alias("choice"), "group_no", "dist")


@query(f"WITH {E}, {C}, s AS (SELECT label, dim, sum(value) AS s, sum(value * value) AS q FROM x GROUP BY label, dim) SELECT label, round(sum(q) / (sum(s * s) + 1e-12), 9) AS diversity FROM s GROUP BY label")
def grad_diversity(spark: SparkSession, d: str) -> DataFrame:
    return vectors.diversity(embeddings(spark, d), "embedding", "label").withColumn("diversity", F.round("diversity", 9))


@query(
    f"""WITH {E}, {C}, p AS (SELECT x.vec_id, sum(x.value * x.value) AS bb, sum(c.m * c.m) AS aa, sum(c.m * x.value) AS ab FROM x JOIN c ON c.label = x.label AND c.dim = x.dim GROUP BY x.vec_id),
    q AS (SELECT *, ab / aa AS f, sqrt(greatest(bb - ab * ab / aa, 0)) AS r FROM p)
    SELECT vec_id, round(f, 6) AS factor, round(r, 6) AS remains, round(ab / (sqrt(aa) * sqrt(bb) + 1e-12), 6) AS cosine, round(1 - r * r / ((sqrt(bb) + 1e-12) * (sqrt(bb) + 1e-12)), 6) AS explained FROM q"""
)
def alpha_fit(spark: SparkSession, d: str) -> DataFrame:
    rows = embeddings(spark, d)
    joined = rows.join(F.broadcast(vectors.centroids(rows, "embedding", "label").select("label", "center")), "label")
    return joined.select("vec_id", *[F.round(c, 6).alias(n) for n, c in vectors.best_scale("center", "embedding").items()])


@query("SELECT vec_id, unnest([round(x::DOUBLE - list_max(embedding)::DOUBLE - ln(list_sum([exp(y::DOUBLE - list_max(embedding)::DOUBLE) for y in embedding])), 6) for x in embedding]) AS value, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings")
def log_softmax(spark: SparkSession, d: str) -> DataFrame:
    rows = embeddings(spark, d).select("vec_id", vectors.log_softmax("embedding").alias("v"))
    return vectors.by_dimension(rows, "v", "vec_id").select("vec_id", F.round("value", 6).alias("value"), F.col("dim").cast("long").alias("dim"))


@query("SELECT row_id, round(list_sum([x for x in labels if x <> -100])::DOUBLE / greatest(len([x for x in labels if x <> -100]), 1), 6) AS mean_id FROM tokenized_rows WHERE len([x for x in labels if x <> -100]) > 0")
def masked_token_mean(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "tokenized_rows")
    mask = F.transform("labels", lambda x: x != tokens.IGNORED)
    return rows.where(F.exists("labels", lambda x: x != tokens.IGNORED)).select("row_id", F.round(vectors.masked_mean(F.col("labels").cast("array<double>"), mask), 6).alias("mean_id"))


@query(
    """WITH t AS (SELECT e.vec_id, e.label, [x::DOUBLE for x in e.embedding] AS v FROM embeddings e), h AS (SELECT vec_id, unnest(v) AS value, generate_subscripts(v, 1) - 1 AS dim, label FROM t)
    SELECT vec_id, dim, round((CASE WHEN label % 2 = 0 THEN (0.25 - 1) * value + (0.5 - 1) * value * 2 ELSE (0.25 - 1) * value * 2 END) / 2, 6) AS value FROM h"""
)
def proxy_gradient(spark: SparkSession, d: str) -> DataFrame:
    v = vectors.doubles("embedding")
    double = F.transform(v, lambda x: x * 2)
    ignored = F.lit(tokens.IGNORED)
    labels = F.array(F.when(F.col("label") % 2 == 0, F.lit(5)).otherwise(ignored), F.lit(7), ignored)
    first = F.when(F.col("label") % 2 == 0, v).otherwise(v)
    rows = embeddings(spark, d).select("vec_id", vectors.proxy_gradient(F.array(F.lit(0.25), F.when(F.col("label") % 2 == 0, F.lit(0.5)).otherwise(F.lit(0.25)), F.lit(0.9)), F.array(first, double, v), labels).alias("g"), "label")
    scaled = F.transform("g", lambda x: F.when(F.col("label") % 2 == 0, x).otherwise(x / 2))
    return vectors.by_dimension(rows.select("vec_id", scaled.alias("g")), "g", "vec_id").select("vec_id", F.col("dim").cast("long").alias("dim"), F.round("value", 6).alias("value"))


@query(f"WITH {E}, {C}, n AS (SELECT label, count(*) AS n FROM e GROUP BY label), w AS (SELECT label, (SELECT count(*) FROM n) * n / (SELECT sum(n) FROM n) AS w FROM n) SELECT c.dim, round(sum(w.w * c.m) / sum(w.w), 6) AS value FROM c JOIN w ON w.label = c.label GROUP BY c.dim")
def weighted_group_mean(spark: SparkSession, d: str) -> DataFrame:
    rows = embeddings(spark, d)
    weight = weights.rank_weights(weights.group_sizes(rows, "label"), "label")
    centers = vectors.centroids(rows, "embedding", "label").select("label", "center").join(weight, "label")
    return vectors.weighted_mean(centers, "center", "rank_weight").select(F.col("dim").cast("long").alias("dim"), F.round("value", 6).alias("value"))


# Groups

SKEWED = "CASE WHEN label < 6 THEN 0 ELSE label - 5 END"


@query(
    f"""WITH RECURSIVE {E}, g AS (SELECT vec_id, {SKEWED} AS c, unnest(v) AS value, generate_subscripts(v, 1) AS dim, label FROM e), m AS (SELECT c, dim, avg(value) AS m FROM g GROUP BY c, dim),
    q AS (SELECT g.vec_id, m.c, round(sum((g.value - m.m) * (g.value - m.m)), 6) AS dist FROM g JOIN m ON m.dim = g.dim GROUP BY g.vec_id, m.c),
    n AS (SELECT count(DISTINCT c) AS k, ceil((SELECT count(*) FROM embeddings) / count(DISTINCT c))::BIGINT AS cap FROM m),
    o AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, c) AS choice FROM q),
    p AS (SELECT *, row_number() OVER (ORDER BY dist, vec_id, choice) AS i FROM o WHERE choice <= 2),
    f AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS placed, [0::BIGINT for x in range(k)] AS held, NULL::BIGINT AS vec_id, NULL::BIGINT AS c, NULL::DOUBLE AS dist FROM n
      UNION ALL SELECT p.i, CASE WHEN y THEN list_append(placed, z.vec_id) ELSE placed END, CASE WHEN y THEN [CASE WHEN j - 1 = z.c THEN held[j] + 1 ELSE held[j] END for j in range(1, k + 1)] ELSE held END, CASE WHEN y THEN z.vec_id END, z.c, z.dist
      FROM (SELECT p.*, placed, held, k, NOT list_contains(placed, p.vec_id) AND held[p.c + 1] < cap AS y FROM f JOIN p ON p.i = f.i + 1, n) z JOIN p ON p.i = z.i),
    done AS (SELECT vec_id, c, dist FROM f WHERE vec_id IS NOT NULL), ends AS (SELECT held FROM f ORDER BY i DESC LIMIT 1),
    l AS (SELECT vec_id, list(c ORDER BY choice) AS cs, list(dist ORDER BY choice) AS ds, row_number() OVER (ORDER BY vec_id) AS i FROM o WHERE vec_id NOT IN (SELECT vec_id FROM done) GROUP BY vec_id),
    h AS (SELECT 0::BIGINT AS i, held, NULL::BIGINT AS vec_id, NULL::BIGINT AS c, NULL::DOUBLE AS dist FROM ends
      UNION ALL SELECT x.i, [CASE WHEN j - 1 = x.t THEN held[j] + 1 ELSE held[j] END for j in range(1, k + 1)], x.vec_id, x.t, x.ds[list_position(x.cs, x.t)]
      FROM (SELECT l.*, held, k, [a for a in cs if held[a + 1] < cap][1] AS t FROM h JOIN l ON l.i = h.i + 1, n) x)
    SELECT vec_id, c::INT AS group_no, dist FROM done UNION ALL SELECT vec_id, c::INT, dist FROM h WHERE vec_id IS NOT NULL"""
)
def soft_cap_assign(spark: SparkSession, d: str) -> DataFrame:
    rows = embeddings(spark, d)
    centers = [list(r["center"]) for r in vectors.centroids(rows.withColumn("g", F.expr(SKEWED)), "embedding", "g").orderBy("g").collect()]
    near = grouping.nearest_centers(rows, "vec_id", "embedding", centers, len(centers))
    return grouping.assign_under_capacity(near.where("choice <= 2"), "vec_id", grouping.capacity(rows.count(), len(centers), 0.0), near)


@query()
def pipeline_kmeans(spark: SparkSession, d: str) -> DataFrame:
    steps = pipeline.Pipeline(Grouping(k=8, tries=2), Plan(rule="close", ratio=75))
    order, _ = pipeline.balanced_order(table(spark, d, "row_features"), "row_id", "features", steps)
    return order


# Texts

AT = "'@@ Instruction' || chr(10) || instruction || chr(10) || chr(10) || '@@ Response' || chr(10)"


@query(f"SELECT DISTINCT row_id, md5({AT}) AS prompt_md5, length({AT}) AS n_chars FROM training_rows WHERE instruction IS NOT NULL")
def format_prompt(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "training_rows").where("instruction IS NOT NULL").select("row_id", text.prompt(F.col("instruction")).alias("p"))
    return rows.select("row_id", F.md5("p").alias("prompt_md5"), F.length("p").cast("long").alias("n_chars")).distinct()


LINES = "regexp_extract_all(content, '[^\\n\\r]*(?:\\r\\n|[\\n\\r])|[^\\n\\r]+$')"


def draw_sql(salt: str, n: str) -> str:
    return f"('0x' || substr(md5('0:' || concat_ws(':', raw_index, '{salt}')), 1, 8))::BIGINT % {n}"


@query(
    f"WITH l AS (SELECT raw_index, {LINES} AS l FROM starcoderdata WHERE content IS NOT NULL), s AS (SELECT raw_index, l, {draw_sql('start', 'greatest(len(l), 1)')} AS a, {draw_sql('length', '15')} + 1 AS n FROM l) SELECT raw_index, coalesce(array_to_string(l[a + 1:a + n], ''), '') AS seed FROM s"
)
def extract_snippet(spark: SparkSession, d: str) -> DataFrame:
    return generation.snippets(table(spark, d, "starcoderdata"), "raw_index", "content")


BREAKS = r"\n\r\x0b\x0c\x1c\x1d\x1e\x85\x{2028}\x{2029}"
PARTED = f"""w AS (SELECT seed_index, openai_fingerprint, '[Problem Description]' || chr(10) || problem || chr(10) || '[Solution] here' || chr(10) || coalesce(solution, '') AS t FROM generated_rows WHERE problem IS NOT NULL),
    l AS (SELECT *, regexp_extract_all(t, '[^{BREAKS}]*(?:\\r\\n|[{BREAKS}])|[^{BREAKS}]+$') AS l FROM w),
    m AS (SELECT *, list_position([contains(lower(x), '[problem description]') for x in l], true) AS p, list_position([contains(lower(x), '[solution]') for x in l], true) AS s FROM l),
    d AS (SELECT seed_index, openai_fingerprint, p > 0 AND s > p AS ok, regexp_replace(array_to_string(l[p + 1:s - 1], ''), '^\\s+|\\s+$', '', 'g') AS problem, regexp_replace(array_to_string(l[s + 1:], ''), '^\\s+|\\s+$', '', 'g') AS solution FROM m)"""


def marked_answers(spark: SparkSession, d: str) -> DataFrame:
    """Problems and solutions between their marks; some of them hold a mark of their own."""
    answer = F.concat(F.lit("[Problem Description]\n"), "problem", F.lit("\n[Solution] here\n"), F.coalesce("solution", F.lit("")))
    return table(spark, d, "generated_rows").where("problem IS NOT NULL").withColumn("answer", answer)


@query(f"WITH {PARTED} SELECT DISTINCT seed_index, problem, solution FROM d WHERE ok")
def parse_sections(spark: SparkSession, d: str) -> DataFrame:
    rows = marked_answers(spark, d).select("seed_index", text.sections(F.col("answer")).alias("s"))
    return rows.where("s IS NOT NULL").select("seed_index", "s.problem", "s.solution").distinct()


@query("SELECT DISTINCT seed_index, substr(sha256(concat(seed_index::VARCHAR, coalesce(openai_fingerprint, 'None'), coalesce(problem, 'None'))), 1, 12) AS print FROM generated_rows")
def fingerprint(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "generated_rows")
    return rows.select("seed_index", text.fingerprint(F.col("seed_index"), F.col("openai_fingerprint"), F.col("problem"), length=12).alias("print")).distinct()


WORD_COUNT = "len([w for w in regexp_split_to_array({0}, '\\s+') if w <> ''])"


@query(f"WITH t AS (SELECT seed_index, {WORD_COUNT.format('seed')} AS n FROM seed_snippets WHERE seed IS NOT NULL) SELECT seed_index, n::INT AS n_tokens, least(40, 64 - n - 10)::INT AS room FROM t WHERE least(40, 64 - n - 10) > 0")
def token_budget_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = tokens.encoded(table(spark, d, "seed_snippets").where("seed IS NOT NULL").select("seed_index", "seed"), "seed", "ids")
    budget = generation.Budget(context=64, answer=40)
    counted = rows.select("seed_index", F.size("ids").alias("n_tokens"))
    return generation.within_budget(counted, "n_tokens", budget).withColumn("room", generation.room(F.col("n_tokens"), budget))


@query(f"WITH i AS (SELECT doc_id, row_number() OVER (ORDER BY md5(concat_ws(':', {SEED}, 'ordinal', doc_id)), doc_id) - 1 AS index FROM documents) SELECT doc_id, index FROM i WHERE index >= 100 AND index < 400")
def doc_shuffle_range(spark: SparkSession, d: str) -> DataFrame:
    return jsonl.window(generation.with_ordinal(table(spark, d, "documents").select("doc_id"), "doc_id", SEED), "index", 100, 400)


@query("SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 100")
def scan_prefix(spark: SparkSession, d: str) -> DataFrame:
    return jsonl.prefix(table(spark, d, "documents").select("doc_id", "source"), "doc_id", 100)


@query("SELECT seed_index FROM seed_snippets WHERE seed_index > coalesce((SELECT max(seed_index) FROM generated_rows WHERE seed_index <= (SELECT max(seed_index) // 2 FROM seed_snippets)), -1)")
def resume_positional(spark: SparkSession, d: str) -> DataFrame:
    """What is left after a run that stopped in the middle of the seeds."""
    seeds = table(spark, d, "seed_snippets").select("seed_index")
    last = seeds.agg(F.max("seed_index")).first()[0] or 0
    return jsonl.remaining_by_position(seeds, table(spark, d, "generated_rows").where(F.col("seed_index") <= last // 2), "seed_index")


@query("SELECT seed_index FROM seed_snippets WHERE seed_index NOT IN (SELECT seed_index FROM generated_rows)")
def resume_anti_join(spark: SparkSession, d: str) -> DataFrame:
    return jsonl.remaining_by_key(table(spark, d, "seed_snippets").select("seed_index"), table(spark, d, "generated_rows"), "seed_index")


@query("SELECT raw_index, seed_index, seed FROM seed_snippets WHERE seed_index % 2 = 0 UNION ALL SELECT raw_index, seed_index, seed FROM seed_snippets WHERE seed_index % 2 = 1")
def jsonl_append(spark: SparkSession, d: str) -> DataFrame:
    """One run writes a part, the next one what is missing; the scan has a given schema."""
    rows, path = table(spark, d, "seed_snippets").select("raw_index", "seed_index", "seed"), scratch(spark, "seeds")
    schema = "raw_index LONG, seed_index LONG, seed STRING"
    jsonl.write(rows.where("seed_index % 2 = 0"), path)
    jsonl.append(jsonl.remaining_by_key(rows, jsonl.read(spark, path, schema), "seed_index"), path)
    return jsonl.read(spark, path, schema)


@query("SELECT doc_id, lang FROM documents WHERE lang IS NOT NULL")
def stream_to_jsonl(spark: SparkSession, d: str) -> DataFrame:
    """The documents as a stream that ends in JSON lines."""
    path, source = scratch(spark, "stream"), f"{d}/documents.parquet"
    schema = spark.read.parquet(source).schema
    # a stream reads folders: the table is one, or a file that stands beside others
    rows = spark.readStream.schema(schema).parquet(source) if _is_folder(spark, source) else spark.readStream.schema(schema).option("pathGlobFilter", "documents.parquet").parquet(d)
    scoring.into_jsonl(rows.where("lang IS NOT NULL").select("doc_id", "lang"), path, scratch(spark, "stream-state")).awaitTermination()
    return jsonl.read(spark, path, "doc_id LONG, lang STRING")


def _is_folder(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory()


@query("SELECT raw_index, 'system' AS first_role, 'user' AS second_role, seed FROM seed_snippets")
def chat_messages(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "seed_snippets").withColumn("m", generation.messages("You write exercises.", F.col("seed")))
    return rows.select("raw_index", F.col("m")[0]["role"].alias("first_role"), F.col("m")[1]["role"].alias("second_role"), F.col("m")[1]["content"].alias("seed"))


HALVES = "h AS (SELECT seed_index, substr(seed, 1, length(seed) // 2) AS a, substr(seed, length(seed) // 2 + 1) AS b FROM seed_snippets)"


@query(
    f"WITH {HALVES} SELECT seed_index, CASE seed_index % 3 WHEN 0 THEN '<fim_prefix>' || a || '<fim_suffix>' || b || '<fim_middle>' WHEN 1 THEN '▁<PRE>' || a || '▁<SUF>' || b || '▁<MID>' ELSE '<｜fim▁begin｜>' || a || '<｜fim▁hole｜>' || b || '<｜fim▁end｜>' END AS prompt FROM h"
)
def infilling_prompt(spark: SparkSession, d: str) -> DataFrame:
    family = F.element_at(F.array(F.lit("starcoder"), F.lit("codellama"), F.lit("deepseek")), (F.col("seed_index") % 3 + 1).cast("int"))
    half = F.floor(F.length("seed") / 2).cast("int")
    return table(spark, d, "seed_snippets").select("seed_index", generation.infilling(family, F.substring("seed", F.lit(1), half), F.substring("seed", half + 1, F.length("seed"))).alias("prompt"))


@query(f"WITH {PARTED} SELECT DISTINCT seed_index FROM d WHERE ok AND openai_fingerprint IS NOT NULL AND length(problem) > 0 AND length(solution) > 0")
def accepted_generations(spark: SparkSession, d: str) -> DataFrame:
    reason = F.when(F.col("openai_fingerprint").isNotNull(), "stop").otherwise("length")
    return generation.accepted(marked_answers(spark, d).select("seed_index", "answer", reason.alias("finish_reason"))).select("seed_index").distinct()


def measured_answers(texts: list[str], most: list[int]) -> list[tuple[str, str]]:
    """A stand-in generator: tells how long its prompt is and how much room it had."""
    return [(f"{len(x)}/{n}", "stop" if n > 100 else "length") for x, n in zip(texts, most, strict=True)]


@query(
    "WITH t AS (SELECT seed_index, length(seed) AS size, len([w for w in regexp_split_to_array(seed, '\\s+') if w <> '']) AS n FROM seed_snippets WHERE seed IS NOT NULL), r AS (SELECT *, least(8192 - n - 1, 200, 8300 - n - 1) AS m FROM t) SELECT seed_index, size || '/' || m AS answer, CASE WHEN m > 100 THEN 'stop' ELSE 'length' END AS finish_reason FROM r"
)
def generated_answers(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "seed_snippets").where("seed IS NOT NULL").select("seed_index", "seed")
    return generation.generated(rows, "seed", measured_answers, FAMILIES["starcoder"].context, Decoding(max_new_tokens=200, max_length=8300)).drop("seed")


@query("SELECT doc_id, md5(text) AS text_md5 FROM documents WHERE text IS NOT NULL")
def token_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Every text as byte pairs of a public vocabulary, with a begin and an end id, and back."""
    path, special = f"{TOKENIZERS}/byte_bpe_50k.tiktoken", tokens.Special(begin=1_000_000, end=1_000_001)
    rows = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "text")
    ids = tokens.encoded(rows, "text", "ids", tokens.byte_pairs(path), begin=special.begin, end=special.end)
    return tokens.decoded(ids.select("doc_id", "ids"), "ids", "back", tokens.from_byte_pairs(path), (special.begin, special.end)).select("doc_id", F.md5("back").alias("text_md5"))


@query(
    "WITH c AS (SELECT doc_id // 32 AS chunk, min(doc_id) AS a, max(doc_id) AS b, max(fetched_at) AS f FROM documents GROUP BY 1) SELECT 'data-docs-' || substr(sha256(chunk::VARCHAR), 1, 5) || '-' || a || '_' || b || coalesce('-' || strftime(f, '%Y%m%d_%H%M%S'), '') || '.jsonl' AS name FROM c"
)
def chunk_files(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "documents").groupBy(text.chunk_of(F.col("doc_id"), 32).alias("chunk")).agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.max("fetched_at").alias("f"))
    return chunks.select(jsonl.output_names("docs", text.fingerprint(F.col("chunk"), length=5), F.col("a"), F.col("b"), text.stamp(F.col("f"))).alias("name"))


@query("SELECT '{\"raw_index\":' || raw_index || ',\"seed_index\":' || seed_index || coalesce(',\"openai_fingerprint\":\"' || openai_fingerprint || '\"', '') || '}' AS line FROM generated_rows")
def record_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "generated_rows").select(text.record_json("raw_index", "seed_index", "openai_fingerprint").alias("line"))


@query("SELECT event_id, ceil(value)::INT AS epochs FROM events")
def whole_epochs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", text.whole_epochs(F.col("value")).alias("epochs"))


@query("SELECT (doc_id // 32)::BIGINT AS chunk, count(*) AS n FROM documents GROUP BY 1")
def chunked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(text.chunk_of(F.col("doc_id"), 32).alias("chunk")).agg(F.count("*").alias("n"))


# Token and label arrays

SPLIT = "[w for w in regexp_split_to_array({0}, '[ \\t\\n\\r\\x0b\\x0c\\x1c-\\x1f\\x85\\xa0\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+') if w <> '']"
IDS = "[16 + ('0x' || substr(md5(w), 1, 7))::INT for w in " + SPLIT + "]"
TRAIN = (
    "t AS (SELECT DISTINCT row_id, "
    + IDS.format(AT)
    + " AS p, "
    + IDS.format("coalesce(response, '')")
    + " AS c FROM training_rows WHERE instruction IS NOT NULL), a AS (SELECT row_id, [1] || p || c || [2] AS ids, [-100 for q in [1] || p] || c || [2] AS labels FROM t)"
)


def tokenized(spark: SparkSession, d: str, most: int) -> DataFrame:
    rows = table(spark, d, "training_rows").select("row_id", "instruction", "response").distinct()
    return tokens.training_rows(rows, "row_id", most)


@query(f"WITH {TRAIN} SELECT row_id, list_sum(ids[:100])::BIGINT AS id_sum, list_sum(labels[:100])::BIGINT AS label_sum, len(ids[:100])::INT AS n, len(ids) > 100 AS exceeding_length FROM a")
def training_map(spark: SparkSession, d: str) -> DataFrame:
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return tokenized(spark, d, 100).select("row_id", total("input_ids").alias("id_sum"), total("labels").alias("label_sum"), F.size("input_ids").alias("n"), "exceeding_length")


@query(f"WITH {TRAIN} SELECT count(*) FILTER (len(ids) > 100) AS n_exceeding, count(*) AS n_rows FROM a")
def truncated_count(spark: SparkSession, d: str) -> DataFrame:
    return tokenized(spark, d, 100).agg(F.sum(F.col("exceeding_length").cast("long")).alias("n_exceeding"), F.count("*").alias("n_rows"))


@query("SELECT row_id, len(input_ids)::INT AS n_ids, len([x for x in labels if x = -100])::INT AS n_ignored FROM tokenized_rows")
def label_mask(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "tokenized_rows").select("row_id", F.size("input_ids").alias("n_ids"), F.size(F.filter("labels", lambda x: x == tokens.IGNORED)).alias("n_ignored"))


def add_padding() -> None:
    for side, form in (("right", "input_ids || [0 for i in range(256 - len(input_ids))]"), ("left", "[0 for i in range(256 - len(input_ids))] || input_ids")):
        register(
            f"pad_{side}",
            lambda s, d, left=side == "left": table(s, d, "tokenized_rows").select("row_id", F.md5(F.array_join(tokens.padded(F.col("input_ids"), 256, 0, left), ",")).alias("padded_md5")),
            f"SELECT row_id, md5(array_to_string({form}, ',')) AS padded_md5 FROM tokenized_rows",
        )


@query(
    """WITH t AS (SELECT row_id, row_id % 16 AS batch, input_ids, labels FROM tokenized_rows), m AS (SELECT batch, max(len(input_ids)) AS size FROM t GROUP BY batch)
    SELECT t.row_id, m.size::INT AS n_ids, len([x for x in t.input_ids if x <> 2])::INT AS n_attended, (m.size - len([x for x in t.labels if x <> -100]))::INT AS n_ignored FROM t JOIN m ON m.batch = t.batch"""
)
def collate_batches(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "tokenized_rows").select("row_id", F.pmod("row_id", F.lit(16)).alias("batch"), "input_ids", "labels")
    padded = tokens.collated(rows, "batch")
    ignored = F.size(F.filter("labels", lambda x: x == tokens.IGNORED))
    return padded.select("row_id", F.size("input_ids").alias("n_ids"), F.size(F.filter("attention_mask", lambda x: x)).alias("n_attended"), ignored.alias("n_ignored"))


@query("SELECT row_id, len([x for x in input_ids if x <> 2])::INT AS n_labels FROM tokenized_rows")
def fallback_labels(spark: SparkSession, d: str) -> DataFrame:
    labels = tokens.labels_of(F.col("input_ids"), 2)
    return table(spark, d, "tokenized_rows").select("row_id", F.size(F.filter(labels, lambda x: x != tokens.IGNORED)).alias("n_labels"))


# Streams: a batch run of the same functions

@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1, 2")
def events_by_window(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").where("ts IS NOT NULL").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return rows.select(F.col("w.start").alias("start"), "event_type", "n")


#: Events after this moment, and every tenth one of those before, reach the stream late, in its second run.
LATE = "TIMESTAMP '2024-01-08 00:00:00'"
SECOND = f"(ts >= {LATE} OR event_id % 10 = 0)"


@query(
    f"""WITH a AS (SELECT *, NOT {SECOND} AS first, time_bucket(INTERVAL '1 hour', ts) AS start FROM events WHERE ts IS NOT NULL), w AS (SELECT max(ts) FILTER (first) - INTERVAL '3 hours' AS one, max(ts) - INTERVAL '3 hours' AS two FROM a)
    SELECT start, event_type, count(*) AS n FROM a, w WHERE (first OR one IS NULL OR start + INTERVAL '1 hour' > one) AND start + INTERVAL '1 hour' <= two GROUP BY 1, 2"""
)
def late_events(spark: SparkSession, d: str) -> DataFrame:
    """Windows of a stream that is stopped and goes on: rows that are later than the watermark of the first run are left out."""
    source, path, state = scratch(spark, "events"), scratch(spark, "windows"), scratch(spark, "windows-state")
    rows = table(spark, d, "events").where("ts IS NOT NULL").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    for part in (rows.where(f"NOT {SECOND}"), rows.where(SECOND)):
        part.write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.schema).parquet(source)
        windows = scoring.sizes_by_window(stream, "ts", "1 hour", "3 hours", "event_type")
        scoring.into_jsonl(windows.select(F.col("window.start").alias("start"), "event_type", "n"), path, state).awaitTermination()
    return jsonl.read(spark, path, "start TIMESTAMP, event_type STRING, n LONG").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(
    f"""WITH {E}, {C}, q AS (SELECT x.vec_id, c.label, round(sum((x.value - c.m) * (x.value - c.m)), 6) AS dist FROM x JOIN c ON c.dim = x.dim GROUP BY x.vec_id, c.label)
    SELECT vec_id, label AS group_no, dist FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, label) AS k FROM q) WHERE k = 1"""
)
def score_rows(spark: SparkSession, d: str) -> DataFrame:
    return scoring.scored(embeddings(spark, d), "embedding", first_centers(spark, d)).select("vec_id", "group_no", "dist")


add_selections()
add_row_weights()
add_orders()
add_padding()
