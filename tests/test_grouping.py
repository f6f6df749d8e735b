import random

from granary.functions import vectors
from granary.operators import grouping
from granary.operators.grouping import Grouping
from granary.plans import pipeline
from granary.streaming import scoring


def greedy(dist, cap, near):
    """Visits pairs by distance, id and candidate; leftovers in id order take the nearest center with room."""
    n, k = len(dist), len(dist[0])
    order = {i: sorted(range(k), key=lambda c: (dist[i][c], c)) for i in range(n)}
    room, placed = [cap] * k, {}
    for _, i, c in sorted((dist[i][c], i, c) for i in range(n) for c in order[i][:near]):
        if i not in placed and room[c]:
            placed[i], room[c] = c, room[c] - 1
    for i in range(n):
        if i not in placed:
            c = next(c for c in order[i] if room[c])
            placed[i], room[c] = c, room[c] - 1
    return placed


def test_rounds_of_proposals_equal_the_greedy_order(spark):
    rng = random.Random(5)
    for near, cap in ((1, 4), (2, 5)):
        dist = [[round(rng.random() ** (1 + c), 1) for c in range(4)] for _ in range(16)]
        data = [(i, p + 1, c, dist[i][c]) for i in range(16) for p, c in enumerate(sorted(range(4), key=lambda c: (dist[i][c], c)))]
        every = spark.createDataFrame(data, "id long, choice int, group_no int, dist double")
        out = grouping.assign_under_capacity(every.where(f"choice <= {near}"), "id", cap, every).collect()
        found = {r["id"]: r["group_no"] for r in out}
        assert len(out) == 16 and found == greedy(dist, cap, near)


def test_skewed_groups_are_assigned_under_a_capacity(spark):
    rng = random.Random(1)
    data = [(i, [rng.gauss(0, 0.1) + (9.0 if i % 12 == 0 else 0.0), rng.gauss(0, 0.1)]) for i in range(120)] + [(999, None)]
    df = spark.createDataFrame(data, "id long, v array<double>")
    out = grouping.grouped(df, "id", "v", Grouping(k=2, tries=1)).collect()
    sizes = [sum(r["group_no"] == c for r in out) for c in (0, 1)]
    assert len(out) == 120 and max(sizes) <= grouping.capacity(120, 2, 0.5)


def test_pipeline_covers_each_row_once(spark):
    df = spark.createDataFrame([(i, [float(i % 3), float(i % 5)]) for i in range(60)], "id long, v array<double>")
    order, weight = pipeline.balanced_order(df, "id", "v", pipeline.Pipeline(Grouping(k=1)))
    assert [r["pos"] for r in order.orderBy("id").collect()] == list(range(60)) and weight.first()["rank_weight"] == 1.0
    order, weight = pipeline.balanced_order(df, "id", "v", pipeline.Pipeline(Grouping(k=3, tries=1)))
    rows = order.collect()
    assert sorted(r["pos"] for r in rows) == list(range(len(rows))) and all(r["pos"] % 3 == r["group_no"] for r in rows)
    assert len({r["id"] for r in rows}) == len(rows) and abs(sum(r["rank_weight"] for r in weight.collect()) - 3) < 1e-9


def test_scores_of_new_rows(spark):
    df = spark.createDataFrame([(1, [0.0, 0.9]), (2, [3.0, 0.0]), (3, None)], "id long, v array<double>")
    out = {r["id"]: (r["group_no"], r["dist"]) for r in scoring.scored(df, "v", [[0.0, 0.0], [3.0, 1.0]]).collect()}
    assert out == {1: (0, 0.81), 2: (1, 1.0)}


def test_vectors(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0], [6.0, 8.0]), (2, [0.0, 0.0], [1.0, 0.0])], "id long, a array<double>, b array<double>")
    fit = vectors.best_scale("a", "b")
    out = df.select("id", vectors.normalized("a").alias("n"), vectors.norm("a").alias("l"), *[c.alias(k) for k, c in fit.items()]).orderBy("id").collect()
    assert out[0]["n"] == [0.6, 0.8] and out[0]["l"] == 5.0 and abs(out[0]["factor"] - 2) < 1e-12 and abs(out[0]["explained"] - 1) < 1e-9
    assert out[1]["n"] == [0.0, 0.0] and (out[1]["factor"], out[1]["remains"], out[1]["cosine"]) == (0.0, 1.0, 0.0)


def test_matrix_and_expressions_give_the_same_centers(spark, monkeypatch):
    rng = random.Random(8)
    df = spark.createDataFrame([(i, [round(rng.random(), 1) for _ in range(3)]) for i in range(200)] + [(900, None)], "id long, v array<double>")
    centers = [[round(rng.random(), 1) for _ in range(3)] for _ in range(9)] + [[0.5, 0.5, 0.5]] * 2
    plain = grouping.nearest_centers(df, "id", "v", centers, 3)
    monkeypatch.setattr(grouping, "EXPRESSION_NUMBERS", 0)
    assert sorted(grouping.nearest_centers(df, "id", "v", centers, 3).collect()) == sorted(plain.collect())
