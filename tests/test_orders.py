"""Orders and samplers against plain Python versions of their definitions."""

import random

from pyspark.sql import functions as F

from granary.functions import ranks, tokens
from granary.operators import generation, ordering
from granary.sources.registry import Decoding


def test_positions_of_skewed_and_tied_rows(spark):
    rng = random.Random(3)
    data = [(i, 7 if rng.random() < 0.6 else rng.randrange(-(10**12), 10**12)) for i in range(500)] + [(900, None)]
    df = spark.createDataFrame(data, "id long, v long").repartition(7)
    out = ranks.positions(df, "v", F.col("id").desc()).collect()
    wanted = sorted(data, key=lambda r: (r[1] is not None, r[1] or 0, -r[0]))
    assert {r["id"]: r["pos"] for r in out} == {r[0]: k for k, r in enumerate(wanted)}
    grouped = ranks.in_groups(df.withColumn("g", F.when(F.col("v") == 7, 1)), "g", "id").collect()
    for g in (1, None):
        own = sorted((r for r in grouped if r["g"] == g), key=lambda r: r["id"])
        assert [r["_rank"] for r in own] == list(range(1, len(own) + 1)) and {r["_n"] for r in own} == {len(own)}


def test_no_rows_have_no_places(spark):
    empty = spark.createDataFrame([], "id long, g int")
    assert ranks.positions(empty, "id").count() == 0 and ranks.in_groups(empty, "g", "id").count() == 0


def test_each_batch_mixes_the_parts(spark):
    rows = [(i, random.Random(i).randrange(50)) for i in range(75)]
    df = spark.createDataFrame(rows, "id long, size int")
    out = ordering.ratio_batches(df, "id", "size", [1, 2], 4, 9).orderBy("pos").collect()
    assert [r["pos"] for r in out] == list(range(72))
    for r in out:
        assert r["batch_no"] == r["pos"] // 12 and r["part"] == (r["pos"] % 12 >= 4) and r["part"] == (r["id"] % 3 >= 1)
    # one order of the blocks holds for all parts: block k of either part stands at the same turn
    by_part = {p: [r["id"] for r in out if r["part"] == p] for p in (0, 1)}
    ranked = {p: sorted((i for i, _ in rows if (i % 3 >= 1) == bool(p)), key=lambda i: (-rows[i][1], i % 3, i)) for p in (0, 1)}
    turns = [[ranked[0].index(i) for i in by_part[0]], [ranked[1].index(i) // 2 for i in by_part[1]][::2]]
    assert turns[0] == turns[1]


def test_a_worker_that_lacks_a_row_repeats_its_own_last_one(spark):
    order = spark.range(10).withColumn("pos", F.col("id"))
    for rank in range(4):
        found = [r["pos"] for r in ordering.shard(order, 4, rank, drop_last=False).orderBy("pos").collect()]
        assert found == sorted([*range(rank, 10, 4)] + ([rank + 4] if rank >= 2 else []))
    assert [r["pos"] for r in ordering.shard(spark.range(2).withColumn("pos", F.col("id")), 4, 3, drop_last=False).collect()] == [1]


def test_a_subset_is_numbered_again(spark):
    order = spark.range(9).withColumn("pos", 8 - F.col("id"))
    out = ordering.active(order, spark.createDataFrame([(1,), (1,), (7,), (8,), (50,)], "id long"), "id").collect()
    assert {r["id"]: r["pos"] for r in out} == {8: 0, 7: 1, 1: 2}


def test_marks_are_put_around_what_a_cut_leaves(spark):
    df = spark.createDataFrame([("a b c",), (None,)], "t string")
    out = [r["ids"] for r in tokens.encoded(df, "t", "ids", most=2, begin=1, end=2).collect()]
    assert out[0] == [1, *tokens.word_ids(["a b"])[0], 2] and out[1] == [1, 2]
    names = {1: "<s>", 5: "five", 6: "six"}
    ids = spark.createDataFrame([([1, 5, 6],), ([],), (None,)], "i array<int>")
    decode = lambda many: [" ".join(names[i] for i in x) for x in many]
    assert [r["t"] for r in tokens.decoded(ids, "i", "t", decode, skip=(1,)).collect()] == ["five six", "", None]


def test_a_prompt_that_fills_the_context_is_refused(spark):
    df = spark.createDataFrame([("a b c",)], "prompt string")
    echo = lambda texts, most: [(str(m), "stop") for m in most]
    assert generation.generated(df, "prompt", echo, 6, Decoding(max_new_tokens=9)).first()["answer"] == "2"
    try:
        generation.generated(df, "prompt", echo, 4).collect()
    except Exception as error:
        assert "fills the context" in str(error)
    else:
        raise AssertionError("not refused")
