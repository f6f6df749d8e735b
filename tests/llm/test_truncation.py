import random

import numpy as np

from granary.llm import truncation

NOUNS = "parcel window garden ticket sensor vector bundle ledger".split()


def sentence(rng):
    n = lambda: rng.choice(NOUNS)
    return rng.choice(
        [
            lambda: f"Every call to the {n()} returns a new {n()}, never the old {n()}",
            lambda: f"Keep the {n()} stale and let the reviewer decide about the sorted list",
            lambda: f"Taking one {n()} together with another may lead to frequent thirst",
            lambda: f"After {rng.randrange(900)} rounds the {n()} is compared with the error handler",
        ]
    )()


def text(rng):
    return ". ".join(sentence(rng) for _ in range(rng.randrange(3, 9))) + "."


def test_limits_are_found_where_lengths_pile_up():
    rng = np.random.default_rng(1)
    free = np.exp(rng.normal(6, 0.5, 800)).astype(int)
    cut = np.minimum(np.exp(rng.normal(6, 0.5, 800)).astype(int), 500)
    assert truncation.limits_of(*np.unique(free, return_counts=True), 12.0) == []
    found = truncation.limits_of(*np.unique(cut, return_counts=True), 12.0)
    assert [x for x, _ in found] == [500] and found[0][1] > 0.9
    assert truncation.limits_of(np.array([0, 3]), np.array([50, 2]), 12.0) == []


def test_cuts_are_told_from_endings(spark):
    rng = random.Random(2)
    whole = [text(rng) for _ in range(1500)]
    data, cut = [], set()
    for i, t in enumerate(whole):
        if i % 10 == 0:
            k = t.rfind(". ", 0, len(t) - 2) + 2 + rng.randrange(8, 20)
            t = t[:k].rstrip()
            cut.add(i)
        elif i % 10 == 1:
            t = t[:-1]
        elif i % 10 == 2:
            t = "O(1)"
        data.append((i, t, "s"))
    data += [(5000, None, "s"), (5001, "", None), (5002, "Look:\n\n```python\nx = (1 +", None), (5003, "a " * 50000 + "end.", "s"), (5004, whole[0][:60] + " [truncated]", "s")]
    df = spark.createDataFrame(data, "id long, t string, source string")
    model = truncation.fit(df.selectExpr("coalesce(t, '') AS text"), truncation.Settings(sample=1500))
    limits = truncation.length_limits(truncation.lengths_of(df, "id", "t", "source"))
    out = {r["id"]: r["cut"] for r in truncation.truncated(df, "id", "t", "source", model, limits).collect()}
    assert len(out) == len(data) and not (out[5000] or out[5001] or out[5003]) and out[5002] and out[5004]
    said = {i for i, c in out.items() if c and i < 5000}
    assert len(said & cut) >= 0.97 * len(cut) and len(said - cut) <= 0.01 * len(whole)


def test_limit_and_ending_meet(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(text(rng) for _ in range(3))[:400], "cut") for i in range(400)] + [(1000 + i, text(rng), "free") for i in range(400)]
    df = spark.createDataFrame(rows, "id long, t string, source string")
    limits = truncation.length_limits(truncation.lengths_of(df, "id", "t", "source")).collect()
    assert {(r["source"], r["unit"], r["length"]) for r in limits} >= {("cut", "chars", 400)} and all(r["source"] == "cut" for r in limits)


def test_tokens(spark):
    rows = [(i, [1] + [5] * (i % 30) + [2]) for i in range(60)] + [(100, [1, 5, 6]), (101, []), (102, None)]
    df = spark.createDataFrame(rows, "id long, ids array<int>")
    assert {r["id"] for r in truncation.truncated_tokens(df, "id", "ids", 2).where("cut").collect()} == {100}


def test_empty_table(spark):
    df = spark.createDataFrame([], "id long, t string, source string")
    model = truncation.fit(df.selectExpr("t AS text"))
    limits = truncation.length_limits(truncation.lengths_of(df, "id", "t", "source"))
    assert truncation.truncated(df, "id", "t", "source", model, limits).count() == 0


def test_one_text_in_many_rows_is_drawn_once(spark):
    rng = random.Random(4)
    rows = [(text(rng),) for _ in range(300)] + [("The same parcel stands in very many rows of this table and counts once.",)] * 3000
    df = spark.createDataFrame(rows, "text string")
    for size in (50, 5000):
        drawn = truncation.distinct_sample(df, truncation.Settings(sample=size))
        assert len(drawn) == len(set(drawn)) == min(size, len({r[0] for r in rows if len(r[0]) >= 60}))


def test_the_sample_does_not_grow_with_the_tasks(spark):
    df = spark.range(100_000).selectExpr("concat('The parcel of number ', id, ' waits in the old window of the garden today') AS text")
    sizes = {n: truncation.lowest_texts(df.repartition(n), truncation.Settings(sample=1000)).count() for n in (4, 64)}
    assert sizes[4] == sizes[64] and 1000 <= sizes[4] <= 1400
    assert len(truncation.distinct_sample(df, truncation.Settings(sample=1000))) == 1000


def test_short_sentences_are_judged_where_their_end_is_known(spark):
    rng = random.Random(6)
    texts = [text(rng) + " The buffer then moves to the left side of the garden." for _ in range(400)]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "id long, t string, source string")
    model = truncation.fit(df.selectExpr("t AS text"), truncation.Settings(sample=400))
    odds, learned, bound = truncation.ending_odds(["The buffer then moves t", "The buffer then moves to", "O(n log n)", "Yes", "So it is all done now"], model)
    assert (odds[:2] > 2).all() and learned[:2].all() and not bound[:2].any()
    assert bound[2:].all() and not learned[2:].any()


def test_ends_and_lengths_of_sequences_meet(spark):
    rows = [(i, [1] + [5] * (3 + i % 40) + [2]) for i in range(200)] + [(1000 + i, [1] + [5] * 49) for i in range(60)] + [(2000, [1] + [5] * 48 + [2]), (2001, [5, 5])]
    df = spark.createDataFrame(rows, "id long, ids array<int>")
    out = {r["id"]: r for r in truncation.truncated_tokens(df, "id", "ids", 2).collect()}
    assert {i for i, r in out.items() if r["cut"]} == {*range(1000, 1060), 2001}
    assert out[1000]["censored"] > 0.5 and out[1000]["cut_odds"] > out[2001]["cut_odds"] and out[2000]["cut_odds"] > out[0]["cut_odds"]


def test_shares_of_cuts_come_from_all_rows_by_source(spark):
    rows = [(s, 3.0 if i % 100 < share else -3.0) for s, share in (("many", 70), ("few", 5)) for i in range(4000)]
    df = spark.createDataFrame(rows, "source string, odds double")
    found = {r["source"]: r["share"] for r in truncation.source_shares(df).collect()}
    assert 0.65 < found["many"] < 0.76 and found["few"] < 0.06


def test_short_texts_and_final_marks_are_cut_by_marks_fences_and_limits(spark):
    model = truncation.Model(truncation.arrays.pack(np.zeros(truncation.COUNTERS, dtype=np.int32)), np.zeros(1 + 10 + 2 + 10), 0.0)
    data = [(1, "这个函数读取 [truncated]", "a"), (2, "```python\nx = (1", "a"), (3, "O(1)", "a"), (4, "x" * 10 + " y" * 5, "b"), (5, "这个函数读取文件然后返回列表中的每一个值", "b")]
    data += [(6, "It holds since the parcel is version 3.", "c"), (7, "It holds since the parcel is version 3.", "d"), (8, "It holds because the parcel is garden.", "e"), (9, "Fine\n3", "a")]
    df = spark.createDataFrame(data, "id long, t string, source string")
    limits = spark.createDataFrame([("b", "chars", 20, 0.997), ("c", "chars", 39, 0.997), ("e", "chars", 38, 0.997)], "source string, unit string, length long, censored double")
    assert {r["id"] for r in truncation.truncated(df, "id", "t", "source", model, limits).where("cut").collect()} == {1, 2, 4, 5, 6}
