import random

import pytest

from granary.llm.neardup import Alike, NearDuplicates, components

WORDS = [f"w{i}" for i in range(60)]


def texts(n, seed=3):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        if out and rng.random() < 0.6:
            w = rng.choice(out).split()
            for _ in range(rng.randrange(0, 6)):
                k = rng.randrange(len(w))
                w[k : k + rng.randrange(2)] = [rng.choice(WORDS)] * rng.randrange(2)
            out.append(" ".join(w or ["x"]))
        else:
            out.append(" ".join(rng.choices(WORDS, k=rng.randrange(1, 30))))
    return out


def brute(rows, n, share):
    sets = {i: {tuple(t.split()[k : k + n]) for k in range(len(t.split()) - n + 1)} for i, t in rows}
    ids = sorted(sets)
    return {
        (a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) * 100 >= share * len(sets[a] | sets[b])
    }


@pytest.mark.parametrize(("n", "share", "hot"), [(2, 70, 8192), (2, 70, 4), (3, 80, 8192)])
def test_pairs_equal_brute_force(spark, n, share, hot):
    rows = list(enumerate(texts(160)))
    df = spark.createDataFrame([(i, t, None, "x") for i, t in rows] + [(0, rows[0][1], None, "y")], "id long, a string, b string, text string")
    found = NearDuplicates(df, "id", ["a", "b"], Alike(shingle=n, threshold=share / 100, hot=hot, postings_per_tree=200, fan_out=3)).pairs()
    assert {(r["id_a"], r["id_b"]) for r in found.collect()} == brute(rows, n, share)


@pytest.mark.parametrize(("n", "share", "common", "hot"), [(2, 70, 2, 8192), (2, 70, 2, 4), (1, 50, 0, 8192), (2, 80, 8, 8192), (1, 40, 2, 8192)])
def test_pairs_of_common_tokens_miss_nothing(spark, n, share, common, hot):
    rows = list(enumerate(texts(160)))
    df = spark.createDataFrame(rows, "id long, a string")
    found = NearDuplicates(df, "id", ["a"], Alike(shingle=n, threshold=share / 100, common=common, hot=hot, postings_per_tree=200, fan_out=3)).pairs()
    assert {(r["id_a"], r["id_b"]) for r in found.collect()} == brute(rows, n, share)


def met(n, common):
    """Pairs of records a record that meet in a tree, of n texts over one small vocabulary."""
    import numpy as np

    from granary.llm import arrays, neardup

    a, rng = Alike(shingle=1, threshold=0.7, common=common), random.Random(4)
    sets = neardup.token_sets([" ".join(rng.choices(WORDS + [f"v{i}" for i in range(240)], k=60)) for _ in range(n)], 1)
    count = lambda tokens: np.bincount((tokens & np.uint64(a.least_slots - 1)).astype(np.int64), minlength=a.least_slots).astype(np.uint32)
    counts = count(sets.token)
    held = (counts > common)[(sets.token & np.uint64(a.least_slots - 1)).astype(np.int64)]
    joint = count(neardup.neighbours(sets.row[held], sets.token[held])[1])
    token = neardup.postings(sets, counts, arrays.MOST, a, joint, common)[0]
    return (np.unique(token, return_counts=True)[1].astype(float) ** 2).sum() / 2 / n


def test_trees_stay_small_where_the_vocabulary_is_used_up():
    assert met(4000, 1 << 30) > 5 * met(4000, 100)


def test_groups_are_components(spark):
    rows = list(enumerate(texts(80, 5)))
    df = spark.createDataFrame(rows, "id long, t string")
    out = {r["id"]: r["group_id"] for r in NearDuplicates(df, "id", ["t"], Alike(shingle=2, threshold=0.7)).groups().collect()}
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in sorted(brute(rows, 2, 70)):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert out == {i: find(i) for i, t in rows if len(t.split()) > 1}


def test_odd_rows(spark):
    none = spark.createDataFrame([], "id long, t string")
    assert NearDuplicates(none, "id", ["t"]).pairs().count() == 0
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "one"), (4, "one"), (None, "a b c"), (5, "a b c " * 4000), (6, "a b c " * 4000)], "id long, t string")
    found = NearDuplicates(odd, "id", ["t"], Alike(shingle=2, threshold=0.7)).pairs().collect()
    assert [(r["id_a"], r["id_b"]) for r in found] == [(5, 6)]


def test_components_of_a_long_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    out = {r["node"]: r["root"] for r in components(chain, "a", "b").collect()}
    assert out == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_a_group_of_copies_counts_once_in_a_task():
    from granary.llm import neardup

    sets = neardup.token_sets(["a b c", "x y z", "a b c", "A, b c!"], 2)
    seen = set()
    assert neardup.unseen(sets, seen).tolist() == [True, True, False, False]
    assert neardup.unseen(sets, seen).tolist() == [False] * 4


def test_few_postings_are_repeated_at_any_size():
    """The same records with all counts a thousand times and more as large: what is split follows the mean."""
    import numpy as np

    from granary.llm import neardup

    a = Alike(shingle=2, threshold=0.7, least_slots=1 << 14)
    rng = random.Random(2)
    common = [f"c{i}" for i in range(4)]
    sets = neardup.token_sets([" ".join(rng.choice(common) if rng.random() < 0.3 else f"r{rng.randrange(3000)}" for _ in range(40)) for _ in range(2000)], 2)
    counts = np.bincount((sets.token & np.uint64(a.least_slots - 1)).astype(np.int64), minlength=a.least_slots)
    plain = len(neardup.postings(sets, counts.astype(np.uint32), 1 << 40, a)[0])
    for scale in (1, 1000, 10_000):
        scaled = (counts * scale).astype(np.uint32)
        sent = len(neardup.postings(sets, scaled, neardup.hot_bound(scaled, a), a)[0])
        assert plain <= sent < 2 * plain


def test_bitmaps_and_counters(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from granary.llm import arrays

    keys = spark.range(0, 500).select(F.xxhash64("id").alias("key"))
    held = arrays.key_bitmap(keys, 1 << 20)
    mine = np.array([r["key"] for r in keys.collect()])
    assert arrays.in_bitmap(held, mine).all() and arrays.in_bitmap(held, np.arange(1000) * 7919).sum() < 10
    full = lambda batches: (np.full(b.num_rows, 3) for b in batches)
    assert arrays.slot_sums(spark.range(100), full, 8).tolist() == [0, 0, 0, 100, 0, 0, 0, 0]
    assert arrays.power_above(5, 2, 64) == 8 and arrays.power_above(500, 2, 64) == 64 and arrays.power_above(0, 2, 64) == 2
