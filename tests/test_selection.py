import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from granary.operators import ordering, selection, weights
from granary.operators.selection import Plan


def rows(spark, sizes, dist=lambda g, i: float(i)):
    data = [(g * 1000 + i, g, dist(g, i)) for g, n in enumerate(sizes) for i in range(n)]
    return spark.createDataFrame(data, "id long, g int, dist double")


def kept(spark, plan, sizes=(4, 6, 9), **more):
    out = selection.selected(rows(spark, sizes, **more), "id", "g", "dist", plan).collect()
    found = {}
    for r in out:
        found.setdefault(r["g"], []).append(r["id"] % 1000)
    return {g: sorted(x) for g, x in found.items()}


@pytest.mark.parametrize(
    ("rule", "last"), [("far", [0, 1, 2]), ("close", [6, 7, 8]), ("mix", [0, 7, 8])]
)
def test_rules_name_what_is_thrown_away(spark, rule, last):
    found = kept(spark, Plan(rule=rule, ratio=75))
    assert {g: len(x) for g, x in found.items()} == {0: 3, 1: 3, 2: 3}
    assert found[2] == last


def test_ties_go_by_id(spark):
    assert kept(spark, Plan(rule="far", ratio=50), dist=lambda g, i: 1.0)[2] == [0, 1]
    assert kept(spark, Plan(rule="close", ratio=50), dist=lambda g, i: 1.0)[2] == [7, 8]


@pytest.mark.parametrize("rule", ["far", "close", "mix", "rand", "big"])
def test_nothing_is_kept_where_the_plan_keeps_no_row(spark, rule):
    assert kept(spark, Plan(rule=rule, ratio=10)) == {}
    assert kept(spark, Plan(rule=rule, micro=8, drop_last=True)) == {}


def test_empty_and_null_rows(spark):
    empty = spark.createDataFrame([], "id long, g int, dist double")
    assert selection.selected(empty, "id", "g", "dist", Plan()).count() == 0
    odd = spark.createDataFrame([(1, None, 1.0), (None, 0, 1.0), (2, 0, None), (3, 0, 2.0)], "id long, g int, dist double")
    assert [r["id"] for r in selection.selected(odd, "id", "g", "dist", Plan()).collect()] == [3]


def test_unknown_names_are_refused(spark):
    with pytest.raises(ValueError):
        selection.selected(rows(spark, (2,)), "id", "g", "dist", Plan(rule="other"))
    with pytest.raises(ValueError):
        weights.mode_weight(None, "other")


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 500), st.integers(0, 100), st.integers(1, 20), st.booleans())
def test_kept_size(least, ratio, micro, drop_last):
    m = Plan(ratio=ratio, micro=micro, drop_last=drop_last).keep(least)
    assert 0 <= m <= least * ratio // 100 and (not drop_last or m % micro == 0)


def test_interleaving_skips_exhausted_groups(spark):
    slots = selection.selected(rows(spark, (1, 3, 2)), "id", "g", "dist", Plan(rule="none"))
    order = ordered_groups(ordering.ordered(slots, "g", "interleaved", "id"))
    assert order == [0, 1, 2, 1, 2, 1]
    assert ordered_groups(ordering.ordered(slots, "g", "seq", "id")) == [0, 1, 1, 1, 2, 2]
    assert sorted(r["pos"] for r in ordering.ordered(slots, "g", "rand", "id").collect()) == list(range(6))


def ordered_groups(df):
    return [r["g"] for r in df.orderBy("pos").collect()]


def test_equal_groups_put_worker_and_group_together(spark):
    kept_rows = selection.selected(rows(spark, (8, 12, 20)), "id", "g", "dist", Plan())
    placed = ordering.ordered(kept_rows, "g", "interleaved", "id").collect()
    assert all(r["pos"] % 3 == r["g"] for r in placed)
    moved = ordering.epoch_order(ordering.ordered(kept_rows, "g", "interleaved", "id"), 3, 1, 2, "id").collect()
    assert sorted(r["new_pos"] for r in moved) == list(range(24)) and all(r["new_pos"] % 3 == r["pos"] % 3 for r in moved)


def test_oversampling_fills_up_to_the_largest(spark):
    out = selection.oversampled(rows(spark, (2, 5, 0, 7)), "id", "g", Plan()).collect()
    sizes = {}
    for r in out:
        sizes[r["g"]] = sizes.get(r["g"], 0) + 1
        assert r["id"] // 1000 == r["g"]
    assert sizes == {0: 7, 1: 7, 3: 7}
    assert sum(r["copy"] for r in out) == 7


def test_weights_have_mean_one(spark):
    sizes = weights.group_sizes(rows(spark, (2, 6, 12)), "g")
    found = [r["rank_weight"] for r in weights.rank_weights(sizes, "g").collect()]
    assert abs(sum(found) / 3 - 1) < 1e-12
    picked = selection.selected(rows(spark, (2, 6, 12)), "id", "g", "dist", Plan(rule="none"))
    for mode in weights.MODES:
        values = [r["row_weight"] for r in weights.row_weights(picked, sizes, "g", mode).collect()]
        assert abs(sum(values) / len(values) - 1) < 1e-9


def test_farthest_first(spark):
    data = [(1, 0, [0.0, 0.0]), (2, 0, [5.0, 0.0]), (3, 0, [4.9, 0.0]), (4, 0, [0.0, 3.0]), (5, 0, None), (6, 1, [0.0, 0.0]), (7, 1, [0.0, 0.0])]
    df = spark.createDataFrame(data, "id long, g int, v array<double>")
    out = {(r["g"], r["step"]): r["id"] for r in selection.farthest_first(df, "id", "g", "v", 3).collect()}
    assert out[(0, 1)] == 2 and out[(0, 2)] == 4 and {out[(1, 1)], out[(1, 2)]} == {6, 7} and (1, 3) not in out
    in_place = selection.farthest_first(df, "id", "g", "v", 3, most=2)
    assert {(r["g"], r["step"]): r["id"] for r in in_place.collect()} == out
