import re
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.llm.repetition import Risk, cutoffs, heavy, repeated_shares, repetition, upper_bound

CASES = [None, "", "  ", "a b c", "a b c d a b c d", "x 1 y 2 x 7 y 9 z", "中文中文中文中文中文", "one two three four " * 50, "a b c d e f g h i j"]


def brute(text):
    w = [re.sub(r"\d+", "0", x) for x in re.findall(r"[぀-ヿ一-鿿]|[^\W_぀-ヿ一-鿿]+", (text or "").lower())]
    seen, inside = set(), set()
    for k in range(len(w) - 3):
        run = tuple(w[k : k + 4])
        if run in seen:
            inside |= set(range(k, k + 4))
        seen.add(run)
    return len(w), len(inside)


def test_shares_equal_brute_force():
    total, _, covered = repeated_shares([x or "" for x in CASES])
    assert list(zip(total.tolist(), covered.tolist(), strict=True)) == [brute(x) for x in CASES]


def test_bound_is_exact():
    for errors, trials in ((0, 50), (3, 200), (10, 40)):
        p = upper_bound(errors, trials, 0.05)
        assert abs(sum(comb(trials, k) * p**k * (1 - p) ** (trials - k) for k in range(errors + 1)) - 0.05) < 1e-6
    assert upper_bound(5, 5, 0.05) == 1.0


def test_only_texts_over_their_cutoff_get_the_exact_measure():
    texts = ["a b c d e f", "a b c d " * 3, "u v w x y z " * 2]
    total, repeats, covered = repeated_shares(texts, 4, np.array([0.0, 0.2, 0.9]))
    assert covered.tolist() == [0, 8, -1] and repeats.tolist() == repeated_shares(texts)[1].tolist()


def stratified(spark):
    texts = [f"word{i} " * (1 + i % 9) + " ".join(f"u{i}x{k}" for k in range(8)) for i in range(900)]
    return spark.createDataFrame([(i, x, "EN" if i % 2 else None) for i, x in enumerate(texts)] + [(2000, None, "rare"), (2001, "a b c d " * 9, "rare")], "id long, response string, lang string")


def test_cutoffs_never_lose_a_heavy_document(spark):
    df = stratified(spark)
    rows, risk = repetition(df, "id", "response", ["lang"]).cache(), Risk(rate=0.05)
    chosen = cutoffs(df, "id", "response", ["lang"], risk=risk)
    by = {r["stratum"]: r for r in chosen.collect()}
    assert set(by) == {"", "en", "rare"} and by["rare"]["cutoff"] == risk.lowest(4) == 0.125
    assert all(r["cutoff"] == 0.125 or (r["rejection_bound"] <= 0.05 and not r["missed"]) for r in by.values())
    found = {r["id"] for r in heavy(repetition(df, "id", "response", ["lang"], chosen=chosen, risk=risk), risk).collect()}
    assert found == {r["id"] for r in rows.collect() if r["n_words"] and 2 * r["n_covered"] >= r["n_words"]} and 2001 in found


LOW = [9002]  # an id that a draw of two thirds of the rows by its hash would leave out


def test_cutoffs_count_every_row(spark):
    """A stratum of 6 000 rows, where one heavy text has the lowest score that a heavy text can have."""
    fresh = lambda i, k: " ".join(f"u{i}x{j}z" for j in range(k))
    texts = [fresh(i, 10) + " a b c d" * 4 if i % 10 == 0 else fresh(i, 20) + " a b c d" * 3 if i % 10 == 1 else fresh(i, 6) for i in range(6000)]
    digitless = ["".join(chr(97 + int(c)) if c.isdigit() else c for c in x) for x in texts]
    runs = [" ".join(f"{w}{chr(97 + k)}" for w in ("p", "q", "r", "s")) for k in range(8)]
    low = " ".join(runs + runs[::-1])
    df = spark.createDataFrame([*enumerate(digitless), *((i, low) for i in LOW)], "id long, t string")
    chosen = cutoffs(df, "id", "t").collect()
    assert [r["n_clean"] + r["n_heavy"] for r in chosen] == [6000 + len(LOW)]
    found = {r["id"] for r in heavy(repetition(df, "id", "t", chosen=cutoffs(df, "id", "t"))).collect()}
    exact = {r["id"] for r in heavy(repetition(df, "id", "t")).collect()}
    assert found == exact and set(LOW) <= found


def test_a_cutoff_decides_which_rows_are_measured(spark):
    df = stratified(spark)
    high = cutoffs(df, "id", "response", ["lang"]).withColumn("cutoff", F.lit(0.45))
    out = repetition(df, "id", "response", ["lang"], chosen=high).collect()
    assert all((r["n_covered"] is None) == (r["run_share"] < 0.45) for r in out if r["n_words"]) and any(r["n_covered"] is None for r in out)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "id long, t string")
    assert heavy(repetition(empty, "id", "t", chosen=cutoffs(empty, "id", "t"))).count() == 0


@pytest.mark.parametrize("n", [2, 5])
def test_other_lengths(n):
    total, repeats, covered = repeated_shares(["a b c d e f"], n)
    assert (total[0], repeats[0], covered[0]) == (6, 0, 0)
