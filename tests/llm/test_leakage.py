import random

import numpy as np

from granary.llm.leakage import FMIndex, leaked_spans, suffix_order


def test_suffix_order_and_search_equal_a_plain_scan():
    rng = np.random.default_rng(2)
    for size in (1, 2, 17, 300):
        seq = np.append(rng.integers(1, 5, size), 0)
        assert suffix_order(seq, 3).tolist() == sorted(range(len(seq)), key=lambda k: seq[k:].tolist())
        index = FMIndex(seq, 5)
        phrases = rng.integers(1, 5, (40, 3))
        low, high = index.search(phrases)
        for p, a, b in zip(phrases, low, high, strict=True):
            places = sorted(index.locate(np.arange(a, b)).tolist())
            assert places == [k for k in range(len(seq) - 2) if (seq[k : k + 3] == p).all()]


def test_spans(spark):
    rng = random.Random(4)
    item = [f"q{i}" for i in range(30)]
    filler = lambda n: " ".join(rng.choices(["x", "y", "q1", "q2"], k=n))
    zh = "".join(chr(0x4E00 + i) for i in range(40))
    docs = [
        (1, f"{filler(5)} {' '.join(item[3:15]).upper().replace(' ', ',  ')} {filler(5)}"),
        (2, f"{filler(5)} {' '.join(item[3:14])} {filler(5)}"),
        (3, f"a {zh[5:25]} b"),
        (4, f"a {zh[5:24]} b"),
        (5, None),
        (6, ""),
        (7, " ".join(item[:20]) + "\n\n**" + "** ".join(item[20:])),
        (8, filler(20000) + " " + " ".join(item[10:22])),
    ]
    items = spark.createDataFrame([(10, "en", " ".join(item)), (11, "zh", zh), (12, None, None), (13, "en", "too short"), (14, "en", " ".join(item[:25]))], "item_id long, lang string, text string")
    df = spark.createDataFrame([(*d, "z") for d in docs], "doc_id long, text string, item_id string")
    out = leaked_spans(df, "doc_id", "text", items, {"zh": 20}).collect()
    assert {(r["id"], r["item_id"]) for r in out} == {(1, 10), (1, 14), (3, 11), (7, 10), (7, 14), (8, 10), (8, 14)}
    whole = next(r for r in out if (r["id"], r["item_id"]) == (7, 10))
    assert (whole["start_char"], whole["end_char"]) == (0, len(docs[6][1]))
    span = next(r for r in out if r["id"] == 3)
    assert docs[2][1][span["start_char"] : span["end_char"]] == zh[5:25]
    assert leaked_spans(df.where("false"), "doc_id", "text", items, {}).count() == 0
    assert leaked_spans(df, "doc_id", "text", items.where("false"), {}).count() == 0
