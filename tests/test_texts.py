import pytest
from pyspark.sql import functions as F

from granary.functions import text, tokens
from granary.operators import generation
from granary.operators.generation import Budget, Snippets
from granary.sources import jsonl
from granary.sources.registry import Decoding

BREAKS = ["", "one", "one\n", "a\r\nb\r\n", "a\n\nb", "a\rb\x0bc\x0cd\x85e f g", "\n", "x\x1cy\x1dz\x1e"]


def test_lines_are_those_of_splitlines(spark):
    df = spark.createDataFrame([(x,) for x in BREAKS], "t string").select("t", text.lines(F.col("t")).alias("l"))
    assert all(r["l"] == r["t"].splitlines(keepends=True) for r in df.collect())


def test_snippets_are_runs_of_lines(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate([*BREAKS, None, "l1\nl2\nl3\nl4\nl5\n"])], "id long, c string")
    out = {r["id"]: r["seed"] for r in generation.snippets(df, "id", "c", Snippets(2, 3)).collect()}
    assert out[0] == "" and len(BREAKS) not in out
    whole = "l1\nl2\nl3\nl4\nl5\n"
    assert out[len(BREAKS) + 1] and out[len(BREAKS) + 1] in whole


@pytest.mark.parametrize(
    ("answer", "wanted"),
    [
        ("[Problem Description]\np\n[Solution]\ns\n", ("p", "s")),
        ("x\n[problem description] lost\np1\np2\n[SOLUTION] lost\ns", ("p1\np2", "s")),
        ("[Solution]\ns\n[Problem Description]\np", None),
        ("[Problem Description] [Solution]\nboth", None),
        ("[Problem Description]\np", None),
        ("", None),
        ("[Problem Description]\n[Solution]\ns", ("", "s")),
        ("[Problem Description]\np\n[Solution]\na\n[Solution]\nb", ("p", "a\n[Solution]\nb")),
    ],
)
def test_sections(spark, answer, wanted):
    r = spark.createDataFrame([(answer,)], "t string").select(text.sections(F.col("t")).alias("s")).first()["s"]
    assert (None if r is None else (r["problem"], r["solution"])) == wanted


def test_only_whole_generations_are_accepted(spark):
    good = "[Problem Description]\np\n[Solution]\ns"
    data = [(1, good, "stop"), (2, good, "length"), (3, "nothing", "stop"), (4, "[Problem Description]\n \n[Solution]\ns", "stop"), (5, None, "stop")]
    df = spark.createDataFrame(data, "i long, answer string, finish_reason string")
    out = generation.as_training(generation.accepted(df)).collect()
    assert [(r["i"], r["instruction"], r["response"]) for r in out] == [(1, "p", "s")]


def test_generator_plug_in(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "i long, prompt string")
    out = generation.generated(df, "prompt", lambda texts: [(x.upper(), "stop") for x in texts]).orderBy("i").collect()
    assert [(r["answer"], r["finish_reason"]) for r in out] == [("A", "stop"), ("", "stop")]


def test_retries_wait_longer_and_give_up():
    waits, calls = [], []

    def fails():
        calls.append(1)
        raise OSError("down")

    with pytest.raises(OSError):
        generation.with_retries(fails, tries=3, first=1.0, sleep=waits.append)
    assert len(calls) == 4 and len(waits) == 3 and 2.0 <= waits[0] < 4.0 and waits[2] >= 2 * waits[1] >= 4 * waits[0]


def test_budget_is_strict(spark):
    df = spark.createDataFrame([(n,) for n in (89, 90, 91)], "n int")
    assert [r["n"] for r in generation.within_budget(df, "n", Budget(context=100, answer=50)).collect()] == [89]


def test_training_rows(spark):
    df = spark.createDataFrame([(1, "say hi", "hi there you"), (2, None, "x"), (3, "a", None)], "row_id long, instruction string, response string")
    found = {r["row_id"]: r for r in tokens.training_rows(df, "row_id", 100).collect()}
    assert set(found) == {1, 3}
    r = found[1]
    assert r["input_ids"][0] == 1 and r["input_ids"][-1] == 2 and len(r["input_ids"]) == len(r["labels"])
    kept = [x for x in r["labels"] if x != -100]
    assert kept == r["input_ids"][-4:] and not r["exceeding_length"]
    size = len(r["input_ids"])
    for most, flag in ((size, False), (size - 1, True)):
        cut = tokens.training_rows(df, "row_id", most).where("row_id = 1").first()
        assert cut["exceeding_length"] is flag and len(cut["input_ids"]) == len(cut["labels"]) == most


def test_padding_and_masks(spark):
    df = spark.createDataFrame([([5, 2],), ([],), ([7, 8, 9, 2],)], "ids array<int>")
    out = df.select(tokens.padded(F.col("ids"), 3, 0).alias("r"), tokens.padded(F.col("ids"), 3, 0, left=True).alias("l"), tokens.attention(F.col("ids"), 2).alias("m")).collect()
    assert [x["r"] for x in out] == [[5, 2, 0], [0, 0, 0], None] and out[0]["l"] == [0, 5, 2]
    assert out[0]["m"] == [True, False]  # with the end id as padding the real end is masked, too


def test_resumption(spark):
    rows, written = spark.range(6).withColumnRenamed("id", "i"), spark.createDataFrame([(0,), (3,)], "i long")
    assert [r["i"] for r in jsonl.remaining_by_position(rows, written, "i").orderBy("i").collect()] == [4, 5]
    assert [r["i"] for r in jsonl.remaining_by_key(rows, written, "i").orderBy("i").collect()] == [1, 2, 4, 5]
    assert jsonl.remaining_by_position(rows, written.where("false"), "i").count() == 6
    assert jsonl.output_name("", "ab12c", 0, 5, "t") == "data-ab12c-0_5-t.jsonl"


def test_fingerprints_and_decoding():
    assert len(text.run_fingerprint("a", None, 0.5)) == 5 and text.run_fingerprint(None) == text.run_fingerprint("None")
    assert not Decoding().sampled and Decoding(temperature=0.2).sampled and Decoding(max_new_tokens=9).new_tokens(5, 10) == 5
    with pytest.raises(ValueError):
        Decoding().new_tokens(10, 10)
