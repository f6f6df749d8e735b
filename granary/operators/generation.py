"""Generation of problems from seed snippets: prompts, budgets, a pluggable generator and parsing."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import text, tokens
from granary.functions.hashing import draw, order_key, ranked
from granary.sources.registry import Decoding

#: Tokens that are kept free beside the prompt and the answer.
RESERVE = 10
#: Texts, and where a context is given the most tokens of each answer, to (answer, finish reason).
Generate = Callable[..., list[tuple[str, str]]]


@dataclass(frozen=True)
class Budget:
    context: int = 16_384
    answer: int = 2_048


@dataclass(frozen=True)
class Snippets:
    """Shortest and longest run of lines, and the seed of the draws."""

    least: int = 1
    most: int = 15
    seed: int = 0


def snippets(df: DataFrame, id: str, content: str, s: Snippets = Snippets()) -> DataFrame:
    """(id, seed): a run of lines of each text from a drawn start; '' for the empty text; null texts are left out."""
    rows = df.where(F.col(content).isNotNull()).select(F.col(id), F.col(content))
    n = F.greatest(F.size(text.lines(F.col(content))).cast("long"), F.lit(1).cast("long"))
    start = draw(s.seed, F.concat_ws(":", F.col(id).cast("string"), F.lit("start")), n)
    length = draw(s.seed, F.concat_ws(":", F.col(id).cast("string"), F.lit("length")), F.lit(s.most - s.least + 1).cast("long")) + s.least
    return rows.select(id, text.snippet(F.col(content), start, length).alias("seed"))


def with_ordinal(df: DataFrame, id: str, seed: int, name: str = "index") -> DataFrame:
    """``df`` with its place in a seeded shuffle."""
    return ranked(df.withColumn("_key", order_key(seed, id, "ordinal")), "_key", id, name=name).drop("_key")


def room(tokens: Column, b: Budget) -> Column:
    """Tokens that an answer may have after a prompt of ``tokens``."""
    return F.least(F.lit(b.answer), F.lit(b.context) - tokens - RESERVE)


def within_budget(df: DataFrame, tokens: str, b: Budget) -> DataFrame:
    return df.where(room(F.col(tokens), b) > 0)


def messages(system: str, user: Column) -> Column:
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))


def infilling(family: Column, before: Column, after: Column) -> Column:
    """The prompt for a missing middle in the dialect of the model's family; null for other families."""
    # The markers of three families.
    return (
        F.when(family == "starcoder", F.concat(F.lit("<fim_prefix>"), before, F.lit("<fim_suffix>"), after, F.lit("<fim_middle>")))
        .when(family == "codellama", F.concat(F.lit("▁<PRE>"), before, F.lit("▁<SUF>"), after, F.lit("▁<MID>")))
        .when(family == "deepseek", F.concat(F.lit("<｜fim▁begin｜>"), before, F.lit("<｜fim▁hole｜>"), after, F.lit("<｜fim▁end｜>")))
    )


def with_retries(call: Callable[[], object], tries: int = 5, first: float = 30.0, sleep: Callable[[float], None] = time.sleep):
    """The call's result; after a failure it is tried again up to ``tries`` times, but a ValueError is final. Each wait, the first one too, is twice the one before (at first ``first``) and a random part more."""
    wait = first
    for attempt in range(tries + 1):
        try:
            return call()
        except Exception as error:
            if attempt == tries or isinstance(error, ValueError):
                raise
            wait *= 2 * (1 + random.random())
            sleep(wait)


def generated(df: DataFrame, prompt: str, generate: Generate, context: int | None = None, decoding: Decoding = Decoding(), encode: tokens.Encode = tokens.word_ids) -> DataFrame:
    """``df`` with the generator's ``answer`` and ``finish_reason``, in Arrow batches; a null prompt is an empty one.

    With a ``context`` the generator is also told how many tokens each answer may have, and a
    prompt that fills the context (its begin id counts) is refused.
    """

    def bounded(texts: list[str]) -> list[tuple[str, str]]:
        if context is None:
            return generate(texts)
        return generate(texts, [decoding.new_tokens(len(ids) + 1, context) for ids in encode(texts)])

    @F.pandas_udf("answer string, finish_reason string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(with_retries(lambda b=batch: bounded(b.fillna("").tolist())), columns=["answer", "finish_reason"])

    return df.withColumn("_g", run(F.col(prompt))).select(*df.columns, "_g.answer", "_g.finish_reason")


def accepted(df: DataFrame, answer: str = "answer", finish: str = "finish_reason") -> DataFrame:
    """Rows that finished and hold both parts, neither of them empty, with ``problem`` and ``solution``."""
    parsed = df.where(F.col(finish) == "stop").withColumn("_s", text.sections(F.col(answer)))
    kept = parsed.where("_s is not null").withColumn("problem", F.col("_s.problem")).withColumn("solution", F.col("_s.solution")).drop("_s")
    return kept.where("length(problem) > 0 and length(solution) > 0")


def as_training(df: DataFrame) -> DataFrame:
    """Generated problems and solutions under the names that training reads."""
    return df.withColumnRenamed("problem", "instruction").withColumnRenamed("solution", "response")
