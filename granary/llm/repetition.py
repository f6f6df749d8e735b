"""Repetition inside single documents, with risk-controlled cutoffs.

A document's share of repeated content is the share of its words that lie in some run of
``n`` words that has already occurred earlier in it. Measuring it needs the place of every
word, so a cheaper score comes first: how many of its runs occurred earlier, for each word.
From which score on a document is rejected is not guessed: over all documents (the label is
the exact share) exact binomial (Clopper-Pearson) upper bounds of both error rates are computed
for each stratum and candidate cutoff, at a confidence corrected for all the tests made. Only
rejected documents get the exact measure, which has the last word. The lowest candidate is a
cutoff below which no document can reach the share, so it loses none, and documents below it
are labelled clean without the measure; a higher one is taken only where the lowest would
reject too many clean documents, and only if no document at all is lost to it and the bound of
that rate holds, too.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm import arrays, words
from granary.session import cut


@dataclass(frozen=True)
class Runs:
    """Runs of ``n`` words of a chunk of texts: text and first word of each that occurred earlier in its text; words of all texts."""

    row: np.ndarray
    at: np.ndarray
    word_row: np.ndarray


def repeated_runs(texts: list[str], n: int) -> tuple[np.ndarray, Runs]:
    """(words of each text, its repeated runs)."""
    w = words.words(texts, digits_equal=True)
    total = np.bincount(w.row, minlength=len(texts))
    hashes, at = words.runs(w.row, w.hash, n)
    row = w.row[at]
    by = np.lexsort((hashes, row))
    again = np.zeros(len(at), dtype=bool)
    if len(at):
        again[by[1:]] = (row[by[1:]] == row[by[:-1]]) & (hashes[by[1:]] == hashes[by[:-1]])
    return total, Runs(row[again], at[again], w.row)


def covered_words(runs: Runs, n: int, texts: int, asked: np.ndarray) -> np.ndarray:
    """Words that lie in repeated runs, for the asked texts; 0 for the others."""
    at = runs.at[asked[runs.row]]
    edge = np.zeros(len(runs.word_row) + 1, dtype=np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return np.bincount(runs.word_row[np.cumsum(edge)[:-1] > 0], minlength=texts)


def repeated_shares(texts: list[str], n: int = 4, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, repeats, covered) of each text: its words, its runs that occurred earlier, and the words in such runs.

    With ``least``, a score of repeats for each word, only texts at or over theirs have their
    covered words measured; -1 for the others.
    """
    total, repeats, covered = (np.zeros(len(texts), dtype=np.int64) for _ in range(3))
    for begin, end in words.chunks(texts):
        size = end - begin
        total[begin:end], runs = repeated_runs(texts[begin:end], n)
        repeats[begin:end] = np.bincount(runs.row, minlength=size)
        asked = np.ones(size, dtype=bool) if least is None else (total[begin:end] > 0) & (repeats[begin:end] >= least[begin:end] * total[begin:end] - 1e-9)
        covered[begin:end] = np.where(asked, covered_words(runs, n, size, asked), -1)
    return total, repeats, covered


#: The largest strata that have cutoffs of their own; all others take the lowest cutoff, which loses nothing.
MOST_STRATA = 10_000
MEASURES = "n_words long, n_repeats long, n_covered long, run_share double, repeated_share double"


def repetition(df: DataFrame, id: str, text: str, strata: list[str] | None = None, n: int = 4, chosen: DataFrame | None = None, risk: Risk | None = None, least: float = 0.0) -> DataFrame:
    """(id, stratum, n_words, n_repeats, n_covered, run_share, repeated_share), one row per row of ``df``.

    run_share is the cheap score. With ``chosen`` (from ``cutoffs``) only rows at or over the
    cutoff of their stratum have the exact measure, without it those whose score is ``least`` or
    more; n_covered and repeated_share of the others are null. Null and blank texts, and texts of fewer than ``n`` + 1 words, have share 0.
    Repeated rows give repeated results; columns that are not named are not read.
    """
    narrow = df.select(F.col(id).cast("long").alias("id"), stratum_of(strata).alias("stratum"), arrays.text(text).alias("text"))
    exact = chosen is None and not least
    risk = risk or Risk()
    if chosen is None:
        narrow = narrow.withColumn("cutoff", F.lit(least))
    else:
        known = chosen.orderBy(F.col("n_clean").desc(), "stratum").limit(MOST_STRATA).select("stratum", "cutoff")
        narrow = narrow.join(F.broadcast(known), "stratum", "left").withColumn("cutoff", F.coalesce("cutoff", F.lit(risk.lowest(n))))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cutoff = None if exact else batch.column("cutoff").to_numpy(zero_copy_only=False)
        total, repeats, covered = repeated_shares(arrays.strings(batch, "text"), n, cutoff)
        return pa.RecordBatch.from_pydict(
            {
                "id": batch.column("id"),
                "stratum": batch.column("stratum"),
                "n_words": pa.array(total),
                "n_repeats": pa.array(repeats),
                "n_covered": pa.array(covered, mask=covered < 0),
                "run_share": pa.array(repeats / np.maximum(total, 1)),
                "repeated_share": pa.array(covered / np.maximum(total, 1), mask=covered < 0),
            }
        )

    return arrays.arrow_map(narrow.select("id", "stratum", "text", "cutoff"), run, f"id long, stratum string, {MEASURES}")


def stratum_of(strata: list[str] | None) -> F.Column:
    return F.concat_ws("/", *[F.lower(arrays.text(c)) for c in strata or []])


@dataclass(frozen=True)
class Risk:
    """Allowed rate of false rejections, and the chance that any of the bounds fails."""

    rate: float = 0.02
    chance: float = 0.05
    #: Share of repeated words from which a document counts as heavily repeating.
    heavy: float = 0.5
    #: Highest candidate cutoff of the score, and how many candidates there are from the lowest on.
    highest: float = 0.5
    steps: int = 11

    def lowest(self, n: int) -> float:
        """The score that every heavy document reaches: each repeated run covers at most n words."""
        return self.heavy / n

    def grid(self, n: int) -> list[float]:
        low = self.lowest(n)
        return [low + (self.highest - low) * k / (self.steps - 1) for k in range(self.steps)]


def log_binomial_tail(k: np.ndarray, m: np.ndarray, p: np.ndarray) -> np.ndarray:
    """P(X <= k) for X of m trials with chance p, by the regularised incomplete beta function's continued fraction."""
    from math import lgamma

    out = np.ones(len(k))
    for i, (a, b, x) in enumerate(zip(m - k, k + 1, 1 - p, strict=True)):
        if a <= 0:
            continue
        front = np.exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * np.log(max(x, 1e-300)) + b * np.log(max(1 - x, 1e-300)))
        out[i] = front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, 1 - x) / b
    return out


def fraction(a: float, b: float, x: float) -> float:
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for number in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + number * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + number / (c if abs(c) > tiny else tiny)
            step = d * c
            h *= step
        if abs(step - 1) < 1e-13:
            break
    return h


def upper_bound(errors: int, trials: int, chance: float) -> float:
    """Exact upper confidence bound of a rate: the largest p with P(X <= errors) >= chance."""
    if errors >= trials:
        return 1.0
    low, high = errors / trials, 1.0
    for _ in range(60):
        p = (low + high) / 2
        if log_binomial_tail(np.array([errors]), np.array([trials]), np.array([p]))[0] >= chance:
            low = p
        else:
            high = p
    return high


def cutoffs(df: DataFrame, id: str, text: str, strata: list[str] | None = None, n: int = 4, risk: Risk = Risk()) -> DataFrame:
    """(stratum, n_clean, false_rejections, rejection_bound, n_heavy, missed, miss_bound, cutoff): the cutoff of each stratum.

    The label is the definition itself, a share of at least ``risk.heavy``, and every row counts. A false rejection
    is a clean document at or over the cutoff, a miss a heavy one below it. The confidence is
    divided by the number of tests of all strata (Bonferroni). Where no candidate is proven, as
    in strata of a few documents, the cutoff is the lowest one, which misses nothing.
    """
    held = repetition(df, id, text, strata, n, least=risk.lowest(n))
    grid = risk.grid(n)
    clean, over = F.coalesce("repeated_share", F.lit(0.0)) < risk.heavy, [F.col("n_repeats") >= c * F.col("n_words") - 1e-9 for c in grid]
    errors = [F.sum((clean & o).cast("long")).alias(f"e{k}") for k, o in enumerate(over)]
    misses = [F.sum((~clean & ~o).cast("long")).alias(f"m{k}") for k, o in enumerate(over)]
    counts = cut(held.groupBy("stratum").agg(F.sum(clean.cast("long")).alias("n_clean"), F.sum((~clean).cast("long")).alias("n_heavy"), *errors, *misses))
    level = risk.chance / max(1, 2 * counts.count() * risk.steps)

    def bound(errors: int, trials: int) -> float:
        return upper_bound(errors, trials, level) if trials else 1.0

    def prove(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for row in batch.to_pylist():
            tried = [(c, row[f"e{k}"], bound(row[f"e{k}"], row["n_clean"]), row[f"m{k}"], bound(row[f"m{k}"], row["n_heavy"])) for k, c in enumerate(grid)]
            proven = [x for k, x in enumerate(tried) if x[2] <= risk.rate and (not k or not x[3] and x[4] <= risk.rate)]
            c, wrong, wrong_bound, missed, miss_bound = (proven or tried)[0]
            out.append({"stratum": row["stratum"], "n_clean": row["n_clean"], "false_rejections": wrong, "rejection_bound": wrong_bound, "n_heavy": row["n_heavy"], "missed": missed, "miss_bound": miss_bound, "cutoff": c})
        kinds = [("stratum", pa.string()), ("n_clean", pa.int64()), ("false_rejections", pa.int64()), ("rejection_bound", pa.float64()), ("n_heavy", pa.int64()), ("missed", pa.int64()), ("miss_bound", pa.float64()), ("cutoff", pa.float64())]
        return pa.RecordBatch.from_pylist(out, schema=pa.schema(kinds))

    return arrays.arrow_map(counts, prove, "stratum string, n_clean long, false_rejections long, rejection_bound double, n_heavy long, missed long, miss_bound double, cutoff double")


def heavy(measured: DataFrame, risk: Risk = Risk()) -> DataFrame:
    """Rows that repeat heavily by definition, of those that have the exact measure."""
    share = Fraction(str(risk.heavy))
    return measured.where((F.col("n_words") > 0) & (F.col("n_covered") * share.denominator >= F.col("n_words") * share.numerator))
