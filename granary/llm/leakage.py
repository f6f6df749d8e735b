"""Evaluation passages inside a corpus, found with an FM-index over each shard of it.

A shard (a bounded run of documents) is the sequence of its words, each the number of the
word in the evaluation vocabulary; words outside it are all number 1 and a run of them counts
once, since no phrase holds one. Over the sequence an FM-index is built: suffix order by
prefix doubling, the Burrows-Wheeler transform in a wavelet matrix for rank queries, and
sampled suffix positions. All phrases (runs of ``n`` words of an item) are searched backwards
at once; occurrences are located by walking to the next sampled position, and overlapping
occurrences of one item in one document are merged to spans.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm import arrays, words

END, OUTSIDE, FIRST = 0, 1, 2
SAMPLE = 16
SHARD_CHARS = 2_000_000


class WaveletMatrix:
    """Rank queries over a sequence of small numbers; all queries of a call run at once."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits = bits
        self.zeros: list[int] = []
        self.ones: list[np.ndarray] = []
        current = symbols
        for b in range(bits - 1, -1, -1):
            bit = ((current >> b) & 1).astype(bool)
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]))
            self.zeros.append(int((~bit).sum()))
            current = np.concatenate([current[~bit], current[bit]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        low, high = np.zeros_like(at), at
        for k, b in enumerate(range(self.bits - 1, -1, -1)):
            ones, one = self.ones[k], ((symbol >> b) & 1).astype(bool)
            lo, hi = ones[low], ones[high]
            low, high = np.where(one, self.zeros[k] + lo, low - lo), np.where(one, self.zeros[k] + hi, high - hi)
        return high - low

    def access(self, at: np.ndarray) -> np.ndarray:
        value = np.zeros_like(at)
        for k in range(self.bits):
            ones = self.ones[k]
            bit = ones[at + 1] - ones[at]
            value = (value << 1) | bit
            at = np.where(bit == 1, self.zeros[k] + ones[at], at - ones[at])
        return value


def suffix_order(symbols: np.ndarray, bits: int) -> np.ndarray:
    """Places of the sequence in the order of the suffixes that begin there."""
    size, held = len(symbols), max(1, 60 // bits)
    key = np.zeros(size, dtype=np.int64)
    for k in range(held):
        shifted = np.zeros(size, dtype=np.int64)
        shifted[: size - k] = symbols[k:] if k < size else 0
        key = (key << bits) | shifted
    depth = held
    while True:
        order = np.argsort(key, kind="stable")
        new = np.ones(size, dtype=np.int64)
        new[1:] = key[order][1:] != key[order][:-1]
        rank = np.empty(size, dtype=np.int64)
        rank[order] = np.cumsum(new)
        if rank[order[-1]] == size:
            return order
        after = np.zeros(size, dtype=np.int64)
        after[: max(0, size - depth)] = rank[depth:]
        key = rank * (size + 1) + after
        depth *= 2


class FMIndex:
    """Backward search and location over one sequence, which must end with a symbol of its own."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        self.bits = max(1, int(alphabet - 1).bit_length())
        order = suffix_order(symbols, self.bits)
        last = symbols[order - 1]
        self.size = len(symbols)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=alphabet))])
        self.matrix = WaveletMatrix(last, self.bits)
        sampled = order % SAMPLE == 0
        self.marks = np.concatenate([[0], np.cumsum(sampled, dtype=np.int32)])
        self.samples = order[sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds, in suffix order, of the suffixes that begin with each phrase (a row each)."""
        low = np.zeros(len(phrases), dtype=np.int64)
        high = np.full(len(phrases), self.size, dtype=np.int64)
        alive = np.arange(len(phrases))
        for column in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[alive, column]
            low[alive] = self.first[symbol] + self.matrix.rank(symbol, low[alive])
            high[alive] = self.first[symbol] + self.matrix.rank(symbol, high[alive])
            alive = alive[low[alive] < high[alive]]
            if not len(alive):
                break
        return low, np.maximum(low, high)

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Place in the sequence of each suffix, given by its place in suffix order."""
        place = np.full(len(at), -1, dtype=np.int64)
        steps = np.zeros(len(at), dtype=np.int64)
        going = np.arange(len(at))
        at = at.copy()
        while len(going):
            here = at[going]
            marked = self.marks[here + 1] > self.marks[here]
            done = going[marked]
            place[done] = self.samples[self.marks[at[done]]] + steps[done]
            going = going[~marked]
            symbol = self.matrix.access(at[going])
            at[going] = self.first[symbol] + self.matrix.rank(symbol, at[going])
            steps[going] += 1
        return place


@dataclass(frozen=True)
class Phrases:
    """All runs of the asked number of words of the items, by that number."""

    vocabulary: np.ndarray
    by_length: dict[int, tuple[np.ndarray, list[list[int]]]]


def phrases_of(items: list[tuple[int, str, int]]) -> Phrases:
    """items: (item id, text, least number of words)."""
    w = words.words([text for _, text, _ in items])
    vocabulary = np.unique(w.hash)
    symbol = np.searchsorted(vocabulary, w.hash) + FIRST
    bounds = np.searchsorted(w.row, np.arange(len(items) + 1))
    runs: dict[int, dict[tuple[int, ...], list[int]]] = {}
    for k, (item, _, n) in enumerate(items):
        own = symbol[bounds[k] : bounds[k + 1]].tolist()
        for j in range(len(own) - n + 1):
            holders = runs.setdefault(n, {}).setdefault(tuple(own[j : j + n]), [])
            if item not in holders:
                holders.append(item)
    return Phrases(vocabulary, {n: (np.array(list(found), dtype=np.int64), list(found.values())) for n, found in runs.items()})


def occurrences(texts: list[str], phrases: Phrases) -> Iterator[tuple[int, int, int, int]]:
    """(index of the text, item id, start, end) of each merged span in one shard."""
    w = words.words(texts)
    if not len(w.row) or not len(phrases.vocabulary):
        return
    near = np.minimum(np.searchsorted(phrases.vocabulary, w.hash), len(phrases.vocabulary) - 1)
    symbol = np.where(phrases.vocabulary[near] == w.hash, near + FIRST, OUTSIDE)
    starts_text = np.ones(len(symbol), dtype=bool)
    starts_text[1:] = w.row[1:] != w.row[:-1]
    keep = np.ones(len(symbol), dtype=bool)
    keep[1:] = (symbol[1:] != OUTSIDE) | (symbol[:-1] != OUTSIDE) | starts_text[1:]
    kept = np.flatnonzero(keep)
    head = starts_text[kept]
    # each text is preceded by an OUTSIDE word, so that no phrase reaches over two; END closes the shard
    at = np.arange(len(kept)) + np.cumsum(head)
    sequence = np.full(len(kept) + int(head.sum()) + 1, OUTSIDE, dtype=np.int64)
    sequence[at] = symbol[kept]
    sequence[-1] = END
    word_at = np.full(len(sequence), -1, dtype=np.int64)
    word_at[at] = kept
    index = FMIndex(sequence, len(phrases.vocabulary) + FIRST)
    spans: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for n, (rows, holders) in phrases.by_length.items():
        low, high = index.search(rows)
        which = np.repeat(np.arange(len(rows)), high - low)
        inner = np.arange(len(which)) - np.repeat(np.cumsum(high - low) - (high - low), high - low)
        first = word_at[index.locate(low[which] + inner)]
        for phrase, f in zip(which.tolist(), first.tolist(), strict=True):
            for item in holders[phrase]:
                spans.setdefault((int(w.row[f]), item), []).append((int(w.start[f]), int(w.end[f + n - 1])))
    for (row, item), found in sorted(spans.items()):
        found.sort()
        begin, end = found[0]
        for a, b in found[1:]:
            if a > end:
                yield row, item, begin, end
                begin, end = a, b
            end = max(end, b)
        yield row, item, begin, end


def leaked_spans(corpus: DataFrame, id: str, text: str, items: DataFrame, least: dict[str, int], default: int = 12, most_items: int = 100_000) -> DataFrame:
    """(id, item_id, start_char, end_char): where the corpus holds passages of the items.

    items: (item_id, lang, text), held-out material of a size that does not grow with the
    corpus; more than ``most_items`` of it are refused. least: words a passage must have, by
    the item's language. Null and blank texts hold nothing, items of fewer words cannot be
    found, repeated rows repeat their spans, other columns are not read.
    """
    known = items.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long"), F.lower(arrays.text("lang")), arrays.text("text")).distinct().limit(most_items + 1).collect()
    if len(known) > most_items:
        raise ValueError(f"more than {most_items} items; search them in parts")
    phrases = phrases_of(sorted((i, t, least.get(lang, default)) for i, lang, t in known))
    shared = corpus.sparkSession.sparkContext.broadcast(phrases)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, texts = batch.column("id").to_pylist(), arrays.strings(batch, "text")
        rows: list[tuple[int | None, int, int, int]] = []
        for begin, end in words.chunks(texts, SHARD_CHARS):
            rows += [(ids[begin + k], item, a, b) for k, item, a, b in occurrences(texts[begin:end], shared.value)]
        return pa.RecordBatch.from_pydict(
            {
                "id": pa.array([r[0] for r in rows], pa.int64()),
                "item_id": pa.array([r[1] for r in rows], pa.int64()),
                "start_char": pa.array([r[2] for r in rows], pa.int32()),
                "end_char": pa.array([r[3] for r in rows], pa.int32()),
            }
        )

    narrow = corpus.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return arrays.arrow_map(narrow, run, "id long, item_id long, start_char int, end_char int")
