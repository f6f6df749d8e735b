"""Texts cut off at a field limit or in transfer.

Two kinds of evidence meet. Lengths: for each source a lognormal length distribution that is
right-censored at a candidate limit is fitted by maximum likelihood; where it explains the
lengths better than an uncensored one, the limit stands, and the fit gives the posterior
chance that a value of just that length was censored. Endings: over all texts it is counted
how often each run of last words ends a unit (a sentence, a list item, a block of code) where
it occurs, in a fixed number of slots; with marks of open code, brackets and word ends these
rates feed a logistic model, fitted on a bounded sample of the distinct texts, which are cut at
random places and at true unit ends. How many values are cut is estimated for each source from
all of its rows. A value is cut if the odds of both together say so.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm import arrays, words
from granary.session import cut

ORDERS = (1, 2, 3)
#: Words left out: the one before the last; the last itself and the one two before it.
SKIPS = ((2, 0), (3, 1))
SLOTS = 1 << 23
LETTERS = 1 << 18
# Marks added at a cut, marks that end a unit, marks that leave one open.
CUT_MARK = re.compile(r"(?:\s*(?:\.{3,}|…|\[(?:truncated|cut|cut off|\.{3}|…)\]|\((?:truncated|cut off|continued)\)|<(?:truncated|cut)>|�+))+\s*\Z", re.I)
FINAL = ".!?。！？।؟؛"
CLOSERS = "\"'”’»)]}）】」』*_"
OPEN = ",;:([{（「『“„«-–—=+/<&|"
UNIT_END = re.compile(r"[.!?](?=[\"”»)*]*\s+(?![a-zß-ÿа-я])\S)|[。！？।]|\n(?=\n|```|[-*] |\d+[.)] )")
#: The last words of texts below this many characters are evidence only in a sentence that is known from elsewhere: short answers are no sentences.
SHORT = 25
#: Words of such a sentence, and how often its end must be known.
LEAST_WORDS = 5
LEAST_SEEN = 3
#: A full stop that may stand inside a sentence: after a number or a short word.
INNER_STOP = re.compile(r"(?:\d|\b[^\W\d_]{1,3})\.\Z")
DANGLING = re.compile(r"\n[ \t]*(?:[-*+#]+|`{1,2}|\d{1,3}\.?)\Z")
WORDLIKE = re.compile(r"\w")


@dataclass(frozen=True)
class Settings:
    """sample: distinct texts that the ending model is fitted on, drawn by hash; least: chars that it needs; pool: rows at the share of cuts of all sources that each source's share is estimated with."""

    sample: int = 10_000
    least: int = 60
    seed: int = 7
    gain: float = 12.0
    threshold: float = 0.5
    pool: float = 50.0


# Lengths


def fit_censored(logs: np.ndarray, n: np.ndarray, limit: float, at_limit: float) -> tuple[float, float, float]:
    """(mean, deviation, log likelihood) of log lengths below ``limit`` with ``at_limit`` values censored there (EM)."""
    total = n.sum() + at_limit
    mean = (n @ logs + at_limit * limit) / total
    dev = max(0.05, math.sqrt(max(1e-6, (n @ (logs - mean) ** 2 + at_limit * (limit - mean) ** 2) / total)))
    for _ in range(200 if at_limit else 1):
        z = (limit - mean) / dev
        tail = max(1e-12, 0.5 * math.erfc(z / math.sqrt(2)))
        hazard = math.exp(-z * z / 2) / math.sqrt(2 * math.pi) / tail
        first = mean + dev * hazard
        second = mean * mean + 2 * mean * dev * hazard + dev * dev * (1 + z * hazard)
        new = (n @ logs + at_limit * first) / total
        spread = max(1e-4, (n @ logs**2 + at_limit * second) / total - new * new)
        moved = abs(new - mean) + abs(math.sqrt(spread) - dev)
        mean, dev = new, max(0.05, math.sqrt(spread))
        if moved < 1e-9:
            break
    z = (logs - mean) / dev
    like = float(n @ (-0.5 * z * z - math.log(dev) - 0.5 * math.log(2 * math.pi) - logs))
    if at_limit:
        like += at_limit * math.log(max(1e-300, 0.5 * math.erfc((limit - mean) / dev / math.sqrt(2))))
    return mean, dev, like


def limits_of(length: np.ndarray, n: np.ndarray, gain: float) -> list[tuple[int, float]]:
    """(limit, posterior that a value of this length was censored) for the lengths of one source.

    A candidate is a length with a run of values that nothing, or next to nothing, exceeds.
    """
    order = np.argsort(length)
    length, n = length[order], n[order].astype(float)
    keep = length > 0
    length, n = length[keep], n[keep]
    if n.sum() < 20:
        return []
    above = n.sum() - np.cumsum(n)
    found = []
    for k in np.flatnonzero((n >= 5) & (above <= 0.2 * n)):
        limit, logs, below = float(np.log(length[k])), np.log(length[:k]), n[:k]
        if below.sum() < 10:
            continue
        mean, dev, censored = fit_censored(logs, below, limit, n[k])
        plain = fit_censored(np.append(logs, limit), np.append(below, n[k]), limit, 0.0)[2]
        if censored - plain < gain:
            continue
        tail = 0.5 * math.erfc((limit - mean) / dev / math.sqrt(2))
        density = math.exp(-0.5 * ((limit - mean) / dev) ** 2) / (dev * math.sqrt(2 * math.pi) * length[k])
        found.append((int(length[k]), tail / (tail + density)))
    return found


def length_limits(lengths: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(source, unit, length, censored): candidate limits that the lengths of a source prove.

    lengths: (source, unit, length) of each value. Only counts by length reach a group.
    """

    def run(table: pa.Table) -> pa.Table:
        found = limits_of(table.column("length").to_numpy(), table.column("n").to_numpy(), settings.gain)
        source, unit = table.column("source")[0].as_py(), table.column("unit")[0].as_py()
        return pa.table(
            {
                "source": pa.array([source] * len(found), pa.string()),
                "unit": pa.array([unit] * len(found), pa.string()),
                "length": pa.array([x for x, _ in found], pa.int64()),
                "censored": pa.array([p for _, p in found], pa.float64()),
            }
        )

    counted = lengths.groupBy("source", "unit", "length").agg(F.count("*").alias("n"))
    return counted.groupBy("source", "unit").applyInArrow(run, "source string, unit string, length long, censored double")


# Endings


def context_slots(w: words.Words, order: int) -> np.ndarray:
    """Slot of the last ``order`` words up to each word; -1 where its text has fewer."""
    n = len(w.row)
    total = np.zeros(n, dtype=np.uint64)
    for back in range(order - 1, -1, -1):
        shifted = np.zeros(n, dtype=np.uint64)
        shifted[back:] = w.hash[: n - back]
        total = total * np.uint64(0x9E3779B97F4A7C15) + shifted
    slot = (words.mix(total + np.uint64(order)) & np.uint64(SLOTS - 1)).astype(np.int64)
    if n:
        whole = np.zeros(n, dtype=bool)
        whole[order - 1 :] = w.row[order - 1 :] == w.row[: n - order + 1]
        slot[~whole] = -1
    return slot


def skip_slots(w: words.Words, backs: tuple[int, ...]) -> np.ndarray:
    """Slot of the words ``backs`` places before each word; -1 where its text has fewer."""
    n, most = len(w.row), max(backs)
    total = np.zeros(n, dtype=np.uint64)
    for back in backs:
        shifted = np.zeros(n, dtype=np.uint64)
        shifted[back:] = w.hash[: n - back]
        total = total * np.uint64(0x9E3779B97F4A7C15) + shifted + np.uint64(back)
    slot = (words.mix(total + np.uint64(77 + most)) & np.uint64(SLOTS - 1)).astype(np.int64)
    whole = np.zeros(n, dtype=bool)
    whole[most:] = w.row[most:] == w.row[: max(n - most, 0)]
    slot[~whole] = -1
    return slot


def all_slots(w: words.Words) -> list[np.ndarray]:
    return [*(context_slots(w, order) for order in ORDERS), *(skip_slots(w, backs) for backs in SKIPS)]


def letter_slots(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Slot of the code point at each place with the two before it."""
    key = points[at].astype(np.uint64)
    key += points[at - 1].astype(np.uint64) << np.uint64(21)
    key += points[at - 2].astype(np.uint64) << np.uint64(42)
    return (words.mix(key) & np.uint64(LETTERS - 1)).astype(np.int64)


#: What a code point is where units end: final marks before a blank, final marks, closing marks, what begins a block, blanks, small letters.
STOP, FULL, CLOSE, BLOCK, BLANK, SMALL = 1, 2, 4, 8, 16, 32


@lru_cache(maxsize=1)
def signs() -> np.ndarray:
    """The sum of what each code point is; built once per process."""
    t = words.tables()
    out = np.zeros(words.POINTS, dtype=np.uint8)
    for sign, held in ((STOP, ".!?"), (FULL, "。！？।؟"), (CLOSE, '"”»)'), (BLOCK, "\n`-*"), (BLANK, " \n\r\t")):
        out[[ord(x) for x in held]] |= sign
    out[t.kind == words.DIGIT] |= BLOCK
    for first, last in ((97, 122), (0xDF, 0xFF), (0x430, 0x45F)):
        out[first : last + 1][t.kind[first : last + 1] == words.LETTER] |= SMALL
    return out


def unit_ends(points: np.ndarray) -> np.ndarray:
    """Whether a unit ends at each code point (a final mark or a line feed)."""
    here, feed = signs()[points], signs()[10]
    after = np.append(here[1:], feed)
    later = np.append(after[1:], feed)
    free = (after & BLANK != 0) & (later & SMALL == 0)
    before = np.append(np.uint8(0), here[:-1])
    mark = (here & STOP != 0) & free | (here & FULL != 0)
    closed = (here & CLOSE != 0) & (before & STOP != 0) & free
    line = (points == 10) & (after & BLOCK != 0)
    return mark | closed | line


COUNTERS = 2 * SLOTS + 2 * LETTERS


def ending_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    t = words.tables()
    for batch in batches:
        texts = arrays.strings(batch, "text")
        found: list[np.ndarray] = []
        for begin, end in words.chunks(texts):
            part = texts[begin:end]
            w = words.words(part, digits_equal=True)
            if not len(w.row):
                continue
            points, first = words.code_points(part)
            ended = np.concatenate([[0], np.cumsum(unit_ends(points), dtype=np.int64)])
            # each word up to the next one of its text; a last word only where its text closes it
            after = first[w.row + 1] - 1
            same = w.row[1:] == w.row[:-1]
            after[:-1][same] = (first[w.row[1:]] + w.start[1:])[same]
            closes = ended[after] > ended[first[w.row] + w.end]
            inner = np.flatnonzero(np.append(same, False) | closes)
            shut = closes[inner]
            for slots in all_slots(w):
                slot = slots[inner]
                found += [slot[slot >= 0], slot[shut & (slot >= 0)] + SLOTS]
            small = t.lower[points]
            kind = t.kind[points] == words.LETTER
            deep = kind.copy()
            deep[2:] &= kind[1:-1] & kind[:-2]
            deep[:2] = False
            at = np.flatnonzero(deep)
            slot = letter_slots(small, at) + 2 * SLOTS
            last = ~np.append(kind, False)[at + 1]
            found += [slot, slot[last] + LETTERS]
        if found:
            yield np.concatenate(found)


def endings(prefixes: list[str], counts: np.ndarray) -> np.ndarray:
    """Features of how each prefix ends: one row each."""
    t = words.tables()
    tails = [x[-240:] for x in prefixes]
    w = words.words(tails, digits_equal=True)
    size = len(prefixes)
    last = np.searchsorted(w.row, np.arange(size), side="right") - 1
    has = (last >= 0) & (w.row[np.maximum(last, 0)] == np.arange(size)) if len(w.row) else np.zeros(size, dtype=bool)
    rate, columns = np.full(size, 0.08), []
    slots_of = all_slots(w) if len(w.row) else [np.full(1, -1)] * (len(ORDERS) + len(SKIPS))
    for k, slots in enumerate(slots_of):
        slot = np.where(has, slots[np.maximum(last, 0)], -1)
        total = np.where(slot >= 0, counts[np.maximum(slot, 0)], 0).astype(float)
        shut = np.where(slot >= 0, counts[np.maximum(slot, 0) + SLOTS], 0).astype(float)
        if k < len(ORDERS):
            rate = (shut + rate) / (total + 1.0)
        own = rate if k < len(ORDERS) else (shut + 0.08) / (total + 1.0)
        columns += [np.log((own + 1e-4) / (1 - own + 1e-4)), np.log1p(total)]
    marks = []
    for x in tails:
        tail = x[-3:].lower()
        marks.append([ord(c) for c in tail] if len(tail) == 3 and tail.isalpha() else [0, 0, 0])
    letters = np.array(marks, dtype=np.uint64).reshape(-1, 3)
    key = letters[:, 2] + (letters[:, 1] << np.uint64(21)) + (letters[:, 0] << np.uint64(42))
    slot = (words.mix(key) % np.uint64(LETTERS)).astype(np.int64) + 2 * SLOTS
    known = letters[:, 2] > 0
    total = np.where(known, counts[slot], 0).astype(float)
    shut = np.where(known, counts[slot + LETTERS], 0).astype(float)
    word_end = (shut + 0.5) / (total + 1.0)
    columns += [np.log(word_end / (1 - word_end + 1e-6) + 1e-6), known.astype(float)]
    flags = []
    for x in prefixes:
        line = x[x.rfind("\n") + 1 :]
        fenced = x.count("```") & 1
        balance = sum(line.count(c) for c in "([{") - sum(line.count(c) for c in ")]}")
        end = x[-1:]
        flags.append(
            [
                float(fenced),
                float((line.count("`") & 1) and not fenced),
                float(balance > 0),
                float(x.count("{") > x.count("}")),
                float((line.count('"') & 1)),
                float(end in OPEN),
                float(end in FINAL),
                float(end.isalnum()),
                float(end.isdigit()),
                float(end in CLOSERS),
            ]
        )
    return np.column_stack([np.ones(size), *columns, np.array(flags).reshape(size, -1)]) if size else np.zeros((0, 0))


def examples(texts: list[str], seed: int) -> tuple[list[str], list[int]]:
    """Prefixes that end at a true unit end (0) or at a random place inside a unit (1)."""
    rng = np.random.default_rng(seed)
    prefixes, labels = [], []
    for x in texts:
        ends = {}
        for m in UNIT_END.finditer(x, 30):
            cut = x[: m.start()].rstrip()
            if cut and x.count("```", 0, len(cut)) % 2 == (1 if x[m.start() : m.start() + 4] == "\n```" else 0):
                ends[len(cut)] = cut
        spots = sorted(ends)
        if spots:
            spot = spots[rng.integers(len(spots))]
            prefixes.append(ends[spot].rstrip(FINAL + " "))
            labels.append(0)
        for place in rng.integers(30, max(31, len(x) - 1), 1):
            cut = x[:place].rstrip()
            if len(cut) in ends or not cut or cut[-1] in FINAL or cut[-1] in CLOSERS and len(cut) > 1 and cut[-2] in FINAL or (place < len(x) and UNIT_END.match(x, len(cut))):
                continue
            prefixes.append(cut)
            labels.append(1)
    return prefixes, labels


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    weights = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (y - p) - ridge * weights
        curve = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(curve, slope)
        weights += step
        if np.abs(step).max() < 1e-8:
            break
    return weights


@dataclass
class Model:
    """packed: the counters of all texts; weights: log odds of a cut by the ending; prior: what makes them odds at even chances; closed: log odds of a cut by a final mark, and by a full stop that may stand inside a sentence."""

    packed: bytes
    weights: np.ndarray
    prior: float
    closed: tuple[float, float] = (-6.0, -4.0)

    @cached_property
    def counts(self) -> np.ndarray:
        return arrays.unpack(self.packed)[0]


#: No mark at a cut is longer; the last characters of those marks.
TAIL = 60
MARK_ENDS = ".…])>�"


def open_ending(text: str) -> tuple[str, bool]:
    """The text without blanks and marks of a cut at its end, and whether it had such a mark."""
    bare = text.rstrip()
    tail = bare[-TAIL:]
    if tail[-1:] not in MARK_ENDS:
        return bare, False
    body = bare[: len(bare) - len(tail)] + CUT_MARK.sub("", tail)
    marked = body != bare
    return (body, True) if marked and WORDLIKE.search(body) else (bare, False)


def finished(body: str) -> bool:
    """Whether the last mark alone closes the text: a final mark outside code, or closed code."""
    fences = body.count("```")
    if fences & 1:
        return False
    if body.endswith("```"):
        return True
    bare = body[-TAIL:].rstrip(CLOSERS)
    if bare.endswith("#"):
        bare = bare.rstrip("#").rstrip().rstrip(CLOSERS)
    return bool(bare) and bare[-1] in FINAL and not re.search(r"(?:\b(?:e\.g|i\.e|Dr|Prof|vs|approx|Fig|Sec|No|cf|bzw|Nr|Abb|ca|z|p|ej|env|chap|cap))\.\Z", bare)


def inner_stop(body: str) -> bool:
    return bool(INNER_STOP.search(body[-TAIL:].rstrip(CLOSERS)))


def closed_odds(texts: list[str], seed: int) -> tuple[float, float]:
    """Log odds of a cut for texts with a final mark, by how often random places inside a sentence look so (see ``Model``)."""
    rng = np.random.default_rng(seed)
    inside, whole, places = [0, 0], [0, 0], 0
    for x in texts:
        body = x.rstrip()
        if finished(body):
            whole[inner_stop(body)] += 1
        for place in rng.integers(30, max(31, len(x) - 1), 4):
            part = x[:place].rstrip()
            places += 1
            if part and not part.endswith("```") and finished(part) and not UNIT_END.match(x, len(part.rstrip(CLOSERS)) - 1):
                inside[inner_stop(part)] += 1
    plain, stop = (math.log((inside[k] + 0.5) / (places + 1)) - math.log((whole[k] + 0.5) / (len(texts) + 1)) for k in (0, 1))
    return min(plain, 0.0), min(stop, 0.0)


def known_endings(bodies: list[str], counts: np.ndarray) -> np.ndarray:
    """Whether each short text is a sentence whose last three words stand elsewhere, too, or that breaks off in an unknown word after a known pair."""
    w = words.words(bodies, digits_equal=True)
    size = np.bincount(w.row, minlength=len(bodies))
    last = np.cumsum(size) - 1
    held = np.flatnonzero(size >= LEAST_WORDS)
    known = np.zeros(len(bodies), dtype=bool)
    if len(held):
        one, two, three = (context_slots(w, order) for order in (1, 2, 3))
        end = last[held]
        known[held] = (counts[three[end]] >= LEAST_SEEN) | ((counts[one[end]] == 0) & (counts[two[end - 1]] >= LEAST_SEEN))
    return known


def ending_odds(texts: list[str], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log odds that each text is cut, by its ending alone, whether the model gave them, whether they count at a limit only).

    -inf for blank texts. Texts with a final mark, and short ones whose end is not known from
    other texts, without a mark of a cut or an open block of code, are cut by a limit or not at all.
    """
    odds, learned, bound = np.full(len(texts), -np.inf), np.zeros(len(texts), dtype=bool), np.zeros(len(texts), dtype=bool)
    asked: list[int] = []
    bodies: list[str] = []
    short: list[tuple[int, str]] = []
    for k, x in enumerate(texts):
        body, marked = open_ending(x)
        if not WORDLIKE.search(body):
            continue
        if marked:
            odds[k] = 6.0 if not finished(body) else -3.0
        elif finished(body):
            odds[k], bound[k] = model.closed[inner_stop(body)], True
        elif body.count("```") & 1 or len(body) >= SHORT and DANGLING.search(body[-TAIL:]):
            odds[k] = 6.0
        elif len(body) < SHORT:
            odds[k], bound[k] = 0.0, True
            short.append((k, body))
        else:
            asked.append(k)
            bodies.append(body)
    for (k, body), known in zip(short, known_endings([b for _, b in short], model.counts) if short else (), strict=True):
        if known:
            bound[k] = False
            asked.append(k)
            bodies.append(body)
    if asked:
        odds[asked] = endings(bodies, model.counts) @ model.weights + model.prior
        learned[asked] = True
    return odds, learned, bound


def cut_share(odds: np.ndarray, n: np.ndarray, start: float = 0.3, pool: float = 0.0) -> float:
    """Share of cuts among ``n`` values of such log odds at even chances (EM), with ``pool`` more values at ``start``."""
    share, total = start, n.sum() + pool
    for _ in range(200 if n.sum() else 0):
        chance = 1 / (1 + np.exp(-np.clip(odds + math.log(share / (1 - share)), -30, 30)))
        new = float(np.clip((n @ chance + pool * start) / total, 0.01, 0.9))
        share, moved = new, abs(new - share)
        if moved < 1e-6:
            break
    return share


#: Log odds are counted in steps of this part of one.
STEPS = 10


def source_shares(odds: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(source, share): the share of cuts of each source, from all of its rows (source, odds). Only counts by step reach a group."""
    step = F.round(F.greatest(F.least(F.col("odds"), F.lit(30.0)), F.lit(-30.0)) * STEPS).cast("long")
    counted = odds.groupBy("source", step.alias("step")).agg(F.count("*").alias("n"))
    whole = counted.groupBy("step").agg(F.sum("n").alias("n")).orderBy("step").collect()
    n = np.array([r["n"] for r in whole], dtype=float)
    overall = cut_share(np.array([r["step"] for r in whole], dtype=float) / STEPS, n) if n.sum() >= 50 else 0.3

    def run(table: pa.Table) -> pa.Table:
        share = cut_share(table.column("step").to_numpy() / STEPS, table.column("n").to_numpy().astype(float), overall, settings.pool)
        return pa.table({"source": table.column("source")[:1].cast(pa.string()), "share": pa.array([share])})

    return counted.groupBy("source").applyInArrow(run, "source string, share double")


def lowest_texts(texts: DataFrame, settings: Settings) -> DataFrame:
    """(text, hash): about as many distinct texts as the sample has, those with the lowest hashes; rather more than fewer.

    Where to stop follows from an estimate of how many distinct ones there are, so that what is
    fetched does not depend on the number of tasks.
    """
    hashed = texts.where(F.length("text") >= settings.least).select("text", F.xxhash64("text").alias("hash"))
    known = hashed.agg(F.approx_count_distinct("hash", 0.02)).first()[0]
    wanted = 1.05 * (settings.sample + 5 * math.sqrt(settings.sample) + 10)
    share = wanted / known if known else 1.0
    return (hashed if share >= 1 else hashed.where(F.col("hash") <= int(-(1 << 63) + share * ((1 << 64) - 1)))).distinct()


def distinct_sample(texts: DataFrame, settings: Settings) -> list[str]:
    """At most ``settings.sample`` distinct texts, those with the lowest hashes. A text counts once however often it stands there."""
    return [row["text"] for row in lowest_texts(texts, settings).orderBy("hash", "text").limit(settings.sample).collect()]


def fit(texts: DataFrame, settings: Settings = Settings()) -> Model:
    """The ending model of all texts (a column ``text``).

    The counters cover every text. The weights are fitted on ``settings.sample`` distinct ones,
    the lowest by hash.
    """
    counts = arrays.slot_sums(texts, ending_counts, COUNTERS)
    packed = arrays.pack(counts)
    sample = distinct_sample(texts, settings)
    prefixes, labels = examples(sample, settings.seed)
    y = np.array(labels, dtype=float)
    if not 0 < y.sum() < len(y):
        return Model(packed, np.zeros(1 + 2 * (len(ORDERS) + len(SKIPS)) + 2 + 10), 0.0)
    weights = logistic(endings(prefixes, counts), y)
    return Model(packed, weights, -math.log(y.mean() / (1 - y.mean())), closed_odds(sample, settings.seed))


def truncated(df: DataFrame, id: str, text: str, source: str, model: Model, limits: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(id, source, n_chars, censored, cut_odds, cut): every row of ``df``.

    censored: posterior that a value of this length was cut by a limit (null where the length
    is no limit). Null and blank texts are not cut. Repeated rows give repeated results.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        odds, learned, bound = ending_odds(arrays.strings(batch, "text"), shared.value)
        return pa.RecordBatch.from_pydict({c: batch.column(c) for c in ("id", "source", "n_chars", "n_bytes")} | {"odds": pa.array(odds), "learned": pa.array(learned), "bound": pa.array(bound)})

    rows = cut(arrays.arrow_map(narrowed(df, id, text, source), run, "id long, source string, n_chars long, n_bytes long, odds double, learned boolean, bound boolean"))
    by = limits.groupBy("source", "unit", "length").agg(F.max("censored").alias("censored"))
    chars = by.where("unit = 'chars'").select("source", F.col("length").alias("n_chars"), F.col("censored").alias("in_chars"))
    octets = by.where("unit = 'bytes'").select("source", F.col("length").alias("n_bytes"), F.col("censored").alias("in_bytes"))
    joined = rows.join(chars, ["source", "n_chars"], "left").join(octets, ["source", "n_bytes"], "left")
    known = joined.withColumn("censored", F.greatest("in_chars", "in_bytes"))
    shares = source_shares(known.where("learned and censored is null").select("source", "odds"), settings)
    held = F.when(F.col("censored") > 0.999, F.lit(0.999)).otherwise(F.col("censored"))  # least() would skip nulls
    # a value at a limit has the posterior of its length, any other the share of cuts of its source
    before = F.coalesce(F.log(held / (1 - held)), F.when(F.col("learned"), F.log(F.col("share") / (1 - F.col("share")))), F.lit(0.0))
    both = F.when((F.col("odds") < -1e30) | (F.col("bound") & F.col("censored").isNull()), F.lit(-30.0)).otherwise(F.col("odds") + before)
    chance = 1 / (1 + F.exp(-F.greatest(F.least(F.col("cut_odds"), F.lit(30.0)), F.lit(-30.0))))
    return known.join(shares, "source", "left").withColumn("cut_odds", both).withColumn("cut", chance >= settings.threshold).select("id", "source", "n_chars", "censored", "cut_odds", "cut")


def narrowed(df: DataFrame, id: str, text: str, source: str) -> DataFrame:
    body = F.rtrim(arrays.text(text))
    return df.select(
        F.col(id).cast("long").alias("id"), arrays.text(source).alias("source"), arrays.text(text).alias("text"), F.length(body).cast("long").alias("n_chars"), F.octet_length(body).cast("long").alias("n_bytes")
    )


def lengths_of(df: DataFrame, id: str, text: str, source: str) -> DataFrame:
    """(source, unit, length) of each distinct value in characters and in bytes."""
    rows = narrowed(df, id, text, source).where("n_chars > 0").select("id", "source", "n_chars", "n_bytes").distinct()
    return rows.select("source", F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("n_chars").alias("length")), F.struct(F.lit("bytes").alias("unit"), F.col("n_bytes").alias("length")))).alias("x")).select("source", "x.unit", "x.length")


@dataclass(frozen=True)
class Ends:
    """How sure an end id is: the chance that a whole sequence lacks it, and that a cut one ends with it all the same."""

    lost: float = 1e-3
    forged: float = 1e-6

    def odds(self, ended: Column) -> Column:
        """Log odds of a cut by the last id alone."""
        return F.when(ended, math.log(self.forged / (1 - self.lost))).otherwise(math.log((1 - self.forged) / self.lost))


def truncated_tokens(df: DataFrame, id: str, ids: str, end_token: int, settings: Settings = Settings(), ends: Ends = Ends()) -> DataFrame:
    """(id, n_tokens, censored, cut_odds, cut): sequences that lost their end.

    The lengths give the training length as for texts, and a sequence of just that length has
    the posterior that it was censored there; any other has the share of cuts of all those at
    no limit, estimated from all of them. The last id is the evidence that is added. Null and
    empty sequences are not cut; what a flag says is not read.
    """
    ended = F.element_at(F.when(F.size(ids) > 0, F.col(ids)), -1) == end_token
    rows = df.select(F.col(id).cast("long").alias("id"), F.size(F.coalesce(F.col(ids), F.array())).cast("long").alias("n_tokens"), F.coalesce(ended, F.lit(False)).alias("ended"))
    limits = length_limits(rows.where("n_tokens > 0").select(F.lit("").alias("source"), F.lit("tokens").alias("unit"), F.col("n_tokens").alias("length")), settings)
    known = rows.join(limits.select(F.col("length").alias("n_tokens"), "censored"), "n_tokens", "left").withColumn("odds", ends.odds(F.col("ended")))
    free = known.where("n_tokens > 0 and censored is null").groupBy("odds").agg(F.count("*").alias("n")).collect()  # two rows
    share = cut_share(np.array([r["odds"] for r in free]), np.array([r["n"] for r in free], dtype=float)) if free else 0.3
    held = F.when(F.col("censored") > 0.999, F.lit(0.999)).otherwise(F.col("censored"))
    both = F.when(F.col("n_tokens") == 0, F.lit(-30.0)).otherwise(F.col("odds") + F.coalesce(F.log(held / (1 - held)), F.lit(math.log(share / (1 - share)))))
    return known.withColumn("cut_odds", both).withColumn("cut", F.col("cut_odds") >= math.log(settings.threshold / (1 - settings.threshold))).select("id", "n_tokens", "censored", "cut_odds", "cut")
