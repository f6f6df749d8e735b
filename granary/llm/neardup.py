"""Near-duplicate records: all pairs above a Jaccard threshold, by signature trees.

Each record is the set of its distinct runs of ``n`` neighbouring words. Equal sets are one
class. Classes meet where they can be alike at all: a pair that reaches the threshold shares
a token among the rarest of either set (the prefix bound of set similarity joins), so each
class is sent once to every such token's tree. In a tree the classes of one token are sorted
by set size; a leaf holds a few of them, and each node holds the OR of their token bitmaps,
the range of their sizes and their largest surplus of tokens over bits. Two nodes are
traversed together from the roots down, and a pair of nodes is left as soon as its maximum
possible overlap is below the least overlap that the threshold asks of their sizes. What
passes at the leaves is verified on the whole sets, so the result is exact.

Tokens are counted over all records in slots, eight for each record up to 2^24; the counts
only define the order "rare first" (any common order gives the same result). Where a language
is used up, each token's records grow with the collection and the pairs in its tree with their
square. So a token of more than ``common`` records, and of more than four times the mean of the
slots, has no tree; in its place stand pairs of such tokens, neighbours in the order of their
hashes within the record, the edges included. A token that the other set lacks breaks two of
these pairs at most, one that it has besides breaks one; the prefix bound counts both, so that
no alike records are missed (``bounds``). Pairs are counted and ordered like tokens. A token or
pair of more than ``hot`` records, and of more than four times the mean, is split into blocks
of records, and each pair of blocks gets a tree of its own.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm import arrays, words
from granary.session import cut, shuffle_width

TOKEN_BITS = 44
TOKEN_MASK = np.uint64((1 << TOKEN_BITS) - 1)


@dataclass(frozen=True)
class Alike:
    """What counts as alike, and sizes of the working structures (none changes the result)."""

    shingle: int = 5
    threshold: float = 0.8
    slots_per_record: int = 8
    least_slots: int = 1 << 20
    most_slots: int = 1 << 24
    bitmap_words: int = 3
    fan_out: int = 8
    common: int = 500
    hot: int = 8192
    postings_per_tree: int = 500_000
    #: Bits of the filter for the records that stand in a candidate pair, whose sets are needed again.
    most_bits: int = 1 << 28

    @property
    def ratio(self) -> Fraction:
        return Fraction(str(self.threshold))


@dataclass(frozen=True)
class Sets:
    """Token sets of a chunk of texts: index of the text and token, sorted; sizes and class ids by text."""

    row: np.ndarray
    token: np.ndarray
    size: np.ndarray
    key: np.ndarray


def token_sets(texts: list[str], n: int) -> Sets:
    w = words.words(texts)
    hashes, at = words.runs(w.row, w.hash, n)
    owner = w.row[at].astype(np.uint64)
    both = words.distinct((owner << np.uint64(TOKEN_BITS)) | (hashes & TOKEN_MASK))
    row = (both >> np.uint64(TOKEN_BITS)).astype(np.int64)
    token = both & TOKEN_MASK
    size = np.bincount(row, minlength=len(texts))
    total = np.zeros(len(texts), dtype=np.uint64)
    held = np.flatnonzero(size)
    if len(held):
        first = (np.cumsum(size) - size)[held]
        total[held] = np.add.reduceat(words.mix(token * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)), first)
    key = words.mix(total + size.astype(np.uint64)).view(np.int64)
    return Sets(row, token, size, key)


def ceil_of(share: Fraction, size: np.ndarray) -> np.ndarray:
    return -((-share.numerator * size) // share.denominator)


def prefix_length(size: np.ndarray, share: Fraction) -> np.ndarray:
    return np.where(size > 0, size - ceil_of(share, size) + 1, 0)


def chunk_sets(batch: pa.RecordBatch, n: int) -> Iterator[tuple[int, Sets]]:
    texts = arrays.strings(batch, "text")
    for begin, end in words.chunks(texts):
        yield begin, token_sets(texts[begin:end], n)


def bitmaps(sets: Sets, count: int) -> np.ndarray:
    """A bitmap of ``count`` 64-bit words of each text's tokens."""
    place = words.mix(sets.token) % np.uint64(64 * count)
    out = np.zeros((len(sets.size), count), dtype=np.uint64)
    held = np.flatnonzero(sets.size)
    if len(held):
        bit, part = np.uint64(1) << (place & np.uint64(63)), place >> np.uint64(6)
        first = (np.cumsum(sets.size) - sets.size)[held]
        for k in range(count):
            out[held, k] = np.bitwise_or.reduceat(np.where(part == k, bit, np.uint64(0)), first)
    return out


def hot_bound(counts: np.ndarray, a: Alike) -> int:
    """Postings from which a token is split."""
    return max(a.hot, math.ceil(4 * float(counts.mean())))


def common_bound(counts: np.ndarray, a: Alike) -> int:
    """Records from which a token is taken with its neighbour only; below a threshold of a half the pairs prove nothing."""
    return max(a.common, math.ceil(4 * float(counts.mean()))) if a.ratio * 2 >= 1 else arrays.MOST


def expected_postings(counts: np.ndarray, a: Alike, joint: np.ndarray | None = None) -> int:
    """About how many postings are sent if every token and pair stands in prefixes as often as any other, those of split ones repeated."""
    n = counts[counts <= common_bound(counts, a)].astype(np.float64) if joint is not None else counts.astype(np.float64)
    total = float((n * np.ceil(n / hot_bound(counts, a))).sum())
    if joint is not None:
        m = joint.astype(np.float64)
        total += float((m * np.ceil(m / hot_bound(joint, a))).sum())
    return math.ceil(total * float(1 - a.ratio))


EDGE = np.uint64(1 << 60)


def neighbours(row: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every two tokens that follow each other among a text's sorted tokens, its edges counted as tokens."""
    if not len(row):
        return row, token
    opens = np.append(True, row[1:] != row[:-1])
    closes = np.append(opens[1:], True)
    before = np.append(EDGE, token[:-1])
    before[opens] = EDGE
    left, right = np.concatenate([before, token[closes]]), np.concatenate([token, np.full(closes.sum(), EDGE)])
    return np.concatenate([row, row[closes]]), words.mix(words.mix(left + np.uint64(1)) + right) & TOKEN_MASK


def bounds(size: np.ndarray, share: Fraction, shorter: bool) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens a set of a pair that is alike can lack in the other, and how many neighbour pairs that breaks at most.

    With sizes s and r of this set and the other one the overlap is o >= c (s + r), c = share / (1 + share).
    s - o tokens are lacking and break two pairs each, r - o are added and break one each:
    2 s + r - 3 o <= s (2 - 3 c) + r (1 - 3 c), most for the least r, as 1 - 3 c <= 0 from a share of a half on.
    """
    c = share / (1 + share)
    least = Fraction(1) if shorter else share
    broken = 2 - 3 * c + least * (1 - 3 * c)
    return prefix_length(size, 2 * c if shorter else share) - 1, broken.numerator * size // broken.denominator


def in_prefix(rank: np.ndarray, pair: np.ndarray, size: np.ndarray, singles: np.ndarray, share: Fraction, shorter: bool) -> np.ndarray:
    """Whether all before each place can be missing in an alike set: tokens first, then pairs; each lacking token costs its own place or two pairs."""
    lacking, broken = bounds(size, share, shorter)
    return np.where(pair, (singles <= lacking) & (rank - singles <= broken - 2 * singles), rank <= lacking)


def postings(sets: Sets, order: np.ndarray, hot: int, a: Alike, joint: np.ndarray | None = None, common: int = arrays.MOST, split: int | None = None) -> tuple[np.ndarray, ...]:
    """(token, text, whether the token binds the shorter of a pair, side) of each prefix.

    With ``joint``, the counts of neighbour pairs, tokens of more than ``common`` records are
    replaced by these pairs, which are split from ``split`` records on.
    """
    t = a.ratio
    row, token = sets.row, sets.token
    count = order[(token & np.uint64(len(order) - 1)).astype(np.int64)].astype(np.int64)
    blocks, pair = -(-count // hot), np.zeros(len(row), dtype=bool)
    singles = sets.size
    if joint is not None and (often := count > common).any():
        where, both = neighbours(row[often], token[often])
        met = joint[(both & np.uint64(len(joint) - 1)).astype(np.int64)].astype(np.int64)
        singles = np.bincount(row[~often], minlength=len(sets.size))
        pair = np.append(pair[~often], np.ones(len(both), dtype=bool))
        row, token, count = np.append(row[~often], where), np.append(token[~often], both), np.append(count[~often], met)
        blocks = np.append(blocks[~often], -(-met // (split or hot)))
    by = np.argsort((row.astype(np.uint64) << np.uint64(33)) | (pair.astype(np.uint64) << np.uint64(32)) | count.astype(np.uint64), kind="stable")
    row, token, pair, blocks = row[by], token[by], pair[by], blocks[by]
    length = np.bincount(row, minlength=len(sets.size))
    rank = np.arange(len(row)) - (np.cumsum(length) - length)[row]
    held = in_prefix(rank, pair, sets.size[row], singles[row], t, False)
    row, rank, token, pair, blocks = row[held], rank[held], token[held], pair[held], blocks[held]
    short = in_prefix(rank, pair, sets.size[row], singles[row], t, True)
    side = np.zeros(len(row), dtype=np.uint8)
    many = blocks > 1
    if not many.any():
        return token, row, short, side
    # one posting for each pair of blocks that the class takes part in
    r, s, tok, k = row[many], short[many], token[many], blocks[many]
    own = (words.mix(sets.key[r].view(np.uint64)) % k.astype(np.uint64)).astype(np.int64)
    each = np.repeat(np.arange(len(r)), k)
    other = np.arange(len(each)) - np.repeat(np.cumsum(k) - k, k)
    own, low = own[each], np.minimum(own[each], other)
    met = low * (1 << 20) + np.maximum(own, other)
    tree = words.mix(tok[each] ^ words.mix(met.astype(np.uint64) + np.uint64(1))) & TOKEN_MASK
    which = np.where(own == other, 0, np.where(own < other, 1, 2)).astype(np.uint8)
    return (
        np.concatenate([token[~many], tree]),
        np.concatenate([row[~many], r[each]]),
        np.concatenate([short[~many], s[each]]),
        np.concatenate([side[~many], which]),
    )


def unseen(sets: Sets, seen: set[int]) -> np.ndarray:
    """Whether each text is the first of its class in the task; ``seen`` holds the classes met so far.

    A group of copies, however large, thus counts once in a task and sends its tokens once.
    """
    keys, first = np.unique(sets.key, return_index=True)
    new = [k for k, key in zip(first.tolist(), keys.tolist(), strict=True) if key not in seen]
    seen.update(keys.tolist())
    once = np.zeros(len(sets.key), dtype=bool)
    once[new] = True
    return once


def emit(batch: pa.RecordBatch, prefixes: Callable[[Sets], tuple[np.ndarray, ...]], trees: int, a: Alike, seen: set[int]) -> pa.RecordBatch:
    """For each group of trees one packed row of the batch's classes and their tokens there."""
    group: list[int] = []
    packed: list[bytes] = []
    for _, sets in chunk_sets(batch, a.shingle):
        once = unseen(sets, seen)
        bits = bitmaps(sets, a.bitmap_words)
        token, row, short, side = prefixes(sets)
        keep = once[row]
        token, row, short, side = token[keep], row[keep], short[keep], side[keep]
        at = (token % np.uint64(trees)).astype(np.int64)
        by = np.lexsort((token, at))
        token, row, short, side, at = token[by], row[by], short[by], side[by], at[by]
        bounds = np.flatnonzero(np.diff(at)) + 1
        for part in np.split(np.arange(len(at)), bounds) if len(at) else []:
            here, local = np.unique(row[part], return_inverse=True)
            group.append(int(at[part[0]]))
            packed.append(
                arrays.pack(
                    np.diff(token[part], prepend=np.uint64(0)),
                    local.astype(np.uint16),
                    (short[part] + 2 * side[part]).astype(np.uint8),
                    sets.key[here],
                    sets.size[here].astype(np.uint32),
                    bits[here],
                )
            )
    return pa.RecordBatch.from_pydict({"tree": pa.array(group, pa.int32()), "packed": pa.array(packed, pa.binary())})


class Forest:
    """Signature trees over postings that are sorted by (token, size): one tree for each token."""

    def __init__(self, token: np.ndarray, size: np.ndarray, bits: np.ndarray, fan_out: int):
        self.size, self.bits = size.astype(np.int64), bits
        self.surplus = self.size - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        #: Levels from the leaves' entries up: first child of each node, smallest and largest size, surplus, OR of bitmaps.
        self.levels: list[tuple[np.ndarray, ...]] = []
        self.fan_out = fan_out
        owner = np.cumsum(np.concatenate([[0], token[1:] != token[:-1]])) if len(token) else np.zeros(0, dtype=np.int64)
        low, high, extra, ors = self.size, self.size, self.surplus, bits
        while True:
            begins = np.concatenate([[True], owner[1:] != owner[:-1]])
            heads = np.flatnonzero(begins)
            inside = np.arange(len(owner)) - heads[np.cumsum(begins) - 1]
            first = np.flatnonzero(inside % fan_out == 0)
            low, high = np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)
            extra, ors = np.maximum.reduceat(extra, first), np.bitwise_or.reduceat(ors, first, axis=0)
            self.levels.append((np.append(first, len(owner)), low, high, extra, ors))
            owner = owner[first]
            if (owner[1:] != owner[:-1]).all():
                break

    def pairs(self, short: np.ndarray, side: np.ndarray, ratio: float, budget: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Entries that can be alike, in blocks of about ``budget`` node pairs."""
        roots = np.arange(len(self.levels[-1][1]))
        stack = [(len(self.levels) - 1, roots, roots)]
        while stack:
            level, a, b = stack.pop()
            if level < 0:
                keep = (a < b) & short[a] & ((side[a] == 0) | (side[a] != side[b]))
                a, b = a[keep], b[keep]
                keep = self.fits(self.size, self.size, self.surplus, self.bits, a, b, ratio)
                yield a[keep], b[keep]
                continue
            first, low, high, extra, ors = self.levels[level]
            keep = self.fits(low, high, extra, ors, a, b, ratio)
            a, b = a[keep], b[keep]
            many = (first[a + 1] - first[a]) * (first[b + 1] - first[b])
            cuts = np.searchsorted(np.cumsum(many), np.arange(budget, many.sum() + budget, budget))
            for left, right in zip(np.append(0, cuts[:-1] + 1), cuts + 1, strict=True):
                x, y, m = a[left:right], b[left:right], many[left:right]
                if not len(x):
                    continue
                each = np.repeat(np.arange(len(x)), m)
                inner = np.arange(len(each)) - np.repeat(np.cumsum(m) - m, m)
                wide = (first[y + 1] - first[y])[each]
                ca, cb = first[x][each] + inner // wide, first[y][each] + inner % wide
                keep = ca <= cb
                stack.append((level - 1, ca[keep], cb[keep]))

    @staticmethod
    def fits(low: np.ndarray, high: np.ndarray, extra: np.ndarray, ors: np.ndarray, a: np.ndarray, b: np.ndarray, ratio: float) -> np.ndarray:
        """Whether the maximum possible overlap of each pair of nodes (a before b) reaches the least one needed."""
        keep = np.flatnonzero(high[a] + 1e-9 >= ratio * low[b])
        x, y = a[keep], b[keep]
        most = np.minimum(extra[x], extra[y])
        for k in range(ors.shape[1]):
            most = most + np.bitwise_count(ors[x, k] & ors[y, k])
        most = np.minimum(most, np.minimum(high[x], high[y]))
        result = np.zeros(len(a), dtype=bool)
        result[keep] = most + 1e-9 >= ratio / (1 + ratio) * (low[x] + low[y])
        return result


def traverse(table: pa.Table, a: Alike) -> pa.Table:
    """Pairs of classes of one group of trees that can be alike."""
    token, row, short, side, key, size, bits = [], [], [], [], [], [], []
    seen = 0
    for blob in table.column("packed"):
        steps, local, marks, keys, sizes, maps = arrays.unpack(blob.as_py())
        token.append(np.cumsum(steps))
        row.append(local.astype(np.int64) + seen)
        short.append(marks & 1)
        side.append(marks >> 1)
        key.append(keys)
        size.append(sizes)
        bits.append(maps)
        seen += len(keys)
    keys, first, same = np.unique(np.concatenate(key), return_index=True, return_inverse=True)
    sizes, maps = np.concatenate(size)[first], np.concatenate(bits)[first]
    token, row = np.concatenate(token), same[np.concatenate(row)]
    short, side = np.concatenate(short).astype(bool), np.concatenate(side)
    by = np.lexsort((row, sizes[row], token))
    token, row, short, side = token[by], row[by], short[by], side[by]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (token[1:] != token[:-1]) | (row[1:] != row[:-1])
    token, row, short, side = token[new], row[new], short[new], side[new]
    found = [np.zeros(0, dtype=np.int64)]
    for x, y in Forest(token, sizes[row], maps[row], a.fan_out).pairs(short, side, float(a.ratio)):
        low, high = np.minimum(row[x], row[y]), np.maximum(row[x], row[y])
        found.append(words.distinct(low * len(keys) + high))
    pairs = words.distinct(np.concatenate(found))
    return pa.table({"a": pa.array(keys[pairs // len(keys)]), "b": pa.array(keys[pairs % len(keys)])})


class NearDuplicates:
    """Near-duplicate classes of the records of ``df``.

    df needs ``id`` and the text columns; other columns are not read. Nulls are empty texts.
    Rows without an id are left out. Records of fewer than ``shingle`` words have no token and
    are alike to none. A record delivered again under its id is one record.
    """

    def __init__(self, df: DataFrame, id: str, columns: list[str], alike: Alike = Alike()):
        self.alike = alike
        self.spark = df.sparkSession
        self.counts: tuple[np.ndarray, np.ndarray] | None = None
        self.texts = df.where(F.col(id).isNotNull()).select(
            F.col(id).cast("long").alias("id"), F.concat_ws(" ", *[arrays.text(c) for c in columns]).alias("text")
        )

    def members(self) -> DataFrame:
        """(id, class id, set size) of each record with a token; the same pass over the texts counts the neighbour pairs."""
        a, counts = self.alike, self.token_counts()
        slots, bound = len(counts), common_bound(counts, a)
        often = self.spark.sparkContext.broadcast(np.packbits(counts > bound, bitorder="little"))

        def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, seen = np.zeros(slots, dtype=np.int64), set()
            for batch in batches:
                found = []
                for _, sets in chunk_sets(batch, a.shingle):
                    found.append(sets)
                    held = unseen(sets, seen)[sets.row] & arrays.in_bitmap(often.value, sets.token)
                    np.add.at(total, (neighbours(sets.row[held], sets.token[held])[1] & np.uint64(slots - 1)).astype(np.int64), 1)
                if found:
                    key, size = np.concatenate([s.key for s in found]), np.concatenate([s.size for s in found])
                    held = size > 0
                    yield of(id=batch.column("id").filter(pa.array(held)), key=pa.array(key[held]), size=pa.array(size[held].astype(np.int32)))
            yield of(**arrays.blocks_of(total))

        schema = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("size", pa.int32()), ("block", pa.int32()), ("counts", pa.binary())])

        def of(**columns: pa.Array) -> pa.RecordBatch:
            n = len(next(iter(columns.values())))
            return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in schema], schema=schema)

        once = cut(self.texts.mapInArrow(keys, "id long, key long, size int, block int, counts binary"))
        joint = arrays.added(once.where("block IS NOT NULL").select("block", "counts"), slots)
        self.counts = counts, joint
        return once.where("block IS NULL").select("id", "key", "size").distinct()

    def token_counts(self) -> np.ndarray:
        """How often tokens fall in each slot, each class once a task; the number of slots follows the number of records."""
        a = self.alike
        slots = arrays.power_above(a.slots_per_record * self.texts.count(), a.least_slots, a.most_slots)

        def slots_of(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
            seen: set[int] = set()
            for batch in batches:
                for _, sets in chunk_sets(batch, a.shingle):
                    yield (sets.token[unseen(sets, seen)[sets.row]] & np.uint64(slots - 1)).astype(np.int64)

        return arrays.slot_sums(self.texts.select("text"), slots_of, slots)

    def candidates(self) -> DataFrame:
        """Pairs of classes (a < b) that the trees could not tell apart."""
        if self.counts is None:
            self.members()
        a, (counts, joint) = self.alike, self.counts
        common, hot, split = common_bound(counts, a), hot_bound(counts, a), hot_bound(joint, a)
        trees = max(shuffle_width(self.spark), math.ceil(expected_postings(counts, a, joint) / a.postings_per_tree))
        shared = self.spark.sparkContext.broadcast((counts.view(np.uint32), joint.view(np.uint32)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[int] = set()
            for batch in batches:
                yield emit(batch, lambda sets: postings(sets, shared.value[0], hot, a, shared.value[1], common, split), trees, a, seen)

        packed = self.texts.select("text").mapInArrow(run, "tree int, packed binary")
        found = packed.groupBy("tree").applyInArrow(lambda table: traverse(table, a), "a long, b long")
        return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def links(self) -> DataFrame:
        """(a, b, both, either): pairs of classes that reach the threshold, verified on the whole sets.

        The sets are made again of the classes in candidate pairs alone: a bitmap of their keys,
        eight bits for each up to ``most_bits``, keeps nearly all others back, the join the rest.
        """
        a, t = self.alike, self.alike.ratio
        candidates = cut(self.candidates())
        asked = candidates.select(F.col("a").alias("key")).unionByName(candidates.select(F.col("b").alias("key"))).distinct()
        bits = arrays.power_above(8 * asked.count(), 1 << 20, a.most_bits)
        wanted = self.spark.sparkContext.broadcast(arrays.key_bitmap(asked, bits))

        def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[int] = set()
            for batch in batches:
                keys, sets_of = [], []
                for _, sets in chunk_sets(batch, a.shingle):
                    first = np.cumsum(sets.size) - sets.size
                    for k in np.flatnonzero(unseen(sets, seen) & arrays.in_bitmap(wanted.value, sets.key)):
                        keys.append(int(sets.key[k]))
                        sets_of.append(sets.token[first[k] : first[k] + sets.size[k]].astype(np.int64))
                yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.int64()), "tokens": pa.array(sets_of, pa.list_(pa.int64()))})

        sets = self.texts.select("text").mapInArrow(kept, "key long, tokens array<long>").groupBy("key").agg(F.first("tokens").alias("tokens"))
        left, right = sets.select(F.col("key").alias("a"), F.col("tokens").alias("x")), sets.select(F.col("key").alias("b"), F.col("tokens").alias("y"))
        both = F.size(F.array_intersect("x", "y")).cast("long")
        either = F.size("x") + F.size("y") - F.col("both")
        joined = candidates.join(left, "a").join(right, "b").withColumn("both", both).withColumn("either", either)
        return joined.where(F.col("both") * t.denominator >= F.col("either") * t.numerator).select("a", "b", "both", "either")

    def pairs(self) -> DataFrame:
        """(id_a, id_b), id_a < id_b: every pair of different ids that is alike, copies included."""
        members = cut(self.members())
        low, high = members.select(F.col("key").alias("a"), F.col("id").alias("x")), members.select(F.col("key").alias("b"), F.col("id").alias("y"))
        linked = self.links().select("a", "b").join(low, "a").join(high, "b").select("x", "y")
        repeated = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("key").alias("a"))
        again = repeated.join(low, "a").join(members.select(F.col("key").alias("a"), F.col("id").alias("y")), "a").where("x < y").select("x", "y")
        return (
            linked.where("x <> y")
            .unionByName(again)
            .select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
            .distinct()
        )

    def groups(self) -> DataFrame:
        """(id, class_id, group_id, links): one row per record with a token; class and group are named after their smallest id.

        A class holds the records of equal token sets, links counts the other classes it is alike to.

        Groups are the components of the links, found by rounds of large-star and small-star
        steps whose lineage is cut in the shared checkpoint folder.
        """
        members = cut(self.members())
        links = cut(self.links().select("a", "b"))
        degree = links.select("a").unionByName(links.select(F.col("b").alias("a"))).groupBy("a").agg(F.count("*").alias("links"))
        roots = components(links, "a", "b")
        classes = members.groupBy("key").agg(F.min("id").alias("class_id"))
        named = classes.join(roots.select(F.col("node").alias("key"), "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))
        names = named.groupBy("root").agg(F.min("class_id").alias("group_id"))
        of_class = named.join(names, "root").join(degree.select(F.col("a").alias("key"), "links"), "key", "left")
        return members.join(of_class, "key").select("id", "class_id", "group_id", F.coalesce("links", F.lit(0)).alias("links"))


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): the smallest node reachable from each node of the links."""
    edges = cut(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    while True:
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = around.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(smallest, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(smallest.select("u", F.col("m").alias("v"))).distinct()
        after = cut(small)
        changed = after.exceptAll(edges).limit(1).count() + edges.exceptAll(after).limit(1).count()
        edges = after
        if not changed:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
