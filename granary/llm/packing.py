"""Items of varying length in containers of fixed capacity, by swap-based local search.

Documents are measured in tokens. What exceeds the capacity alone is split into full
containers and a rest; everything else stays whole. Items are packed in shards of bounded
size: a best-fit start, then a local search that takes the emptiest container and moves its
items out, exchanges one for one, two for one or one for two with other underfull containers,
always so that the sum of squared fills rises, until the container is empty or no exchange
helps. It ends when there are as few containers as their contents need, which proves that none
can be emptied any more, or when its effort is spent. The underfull containers of all shards
are opened again and dealt to new shards of the same bounded size, as long as that can still
save a share of them worth a round.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm import arrays, subwords
from granary.session import cut


@dataclass(frozen=True)
class Settings:
    """How large shards are, and how much effort goes into the search; the README gives fills by effort.

    shard: items packed together, in every round. sources: containers that may resist being
    emptied, one after another, before a shard's search ends; partners: containers, emptiest
    first, that each of them is offered to. least: share of the underfull containers that a
    further round must be able to save; gained: share of what the last round could have saved
    that it must have saved.
    """

    shard: int = 25_000
    sources: int = 200
    partners: int = 2_000
    least: float = 0.0005
    gained: float = 0.1


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Containers of item numbers; sizes must be sorted from large to small."""
    gaps: list[int] = []
    holders: dict[int, list[int]] = {}
    bins: list[list[int]] = []
    for k, size in enumerate(sizes):
        at = bisect_left(gaps, size)
        if at < len(gaps):
            gap = gaps[at]
            which = holders[gap].pop()
            if not holders[gap]:
                gaps.pop(at)
        else:
            gap, which = capacity, len(bins)
            bins.append([])
        bins[which].append(k)
        left = gap - size
        if left:
            if left not in holders or not holders[left]:
                insort(gaps, left)
            holders.setdefault(left, []).append(which)
    return bins


class Search:
    """Local search over the underfull containers of one shard."""

    def __init__(self, bins: list[list[int]], sizes: list[int], capacity: int):
        self.bins, self.sizes, self.capacity = bins, sizes, capacity
        self.fill = [sum(sizes[k] for k in b) for b in bins]

    def improve(self, source: int, target: int) -> bool:
        """One exchange that makes ``target`` fuller with items of ``source``; the fuller the better."""
        sizes, gap = self.sizes, self.capacity - self.fill[target]
        own = sorted({sizes[k]: k for k in self.bins[source]}.items())
        theirs = sorted({sizes[k]: k for k in self.bins[target]}.items())
        values = [s for s, _ in own]
        best: tuple[int, list[int], list[int]] = (0, [], [])

        def offer(gain: int, out: list[int], back: list[int]) -> None:
            nonlocal best
            # (t + g)^2 + (s - g)^2 > t^2 + s^2 for fills t, s and a gain g means t + g > s
            if best[0] < gain <= gap and self.fill[target] + gain > self.fill[source]:
                best = (gain, out, back)

        at = bisect_left(values, gap + 1)
        if at:
            offer(values[at - 1], [own[at - 1][1]], [])
        for back, item in [(0, None), *theirs]:
            held = [] if item is None else [item]
            at = bisect_left(values, back + gap + 1)
            if at and values[at - 1] > back:
                offer(values[at - 1] - back, [own[at - 1][1]], held)
            if best[0] == gap:
                break
            ordered = sorted(((sizes[k], k) for k in self.bins[source]))
            low, high = 0, len(ordered) - 1
            while low < high:
                total = ordered[low][0] + ordered[high][0] - back
                if total > gap:
                    high -= 1
                else:
                    if total > 0:
                        offer(total, [ordered[low][1], ordered[high][1]], held)
                    low += 1
        if best[0] < gap and len(theirs) > 1:
            ordered = sorted(((sizes[k], k) for k in self.bins[target]))
            for mine, item in own:
                low, high = 0, len(ordered) - 1
                while low < high:
                    gain = mine - ordered[low][0] - ordered[high][0]
                    if gain > gap:
                        low += 1
                    else:
                        if gain > 0:
                            offer(gain, [item], [ordered[low][1], ordered[high][1]])
                        high -= 1
        gain, out, back = best
        if not gain:
            return False
        for k in out:
            self.bins[source].remove(k)
            self.bins[target].append(k)
        for k in back:
            self.bins[target].remove(k)
            self.bins[source].append(k)
        self.fill[source] -= gain
        self.fill[target] += gain
        return True

    def run(self, s: Settings) -> None:
        failed: set[int] = set()
        while len(failed) < s.sources:
            open_bins = sorted((f, b) for b, f in enumerate(self.fill) if 0 < f < self.capacity)
            # no fewer containers can hold what these hold
            if len(open_bins) <= -(-sum(f for f, _ in open_bins) // self.capacity):
                return
            source = next((b for _, b in open_bins if b not in failed), None)
            if source is None:
                return
            for _, target in open_bins[: s.partners]:
                while target != source and self.fill[source] and self.fill[target] < self.capacity and self.improve(source, target):
                    pass
                if not self.fill[source]:
                    break
            if self.fill[source]:
                failed.add(source)


def pack(sizes: np.ndarray, capacity: int, s: Settings) -> list[list[int]]:
    """Containers of item numbers: none above the capacity, every item once."""
    order = np.argsort(-sizes, kind="stable")
    ranked = sizes[order].tolist()
    bins = best_fit(ranked, capacity)
    search = Search(bins, ranked, capacity)
    search.run(s)
    return [[int(order[k]) for k in b] for b in search.bins if b]


def token_counts(df: DataFrame, id: str, text: str, tokenizer: str | None = None) -> DataFrame:
    """(id, n_tokens) of each row with an id and a text that is not empty."""
    path = tokenizer or subwords.vocabulary()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"id": batch.column("id"), "n_tokens": pa.array(subwords.counts(arrays.strings(batch, "text"), path), pa.int32())})

    narrow = df.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text")).where("id is not null and text <> ''")
    return arrays.arrow_map(narrow, run, "id long, n_tokens int").groupBy("id").agg(F.max("n_tokens").alias("n_tokens"))


def containers(df: DataFrame, id: str, text: str, capacities: DataFrame, tokenizer: str | None = None, s: Settings = Settings()) -> DataFrame:
    """(capacity_id, container, n_docs, n_tokens, docs): the list of documents of each container.

    capacities: (capacity_id, capacity_tokens), a table of a few sizes; null or sizes below 1
    are left out. docs: array of (doc_id, part, first_token, n_tokens); a document has more
    than one part only where it alone exceeds the capacity. Null and empty texts are in no
    container; an id that stands in several rows is one document, of its longest text.
    """
    wanted = [(int(i), int(c)) for i, c in capacities.where("capacity_id is not null and capacity_tokens >= 1").select("capacity_id", "capacity_tokens").distinct().limit(1001).collect()]
    if len(wanted) > 1000:
        raise ValueError("more than 1000 capacities; pack them in parts")
    counted = cut(token_counts(df, id, text, tokenizer))
    total = counted.count()
    empty = "capacity_id long, container string, n_docs int, n_tokens int, docs array<struct<doc_id: long, part: int, first_token: int, n_tokens: int>>"
    if not wanted or not total:
        return df.sparkSession.createDataFrame([], empty)
    options = F.array(*[F.struct(F.lit(i).cast("long").alias("capacity_id"), F.lit(c).alias("capacity")) for i, c in wanted])
    each = counted.select("id", "n_tokens", F.explode(options).alias("o")).select("id", "n_tokens", "o.*")
    full = (F.col("n_tokens") / F.col("capacity")).cast("int")
    piece = F.struct(F.col("id").alias("doc_id"), F.col("part"), (F.col("part") * F.col("capacity")).alias("first_token"), F.col("capacity").alias("n_tokens"))
    whole = (
        each.where("n_tokens >= capacity")
        .withColumn("part", F.explode(F.sequence(F.lit(0), full - 1)))
        .select("capacity_id", F.concat_ws("-", F.lit("f"), "id", "part").alias("container"), F.lit(1).alias("n_docs"), F.col("capacity").alias("n_tokens"), F.array(piece).alias("docs"))
    )
    rest = F.col("n_tokens") % F.col("capacity")
    items = each.where(rest > 0).select("capacity_id", "capacity", F.xxhash64("id").alias("key"), F.col("id").alias("doc_id"), full.alias("part"), (full * F.col("capacity")).alias("first_token"), rest.alias("n_tokens"))
    columns = ("capacity_id", "container", "n_docs", "n_tokens", "docs")
    done = [whole]
    shards = {i: max(1, -(-total // s.shard)) for i, _ in wanted}
    could: dict[int, tuple[int, int]] = {}
    for level in count():
        dealt = items.withColumn("shard", F.pmod("key", number_of(shards))).drop("key")
        packed = cut(dealt.groupBy("capacity_id", "shard").applyInArrow(packer(s, level), empty.replace("docs array", "capacity int, docs array")))
        under = packed.where("n_tokens < capacity").groupBy("capacity_id", "capacity").agg(F.count("*").alias("bins"), F.sum("n_docs").alias("items"), F.sum("n_tokens").alias("tokens"))
        again = {}
        for i, capacity, bins, held, tokens in under.collect():  # a row for each capacity
            saving, (before, saved_from) = bins - -(-tokens // capacity), could.get(i, (0, 0))
            worth = saving >= max(1, s.least * bins) and (not saved_from or before - bins >= s.gained * saved_from)
            if shards[i] > 1 and worth:
                again[i], could[i] = -(-held // s.shard), (bins, saving)
        opened = F.col("capacity_id").isin(list(again)) & (F.col("n_tokens") < F.col("capacity")) if again else F.lit(False)
        done.append(packed.where(~opened).select(*columns))
        if not again:
            return reduce(DataFrame.unionByName, done)
        shards = again
        items = packed.where(opened).select("capacity_id", "capacity", F.xxhash64("container", F.lit(level)).alias("key"), F.explode("docs").alias("d")).select("capacity_id", "capacity", "key", "d.*")


def number_of(shards: dict[int, int]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for i, n in shards.items() for x in (i, n)]), F.col("capacity_id"))


def packer(s: Settings, level: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("n_tokens", "descending"), ("doc_id", "ascending")])
        capacity, shard, capacity_id = (table.column(c)[0].as_py() for c in ("capacity", "shard", "capacity_id"))
        bins = pack(table.column("n_tokens").to_numpy().astype(np.int64), capacity, s)
        rows = table.select(["doc_id", "part", "first_token", "n_tokens"]).to_pylist()
        names = ("capacity_id", "container", "n_docs", "n_tokens", "capacity", "docs")
        out: dict[str, list] = {n: [] for n in names}
        for k, b in enumerate(bins):
            docs = [rows[i] for i in b]
            values = (capacity_id, f"{level}-{shard}-{k}", len(docs), sum(d["n_tokens"] for d in docs), capacity, docs)
            for n, v in zip(names, values, strict=True):
                out[n].append(v)
        piece = pa.struct([("doc_id", pa.int64()), ("part", pa.int32()), ("first_token", pa.int32()), ("n_tokens", pa.int32())])
        kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.list_(piece))
        return pa.table({n: pa.array(out[n], t) for n, t in zip(names, kinds, strict=True)})

    return run
