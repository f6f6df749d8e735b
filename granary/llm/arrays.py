"""Moving NumPy arrays through Spark rows, and sums of fixed-size arrays over all rows."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 1 << 14
#: Counters stop here instead of running over.
MOST = np.iinfo(np.int32).max
#: Bits of one block of a bitmap.
BITS = 1 << 17


def pack(*arrays: np.ndarray) -> bytes:
    """The arrays as one compressed value, without copies of their contents on the way."""
    parts = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        held = pa.compress(pa.py_buffer(a), codec="zstd", asbytes=True) if a.nbytes else b""
        parts.append((a.dtype.str, a.shape, a.nbytes, held))
    return pickle.dumps(parts, protocol=5)


def unpack(blob: bytes) -> tuple[np.ndarray, ...]:
    """The arrays again, for reading."""
    out = []
    for kind, shape, size, held in pickle.loads(blob):
        raw = pa.decompress(held, size, codec="zstd") if size else b""
        out.append(np.frombuffer(raw, dtype=kind).reshape(shape))
    return tuple(out)


def slot_sums(df: DataFrame, slots_of: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], slots: int) -> np.ndarray:
    """How often each of ``slots`` slots occurs over all rows.

    ``slots_of`` turns a partition's batches into arrays of slot numbers. The partial sums
    leave each task as blocks of fixed size and are added before the driver fetches the one
    array of ``slots`` counters (32 bits, at most 2^31 - 1 each), whose size does not depend
    on the data.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(slots, dtype=np.int64)
        for found in slots_of(batches):
            np.add.at(total, found, 1)
        yield pa.RecordBatch.from_pydict(blocks_of(total))

    return added(df.mapInArrow(partial, "block int, counts binary"), slots)


def blocks_of(total: np.ndarray) -> dict[str, pa.Array]:
    """The counters of a task as columns ``block`` and ``counts``; blocks of zeros are left out."""
    held = np.minimum(total, MOST).astype(np.int32)
    blocks = [b for b in range(0, len(held), BLOCK) if held[b : b + BLOCK].any()]
    return {"block": pa.array(blocks, pa.int32()), "counts": pa.array([pack(held[b : b + BLOCK]) for b in blocks], pa.binary())}


def added(parts: DataFrame, slots: int) -> np.ndarray:
    """The sum of the tasks' counters (columns block, counts), one array of ``slots`` counters."""

    def add(table: pa.Table) -> pa.Table:
        total = sum(unpack(x)[0].astype(np.int64) for x in table.column("counts").to_pylist())
        total = np.minimum(total, MOST).astype(np.int32)
        return pa.table({"block": table.column("block")[:1].cast(pa.int32()), "counts": pa.array([pack(total)], pa.binary())})

    result = np.zeros(slots, dtype=np.int32)
    for row in parts.groupBy("block").applyInArrow(add, "block int, counts binary").collect():
        found = unpack(bytes(row["counts"]))[0]
        result[row["block"] : row["block"] + len(found)] = found
    return result


def key_bitmap(keys: DataFrame, bits: int) -> np.ndarray:
    """One bit for each slot (a key's low bits, of which ``bits`` is the number) that a column ``key`` of 64-bit hashes fills.

    Each block of the bitmap is made where its slots meet; the driver fetches ``bits`` / 8 bytes at most.
    """

    def filled(table: pa.Table) -> pa.Table:
        held = np.zeros(BITS, dtype=bool)
        held[table.column("bit").to_numpy()] = True
        return pa.table({"block": table.column("block")[:1], "held": pa.array([np.packbits(held, bitorder="little").tobytes()], pa.binary())})

    slot = F.col("key").bitwiseAND(F.lit(bits - 1))
    spread = keys.select(F.floor(slot / BITS).cast("int").alias("block"), (slot % BITS).cast("int").alias("bit")).distinct()
    result = np.zeros(bits // 8, dtype=np.uint8)
    for row in spread.groupBy("block").applyInArrow(filled, "block int, held binary").collect():
        result[row["block"] * BITS // 8 : (row["block"] + 1) * BITS // 8] = np.frombuffer(bytes(row["held"]), dtype=np.uint8)
    return result


def in_bitmap(held: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the bit of each 64-bit key is set."""
    slot = keys.view(np.uint64) & np.uint64(8 * len(held) - 1)
    return (held[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def power_above(n: int, least: int, most: int) -> int:
    """The power of two at or over ``n``, between two others."""
    return min(max(1 << max(0, n - 1).bit_length(), least), most)


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """One output batch per input batch; nothing for None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def strings(batch: pa.RecordBatch, column: str) -> list[str]:
    """The column with null as the empty text."""
    return [x or "" for x in batch.column(column).to_pylist()]


def text(column: str) -> F.Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
