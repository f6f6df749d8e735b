"""Words of whole column batches as arrays, without a Python step per word.

A batch of texts becomes one array of code points. A class per code point (letter or digit;
Chinese or Japanese character; anything else) gives the word boundaries, and a sum of mixed
code points times position multipliers gives each word a 64-bit hash. Offsets count code
points from 0, end exclusive, like those of the tables.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

#: Ranges whose characters are words of their own.
SINGLE_RANGES = (
    (0x3005, 0x3007),
    (0x3040, 0x30FF),
    (0x31F0, 0x31FF),
    (0x3400, 0x4DBF),
    (0x4E00, 0x9FFF),
    (0xF900, 0xFAFF),
    (0xFF66, 0xFF9F),
    (0x20000, 0x323AF),
)
POINTS = 0x110000
OTHER, LETTER, SINGLE, DIGIT = 0, 1, 2, 3
CHUNK_CHARS = 1_500_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit values."""
    x = np.asarray(x, dtype=np.uint64).copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass(frozen=True)
class Tables:
    kind: np.ndarray
    lower: np.ndarray
    code: np.ndarray
    place: np.ndarray


@lru_cache(maxsize=1)
def tables() -> Tables:
    """Class, lower case and scrambled value of each code point; built once per process."""
    kind = np.zeros(POINTS, dtype=np.uint8)
    lower = np.arange(POINTS, dtype=np.uint32)
    for point in range(POINTS):
        c = chr(point)
        if c.isalnum():
            kind[point] = DIGIT if c.isdecimal() else LETTER
            small = c.lower()
            if small != c and len(small) == 1:
                lower[point] = ord(small)
    for first, last in SINGLE_RANGES:
        span = kind[first : last + 1]
        span[span != OTHER] = SINGLE
    for mark in (0x3005, 0x3006, 0x3007, 0x30FC):
        kind[mark] = SINGLE
    steps = np.arange(POINTS, dtype=np.uint64) + np.uint64(1)
    return Tables(kind, lower, mix(steps * np.uint64(0x9E3779B97F4A7C15)), mix(np.arange(1, 1025, dtype=np.uint64) << np.uint64(32)) | np.uint64(1))


@dataclass(frozen=True)
class Words:
    """Words of a chunk of texts: index of the text, first and last offset in it, hash."""

    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    single: np.ndarray


def code_points(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, each followed by a line feed, and where each text begins."""
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    first = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(sizes + 1, out=first[1:])
    joined = "".join(x + "\n" for x in texts)
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), first


def words(texts: Sequence[str], digits_equal: bool = False) -> Words:
    """All words of the texts, lower-cased.

    digits_equal: any run of digits hashes like any other. Empty texts have no words; nulls
    must have been replaced before.
    """
    t = tables()
    points, first = code_points(texts)
    points = t.lower[points]
    kind = t.kind[points]
    inside = kind != OTHER
    if not inside.any():
        none = np.zeros(0, dtype=np.int64)
        return Words(none, none, none, none.astype(np.uint64), none.astype(bool))
    alone = kind == SINGLE
    before = np.zeros_like(inside)
    before[1:] = inside[:-1] & ~alone[:-1]
    opens = inside & (alone | ~before)
    after = np.zeros_like(inside)
    after[:-1] = inside[1:] & ~alone[1:]
    starts = np.flatnonzero(opens)
    ends = np.flatnonzero(inside & (alone | ~after)) + 1
    keep = inside
    if digits_equal:
        digit = kind == DIGIT
        points = np.where(digit, np.uint32(48), points)
        repeated = np.zeros_like(digit)
        repeated[1:] = digit[1:] & digit[:-1]
        keep = inside & ~repeated
    at = np.flatnonzero(keep)
    heads = np.flatnonzero(opens[at])
    owner = np.cumsum(opens[at]) - 1
    place = (np.arange(len(at)) - heads[owner]) & 1023
    sums = np.add.reduceat(t.code[points[at]] * t.place[place], heads)
    row = np.searchsorted(first, starts, side="right") - 1
    return Words(row, starts - first[row], ends - first[row], mix(sums), alone[starts])


def distinct(x: np.ndarray) -> np.ndarray:
    """The sorted distinct values; much faster than the hashing of np.unique on large arrays."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def chunks(texts: Sequence[str], most: int = CHUNK_CHARS, rows: int = 8192) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``most`` characters (a longer text stands alone)."""
    begin, size = 0, 0
    for k, text in enumerate(texts):
        if k > begin and (size + len(text) > most or k - begin >= rows):
            yield begin, k
            begin, size = k, 0
        size += len(text)
    if begin < len(texts):
        yield begin, len(texts)


def runs(row: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``n`` words inside one text, and the index of its first word."""
    count = len(row) - n + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    total = np.zeros(count, dtype=np.uint64)
    for k in range(n):
        total = total * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + count]
    at = np.flatnonzero(row[:count] == row[n - 1 :])
    return mix(total[at]), at
