"""Token and label arrays of instruction data, with a pluggable tokenizer."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import text

IGNORED = -100
Encode = Callable[[list[str]], list[list[int]]]
Decode = Callable[[list[list[int]]], list[str]]


@dataclass(frozen=True)
class Special:
    """Ids with a meaning; without a pad id the end id takes its place."""

    begin: int = 1
    end: int = 2
    pad: int | None = None

    @property
    def padding(self) -> int:
        return self.end if self.pad is None else self.pad


def word_ids(texts: list[str]) -> list[list[int]]:
    """A stand-in tokenizer: each run of non-blanks is the first 28 bits of its md5, after the special ids."""
    import hashlib

    return [[16 + int(hashlib.md5(w.encode()).hexdigest()[:7], 16) for w in x.split()] for x in texts]


def byte_pairs(path: str) -> Encode:
    """Subwords of a vocabulary file of ranks on the executors; loaded once per process."""

    def encode(texts: list[str]) -> list[list[int]]:
        encoding = loaded(path)
        return [encoding.encode_ordinary(x) for x in texts]

    return encode


def from_byte_pairs(path: str) -> Decode:
    """Texts of the ids of ``byte_pairs``."""

    def decode(ids: list[list[int]]) -> list[str]:
        encoding = loaded(path)
        return [encoding.decode(x) for x in ids]

    return decode


_LOADED: dict[str, object] = {}


def loaded(path: str):
    if path not in _LOADED:
        import base64

        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, file)}
        pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        _LOADED[path] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def encoded(df: DataFrame, column: str, name: str, encode: Encode = word_ids, most: int | None = None, begin: int | None = None, end: int | None = None) -> DataFrame:
    """``df`` with the ids of a text column; null texts have none (an empty array).

    The ids are cut to ``most`` first; ``begin`` and ``end`` are put around what is left, so
    that a cut never loses them.
    """

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(encode(batch.fillna("").tolist()))

    found = ids(F.col(column))
    if most is not None:
        found = cut(found, most)
    marks = [F.array() if x is None else F.array(F.lit(x)) for x in (begin, end)]
    if begin is not None or end is not None:
        found = F.concat(marks[0].cast("array<int>"), found, marks[1].cast("array<int>"))
    return df.withColumn(name, found)


def decoded(df: DataFrame, column: str, name: str, decode: Decode, skip: tuple[int, ...] = ()) -> DataFrame:
    """``df`` with the text of a column of ids; ids in ``skip`` (begin, end, padding) are left out; null stays null."""
    kept = F.filter(F.col(column), lambda x: ~x.isin(*skip)) if skip else F.col(column)

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            held = [x is not None for x in batch]
            found = iter(decode([[int(i) for i in x] for x in batch if x is not None]))
            yield pd.Series([next(found) if h else None for h in held], dtype=object)

    return df.withColumn(name, texts(kept))


def joined(prompt: Column, completion: Column, special: Special) -> Column:
    """begin + prompt + completion + end."""
    return F.concat(F.array(F.lit(special.begin)), prompt, completion, F.array(F.lit(special.end)))


def masked_labels(prompt_size: Column, completion: Column, special: Special) -> Column:
    """Ignored over begin and prompt, then the completion and the end."""
    return F.concat(F.array_repeat(F.lit(IGNORED), (prompt_size + 1).cast("int")), completion, F.array(F.lit(special.end)))


def cut(ids: Column, most: int) -> Column:
    return F.slice(ids, 1, most)


def padded(ids: Column, size: Column | int, pad: int, left: bool = False) -> Column:
    """Filled up with ``pad``; null where the ids are longer than asked."""
    wanted = F.lit(size) if isinstance(size, int) else size
    fill = F.array_repeat(F.lit(pad), F.greatest(wanted - F.size(ids), F.lit(0)).cast("int"))
    return F.when(F.size(ids) <= wanted, F.concat(fill, ids) if left else F.concat(ids, fill))


def attention(ids: Column, pad: int) -> Column:
    """Where an id is not padding. If the end id serves as padding, real ends are left out as well."""
    return F.transform(ids, lambda x: x != pad)


def labels_of(ids: Column, pad: int) -> Column:
    """Labels for rows without any: the ids themselves, ignored where they are padding."""
    return F.transform(ids, lambda x: F.when(x != pad, x).otherwise(F.lit(IGNORED)))


def training_rows(df: DataFrame, id: str, most: int, special: Special = Special(), encode: Encode = word_ids, instruction: str = "instruction", response: str = "response") -> DataFrame:
    """(id, input_ids, labels, exceeding_length) of instruction data; rows without an instruction are left out.

    The flag is taken before both arrays are cut to ``most`` ids.
    """
    asked = df.where(F.col(instruction).isNotNull()).select(F.col(id), text.prompt(F.col(instruction)).alias("_p"), F.coalesce(response, F.lit("")).alias("_c"))
    both = encoded(encoded(asked, "_p", "_pi", encode), "_c", "_ci", encode)
    ids = joined(F.col("_pi"), F.col("_ci"), special)
    labels = masked_labels(F.size("_pi"), F.col("_ci"), special)
    return both.select(id, cut(ids, most).alias("input_ids"), cut(labels, most).alias("labels"), (F.size(ids) > most).alias("exceeding_length"))


def collated(df: DataFrame, batch: str, special: Special = Special(), left: bool = False) -> DataFrame:
    """Rows padded to the longest of their batch: input_ids, labels, attention_mask."""
    longest = df.groupBy(batch).agg(F.max(F.size("input_ids")).alias("_size"))
    rows = df.join(longest, batch)
    ids = padded(F.col("input_ids"), F.col("_size"), special.padding, left)
    return rows.select(
        *[c for c in df.columns if c not in ("input_ids", "labels")],
        ids.alias("input_ids"),
        padded(F.col("labels"), F.col("_size"), IGNORED, left).alias("labels"),
        attention(ids, special.padding).alias("attention_mask"),
    )
