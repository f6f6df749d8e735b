"""JSON lines: scans with a given schema, sinks, and resumption of interrupted runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read(spark: SparkSession, paths: str | list[str], schema: StructType | str) -> DataFrame:
    """All files of the paths with the given schema; nothing is inferred."""
    return spark.read.schema(schema).json(paths)


def write(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def whole_text(spark: SparkSession, path: str) -> DataFrame:
    """(value): each file as one text."""
    return spark.read.text(path, wholetext=True)


def prefix(df: DataFrame, id: str, n: int) -> DataFrame:
    """The first ``n`` rows by id: a file order is no order where files are read side by side."""
    return df.orderBy(id).limit(n)


def window(df: DataFrame, index: str, start: int, end: int) -> DataFrame:
    """Rows of an index range; the filter reaches the scan."""
    return df.where((F.col(index) >= start) & (F.col(index) < end))


def remaining_by_position(df: DataFrame, written: DataFrame, index: str) -> DataFrame:
    """Rows after the last index written; what was dropped before it is not tried again."""
    last = written.agg(F.max(index)).first()[0]
    return df if last is None else df.where(F.col(index) > last)


def remaining_by_key(df: DataFrame, written: DataFrame, index: str) -> DataFrame:
    """Rows whose index was not written; what was dropped is tried again."""
    return df.join(written.select(index).distinct(), index, "left_anti")


def output_name(tag: str, fingerprint: str, start: int, end: int, stamp: str) -> str:
    return f"data{'-' + tag if tag else ''}-{fingerprint}-{start}_{end}-{stamp}.jsonl"


def output_names(tag: str, fingerprint: Column, start: Column, end: Column, stamp: Column) -> Column:
    """The same names for the rows of a table of runs."""
    span = F.concat_ws("_", start.cast("string"), end.cast("string"))
    return F.concat(F.concat_ws("-", F.lit(f"data-{tag}" if tag else "data"), fingerprint, span, stamp), F.lit(".jsonl"))
