"""Text columns: templates, line slices, marked sections, fingerprints."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The instruction template, the marks of a generated text's parts and its line breaks.
PROMPT = "@@ Instruction\n%s\n\n@@ Response\n%s"
PROBLEM_MARKS = ("[problem description]",)
SOLUTION_MARK = "[solution]"
LINE = "[^\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]*(?:\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029])|[^\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]+\\z"


def prompt(instruction: Column, response: Column | None = None, template: str = PROMPT) -> Column:
    """The template with instruction and response; a null instruction gives null."""
    return F.format_string(template, instruction, F.lit("") if response is None else F.coalesce(response, F.lit("")))


def lines(text: Column) -> Column:
    """Lines with their ends; the empty text has none."""
    return F.regexp_extract_all(text, F.lit(LINE), F.lit(0))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, "^\\s+|\\s+$", "")


def snippet(text: Column, start: Column, length: Column) -> Column:
    """``length`` lines from line ``start`` (from 0), line ends kept; '' for the empty text."""
    return F.array_join(F.slice(lines(text), (start + 1).cast("int"), length.cast("int")), "")


def first_line_with(found: Column, mark: str) -> Column:
    """Number from 1 of the first line that contains the mark, in any case; 0 without one."""
    return F.array_position(F.transform(found, lambda x: F.contains(F.lower(x), F.lit(mark))), True)


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), where the value is computed once however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def sections(text: Column) -> Column:
    """struct(problem, solution): the lines after each mark's line; null unless both marks are there in this order.

    Only the first line with each mark counts, so a later one belongs to the solution.
    """

    def part(found: Column, first: Column, last: Column) -> Column:
        return strip(F.array_join(F.slice(found, (first + 1).cast("int"), F.greatest(last - first, F.lit(0)).cast("int")), ""))

    def marked(found: Column) -> Column:
        return F.struct(found.alias("l"), first_line_with(found, PROBLEM_MARKS[0]).alias("p"), first_line_with(found, SOLUTION_MARK).alias("s"))

    def parts(m: Column) -> Column:
        both = F.struct(part(m["l"], m["p"], m["s"] - 1).alias("problem"), part(m["l"], m["s"], F.size(m["l"]).cast("long")).alias("solution"))
        return F.when((m["p"] > 0) & (m["s"] > m["p"]), both)

    return bound(bound(lines(text), marked), parts)


def fingerprint(*parts: Column, length: int | None = None) -> Column:
    """SHA-256 of the parts one after another as hex, or its first digits."""
    whole = F.sha2(F.concat(*[F.coalesce(p.cast("string"), F.lit("None")) for p in parts]), 256)
    return whole if length is None else F.substring(whole, 1, length)


def run_fingerprint(*values: object, length: int = 5) -> str:
    """The same for a run's settings, on the driver."""
    return hashlib.sha256("".join(str(v) for v in values).encode()).hexdigest()[:length]


def chunk_of(index: Column, size: int) -> Column:
    return F.floor(index / size)


def stamp(at: Column | None = None) -> Column:
    """The time as it stands in file names; without one the present."""
    return F.date_format(F.current_timestamp() if at is None else at, "yyyyMMdd_HHmmss")


def whole_epochs(epochs: Column) -> Column:
    return F.ceil(epochs).cast("int")


def record_json(*columns: str) -> Column:
    return F.to_json(F.struct(*columns))
