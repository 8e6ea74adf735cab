"""Functions of text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tags that open a block of a model's reasoning.
REASONING = "think|thinking|reasoning"


def strip_reasoning(text: Column) -> Column:
    """Without reasoning blocks. What follows a stray closing tag is kept, what an unclosed block holds is not."""
    closed = F.regexp_replace(text, rf"(?is)<({REASONING})>.*?</\1>", "")
    rest = F.element_at(F.split(closed, rf"(?i)</(?:{REASONING})>", -1), -1)
    return F.trim(F.regexp_replace(rest, rf"(?is)<(?:{REASONING})>.*$", ""))


def extract_json(text: Column, schema: str) -> Column:
    """The object from the first brace to the last, fences aside, read with the schema; null if there is none."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(found != "", F.from_json(found, schema))


def format_number(value: Column, kind: str = "num") -> Column:
    """How a number is shown: whole, percent, or shortened by its size."""
    v = value.cast("double")
    if kind == "int":
        shown = F.format_number(F.when(v < 0, F.ceil(v)).otherwise(F.floor(v)).cast("long"), 0)
    elif kind == "pct":
        shown = F.concat(F.format_number(v, 1), F.lit("%"))
    else:
        size = F.abs(v)
        shown = F.when(size >= 1e9, F.concat(F.format_number(v / 1e9, 2), F.lit("B"))).when(size >= 1e6, F.concat(F.format_number(v / 1e6, 2), F.lit("M"))).when(size >= 1e3, F.format_number(v, 0)).otherwise(F.format_number(v, 2))
    return F.when(v.isNull() | F.isnan(v), F.lit("n/a")).otherwise(shown)
