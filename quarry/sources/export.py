"""Rows out: pages, delimited lines, JSON, fingerprints."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame, Observation, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators.filters import quoted
from quarry.operators.profile import row_digest
from quarry.sources.shared import observed


class Cursor(NamedTuple):
    """Where a page ended: the last row's keys and digest, and how many rows equal to it have been shown."""

    keys: tuple[Any, ...]
    digest: str
    shown: int


@dataclass
class Page:
    """A page's rows as (kind, name) columns and rows, the number of all rows, and where the next page begins (None after the last)."""

    columns: list[tuple[str, str]]
    rows: list[Row]
    total: int
    after: Cursor | None


def _from(order: Sequence[Column], values: Sequence[Any], strictly: bool) -> Column:
    """Rows after the values in that order, or with them unless ``strictly``; nulls come first."""
    beyond, equal = F.lit(False), F.lit(True)
    for c, value in zip(order, values, strict=True):
        after, same = (c.isNotNull(), c.isNull()) if value is None else (c > F.lit(value), c.eqNullSafe(F.lit(value)))
        beyond = beyond | (equal & after)
        equal = equal & same
    return F.coalesce(beyond if strictly else beyond | equal, F.lit(False))


def page(df: DataFrame, keys: Sequence[str], after: Sequence[Any] | None = None, size: int = 100) -> DataFrame:
    """The next rows whose keys come after the given ones; nulls come first. For keys that no two rows share; ``read_page`` is for all others."""
    order = [quoted(k) for k in keys]
    if after is not None:
        df = df.where(_from(order, list(after), True))
    return df.orderBy(*(c.asc_nulls_first() for c in order)).limit(size)


def read_page(df: DataFrame, keys: Sequence[str], after: Cursor | None = None, size: int = 100) -> Page:
    """The next ``size`` rows by the keys, and by a digest of the row where keys are equal, with the number of all rows from the same scan.
    Rows that are equal in everything are counted, so that a page's end may fall among them."""
    held = df.select(F.struct(*(quoted(c) for c in df.columns)).alias("row"), row_digest(df).alias("digest"))
    seen = Observation()
    rows = held.observe(seen, F.count(F.lit(1)).alias("total"))
    order = [*(F.col("row").getField(k) for k in keys), F.col("digest")]
    if after is not None:
        rows = rows.where(_from(order, [*after.keys, after.digest], False))
    skipped = after.shown if after else 0
    found = rows.orderBy(*(c.asc_nulls_first() for c in order)).limit(size + skipped).collect()[skipped:]
    columns = [(f.name, kind(f.dataType)) for f in df.schema]
    if not found:
        return Page(columns, [], observed(seen).get("total", 0), None)
    last = found[-1]
    place = tuple(last["row"][k] for k in keys)
    same = sum(r["digest"] == last["digest"] and tuple(r["row"][k] for k in keys) == place for r in found)
    if after and after.digest == last["digest"] and after.keys == place:
        same += after.shown
    return Page(columns, [r["row"] for r in found], observed(seen).get("total", 0), Cursor(place, last["digest"], same) if len(found) == size else None)


def pages(df: DataFrame, keys: Sequence[str], size: int = 100) -> Iterator[Page]:
    """All pages in turn: every row once."""
    after = None
    while True:
        got = read_page(df, keys, after, size)
        yield got
        after = got.after
        if after is None:
            return


def _field(c: Column) -> Column:
    """A field as delimited files have it: quoted if it holds a quote, a comma or a line end; empty for null."""
    text = c.cast("string")
    return F.coalesce(F.when(text.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text), F.lit(""))


def csv_lines(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """Each row as one delimited line."""
    return F.concat_ws(",", *(_field(quoted(c)) for c in columns or df.columns))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("escape", '"').csv(path)


def kind(of: T.DataType) -> str:
    return "number" if isinstance(of, T.NumericType) else "date" if isinstance(of, (T.DateType, T.TimestampType, T.TimestampNTZType)) else "text"


def json_rows(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """Each row as a JSON object; numbers that aren't finite are null, and nulls are written."""
    made = []
    for name in columns or df.columns:
        c, of = quoted(name), df.schema[name].dataType
        if isinstance(of, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
        elif isinstance(of, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        made.append(c.alias(name))
    return F.to_json(F.struct(*made), {"ignoreNullFields": "false"})


def fingerprint(df: DataFrame) -> DataFrame:
    """One row: rows, columns, a digest of names and types, and one of the content that doesn't depend on the rows' order."""
    layout = "|".join(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema)
    part = F.conv(F.substring(row_digest(df), 1, 12), 16, 10).cast("decimal(20,0)")
    return df.agg(F.count("*").alias("rows"), F.lit(len(df.columns)).alias("columns"), F.sha2(F.lit(layout), 256).alias("layout"), F.coalesce(F.sum(part), F.lit(0)).cast("string").alias("content"))
