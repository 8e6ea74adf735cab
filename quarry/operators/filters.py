"""Filters with the null rules of the analysis specs.

A null never matches, but for ``!=`` and ``not in``, which keep null rows. Filters that can't be read are skipped with
a warning, as is one that would leave no row of what the filters before it kept.
"""

from __future__ import annotations

import datetime
import decimal
import difflib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.plans.spec import Filter, is_date, is_numeric, quoted

ALIASES = {"=": "==", "eq": "==", "ne": "!=", "<>": "!=", "notin": "not in"}
COMPARE = {">": Column.__gt__, "<": Column.__lt__, ">=": Column.__ge__, "<=": Column.__le__}
CLOSE = 0.85
#: With more filters than this, what they would leave is asked filter by filter, not in one count of their combinations.
MOST_AT_ONCE = 12


def coerced(value: Any, kind: T.DataType) -> Any:
    """The value as the column has it; ValueError if it can't be."""
    if isinstance(kind, T.BooleanType):
        if str(value).lower() in ("true", "false"):
            return str(value).lower() == "true"
        raise ValueError(f"{value!r} is no truth value")
    if is_date(kind):
        if isinstance(value, (datetime.date, datetime.datetime)):
            return value if isinstance(value, datetime.datetime) else datetime.datetime.combine(value, datetime.time())
        return datetime.datetime.fromisoformat(str(value))
    if is_numeric(kind):
        return _number(value)
    return str(value)


def _number(value: Any) -> int | float | decimal.Decimal:
    """Whole numbers and decimals stay exact, however long; floats stay floats."""
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, (int, float, decimal.Decimal)):
        number = value
    else:
        try:
            number = decimal.Decimal(str(value).strip())
        except decimal.InvalidOperation as e:
            raise ValueError(f"{value!r} is no number") from e
        if number.is_finite() and abs(number) < 10**37 and number == number.to_integral_value():
            number = int(number)
    if number != number:
        raise ValueError("not a number")
    return number


def literal(value: Any, kind: T.DataType) -> Column:
    """The value to compare with a column of that kind. A whole number or decimal meets whole and decimal columns as an exact decimal;
    doubles are compared as such."""
    made = coerced(value, kind)
    if is_date(kind):
        return F.lit(made).cast(kind)
    if isinstance(kind, (T.FloatType, T.DoubleType)) and not isinstance(made, float):
        return F.lit(float(made))
    if isinstance(made, (int, decimal.Decimal)) and not isinstance(made, bool) and abs(made) >= 1 << 63:
        made = decimal.Decimal(made) if abs(made) < 10**37 else float(made)
    if isinstance(made, float) and isinstance(kind, (T.IntegralType, T.DecimalType)) and abs(made) < 1e19:
        exact = decimal.Decimal(repr(made))
        made = int(exact) if exact == exact.to_integral_value() and abs(exact) < 1 << 63 else exact
    return F.lit(made)


def as_text(name: str, kind: T.DataType) -> Column:
    """The value as people write it: numbers without an exponent or idle zeros."""
    if isinstance(kind, (T.FractionalType, T.DecimalType)):
        return F.regexp_replace(quoted(name).cast("decimal(38,10)").cast("string"), r"\.?0+$", "")
    return quoted(name).cast("string")


def predicate(f: Filter, schema: T.StructType) -> Column:
    """The filter as a column that is never null; ValueError if it can't be read."""
    kind, op = schema[f.column].dataType, ALIASES.get(f.op, f.op)
    column = quoted(f.column)
    if op in ("in", "not in"):
        values = f.value if isinstance(f.value, (list, tuple, set)) else [f.value]
        held = F.coalesce(column.isin(*(literal(v, kind) for v in values)), F.lit(False))
        return ~held if op == "not in" else held
    if op == "between":
        if not isinstance(f.value, (list, tuple)) or len(f.value) != 2:
            raise ValueError("between needs two values")
        return F.coalesce(column.between(*(literal(v, kind) for v in f.value)), F.lit(False))
    if op == "contains":
        return F.coalesce(as_text(f.column, kind).rlike(f"(?i){f.value}"), F.lit(False))
    if op == "!=":
        return ~column.eqNullSafe(literal(f.value, kind))
    if op == "==":
        return F.coalesce(column == literal(f.value, kind), F.lit(False))
    if op in COMPARE:
        return F.coalesce(COMPARE[op](column, literal(f.value, kind)), F.lit(False))
    raise ValueError(f"unknown operator {f.op!r}")


def closest_bound(low: Column, wanted: str) -> Column:
    """No less than the similarity of ``wanted`` and the lower-cased text: twice the letters that both have, over all letters."""
    shared: Column = F.lit(0)
    for letter, n in sorted(Counter(wanted.lower()).items()):
        shared = shared + F.least(F.lit(n), F.length(low) - F.length(F.replace(low, F.lit(letter), F.lit(""))))
    return F.lit(2.0) * shared / F.greatest(F.lit(len(wanted.lower())) + F.length(low), F.lit(1))


def candidates(values: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """The values (value, low) that may be as similar as ``CLOSE`` to one that is wanted: by length first, then by letters."""
    n = F.length("low")
    near = [(n * F.lit(CLOSE) <= F.lit((2 - CLOSE) * len(w)) + 1e-9) & (F.lit(CLOSE * len(w)) <= n * F.lit(2 - CLOSE) + 1e-9) & (closest_bound(F.col("low"), w) >= CLOSE - 1e-9) for w in dict.fromkeys(x.lower() for x in wanted)]
    return values.withColumn("low", F.lower("value")).where(reduce(Column.__or__, near))


def snapped(df: DataFrame, filters: Sequence[Filter]) -> list[Filter]:
    """Values of filters on text columns moved to the category they mean: the same but for case, or else the most similar
    from ``CLOSE`` on. One job goes over the distinct values of the columns; only those whose length and letters allow the similarity are compared."""
    asked = [(k, i, f.column, str(v)) for k, f in enumerate(filters) if isinstance(df.schema[f.column].dataType, T.StringType) and ALIASES.get(f.op, f.op) in ("==", "!=", "in", "not in") for i, v in enumerate(f.value if isinstance(f.value, (list, tuple)) else [f.value])]
    if not asked:
        return list(filters)
    parts = []
    for c in dict.fromkeys(a[2] for a in asked):
        distinct = df.select(quoted(c).alias("value")).where("value is not null").distinct()
        parts.append(candidates(distinct, [v for *_, of, v in asked if of == c]).select(F.lit(c).alias("column"), "value", "low"))

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for column, value, low in zip(batch["column"], batch["value"], batch["low"], strict=True):
                for k, i, of, wanted in asked:
                    if of == column:
                        ratio = 3.0 if value == wanted else 2.0 if low == wanted.lower() else difflib.SequenceMatcher(None, wanted.lower(), low).ratio()
                        if ratio >= CLOSE:
                            found.append((k, i, value, ratio))
            yield pd.DataFrame(found, columns=["k", "i", "value", "ratio"])

    best = reduce(DataFrame.unionByName, parts).mapInPandas(near, "k int, i int, value string, ratio double").groupBy("k", "i").agg(F.max(F.struct("ratio", "value")).alias("best"))
    moved = {(r["k"], r["i"]): r["best"]["value"] for r in best.collect()}  # one row for each value asked
    out = []
    for k, f in enumerate(filters):
        if isinstance(f.value, (list, tuple)):
            out.append(replace(f, value=[moved.get((k, i), v) for i, v in enumerate(f.value)]))
        else:
            out.append(replace(f, value=moved.get((k, 0), f.value)))
    return out


@dataclass
class Filtered:
    """The rows that are left, what was applied, and what was skipped."""

    df: DataFrame
    applied: list[Filter] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


def _bad_patterns(df: DataFrame, filters: Sequence[Filter]) -> set[int]:
    """Which filters hold a pattern that doesn't compile: one job for all, and only if that fails one for each."""
    asked = [i for i, f in enumerate(filters) if ALIASES.get(f.op, f.op) == "contains"]

    def compiles(places: list[int]) -> bool:
        try:
            df.sparkSession.range(1).select(*(F.lit("").rlike(f"(?i){filters[i].value}") for i in places)).collect()
        except Exception:  # noqa: BLE001 - the JVM's error has no class of its own here
            return False
        return True

    return set() if not asked or compiles(asked) else {i for i in asked if not compiles([i])}


def apply_filters(df: DataFrame, filters: Sequence[Filter], snap: bool = True) -> Filtered:
    """All filters that can be read and leave rows, joined by and."""
    result = Filtered(df)
    made: list[tuple[Filter, Column]] = []
    filters = snapped(df, filters) if snap else list(filters)
    bad = _bad_patterns(df, filters)
    for i, f in enumerate(filters):
        try:
            if i in bad:
                raise ValueError("bad pattern")
            made.append((f, predicate(f, df.schema)))
        except (ValueError, KeyError) as e:
            result.warnings.append(f"{f.column} {f.op} {f.value!r} skipped: {e}")
    keep: list[int] = []
    if len(made) <= MOST_AT_ONCE:
        mask = reduce(Column.__add__, (F.when(p, 1 << i).otherwise(0) for i, (_, p) in enumerate(made)), F.lit(0))
        seen = [r["mask"] for r in df.groupBy(mask.alias("mask")).count().collect()] if made else []  # 2 ** MOST_AT_ONCE rows at most
        for i in range(len(made)):
            want = sum(1 << k for k in [*keep, i])
            if any(m & want == want for m in seen):
                keep.append(i)
    else:
        for i in range(len(made)):
            if not df.where(reduce(Column.__and__, (made[k][1] for k in [*keep, i]))).isEmpty():
                keep.append(i)
    for i, (f, p) in enumerate(made):
        if i in keep:
            result.df = result.df.where(p)
            result.applied.append(f)
        else:
            result.warnings.append(f"{f.column} {f.op} {f.value!r} skipped: no row would be left")
    return result


def told(f: Filter) -> str:
    """The filter as people read it."""
    op = ALIASES.get(f.op, f.op)
    if op == "between" and isinstance(f.value, (list, tuple)):
        return f"{f.column} between {f.value[0]} and {f.value[1]}"
    value = ", ".join(map(str, f.value)) if isinstance(f.value, (list, tuple, set)) else f.value
    return f"{f.column} {op} {value}"


def evidence(df: DataFrame, applied: Sequence[Filter], date: str | None = None, used: Sequence[str] = ()) -> DataFrame:
    """One row from one scan: rows before and after the filters, the dates that are left, the filters as text and the columns used."""
    kept = reduce(Column.__and__, (predicate(f, df.schema) for f in applied), F.lit(True))
    day = F.when(kept, quoted(date).cast("date")) if date else F.lit(None).cast("date")
    texts = F.array(*(F.lit(told(f)) for f in applied)) if applied else F.array(F.lit("none"))
    columns = list(dict.fromkeys([*used, *(f.column for f in applied), *([date] if date else [])]))
    return df.agg(
        F.count("*").alias("rows_in_dataset"), F.count_if(kept).alias("rows_after_filters"), F.min(day).alias("date_min"), F.max(day).alias("date_max"), texts.alias("filters"), F.array(*map(F.lit, columns)).cast("array<string>").alias("columns_used"),
    )


def one_row(df: DataFrame) -> Column:
    """A frame of one row as a struct, for use beside other rows: a scalar subquery, no join."""
    return df.select(F.struct(*map(quoted, df.columns))).scalar()


def drop_nulls(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(columns)).select(*map(quoted, columns))
