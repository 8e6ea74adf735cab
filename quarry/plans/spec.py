"""Declarative analysis specs: what to compute over one table, as plain data, with repairs for what doesn't fit it."""

from __future__ import annotations

import difflib
import re
from collections.abc import Sequence
from dataclasses import asdict, dataclass, replace
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names that a spec may use.
INTENTS = ("aggregate", "topn", "compare", "trend", "distribution", "relationship", "correlation", "rows", "describe")
AGGREGATIONS = ("sum", "mean", "median", "count", "min", "max", "nunique", "std")
GRAINS = ("day", "week", "month", "quarter", "year")
GRAIN_ALIASES = {"m": "month", "y": "year", "daily": "day", "weekly": "week", "monthly": "month", "quarterly": "quarter", "yearly": "year", "annual": "year"}
NUMERIC_ONLY = ("sum", "mean", "median", "std")
#: Intents that aggregate the metric; the others take columns of any kind.
AGGREGATING = ("aggregate", "topn", "compare", "trend")


@dataclass(frozen=True)
class Filter:
    column: str
    op: str = "=="
    value: Any = None


@dataclass(frozen=True)
class Ratio:
    """Sum of one column over the sum of another."""

    numerator: str
    denominator: str
    scale: float = 1.0


@dataclass(frozen=True)
class Spec:
    intent: str = "aggregate"
    metric: str | None = None
    aggregation: str = "sum"
    dimensions: tuple[str, ...] = ()
    filters: tuple[Filter, ...] = ()
    date: str | None = None
    grain: str | None = None
    sort: str = "desc"
    limit: int | None = None
    ratio: Ratio | None = None
    second_metric: str | None = None

    @staticmethod
    def from_dict(d: dict[str, Any]) -> Spec:
        known = {k: v for k, v in d.items() if k in Spec.__dataclass_fields__}
        known["dimensions"] = tuple(known.get("dimensions") or ())
        known["filters"] = tuple(Filter(f["column"], f.get("op") or f.get("operator") or "==", f.get("value")) for f in known.get("filters") or ())
        if isinstance(known.get("ratio"), dict):
            known["ratio"] = Ratio(**known["ratio"])
        return Spec(**known)

    def to_dict(self) -> dict[str, Any]:
        return asdict(self)


def plain_name(name: str) -> str:
    return re.sub(r"[^a-z0-9]", "", name.lower())


def resolve(name: str | None, columns: Sequence[str]) -> str | None:
    """The column meant: by its exact name, in any case, by letters and digits alone, or else the closest; None if none is close."""
    if not name:
        return None
    if name in columns:
        return name
    for same in (str.lower, plain_name):
        found = {same(c): c for c in reversed(columns)}
        if same(name) in found:
            return found[same(name)]
    lowered = {c.lower(): c for c in reversed(columns)}
    close = difflib.get_close_matches(name.lower(), list(lowered), n=1, cutoff=0.82)
    return lowered[close[0]] if close else None


def quoted(name: str) -> Column:
    """The column of that very name, whatever characters are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def is_date(kind: T.DataType) -> bool:
    return isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType))


def value_name(spec: Spec) -> str:
    """How a result calls its value."""
    if spec.ratio:
        return f"{spec.ratio.numerator} per {spec.ratio.denominator}"
    if spec.aggregation == "count":
        return "Row count"
    words = {"sum": "Total", "mean": "Average", "nunique": "Distinct"}
    return f"{words[spec.aggregation]} {spec.metric}" if spec.aggregation in words else f"{spec.aggregation}({spec.metric})"


def merge_filters(spec: Spec, view: Sequence[Filter]) -> Spec:
    """The view's filters added where the spec doesn't filter their column itself."""
    own = {f.column for f in spec.filters}
    return replace(spec, filters=spec.filters + tuple(f for f in view if f.column not in own))


def validate(spec: Spec, schema: T.StructType, primary_metric: str | None = None, primary_date: str | None = None) -> tuple[Spec, list[str]]:
    """A spec that can run on the schema, and a note for each repair. The limit asked for is kept: at least 1, none for all rows."""
    notes: list[str] = []
    columns = [f.name for f in schema]
    kinds = {f.name: f.dataType for f in schema}

    def named(name: str | None) -> str | None:
        found = resolve(name, columns)
        if name and found != name:
            notes.append(f"column {name!r}: " + (f"read as {found!r}" if found else "not found"))
        return found

    changes: dict[str, Any] = {}
    if spec.intent not in INTENTS:
        changes["intent"] = "aggregate"
        notes.append(f"intent {spec.intent!r}: read as 'aggregate'")
    how = spec.aggregation
    if how not in AGGREGATIONS:
        how = "sum"
        notes.append(f"aggregation {spec.aggregation!r}: read as 'sum'")
    metric = named(spec.metric) or (primary_metric if spec.ratio is None else None)
    ratio = spec.ratio
    if ratio:
        top, bottom = named(ratio.numerator), named(ratio.denominator)
        ratio = replace(ratio, numerator=top, denominator=bottom) if top and bottom else None
        if ratio is None:
            notes.append("ratio dropped: a column is missing")
    if metric is None and ratio is None and columns and (changes.get("intent") or spec.intent) not in ("rows", "describe", "correlation"):
        metric, how = columns[0], "count"
        notes.append("no metric: rows are counted")
    second = named(spec.second_metric)
    if (changes.get("intent") or spec.intent) == "relationship":
        wrong = [x for x in (metric, second) if x is None or not is_numeric(kinds[x])]
        if wrong:
            raise ValueError("a relationship needs two numeric columns: " + ", ".join("one is missing" if x is None else f"{x} is {kinds[x].simpleString()}" for x in wrong))
    if metric and ratio is None and how in NUMERIC_ONLY and (changes.get("intent") or spec.intent) in AGGREGATING and not is_numeric(kinds[metric]):
        raise ValueError(f"{how} needs a numeric column; {metric} is {kinds[metric].simpleString()}")
    dimensions = tuple(dict.fromkeys(d for d in map(named, spec.dimensions) if d))
    if len(dimensions) > 2:
        notes.append("only the first two dimensions are used")
    filters = tuple(replace(f, column=c) for f in spec.filters if (c := named(f.column)))
    date = named(spec.date)
    if date and not is_date(kinds[date]):
        notes.append(f"{date} is no date")
        date = None
    date = date or primary_date
    intent = changes.get("intent", spec.intent)
    if intent == "trend" and date is None:
        intent = "aggregate"
        notes.append("no date column: read as 'aggregate'")
    grain = GRAIN_ALIASES.get((spec.grain or "month").lower(), (spec.grain or "month").lower())
    if grain not in GRAINS:
        notes.append(f"grain {spec.grain!r}: read as 'month'")
        grain = "month"
    sort = spec.sort if spec.sort in ("asc", "desc") else "desc"
    limit = None if spec.limit is None else max(1, int(spec.limit))
    if limit is None and intent in ("topn", "rows"):
        limit = 10 if intent == "topn" else 25
    return Spec(intent, metric, how, dimensions[:2], filters, date, grain, sort, limit, ratio, second), notes
