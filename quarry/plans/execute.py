"""Runs a spec: filters, then the intent's operator; the result is a lazy DataFrame."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from quarry.operators import aggregate as A
from quarry.operators import relations as R
from quarry.operators import timeseries as S
from quarry.operators.filters import Filtered, apply_filters
from quarry.plans.spec import Spec, is_numeric, quoted, validate, value_name


@dataclass
class Result:
    table: DataFrame
    spec: Spec
    value: str
    notes: list[str]


def run(df: DataFrame, spec: Spec, keys: tuple[str, ...] = (), primary_metric: str | None = None, primary_date: str | None = None) -> Result:
    """The spec's answer over ``df``. ``keys`` order rows of equal value where whole rows are shown."""
    spec, notes = validate(spec, df.schema, primary_metric, primary_date)
    left: Filtered = apply_filters(df, spec.filters)
    out = _dispatch(left.df, spec, keys or tuple(df.columns))
    return Result(out, spec, value_name(spec) if spec.metric or spec.ratio else "", notes + left.warnings)


def _dispatch(df: DataFrame, spec: Spec, keys: tuple[str, ...]) -> DataFrame:
    if spec.intent == "trend":
        out = S.trend(df, spec.date, spec.grain, spec.metric, spec.aggregation, spec.dimensions, spec.ratio)
        return out.orderBy(*map(quoted, [out.columns[0], *spec.dimensions]))
    if spec.intent == "distribution":
        numeric = is_numeric(df.schema[spec.metric].dataType)
        return R.summary(df, spec.metric) if numeric else R.value_counts(df, spec.metric, spec.limit)
    if spec.intent == "relationship":
        return R.pearson(df, spec.metric, spec.second_metric)
    if spec.intent == "correlation":
        return R.correlations(df, [f.name for f in df.schema if is_numeric(f.dataType)])
    if spec.intent == "rows":
        return A.matching_rows(df, spec.metric, keys, spec.sort, spec.limit)
    if spec.intent == "describe":
        from quarry.operators.profile import describe

        return describe(df)
    if not spec.dimensions:
        return A.scalar_ratio(df, spec.ratio) if spec.ratio else A.scalar(df, spec.metric, spec.aggregation)
    found = A.grouped_ratio(df, spec.ratio, spec.dimensions) if spec.ratio else A.grouped(df, spec.metric, spec.aggregation, spec.dimensions)
    return A.ranked(found, spec.dimensions, "value", spec.sort, spec.limit)
