"""Grouped and scalar aggregates, ratios and rankings."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.filters import quoted
from quarry.operators.quantiles import quantile_columns
from quarry.plans.spec import Ratio


def aggregate_column(metric: str, how: str, grouped: bool) -> Column:
    """All aggregations but the median. Sums of nothing are 0; a count is of rows, or in groups of the metric's values."""
    c = quoted(metric)
    return {
        "sum": lambda: F.coalesce(F.sum(c).cast("double"), F.lit(0.0)), "mean": lambda: (F.sum(c).cast("double") / F.nullif(F.count(c), F.lit(0))),
        "count": lambda: F.count(c) if grouped else F.count("*"), "min": lambda: F.min(c), "max": lambda: F.max(c),
        "nunique": lambda: F.count_distinct(c), "std": lambda: F.stddev_samp(c.cast("double")),
    }[how]()


def not_null(columns: Sequence[str]) -> Column:
    return reduce(Column.__and__, (quoted(c).isNotNull() for c in columns), F.lit(True))


def grouped(df: DataFrame, metric: str, how: str, by: Sequence[str], name: str = "value") -> DataFrame:
    """One row for each group whose keys are all there."""
    if name in by:
        raise ValueError(f"{name} is a key; give the result another name")
    rows = df.where(not_null(by))
    if how == "median":
        found = quantile_columns(rows, metric, {name: 0.5}, by)
        every = rows.select(*map(quoted, by)).distinct()  # groups without a value stay, with none
        return every.join(found, list(by), "left")
    return rows.groupBy(*map(quoted, by)).agg(aggregate_column(metric, how, True).alias(name))


def scalar(df: DataFrame, metric: str, how: str, name: str = "value") -> DataFrame:
    if how == "median":
        return quantile_columns(df, metric, {name: 0.5})
    return df.agg(aggregate_column(metric, how, False).alias(name))


def ratio_column(ratio: Ratio) -> Column:
    """Sum over sum, then scaled; null if the denominator's sum is 0 or missing."""
    bottom = F.nullif(F.sum(quoted(ratio.denominator)).cast("double"), F.lit(0.0))
    return F.sum(quoted(ratio.numerator)).cast("double") / bottom * F.lit(float(ratio.scale))


def grouped_ratio(df: DataFrame, ratio: Ratio, by: Sequence[str], name: str = "value") -> DataFrame:
    """Groups without a ratio have no row."""
    return df.where(not_null(by)).groupBy(*map(quoted, by)).agg(ratio_column(ratio).alias(name)).where(quoted(name).isNotNull())


def scalar_ratio(df: DataFrame, ratio: Ratio, name: str = "value") -> DataFrame:
    return df.agg(ratio_column(ratio).alias(name))


def ranked(df: DataFrame, by: Sequence[str], value: str = "value", sort: str = "desc", limit: int | None = None) -> DataFrame:
    """By value, nulls last either way, ties by the keys; all rows if there is no limit."""
    order = quoted(value).desc_nulls_last() if sort == "desc" else quoted(value).asc_nulls_last()
    out = df.orderBy(order, *map(quoted, by))
    return out if limit is None else out.limit(limit)


def matching_rows(df: DataFrame, metric: str | None, keys: Sequence[str], sort: str = "desc", limit: int | None = 25) -> DataFrame:
    """Rows by the metric, if there is one, then by the keys."""
    if metric is None:
        out = df.orderBy(*map(quoted, keys))
        return out if limit is None else out.limit(limit)
    return ranked(df, keys, metric, sort, limit)


def steady_sample(df: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    """The same rows each time and in any engine: those whose keys, as text, have the least MD5; rows of equal keys by their other columns."""
    draw = F.md5(F.concat_ws("\x1f", *(F.coalesce(F.concat(F.lit("v"), quoted(k).cast("string")), F.lit("n")) for k in keys)).cast("binary"))
    return df.orderBy(draw, *map(quoted, keys), *(quoted(c) for c in df.columns if c not in keys)).limit(size)
