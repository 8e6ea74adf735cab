"""Comparison and summary facts, as rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.aggregate import grouped, ranked
from quarry.operators.filters import one_row, quoted
from quarry.operators.timeseries import calendar


def ranking_facts(table: DataFrame, label: str, sort: str = "desc") -> DataFrame:
    """One row on a ranked (label, value) list of two rows or more: the leader's gap to the next in percent of the next's
    size, its share of the listed total, and the last. The gap is null if the next is 0, the share if the total is."""
    order = [quoted("value").desc_nulls_last() if sort == "desc" else quoted("value").asc_nulls_last(), quoted(label)]
    rank = table.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    pick = lambda k, c: F.max(F.when(F.col("rank") == k, quoted(c)))
    row = rank.agg(F.count("*").alias("n"), pick(1, label).alias("leader"), pick(1, "value").alias("v1"), pick(2, label).alias("runner_up"), pick(2, "value").alias("v2"), F.sum("value").alias("total"), F.max_by(label, "rank").alias("lowest"), F.max_by("value", "rank").alias("lowest_value")).where("n > 1")
    gap = (F.col("v1") - F.col("v2")) / F.nullif(F.abs("v2"), F.lit(0.0)) * 100
    return row.select("leader", "runner_up", F.round(gap, 1).alias("gap_pct"), F.round(F.col("v1") / F.nullif(F.col("total"), F.lit(0.0)) * 100, 1).alias("leader_share_pct"), "lowest", "lowest_value")


def metric_totals(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """(metric, total, average, minimum, maximum) of every metric with a value, from one aggregate."""
    made = [f(quoted(m).cast(kind) if kind else quoted(m)).cast("double").alias(f"{n}{k}") for k, m in enumerate(metrics) for n, f, kind in (("t", F.sum, None), ("n", F.count, None), ("lo", F.min, None), ("hi", F.max, None))]
    cells = [F.struct(F.lit(m).alias("metric"), F.col(f"t{k}").alias("total"), (F.col(f"t{k}") / F.nullif(F.col(f"n{k}"), F.lit(0.0))).alias("average"), F.col(f"lo{k}").alias("minimum"), F.col(f"hi{k}").alias("maximum")) for k, m in enumerate(metrics)]
    return df.agg(*made).select(F.explode(F.array(*cells)).alias("c")).select("c.*").where("total is not null")


def _by_dimension(df: DataFrame, metric: str, dimensions: Sequence[str]) -> DataFrame:
    """(position, dimension, label, value): sums of the metric by every dimension, from one shuffle."""
    cells = [F.struct(F.lit(k).alias("position"), F.lit(d).alias("dimension"), quoted(d).cast("string").alias("label")) for k, d in enumerate(dimensions)]
    long = df.select(F.explode(F.array(*cells)).alias("c"), quoted(metric).alias("m")).where("c.label is not null")
    return long.groupBy("c.position", "c.dimension", "c.label").agg(F.coalesce(F.sum("m").cast("double"), F.lit(0.0)).alias("value"))


def top_by_dimension(df: DataFrame, metric: str, dimensions: Sequence[str], most: int = 3) -> DataFrame:
    """(dimension, rank, label, value, leader_share_pct): the leaders of every dimension. Totals are summed apart from
    the ranking, so neither needs all groups of a dimension in one task."""
    sums = _by_dimension(df, metric, dimensions)
    totals = sums.groupBy("dimension").agg(F.sum("value").alias("total"))
    rank = F.row_number().over(Window.partitionBy("dimension").orderBy(F.desc("value"), "label"))
    top = sums.withColumn("rank", rank).where(F.col("rank") <= most)
    share = F.when(F.col("rank") == 1, F.round(F.col("value") / F.nullif(F.col("total"), F.lit(0.0)) * 100, 1))
    return top.join(F.broadcast(totals), "dimension").select("dimension", "rank", "label", "value", share.alias("leader_share_pct"))


def negative_laggards(df: DataFrame, metric: str, dimensions: Sequence[str]) -> DataFrame:
    """(dimension, label, value): the last of every dimension where its sum is negative."""
    sums = _by_dimension(df, metric, dimensions)
    last = sums.groupBy("dimension").agg(F.min(F.struct("value", "label")).alias("last"))
    return last.where("last.value < 0").select("dimension", "last.label", "last.value")


def yearly_facts(df: DataFrame, date: str, metric: str) -> DataFrame:
    """(period, value, overall_change_pct): yearly totals, gaps as 0, of two years or more; the change from first to last stands in each."""
    years = calendar(df, date, metric, "year").select("period", "value")
    ends = years.agg(F.count("*").alias("n"), F.min_by("value", "period").alias("first"), F.max_by("value", "period").alias("last")).where("n >= 2")
    change = (F.col("last") - F.col("first")) / F.nullif(F.abs("first"), F.lit(0.0)) * 100
    return years.withColumn("ends", one_row(ends)).where("ends is not null").select("*", "ends.*").select("period", "value", F.round(change, 1).alias("overall_change_pct"))


def facts_table(parts: Sequence[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """(ord, kind, key, value): facts of several kinds in one table; a part is its kind, rows, key column and value column."""
    return reduce(DataFrame.unionByName, (d.select(F.lit(k).alias("ord"), F.lit(kind).alias("kind"), quoted(key).cast("string").alias("key"), quoted(value).cast("double").alias("value")) for k, (kind, d, key, value) in enumerate(parts)))


def top_categories(df: DataFrame, dimension: str, metric: str, most: int = 10) -> DataFrame:
    rows = df.where(quoted(dimension).isNotNull() & quoted(metric).isNotNull())
    return ranked(grouped(rows, metric, "sum", [dimension]), [dimension], limit=most)
