"""Exact quantiles from one pass over the rows and one range shuffle of distinct values.

Distinct values are counted, and their counts sorted over all partitions by group and value and written once. Sums of
the partitions tell in which one each wanted rank lies; only there are values ranked. So a task ranks one
partition's distinct values at most, whatever the group, and the source is read once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.plans.spec import quoted
from quarry.sources.shared import written


def _found(df: DataFrame, value: str, shares: Sequence[float], by: Sequence[str]) -> DataFrame:
    """(g, share, value): the group's keys as one struct, so that no name of the caller's can clash."""
    group = F.struct(*(quoted(c).alias(f"k{i}") for i, c in enumerate(by)), F.lit(0).alias("all")).alias("g")
    values = df.select(group, quoted(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    counts = values.groupBy("g", "v").agg(F.count("*").alias("n"))
    held = written(counts.repartitionByRange("g", "v").sortWithinPartitions("g", "v").withColumn("part", F.spark_partition_id()), "counts")

    sums = held.groupBy("g", "part").agg(F.sum("n").alias("n"))  # a row for each group of a partition
    upto = F.sum("n").over(Window.partitionBy("g").orderBy("part"))
    parts = sums.select("g", "part", (upto - F.col("n")).alias("before"), "n")
    places = F.array(*(F.struct(F.lit(float(s)).alias("share"), ((F.col("total") - 1) * F.lit(float(s))).alias("place")) for s in shares))
    asked = sums.groupBy("g").agg(F.sum("n").alias("total")).select("g", F.explode(places).alias("q")).select("g", "q.*")
    ranks = asked.select("g", F.explode(F.array_distinct(F.array(F.floor("place"), F.ceil("place")))).alias("rank")).distinct()
    where = ranks.join(parts, "g").where("before <= rank and rank < before + n").select("g", "part", "before", "rank")

    own = held.join(where.select("g", "part").distinct(), ["g", "part"], "left_semi")
    last = F.sum("n").over(Window.partitionBy("g", "part").orderBy("v"))
    placed = own.select("g", "part", "v", (last - F.col("n")).alias("first"), last.alias("last"))
    at = placed.join(where, ["g", "part"]).where("first <= rank - before and rank - before < last").groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("values"))  # two ranks a share
    low, high = F.col("values")[F.floor("place")], F.col("values")[F.ceil("place")]
    return asked.join(at, "g").select("g", "share", (low + (high - low) * (F.col("place") - F.floor("place"))).alias("value"))


def exact_quantiles(df: DataFrame, value: str, shares: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by, share, value): interpolated quantiles of the non-null values of each group. Groups without a value have no row."""
    if {"share", "value"} & set(by):
        raise ValueError("share and value are names of the result; use quantile_columns")
    return _found(df, value, shares, by).select(*(F.col(f"g.k{i}").alias(c) for i, c in enumerate(by)), "share", "value")


def quantile_columns(df: DataFrame, value: str, names: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """One row a group (or one row) with a column for each named quantile."""
    if set(names) & set(by):
        raise ValueError(f"{sorted(set(names) & set(by))} are keys and names of quantiles")
    got = _found(df, value, sorted(set(names.values())), by)
    picks = [F.max(F.when(F.col("share") == s, F.col("value"))).alias(n) for n, s in names.items()]
    return got.groupBy("g").agg(*picks).select(*(F.col(f"g.k{i}").alias(c) for i, c in enumerate(by)), *map(quoted, names)) if by else got.agg(*picks)
