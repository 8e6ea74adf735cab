"""Distributions and relations of numeric columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.aggregate import steady_sample
from quarry.operators.filters import one_row, quoted
from quarry.operators.quantiles import quantile_columns

BINS = 40
QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}


def summary(df: DataFrame, column: str) -> DataFrame:
    """(position, statistic, value): count, mean, std, min, quartiles and max, rounded to three places."""
    c = quoted(column).cast("double")
    plain = df.agg(F.count(c).cast("double").alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"))
    row = plain.withColumn("q", one_row(quantile_columns(df, column, QUARTILES))).select("*", "q.*")
    order = ["count", "mean", "std", "min", "p25", "p50", "p75", "max"]
    return row.select(F.posexplode(F.array(*(F.struct(F.lit(n).alias("statistic"), F.round(n, 3).alias("value")) for n in order))).alias("position", "s")).select("position", "s.*")


def skew_hint(df: DataFrame, column: str) -> DataFrame:
    """One row: mean, median, std and whether they look symmetric or skewed; without spread 1 counts as the std."""
    c = quoted(column).cast("double")
    row = df.agg(F.avg(c).alias("mean"), F.stddev_samp(c).alias("std")).withColumn("q", one_row(quantile_columns(df, column, {"median": 0.5}))).select("*", "q.*")
    spread = F.when(F.coalesce("std", F.lit(0.0)) == 0, 1.0).otherwise(F.col("std"))
    near = F.abs(F.col("mean") - F.col("median")) < 0.5 * spread
    return row.select("mean", "median", "std", F.when(near, "symmetric").otherwise("skewed").alias("shape"))


def value_counts(df: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    out = df.where(quoted(column).isNotNull()).groupBy(quoted(column).alias("value")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "value")
    return out if limit is None else out.limit(limit)


def histogram(df: DataFrame, column: str, bins: int = BINS, weight: str | None = None) -> DataFrame:
    """(bin, low, high, count): equal bins from the least to the greatest value, empty ones too; one bin if all are equal. A row counts ``weight`` times, if given."""
    values = df.select(quoted(column).cast("double").alias("v"), (quoted(weight) if weight else F.lit(1)).cast("long").alias("w")).where("v is not null")
    ends = values.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).where("lo is not null")
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.width_bucket("v", "lo", "hi", F.lit(bins)), F.lit(bins).cast("long"))).otherwise(F.lit(1).cast("long"))
    counts = values.withColumn("ends", one_row(ends)).select("*", "ends.*").groupBy(place.alias("bin")).agg(F.sum("w").alias("count"))
    spine = ends.select("lo", "hi", F.explode(F.sequence(F.lit(1).cast("long"), F.when(F.col("hi") > F.col("lo"), F.lit(bins)).otherwise(F.lit(1)).cast("long"))).alias("bin"))
    width = (F.col("hi") - F.col("lo")) / bins
    return spine.join(counts, "bin", "left").select("bin", (F.col("lo") + (F.col("bin") - 1) * width).alias("low"), F.when(F.col("hi") > F.col("lo"), F.col("lo") + F.col("bin") * width).otherwise(F.col("hi")).alias("high"), F.coalesce("count", F.lit(0).cast("long")).alias("count"))


def box(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Quartiles, whiskers (the ends of what lies within one and a half interquartile ranges) and outliers of each group."""
    rows = df.select(*map(quoted, by), quoted(column).cast("double").alias("v")).where("v is not null")
    for c in by:
        rows = rows.where(quoted(c).isNotNull())
    quarters = quantile_columns(rows, "v", QUARTILES, by)
    fence = 1.5 * (F.col("p75") - F.col("p25"))
    inside = (F.col("v") >= F.col("p25") - fence) & (F.col("v") <= F.col("p75") + fence)
    keys = list(by)
    met = rows.join(quarters, keys) if keys else rows.withColumn("q", one_row(quarters)).select("*", "q.*")
    return met.groupBy(*keys, "p25", "p50", "p75").agg(F.min(F.when(inside, F.col("v"))).alias("whisker_low"), F.max(F.when(inside, F.col("v"))).alias("whisker_high"), F.count_if(~inside).alias("outliers"))


def correlation(a: Column, b: Column) -> Column:
    """Null where a column is constant; rows with both values count."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def pearson(df: DataFrame, one: str, other: str) -> DataFrame:
    a, b = quoted(one).cast("double"), quoted(other).cast("double")
    return df.agg(F.count_if(a.isNotNull() & b.isNotNull()).alias("n"), correlation(a, b).alias("r"))


def strength(r: Column) -> Column:
    size = F.abs(r)
    return F.when(size > 0.8, "very strong").when(size > 0.6, "strong").when(size > 0.35, "moderate").when(size > 0.15, "weak").when(r.isNotNull(), "negligible")


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_a, column_b, r, strength) of all pairs, from one aggregate; the diagonal is 1, or null for a constant column."""
    value = {c: quoted(c).cast("double") for c in columns}
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    made = [(F.when(F.stddev_pop(value[a]) > 0, 1.0) if a == b else F.round(correlation(value[a], value[b]), 3)).alias(f"r{k}") for k, (a, b) in enumerate(pairs)]
    cells = [F.struct(F.lit(x).alias("column_a"), F.lit(y).alias("column_b"), F.col(f"r{k}").alias("r")) for k, (a, b) in enumerate(pairs) for x, y in dict.fromkeys([(a, b), (b, a)])]
    long = df.agg(*made).select(F.explode(F.array(*cells)).alias("c")).select("c.*")
    return long.withColumn("strength", strength(F.col("r")))


def scatter_sample(df: DataFrame, x: str, y: str, keys: Sequence[str], colour: str | None = None, size: int = 5000) -> DataFrame:
    """At most ``size`` points with both values, the same ones each time; rows of equal keys in the order of their values."""
    rows = df.where(quoted(x).isNotNull() & quoted(y).isNotNull())
    shown = list(dict.fromkeys([*keys, x, y, *([colour] if colour else [])]))
    return steady_sample(rows.select(*map(quoted, shown)), keys, size)
