"""Periods, trends, calendars without gaps, anomalies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.aggregate import grouped, grouped_ratio
from quarry.operators.filters import one_row, quoted
from quarry.plans.spec import Ratio

STEPS = {"day": "interval 1 day", "week": "interval 7 days", "month": "interval 1 month", "quarter": "interval 3 months", "year": "interval 1 year"}


def period(date: Column, grain: str) -> Column:
    """The label of a date's period: 2017-01-04, 2017-01-02/2017-01-08, 2017-01, 2017Q1 or 2017."""
    day = date.cast("date")
    if grain == "week":
        start = F.date_trunc("week", day).cast("date")
        return F.concat_ws("/", start.cast("string"), F.date_add(start, 6).cast("string"))
    return F.date_format(day, {"day": "yyyy-MM-dd", "month": "yyyy-MM", "quarter": "yyyy'Q'Q", "year": "yyyy"}[grain])


def period_name(used: Sequence[str]) -> str:
    """``period``, or with a number if a column of that name is used."""
    lowered, name, k = {c.lower() for c in used}, "period", 1
    while name in lowered:
        k += 1
        name = f"period {k}"
    return name


def with_period(df: DataFrame, date: str, grain: str, name: str = "period") -> DataFrame:
    return df.where(quoted(date).isNotNull()).withColumn(name, period(quoted(date), grain))


def trend(df: DataFrame, date: str, grain: str, metric: str | None = None, how: str = "sum", by: Sequence[str] = (), ratio: Ratio | None = None) -> DataFrame:
    """Value by period (and dimension); without dimensions also the change from the period before. Empty periods have no row.
    The first column is the period; it is ``period 2`` where a dimension or the metric is called ``period``."""
    name = period_name([*by, *(x for x in (metric, ratio and ratio.numerator, ratio and ratio.denominator) if x)])
    rows = with_period(df, date, grain, name)
    keys = [name, *by]
    out = grouped_ratio(rows, ratio, keys) if ratio else grouped(rows, metric, how, keys)
    return out if by else with_change(out, name)


def with_change(series: DataFrame, by: str = "period") -> DataFrame:
    """Change and change in percent against the period before. The window runs over one row a period."""
    last = F.lag("value").over(Window.orderBy(quoted(by)))
    out = series.withColumn("change", F.round(F.col("value") - last, 2))
    return out.withColumn("change_pct", F.round((F.col("value") - last) / F.nullif(last, F.lit(0.0)) * 100, 1))


def calendar(df: DataFrame, date: str, metric: str, grain: str) -> DataFrame:
    """(start, period, value): the sum for every period from the first to the last date, 0 for those without rows."""
    start = F.date_trunc(grain, quoted(date).cast("date")).cast("date")
    sums = df.where(quoted(date).isNotNull()).groupBy(start.alias("start")).agg(F.coalesce(F.sum(quoted(metric)).cast("double"), F.lit(0.0)).alias("value"))
    spine = sums.agg(F.min("start").alias("lo"), F.max("start").alias("hi")).select(F.explode(F.sequence("lo", "hi", F.expr(STEPS[grain]))).alias("start"))
    return spine.join(sums, "start", "left").select("start", period(F.col("start"), grain).alias("period"), F.coalesce("value", F.lit(0.0)).alias("value"))


def anomalies(df: DataFrame, date: str, metric: str, grain: str = "month", z: float = 2.0, least: int = 6) -> DataFrame:
    """Periods whose rounded z-score reaches ``z``; a series of fewer than ``least`` periods or without spread has none,
    and ``too_short`` tells of the former."""
    series = calendar(df, date, metric, grain)
    about = series.agg(F.count("*").alias("periods"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    score = F.round((F.col("value") - F.col("mean")) / F.nullif(F.col("std"), F.lit(0.0)), 2)
    out = series.withColumn("about", one_row(about)).select("*", "about.*").withColumn("z_score", score).withColumn("too_short", F.col("periods") < least)
    return out.where((F.abs("z_score") >= z) & ~F.col("too_short")).select("period", "value", "z_score", F.when(F.col("z_score") > 0, "above").otherwise("below").alias("direction"), "too_short")


def series_facts(series: DataFrame) -> DataFrame:
    """One row: first, last, change in percent, peak, low (the earliest of equals) and total of a (period, value) series."""
    found = series.agg(
        F.min_by("value", "period").alias("first_value"), F.max_by("value", "period").alias("last_value"),
        F.min(F.struct((-F.col("value")).alias("v"), "period")).alias("peak"), F.min(F.struct(F.col("value").alias("v"), "period")).alias("low"), F.sum("value").alias("total"),
    )
    change = (F.col("last_value") - F.col("first_value")) / F.nullif(F.abs("first_value"), F.lit(0.0)) * 100
    return found.select("first_value", "last_value", F.round(change, 1).alias("change_pct"), F.col("peak.period").alias("peak_period"), (-F.col("peak.v")).alias("peak_value"), F.col("low.period").alias("low_period"), F.col("low.v").alias("low_value"), "total")
