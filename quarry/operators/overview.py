"""A dashboard's numbers from one pass over a view: cards, months, leaders, histogram, correlations, missing shares, anomalies.

The view is read once. Aggregates over all rows are observed while a second kind of aggregate is written: sums of the
headline metric by month, by every dimension's labels, and counts of its distinct values. All parts come from those.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from quarry.operators import relations as R
from quarry.operators import timeseries as S
from quarry.plans.spec import Ratio, quoted
from quarry.sources.shared import observed, written

#: Kinds of cells: the months, the distinct values, and from here on the dimensions.
MONTH, VALUE, FIRST_DIMENSION = 0, 1, 2


def cells(df: DataFrame, metric: str, date: str | None, dimensions: Sequence[str]) -> DataFrame:
    """(kind, key, x, n, total, values): rows, sum and count of the metric by month, by distinct value and by label of every dimension."""
    cell = lambda kind, key, x=F.lit(None): F.struct(F.lit(kind).alias("kind"), key.cast("string").alias("key"), x.cast("double").alias("x"))
    made = [cell(VALUE, F.lit(None), quoted(metric))]
    if date:
        made.append(cell(MONTH, F.date_format(quoted(date), "yyyy-MM")))
    made += [cell(FIRST_DIMENSION + k, quoted(d)) for k, d in enumerate(dimensions)]
    long = df.select(F.explode(F.array(*made)).alias("c"), quoted(metric).alias("m")).where("c.key is not null or c.x is not null")
    return long.groupBy("c.kind", "c.key", "c.x").agg(F.count("*").alias("n"), F.sum("m").alias("total"), F.count("m").alias("values"))


def whole(df: DataFrame, metrics: Sequence[str]) -> list[Column]:
    """Aggregates over all rows: sizes, sums, correlations, missing values."""
    value = [quoted(m).cast("double") for m in metrics]
    out = [F.count(F.lit(1)).alias("rows")]
    out += [x for k, m in enumerate(metrics) for x in (F.sum(quoted(m)).cast("double").alias(f"sum{k}"), F.count(quoted(m)).alias(f"count{k}"))]
    out += [F.round(R.correlation(value[i], value[j]), 3).alias(f"r{i}_{j}") for i in range(len(metrics)) for j in range(i + 1, len(metrics))]
    return out + [F.count_if(quoted(c).isNull()).alias(f"missing{k}") for k, c in enumerate(df.columns)]


def overview(df: DataFrame, metrics: dict[str, str], ratios: Sequence[tuple[str, Ratio]] = (), metric: str | None = None, date: str | None = None, dimensions: Sequence[str] = (), most: int = 10, bins: int = R.BINS) -> DataFrame:
    """(ord, kind, key, value). ``metrics`` names each metric's sum or mean; ``metric``, the first unless given, is the one of the months, leaders and bins.

    0 card, 1 month (empty ones are 0), 2 top (dimension, place and label), 3 bin, 4 correlation of two metrics, 5 missing (percent of
    columns that lack values), 6 anomaly (z-score of a month). A view without rows has its cards alone."""
    names = list(metrics)
    metric = metric or names[0]
    seen = Observation()
    held = written(cells(df.observe(seen, *whole(df, names)), metric, date, dimensions), "overview")
    about = observed(seen) or {"rows": 0}
    spark = df.sparkSession
    labels = held.where(F.col("kind") >= FIRST_DIMENSION)

    def place(k: int) -> int:
        return names.index(k)

    cards: list[tuple[str, Any]] = [("Rows", float(about["rows"]))]
    for k, (name, how) in enumerate(metrics.items()):
        total, n = about.get(f"sum{k}"), about.get(f"count{k}")
        if n:
            cards.append((f"{'Avg' if how == 'mean' else 'Total'} {name}", total / n if how == "mean" else total))
    for name, r in ratios:
        top, bottom = about.get(f"sum{place(r.numerator)}"), about.get(f"sum{place(r.denominator)}")
        if top is not None and bottom:
            cards.append((name, top / bottom * r.scale))
    if dimensions:
        cards.append((f"Distinct {dimensions[0]}", float(labels.where(F.col("kind") == FIRST_DIMENSION).count())))
    pairs = [(f"{names[i]}|{names[j]}", about.get(f"r{i}_{j}")) for i in range(len(names)) for j in range(i + 1, len(names))]
    missing = [(c, round(100 * about[f"missing{k}"] / about["rows"], 2)) for k, c in enumerate(df.columns) if about.get(f"missing{k}")]
    known = [(o, kind, k, v) for o, kind, part in ((0, "card", cards), (4, "correlation", pairs), (5, "missing", missing)) for k, v in part]
    parts = [spark.createDataFrame(known, "ord int, kind string, key string, value double")]

    def part(ord_: int, kind: str, rows: DataFrame) -> None:
        parts.append(rows.select(F.lit(ord_).alias("ord"), F.lit(kind).alias("kind"), F.col("key"), F.col("value").cast("double").alias("value")))

    if date:
        months = held.where(F.col("kind") == MONTH).select(F.to_date(F.concat("key", F.lit("-01"))).alias("start"), F.coalesce(F.col("total").cast("double"), F.lit(0.0)).alias("total"))
        part(1, "month", S.calendar(months, "start", "total", "month").withColumnRenamed("period", "key"))
        part(6, "anomaly", S.anomalies(months, "start", "total").select(F.col("period").alias("key"), F.col("z_score").alias("value")))
    if dimensions:
        rank = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("total"), "key"))
        top = labels.where(F.col("values") > 0).withColumn("rank", rank).where(F.col("rank") <= most)
        name = F.element_at(F.array(*map(F.lit, dimensions)), F.col("kind") - FIRST_DIMENSION + 1)
        part(2, "top", top.select(F.concat_ws("|", name, F.col("rank").cast("string"), "key").alias("key"), F.col("total").alias("value")))
    counted = held.where(F.col("kind") == VALUE)
    part(3, "bin", R.histogram(counted, "x", bins, weight="n").select(F.col("bin").cast("string").alias("key"), F.col("count").alias("value")))
    return reduce(DataFrame.unionByName, parts)
