"""Approximate column profiles from sketches that merge: one batch is read once, and no batch is read again.

Per column: rows and missing values, exactly; distinct values by HyperLogLog; quantiles of numbers by KLL; frequent values by a
top-k sketch. A profile of batches is that of their merged sketches. The exact profile is in ``profile``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators.profile import value_key
from quarry.plans.spec import is_numeric, quoted

#: Registers of the distinct counts as a power of two, size of the quantile sketches, values that the top-k sketches track.
REGISTERS, QUANTILES, TRACKED = 14, 400, 4096
#: Three standard errors of a distinct count, as a share of it; and by how much the rank of a quantile is off at 99 %, as a share of the values.
DISTINCT_ERROR, RANK_ERROR = 3 * 1.04 / (1 << REGISTERS) ** 0.5, 0.0075
SCHEMA = "position int, column string, rows long, missing long, distinct binary, numbers binary, top struct<sketch:binary,maxItemsTracked:int,itemDataType:string,itemDataTypeDDL:string>"


def _plain(kind: T.DataType) -> bool:
    return not isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))


def sketches(df: DataFrame) -> DataFrame:
    """A row for each column with its sketches, from one aggregate over one scan; long texts count by their digests."""
    cells = []
    for k, f in enumerate(f for f in df.schema if _plain(f.dataType)):
        c, number = quoted(f.name), is_numeric(f.dataType)
        text = value_key(c)
        v = c.cast("double")
        cells.append(F.struct(
            F.lit(k).alias("position"), F.lit(f.name).alias("column"), F.count(F.lit(1)).alias("rows"), F.count_if(c.isNull()).alias("missing"), F.hll_sketch_agg(text, F.lit(REGISTERS)).alias("distinct"),
            (F.kll_sketch_agg_double(F.when(~F.isnan(v), v), F.lit(QUANTILES)) if number else F.lit(None).cast("binary")).alias("numbers"), F.call_function("approx_top_k_accumulate", text, F.lit(TRACKED)).alias("top"),
        ))
    return df.agg(F.array(*cells).alias("all")).select(F.explode("all").alias("c")).select("c.*")


def merged(held: DataFrame) -> DataFrame:
    """The sketches of all batches together, a row for each column."""
    return held.groupBy("column").agg(
        F.min("position").alias("position"), F.sum("rows").alias("rows"), F.sum("missing").alias("missing"), F.hll_union_agg("distinct").alias("distinct"), F.kll_merge_agg_double("numbers").alias("numbers"),
        F.call_function("approx_top_k_combine", F.col("top"), F.lit(TRACKED)).alias("top"), F.count("numbers").alias("numeric"),
    ).select("position", "column", "rows", "missing", "distinct", F.when(F.col("numeric") > 0, F.col("numbers")).alias("numbers"), "top")


def quantile(share: float) -> Column:
    some = F.kll_sketch_get_n_double("numbers") > 0
    return F.when(F.col("numbers").isNotNull() & some, F.kll_sketch_get_quantile_double("numbers", F.lit(share)))


def profile(held: DataFrame, shares: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """(position, column, rows, missing, missing_pct, distinct_about, and a quantile for each share) from sketches."""
    pct = F.round(F.col("missing") / F.greatest("rows", F.lit(1)) * 100, 2).alias("missing_pct")
    return held.select("position", "column", "rows", "missing", pct, F.hll_sketch_estimate("distinct").alias("distinct_about"), *(quantile(s).alias(f"p{round(100 * s)}_about") for s in shares))


def top_values(held: DataFrame, most: int = 10) -> DataFrame:
    """(column, rank, value, n): the frequent values, ties by value; exact where a column has no more values than are tracked. Long texts are digests."""
    listed = F.call_function("approx_top_k_estimate", F.col("top"), F.lit(most + 1))
    rows = held.select("column", F.explode(listed).alias("t")).where("t.item is not null").select("column", F.col("t.item").alias("value"), F.col("t.count").alias("n"))
    by = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "value")))
    return rows.groupBy("column").agg(F.slice(by, 1, most).alias("all")).select("column", F.posexplode("all").alias("k", "t")).select("column", (F.col("k") + 1).alias("rank"), "t.value", (-F.col("t.n")).alias("n"))


class ProfileStore:
    """Sketches kept at ``path``, one set a batch."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def add(self, batch: DataFrame) -> None:
        sketches(batch).write.mode("append").parquet(self.path)

    def merged(self) -> DataFrame:
        return merged(self.spark.read.schema(SCHEMA).parquet(self.path))
