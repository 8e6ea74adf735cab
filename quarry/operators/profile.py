"""Column profiles: counts, statistics, roles, and what follows from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators.filters import quoted
from quarry.operators.quantiles import quantile_columns
from quarry.plans.spec import is_date, is_numeric

# Fragments of column names that tell what a column is.
ID_HINTS = ("id", "code", "key", "number", "no.", "uuid", "guid", "sku", "ref")
METRIC_HINTS = ("sales", "revenue", "profit", "amount", "cost", "price", "value", "total", "quantity", "qty", "units", "spend", "margin", "income", "discount", "fee", "budget", "count", "volume", "gmv", "sum")
RATIO_HINTS = ("rate", "ratio", "percent", "pct", "%", "score", "avg", "average", "index")
HEADLINE = ("sales", "revenue", "amount", "total", "profit", "value", "price", "quantity")
DATE_HEADLINE = ("order", "transaction", "invoice", "sale", "purchase")
DERIVED = (
    ("Profit Margin %", ("profit",), ("sales", "revenue", "amount", "total"), 100.0),
    ("Average Selling Price", ("sales", "revenue", "amount", "total"), ("quantity", "qty", "units"), 1.0),
    ("Return on Cost %", ("profit",), ("cost",), 100.0),
)
#: Longer texts are counted by a 128-bit digest, so that no long text is a shuffle key.
LONGEST_KEY = 64


def _atomic(kind: T.DataType) -> bool:
    return not isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))


def _kind(kind: T.DataType) -> str:
    return "date" if is_date(kind) else "number" if is_numeric(kind) else "bool" if isinstance(kind, T.BooleanType) else "text"


def value_key(c: Column) -> Column:
    text = c.cast("string")
    return F.when(F.length(text) > LONGEST_KEY, F.concat(F.lit("md5:"), F.md5(text.cast("binary")))).otherwise(text)


def _long(df: DataFrame) -> DataFrame:
    """(position, column, value) of every cell of a column that has one value; long texts as digests."""
    key = lambda f: value_key(quoted(f.name)) if _kind(f.dataType) == "text" else quoted(f.name).cast("string")  # noqa: E731  others are short
    cells = [F.struct(F.lit(k).alias("position"), F.lit(f.name).alias("column"), key(f).alias("value")) for k, f in enumerate(df.schema) if _atomic(f.dataType)]
    return df.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def value_counts_long(df: DataFrame) -> DataFrame:
    """(position, column, value, n): one shuffle that distinct counts, missing counts and top values share."""
    return _long(df).groupBy("position", "column", "value").agg(F.count("*").alias("n"))


def counts(df: DataFrame, approx: bool = False) -> DataFrame:
    """(position, column, rows, missing, unique, missing_pct). ``approx`` takes the distinct values from sketches: one aggregate, where
    the exact way shuffles every distinct value of every column; all else is exact either way."""
    if approx:
        from quarry.operators import sketches

        return sketches.profile(sketches.sketches(df), ()).select("position", "column", "rows", "missing", F.col("distinct_about").alias("unique"), "missing_pct")
    values = _long(df).groupBy("position", "value").agg(F.count("*").alias("n"))  # names aren't part of the many keys
    named = values.withColumn("column", F.get(F.array(*map(F.lit, df.columns)), F.col("position")))
    out = named.groupBy("position", "column").agg(F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0).cast("long")).alias("missing"), F.count("value").alias("unique"))
    return out.withColumn("missing_pct", F.round(F.col("missing") / F.greatest(F.col("rows"), F.lit(1)) * 100, 2))


def top_values(df: DataFrame, columns: list[str] | None = None, most: int = 10) -> DataFrame:
    """(column, rank, value, n): the most frequent values, ties by value. Digests give way to their texts."""
    chosen = df.select(*(quoted(c) for c in columns)) if columns else df
    first = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    top = value_counts_long(chosen).where("value is not null").withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= most).select("column", "rank", "value", "n")
    texts = [f.name for f in chosen.schema if isinstance(f.dataType, T.StringType)]
    if not texts:
        return top
    whole = [chosen.select(F.lit(c).alias("column"), value_key(quoted(c)).alias("value"), quoted(c).alias("text")).where(F.length("text") > LONGEST_KEY) for c in texts]
    wanted = top.where("value like 'md5:%'").select("column", "value")
    found = reduce(DataFrame.unionByName, whole).join(F.broadcast(wanted), ["column", "value"], "left_semi").groupBy("column", "value").agg(F.min("text").alias("text"))  # ``most`` texts a column
    return top.join(found, ["column", "value"], "left").select("column", "rank", F.coalesce("text", "value").alias("value"), "n")


def samples(df: DataFrame, most: int = 5) -> DataFrame:
    """(column, rank, value): the smallest distinct values as text."""
    first = Window.partitionBy("column").orderBy("value")
    return value_counts_long(df).where("value is not null").withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= most).select("column", "rank", "value")


def _numeric_long(df: DataFrame) -> DataFrame:
    cells = [F.struct(F.lit(f.name).alias("column"), quoted(f.name).cast("double").alias("v")) for f in df.schema if is_numeric(f.dataType)]
    return df.select(F.explode(F.array(*cells)).alias("c")).select("c.*").where("v is not null and not isnan(v)")


def numeric_stats(df: DataFrame) -> DataFrame:
    """(column, minimum, maximum, mean, median, std, zeros, negatives) of every numeric column; the std of one value is 0."""
    long = _numeric_long(df)
    plain = long.groupBy("column").agg(
        F.min("v").alias("minimum"), F.max("v").alias("maximum"), F.avg("v").alias("mean"), F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("std"),
        F.count_if(F.col("v") == 0).alias("zeros"), F.count_if(F.col("v") < 0).alias("negatives"),
    )
    return plain.join(quantile_columns(long, "v", {"median": 0.5}, ["column"]), "column")


def metric_stats(df: DataFrame) -> DataFrame | None:
    """``numeric_stats`` of the metrics alone, with their positions; None if there are none. Quantiles of identifiers, which are the most distinct
    values, aren't worked out."""
    metrics = {r["column"]: r["position"] for r in roles(df).where("role = 'metric'").select("position", "column").collect()}  # no more than there are columns
    if not metrics:
        return None
    places = F.create_map(*(F.lit(x) for pair in metrics.items() for x in pair))
    return numeric_stats(df.select(*map(quoted, metrics))).withColumn("position", F.get(F.map_values(F.map_filter(places, lambda c, _: c == F.col("column"))), F.lit(0)))


def outliers(df: DataFrame, least: int = 10) -> DataFrame:
    """(column, n, outliers): values beyond one and a half interquartile ranges; none if there are fewer than ``least`` values
    (``too_short``) or the range is 0."""
    long = _numeric_long(df)
    quarters = quantile_columns(long, "v", {"q1": 0.25, "q3": 0.75}, ["column"])
    spread = F.col("q3") - F.col("q1")
    out = (F.col("v") < F.col("q1") - 1.5 * spread) | (F.col("v") > F.col("q3") + 1.5 * spread)
    met = long.join(F.broadcast(quarters), "column").groupBy("column").agg(F.count("*").alias("n"), F.count_if(out & (spread > 0)).alias("outliers"))
    return met.select("column", "n", F.when(F.col("n") < least, 0).otherwise(F.col("outliers")).cast("long").alias("outliers"), (F.col("n") < least).alias("too_short"))


def date_bounds(df: DataFrame) -> DataFrame:
    """(column, date_min, date_max) of every date column."""
    dates = [f.name for f in df.schema if is_date(f.dataType)]
    ends = df.agg(*(g(quoted(c)).cast("date").alias(f"{n}{k}") for k, c in enumerate(dates) for n, g in (("lo", F.min), ("hi", F.max))))
    return ends.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"lo{k}").alias("date_min"), F.col(f"hi{k}").alias("date_max")) for k, c in enumerate(dates)))).alias("c")).select("c.*")


def _hinted(hints: tuple[str, ...]) -> Column:
    return reduce(Column.__or__, (F.contains(F.lower("column"), F.lit(h)) for h in hints))


def roles(df: DataFrame, approx: bool = False) -> DataFrame:
    """(position, column, kind, unique, missing_pct, role, default_aggregation) by name, type and values; ``approx`` as in ``counts``."""
    about = [F.struct(F.lit(f.name).alias("column"), F.lit(_kind(f.dataType)).alias("kind")) for f in df.schema if _atomic(f.dataType)]
    kinds = df.sparkSession.range(1).select(F.explode(F.array(*about)).alias("c")).select("c.*")
    facts = []
    for f in df.schema:
        if _atomic(f.dataType):
            number, c = is_numeric(f.dataType), quoted(f.name)
            v = c.cast("double") if number else F.lit(None).cast("double")
            length = F.length(c.cast("string")) if _kind(f.dataType) == "text" else F.lit(None).cast("int")
            facts += [F.struct(F.lit(f.name).alias("column"), F.coalesce(F.bool_and(v % 1 == 0), F.lit(True)).alias("whole"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.avg(length).alias("mean_length"))]
    more = df.agg(F.array(*facts).alias("all")).select(F.explode("all").alias("c")).select("c.*")
    known = counts(df, approx).join(F.broadcast(kinds), "column").join(F.broadcast(more), "column")
    is_id, is_metric = _hinted(ID_HINTS), _hinted(METRIC_HINTS)
    share = F.col("unique") / F.greatest(F.col("rows") - F.col("missing"), F.lit(1))
    number = F.when(is_id & ~is_metric, "identifier").when((F.col("unique") <= 12) & F.col("whole") & ~is_metric, "dimension").otherwise("metric")
    text = F.when(is_id & (share > 0.5), "identifier").when((share > 0.6) & (F.col("unique") > 200) & (F.col("mean_length") > 60), "text").otherwise("dimension")
    role = F.when(F.col("kind") == "date", "date").when(F.col("kind") == "bool", "dimension").when(F.col("kind") == "number", number).otherwise(text)
    fraction = (F.col("lo") >= 0) & (F.col("hi") <= 1) & (F.col("unique") > 2)
    known = known.withColumn("role", role)
    default = F.when(F.col("role") == "metric", F.when(_hinted(RATIO_HINTS) | F.coalesce(fraction, F.lit(False)), "mean").otherwise("sum"))
    return known.withColumn("default_aggregation", default).select("position", "column", "kind", "unique", "missing_pct", "role", "default_aggregation")


def _hint_rank(hints: tuple[str, ...]) -> Column:
    return F.coalesce(*(F.when(F.contains(F.lower("column"), F.lit(h)), k) for k, h in enumerate(hints)), F.lit(len(hints)))


def primary_metric(df: DataFrame) -> DataFrame:
    """One row: the metric whose name has the first headline word, or else the greatest spread."""
    metrics = roles(df).where("role = 'metric'").join(numeric_stats(df).select("column", "std"), "column", "left").withColumn("hint", _hint_rank(HEADLINE))
    spread = F.when(F.col("hint") == len(HEADLINE), -F.coalesce("std", F.lit(0.0))).otherwise(0.0)
    return metrics.orderBy("hint", spread, "position").limit(1).select(F.col("column").alias("primary_metric"))


def primary_date(df: DataFrame) -> DataFrame:
    """One row: the first date column with a headline word in its name, or else the first."""
    hinted = F.when(_hint_rank(DATE_HEADLINE) < len(DATE_HEADLINE), 0).otherwise(1)
    return roles(df).where("role = 'date'").orderBy(hinted, "position").limit(1).select(F.col("column").alias("primary_date"))


def rank_dimensions(df: DataFrame) -> DataFrame:
    """(rank, column, unique, band): dimensions by how well they group; a handful of values is best."""
    band = F.when((F.col("unique") <= 1) | _hinted(ID_HINTS), 0).when(F.col("unique") <= 12, 4).when(F.col("unique") <= 40, 3).when(F.col("unique") <= 500, 2).otherwise(1)
    found = roles(df).where("role = 'dimension'").withColumn("band", band)
    return found.select(F.row_number().over(Window.orderBy(F.desc("band"), "unique", "position")).alias("rank"), "column", "unique", "band")


def row_digest(df: DataFrame) -> Column:
    """128 bits of a whole row; nulls count as values of their own."""
    cells = [F.coalesce(F.concat(F.lit("v"), F.to_json(F.struct(quoted(f.name).alias("x"))) if not _atomic(f.dataType) else quoted(f.name).cast("string")), F.lit("n")) for f in df.schema]
    return F.md5(F.concat_ws("\x1f", *cells).cast("binary"))


def totals(df: DataFrame) -> DataFrame:
    """One row: rows, columns, missing cells and their share, and rows that repeat another."""
    rows = df.select(row_digest(df).alias("d"), reduce(Column.__add__, (F.when(quoted(f.name).isNull(), 1).otherwise(0) for f in df.schema)).cast("long").alias("missing"))
    each = rows.groupBy("d").agg(F.count("*").alias("n"), F.sum("missing").alias("missing"))
    out = each.agg(F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("rows"), F.coalesce(F.sum("missing"), F.lit(0).cast("long")).alias("missing_cells"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0).cast("long")).alias("duplicate_rows"))
    n = len(df.columns)
    return out.select("rows", F.lit(n).cast("long").alias("columns"), "missing_cells", F.round(F.col("missing_cells") / F.greatest(F.col("rows") * n, F.lit(1)) * 100, 2).alias("missing_pct"), "duplicate_rows")


def describe(df: DataFrame) -> DataFrame:
    """(position, column, role, kind, unique, missing_pct, example): the schema with its profile; the example is the smallest value."""
    first = samples(df, 1).select("column", F.col("value").alias("example"))
    return roles(df).join(first, "column", "left").select("position", "column", "role", "kind", "unique", "missing_pct", "example")


def missing_shares(df: DataFrame) -> DataFrame:
    """(column, missing_pct) of columns with missing values, the least first."""
    return counts(df).where("missing > 0").select("column", "missing_pct").orderBy("missing_pct", "column")


def derived_metrics(df: DataFrame) -> DataFrame:
    """(name, numerator, denominator, scale): ratios that the metrics allow; the first name word decides, then the column's place."""
    metrics = roles(df).where("role = 'metric'").select("position", "column")

    def first(hints: tuple[str, ...]) -> Column:
        hint = _hint_rank(hints)
        return F.min(F.when(hint < len(hints), F.struct(hint.alias("hint"), "position", "column")))["column"]

    # One aggregate finds all sides, so that the roles are worked out once.
    row = metrics.agg(*(first(hints).alias(f"{side}{k}") for k, (_, top, bottom, _) in enumerate(DERIVED) for side, hints in (("n", top), ("d", bottom))))
    cells = [F.struct(F.lit(name).alias("name"), F.col(f"n{k}").alias("numerator"), F.col(f"d{k}").alias("denominator"), F.lit(scale).alias("scale")) for k, (name, _, _, scale) in enumerate(DERIVED)]
    return row.select(F.explode(F.array(*cells)).alias("c")).select("c.*").where("numerator is not null and denominator is not null")


def kpi_cards(df: DataFrame, metrics: dict[str, str], ratios: list[tuple[str, str, str, float]], dimension: str | None) -> DataFrame:
    """(position, label, value, format) from one aggregate: rows, every metric's total or average, every ratio with a
    denominator that isn't 0, and the distinct values of the best dimension. Metrics without a value have no card."""
    made, cards = [F.count("*").cast("double").alias("c0")], [("Rows", "int")]
    for name, how in metrics.items():
        c = quoted(name)
        made.append((F.sum(c).cast("double") / F.nullif(F.count(c), F.lit(0)) if how == "mean" else F.sum(c).cast("double")).alias(f"c{len(made)}"))
        cards.append((f"{'Avg' if how == 'mean' else 'Total'} {name}", "num"))
    for name, top, bottom, scale in ratios:
        made.append((F.sum(quoted(top)).cast("double") / F.nullif(F.sum(quoted(bottom)).cast("double"), F.lit(0.0)) * scale).alias(f"c{len(made)}"))
        cards.append((name, "pct" if scale == 100 else "num"))
    if dimension:
        made.append(F.count_distinct(quoted(dimension)).cast("double").alias(f"c{len(made)}"))
        cards.append((f"Distinct {dimension}", "int"))
    row = df.agg(*made)
    cells = [F.struct(F.lit(k).alias("position"), F.lit(label).alias("label"), F.col(f"c{k}").alias("value"), F.lit(form).alias("format")) for k, (label, form) in enumerate(cards)]
    return row.select(F.explode(F.array(*cells)).alias("c")).select("c.*").where("value is not null")


def filter_options(df: DataFrame, dimensions: list[str], most_values: int | None = None) -> DataFrame:
    """(column, value): the distinct values of every dimension as text; ``most_values`` leaves out dimensions with more."""
    found = value_counts_long(df.select(*map(quoted, dimensions))).where("value is not null").select("column", "value")
    if most_values is not None:
        found = found.join(found.groupBy("column").count().where(F.col("count") <= most_values).select("column"), "column")
    return found
