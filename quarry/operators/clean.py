"""Cleaning of text columns read from delimited files. Every ratio is over all rows, and one aggregate serves a whole table."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators.filters import quoted
from quarry.operators.profile import row_digest

# Texts that stand for nothing, signs around numbers, name fragments of dates, and date styles in order.
NULL_TOKENS = ("", "nan", "None", "NULL")
NUMBER_SIGNS = r"[,$€£₹%\s]"
NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
DATE_HINTS = ("date", "time", "day", "month", "year", "timestamp", "period")
DATE_STYLES = {
    "yyyy-MM-dd HH:mm:ss": r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$", "yyyy-MM-dd'T'HH:mm:ss": r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$", "yyyy-MM-dd": r"^\d{4}-\d{2}-\d{2}$", "yyyy/M/d": r"^\d{4}/\d{1,2}/\d{1,2}$",
    "M/d/yyyy": r"^(0?[1-9]|1[0-2])/(0?[1-9]|[12]\d|3[01])/\d{4}$", "d/M/yyyy": r"^(0?[1-9]|[12]\d|3[01])/(0?[1-9]|1[0-2])/\d{4}$",
    "MMM d, yyyy": r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMMM d, yyyy": r"^[A-Za-z]{3,9} \d{1,2}, \d{4}$", "d MMM yyyy": r"^\d{1,2} [A-Za-z]{3} \d{4}$", "yyyy": r"^\d{4}$",
}
MONTH_FIRST, DAY_FIRST = "M/d/yyyy", "d/M/yyyy"
EDGES = r"^\s+|\s+$"


def tidy_names(names: Sequence[str]) -> list[str]:
    """Names without outer or double white space; blank ones are ``unnamed``, and repeats, also in another case, are numbered."""
    out, seen = [], set()
    for name in names:
        base = " ".join(name.split()) or "unnamed"
        tidy, k = base, 0
        while tidy.lower() in seen:
            k += 1
            tidy = f"{base} ({k})"
        seen.add(tidy.lower())
        out.append(tidy)
    return out


def trimmed(c: Column) -> Column:
    """Without outer white space; null if what is left stands for nothing."""
    bare = F.regexp_replace(c, EDGES, "")
    return F.when(~bare.isin(*NULL_TOKENS), bare)


def as_number(c: Column) -> Column:
    """The number behind currency signs, separators, percent signs and accounting brackets; null if there is none. Product
    codes such as 12D are none, though a cast alone would read them."""
    bare = F.regexp_replace(F.regexp_replace(c, NUMBER_SIGNS, ""), r"^\((.*)\)$", "-$1")
    return F.when(bare.rlike(NUMBER), bare.try_cast("double"))


def in_style(c: Column, style: str) -> Column:
    """The time that the text tells in that style, else null. Only texts of the style's form are parsed, as a failed parse costs much more than a look."""
    return F.when(c.rlike(DATE_STYLES[style]), F.try_to_timestamp(c, F.lit(style)))


def as_date(c: Column, day_first: bool = False) -> Column:
    """The time that the text tells in the first style that reads it. Of 3/4/2020 the column decides, not the value: ``day_first`` holds for all of it."""
    other = {MONTH_FIRST: DAY_FIRST, DAY_FIRST: MONTH_FIRST} if day_first else {}
    return F.coalesce(*(in_style(c, other.get(style, style)) for style in DATE_STYLES)).cast("timestamp_ntz")


@dataclass
class Report:
    """What cleaning did, and counts before and after."""

    renamed: dict[str, str] = field(default_factory=dict)
    empty_columns: list[str] = field(default_factory=list)
    index_columns: list[str] = field(default_factory=list)
    numbers: list[str] = field(default_factory=list)
    dates: list[str] = field(default_factory=list)
    day_first: list[str] = field(default_factory=list)
    before: dict[str, int] = field(default_factory=dict)
    after: dict[str, int] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)


def column_facts(df: DataFrame) -> DataFrame:
    """(position, column, is_text, rows, present, texts, numbers, dates, month_first, day_first, plain_digits) of every column from one aggregate.
    Texts are trimmed once, before they are tried; ``month_first`` and ``day_first`` count the dates that either reading of 3/4/2020 takes."""
    text = [isinstance(f.dataType, T.StringType) for f in df.schema]
    rows = df.select(*((trimmed(quoted(f.name)) if t else quoted(f.name).isNotNull()).alias(f"c{k}") for k, (f, t) in enumerate(zip(df.schema, text, strict=True))), *(quoted(f.name).isNotNull().alias(f"p{k}") for k, f in enumerate(df.schema)))
    some = lambda c: F.coalesce(c, F.lit(False))
    cells = []
    for k, f in enumerate(df.schema):
        t = F.col(f"c{k}") if text[k] else F.lit(None).cast("string")
        zero = F.lit(0).cast("long")
        tried = [F.count(t), F.count(as_number(t)), F.count(as_date(t)), F.count(in_style(t, MONTH_FIRST)), F.count(in_style(t, DAY_FIRST)), F.count_if(some(t.rlike(r"^\d{1,8}$")))] if text[k] else [zero] * 6
        names = ("texts", "numbers", "dates", "month_first", "day_first", "plain_digits")
        cells.append(F.struct(F.lit(k).alias("position"), F.lit(f.name).alias("column"), F.lit(text[k]).alias("is_text"), F.count("*").alias("rows"), F.count_if(F.col(f"p{k}")).alias("present"), *(x.alias(n) for x, n in zip(tried, names, strict=True))))
    return rows.agg(F.array(*cells).alias("all")).select(F.explode("all").alias("c")).select("c.*")


def decisions() -> Column:
    """What becomes of a column by its facts: drop, number, date or keep."""
    hinted = F.lit(False)
    for h in DATE_HINTS:
        hinted = hinted | F.contains(F.lower("column"), F.lit(h))
    share = lambda c: F.col(c) / F.nullif(F.col("texts"), F.lit(0))
    number = F.col("is_text") & (share("numbers") > 0.9)
    enough = share("dates") > F.when(hinted, 0.7).otherwise(0.95)
    date = F.col("is_text") & enough & ~((share("plain_digits") > 0.8) & ~hinted) & (F.col("dates") / F.col("rows") > 0.5)
    return F.when(F.col("present") == 0, "drop").when(number, "number").when(date, "date").otherwise("keep")


def drop_empty_rows(df: DataFrame) -> DataFrame:
    return df.na.drop("all")


def is_index_name(name: str) -> bool:
    return re.fullmatch(r"(?i)unnamed:?\s*\d*|_c0", name) is not None


def drop_index_columns(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Without unique numeric columns named like an exported index."""
    tried = [f.name for f in df.schema if is_index_name(f.name)]
    if not tried:
        return df, []
    facts = df.agg(F.count("*").alias("n"), *(x for k, c in enumerate(tried) for x in (F.count_distinct(quoted(c)).alias(f"d{k}"), F.count(as_number(quoted(c).cast("string"))).alias(f"m{k}")))).first()
    gone = [c for k, c in enumerate(tried) if facts[f"d{k}"] == facts[f"m{k}"] == facts["n"]]
    return df.drop(*gone), gone


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    """One of each set of equal rows; nulls are equal. Rows are compared by a 128-bit digest, so that the shuffle's key is short."""
    held = df.select(F.struct(*(quoted(c) for c in df.columns)).alias("row"), row_digest(df).alias("digest")).dropDuplicates(["digest"])
    return held.select(*(F.col("row").getField(c).alias(c) for c in df.columns))


def size_facts(df: DataFrame) -> DataFrame:
    """One row: rows, columns, missing cells and rows that repeat another."""
    missing = sum((F.when(quoted(f.name).isNull(), 1).otherwise(0) for f in df.schema), F.lit(0))
    each = df.select(row_digest(df).alias("d"), missing.alias("missing")).groupBy("d").agg(F.count("*").alias("n"), F.sum("missing").alias("missing"))
    zero = F.lit(0).cast("long")
    return each.agg(F.coalesce(F.sum("n"), zero).alias("rows"), F.lit(len(df.columns)).cast("long").alias("columns"), F.coalesce(F.sum("missing"), zero).alias("missing"), F.coalesce(F.sum(F.col("n") - 1), zero).alias("duplicates"))


def warnings(rows: int, columns: int, empty_shares: dict[str, float]) -> list[str]:
    out = []
    if rows == 0:
        out.append("no rows are left")
    if columns < 2:
        out.append("fewer than two columns")
    out += [f"{c} is {100 * s:.0f}% empty" for c, s in empty_shares.items() if s > 0.5]
    return out


def present_facts(df: DataFrame) -> tuple[dict[str, int], dict[str, float]]:
    """Sizes of rows that don't repeat, and each column's share of missing values, from one aggregate without a shuffle of rows."""
    row = df.agg(F.count("*").alias("n"), *(F.count_if(quoted(c).isNull()).alias(f"m{k}") for k, c in enumerate(df.columns))).first()
    missing = {c: row[f"m{k}"] for k, c in enumerate(df.columns)}
    return {"rows": row["n"], "columns": len(df.columns), "missing": sum(missing.values()), "duplicates": 0}, {c: m / row["n"] if row["n"] else 0.0 for c, m in missing.items()}


def clean(df: DataFrame) -> tuple[DataFrame, Report]:
    """All steps in order: names, empty columns and rows, index columns, trimming, numbers, dates, duplicate rows."""
    report = Report()
    names = tidy_names(df.columns)
    report.renamed = {a: b for a, b in zip(df.columns, names, strict=True) if a != b}
    df = df.toDF(*names)
    report.before = size_facts(df).first().asDict()
    facts = {r["column"]: r for r in column_facts(df).withColumn("decision", decisions()).collect()}  # one row a column
    verdict = {c: r["decision"] for c, r in facts.items()}
    report.empty_columns = [c for c, d in verdict.items() if d == "drop"]
    out = drop_empty_rows(df.drop(*report.empty_columns))
    out, report.index_columns = drop_index_columns(out)
    made = []
    for f in out.schema:
        c = quoted(f.name)
        if isinstance(f.dataType, T.StringType):
            c = trimmed(c)
            if verdict[f.name] == "number":
                c = as_number(c)
                report.numbers.append(f.name)
            elif verdict[f.name] == "date":
                day_first = facts[f.name]["day_first"] > facts[f.name]["month_first"]
                c = as_date(c, day_first)
                report.dates.append(f.name)
                report.day_first += [f.name] * day_first
        made.append(c.alias(f.name))
    out = drop_duplicate_rows(out.select(*made))
    report.after, shares = present_facts(out)
    report.warnings = warnings(report.after["rows"], len(out.columns), shares)
    return out, report
