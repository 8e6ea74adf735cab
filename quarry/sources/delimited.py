"""Delimited text: separators, encodings, parsing. Files are read by lines, which split, and judged by aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Candidates in order; the earlier wins a tie, the first if none occurs.
SEPARATORS = (",", ";", "\t", "|")
#: Texts that count as missing when a file is read.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def separator_scores(lines: DataFrame, file: str = "file", line: str = "line") -> DataFrame:
    """(file, separator): per file the candidate with the best mean less two standard deviations a line, over all lines that aren't blank."""
    text = F.col(line)
    rows = lines.where(F.trim(text) != "")
    scores = []
    for k, s in enumerate(SEPARATORS):
        n = (F.length(text) - F.length(F.replace(text, F.lit(s), F.lit("")))).cast("double")
        scores.append(F.struct(F.when(F.sum(n) > 0, F.avg(n) - 2 * F.stddev_pop(n)).otherwise(F.lit(float("-inf"))).alias("score"), F.lit(-k).alias("first"), F.lit(s).alias("separator"), F.sum(n).alias("seen")))
    best = rows.groupBy(F.col(file).alias("file")).agg(F.array(*scores).alias("scores"))
    top = F.array_max("scores")
    return best.select("file", F.when(top["seen"] > 0, top["separator"]).otherwise(SEPARATORS[0]).alias("separator"))


def decoded(raw: Column, utf8: Column) -> Column:
    """Bytes as text: UTF-8 without its mark where the whole file is valid, else ISO-8859-1."""
    return F.when(utf8, F.regexp_replace(raw.cast("string"), "^﻿", "")).otherwise(F.decode(raw, "ISO-8859-1"))


def utf8_files(lines: DataFrame, file: str = "file", raw: str = "raw") -> DataFrame:
    """(file, utf8): whether every line of a file is valid UTF-8."""
    return lines.groupBy(F.col(file).alias("file")).agg(F.bool_and(F.is_valid_utf8(F.col(raw).cast("string"))).alias("utf8"))


def parsed(lines: Column, schema: str, separator: str) -> Column:
    """A line as a struct of texts; quoted fields may hold the separator."""
    return F.from_csv(lines, schema, {"sep": separator, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "true"})


def odd_quotes(lines: DataFrame, file: str = "file", line: str = "line") -> DataFrame:
    """Files in which some line has an odd number of quotes, so that a field goes over lines; only these need to be read whole."""
    n = F.length(line) - F.length(F.replace(F.col(line), F.lit('"'), F.lit("")))
    return lines.groupBy(F.col(file).alias("file")).agg(F.bool_or(n % 2 == 1).alias("over_lines"))


def read_delimited(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """A file or folder of one layout as text columns; the separator is found over all lines unless given. Tabs in ``.tsv``."""
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.lit(path).alias("file"))
    if separator is None:
        found = None if path.rstrip("/").endswith(".tsv") else separator_scores(lines).first()
        separator = "\t" if path.rstrip("/").endswith(".tsv") else found["separator"] if found else SEPARATORS[0]
    over = odd_quotes(lines).first()
    if over is None:
        raise ValueError(f"{path} has no lines")
    utf8 = lines.agg(F.bool_and(F.is_valid_utf8("line"))).first()[0]
    df = spark.read.csv(path, header=True, sep=separator, quote='"', escape='"', multiLine=bool(over["over_lines"]), ignoreLeadingWhiteSpace=True, encoding="UTF-8" if utf8 else "ISO-8859-1")
    named = df.toDF(*(c.removeprefix("﻿") for c in df.columns))
    out = named.select(*(F.when(~F.col(f"`{c}`").isin(*MISSING), F.col(f"`{c}`")).alias(c) for c in named.columns))
    if out.isEmpty():
        raise ValueError(f"{path} has no rows")
    return out
