"""Folders of delimited files whose layouts differ from file to file.

One pass over the lines gives a verdict for each file: encoding, separator, header, whether a field goes over lines, and
what is wrong with it. Files of one layout are then read together, and the layouts' columns are matched by their headers'
names, whatever their order. The driver sees one row a file, as it does when Spark lists them.
"""

from __future__ import annotations

import csv
import io
import re
from collections import defaultdict
from collections.abc import Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.operators.clean import tidy_names
from quarry.sources.delimited import MISSING, SEPARATORS

#: What can be wrong with a file.
NO_BYTES, NO_ROWS = "no bytes", "no rows"


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(file) of every file; nothing is read of them. Scans pass over files without a byte, so the names come from Spark's listing."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).inputFiles()
    return spark.createDataFrame([(re.sub("^([a-z]+):///", r"\1:/", f),) for f in listed], "file string")  # as _metadata spells them


def _lines(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(file, size, at, raw): every line as its bytes, and its place in the file."""
    read = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path)
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    return read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), at.alias("at"), F.col("value").cast("binary").alias("raw"))


def verdicts(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(file, bytes, utf8, separator, over_lines, header, lines, problem) of every file below ``path``.

    The separator is the candidate of the best mean less two standard deviations a line over all lines that aren't
    blank; the earlier one wins a tie, and ``.tsv`` files have tabs. Files are named as Spark's metadata names them, as URIs. ``header`` is the first line as text, ``lines`` counts those that aren't blank.
    """
    # Each byte is one character here, whatever the encoding; separators and quotes are ASCII.
    text = F.decode(F.col("raw"), "ISO-8859-1")
    rows = _lines(spark, path, pattern).select("file", "size", "at", "raw", text.alias("text"), (F.trim(text) != "").alias("some"))
    count = lambda s: (F.length("text") - F.length(F.replace(F.col("text"), F.lit(s), F.lit("")))).cast("double")
    made = []
    for k, s in enumerate(SEPARATORS):
        n = F.when(F.col("some"), count(s))
        made.append(F.when(F.sum(n) > 0, F.struct((F.avg(n) - 2 * F.stddev_pop(n)).alias("score"), F.lit(-k).alias("first"), F.lit(s).alias("separator"))))
    judged = rows.groupBy("file").agg(
        F.bool_and(F.is_valid_utf8(F.col("raw").cast("string"))).alias("utf8"), F.array_max(F.array(*made))["separator"].alias("separator"),
        F.bool_or(count('"') % 2 == 1).alias("over_lines"), F.min_by("raw", F.when(F.col("some"), F.col("at"))).alias("header"), F.count_if("some").alias("lines"), F.max("size").alias("size"),
    )
    header = F.when(F.col("utf8"), F.regexp_replace(F.col("header").cast("string"), "^﻿", "")).otherwise(F.decode(F.col("header"), "ISO-8859-1"))
    tabs = F.lower("file").endswith(".tsv")
    problem = F.when(F.col("size").isNull(), NO_BYTES).when(F.coalesce("lines", F.lit(0)) < 2, NO_ROWS)
    return _files(spark, path, pattern).join(judged, "file", "left").select(
        "file", F.coalesce("size", F.lit(0)).alias("bytes"), "utf8", F.when(tabs, "\t").otherwise(F.coalesce("separator", F.lit(SEPARATORS[0]))).alias("separator"), "over_lines", header.alias("header"), F.coalesce("lines", F.lit(0)).alias("lines"), problem.alias("problem")
    )


def _names(header: str, separator: str) -> list[str]:
    return tidy_names(next(csv.reader(io.StringIO(header), delimiter=separator, skipinitialspace=True), []))


def _header_over_lines(spark: SparkSession, file: str, separator: str, encoding: str) -> list[str]:
    """Of a file whose first line opens a quote that it doesn't close."""
    first = spark.read.csv(file, header=False, sep=separator, quote='"', escape='"', multiLine=True, ignoreLeadingWhiteSpace=True, encoding=encoding).first()
    return tidy_names([(x or "").removeprefix("﻿") for x in first])


def read_folder(spark: SparkSession, path: str, pattern: str = "*", on_problem: str = "raise", file_column: str | None = None) -> tuple[DataFrame, DataFrame]:
    """All rows below ``path`` as text columns, and the verdicts. A column is known by its tidied name in any case; files without it have
    nulls there. ``on_problem``: ``raise`` names the files that have no rows, ``skip`` leaves them out. ``file_column``, if given, names a column with each row's file."""
    if on_problem not in ("raise", "skip"):
        raise ValueError("on_problem is raise or skip")
    judged = verdicts(spark, path, pattern)
    found = judged.collect()  # one row a file
    wrong = [r for r in found if r["problem"]]
    if wrong and on_problem == "raise":
        raise ValueError("; ".join(f"{unquote(r['file'])}: {r['problem']}" for r in sorted(wrong, key=lambda r: r["file"])))
    layouts: dict[tuple, list[str]] = defaultdict(list)
    for r in sorted(found, key=lambda r: r["file"]):
        if r["problem"]:
            continue
        encoding = "UTF-8" if r["utf8"] else "ISO-8859-1"
        open_quote = r["header"].count('"') % 2 == 1
        names = _header_over_lines(spark, unquote(r["file"]), r["separator"], encoding) if open_quote else _names(r["header"], r["separator"])
        layouts[(r["separator"], encoding, bool(r["over_lines"]), tuple(names))].append(unquote(r["file"]))
    if not layouts:
        raise ValueError(f"{path} has no rows")
    known: dict[str, str] = {}  # the first spelling of each name
    parts = []
    for (separator, encoding, over_lines, names), files in layouts.items():
        for n in names:
            known.setdefault(n.lower(), n)
        parts.append(_read(spark, files, separator, encoding, over_lines, [known[n.lower()] for n in names], file_column))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts), judged


def _read(spark: SparkSession, files: Sequence[str], separator: str, encoding: str, over_lines: bool, names: Sequence[str], file_column: str | None) -> DataFrame:
    """Files of one layout. Names are given after reading, so that Spark renames none."""
    schema = ", ".join(f"c{k} string" for k in range(len(names)))
    df = spark.read.csv(list(files), schema=schema, header=True, enforceSchema=True, sep=separator, quote='"', escape='"', multiLine=over_lines, ignoreLeadingWhiteSpace=True, encoding=encoding)
    value: list[Column] = [F.when(~F.col(f"c{k}").isin(*MISSING), F.col(f"c{k}")).alias(n) for k, n in enumerate(names)]
    if file_column:
        value.append(F.col("_metadata.file_path").alias(file_column))
    return df.select(*value)


def layouts(judged: DataFrame) -> DataFrame:
    """(layout, separator, utf8, over_lines, header, files, bytes): the layouts of a folder's files that have rows, by their first file."""
    by = ["separator", "utf8", "over_lines", "header"]
    found = judged.where("problem is null").groupBy(*by).agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.min("file").alias("first"))
    return found.select(F.row_number().over(Window.orderBy("first")).alias("layout"), *by, "files", "bytes")
