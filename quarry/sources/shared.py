"""Folders that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a session on one machine (tests) gets a folder of its own; a cluster is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="shared-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; what is written there is deleted when the session ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = there.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(there)
    files.deleteOnExit(there)
    return path


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """The rows written as Parquet to the shared folder, read from there from now on."""
    path = f"{new_folder(df.sparkSession, name)}/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def observed(seen: Observation) -> dict[str, Any]:
    """What was observed by an action that has ended; nothing if the optimizer saw that there are no rows and left the observation out."""
    try:
        return seen.get
    except Py4JJavaError:
        return {}
