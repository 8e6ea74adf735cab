"""The corpus pipeline: from raw documents to packed training sequences.

Each stage takes all that its predecessor kept and is written as Parquet and read again, so that a lost executor costs
one stage at most. Toxic documents go, one document of each near-duplicate group stays, documents that hold a
benchmark item go, secrets are masked in the texts that hold them, and what is left is packed.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import secret_scan, toxicity
from quarry.llm.common import table
from quarry.llm.decontaminate import without_leaks
from quarry.llm.near_dedup import one_of_each
from quarry.llm.packing import pack_documents
from quarry.llm.queries import toxicity_model
from quarry.sources.shared import new_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted to be toxic go. The network learns from labelled documents outside the held-out third."""
    return toxicity.without_toxic(docs, toxicity_model(spark, sf_dir))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return one_of_each(docs, percent=75)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"), percent=75)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets give way to a mark; ``n_chars``, where there is one, follows the text."""
    found = secret_scan.redact(secret_scan.find_secrets(docs)).select("row", (F.size("spans") > 0).alias("masked"))
    of = lambda c: F.col("row").getField(c)
    length = F.when(F.col("masked"), F.length(of("text")).cast("long")).otherwise(of("n_chars")) if "n_chars" in docs.columns else None
    return found.select(*((length if c == "n_chars" else of(c)).alias(c) for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left becomes sequences of at most 4096 tokens."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1)


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_copies), ("decontamination", drop_leaks), ("secrets", mask_secrets), ("packing", pack)]

#: A trained network decides in the first stage, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between two is kept in the shared folder until the session ends."""
    folder = new_folder(spark, "corpus")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
