"""The registered queries of the text operators, each over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quarry.llm import filter_audit, html_extract, lang_id, ranked_search, secret_scan, toxicity, url_filter
from quarry.llm.common import fold_of, table
from quarry.llm.decontaminate import find_leaks
from quarry.llm.fingerprint import fingerprints
from quarry.llm.near_dedup import near_groups
from quarry.llm.packing import pack_documents
from quarry.llm.simhash import simhash_groups
from quarry.llm.token_counts import count_tokens


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_report(table(spark, sf_dir, "documents"))


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Network | None:
    """Learned from labelled documents outside the held-out third."""
    labels = table(spark, sf_dir, "labels").where(fold_of("doc_id", 3) != 1)
    return toxicity.learn(table(spark, sf_dir, "documents"), labels)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = {"held_out": fold_of("doc_id", 3) == 1}
    return toxicity.score(table(spark, sf_dir, "documents"), toxicity_model(spark, sf_dir), more=held_out)


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"), percent=75)


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_text(table(spark, sf_dir, "pages"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=75)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    languages, logs = lang_id.learn(docs.where(fold_of("doc_id", 5) != 0))
    return lang_id.predict(docs, languages, logs, more={"held_out": fold_of("doc_id", 5) == 0})


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), rules)


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op12_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"), radius=2)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_ALL = (
    op1_token_counts, op2_secret_scan, op3_toxicity, op4_near_dedup, op5_html_extract, op6_packing, op7_decontaminate, op8_language, op9_url_filter,
    op10_fingerprints, op11_ranked_search, op12_simhash_dedup, op13_filter_audit,
)
QUERIES = {f.__name__: f for f in _ALL}

ORACLE_SQL = {"op2_secret_scan": secret_scan.oracle(), "op9_url_filter": url_filter.oracle(), "op11_ranked_search": ranked_search.oracle(), "op13_filter_audit": filter_audit.oracle()}
