"""Registered queries of the dealt operators: production parameters, whole tables, digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchloom.llm import (
    alignment, cap_links, fingerprints, language, lm, mixing, near_dups, pieces, prefix_trie, suffixes, token_counts, token_files, toxicity)
from watchloom.llm.common import fold

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir).select("doc_id", "text"))


@query
def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip_digests(documents(spark, sf_dir).select("doc_id", "text"))


@query
def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_files.write_token_files(documents(spark, sf_dir).select("doc_id", "text"))
    return token_files.read_token_files(spark, path)


@query
def op1_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(documents(spark, sf_dir).select("doc_id", "text"), fold("doc_id", 5) == 1)


@query
def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    network = language.fit(docs, fold("doc_id", 5) != 0)
    return language.identify(docs.select("doc_id", "text"), network).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


@query
def op5_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cap_links.link(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", mixing.label_domain().alias("domain"))
    return mixing.rates(documents(spark, sf_dir).select("doc_id", "text"), labels)


ORACLES["op6_mixing"] = mixing.oracle()


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), fold("doc_id", 3) != 1)
    return toxicity.score(docs, model).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


@query
def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint(documents(spark, sf_dir).select("doc_id", "text"))


@query
def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))


@query
def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.linked_counts(documents(spark, sf_dir).select("doc_id", "text"))


@query
def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.contamination(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLES["op12_decontamination"] = suffixes.ORACLE


@query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLES["op13_prefix_trie"] = prefix_trie.ORACLE
