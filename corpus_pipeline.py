"""From raw documents to training token ids: five stages, each one of the library's operators.

toxicity drops documents scored as toxic; language drops texts without a recognised language; near_dedup keeps one document of
each near-duplicate class; mixing repeats or drops documents so that domain totals match the targets; encode gives ids and the
decoded text. All stages but the last return the columns of documents. Null texts count as empty: toxicity keeps them unless
the model finds them toxic, and language drops them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchloom.llm import language, mixing, near_dups, pieces, toxicity
from watchloom.llm.common import fold, written

#: A text whose best language has a lower share than this is rejected.
LEAST_LANGUAGE = 0.3
#: Shares of all words after the toxic documents are gone.
TARGETS = {"good": 0.85, "low": 0.15}


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under the operator's threshold."""
    model = toxicity.fit(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"), fold("doc_id", 3) != 1)
    return toxicity.score(docs, model, drop_text=False).where("predicted = 0").select(*docs.columns)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language."""
    network = language.fit(docs.select("doc_id", "text", "lang"), fold("doc_id", 5) != 0)
    found = language.identify(docs, network, drop_text=False)
    return found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: the one with the least id."""
    return near_dups.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the rates say that bring the domains to their target weights."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", mixing.label_domain().alias("domain"))
    return mixing.mixed(docs, labels, TARGETS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids with begin and end, and the text decoded from them."""
    return pieces.encode_and_decode(docs.select("doc_id", "text"))


STAGES = [("toxicity", drop_toxic), ("language", keep_languages), ("near_dedup", near_dedup), ("mixing", mix_sources), ("encode", encode)]
#: The models of the first stages cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
