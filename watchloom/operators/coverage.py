"""Counts, coverage of phases and techniques, and gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def table_counts(df: DataFrame, table: str = "table") -> DataFrame:
    """Rows per table without writing anything."""
    return df.groupBy(table).agg(F.count("*").alias("records"))


def throughput(df: DataFrame, ts: str, floor: int = 20) -> DataFrame:
    """Events, elapsed seconds between the first and the last, rate, and whether the floor is met."""
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    elapsed = (F.max(us) - F.min(us)) / F.lit(1e6)
    return df.agg(F.count("*").alias("events"), F.round(elapsed, 3).alias("elapsed_s")).withColumn(
        "rate", F.round(F.when(F.col("elapsed_s") > 0, F.col("events") / F.col("elapsed_s")).otherwise(0.0), 6)
    ).withColumn("enough", F.col("events") >= floor)


def scenario_catalog(templates: DataFrame) -> DataFrame:
    """Per scenario: stages, templates, events after replication, phases and techniques."""
    return templates.groupBy("scenario").agg(
        F.countDistinct("stage_idx").alias("stages"),
        F.count("*").alias("templates"),
        F.sum("multiply").alias("events"),
        F.countDistinct("phase").alias("phases"),
        F.countDistinct("technique").alias("techniques"),
    )


def attack_coverage(df: DataFrame, tactic: str, technique: str) -> DataFrame:
    """Events by tactic and technique, with subtotals; ``level`` 0 is a pair, 1 a tactic, 3 all."""
    return df.rollup(tactic, technique).agg(
        F.grouping_id().cast("int").alias("level"), F.count("*").alias("events"))


def framework_ids(df: DataFrame) -> DataFrame:
    """Events per framework id (techniques, AI techniques, countermeasures) and phase."""
    ids = F.array(
        F.struct(F.lit("mitre").alias("framework"), F.col("mitre.technique_id").alias("id")),
        F.struct(F.lit("atlas").alias("framework"), F.col("atlas.id").alias("id")),
        F.struct(F.lit("d3fend").alias("framework"), F.col("d3fend.id").alias("id")),
        F.struct(F.lit("phase").alias("framework"), F.nullif(F.col("killchain_phase"), F.lit("")).alias("id")),
    )
    return df.select(F.inline(F.filter(ids, lambda x: x["id"].isNotNull()))).groupBy("framework", "id").agg(
        F.count("*").alias("events"))


def coverage_gaps(expected: DataFrame, observed: DataFrame, on: list[str]) -> DataFrame:
    """Expected phases, techniques or tables without a single event."""
    return expected.join(observed.select(*on).distinct(), on, "left_anti")


def table_source_matrix(df: DataFrame, table: str, source: str, sources: list[str]) -> DataFrame:
    """(table x source) counts; the sources are given, so no extra pass looks for them."""
    return df.groupBy(table).pivot(source, sources).agg(F.count(F.lit(1))).na.fill(0)


def malicious_stage_size(df: DataFrame, stage: list[str], flag: str = "is_malicious",
                         size: Column | None = None) -> DataFrame:
    """Events in all stages that contain a malicious one; the whole stage counts.
    ``exact`` counts the malicious events alone."""
    n = F.lit(1) if size is None else size
    stages = df.groupBy(*stage).agg(
        F.max(F.col(flag).cast("int")).alias("_hit"), F.sum(n).alias("_n"),
        F.sum(F.when(F.col(flag), n).otherwise(0)).alias("_bad"))
    return stages.agg(
        F.coalesce(F.sum(F.when(F.col("_hit") == 1, F.col("_n"))), F.lit(0)).cast("bigint").alias("events"),
        F.coalesce(F.sum("_bad"), F.lit(0)).cast("bigint").alias("exact"))


def record_type_counts(lines: DataFrame, line: str = "line") -> DataFrame:
    """Audit records by type, to compare one to one with an indexer."""
    kind = F.regexp_extract(line, r"^(?:node=\S+ )?type=(\S+)", 1)
    return lines.groupBy(kind.alias("record_type")).agg(F.count("*").alias("records"))


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, with how often."""
    return df.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > 1)


def uniqueness(df: DataFrame, key: str) -> DataFrame:
    """Rows, distinct keys and surplus rows, from one count per key."""
    per_key = df.groupBy(key).agg(F.count("*").alias("_n"))
    return per_key.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("records"),
        F.count(key).alias("distinct_keys"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint").alias("surplus"))
