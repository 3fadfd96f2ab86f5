"""Readers of authoring documents, corpora and exported feeds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from watchloom.sources.splits import read_csv_records, read_json_array  # noqa: F401 - readers too

STAGES = "array<struct<name:string,delay:double,events:array<map<string,string>>>>"
PROFILE = (
    "struct<table:string,record_count:bigint,sources:map<string,bigint>,mined_at:string,"
    "fields:map<string,struct<kind:string,n:bigint,"
    "values:array<struct<value:string,count:bigint,weight:double>>,"
    "shapes:array<struct<shape:string,count:bigint,weight:double>>>>>"
)


def _file_stem() -> Column:
    return F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1)


def read_scenario_documents(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """One row per scenario file: its name and its array of stages (null when it does not parse)."""
    docs = spark.read.text(paths, wholetext=True)
    return docs.select(
        F.input_file_name().alias("path"), _file_stem().alias("scenario"),
        F.from_json("value", STAGES).alias("stages"))


def read_scenarios(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """One row per (scenario, stage, event template) with the raw record; order is kept in
    ``scenario_idx, stage_idx, event_idx``. Scenarios follow the order of the paths given."""
    listed = [paths] if isinstance(paths, str) else list(paths)
    docs = None
    for i, path in enumerate(listed):
        one = read_scenario_documents(spark, path).withColumn("scenario_idx", F.lit(i))
        docs = one if docs is None else docs.unionByName(one)
    stages = docs.select("scenario_idx", "scenario", F.posexplode("stages").alias("stage_idx", "stage"))
    return stages.select(
        "scenario_idx", "scenario", "stage_idx", F.col("stage.name").alias("stage_name"),
        F.coalesce("stage.delay", F.lit(1.0)).alias("delay"),
        F.posexplode("stage.events").alias("event_idx", "raw"),
    ).withColumn("multiply", F.coalesce(F.col("raw")["multiply"].try_cast("int"), F.lit(1)))


def read_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Text lines with their file, 1-based line number and ``seq``, the 0-based place over all files; blank lines included.

    Files follow the order of their paths. Spark reads splits in an order of its own (large files first), so both
    numbers come from the row's place in its input split plus the lines of the earlier splits: one summary row
    per split, no window over the lines.
    """
    lines = spark.read.text(path).select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    splits = lines.groupBy("file", "_block").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = lambda window: F.coalesce(
        F.sum("_n").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select(
        "file", "_block", "_first", before(Window.orderBy("file", "_block")).alias("_all"),
        before(Window.partitionBy("file").orderBy("_block")).alias("_own"))
    place = F.col("_at") - F.col("_first")
    return lines.join(splits, ["file", "_block"]).select(
        "line", "file", (F.col("_all") + place).alias("seq"), (F.col("_own") + place + 1).alias("line_no"))


def read_jsonl(spark: SparkSession, path: str | Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(records, bad lines with file and line number); blank lines are neither."""
    lines = read_lines(spark, path).filter(F.trim("line") != "")
    parsed = lines.withColumn("raw", F.from_json("line", "map<string,string>"))
    is_object = F.col("raw").isNotNull() & F.col("line").rlike(r"^\s*\{") & F.expr(
        "try_parse_json(line) IS NOT NULL")
    good = parsed.filter(is_object).select("file", "line_no", F.col("seq").alias("row_id"), "raw", "line")
    bad = parsed.filter(~F.coalesce(is_object, F.lit(False))).select("file", "line_no", "line")
    return good, bad


def read_winevent_json(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Exported Windows records, unwrapped: provider, event id text and the event as JSON."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    event = F.coalesce(F.get_json_object("value", "$.Event"), F.col("value"))
    return lines.select(event.alias("event")).select(
        F.get_json_object("event", "$.System.Provider['#attributes'].Name").alias("provider"),
        F.get_json_object("event", "$.System.EventID").alias("event_id_text"),
        "event")


def read_profile(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(profile rows, source tallies) of every profile document, also of those that ``write_profile_documents`` wrote;
    unreadable files are skipped and a document without a table takes its file's name."""
    docs = spark.read.text(path, wholetext=True, pathGlobFilter="{*.json,part-*}").select(
        _file_stem().alias("stem"), F.from_json("value", PROFILE).alias("p")
    ).filter(F.col("p.fields").isNotNull())
    docs = docs.select(F.coalesce("p.table", "stem").alias("table"), "p")
    fields = docs.select("table", F.explode("p.fields").alias("field", "f"))
    item = lambda kind, array, name: fields.select(
        "table", "field", F.col("f.kind").alias("kind"), F.col("f.n").alias("n"),
        F.posexplode(f"f.{array}").alias("pos", "x")
    ).select("table", "field", "kind", F.col(f"x.{name}").alias("item"), "x.count", "x.weight",
             (F.col("pos") + 1).alias("rank"), "n")
    rows = item("freeform", "values", "value").unionByName(item("identifier", "shapes", "shape"))
    tallies = docs.select("table", F.explode("p.sources").alias("source", "records"))
    return rows, tallies


def read_feed_text(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Lines of an exported feed, for checks."""
    return spark.read.text(path).select(F.col("value").alias("line"), F.input_file_name().alias("file"))
