"""Writers of tables, feeds, profiles and ingestion arrays."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from watchloom.operators.ordered import last_known
from watchloom.operators.profiling import merge_profiles, profile_fields, settle_kinds, shape_pool, value_pool
from watchloom.session import materialise

log = logging.getLogger(__name__)

VENDOR_FEEDS = ("fortinet", "cisco_asa", "okta")


def write_tables(lines: DataFrame, path: str, max_records: int | None = None, mode: str = "append", compression: str | None = None) -> None:
    """One JSON-lines dataset per table from rows ``table, line`` (the JSON feed).

    Rows are gathered by table first (a large table in several parts), so a task opens few files.
    """
    _bounded(lines.select("table", F.col("line").alias("value")).hint("rebalance", "table"), max_records, compression).mode(mode).partitionBy(
        "table").text(path)


def write_unified(lines: DataFrame, path: str, max_records: int | None = None, mode: str = "append", compression: str | None = None) -> None:
    """The same rows as one feed."""
    _bounded(lines.select(F.col("line").alias("value")), max_records, compression).mode(mode).text(path)


def write_feed(lines: DataFrame, path: str, max_records: int | None = None, mode: str = "append", compression: str | None = None) -> None:
    """Line feeds from rows ``feed, line``. A line with a line break in it would become two records: it goes to the
    feed ``unwritable`` beside the others, as a JSON text with its feed, and the rest is written."""
    broken = F.col("line").rlike("[\r\n]")
    named = F.when(broken, F.lit("unwritable")).otherwise(F.col("feed"))
    value = F.when(broken, F.to_json(F.struct("feed", "line"))).otherwise(F.col("line"))
    placed = lines.select(named.alias("feed"), value.alias("value")).hint("rebalance", "feed")
    _bounded(placed, max_records, compression).mode(mode).partitionBy("feed").text(path)


def write_vendor_feeds(lines: DataFrame, path: str, max_records: int | None = None, mode: str = "append", compression: str | None = None) -> None:
    """Only rows with a vendor rendering, one dataset per vendor."""
    write_feed(lines.filter(F.col("feed").isin(*VENDOR_FEEDS)), path, max_records, mode, compression)


def _bounded(df: DataFrame, max_records: int | None, compression: str | None = None):
    """A writer whose files hold at most so many records (no bound for historical windows), plain or with a codec of Hadoop."""
    writer = df.write.option("compression", compression) if compression else df.write
    return writer.option("maxRecordsPerFile", max_records) if max_records else writer


def bounded_files(lines: DataFrame, path: str, max_bytes: int, mode: str = "append") -> None:
    """Text files of at most about ``max_bytes`` each (a longer line is a file of its own).

    Rows of each written partition are cut by their running size, and a cut is a folder ``part=...``.
    """
    size = F.octet_length("line") + 1
    placed = lines.select("line").withColumn("_pid", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    placed = materialise(placed)
    before = Window.partitionBy("_pid").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    cut = F.floor(F.coalesce(F.sum(size).over(before), F.lit(0)) / max_bytes).cast("bigint")
    rows = placed.withColumn("part", F.concat_ws("-", "_pid", cut)).repartition("part").sortWithinPartitions("part", "_at")
    rows.select(F.col("line").alias("value"), "part").write.mode(mode).partitionBy("part").text(path)


def retained_files(spark: SparkSession, path: str, keep: int, glob: str = "*") -> DataFrame:
    """Files per folder, newest first, and whether retention keeps them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option(
        "recursiveFileLookup", "true").load(path).select("path", "modificationTime", "length")
    folder = F.regexp_replace("path", "/[^/]+$", "")
    newest = Window.partitionBy("folder").orderBy(F.desc("modificationTime"), F.desc("path"))
    return files.withColumn("folder", folder).withColumn("age_rank", F.row_number().over(newest)).withColumn(
        "keep", F.col("age_rank") <= keep)


def apply_retention(spark: SparkSession, path: str, keep: int, glob: str = "*") -> int:
    """Remove the files that retention does not keep, through Hadoop's file system; gives their number.

    File names are a listing, small next to what the files hold.
    """
    old = [r["path"] for r in retained_files(spark, path, keep, glob).filter("NOT keep").select("path").collect()]
    for name in old:
        _remove(spark, name)
    return len(old)


def sort_lines(lines: DataFrame, key_field: str = "TimeGenerated", line: str = "line", seq: str = "seq") -> DataFrame:
    """JSON lines with their sort key: the record's time, for a line without one that of the line
    before it. Blank lines are left out; order is by (key, arrival)."""
    rows = lines.filter(F.trim(line) != "").withColumn(
        "sort_key", F.nullif(F.get_json_object(line, f"$.{key_field}"), F.lit("")))
    keyed = last_known(rows, seq, "sort_key", "_k")
    return keyed.withColumn("sort_key", F.coalesce("_k", F.lit(""))).drop("_k")


def write_sorted(lines: DataFrame, path: str, seq: str = "seq", mode: str = "overwrite") -> None:
    """A feed rewritten in time order, ties in order of arrival; the files in name order are the
    sorted feed."""
    ordered = sort_lines(lines, seq=seq).orderBy("sort_key", seq)
    ordered.select(F.col("line").alias("value")).write.mode(mode).text(path)


def to_ingestion_arrays(lines: DataFrame, max_rows: int = 10_000, max_bytes: int = 1_000_000,
                        seq: str = "seq", line: str = "line") -> DataFrame:
    """JSON lines to JSON arrays of bounded size: ``batch, part, rows, body``.

    Rows are cut into serial ranges of ``max_rows`` and those, by running size, into parts of
    about ``max_bytes``; no array depends on how many rows there are in all. Lines that do not
    parse are left out.
    """
    good = lines.filter(F.expr(f"try_parse_json({line}) IS NOT NULL"))
    cut = good.withColumn("batch", F.floor(F.col(seq) / max_rows).cast("bigint"))
    before = Window.partitionBy("batch").orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    size = F.coalesce(F.sum(F.octet_length(line) + 1).over(before), F.lit(0))
    parts = cut.withColumn("part", F.floor(size / max_bytes).cast("int"))
    return parts.groupBy("batch", "part").agg(
        F.count("*").alias("rows"),
        F.transform(F.sort_array(F.collect_list(F.struct(seq, line))), lambda r: r[line]).alias("_lines"),
    ).select("batch", "part", "rows", F.concat(F.lit("["), F.array_join("_lines", ","), F.lit("]")).alias("body"))


def ingestible_files(paths: DataFrame, path: str = "path") -> DataFrame:
    """Files of a folder run: what was already converted and the unified feed are left out."""
    name = F.regexp_extract(path, r"([^/]+)$", 1)
    return paths.filter(~name.endswith("_array.json") & ~name.startswith("unified"))


def write_profile(counts: DataFrame, path: str, version: int) -> DataFrame:
    """Add counts to the stored profile under a version of their own and give all that is stored, merged.

    Only the new counts are written; a version that is written again replaces itself. Counts are settled first,
    so a field that holds an identity keeps shapes only, in the store too.
    """
    settle_kinds(counts).write.mode("overwrite").parquet(f"{path}/version={version}")
    return stored_profile(counts.sparkSession, path)


def stored_profile(spark: SparkSession, path: str) -> DataFrame:
    """All versions of a stored profile, merged and settled."""
    return settle_kinds(merge_profiles(spark.read.parquet(path).drop("version")))


def compact_profile(spark: SparkSession, path: str, target: str) -> DataFrame:
    """The stored versions merged into version 0 of another folder."""
    return write_profile(stored_profile(spark, path), target, 0)


def write_profile_documents(counts: DataFrame, tallies: DataFrame, path: str, mined_at: str) -> None:
    """One JSON document per table, as ``read_profile`` reads them: pools of its fields, records and sources.

    ``counts`` as stored; ``tallies``: ``table, source, records``. A document holds pools of bounded size.
    """
    values = value_pool(counts).select("table", "field", "rank", F.struct("value", "count", "weight").alias("v"))
    shapes = shape_pool(counts).select("table", "field", "rank", F.struct("shape", "count", "weight").alias("s"))
    ordered = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("rank", c))), lambda x: x[c])
    fields = profile_fields(counts).select("table", "field", "kind", "n").join(
        values.groupBy("table", "field").agg(ordered("v").alias("values")), ["table", "field"], "left").join(
        shapes.groupBy("table", "field").agg(ordered("s").alias("shapes")), ["table", "field"], "left")
    whole = fields.groupBy("table").agg(F.map_from_entries(F.sort_array(F.collect_list(
        F.struct("field", F.struct("kind", "n", "values", "shapes"))))).alias("fields"))
    sources = tallies.groupBy("table").agg(
        F.sum("records").alias("record_count"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("source", "records")))).alias("sources"))
    document = F.to_json(F.struct("table", "record_count", "sources", F.lit(mined_at).alias("mined_at"), "fields"))
    lines = whole.join(sources, "table", "left").select("table", document.alias("value"))
    lines.repartition("table").write.mode("overwrite").partitionBy("table").text(path)


Sinks = Mapping[str, Callable[[DataFrame, int], None]]


class Ledger:
    """What sinks still have to get: a table of (sink, batch, attempt, state) and the rows of the batches it names.

    Only deliveries that fail are written down, and then how they go on; the last attempt of a sink and batch counts. A
    batch's rows are kept until every sink has them. One writer at a time.
    """

    SCHEMA = "sink string, batch long, attempt int, state string, error string"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _note(self, sink: str, batch_id: int, attempt: int, state: str, error: str | None = None) -> None:
        row = self.spark.createDataFrame([(sink, batch_id, attempt, state, error)], self.SCHEMA)
        row.coalesce(1).write.mode("append").json(f"{self.path}/notes")

    def states(self) -> DataFrame:
        """The last state of each delivery that failed at least once: sink, batch, attempt, state, error."""
        if not _exists(self.spark, f"{self.path}/notes"):
            return self.spark.createDataFrame([], self.SCHEMA)
        notes = self.spark.read.schema(self.SCHEMA).json(f"{self.path}/notes")
        return notes.groupBy("sink", "batch").agg(F.max_by(F.struct("attempt", "state", "error"), "attempt").alias("last")).select(
            "sink", "batch", "last.*")

    def open(self) -> list:
        """Deliveries that are due, oldest batch first. As many rows as there are undelivered batches."""
        return self.states().filter("state = 'failed'").orderBy("batch", "sink").collect()

    def hold(self, rows: DataFrame, batch_id: int, failed: Mapping[str, str]) -> None:
        """Keep a batch for the sinks that did not take it. The rows are written before the notes."""
        rows.write.mode("overwrite").parquet(f"{self.path}/rows/batch={batch_id}")
        for sink, error in failed.items():
            self._note(sink, batch_id, 1, "failed", error)

    def redeliver(self, sinks: Sinks) -> set[str]:
        """Hand every batch that is due to its sink again; gives the sinks that still fail. A sink gets its batches in order."""
        due = self.open()
        down: set[str] = set()
        for r in due:
            if r["sink"] in down or r["sink"] not in sinks:
                down.add(r["sink"])
                continue
            try:
                sinks[r["sink"]](self.spark.read.parquet(f"{self.path}/rows/batch={r['batch']}"), r["batch"])
                self._note(r["sink"], r["batch"], r["attempt"] + 1, "delivered")
            except Exception as error:  # noqa: BLE001 - one sink must not stop the rest
                down.add(r["sink"])
                self._note(r["sink"], r["batch"], r["attempt"] + 1, "failed", str(error))
                log.warning("sink %s failed again on batch %s: %s", r["sink"], r["batch"], error)
        left = {r["batch"] for r in due if r["sink"] in down}
        for batch_id in {r["batch"] for r in due} - left:
            _remove(self.spark, f"{self.path}/rows/batch={batch_id}")
        return down


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _exists(spark: SparkSession, path: str) -> bool:
    system, target = _file_system(spark, path)
    return system.exists(target)


def _remove(spark: SparkSession, path: str) -> None:
    system, target = _file_system(spark, path)
    system.delete(target, True)


def fan_out(batch: DataFrame, batch_id: int, sinks: Sinks, ledger: Ledger | None = None) -> dict[str, str]:
    """Hand one batch to every sink. A sink that fails does not keep the others from theirs;
    what failed is returned by sink name.

    With a ledger, batches that are due come first, a sink that is still down does not get the new one out of turn, and
    what a sink did not take is kept for it.
    """
    failed: dict[str, str] = {}
    cached = batch.persist()
    try:
        down = ledger.redeliver(sinks) if ledger else set()
        for name, sink in sinks.items():
            if name in down:
                failed[name] = "an earlier batch is still due"
                continue
            try:
                sink(cached, batch_id)
            except Exception as error:  # noqa: BLE001 - one sink must not stop the rest
                failed[name] = str(error)
                log.warning("sink %s failed on batch %s: %s", name, batch_id, error)
        if failed and ledger:
            ledger.hold(cached, batch_id, failed)
    finally:
        cached.unpersist()
    return failed
