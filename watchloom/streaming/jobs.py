"""Structured Streaming forms of the operators."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from watchloom.operators.feeds import export_judged
from watchloom.operators.normalize import flatten_data, route_event_type, table_name
from watchloom.operators.profiling import field_counts, settle_kinds
from watchloom.operators.rowprogram import judged_whole, table_of
from watchloom.operators.settings import Settings
from watchloom.sources.sinks import Ledger, fan_out

#: writers are up to about eleven minutes out of order
LATENESS = "15 minutes"
#: audit serials that a batch may use
BATCH_SERIALS = 1 << 32


def read_jsonl_stream(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """Lines of JSON-lines files with their place: ``file, block, line, raw``; ``raw`` is null where a line is no object.

    ``max_files`` per batch takes the place of a queue bound. Blank lines are left out.
    """
    lines = spark.readStream.option("maxFilesPerTrigger", max_files).text(path)
    parsed = lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("value").alias("line"), F.from_json("value", "map<string,string>").alias("raw")).filter(F.trim("line") != "")
    is_object = F.col("line").rlike(r"^\s*\{") & F.expr("try_parse_json(line) IS NOT NULL")
    return parsed.withColumn("raw", F.when(F.coalesce(is_object, F.lit(False)), F.col("raw")))


def numbered(batch: DataFrame) -> DataFrame:
    """A batch of read lines with ``row_id``: file, block and place in the batch.

    Equal lines keep ids of their own, and a replayed batch, which reads the same files, gives the same ids.
    """
    return batch.withColumn("row_id", F.concat_ws("#", "file", "block", F.monotonically_increasing_id()))


def judged_batch(batch: DataFrame, models: Sequence[str]) -> DataFrame:
    """Every line of a numbered batch, judged once: its class, the texts given to its columns, and ``reasons``, which are empty
    when its class accepts it. A line that does not parse and a record of a class that was not asked for have theirs.

    To be persisted: all that becomes of a batch is read from it.
    """
    rows = judged_whole(route_event_type(flatten_data(batch)), models)
    why = F.when(F.col("raw").isNull(), F.array(F.lit("unparsed"))).when(
        F.col("model").isin(*models), F.col("errors")).otherwise(F.array(F.lit("class")))
    model = F.when(F.col("raw").isNotNull(), F.col("model"))
    return rows.select("row_id", "line", model.alias("model"), "route_source", "route_type", "chosen", "given", why.alias("reasons"))


def refused_of(rows: DataFrame) -> DataFrame:
    """``row_id, model, line, reasons`` of all other lines."""
    return rows.filter(F.size("reasons") > 0).select("row_id", "model", "line", "reasons")


def normalised_batch(rows: DataFrame, models: Sequence[str], settings: Settings = Settings()) -> tuple[dict[str, DataFrame], DataFrame]:
    """(accepted rows of each class, everything else) of a judged batch.

    The second part, ``row_id, model, line, reasons``, has lines that do not parse, records of classes that were not
    asked for, and records their class does not accept: each row of the batch is in exactly one place.
    """
    good = rows.filter(F.size("reasons") == 0)
    return {name: table_of(good.filter(F.col("model") == name), name, settings) for name in models}, refused_of(rows)


def stream_normalise(raw: DataFrame, models: Sequence[str], accepted: Callable[[str, DataFrame, int], None],
                     quarantine: Callable[[DataFrame, int], None], checkpoint: str, settings: Settings = Settings()) -> StreamingQuery:
    """Every batch to typed tables: ``accepted(name, rows, batch id)`` and ``quarantine(rows, batch id)``, until the input
    is drained. Both should overwrite what they wrote for the same batch id."""

    def run(batch: DataFrame, batch_id: int) -> None:
        own = judged_batch(numbered(batch), models).persist()
        try:
            tables, refused = normalised_batch(own, models, settings)
            for name, table in tables.items():
                accepted(name, table, batch_id)
            quarantine(refused, batch_id)
        finally:
            own.unpersist()

    return raw.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_fanout(raw: DataFrame, models: Sequence[str], sinks: Mapping[str, Callable[[DataFrame, int], None]],
                  checkpoint: str, quarantine: Callable[[DataFrame, int], None], settings: Settings = Settings(),
                  on_failure: Callable[[int, dict], None] | None = None, ledger: Ledger | None = None) -> StreamingQuery:
    """Every batch normalised, rendered and handed to all sinks, then the query ends when the
    input is drained. Sinks get rows ``table, ts, feed, line`` and the batch id, which they can
    use to overwrite a batch that is replayed; ``quarantine`` gets what no table took.

    With a ledger a sink that fails gets its batches again, in order: before the next one, and when the stream is started
    again. Without one a batch that a sink does not take is told to ``on_failure`` and is lost to that sink.
    """
    if ledger:
        ledger.redeliver(sinks)

    def run(batch: DataFrame, batch_id: int) -> None:
        own = judged_batch(numbered(batch), models).persist()
        try:
            lines = export_judged(own.withColumnRenamed("reasons", "errors"), models, settings, first_serial=batch_id * BATCH_SERIALS)
            failed = fan_out(lines, batch_id, sinks, ledger)
            quarantine(refused_of(own), batch_id)
        finally:
            own.unpersist()
        if failed and on_failure:
            on_failure(batch_id, failed)

    return raw.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start()


def rate(df: DataFrame, ts: str, window: str, slide: str | None = None, table: str = "table") -> DataFrame:
    """Events per table and (tumbling or sliding) window; the same plan in batch and stream."""
    span = F.window(ts, window, slide) if slide else F.window(ts, window)
    return df.groupBy(span.alias("w"), table).agg(F.count("*").alias("events")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), table, "events")


def stream_rate(df: DataFrame, ts: str, window: str, slide: str | None = None, table: str = "table",
                lateness: str = LATENESS) -> DataFrame:
    return rate(df.withWatermark(ts, lateness), ts, window, slide, table)


def stream_rate_table(df: DataFrame, ts: str, window: str, path: str, checkpoint: str, slide: str | None = None,
                      table: str = "table", lateness: str = LATENESS) -> StreamingQuery:
    """The windowed rate as a table that grows with the stream: a batch writes only the windows it changed, as an
    update numbered by the batch, and windows that the watermark has passed leave the state."""
    changed = stream_rate(df, ts, window, slide, table, lateness)
    return changed.writeStream.outputMode("update").foreachBatch(
        lambda batch, i: batch.write.mode("overwrite").parquet(f"{path}/batch={i}")).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rate_table(spark: SparkSession, path: str, table: str = "table") -> DataFrame:
    """The last update of every window."""
    return spark.read.parquet(path).groupBy("window_start", "window_end", table).agg(F.max_by("events", "batch").alias("events"))


def stream_aside(df: DataFrame, ts: str, keep: Callable[[DataFrame, int], None], aside: Callable[[DataFrame, int], None],
                 path: str, checkpoint: str, lateness: str = LATENESS, shed: Column | None = None) -> StreamingQuery:
    """Each row of a stream goes to ``keep`` or, with a reason, to ``aside``: ``late`` when it lies further behind the latest
    time of the earlier batches than the lateness allows, ``shed`` when the condition says so.

    The latest time is written by batch, and a replayed batch starts from that of the batch before it, so it is split the
    same way. A row without a time is kept. Both functions should overwrite what they wrote for the same batch id.
    """
    spark = df.sparkSession

    def run(batch: DataFrame, batch_id: int) -> None:
        rows = batch.persist()
        try:
            seen = spark.read.schema("at timestamp").parquet(f"{path}/batch={batch_id - 1}").first()["at"] if batch_id else None
            edge = F.lit(seen).cast("timestamp") - F.expr(f"INTERVAL {lateness}")
            late = F.coalesce(F.col(ts) < edge, F.lit(False))
            reason = F.when(late, "late")
            if shed is not None:
                reason = reason.when(F.coalesce(shed, F.lit(False)), "shed")
            marked = rows.withColumn("reason", reason)
            keep(marked.filter("reason IS NULL").drop("reason"), batch_id)
            aside(marked.filter("reason IS NOT NULL"), batch_id)
            rows.agg(F.greatest(F.max(ts).cast("timestamp"), F.lit(seen).cast("timestamp")).alias("at")).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        finally:
            rows.unpersist()

    return df.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_dedup(df: DataFrame, key: str, ts: str, lateness: str = LATENESS) -> DataFrame:
    """First row per id within the lateness bound; state older than that is let go."""
    return df.withWatermark(ts, lateness).dropDuplicatesWithinWatermark([key])


class LateRows(StreamingQueryListener):
    """Counts the rows that watermarks drop, over whole runs: ``add`` it to a session before its queries start.

    A query's own list of progress keeps only the last updates; a listener sees every one.
    """

    def __init__(self) -> None:
        self.by_run: dict[str, int] = {}

    def add(self, spark: SparkSession) -> LateRows:
        self.spark = spark
        spark.streams.addListener(self)
        return self

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.by_run.setdefault(str(event.runId), 0)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        dropped = sum(op.numRowsDroppedByWatermark for op in event.progress.stateOperators)
        run = str(event.progress.runId)
        self.by_run[run] = self.by_run.get(run, 0) + dropped

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def of(self, query: StreamingQuery) -> int:
        """Rows dropped so far in a query's run; events still on their way are waited for."""
        self.spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        return self.by_run.get(str(query.runId), 0)


def observed(df: DataFrame, name: str, shed: Column | None = None) -> DataFrame:
    """Count rows (and those a condition would shed) as the stream runs, without another pass."""
    counters = [F.count(F.lit(1)).alias("rows")]
    if shed is not None:
        counters.append(F.count_if(shed).alias("shed"))
    return df.observe(name, *counters)


def run_to_completion(query: StreamingQuery, deadline_s: float | None = None) -> bool:
    """Wait until the input is drained; at the deadline stop the query. True when it drained."""
    done = query.awaitTermination(deadline_s) if deadline_s else (query.awaitTermination() or True)
    if not done:
        query.stop()
    return bool(done)


def stream_profile(long: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Profile counts that grow with every batch. A batch only writes its own counts, as a version numbered by the
    batch, so a replayed batch replaces itself instead of counting twice; ``stored_profile`` merges them."""

    def add(batch: DataFrame, batch_id: int) -> None:
        settle_kinds(field_counts(batch)).write.mode("overwrite").parquet(f"{path}/version={batch_id}")

    return long.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start()


def routed_counts(raw: DataFrame) -> DataFrame:
    """Records per class and table of a (streaming or static) raw input."""
    routed = route_event_type(flatten_data(raw))
    table = table_name(F.col("route_type"), F.col("route_source"))
    return routed.groupBy("model", table.alias("table")).agg(F.count("*").alias("records"))
