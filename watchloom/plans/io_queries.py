"""Sources, sinks and streams over the given tables.

Each query writes to a new folder below the shared checkpoint folder and reads it back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchloom.operators import profiling as P
from watchloom.operators.sequence import time_inversions
from watchloom.plans.feed_queries import SQL_LINES, all_lines
from watchloom.plans.function_queries import SQL_CLASS, SQL_WORDS, words
from watchloom.plans.inputs import EV, load, raw_events, sql_table_of
from watchloom.plans.normalize_queries import RUN, SQL_MODEL
from watchloom.plans.registry import query
from watchloom.session import checkpoint_dir
from watchloom.sources import readers, sinks
from watchloom.streaming import jobs


def scratch(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/run-{uuid.uuid4()}"


_OK = "(event_type = 'error' OR (event_type = 'view' AND NOT (k % 3 = 0 AND k % 11 = 0)))"


@query(SQL_LINES + """
SELECT 'table' AS kind, t AS name, count(*) AS lines FROM f WHERE feed = 'json' GROUP BY 2
UNION ALL SELECT 'unified', 'all', count(*) FROM f WHERE feed = 'json'
UNION ALL SELECT CASE WHEN feed IN ('okta', 'fortinet', 'cisco_asa') THEN 'vendor' ELSE 'feed' END, feed, count(*) FROM f WHERE feed <> 'json' GROUP BY 1, 2""")
def written_feeds(spark, sf):
    """Tables, the unified feed, line feeds and vendor feeds of all classes, written from one cached pass and read back."""
    path, lines = scratch(spark), all_lines(spark, sf).persist()
    try:
        json = lines.filter("feed = 'json'")
        sinks.write_tables(json, f"{path}/tables", max_records=5000, compression="gzip")
        sinks.write_unified(json, f"{path}/unified", compression="gzip")
        sinks.write_feed(lines.filter("feed IN ('cef', 'syslog', 'winxml', 'auditd')"), f"{path}/feeds", compression="gzip")
        sinks.write_vendor_feeds(lines, f"{path}/vendors", compression="gzip")
    finally:
        lines.unpersist()

    def count(kind, folder, key):
        rows = spark.read.text(f"{path}/{folder}")
        name = F.col(key) if key else F.lit("all")
        return rows.groupBy(F.lit(kind).alias("kind"), name.alias("name")).agg(F.count("*").alias("lines"))

    return count("table", "tables", "table").unionByName(count("unified", "unified", None)).unionByName(
        count("feed", "feeds", "feed")).unionByName(count("vendor", "vendors", "feed"))


@query("SELECT count(*) AS records, 0::BIGINT AS inversions, count(*) FILTER (event_id % 50 = 7) AS unreadable FROM events WHERE event_id % 50 <> 8")
def sorted_feed_file(spark, sf):
    """A disordered feed with unreadable and blank lines, rewritten in time order and read back."""
    path = scratch(spark)
    step = F.expr("CASE WHEN event_id % 9 = 4 THEN INTERVAL 11 MINUTES ELSE INTERVAL 0 MINUTES END")
    stamp = F.date_format(F.col("ts") - step, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    record = F.to_json(F.struct(stamp.alias("TimeGenerated"), "event_id"))
    line = F.when(F.col("event_id") % 50 == 7, "not json").when(F.col("event_id") % 50 == 8, " ").otherwise(record)
    sinks.write_sorted(load(spark, sf, "events").select(F.col("event_id").alias("seq"), line.alias("line")), path)
    back = readers.read_lines(spark, path).withColumn(
        "at", F.get_json_object("line", "$.TimeGenerated").try_cast("timestamp"))
    stamped = back.filter("at IS NOT NULL")
    ordered = time_inversions(stamped, "seq", "at").select("inversions")
    totals = back.agg(F.count("*").alias("records"), F.count_if(F.col("line") == "not json").alias("unreadable"))
    both = totals.unionByName(ordered, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in ("records", "inversions", "unreadable")])


@query("""
SELECT event_id // 1000 AS batch, count(*) AS rows, count(*) AS parsed FROM events WHERE event_id % 50 <> 7 GROUP BY 1""")
def ingestion_arrays(spark, sf):
    """JSON lines as bounded arrays; an unreadable line is left out."""
    line = F.when(F.col("event_id") % 50 == 7, "{broken").otherwise(F.to_json(F.struct("event_id", "event_type")))
    arrays = sinks.to_ingestion_arrays(
        load(spark, sf, "events").select(F.col("event_id").alias("seq"), line.alias("line")), 1000, 16_000)
    return arrays.groupBy("batch").agg(
        F.sum("rows").alias("rows"), F.sum(F.json_array_length("body")).cast("bigint").alias("parsed"))


@query("""
SELECT event_id, event_type AS kind FROM events WHERE event_id % 50 NOT IN (7, 8)
UNION ALL SELECT event_id, 'bad' FROM events WHERE event_id % 50 = 7""")
def json_line_records(spark, sf):
    """Records and reported bad lines of a JSON-lines folder; blank lines are neither."""
    path = scratch(spark)
    line = F.expr("CASE WHEN event_id % 50 = 7 THEN concat('oops ', event_id) WHEN event_id % 50 = 8 THEN '' "
                  "ELSE to_json(struct(event_id, event_type)) END")
    load(spark, sf, "events").select(line.alias("value")).write.text(path)
    good, bad = readers.read_jsonl(spark, path)
    a = good.select(F.col("raw")["event_id"].cast("bigint").alias("event_id"), F.col("raw")["event_type"].alias("kind"))
    b = bad.select(F.regexp_extract("line", "([0-9]+)", 1).cast("bigint").alias("event_id"), F.lit("bad").alias("kind"))
    return a.unionByName(b)


@query("SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus, o_orderpriority FROM orders")
def csv_records(spark, sf):
    path = scratch(spark)
    load(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority").write.csv(path, header=True)
    return readers.read_csv_records(spark, path)


_SQL_PROFILE = f"""
WITH w AS (SELECT lang, t, {SQL_CLASS} AS c FROM {SQL_WORDS} WHERE t <> '')
SELECT lang AS "table", CAST(count(*) AS BIGINT) AS n FROM w GROUP BY 1"""


@query(_SQL_PROFILE)
def stored_profiles(spark, sf):
    """Two runs merged into one stored profile hold all observations."""
    path = scratch(spark)
    long = words(spark, sf).select(
        F.col("lang").alias("table"), F.lit("note").alias("path"), F.col("t").alias("value"), (F.col("doc_id") % 2).alias("half"))
    for version in (0, 1):
        stored = sinks.write_profile(P.field_counts(long.filter(F.col("half") == version), kind=None), path, version)
    return stored.groupBy("table").agg(F.sum("count").alias("n"))


# --- streams ------------------------------------------------------------------------------

def _events(spark, sf) -> DataFrame:
    return load(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.expr(sql_table_of()).alias("table"))


def _event_stream(spark, sf) -> DataFrame:
    schema = load(spark, sf, "events").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf}/events.parque[t]")
    table = F.expr(sql_table_of())
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("table", table)


def _by_quarters(spark, sf, path):
    """The events written one quarter of their time after the other; ``run(i)`` gets its turn behind each."""
    rows = _events(spark, sf)
    cuts = rows.select(F.percentile_approx(F.unix_micros("ts"), F.array(*[F.lit(q) for q in (0.25, 0.5, 0.75)]), F.lit(1000)).alias("c")).first()["c"] or []
    bounds = [None, *sorted(set(cuts)), None]
    for i, (low, high) in enumerate(zip(bounds, bounds[1:])):
        own = rows
        if low is not None:
            own = own.filter(F.unix_micros("ts") >= low)
        if high is not None:
            own = own.filter(F.unix_micros("ts") < high)
        own.write.parquet(f"{path}/in/part={i}")
        yield spark.readStream.schema(rows.schema).parquet(f"{path}/in/*")


def _rate_of_quarters(spark, sf, slide=None):
    path = scratch(spark)
    for stream in _by_quarters(spark, sf, path):
        # the same checkpoint each time: every quarter is a batch of its own, on all tasks
        jobs.run_to_completion(jobs.stream_rate_table(stream, "ts", "1 hour", f"{path}/out", f"{path}/state", slide))
    return jobs.rate_table(spark, f"{path}/out").select(F.unix_micros("window_start").alias("from_us"), "table", "events")


@query(f"""
SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS from_us, {sql_table_of()} AS "table", count(*) AS events FROM events GROUP BY 1, 2""")
def streamed_hourly_rate(spark, sf):
    """The windowed rate of a stream of several batches, by updates, equals that of the same rows in batch."""
    return _rate_of_quarters(spark, sf)


@query(f"""
SELECT epoch_us(time_bucket(INTERVAL 15 MINUTE, ts)) - n * 900000000 AS from_us, {sql_table_of()} AS "table", count(*) AS events FROM events, range(4) t(n) GROUP BY 1, 2""")
def streamed_sliding_rate(spark, sf):
    """Windows of an hour that start every quarter of an hour."""
    return _rate_of_quarters(spark, sf, "15 minutes")


@query("""
WITH q AS (SELECT event_id, ts, event_id % 10 = 3 AS again FROM events), m AS (SELECT max(ts) AS top FROM events)
SELECT CAST(event_id AS VARCHAR) AS id, CASE WHEN event_id % 20 = 7 THEN 'shed' ELSE 'kept' END AS fate FROM q
UNION ALL SELECT 'again' || event_id, CASE WHEN ts < top - INTERVAL 15 MINUTE THEN 'late' WHEN event_id % 20 = 7 THEN 'shed' ELSE 'kept' END FROM q, m WHERE again""")
def streamed_rows_aside(spark, sf):
    """Events in the order of their time and then a tenth of them again: where each row of the stream went."""
    path = scratch(spark)
    write = lambda name: lambda rows, i: rows.write.mode("overwrite").parquet(f"{path}/{name}/batch={i}")
    shed = F.col("event_id") % 20 == 7

    def run(stream):
        named = stream.select("event_id", "ts", F.concat(F.when(F.col("again"), "again").otherwise(""), F.col("event_id")).alias("id"))
        jobs.run_to_completion(jobs.stream_aside(named, "ts", write("kept"), write("aside"), f"{path}/seen", f"{path}/state", shed=shed))

    for stream in _by_quarters(spark, sf, path):
        run(stream.withColumn("again", F.lit(False)))
    rows = _events(spark, sf)
    rows.filter("event_id % 10 = 3").write.parquet(f"{path}/in/part=again")
    run(spark.readStream.schema(rows.schema).parquet(f"{path}/in/*").withColumn("again", F.lit(True)))
    return spark.read.parquet(f"{path}/kept").select("id", F.lit("kept").alias("fate")).unionByName(
        spark.read.parquet(f"{path}/aside").select("id", F.col("reason").alias("fate")))


@query("SELECT event_id FROM events")
def streamed_dedup(spark, sf):
    """Every event delivered twice, kept once."""
    path = scratch(spark)
    both = _event_stream(spark, sf).select("event_id", "ts")
    once = jobs.stream_dedup(both.unionByName(_event_stream(spark, sf).select("event_id", "ts")), "event_id", "ts")
    run = once.writeStream.format("parquet").option("path", f"{path}/out").option(
        "checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    jobs.run_to_completion(run)
    return spark.read.parquet(f"{path}/out").select("event_id")


@query(f"""
WITH {EV} SELECT CASE WHEN k % 2 = 0 THEN '50126' ELSE '0' END AS result_type, count(*) AS n FROM ev
WHERE event_type = 'view' AND NOT (k % 3 = 0 AND k % 11 = 0) GROUP BY 1""")
def streamed_signins(spark, sf):
    """Raw JSON lines normalised on the stream."""
    path = scratch(spark)
    raw_events(spark, sf).select(F.to_json("raw", {"ignoreNullFields": "false"}).alias("value")).write.text(f"{path}/in")

    def accepted(name, rows, i):
        rows.select("result_type").write.mode("overwrite").parquet(f"{path}/out/{name}/batch={i}")

    def quarantine(rows, i):
        rows.write.mode("overwrite").parquet(f"{path}/refused/batch={i}")

    jobs.run_to_completion(jobs.stream_normalise(
        jobs.read_jsonl_stream(spark, f"{path}/in", 2), ["signin"], accepted, quarantine, f"{path}/state", RUN))
    return spark.read.parquet(f"{path}/out/signin").groupBy("result_type").agg(F.count("*").alias("n"))


@query(f"""
WITH {EV}, o AS (SELECT * FROM ev WHERE {_OK})
SELECT unnest(['cef', 'json', 'syslog']) AS feed, count(*) AS lines FROM o
UNION ALL SELECT 'winxml', count(*) FROM o WHERE event_type = 'view'
UNION ALL SELECT CASE WHEN event_type = 'view' THEN 'okta' WHEN k % 3 = 0 THEN 'cisco_asa' ELSE 'fortinet' END, count(*) FROM o GROUP BY 1""")
def streamed_fan_out(spark, sf):
    """Every batch to all sinks; one of them always fails and does not hold up the others."""
    path = scratch(spark)
    raw_events(spark, sf).select(F.to_json("raw", {"ignoreNullFields": "false"}).alias("value")).write.text(f"{path}/in")

    def keep(batch, i):
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={i}")

    def broken(batch, i):
        raise RuntimeError("sink down")

    run = jobs.stream_fanout(jobs.read_jsonl_stream(spark, f"{path}/in", 2), ["firewall", "signin"], {"broken": broken, "keep": keep},
                             f"{path}/state", lambda rows, i: rows.write.mode("overwrite").parquet(f"{path}/refused/batch={i}"), RUN)
    jobs.run_to_completion(run)
    return spark.read.parquet(f"{path}/out").groupBy("feed").agg(F.count("*").alias("lines"))


@query(f"""
WITH {EV}, o AS (SELECT * FROM ev WHERE {_OK}), l AS (SELECT unnest(['cef', 'json', 'syslog']) AS feed, count(*) AS lines FROM o
  UNION ALL SELECT 'winxml', count(*) FROM o WHERE event_type = 'view'
  UNION ALL SELECT CASE WHEN event_type = 'view' THEN 'okta' WHEN k % 3 = 0 THEN 'cisco_asa' ELSE 'fortinet' END, count(*) FROM o GROUP BY 1)
SELECT sink, feed, lines FROM l, (VALUES ('steady'), ('flaky'), ('down at first')) s(sink)""")
def redelivered_batches(spark, sf):
    """One sink takes all, one fails twice, one is down for the whole first run: all end with every line once."""
    path = scratch(spark)
    raw_events(spark, sf).select(F.to_json("raw", {"ignoreNullFields": "false"}).alias("value")).write.text(f"{path}/in")
    fails = {"flaky": 2, "down at first": 10 ** 9}

    def sink(name):
        def take(batch, i):
            if fails.get(name, 0) > 0:
                fails[name] -= 1
                raise RuntimeError("sink down")
            batch.write.mode("overwrite").parquet(f"{path}/out/sink={name}/batch={i}")
        return take

    def run():
        jobs.run_to_completion(jobs.stream_fanout(
            jobs.read_jsonl_stream(spark, f"{path}/in", 3), ["firewall", "signin"], {n: sink(n) for n in ("steady", "flaky", "down at first")}, f"{path}/state",
            lambda rows, i: rows.write.mode("overwrite").parquet(f"{path}/refused/batch={i}"), RUN, ledger=sinks.Ledger(spark, f"{path}/ledger")))

    run()
    fails["down at first"] = 0
    run()
    return spark.read.parquet(f"{path}/out").groupBy("sink", "feed").agg(F.count("*").alias("lines"))


@query("""SELECT event_type AS "table", count(*) AS n FROM events GROUP BY 1""")
def streamed_profile(spark, sf):
    """Profile counts that grow with every batch of a stream."""
    path = scratch(spark)
    long = _event_stream(spark, sf).select(
        F.col("event_type").alias("table"), F.lit("props").alias("path"), F.col("props").alias("value"), F.lit("str").alias("type"))
    jobs.run_to_completion(jobs.stream_profile(long, f"{path}/out", f"{path}/state"))
    return sinks.stored_profile(spark, f"{path}/out").groupBy("table").agg(F.sum("count").alias("n"))


@query(f"""
WITH {EV}, m AS (SELECT *, {SQL_MODEL} AS model FROM ev), d AS (
  SELECT event_id, CASE WHEN event_id % 40 = 5 THEN 'unparsed' WHEN model NOT IN ('signin', 'firewall') THEN 'class ' || model
    WHEN model = 'signin' AND k % 3 = 0 AND k % 11 = 0 THEN 'null:UserPrincipalName' ELSE 'accepted ' || model END AS fate FROM m)
SELECT fate, count(*) * 2 AS lines, count(*) * 2 AS ids FROM d GROUP BY 1""")
def streamed_accounts(spark, sf):
    """Where every line of a stream of several batches went. Each record is there twice, as equal lines, and some lines do not
    parse: all are accepted or quarantined, and no two share an id."""
    path = scratch(spark)
    line = F.when(F.col("row_id") % 40 == 5, F.lit("{oops")).otherwise(F.to_json("raw", {"ignoreNullFields": "false"}))
    once = raw_events(spark, sf).select(line.alias("value"))
    once.select(F.explode(F.array("value", "value")).alias("value")).write.text(f"{path}/in")

    def accepted(name, rows, i):
        rows.select("row_id", F.lit(f"accepted {name}").alias("fate")).write.mode("overwrite").parquet(f"{path}/out/batch={i}/model={name}")

    def quarantine(rows, i):
        why = F.when(F.col("reasons")[0] == "class", F.concat(F.lit("class "), "model")).otherwise(F.array_join("reasons", ","))
        rows.select("row_id", why.alias("fate")).write.mode("overwrite").parquet(f"{path}/refused/batch={i}")

    jobs.run_to_completion(jobs.stream_normalise(
        jobs.read_jsonl_stream(spark, f"{path}/in", 3), ["signin", "firewall"], accepted, quarantine, f"{path}/state", RUN))
    rows = spark.read.parquet(f"{path}/out").select("row_id", "fate").unionByName(spark.read.parquet(f"{path}/refused").select("row_id", "fate"))
    return rows.groupBy("fate").agg(F.count("*").alias("lines"), F.count_distinct("row_id").alias("ids"))


@query(f"""
WITH t AS (SELECT {sql_table_of()} AS "table", count(*) AS lines FROM events GROUP BY 1)
SELECT "table", lines, lines AS written, true AS bounded, 3::BIGINT AS kept, true AS dropped FROM t""")
def bounded_retained_files(spark, sf):
    """Feeds in files of bounded size and of bounded records: all lines are there, no file is over its bound, and retention
    leaves the three newest files of each table."""
    path = scratch(spark)
    events = load(spark, sf, "events")
    lines = events.select(F.expr(sql_table_of()).alias("table"), F.to_json(F.struct("event_id", "event_type", "ts")).alias("line")).persist()
    try:
        sinks.bounded_files(lines, f"{path}/bytes", 50_000)
        sinks.write_tables(lines, f"{path}/records", max_records=max(1, lines.count() // 60))
        counts = lines.groupBy("table").agg(F.count("*").alias("lines")).collect()
    finally:
        lines.unpersist()
    sizes = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{path}/bytes").select("length")
    bounded = sizes.filter(F.col("length") > 50_000 + 200).isEmpty() and spark.read.text(f"{path}/bytes").count() == sum(r["lines"] for r in counts)
    written = spark.read.text(f"{path}/records").groupBy("table").agg(F.count("*").alias("written")).collect()
    removed = sinks.apply_retention(spark, f"{path}/records", 3, "part-*")
    kept = sinks.retained_files(spark, f"{path}/records", 3, "part-*").groupBy(F.regexp_extract("folder", "table=([^/]+)", 1).alias("table")).agg(F.count_if("keep").alias("kept"))
    rows = spark.createDataFrame([(r["table"], r["lines"]) for r in counts], "table string, lines long").join(
        spark.createDataFrame([(r["table"], r["written"]) for r in written], "table string, written long"), "table")
    return rows.join(kept, "table").select("table", "lines", "written", F.lit(bounded).alias("bounded"), "kept", F.lit(removed > 0).alias("dropped"))
