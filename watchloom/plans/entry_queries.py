"""Queries of readers, checks and streams that need files or a run of their own.

Each writes its input from a given table to a new folder below the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from watchloom.functions.classify import tokenize_name
from watchloom.functions.hashing import uuid5
from watchloom.operators import lookup as L
from watchloom.operators import normalize as N
from watchloom.operators import profiling as P
from watchloom.operators import quality as Q
from watchloom.plans.feed_queries import linux_rows
from watchloom.plans.inputs import EV, events, load
from watchloom.plans.io_queries import scratch
from watchloom.plans.normalize_queries import RUN, accepted
from watchloom.plans.registry import query
from watchloom.operators import feeds as X
from watchloom.sources import readers, sinks
from watchloom.streaming import jobs


def _scenario(stages):
    """Rows of stages (key, place, stage) as one JSON document per key."""
    return stages.groupBy("key").agg(F.to_json(F.transform(
        F.sort_array(F.collect_list(F.struct("place", "stage"))), lambda s: s["stage"])).alias("value"))


@query("""
SELECT CAST(n_regionkey AS INT) AS scenario_idx, CAST(place - 1 AS INT) AS stage_idx,
  n_name AS stage_name, n_nationkey + 0.5::DOUBLE AS delay, CAST(e AS INT) AS event_idx, n_name || e AS name, CAST(CASE WHEN e = 0 THEN 3 ELSE 1 END AS INT) AS multiply
FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS place FROM nation), range(2) t(e)""")
def scenario_rows(spark, sf):
    """Regions play scenario documents, nations their stages; documents follow the order of the paths given."""
    path, nation = scratch(spark), load(spark, sf, "nation")
    event = lambda e: F.struct(
        F.lit("dns_query").alias("event_type"), F.concat("n_name", F.lit(e)).alias("Name"), (F.lit("3") if e == "0" else F.lit(None).cast("string")).alias("multiply"))
    stages = nation.select(F.col("n_regionkey").alias("key"), F.col("n_nationkey").alias("place"), F.struct(
        F.col("n_name").alias("name"), (F.col("n_nationkey") + 0.5).alias("delay"), F.array(event("0"), event("1")).alias("events")).alias("stage"))
    docs = _scenario(stages)
    docs.repartition("key").write.partitionBy("key").text(path)
    keys = [r["r_regionkey"] for r in load(spark, sf, "region").orderBy("r_regionkey").collect()]
    rows = readers.read_scenarios(spark, [f"{path}/key={k}" for k in keys])
    return rows.select("scenario_idx", "stage_idx", "stage_name", "delay", "event_idx", F.col("raw")["Name"].alias("name"), "multiply")


@query("""
SELECT n_regionkey AS key, CASE n_nationkey % 3 WHEN 0 THEN 'no stages' ELSE 'stage without name or events' END AS reason
FROM (SELECT n_regionkey, n_nationkey FROM nation WHERE n_nationkey % 4 > 0)""")
def invalid_scenarios(spark, sf):
    """Nations play scenario documents, most of them broken in one of three ways."""
    path = scratch(spark)
    stage = F.expr("""CASE WHEN n_nationkey % 4 = 0 THEN array(named_struct('name', n_name, 'events', array(map('event_type', 'audit'))))
        WHEN n_nationkey % 3 = 0 THEN CAST(array() AS array<struct<name:string,events:array<map<string,string>>>>)
        WHEN n_nationkey % 3 = 1 THEN array(named_struct('name', n_name, 'events', CAST(array() AS array<map<string,string>>)))
        ELSE array(named_struct('name', CAST(NULL AS STRING), 'events', array(map('event_type', 'audit')))) END""")
    docs = load(spark, sf, "nation").select("n_regionkey", "n_nationkey", F.to_json(stage).alias("value"))
    docs.repartition("n_nationkey").write.partitionBy("n_regionkey", "n_nationkey").text(path)
    bad = Q.scenario_valid(readers.read_scenario_documents(spark, f"{path}/*/*"))
    return bad.select(F.regexp_extract("path", "n_regionkey=([0-9]+)", 1).cast("int").alias("key"), "reason")


@query("SELECT s_suppkey, s_name FROM supplier")
def json_array_members(spark, sf):
    """Suppliers by nation as files that hold a list; members that are no objects are left out."""
    path = scratch(spark)
    rows = load(spark, sf, "supplier").groupBy("s_nationkey").agg(F.concat(
        F.lit("[7, "), F.array_join(F.collect_list(F.to_json(F.struct("s_suppkey", "s_name"))), ", "), F.lit(', "x"]')).alias("value"))
    rows.repartition("s_nationkey").write.partitionBy("s_nationkey").text(path)
    members = readers.read_json_array(spark, f"{path}/*")
    at = lambda name: F.get_json_object("line", f"$.{name}")
    return members.select(at("s_suppkey").cast("bigint").alias("s_suppkey"), at("s_name").alias("s_name"))


@query(f"""
WITH {{EV}} SELECT event_id, CASE k % 3 WHEN 0 THEN 'DnsEvents' WHEN 1 THEN 'DeviceProcessEvents' ELSE 'IdentityLogonEvents' END AS "table",
  CAST(CASE k % 3 WHEN 0 THEN 22 WHEN 1 THEN 1 ELSE 4624 END AS INT) AS id FROM ev""".format(EV=EV))
def exported_windows_records(spark, sf):
    """Windows records, wrapped or not, with ids as numbers or objects."""
    path = scratch(spark)
    code = F.expr("CASE k % 3 WHEN 0 THEN 22 WHEN 1 THEN 1 ELSE 4624 END")
    provider = F.expr("CASE WHEN k % 3 < 2 THEN 'Microsoft-Windows-Sysmon' ELSE 'Microsoft-Windows-Security-Auditing' END")
    shown = F.when(F.col("k") % 2 == 0, F.concat(F.lit('{"#text":'), code, F.lit("}"))).otherwise(code.cast("string"))
    event = F.concat(F.lit('{"System":{"Provider":{"#attributes":{"Name":"'), provider, F.lit('"}},"EventID":'), shown,
                     F.lit('},"EventData":{"n":'), F.col("event_id"), F.lit("}}"))
    line = F.when(F.col("k") % 5 == 0, event).otherwise(F.concat(F.lit('{"Event":'), event, F.lit("}")))
    events(spark, sf).select(line.alias("value")).write.text(path)
    seen = readers.read_winevent_json(spark, path).withColumn("event_id", L.winevent_id(F.col("event_id_text")))
    routed = L.route_winevent(seen)
    return routed.select(F.get_json_object("event", "$.EventData.n").cast("bigint").alias("event_id"), "table", F.col("event_id").alias("id"))


@query("""
WITH p AS (SELECT p_brand AS item, count(*) AS count FROM part GROUP BY 1), t AS (SELECT sum(count) AS n FROM p)
SELECT 'DeviceEvents' AS "table", 'action' AS field, 'freeform' AS kind, item, count, CAST(row_number() OVER (ORDER BY count DESC, item) AS INT) AS rank, CAST(n AS BIGINT) AS n FROM p, t
UNION ALL SELECT 'DeviceEvents', 'source', 'tally', p_mfgr, count(*), 0, 0 FROM (SELECT substr(p_brand, 1, 7) AS p_mfgr FROM part) GROUP BY 4""")
def profile_documents(spark, sf):
    """A profile written as documents and read back: pools with ranks, and the records of each source."""
    path, part = scratch(spark), load(spark, sf, "part")
    long = part.select(F.lit("DeviceEvents").alias("table"), F.lit("action").alias("path"), F.col("p_brand").alias("value"))
    tallies = P.source_tally(part.select(F.lit("DeviceEvents").alias("table"), F.substring("p_brand", 1, 7).alias("source")))
    sinks.write_profile_documents(P.field_counts(long, kind=None), tallies, path, "2026-09-01T00:00:00Z")
    rows, back = readers.read_profile(spark, f"{path}/*")
    one = rows.select("table", "field", "kind", "item", "count", F.col("rank").cast("int").alias("rank"), "n")
    two = back.select("table", F.lit("source").alias("field"), F.lit("tally").alias("kind"), F.col("source").alias("item"),
                      F.col("records").alias("count"), F.lit(0).alias("rank"), F.lit(0).cast("bigint").alias("n"))
    return one.unionByName(two)


@query("""
WITH w AS (SELECT c_custkey, lower(c_mktsegment) AS a, n_name AS b FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT c_custkey, array_to_string([a, lower(regexp_replace(b, '[^A-Z]', '', 'g')), CAST(c_custkey AS VARCHAR), 'ip', 'addr'], ' ') AS words FROM w""")
def tokenized_names(spark, sf):
    """Field names made of market segments, nations and numbers, in mixed spellings."""
    nation = load(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    rows = load(spark, sf, "customer").join(nation, "c_nationkey")
    name = F.concat(F.initcap("c_mktsegment"), F.initcap(F.lower(F.regexp_replace("n_name", "[^A-Z]", ""))), F.col("c_custkey"), F.lit(".IPAddr"))
    return rows.select("c_custkey", F.array_join(tokenize_name(name), " ").alias("words"))


_SHA = "sha1(from_hex('6ba7b8109dad11d180b400c04fd430c8') || encode(url))"


@query(f"""
SELECT page_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab')
  || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id FROM (SELECT page_id, {_SHA} AS h FROM pages)""")
def name_uuids(spark, sf):
    return load(spark, sf, "pages").select("page_id", uuid5(F.col("url")).alias("id"))


@query(f"WITH {EV} SELECT event_id AS row_id FROM ev WHERE event_type = 'error' AND k % 6 IN (0, 1)")
def broken_audit_lines(spark, sf):
    """Audit records damaged in two ways are exactly the ones the gate reports."""
    good, _ = N.normalize(linux_rows(spark, sf), "linux_sudo", RUN, keep=("row_id", "serial"))
    lines = X.export_auditd(good, "linux_sudo", RUN, ("row_id", "pid"))
    hurt = lines.withColumn("line", F.expr(
        "CASE WHEN pid % 6 = 0 THEN concat('<13>', line) WHEN pid % 6 = 1 THEN concat(line, chr(10), 'x') ELSE line END"))
    return Q.gate_auditd(hurt).select("row_id")


@query(f"""
WITH {EV} SELECT event_id AS row_id, 4 AS before, 0 AS after FROM ev WHERE event_type = 'error'""")
def label_columns(spark, sf):
    """How many label columns each row carries before and after the export."""
    rows = accepted(spark, sf, "firewall")
    before, after = Q.labels_present(rows), Q.labels_present(N.public_table(rows, "firewall"))
    return rows.select("row_id", F.lit(len(before)).alias("before"), F.lit(len(after)).alias("after"))


@query("""
WITH m AS (SELECT max(epoch_us(ts)) AS top FROM events), b AS (SELECT event_id, epoch_us(ts) AS us FROM events WHERE event_id % 10 = 3)
SELECT count(*) FILTER (us <= top // 1000 * 1000 - 900000000) AS dropped, (SELECT count(*) FROM events) + 1 + count(*) FILTER (us > top // 1000 * 1000 - 900000000) AS kept,
  (SELECT count(*) FROM events) + 1 + count(*) AS seen, count(*) FILTER (event_id % 20 = 3) + (SELECT count(*) FROM events WHERE event_id % 20 = 3) AS shed FROM b, m""")
def streamed_late_rows(spark, sf):
    """A stream whose third file comes too late for most of its rows: kept, dropped, and counted as they pass."""
    path = scratch(spark)
    rows = load(spark, sf, "events").select(F.col("event_id").cast("string").alias("id"), F.col("ts").cast("timestamp").alias("ts"), "event_id")
    rows.coalesce(1).write.parquet(f"{path}/in/a")
    rows.agg(F.max("ts").alias("ts")).select(F.lit("end").alias("id"), "ts", F.lit(-1).cast("bigint").alias("event_id")).write.parquet(f"{path}/in/b")
    rows.filter("event_id % 10 = 3").withColumn("id", F.concat(F.lit("late"), "id")).coalesce(1).write.parquet(f"{path}/in/c")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in/*")
    late = jobs.LateRows().add(spark)
    seen = jobs.observed(stream, "passing", F.col("event_id") % 20 == 3)
    once = jobs.stream_dedup(seen, "id", "ts")
    run = once.select("id").writeStream.format("parquet").option("path", f"{path}/out").option(
        "checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    jobs.run_to_completion(run)
    dropped = late.of(run)
    spark.streams.removeListener(late)
    passed = [p.observedMetrics["passing"] for p in run.recentProgress if "passing" in p.observedMetrics]
    kept = spark.read.parquet(f"{path}/out")
    return kept.agg(F.lit(dropped).cast("bigint").alias("dropped"), F.count("*").alias("kept"),
                    F.lit(sum(m["rows"] for m in passed)).cast("bigint").alias("seen"), F.lit(sum(m["shed"] for m in passed)).cast("bigint").alias("shed"))
