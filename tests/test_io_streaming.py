"""Readers, writers and streams."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from watchloom.operators import coverage as C
from watchloom.operators import lookup as L
from watchloom.operators import normalize as N
from watchloom.operators import profiling as P
from watchloom.operators import quality as Q
from watchloom.operators.feeds import feed_lines
from watchloom.plans.flows import export_run, normalise_run
from watchloom.session import checkpoint_dir
from watchloom.sources import readers, sinks
from watchloom.streaming import jobs

SCENARIO = [
    {"name": "first", "delay": 2.5, "events": [
        {"event_type": "dns_query", "source": "dns", "Name": "{{RANDOM_HOST}}", "multiply": 3, "data": {"QueryType": "MX"}},
        {"event_type": "process_creation", "FileName": "a", "ProcessId": 1, "ProcessCommandLine": "b"}]},
    {"name": "second", "events": [{"event_type": "audit", "action": "x", "mitre": {"tactic": "t", "technique_id": "T1", "technique_name": "n"}}]},
]


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_scenarios_keep_order_and_normalise(spark, tmp_path):
    one = write(tmp_path / "b_first.json", json.dumps(SCENARIO))
    two = write(tmp_path / "a_second.json", json.dumps(SCENARIO[1:]))
    rows = readers.read_scenarios(spark, [one, two])
    got = rows.orderBy("scenario_idx", "stage_idx", "event_idx").collect()
    assert [(r["scenario"], r["stage_idx"], r["event_idx"], r["delay"], r["multiply"]) for r in got] == [
        ("b_first", 0, 0, 2.5, 3), ("b_first", 0, 1, 2.5, 1), ("b_first", 1, 0, 1.0, 1), ("a_second", 0, 0, 1.0, 1)]
    tables, refused = normalise_run(
        rows.withColumn("row_id", F.monotonically_increasing_id()), ["dns", "process", "workspace_audit"], routed_path=str(tmp_path / "routed"))
    assert tables["dns"].first()["query_type"] == "MX" and refused.count() == 0
    assert tables["workspace_audit"].first()["mitre"]["technique_id"] == "T1"
    assert {r["feed"] for r in export_run(tables).collect()} == {"json", "cef", "syslog", "winxml"}
    catalog = C.scenario_catalog(rows.withColumn("phase", F.lit("p")).withColumn("technique", F.lit("t")))
    assert {r["scenario"]: r["events"] for r in catalog.collect()} == {"b_first": 5, "a_second": 1}


def test_scenario_documents_are_checked(spark, tmp_path):
    for name, doc in (("good", SCENARIO), ("empty", []), ("noevents", [{"name": "x", "events": []}]), ("noname", [{"events": SCENARIO[1]["events"]}])):
        write(tmp_path / "s" / f"{name}.json", json.dumps(doc))
    bad = Q.scenario_valid(readers.read_scenario_documents(spark, str(tmp_path / "s")))
    assert {r["scenario"]: r["reason"] for r in bad.collect()} == {
        "empty": "no stages", "noevents": "stage without name or events", "noname": "stage without name or events"}


def test_json_lines_report_bad_lines_by_number(spark, tmp_path):
    write(tmp_path / "f.jsonl", '{"a": 1}\n\n{broken\n  \n{"a": {"b": 2}}\n[1]\n')
    good, bad = readers.read_jsonl(spark, str(tmp_path / "f.jsonl"))
    assert [(r["line_no"], r["raw"]["a"]) for r in good.orderBy("line_no").collect()] == [(1, "1"), (5, '{"b":2}')]
    assert [(r["line_no"], r["line"]) for r in bad.orderBy("line_no").collect()] == [(3, "{broken"), (6, "[1]")]


def test_line_numbers_hold_over_splits(spark, tmp_path):
    path = write(tmp_path / "big.txt", "".join(f"line {i}\n" for i in range(1, 5001)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = readers.read_lines(spark, path)
        assert rows.filter(F.concat(F.lit("line "), "line_no") != F.col("line")).count() == 0 and rows.count() == 5000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_arrays_csv_and_windows_records(spark, tmp_path):
    rows = readers.read_json_array(spark, [write(tmp_path / "l.json", '[{"a": 1}, 5, "x", {"b": [2]}]'), write(tmp_path / "o.json", '{"c": 3}')])
    assert sorted(r["line"] for r in rows.collect()) == ['{"a":1}', '{"b":[2]}', '{"c":3}']
    table = readers.read_csv_records(spark, write(tmp_path / "t.csv", "a,b\n1,\"x,y\"\n"))
    assert table.first().asDict() == {"a": "1", "b": "x,y"}
    event = {"System": {"Provider": {"#attributes": {"Name": "Microsoft-Windows-Sysmon"}}, "EventID": {"#text": 22}}, "EventData": {"q": 1}}
    lines = write(tmp_path / "w.jsonl", json.dumps({"Event": event}) + "\n" + json.dumps({**event, "System": {**event["System"], "EventID": 1}}) + "\n")
    seen = readers.read_winevent_json(spark, lines).withColumn("event_id", L.winevent_id(F.col("event_id_text")))
    assert [r["table"] for r in L.route_winevent(seen).collect()] == ["DnsEvents", "DeviceProcessEvents"]


def test_profile_documents(spark, tmp_path):
    doc = {"record_count": 3, "sources": {"s": 3}, "fields": {
        "UA": {"kind": "freeform", "n": 3, "values": [{"value": "x", "count": 2, "weight": 0.6667}, {"value": "y", "count": 1, "weight": 0.3333}]},
        "User": {"kind": "identifier", "n": 3, "shapes": [{"shape": "guid", "count": 3, "weight": 1.0}]}}}
    write(tmp_path / "p" / "SigninLogs.json", json.dumps(doc))
    write(tmp_path / "p" / "broken.json", "{nope")
    rows, tallies = readers.read_profile(spark, str(tmp_path / "p"))
    assert {(r["table"], r["field"], r["kind"], r["item"], r["rank"]) for r in rows.collect()} == {
        ("SigninLogs", "UA", "freeform", "x", 1), ("SigninLogs", "UA", "freeform", "y", 2), ("SigninLogs", "User", "identifier", "guid", 1)}
    assert [tuple(r) for r in tallies.collect()] == [("SigninLogs", "s", 3)]


def test_sorting_a_feed(spark, tmp_path):
    stamps = list(range(600))
    lines = [json.dumps({"TimeGenerated": f"2026-09-01T00:{(s * 7 % 600) // 60:02d}:{(s * 7 % 600) % 60:02d}", "i": s}) for s in stamps]
    lines[100:100] = ["bad line", ""]
    df = spark.createDataFrame(list(enumerate(lines)), "seq long, line string").repartition(5)
    sinks.write_sorted(df, str(tmp_path / "out"))
    files = sorted((tmp_path / "out").glob("part-*"))
    text = [ln for f in files for ln in f.read_text().splitlines()]
    times = [json.loads(ln)["TimeGenerated"] for ln in text if ln != "bad line"]
    assert times == sorted(times) and len(text) == 601
    assert json.loads(text[text.index("bad line") - 1])["i"] == json.loads(lines[99])["i"]


def test_arrays_are_bounded_and_whole(spark):
    rows = [(i, json.dumps({"i": i, "pad": "x" * (i % 40)}) if i % 10 else "{bad") for i in range(500)]
    arrays = sinks.to_ingestion_arrays(spark.createDataFrame(rows, "seq long, line string"), 100, 1500).collect()
    got = [d["i"] for a in sorted(arrays, key=lambda a: (a["batch"], a["part"])) for d in json.loads(a["body"])]
    assert got == [i for i in range(500) if i % 10] and all(len(a["body"]) < 1700 and a["rows"] <= 100 for a in arrays)
    names = spark.createDataFrame([("d/unified.json",), ("d/A.json",), ("d/A_array.json",)], "path string")
    assert [r["path"] for r in sinks.ingestible_files(names).collect()] == ["d/A.json"]


def test_files_are_bounded_and_old_ones_marked(spark, tmp_path):
    lines = spark.range(1000).select(F.lit("DnsEvents").alias("table"), F.col("id").cast("string").alias("line")).coalesce(1)
    sinks.write_tables(lines, str(tmp_path / "t"), max_records=100)
    assert len(list((tmp_path / "t").rglob("part-*"))) == 10
    kept = sinks.retained_files(spark, str(tmp_path / "t"), 4, "part-*")
    assert kept.filter("keep").count() == 4 and kept.count() == 10
    missing = L.missing_feeds(spark.createDataFrame([("DnsEvents",), ("cef",)], "feed string"), spark.read.text(str(tmp_path / "t")).withColumnRenamed("table", "feed"))
    assert [r["feed"] for r in missing.collect()] == ["cef"]


def test_lines_that_would_break_are_set_aside(spark, tmp_path):
    lines = spark.createDataFrame([("cef", "a\nb"), ("cef", "whole")], "feed string, line string")
    sinks.write_feed(lines, str(tmp_path / "f"))
    got = {(r["feed"], r["value"]) for r in spark.read.text(str(tmp_path / "f")).collect()}
    assert ("cef", "whole") in got and len(got) == 2
    aside = next(v for f, v in got if f == "unwritable")
    assert json.loads(aside) == {"feed": "cef", "line": "a\nb"}


def test_files_are_bounded_by_bytes_and_retention_removes(spark, tmp_path):
    sinks.bounded_files(spark.range(2000).select(F.lpad(F.col("id").cast("string"), 99, "0").alias("line")).coalesce(2), str(tmp_path / "b"), 20_000)
    files = list((tmp_path / "b").rglob("part-*"))
    files = [f for f in files if f.is_file()]
    assert len(files) >= 10 and all(f.stat().st_size <= 20_100 for f in files) and spark.read.text(str(tmp_path / "b")).count() == 2000
    sinks.write_tables(spark.range(100).select(F.lit("T").alias("table"), F.col("id").cast("string").alias("line")).coalesce(1), str(tmp_path / "t"), max_records=10)
    assert sinks.apply_retention(spark, str(tmp_path / "t"), 4, "part-*") == 6
    assert spark.read.text(str(tmp_path / "t")).count() == 40


def test_a_failing_sink_does_not_stop_the_others(spark, tmp_path):
    got = []

    def broken(batch, i):
        raise ValueError("down")

    failed = sinks.fan_out(spark.range(3).toDF("n"), 7, {"a": broken, "b": lambda batch, i: got.append((i, batch.count()))})
    assert got == [(7, 3)] and "down" in failed["a"]


def test_profiles_merge_by_version(spark, tmp_path):
    counts = spark.createDataFrame([("t", "f", "freeform", "x", 2)], P.COUNTS_SCHEMA)
    sinks.write_profile(counts, str(tmp_path / "p"), 0)
    assert sinks.write_profile(counts, str(tmp_path / "p"), 1).first()["count"] == 4
    assert sinks.write_profile(counts, str(tmp_path / "p"), 1).first()["count"] == 4
    assert sinks.compact_profile(spark, str(tmp_path / "p"), str(tmp_path / "q")).first()["count"] == 4


def test_one_identity_keeps_values_out_of_store_and_pools(spark, tmp_path):
    long = spark.createDataFrame([("t", "note", "secret plan", "str"), ("t", "note", "a@b.c", "str"), ("t", "tone", "calm", "str")],
                                 "table string, path string, value string, type string")
    counts = P.field_counts(long)
    assert [r["value"] for r in P.value_pool(counts).collect()] == ["calm"]
    stored = sinks.write_profile(counts, str(tmp_path / "p"), 0).collect()
    assert "secret plan" not in {r["item"] for r in stored} and "calm" in {r["item"] for r in stored}
    late = spark.createDataFrame([("t", "tone", "x@y.z", "str")], "table string, path string, value string, type string")
    again = sinks.write_profile(P.field_counts(late), str(tmp_path / "p"), 1).collect()
    assert "calm" not in {r["item"] for r in again}


def test_profile_documents_go_out_and_in(spark, tmp_path):
    counts = spark.createDataFrame([("t", "f", "freeform", "x", 2), ("t", "f", "freeform", "y", 1), ("t", "u", "identifier", "guid", 3)], P.COUNTS_SCHEMA)
    tallies = spark.createDataFrame([("t", "s1", 2), ("t", "s2", 1)], "table string, source string, records long")
    sinks.write_profile_documents(counts, tallies, str(tmp_path / "d"), "2026-09-01T00:00:00Z")
    for f in list((tmp_path / "d").rglob("part-*")):
        write(tmp_path / "docs" / (f.parent.name.split("=")[1] + ".json"), f.read_text())
    rows, back = readers.read_profile(spark, str(tmp_path / "docs"))
    assert {(r["table"], r["field"], r["kind"], r["item"], r["count"], r["rank"], r["n"]) for r in rows.collect()} == {
        ("t", "f", "freeform", "x", 2, 1, 3), ("t", "f", "freeform", "y", 1, 2, 3), ("t", "u", "identifier", "guid", 3, 1, 3)}
    assert {tuple(r) for r in back.collect()} == {("t", "s1", 2), ("t", "s2", 1)}


@pytest.mark.parametrize("files", [1, 8, 40])
@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_read_order_is_file_order(spark, tmp_path, files, adaptive):
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        sizes = [1 + (i * 37) % 29 for i in range(files)]
        n = 0
        for i, size in enumerate(sizes):
            write(tmp_path / "in" / f"part-{i:05d}.txt", "".join(f"{n + j}\n" for j in range(size)))
            n += size
        rows = readers.read_lines(spark, str(tmp_path / "in"))
        assert rows.count() == n and rows.filter(F.col("seq").cast("string") != F.col("line")).count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    names = [f"u{i % 4}@x.org" for i in range(40)]
    for part in range(4):
        write(src / f"{part}.jsonl", "".join(
            json.dumps({"event_type": "authentication", "UserPrincipalName": n, "data": {"status": "0"}}) + "\n" for n in names[part * 10:part * 10 + 10]) + "{bad\n")
    raw = jobs.read_jsonl_stream(spark, str(src), max_files=1)

    def keep(folder):
        return lambda rows, i: rows.write.mode("overwrite").parquet(f"{tmp_path}/{folder}/batch={i}")

    query = jobs.stream_normalise(raw, ["signin"], lambda name, rows, i: keep(name)(rows, i), keep("refused"), str(tmp_path / "c1"))
    assert jobs.run_to_completion(query, 120)
    streamed = spark.read.parquet(str(tmp_path / "signin")).collect()
    assert len(streamed) == 40 and len({r["row_id"] for r in streamed}) == 40 and len({r["event_id"] for r in streamed}) == 40
    refused = spark.read.parquet(str(tmp_path / "refused")).collect()
    assert [(r["line"], r["reasons"]) for r in refused] == [("{bad", ["unparsed"])] * 4
    assert len([p for p in query.recentProgress if p.numInputRows]) == 4

    counted = jobs.observed(raw, "seen", F.col("line").contains("u0@x.org")).writeStream.format("noop").option(
        "checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start()
    assert jobs.run_to_completion(counted, 120)
    assert sum(p.observedMetrics["seen"]["shed"] for p in counted.recentProgress if "seen" in p.observedMetrics) == 10

    failures = []
    run = jobs.stream_fanout(raw, ["signin"], {
        "bad": lambda b, i: 1 / 0, "good": lambda b, i: b.write.mode("overwrite").parquet(f"{tmp_path}/lines/batch={i}")},
        str(tmp_path / "c2"), keep("refused2"), on_failure=lambda i, f: failures.append((i, sorted(f))))
    assert jobs.run_to_completion(run, 180)
    assert spark.read.parquet(str(tmp_path / "lines")).groupBy("feed").count().filter("count <> 40").count() == 0
    assert [f for _, f in failures] == [["bad"]] * 4 and spark.read.parquet(str(tmp_path / "refused2")).count() == 4


def test_late_rows_are_counted(spark, tmp_path):
    schema = "ts timestamp, table string"
    for i, stamps in enumerate((["2026-09-01T12:00:00", "2026-09-01T13:00:00"], ["2026-09-01T12:50:00", "2026-09-01T13:30:00"], ["2026-09-01T10:00:00"])):
        time.sleep(0.05)
        write(tmp_path / "s" / f"{i}.json", "".join(json.dumps({"ts": t, "table": "x"}) + "\n" for t in stamps))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "s"))
    late = jobs.LateRows().add(spark)
    query = jobs.stream_rate(stream, "ts", "10 minutes").writeStream.format("parquet").option("path", str(tmp_path / "o")).option(
        "checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert jobs.run_to_completion(query, 120)
    assert late.of(query) == 1


def test_deadline_stops_a_query(spark, tmp_path):
    stream = spark.readStream.format("rate").load()
    query = stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).start()
    assert jobs.run_to_completion(query, 2) is False and not query.isActive


def test_checkpoint_folder_is_set_once(spark):
    assert checkpoint_dir(spark) == checkpoint_dir(spark)


def test_conservation_and_order(spark, accept):
    good, _ = accept("dns", "dns_query", {"Name": "a"}, {"Name": "b"})
    out = feed_lines(good, "dns").filter("feed = 'json'")
    kept = Q.conservation(good.withColumn("table", F.lit("DnsEvents")), out, "table").first()
    assert (kept["rows_in"], kept["rows_out"], kept["kept"]) == (2, 2, True)
    assert jobs.routed_counts(good.select(F.create_map(F.lit("event_type"), F.lit("dns_query")).alias("raw"))).first()["records"] == 2


@pytest.fixture
def small_splits(spark):
    """Input splits of a few bytes, so that records go over their ends."""
    def use(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        spark.conf.set("spark.sql.files.minPartitionNum", "1")

    yield use
    for key in ("maxPartitionBytes", "openCostInBytes", "minPartitionNum"):
        spark.conf.unset(f"spark.sql.files.{key}")


@pytest.mark.parametrize("size", [60, 1 << 20])
def test_csv_splits_equal_the_reader_of_whole_files(spark, tmp_path, small_splits, size):
    rnd = random.Random(size)
    quote = lambda t: '"' + t.replace('"', '""') + '"'
    cell = lambda: rnd.choice(["", "x", "a b", quote(""), quote("l1\nl2"), quote('say "hi",\r\nthen'), quote("\n\n"), quote("é," * rnd.randint(0, 30)), quote('""')])
    for name in "ab":
        ends = rnd.choice(["\n", "\r\n"])
        write(tmp_path / "in" / f"{name}.csv", ends.join(["k,one,two", *[f"{name}{i},{cell()},{cell()}" for i in range(20)], "", f"{name}last,{quote('end' + chr(10))},z"]) + rnd.choice(["", ends]))
    want = spark.read.csv(str(tmp_path / "in"), header=True, multiLine=True, nullValue="\u0000", emptyValue="", escape='"').collect()
    small_splits(size)
    got = readers.read_csv_records(spark, str(tmp_path / "in"))
    assert got.columns == ["k", "one", "two"] and len(want) == 42
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want), key=repr)


@pytest.mark.parametrize("size", [120, 1 << 20])
def test_list_members_are_read_over_splits(spark, tmp_path, small_splits, size):
    rnd = random.Random(size)

    def thing(depth=0):
        kind = rnd.randint(0, 7 if depth < 4 else 4)
        if kind < 5:
            return [rnd.randint(-9, 9), 'q"}{[\\', "a, b]\n}}", None, "é😀"][kind]
        return [thing(depth + 1) for _ in range(rnd.randint(0, 4))] if kind == 5 else {rnd.choice(['k', '}', '"', 'n\\']) + str(i): thing(depth + 1) for i in range(rnd.randint(0, 4))}

    want = set()
    for n in range(6):
        value = [thing() for _ in range(15)] if n < 4 else {"one": [thing(), {"x": [1, 2, {}]}], "b": thing()}
        path = write(tmp_path / "in" / f"{n}.json", " \n" + json.dumps(value, indent=rnd.choice([None, 2]), ensure_ascii=n % 2 == 0) + "\n")
        members = value if n < 4 else [value]
        want |= {(path.rsplit("/", 1)[1], i, json.dumps(m, sort_keys=True)) for i, m in enumerate(members) if isinstance(m, dict)}
    write(tmp_path / "in" / "7.json", "[1, 2")
    write(tmp_path / "in" / "8.json", "")
    write(tmp_path / "in" / "9.json", "[]")
    small_splits(size)
    got = readers.read_json_array(spark, str(tmp_path / "in")).collect()
    assert sorted((r["file"].rsplit("/", 1)[1], r["pos"], json.dumps(json.loads(r["line"]), sort_keys=True)) for r in got) == sorted(want)


def test_a_ledger_delivers_what_a_sink_missed_in_order(spark, tmp_path):
    ledger, got, down = sinks.Ledger(spark, str(tmp_path / "ledger")), [], {"b": 3}

    def sink(name):
        def take(batch, i):
            if down.get(name, 0) > 0:
                down[name] -= 1
                raise ValueError("down")
            got.append((name, i, batch.count()))
        return take

    both = {n: sink(n) for n in "ab"}
    for i in range(3):
        sinks.fan_out(spark.range(i + 1).toDF("n"), i, both, ledger)
    assert [x for x in got if x[0] == "a"] == [("a", 0, 1), ("a", 1, 2), ("a", 2, 3)] and [x for x in got if x[0] == "b"] == []
    assert [(r["sink"], r["batch"]) for r in ledger.open()] == [("b", 0), ("b", 1), ("b", 2)]
    assert ledger.redeliver(both) == set() and [x for x in got if x[0] == "b"] == [("b", 0, 1), ("b", 1, 2), ("b", 2, 3)]
    assert ledger.open() == [] and not any((tmp_path / "ledger" / "rows").glob("batch=*"))


def test_rows_go_to_one_place_and_windows_leave_the_state(spark, tmp_path):
    schema = "id long, ts timestamp, table string"
    folder, state, rows = tmp_path / "in", [], []
    for b in range(12):
        own = [(b * 10 + k, f"2026-09-01T{b:02d}:{k * 5:02d}:00") for k in range(10)] + ([(1000 + b, f"2026-09-01T{b - 2:02d}:30:00"), (2000 + b, None)] if b > 2 else [])
        rows += [(i, b, t) for i, t in own]
        write(folder / f"{b:02d}.json", "".join(json.dumps({"id": i, "ts": t, "table": "x"}) + "\n" for i, t in own))
        stream = spark.readStream.schema(schema).json(str(folder))
        put = lambda name: lambda df, i: df.write.mode("overwrite").parquet(f"{tmp_path}/{name}/batch={i}")
        assert jobs.run_to_completion(jobs.stream_aside(stream, "ts", put("kept"), put("aside"), f"{tmp_path}/seen", f"{tmp_path}/c1", shed=F.col("id") % 10 == 4), 120)
        if b < 4:
            query = jobs.stream_rate_table(stream, "ts", "10 minutes", f"{tmp_path}/rate", f"{tmp_path}/c2")
            assert jobs.run_to_completion(query, 120)
            state.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    kept = {r["id"] for r in spark.read.parquet(f"{tmp_path}/kept").collect()}
    aside = {r["id"]: r["reason"] for r in spark.read.parquet(f"{tmp_path}/aside").collect()}
    assert kept | set(aside) == {i for i, *_ in rows} and not kept & set(aside) and len(rows) == len(kept) + len(aside)
    assert {i for i, r in aside.items() if r == "late"} == {1000 + b for b in range(3, 12)}
    assert {i for i, r in aside.items() if r == "shed"} == {i for i, *_ in rows if i % 10 == 4 and i not in range(1000, 2000)}
    assert max(state) <= 10 and jobs.rate_table(spark, f"{tmp_path}/rate").filter("events = 2").count() >= 20


def test_feeds_are_written_packed_when_asked(spark, tmp_path):
    rows = [("T", "json", f'{{"a":{i}}}') for i in range(40)] + [("T", "okta", f"o{i}") for i in range(9)]
    lines = spark.createDataFrame(rows, "table string, feed string, line string")
    for name, codec in (("plain", None), ("packed", "gzip")):
        json_lines = lines.filter("feed = 'json'")
        sinks.write_tables(json_lines, f"{tmp_path}/{name}/tables", max_records=10, compression=codec)
        sinks.write_unified(json_lines, f"{tmp_path}/{name}/unified", compression=codec)
        sinks.write_feed(lines, f"{tmp_path}/{name}/feeds", compression=codec)
        sinks.write_vendor_feeds(lines, f"{tmp_path}/{name}/vendors", compression=codec)
        files = [p for p in (tmp_path / name).rglob("part-*") if not p.name.endswith(".crc")]
        assert {p.suffix for p in files} == {".gz" if codec else ".txt"}
    for part in ("tables", "unified", "feeds", "vendors"):
        plain, packed = (sorted(r["value"] for r in spark.read.text(f"{tmp_path}/{n}/{part}").collect()) for n in ("plain", "packed"))
        assert plain == packed and plain


def test_a_batch_is_judged_once_for_all_that_becomes_of_it(spark):
    from watchloom.operators.feeds import export_judged, export_records
    from watchloom.operators.normalize import flatten_data, normalize, route_event_type

    models = ["signin", "firewall", "linux_auth"]
    given = [
        {"event_type": "linux_auth", "source": "Linux", "timestamp": "1704067200"},
        {"event_type": "authentication", "source": "Azure AD", "user_name": "a", "is_malicious": "perhaps"},
        {"event_type": "authentication", "source": "Azure AD", "user_name": None, "AccountName": "x"},
        {"event_type": "authentication", "source": "Azure AD", "AccountName": "b", "timestamp": "2024-01-01 00:00:03"},
        {"event_type": "network_connection", "source": "Firewall", "source_ip": "10.0.0.1", "timestamp": "1704067200"},
        {"data": '{"event_type": "network_connection", "source": "Firewall"}'}, {"event_type": "odd"}, None]
    batch = spark.createDataFrame(
        [(str(i), str(d), d) for i, d in enumerate(given)], "row_id string, line string, raw map<string,string>")
    rows = jobs.judged_batch(batch, models).persist()
    try:
        tables, refused = jobs.normalised_batch(rows, models)
        assert all(df._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 1 for df in (*tables.values(), refused))
        routed = route_event_type(flatten_data(batch.filter("raw IS NOT NULL")))
        want = {r["row_id"]: (None, ["unparsed"]) for r in batch.filter("raw IS NULL").collect()}
        want |= {r["row_id"]: (r["model"], ["class"]) for r in routed.collect() if r["model"] not in models}
        same = lambda df: sorted(map(str, df.drop("ingested_at").collect()))
        for name in models:
            good, bad = normalize(routed, name, now="TIMESTAMP '2024-01-02 00:00:00'")
            want |= {r["row_id"]: (name, r["reasons"]) for r in bad.collect()}
            assert tables[name].schema == good.schema and same(tables[name].select("row_id")) == same(good.select("row_id"))
            stamped = [c for c in good.columns if good.schema[c].dataType.typeName() != "timestamp"]
            assert same(tables[name].select(stamped)) == same(good.select(stamped))
        assert {r["row_id"]: (r["model"], r["reasons"]) for r in refused.collect()} == want and len(want) >= 4
        timed = lambda df: sorted(map(str, df.filter("feed IN ('syslog', 'winxml', 'auditd')").select("table", "feed").collect()))
        assert timed(export_judged(rows.withColumnRenamed("reasons", "errors"), models)) == timed(export_records(routed, models))
    finally:
        rows.unpersist()
