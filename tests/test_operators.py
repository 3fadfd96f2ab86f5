"""Sequences, timelines, expansion, profiles, rules."""

import json
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from watchloom.catalog import dims
from watchloom.operators import coverage as C
from watchloom.operators import detect as D
from watchloom.operators import expand as G
from watchloom.operators import lookup as L
from watchloom.operators import normalize as N
from watchloom.operators import ordered as O
from watchloom.operators import profiling as P
from watchloom.operators import sequence as S
from watchloom.operators import timeline as T
from watchloom.operators.rangejoin import range_join, step_join
from watchloom.operators.settings import Settings, TimingProfile


def test_previous_rows_hold_over_seams(spark):
    rnd = random.Random(1)
    rows = [("hot" if rnd.random() < 0.5 else f"k{rnd.randint(0, 9)}" if rnd.random() < 0.9 else None, rnd.randint(0, 50), i, f"s{rnd.randint(0, 3)}")
            for i in range(600)]
    df = spark.createDataFrame(rows, "k string, t int, i int, s string")
    got = {r["i"]: (r["p"], r["pt"]) for r in O.with_previous(df, "k", ("t", "i"), {"s": "p", "t": "pt"}).collect()}
    want, last = {}, {}
    for k, t, i, s in sorted(rows, key=lambda r: (r[1], r[2])):
        want[i] = last.get(k, (None, None))
        last[k] = (s, t)
    assert got == want


def test_steps_are_carried_forward(spark):
    rnd = random.Random(5)
    steps = sorted({(rnd.choice("ab"), rnd.randint(0, 10_000) / 10_000) for _ in range(400)} | {("a", 0.0), ("c", 0.5)})
    points = [(rnd.choice("abc"), rnd.random(), i) for i in range(3000)]
    got = step_join(spark.createDataFrame(points, "g string, u double, i int"),
                    spark.createDataFrame([(g, x, f"{g}{x}") for g, x in steps], "g string, lo double, n string"), "u", "lo", ("g",))
    want = {}
    for g, u, i in points:
        own = [x for h, x in steps if h == g and x <= u]
        if own:
            want[i] = f"{g}{max(own)}"
    assert {r["i"]: r["n"] for r in got.collect()} == want


def test_draws_from_a_large_pool(spark):
    pool = spark.range(1_000_000).select(F.col("id").alias("value"), (F.col("id") % 7).alias("weight"))
    drawn = G.weighted_sample(pool, 20_000, "big").select("rank", "value", "weight").collect()
    assert len(drawn) == 20_000 and len({r["rank"] for r in drawn}) == 20_000
    light = sum(r["weight"] in (0, 1) for r in drawn)
    assert 0.07 < light / 20_000 < 0.11  # two of the kinds weigh one each, of 22 in all


def test_serial_ranges_equal_one_window(spark):
    rnd = random.Random(2)
    rows = [(i * 3, rnd.randint(0, 100), rnd.choice([None, f"v{i}"])) for i in range(200)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "seq long, v int, key string")
    seen, best, last, want = {}, None, "", {}
    for seq, v, key in sorted(rows):
        seen[seq] = best
        best = v if best is None else max(best, v)
        last = key or last
        want[seq] = last
    got = {r["seq"]: r["m"] for r in O.running_max_before(df, "seq", "v", "m", 16).collect()}
    assert got == seen
    assert {r["seq"]: r["key"] for r in S.forward_fill_key(df, "seq", "key", 16).collect()} == want
    assert sorted((r["rank"], r["seq"]) for r in O.serial_rank(df, "seq", width=16).collect()) == [(i, i * 3) for i in range(200)]
    ranked = O.global_rank(df, ["v", "seq"], partitions=7).collect()
    assert [(r["v"], r["seq"]) for r in sorted(ranked, key=lambda r: r["rank"])] == sorted((v, s) for s, v, _ in rows)


def test_range_join_equals_comparing_all(spark):
    points = spark.createDataFrame([(float(x) / 3,) for x in range(60)], "p double")
    spans = spark.createDataFrame([(0.0, 2.5, "a"), (2.0, 9.0, "b"), (9.0, 9.0, "empty"), (-1.0, 20.0, "c")], "lo double, hi double, n string")
    want = points.join(spans, (F.col("p") >= F.col("lo")) & (F.col("p") < F.col("hi"))).select("p", "n").collect()
    got = range_join(points, spans, "p", "lo", "hi", 1.5).select("p", "n").collect()
    assert sorted(map(tuple, want)) == sorted(map(tuple, got))


def test_interleaving(spark):
    for stages, noise in ((23, 512), (7, 30), (6, 60), (10, 3)):
        attack = spark.createDataFrame([(i, f"a{i}") for i in range(stages)], "stage_idx int, what string")
        batch = spark.range(noise).withColumnRenamed("id", "rank")
        rows = S.interleave_batches(attack, batch, stages, noise).filter("is_noise").collect()
        sizes = {}
        for r in rows:
            sizes[r["stage_idx"]] = sizes.get(r["stage_idx"], 0) + 1
        want = {i: (i + 1) * noise // stages - i * noise // stages for i in range(stages)}
        assert sizes == {i: n for i, n in want.items() if n} and len({r["rank"] for r in rows}) == noise
    assert S.interleave_batches(attack, spark.range(0).withColumnRenamed("id", "rank"), 10, 0).count() == 10


def delays(spark, profile, *stamps):
    df = spark.createDataFrame([(s,) for s in stamps], "ts timestamp_ntz")
    return [round(r[0], 3) for r in df.select(T.expected_delay(F.col("ts"), profile)).collect()]


def test_calendar(spark):
    flat = dict(jitter=0.0)
    assert delays(spark, TimingProfile(**flat), datetime(2026, 9, 16, 12), datetime(2026, 9, 16, 22)) == [1.0, 10.0]
    assert delays(spark, TimingProfile(weekends=True, **flat), datetime(2026, 9, 19, 12)) == [round(1 / 0.15, 3)]
    west = TimingProfile(utc_offset_hours=-8, weekends=True, **flat)
    assert delays(spark, west, datetime(2026, 9, 21, 22, 50), datetime(2026, 9, 21, 11), datetime(2026, 9, 19, 2)) == [1.0, 10.0, 10.0]


def test_jitter_is_repeatable_and_positive(spark):
    df = spark.range(500).select("id", T.expected_delay(
        F.lit(datetime(2026, 9, 16, 12)).cast("timestamp"), TimingProfile(), F.col("id").cast("string")).alias("d"))
    first, again = [r["d"] for r in df.collect()], [r["d"] for r in df.collect()]
    assert first == again and min(first) > 0 and 0.95 < sum(first) / 500 < 1.05


def test_virtual_timeline_steps_like_a_clock(spark):
    profile = TimingProfile(avg_delay_seconds=37.0, weekends=True, utc_offset_hours=-3.5)
    start, end = datetime(2026, 9, 18, 11, 20), datetime(2026, 9, 19, 15)
    at, want = start, []
    while at < end:
        want.append(at)
        local = at + timedelta(hours=-3.5)
        d = 37.0 if 9 <= local.hour < 17 else 37.0 / 0.1
        at += timedelta(seconds=d / 0.15 if local.weekday() >= 5 else d)
    out = T.assign_timestamps(spark.range(len(want) + 5).withColumnRenamed("id", "rank"), start, end, profile)
    got = {r["rank"]: r for r in out.collect()}
    assert [got[i]["ts"] for i in range(len(want))] == want
    assert all(got[len(want) + i]["ts"] is None for i in range(5)) and got[0]["progress"] == 0.0
    full = T.hour_table(spark, datetime(2026, 9, 18), datetime(2026, 9, 21), TimingProfile(avg_delay_seconds=0.2, weekends=True))
    # 224 640 by hourly capacity; the last event of an hour runs a little into the next
    assert abs(full.agg(F.max("rank_to")).first()[0] - 224640) < 24


def test_transition_weights_are_normalised(spark):
    probs = S.normalise_weights(S.declared_transitions(spark)).groupBy("state").agg(F.sum("prob").alias("p")).collect()
    assert all(abs(r["p"] - 1) < 1e-9 for r in probs)


def follow(spark, n, user, state="SigninLogs"):
    return spark.range(n).select(
        F.concat(F.lit("e"), "id").alias("event_id"), F.lit(state).alias("event_type"), F.lit(0).alias("depth"),
        F.lit("corr").alias("correlation_id"), F.lit(user).cast("string").alias("user_name"), F.lit("H").alias("hostname"),
        F.lit("1.2.3.4").alias("source_ip"), F.lit(None).cast("string").alias("dest_ip"), F.lit("high").alias("severity"),
        F.lit(True).alias("is_malicious"), F.lit("s").alias("scenario_id"), F.lit("impact").alias("killchain_phase"))


def test_follow_ups_inherit_and_normalise(spark):
    derived = G.follow_ups(follow(spark, 200, None)).persist()
    depths = {r["depth"]: r["count"] for r in derived.groupBy("depth").count().collect()}
    assert depths[1] == 200 and max(depths) == dims.MAX_DEPTH
    assert {r["correlation_id"] for r in derived.select("correlation_id").distinct().collect()} == {"corr"}
    rows = derived.withColumn("row_id", F.col("event_id"))
    for model in ("process", "firewall", "office_activity", "cloud_activity", "signin"):
        good, bad = N.normalize(rows, model)
        assert bad.count() == 0 and good.count() == rows.filter(F.col("model") == model).count()
    assert {r["vendor"] for r in N.normalize(rows, "firewall")[0].collect()} <= {"cisco"}
    signins = N.normalize(rows, "signin")[0].collect()
    assert {r["user_principal_name"] for r in signins} <= {"unknown@corp.local"}
    assert G.follow_ups(follow(spark, 5, "u", "DnsEvents")).count() == 0


def test_replication_and_binding(spark, records):
    raw = records({"ip": "{{RANDOM_IP}}|{{RANDOM_IP}}", "nested": '{"a": "{{RANDOM_PID}}"}', "u": "{{PERSONA_EMAIL}}", "s": "{{CNC_IP}} {{DEEPFAKE_PHONE}}"})
    many = G.multiply_rows(raw.withColumn("multiply", F.lit(12_345)), spread=True)
    assert many.count() == 12_345 and many.select("instance").distinct().count() == 12_345
    assert G.multiply_rows(raw.withColumn("multiply", F.lit(0))).count() == 0
    five = G.multiply_rows(raw.withColumn("multiply", F.lit(5))).withColumn("row_id", F.col("instance")).withColumn("cycle", F.lit(1))
    bound = G.bind_pools(G.bind_session(G.bind_persona(five))).collect()
    assert len({r["raw"]["ip"] for r in bound}) > 1 and len({r["raw"]["u"] for r in bound}) == 1 and len({r["raw"]["s"] for r in bound}) == 1
    for r in bound:
        first, second = r["raw"]["ip"].split("|")
        assert first == second and "{{" not in str(r["raw"]) and r["raw"]["u"].endswith("@example.org")
        assert json.loads(r["raw"]["nested"])["a"].isdigit()


def test_nested_values_stay_json(records):
    raw = records({"n": '{"p": "{{RANDOM_FILE_PATH}}", "q": ["{{RANDOM_GUID}} {{RANDOM_GUID}}", "{{RANDOM_GUID}}"], "k": 1}', "t": "{{RANDOM_FILE_PATH}}"})
    out = G.bind_pools(raw).first()["raw"]
    nested = json.loads(out["n"])
    assert nested["p"] in dims.FILE_PATHS and out["t"] in dims.FILE_PATHS and nested["k"] == 1
    one, two = nested["q"][0].split()
    assert one == two and one != nested["q"][1]


def test_every_placeholder_is_filled(records):
    names = list(G.RANDOM_VALUES)
    assert len(names) == 22
    out = G.bind_pools(records({n: "{{" + n + "}}" for n in names})).first()["raw"]
    assert all(out[n] and "{{" not in out[n] for n in names)


def test_profile_values_come_before_the_fixed_pool(spark, records):
    rows = [("SigninLogs", "UserAgent", "freeform", "agent\n one", 3), ("OfficeActivity", "UserAgent", "freeform", "later", 9),
            ("W3CIISLog", "csUriStem", "freeform", "C:\\local", 5)]
    pools = P.value_pool(spark.createDataFrame(rows, P.COUNTS_SCHEMA))
    raw = G.bind_pools(records({"ua": "{{RANDOM_UA}}", "url": "{{RANDOM_URL}}"}), chosen=G.choose_pools(pools)).first()["raw"]
    assert raw["ua"] == "agent one" and raw["url"] in dims.URLS


def test_noise(spark):
    assert [G.noise_count(r, 70) for r in (0.3, 0, 1, 1.5)] == [30, 0, 0, 0]
    pool = spark.createDataFrame([(0, 50), (1, None), (2, -3)], "template_id int, multiply int")
    assert {r["template_id"]: r["weight"] for r in G.noise_pool(pool).collect()} == {0: 20, 1: 1, 2: 1}
    drawn = G.weighted_sample(G.noise_pool(pool), 400, "x", ("template_id",)).groupBy("template_id").count().collect()
    counts = {r["template_id"]: r["count"] for r in drawn}
    assert sum(counts.values()) == 400 and counts[0] > 300


def test_profiles(spark):
    long = spark.createDataFrame(
        [("t", "note", "plain", "str"), ("t", "note", "plain", "str"), ("t", "note", "a@b.c", "str"), ("t", "UserName", "bob", "str"),
         ("t", "Status", "200", "int"), ("t", "Status", "", "str"), ("t", "Status", None, "str"), ("t", "UserId", "7", "int")],
        "table string, path string, value string, type string")
    counts = P.field_counts(long)
    got = {(r["field"], r["kind"], r["item"]): r["count"] for r in counts.collect()}
    assert got == {("note", "freeform", "plain"): 2, ("note", "identifier", "email:local_len=1:domain_labels=2"): 1,
                   ("UserName", "identifier", "str:len_bucket=<=8"): 1, ("Status", "freeform", "200"): 1, ("UserId", "identifier", "int"): 1}
    settled = {(r["field"], r["item"]) for r in P.settle_kinds(counts).collect() if r["field"] == "note"}
    assert settled == {("note", "str:len_bucket=<=8"), ("note", "email:local_len=1:domain_labels=2")}
    assert P.leak_scan(P.value_pool(counts)).count() == 0
    a, b = counts.filter("field = 'note'"), counts.filter("field <> 'note'")
    assert sorted(map(str, P.merge_profiles(a, b).collect())) == sorted(map(str, P.merge_profiles(b, a).collect()))
    leak = spark.createDataFrame([("x@y.z",), ("plain text",)], "value string")
    assert [r["value"] for r in P.leak_scan(leak).collect()] == ["x@y.z"]


def test_deep_and_typed_records(spark):
    docs = spark.createDataFrame([(1, '{"a":{"b":{"c":{"d":1}}},"l":[1,{"x":2}],"t":true,"n":null,"f":1.5,"s":"x"}'), (2, '{"a":"leaf"}')], "id int, j string")
    rows = P.flatten_record(docs.select("id", F.parse_json("j").alias("v")), ("id",), "v").collect()
    assert {(r["id"], r["path"], r["value"], r["type"]) for r in rows} == {
        (1, "a.b.c.d", "1", "int"), (1, "l[]", "list_len=2", "str"), (1, "t", "True", "bool"), (1, "n", None, "NoneType"),
        (1, "f", "1.5", "float"), (1, "s", "x", "str"), (2, "a", "leaf", "str")}
    typed = spark.sql("SELECT 1 AS id, named_struct('a', named_struct('b', 2L), 'l', array(1, 2), 't', false) AS r")
    assert {tuple(r) for r in P.flatten_struct(typed, (), "r").collect()} == {
        ("a.b", "2", "int"), ("l[]", "list_len=2", "str"), ("t", "False", "bool")}


def test_windows_event_routes(spark):
    df = spark.createDataFrame(
        [("Microsoft-Windows-Sysmon", "22"), ("Microsoft-Windows-Security-Auditing", '{"#text": 4624}'), ("Odd Prov!", "7"), (None, "x"),
         ("Microsoft-Windows-RemoteDesktopServices-RdpCoreTS", "131")], "provider string, e string").withColumn("event_id", L.winevent_id(F.col("e")))
    assert [r["table"] for r in L.route_winevent(df).collect()] == [
        "DnsEvents", "IdentityLogonEvents", "Unclassified_Odd_Prov__7", "Unclassified_Unknown_None", "IdentityLogonEvents"]
    assert {r["table"] for r in L.route_winevent(df, forced="X").collect()} == {"X"}


def test_children_take_one_parent_each(spark):
    rows = [("c", 0, 0, "root"), ("c", 0, 1, "twin"), *[("c", 1, i, None) for i in range(2, 50)], ("d", 1, 99, "own")]
    df = spark.createDataFrame(rows, "correlation_id string, depth int, row_id int, user_name string")
    out = L.inherit_context(df.filter("depth = 1"), df, order=("row_id",), columns=("user_name",)).collect()
    assert len(out) == 49 and {r["user_name"] for r in out} == {"root", "own"}


def test_personas(spark):
    people = L.persona_dimension(spark)
    df = spark.createDataFrame([("board.chair",), ("nobody",)], "user_name string")
    got = {r["user_name"]: r for r in L.enrich_persona(df, people).collect()}
    assert got["board.chair"]["is_sensitive"] and got["board.chair"]["email"] == "board.chair@example.org" and got["nobody"]["role"] is None


def test_rules_and_counts(spark):
    df = spark.createDataFrame(
        [(1, "x vssadmin.exe delete shadows /all AnyDesk", None, True), (2, None, "Failed password for root", True), (3, "x", "y", False)],
        "Id int, ProcessCommandLine string, Message string, bad boolean")
    hits = {(r["Id"], r["rule_id"], r["level"]) for r in D.detect(df).collect()}
    assert hits == {(1, "100005", 14), (1, "100002", 14), (2, "100001", 12)}
    usable = [r for r in D.DEFAULT_RULES if r.column != "ActionType"]
    quality = {r["rule_id"]: r for r in D.rule_quality(df, usable, "bad").collect()}
    assert quality["100001"]["precision"] == 1.0 and quality["100001"]["recall"] == 0.5 and quality["100003"]["precision"] is None
    size = C.malicious_stage_size(spark.createDataFrame([(0, True), (0, False), (1, False)], "s int, is_malicious boolean"), ["s"]).first()
    assert (size["events"], size["exact"]) == (2, 1)


def test_weighted_intervals_leave_no_gap(spark):
    from watchloom.operators.rangejoin import cumulative

    rnd = random.Random(3)
    pool = spark.createDataFrame([(i, i % 2, rnd.random()) for i in range(300)], "value int, g int, w double")
    for group in ([], ["g"]):
        rows = cumulative(pool, group, ["value"], F.col("w")).collect()
        for key in {r["g"] for r in rows} if group else {None}:
            own = sorted((r for r in rows if key is None or r["g"] == key), key=lambda r: r["value"])
            assert own[0]["lo"] == 0.0 and abs(own[-1]["hi"] - 1.0) < 1e-12
            assert all(a["hi"] == b["lo"] for a, b in zip(own, own[1:]))


def test_required_texts_are_in_every_match():
    cases = {"abcd": "abcd", "a(bcd)+e": "bcd", "(?i)ABCdef[0-9]ghi": "abcdef", "x|abcd": "", "ab?cdef": "cdef", "abc{0,3}defg": "defg", "^foo bar$": "foo bar",
             r"a\.exe\s+-enc": ".exe", "(unclosed": "", r"\p{L}abc": "", "(?:abc)def": "abcdef", "ä1234": "1234", "abc*d": "ab", "": "", "(a|b)cdef(?=zz)": "cdef"}
    got = {p: D.required_text(p) for p in cases}
    assert {p: t for p, t in got.items() if p != r"a\.exe\s+-enc"} == {p: t for p, t in cases.items() if p != r"a\.exe\s+-enc"}
    assert got[r"a\.exe\s+-enc"] == "a.exe"


def test_many_rules_equal_testing_every_rule(spark):
    rnd = random.Random(8)
    words = ["mimikatz", "powershell", "-enc", "cmd.exe", "x", "rundll32", "ab", "Temp"]
    patterns = [rnd.choice(["", "(?i)", "^"]) + rnd.choice(words).replace(".", r"\.") + rnd.choice(["", ".*", "[0-9]+", "$", "(a|b)"]) + rnd.choice(["", rnd.choice(words).replace(".", r"\.")]) for _ in range(300)]
    rules = [(f"r{i}", i % 5, f"c{i % 3}", p, "d") for i, p in enumerate(patterns)]
    values = [(i, f"c{i % 4}", None if i % 50 == 0 else " ".join(rnd.choice([*words, "MIMIKATZ", "7", "Σ"]) for _ in range(rnd.randint(0, 5)))) for i in range(400)]
    table = spark.createDataFrame(rules, "rule_id string, level int, column string, pattern string, description string")
    rows = spark.createDataFrame(values, "row_id long, column string, value string")
    got = {(r["row_id"], r["rule_id"]) for r in D.detect_indexed(rows, table).collect()}
    want = {(r["row_id"], r["rule_id"]) for r in rows.join(table, "column").filter("value rlike pattern").collect()}
    assert got == want and len(got) > 200 and D.detect_indexed(rows, table).count() == len(got)
    assert {r["rule_id"] for r in D.unused_rules(table, ["c0", "c1"]).collect()} == {f"r{i}" for i in range(300) if i % 3 == 2}
    quality = D.rule_quality(rows.withColumn("bad", F.lit(True)), [D.Rule("a", 1, "gone", "x", ""), D.Rule("b", 1, "value", "x", "")], "bad").collect()
    assert quality[0]["hits"] is None and quality[1]["hits"] > 0


def test_alias_cells_hold_each_rows_share(spark):
    from watchloom.operators.alias import alias_table

    rnd = random.Random(11)
    for weights in ([1] * 7, [5], [1000] + [1] * 600, [rnd.choice([0.25, 1, 3, 17.5]) for _ in range(900)], [10 ** 6, 10 ** 6, 1]):
        pool = spark.createDataFrame([(i, float(w), i % 2) for i, w in enumerate(weights)], "value long, w double, g int").repartition(3)
        for group in ((), ("g",)):
            cells = alias_table(pool, ("value",), F.col("w"), group)[0].collect()
            share = {}
            for c in cells:
                n = c["_n"]
                share[c["_own"]["value"]] = share.get(c["_own"]["value"], 0) + c["_keep"] / n
                if c["_other"] is not None:
                    share[c["_other"]["value"]] = share.get(c["_other"]["value"], 0) + (1 - c["_keep"]) / n
                assert 0 <= c["_keep"] <= 1
            assert len(cells) == len(weights)
            for i, w in enumerate(weights):
                total = sum(x for j, x in enumerate(weights) if not group or j % 2 == i % 2)
                assert abs(share[i] - w / total) < 1e-9
            for g in {c["g"] for c in cells} if group else {None}:
                own = sorted(c["_cell"] for c in cells if g is None or c["g"] == g)
                assert own == list(range(len(own)))


def test_rules_with_flags_behind_an_anchor_meet_few_values(spark):
    rules = spark.range(2000).select(
        F.concat(F.lit("r"), "id").alias("rule_id"), F.lit(1).alias("level"), F.lit("c").alias("column"),
        F.concat(F.lit("^(?i)USER"), "id", F.lit(" did (click|view)$")).alias("pattern"), F.lit("").alias("description"))
    index = D.rule_index(rules).groupBy("gram").count().collect()
    assert None not in {r["gram"] for r in index} and max(r["count"] for r in index) <= 2
    values = spark.range(4000).select(F.col("id").alias("row_id"), F.lit("c").alias("column"), F.concat(F.lit("User"), "id", F.lit(" did view")).alias("value"))
    got = {(r["row_id"], r["rule_id"]) for r in D.detect_indexed(values, rules).collect()}
    assert got == {(i, f"r{i}") for i in range(2000)}


def test_pools_read_their_texts_once(spark):
    from __spark_entry__ import queries

    for name in ("value_pools", "shape_pools", "pools_without_identities", "settled_kinds"):
        files = queries()[name](spark, "/root/testdata/sf0.001").inputFiles()
        assert files and not [f for f in files if "documents.parquet" in f], name


def test_label_predicates_read_the_events_once(spark):
    from __spark_entry__ import queries

    files = queries()["label_predicates"](spark, "/root/testdata/sf0.001").inputFiles()
    assert files and not [f for f in files if "events.parquet" in f]
