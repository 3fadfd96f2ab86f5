"""Accepted rows, input names, defaults, quarantine, table names."""

from pyspark.sql import functions as F

from watchloom.catalog import dims
from watchloom.catalog.tables import GENERIC, REGISTRY, spec_of
from watchloom.operators import normalize as N
from watchloom.operators import quality as Q


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def reasons(bad):
    return [list(r["reasons"]) for r in bad.collect()]


def test_catalog_is_complete():
    assert len(REGISTRY) == 32 and len(dims.EVENT_TYPES) == 36 and len(dims.SOURCE_TABLES) == 20
    assert len(dims.WINEVENT_ROUTES) >= 130
    assert set(dims.EVENT_TYPES.values()) == set(REGISTRY)
    assert len({p[0] for p in dims.PERSONAS}) == len(dims.PERSONAS)


def test_process_row(accept):
    good, bad = accept("process", "process_creation", {
        "FileName": "cmd.exe", "ProcessId": 1234, "ProcessCommandLine": "cmd.exe /c whoami"})
    row = one(good)
    assert row["source"] == "endpoint" and row["event_type"] == "DeviceProcessEvents"
    assert row["process_id"] == 1234 and row["folder_path"] == "C:\\Windows\\System32"
    assert row["is_signed"] is True and row["timestamp"] is not None and row["data"] == {}
    assert bad.count() == 0


def test_missing_required_column_is_quarantined(accept):
    good, bad = accept("process", "process_creation", {"FileName": "cmd.exe", "ProcessId": 1})
    assert good.count() == 0 and reasons(bad) == [["missing:ProcessCommandLine"]]


def test_uncastable_and_lax_numbers(accept):
    base = {"FileName": "a", "ProcessCommandLine": "a"}
    good, bad = accept("process", "process_creation", {**base, "ProcessId": "x1"}, {**base, "ProcessId": " 12.0"})
    assert [r["process_id"] for r in good.collect()] == [12]
    assert reasons(bad) == [["cast:ProcessId"]]


def test_signin_takes_the_first_present_name(accept):
    good, bad = accept(
        "signin", "authentication", {"user_name": "legacy@test.com"},
        {"UserPrincipalName": "a@b.c", "user_name": "d@e.f"}, {"user_name": None, "user_principal_name": "a"})
    got = {r["row_id"]: r["user_principal_name"] for r in good.collect()}
    assert got == {0: "legacy@test.com", 1: "a@b.c"}
    assert reasons(bad) == [["null:UserPrincipalName"]]


def test_firewall_alert_incident_dns_and_mail_defaults(accept):
    fw = one(accept("firewall", "network_connection", {
        "DeviceAction": "blocked", "Protocol": "TCP", "SourcePort": 12345, "DestinationPort": 443})[0])
    assert fw["direction"] == "Outbound" and fw["vendor"] == "fortigate"
    assert one(accept("alert", "security_alert", {"AlertName": "x", "severity": "High"})[0])["confidence_level"] == "High"
    inc = one(accept("incident", "security_incident", {"Title": "x"})[0])
    assert (inc["status"], inc["owner"]) == ("New", "Unassigned") and inc["incident_number"].startswith("INC")
    assert one(accept("dns", "dns_query", {"Name": "example.com"})[0])["query_type"] == "A"
    mail = one(accept("email", "email_event", {"sender": "a@b.c", "recipient": "d@e.f", "subject": "s"})[0])
    assert mail["attachment_verdict"] == "NoAttachment" and mail["detection_method"] == "None"


def test_linux_rows_carry_their_platform(accept):
    row = one(accept("linux_auth", "linux_auth", {
        "pid": 1234, "proc": "sshd", "Message": "Failed password for root from 10.0.0.1 port 22 ssh2"})[0])
    assert row["os_platform"] == "Linux" and row["device_category"] == "Server" and row["source"] == "linux"


def test_every_class_accepts_its_minimum(accept):
    sample = {"int": "1", "long": "1", "float": "1", "bool": "true"}
    event_of = {}
    for event_type, name in dims.EVENT_TYPES.items():
        event_of.setdefault(name, event_type)
    for name in ("vpn", "web", "database", "cloud_app", "service_signin", "identity_logon", "macos_exec", "linux_process"):
        fields = {c.public: sample.get(c.kind, "x") for c in spec_of(name).columns if c.required}
        good, bad = accept(name, event_of[name], fields)
        assert good.count() == 1, (name, reasons(bad))
        public = N.public_table(good, name)
        assert len(set(public.columns)) == len(public.columns)


def test_nested_data_wins_and_source_decides(records):
    raw = records({"event_type": "Office_Activity", "source": "x", "Workload": "a", "data": '{"Workload": "b", "Operation": "c"}'},
                  {"event_type": "whatever", "source": "ALERT"}, {"event_type": "New", "source": "Odd"})
    routed = N.route_event_type(N.flatten_data(raw))
    rows = {r["row_id"]: r for r in routed.collect()}
    assert rows[0]["raw"]["Workload"] == "b" and rows[0]["raw"]["Operation"] == "c" and "data" not in rows[0]["raw"]
    assert [rows[i]["model"] for i in range(3)] == ["office_activity", "alert", "generic"]
    assert one(N.fallback_generic(routed))["SourceSystem"] == "odd"
    assert Q.no_generic_fallback(routed).count() == 1
    generic = one(N.normalize(routed, GENERIC.name)[0])
    assert (generic["source"], generic["event_type"]) == ("odd", "new")


def test_table_names(spark):
    df = spark.createDataFrame(
        [("totally_unmapped_source", "SomeNewThing"), ("x", "DnsEvents"), ("MacOS", "macos_log"), ("sentinel_audit", "audit")],
        "source string, event_type string")
    assert [r["table"] for r in N.assign_table(df).collect()] == [
        "Unmapped_Totally_unmapped_source", "DnsEvents", "Syslog", "SentinelAudit"]


def test_nested_columns_and_pinned_values(accept):
    base = {"DeviceAction": "a", "Protocol": "TCP", "SourcePort": 1, "DestinationPort": 2}
    good, bad = accept(
        "firewall", "network_connection",
        {**base, "mitre": '{"tactic":"t","technique_id":"T1","technique_name":"n"}', "ExtendedProperties": '{"a": 1}'},
        {**base, "mitre": '{"tactic":"t"}'}, {**base, "SourceSystem": "Other"})
    row = one(good)
    assert row["mitre"]["technique_id"] == "T1" and row["data"] == {"a": "1"}
    assert reasons(bad) == [["cast:mitre"], ["value:SourceSystem"]]


def test_timestamps_read_iso_and_epoch(accept):
    times = ("2026-09-01T13:45:30Z", "1788270330", "1788270330000")
    good, _ = accept("dns", "dns_query", *[{"Name": "a", "timestamp": t} for t in times])
    assert {r["s"] for r in good.select(F.unix_seconds("timestamp").alias("s")).collect()} == {1788270330}


def test_ids_are_unique_and_stable(accept):
    rows = [{"Name": "a"}] * 5
    first = [r["event_id"] for r in accept("dns", "dns_query", *rows)[0].collect()]
    again = [r["event_id"] for r in accept("dns", "dns_query", *rows)[0].collect()]
    assert len(set(first)) == 5 and first == again


def test_public_columns_drop_labels_and_inputs(accept):
    good, _ = accept("signin", "authentication", {"UserPrincipalName": "a@b.c", "location": "DE", "is_malicious": "true"})
    table = N.public_table(good, "signin")
    assert not Q.labels_present(table) and not {"Location", "City", "MfaMethod", "location"} & set(table.columns)
    assert one(table)["LocationDetails"]["countryOrRegion"] == "DE"
    mail = N.public_table(accept("email", "email_event", {
        "sender": "a", "recipient": "b", "subject": "c", "dkim_pass": "false"})[0], "email")
    assert one(mail)["AuthenticationDetails"] == "SPF: pass; DKIM: fail; DMARC: pass"
    sudo = N.public_table(accept("linux_sudo", "linux_sudo", {"pid": 1, "user": "bob", "command": "id"})[0], "linux_sudo")
    assert one(sudo)["AccountName"] == "bob"


def test_unknown_keys_are_counted(records):
    raw = records({"event_type": "dns_query", "Name": "a", "colour": "x"}, {"event_type": "dns_query", "Name": "a", "colour": "y"})
    got = [(r["model"], r["key"], r["records"]) for r in N.unknown_key_report(N.route_event_type(raw)).collect()]
    assert got == [("dns", "colour", 2)]


def test_normalising_again_changes_nothing(accept, spark):
    good, _ = accept("dns", "dns_query", {"Name": "a", "QueryType": "MX", "hostname": "h"})
    row = one(good)
    again, _ = accept("dns", "dns_query", {
        "Name": row["query_name"], "QueryType": row["query_type"], "DeviceName": row["hostname"], "Id": row["event_id"],
        "CorrelationId": row["correlation_id"], "TimeGenerated": row["timestamp"].isoformat() + "Z", "TenantId": row["tenant_id"]})
    new = one(again)
    assert {c: row[c] for c in good.columns} == {c: new[c] for c in good.columns}


def test_routed_records_can_be_written_by_class(records, tmp_path):
    raw = records({"event_type": "dns_query", "Name": "a"}, {"event_type": "dns_query", "Name": "b"}, {"event_type": "audit", "action": "x"})
    routed = N.materialise_routed(N.route_event_type(raw), str(tmp_path / "routed"))
    assert N.normalize(routed, "dns")[0].count() == 2 and N.normalize(routed, "workspace_audit")[0].count() == 1


def test_a_class_query_normalises_once_and_compiles(spark, tmp_path):
    from pathlib import Path

    from watchloom.plans.class_queries import PLAYS, _run
    from watchloom.session import JIT_LIMIT

    data = Path("/root/testdata/sf0.001")
    if not data.exists():
        pytest.skip("no test data")
    key = "spark.sql.codegen.hugeMethodLimit"
    spark.conf.set(key, "65535")
    try:
        out = _run(next(p for p in PLAYS if p.name == "email"))(spark, str(data))
        assert int(spark.conf.get(key)) == JIT_LIMIT
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "map_from_entries" not in plan and "get_json_object" not in plan
    finally:
        spark.conf.set(key, str(JIT_LIMIT))


def test_times_and_flags_in_all_spellings(spark):
    from watchloom.catalog.tables import spec_of
    from watchloom.operators.normalize import lax_cast

    columns = spec_of("email").columns
    moment = next(c for c in columns if c.kind == "time")
    flag = next(c for c in columns if c.kind == "bool")
    texts = ["1700000000", "1700000000000", "-5.5", "2024-01-02 03:04:05", "x", "", None, "1e5", "12\n", " 7"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert "RLIKE" in lax_cast("t", moment)  # a text that is no number is never cast to one
    got = [r[0] for r in rows.selectExpr(f"unix_millis({lax_cast('t', moment)})").collect()]
    assert got == [1700000000000, 1700000000000, -5500, 1704164645000, None, None, None, None, 12000, None]
    flags = spark.createDataFrame([(t,) for t in ["true", "false", " TRUE ", "Yes", "n", "0", "maybe", "", None]], "t string")
    assert [r[0] for r in flags.selectExpr(lax_cast("t", flag)).collect()] == [True, False, True, True, False, False, None, None, None]
