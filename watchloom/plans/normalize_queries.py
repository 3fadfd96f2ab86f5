"""Normalisation: records to typed tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from watchloom.catalog import dims
from watchloom.catalog.tables import spec_of
from watchloom.functions.text import single_line
from watchloom.operators import normalize as N
from watchloom.operators.profiling import flatten_record
from watchloom.operators.settings import Settings
from watchloom.plans.inputs import EV, events, load, raw_events
from watchloom.plans.registry import query, sql_case, sql_in, sql_uuid
from watchloom.session import checkpoint_dir, stored

RUN = Settings(run_id="run-1")
MODELS = ("process", "signin", "firewall", "cloud_activity", "office_activity", "alert", "generic")

#: class of a raw record in SQL
SQL_MODEL = """CASE WHEN event_type = 'signup' AND k % 9 = 0 THEN 'generic'
    WHEN event_type = 'signup' AND k % 9 = 1 THEN 'alert'
    WHEN event_type = 'click' THEN 'process' WHEN event_type = 'view' THEN 'signin'
    WHEN event_type = 'error' THEN 'firewall' WHEN event_type = 'signup' THEN 'cloud_activity'
    ELSE 'office_activity' END"""


def routed(spark, sf):
    return N.route_event_type(N.flatten_data(raw_events(spark, sf)))


def routed_once(spark, sf):
    """Routed records written split by class: parsed once however many classes are read."""
    return N.materialise_routed(routed(spark, sf), f"{checkpoint_dir(spark)}/routed-{uuid.uuid4()}")


def accepted(spark, sf, name):
    return N.normalize(routed(spark, sf), name, RUN)[0]


@query(f"""
WITH {EV}, doc AS (
  SELECT event_id, 'event_type' AS path, event_type AS value, 'str' AS type FROM ev
  UNION ALL SELECT event_id, 'ctx.user', CAST(user_id AS VARCHAR), 'int' FROM ev
  UNION ALL SELECT event_id, 'ctx.more.k', CAST(k AS VARCHAR), 'int' FROM ev WHERE k % 2 = 0
  UNION ALL SELECT event_id, 'ctx.flag', CASE WHEN k > 50 THEN 'True' ELSE 'False' END, 'bool' FROM ev
  UNION ALL SELECT event_id, 'ctx.tags[]', 'list_len=' || (k % 4), 'str' FROM ev)
SELECT event_id, path, value, type FROM doc""")
def flattened_records(spark, sf):
    ctx = F.concat(
        F.lit('{"event_type":"'), F.col("event_type"), F.lit('","ctx":{"user":'), F.col("user_id"),
        F.when(F.col("k") % 2 == 0, F.concat(F.lit(',"more":{"k":'), F.col("k"), F.lit("}"))).otherwise(""),
        F.lit(',"flag":'), F.when(F.col("k") > 50, "true").otherwise("false"),
        F.lit(',"tags":['), F.array_join(F.array_repeat(F.lit("1"), F.col("k") % 4), ","), F.lit("]}}"))
    docs = events(spark, sf).select("event_id", F.parse_json(ctx).alias("doc"))
    return flatten_record(docs, ("event_id",), "doc")


@query(f"""
WITH {EV}
SELECT event_id AS row_id,
  CASE WHEN k % 2 = 0 THEN 'proc' || k || '.exe' WHEN k % 4 = 1 THEN 'file' || k || '.exe' ELSE 'late' || k || '.exe' END AS file_name,
  CASE WHEN k % 5 = 0 THEN CAST(event_id AS VARCHAR) WHEN k % 10 = 1 THEN 'n/a' ELSE CAST(event_id + 1 AS VARCHAR) END AS process_id,
  CASE WHEN k % 7 > 0 THEN 'run --job ' || k END AS command_line,
  k % 7 > 0 AS has_command_line,
  CASE WHEN k % 4 = 0 THEN 'D:\\apps\\' || k END AS folder_path
FROM ev WHERE event_type = 'click'""")
def input_names_process(spark, sf):
    spec = spec_of("process")
    rows = N.resolve_aliases(routed(spark, sf).filter("model = 'process'"), spec)
    has = F.array_contains("chosen", "command_line")
    return rows.select("row_id", F.coalesce(has, F.lit(False)).alias("has_command_line"), *[
        F.col(f"given_{c}").alias(c) for c in ("file_name", "process_id", "command_line", "folder_path")])


@query(f"""
WITH {EV}
SELECT event_id AS row_id,
  CASE WHEN k % 3 = 0 THEN CASE WHEN k % 11 = 0 THEN NULL ELSE 'user' || user_id || '@corp.test' END
       ELSE 'acct' || user_id || '@corp.test' END AS user_principal_name,
  'acct' || user_id || '@corp.test' AS user_name
FROM ev WHERE event_type = 'view'""")
def input_names_signin(spark, sf):
    """A null under an earlier name beats a value under a later one."""
    rows = N.resolve_aliases(routed(spark, sf).filter("model = 'signin'"), spec_of("signin"))
    return rows.select("row_id", *[
        F.col(f"given_{c}").alias(c) for c in ("user_principal_name", "user_name")])


@query(f"""
WITH {EV}
SELECT event_id AS row_id, CASE WHEN k % 2 = 0 THEN '50126' ELSE '0' END AS result_type,
  'Success' AS result_description, CASE WHEN k % 4 = 0 THEN 'DE' ELSE 'US' END AS location,
  CASE WHEN k % 4 = 0 THEN 'Berlin' ELSE 'Seattle' END AS city, 'Browser' AS client_app_used,
  {sql_uuid("'run-1|' || event_id || '|event_id'")} AS event_id
FROM ev WHERE event_type = 'view'""")
def defaults_signin(spark, sf):
    spec = spec_of("signin")
    rows = N.resolve_aliases(routed(spark, sf).filter("model = 'signin'"), spec)
    rows = N.apply_defaults(rows, spec, RUN)
    return rows.select("row_id", *[F.col(f"given_{c}").alias(c) for c in (
        "result_type", "result_description", "location", "city", "client_app_used", "event_id")])


@query(f"""
WITH {EV}
SELECT event_id AS row_id,
  CASE WHEN k % 2 = 0 THEN 'proc' || k || '.exe' WHEN k % 4 = 1 THEN 'file' || k || '.exe' ELSE 'late' || k || '.exe' END AS file_name,
  CAST(CASE WHEN k % 5 = 0 THEN event_id ELSE event_id + 1 END AS INT) AS process_id,
  'run --job ' || k AS command_line,
  CASE WHEN k % 4 = 0 THEN 'D:\\apps\\' || k ELSE 'C:\\Windows\\System32' END AS folder_path,
  'ProcessCreated' AS action_type, true AS is_signed, 'endpoint' AS source,
  CASE WHEN k % 3 = 0 THEN 'explorer.exe' END AS parent_process_name,
  epoch_us(ts) AS ts_us,
  CAST(10000 + (('0x' || substr(md5('run-1|' || event_id || '|report_id'), 1, 8))::BIGINT % 90000) AS INT) AS report_id
FROM ev WHERE event_type = 'click' AND k % 7 > 0 AND NOT (k % 10 = 1)""")
def accepted_process(spark, sf):
    good = accepted(spark, sf, "process")
    return good.select("row_id", "file_name", "process_id", "command_line", "folder_path", "action_type",
                       "is_signed", "source", "parent_process_name",
                       F.unix_micros("timestamp").alias("ts_us"), "report_id")


@query(f"""
WITH {EV}
SELECT event_id AS row_id, CASE WHEN k % 4 = 0 THEN 'blocked' ELSE 'allowed' END AS action,
  CASE WHEN k % 2 = 0 THEN 'udp' ELSE 'TCP' END AS protocol,
  CAST(49152 + user_id % 16384 AS INT) AS source_port,
  CASE WHEN k % 6 = 0 THEN 80 ELSE 443 END AS dest_port,
  CASE WHEN k % 5 = 0 THEN 'Inbound' ELSE 'Outbound' END AS direction,
  CASE WHEN k % 3 = 0 THEN 'Cisco' ELSE 'fortigate' END AS vendor,
  CASE WHEN k % 2 = 1 THEN CAST(k * 10 AS BIGINT) END AS bytes_sent,
  CASE WHEN k % 2 = 0 THEN 'T' || (1400 + k) END AS technique, true AS is_malicious
FROM ev WHERE event_type = 'error'""")
def accepted_firewall(spark, sf):
    return accepted(spark, sf, "firewall").select(
        "row_id", "action", "protocol", "source_port", "dest_port", "direction", "vendor", "bytes_sent",
        F.col("mitre.technique_id").alias("technique"), "is_malicious")


@query(f"""
WITH {EV}, m AS (SELECT *, {SQL_MODEL} AS model FROM ev), r AS (
  SELECT event_id AS row_id, model, concat_ws(',',
    CASE WHEN model = 'process' AND k % 5 <> 0 AND k % 10 = 1 THEN 'cast:ProcessId' END,
    CASE WHEN model = 'process' AND k % 7 = 0 THEN 'missing:ProcessCommandLine' END,
    CASE WHEN model = 'signin' AND k % 3 = 0 AND k % 11 = 0 THEN 'null:UserPrincipalName' END,
    CASE WHEN model = 'alert' THEN 'missing:AlertName' END) AS reasons FROM m)
SELECT row_id, model, reasons FROM r WHERE reasons <> ''""")
def quarantined_records(spark, sf):
    rows = routed_once(spark, sf)
    out = None
    for name in MODELS:
        bad = N.normalize(rows, name, RUN)[1].select("row_id", "model", F.array_join("reasons", ",").alias("reasons"))
        out = bad if out is None else out.unionByName(bad)
    return out


@query(f"WITH {EV} SELECT event_id AS row_id, {SQL_MODEL} AS model FROM ev")
def routed_event_types(spark, sf):
    return routed(spark, sf).select("row_id", "model")


@query(f"""
WITH {EV} SELECT event_id AS row_id, 'odd_source' AS "SourceSystem", 'mystery' AS "Type"
FROM ev WHERE event_type = 'signup' AND k % 9 = 0""")
def generic_fallback(spark, sf):
    return N.fallback_generic(routed(spark, sf)).select("row_id", "SourceSystem", "Type")


@query(f"""
WITH {EV}, s AS (SELECT event_id, CASE
    WHEN event_type = 'click' THEN 'DeviceProcessEvents' WHEN event_type = 'error' THEN 'network' ELSE 'x' END AS t,
  CASE WHEN event_type = 'error' THEN 'FireWall' WHEN event_type = 'view' THEN 'macos'
    WHEN event_type = 'signup' THEN 'TOTALLY_Unmapped ' || (k % 3) ELSE 'Sentinel_Audit' END AS src FROM ev)
SELECT event_id, CASE WHEN t = 'DeviceProcessEvents' THEN t
  WHEN lower(src) IN {sql_in(dims.SOURCE_TABLES)} THEN {sql_case('lower(src)', dims.SOURCE_TABLES, 'NULL')}
  ELSE 'Unmapped_' || upper(substr(src, 1, 1)) || lower(substr(src, 2)) END AS "table" FROM s""")
def assigned_tables(spark, sf):
    kind = F.col("event_type")
    rows = events(spark, sf).select(
        "event_id",
        F.when(kind == "click", "DeviceProcessEvents").when(kind == "error", "network").otherwise("x").alias("t"),
        F.when(kind == "error", "FireWall").when(kind == "view", "macos")
        .when(kind == "signup", F.concat(F.lit("TOTALLY_Unmapped "), F.col("k") % 3))
        .otherwise("Sentinel_Audit").alias("src"))
    return N.assign_table(rows, "t", "src").select("event_id", "table")


@query(f"""
WITH {EV}
SELECT event_id AS row_id, 'Office 365' AS "SourceSystem", 'OfficeActivity' AS "Type", 'high' AS "AlertSeverity",
  'Exchange' AS "Workload", 'op' || k AS "Operation", 'Message' AS "ItemType", 'user' || user_id AS "UserId",
  '127.0.0.1' AS "ClientIP", CASE WHEN k % 10 > 0 THEN 'WS-' || (user_id % 97) END AS "DeviceName",
  {sql_uuid("'run-1'")} AS "TenantId", 'c' || user_id AS "CorrelationId", 24 AS n_columns
FROM ev WHERE event_type = 'purchase'""")
def public_columns_office(spark, sf):
    """Public names, no label columns; the nested input object has been lifted and wins."""
    table = N.public_table(accepted(spark, sf, "office_activity"), "office_activity")
    return table.select("row_id", "SourceSystem", "Type", "AlertSeverity", "Workload", "Operation", "ItemType",
                        "UserId", "ClientIP", "DeviceName", "TenantId", "CorrelationId",
                        F.lit(len(table.columns) - 1).alias("n_columns"))


@query(f"""
WITH {EV}
SELECT event_id AS row_id, CASE WHEN k % 4 = 0 THEN 'DE' ELSE 'US' END AS country,
  CASE WHEN k % 4 = 0 THEN 'Berlin' ELSE 'Seattle' END AS city
FROM ev WHERE event_type = 'view' AND NOT (k % 3 = 0 AND k % 11 = 0)""")
def derived_location(spark, sf):
    table = N.public_table(accepted(spark, sf, "signin"), "signin")
    return table.select("row_id", F.col("LocationDetails.countryOrRegion").alias("country"), "LocationDetails.city")


@query(f"""
WITH {EV}
SELECT event_id, 'SPF: ' || CASE WHEN k % 2 = 0 THEN 'pass' ELSE 'fail' END || '; DKIM: ' ||
  CASE WHEN k % 3 = 0 THEN 'pass' ELSE 'fail' END || '; DMARC: ' || CASE WHEN k % 5 = 0 THEN 'pass' ELSE 'fail' END
  AS "AuthenticationDetails" FROM ev""")
def derived_mail_auth(spark, sf):
    k = F.col("k")
    rows = events(spark, sf).select(
        "event_id", (k % 2 == 0).alias("spf_pass"), (k % 3 == 0).alias("dkim_pass"), (k % 5 == 0).alias("dmarc_pass"))
    return N.derive_mail_auth(rows)


@query(r"""
SELECT doc_id, md5(t) AS digest, CAST(length(t) AS INT) AS n
FROM (SELECT doc_id, trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g')) AS t FROM documents)""")
def single_line_texts(spark, sf):
    text = single_line(F.col("text"), unicode_space=False)
    return load(spark, sf, "documents").select("doc_id", F.md5(text).alias("digest"), F.length(text).alias("n"))


@query(f"""
SELECT event_id, {sql_uuid("'run-7|' || event_id || '|id'")} AS "Id",
  CASE WHEN event_type = 'error' THEN 'kept' ELSE {sql_uuid("'run-7|' || event_id || '|correlation'")} END AS "CorrelationId",
  {sql_uuid("'run-7'")} AS "TenantId" FROM events""")
def stable_ids(spark, sf):
    rows = events(spark, sf).select(
        "event_id", F.when(F.col("event_type") == "error", "kept").alias("CorrelationId"))
    return N.stable_ids(rows, "run-7", "event_id")


@query(f"""
WITH {EV}, f AS (SELECT k, event_id FROM ev WHERE event_type = 'error')
SELECT 'malicious' AS predicate, count(*) AS n FROM f
UNION ALL SELECT 'phase', count(*) FROM f WHERE k % 2 = 0
UNION ALL SELECT 'technique', count(*) FROM f WHERE k IN (4, 6)
UNION ALL SELECT 'severity', count(*) FROM f WHERE event_id % 5 IN (0, 1)
UNION ALL SELECT 'table', count(*) FROM f""")
def label_predicates(spark, sf):
    labels = ("is_malicious", "killchain_phase", "mitre", "severity", "table")
    # written once: five predicates read it
    rows = stored(N.assign_table(accepted(spark, sf, "firewall")).select(*labels))
    picks = {
        "malicious": N.filter_malicious(rows), "phase": N.by_phase(rows, "impact"),
        "technique": N.by_technique(rows, "T1404", "T1406"),
        "severity": N.by_severity(rows, "critical", "high"), "table": N.by_table(rows, "CommonSecurityLog"),
    }
    out = None
    for name, part in picks.items():
        one = part.agg(F.count("*").alias("n")).select(F.lit(name).alias("predicate"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""
WITH {EV}
SELECT {SQL_MODEL} AS model, 'colour' AS "key", count(*) AS records FROM ev
WHERE event_type = 'signup' AND k % 2 = 0 GROUP BY 1
UNION ALL SELECT m, x, count(*) FROM (SELECT {SQL_MODEL} AS m,
    unnest(CASE WHEN k % 2 = 0 THEN ['operation_name', 'resource_id', 'caller', 'user_identity_type']
           ELSE ['operation_name', 'resource_id', 'caller'] END) AS x
  FROM ev WHERE event_type = 'signup' AND k % 9 < 2) GROUP BY 1, 2""")
def unknown_input_keys(spark, sf):
    return N.unknown_key_report(routed(spark, sf))


@query(f"""
WITH {EV}, m AS (SELECT *, {SQL_MODEL} AS model FROM ev)
SELECT CASE model WHEN 'process' THEN 'DeviceProcessEvents' WHEN 'signin' THEN 'SigninLogs'
    WHEN 'firewall' THEN 'CommonSecurityLog' WHEN 'cloud_activity' THEN 'AzureActivity'
    WHEN 'office_activity' THEN 'OfficeActivity' ELSE 'Unmapped_Odd_source' END AS "table",
  count(*) AS records FROM m
WHERE NOT (model = 'process' AND ((k % 5 <> 0 AND k % 10 = 1) OR k % 7 = 0))
  AND NOT (model = 'signin' AND k % 3 = 0 AND k % 11 = 0) AND model <> 'alert' GROUP BY 1""")
def unified_feed_counts(spark, sf):
    """All accepted tables as one JSON feed, counted by table."""
    from watchloom.operators.feeds import export_json

    rows = routed_once(spark, sf)
    out = None
    for name in MODELS:
        lines = export_json(N.normalize(rows, name, RUN)[0], name)
        out = lines if out is None else out.unionByName(lines)
    return out.groupBy("table").agg(F.count("*").alias("records"))
