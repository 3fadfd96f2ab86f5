"""The given tables in the shape of telemetry.

``events`` plays the raw event log: five kinds of records for five event classes, with input
names, missing, null and unreadable values varying with the number in ``props``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchloom.session import compiled, dealt


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    # the given tables hold UTC stamps; a session that is in UTC already is left as it is
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return compiled(spark).read.parquet(f"{sf}/{name}.parquet")


def events(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "events")
    return rows.withColumn("k", F.get_json_object("props", "$.k").cast("int"))


#: the same view for the SQL equivalents
EV = "ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)"

KINDS = {
    "click": ("process_creation", "endpoint"),
    "view": ("authentication", "Azure AD"),
    "error": ("network_connection", "Firewall"),
    "signup": ("cloud_activity", "Azure"),
    "purchase": ("office_activity", "Office 365"),
}
TABLE_OF = {
    "click": "DeviceProcessEvents", "view": "SigninLogs", "error": "CommonSecurityLog",
    "signup": "AzureActivity", "purchase": "OfficeActivity",
}

#: kind -> (input name, when it is present, value); both parts are SQL over the event
FIELDS = {
    "": (
        ("event_type", "true", "CASE WHEN event_type = 'signup' AND k % 9 = 0 THEN 'Mystery' ELSE kind_type END"),
        ("source", "true",
         "CASE WHEN event_type = 'signup' AND k % 9 = 0 THEN 'Odd_Source' "
         "WHEN event_type = 'signup' AND k % 9 = 1 THEN 'Alert' ELSE kind_source END"),
        ("timestamp", "true", "CAST(ts AS STRING)"),
        ("severity", "true", "element_at(array('critical', 'High', 'medium', 'LOW', 'informational'), CAST(event_id % 5 + 1 AS INT))"),
        ("is_malicious", "event_type = 'error'", "'true'"),
        ("correlation_id", "true", "concat('c', user_id)"),
        ("hostname", "k % 10 > 0", "concat('WS-', user_id % 97)"),
        ("source_ip", "true", "concat('10.', user_id % 200, '.', k, '.7')"),
        ("dest_ip", "k % 8 > 0", "CASE WHEN k % 3 = 0 THEN concat('203.0.113.', k) ELSE concat('192.168.1.', k) END"),
    ),
    "click": (
        ("process_name", "k % 2 = 0", "concat('proc', k, '.exe')"),
        ("FileName", "k % 4 = 1", "concat('file', k, '.exe')"),
        ("file_name", "k % 4 = 3", "concat('late', k, '.exe')"),
        ("ProcessId", "k % 5 = 0", "CAST(event_id AS STRING)"),
        ("process_id", "true", "CASE WHEN k % 10 = 1 THEN 'n/a' ELSE CAST(event_id + 1 AS STRING) END"),
        ("command_line", "k % 7 > 0", "concat('run --job ', k)"),
        ("image_path", "k % 4 = 0", r"concat('D:\\apps\\', k)"),
        ("parent_process_name", "k % 3 = 0", "'explorer.exe'"),
    ),
    "view": (
        ("user_name", "k % 3 = 0", "CASE WHEN k % 11 = 0 THEN NULL ELSE concat('user', user_id, '@corp.test') END"),
        ("AccountName", "true", "concat('acct', user_id, '@corp.test')"),
        ("status", "k % 2 = 0", "'50126'"),
        ("location", "k % 4 = 0", "'DE'"),
        ("city", "k % 4 = 0", "'Berlin'"),
    ),
    "error": (
        ("action", "true", "CASE WHEN k % 4 = 0 THEN 'blocked' ELSE 'allowed' END"),
        ("protocol", "true", "CASE WHEN k % 2 = 0 THEN 'udp' ELSE 'TCP' END"),
        ("source_port", "true", "CAST(49152 + user_id % 16384 AS STRING)"),
        ("dest_port", "true", "CASE WHEN k % 6 = 0 THEN '80' ELSE '443' END"),
        ("direction", "k % 5 = 0", "'Inbound'"),
        ("vendor", "k % 3 = 0", "'Cisco'"),
        ("bytes_sent", "k % 2 = 1", "CAST(k * 10 AS STRING)"),
        ("mitre", "k % 2 = 0",
         "concat('{\"tactic\":\"Impact\",\"technique_id\":\"T', 1400 + k, '\",\"technique_name\":\"n', k, '\"}')"),
        ("killchain_phase", "true", "CASE WHEN k % 2 = 0 THEN 'impact' ELSE 'reconnaissance' END"),
    ),
    "signup": (
        ("operation_name", "true", "concat('op', k)"),
        ("resource_id", "true", "concat('/r/', user_id)"),
        ("user_identity_type", "k % 2 = 0", "'app'"),
        ("caller", "true", "concat('u', user_id)"),
        ("colour", "k % 2 = 0", "'red'"),
    ),
    "purchase": (
        ("data", "true",
         "concat('{\"workload\":\"Exchange\",\"operation\":\"op', k, '\",\"item_type\":\"Message\",\"user_key\":\"user', user_id, '\",\"severity\":\"high\"}')"),
    ),
}


def _record() -> str:
    entries = ", ".join(
        f"named_struct('key', '{name}', 'value', {value}, 'given', "
        + (f"({when})" if not kind else f"event_type = '{kind}' AND ({when})") + ")"
        for kind, fields in FIELDS.items() for name, when, value in fields)
    return f"map_from_entries(transform(filter(array({entries}), e -> e.given), e -> struct(e.key, e.value)))"


def raw_events(spark: SparkSession, sf: str) -> DataFrame:
    """``row_id, raw`` records of the event log (and the event they come from)."""
    ev = dealt(events(spark, sf))
    kind_type = F.expr("CASE event_type " + " ".join(f"WHEN '{k}' THEN '{t}'" for k, (t, _) in KINDS.items()) + " END")
    kind_source = F.expr("CASE event_type " + " ".join(f"WHEN '{k}' THEN '{s}'" for k, (_, s) in KINDS.items()) + " END")
    return ev.withColumn("kind_type", kind_type).withColumn("kind_source", kind_source).select(
        F.col("event_id").alias("row_id"), F.expr(_record()).alias("raw"))


def typed_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events with the table their kind stands for, for operators that need no raw record."""
    table = F.expr("CASE event_type " + " ".join(f"WHEN '{k}' THEN '{t}'" for k, t in TABLE_OF.items()) + " END")
    return events(spark, sf).withColumn("table", table)


def sql_table_of(col: str = "event_type") -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN '{t}'" for k, t in TABLE_OF.items()) + " END"
