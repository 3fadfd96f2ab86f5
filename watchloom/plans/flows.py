"""End-to-end plans: raw records to tables, feeds and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchloom.functions.severity import cef_severity, syslog_priority
from watchloom.operators import normalize as N
from watchloom.operators.feeds import export_run  # noqa: F401 - part of the run
from watchloom.operators.ordered import SERIAL_WIDTH, running_max_before
from watchloom.operators.rowprogram import accepted_rows
from watchloom.operators.settings import Settings
from watchloom.plans.inputs import EV, raw_events
from watchloom.plans.normalize_queries import MODELS, RUN, SQL_MODEL
from watchloom.plans.registry import query, sql_case
from watchloom.session import materialise

#: columns that the report needs of every class
BASE = ("timestamp", "source", "event_type", "severity")


def normalise_run(raw: DataFrame, models: Sequence[str], settings: Settings = Settings(),
                  routed_path: str | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """Raw records to one table per class plus the quarantine of all.

    With ``routed_path`` the routed records are written split by class first, so the input is
    parsed once whatever the number of classes; without it the caller should cache ``raw`` when
    several classes are asked for.
    """
    routed = N.route_event_type(N.flatten_data(raw))
    if routed_path:
        routed = N.materialise_routed(routed, routed_path)
    tables, refused = {}, None
    for name in models:
        good, bad = N.normalize(routed, name, settings)
        tables[name] = good
        refused = bad if refused is None else refused.unionByName(bad)
    return tables, refused


_NOT_OK = "(model = 'process' AND ((k % 5 <> 0 AND k % 10 = 1) OR k % 7 = 0)) OR (model = 'signin' AND k % 3 = 0 AND k % 11 = 0) OR model = 'alert'"
_PRIORITY = {0: 10, 1: 11, 2: 12, 3: 13, 4: 14}
_CEF = {0: 10, 1: 8, 2: 5, 3: 3, 4: 1}


@query(f"""
WITH {EV}, m AS (SELECT *, {SQL_MODEL} AS model FROM ev), g AS (SELECT *, max(epoch_us(ts) - CASE WHEN event_id % 9 = 4 THEN 660000000 ELSE 0 END)
    OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen,
  epoch_us(ts) - CASE WHEN event_id % 9 = 4 THEN 660000000 ELSE 0 END AS us FROM m WHERE NOT ({_NOT_OK}))
SELECT CASE model WHEN 'process' THEN 'DeviceProcessEvents' WHEN 'signin' THEN 'SigninLogs'
    WHEN 'firewall' THEN 'CommonSecurityLog' WHEN 'cloud_activity' THEN 'AzureActivity'
    WHEN 'office_activity' THEN 'OfficeActivity' ELSE 'Unmapped_Odd_source' END AS "table",
  us // 3600000000 AS hour, count(*) AS events, count(*) FILTER (us < seen) AS late,
  CAST(min(CASE WHEN model = 'office_activity' THEN 11 ELSE {sql_case('event_id % 5', _PRIORITY, '0')} END) AS INT) AS top_priority,
  CAST(max(CASE WHEN model = 'office_activity' THEN 8 ELSE {sql_case('event_id % 5', _CEF, '0')} END) AS INT) AS top_severity,
  round(count(*) FILTER (us < seen)::DOUBLE / count(*), 6) AS late_share
FROM g GROUP BY ALL""")
def telemetry_by_hour(spark: SparkSession, sf: str) -> DataFrame:
    """Accepted telemetry per table and hour: volume, most urgent priority and severity, and the
    share of events that arrive after a later-stamped one."""
    routed = N.route_event_type(N.flatten_data(raw_events(spark, sf)))
    rows = N.assign_table(accepted_rows(routed, MODELS, RUN, ("row_id", "model"), only=BASE))
    drift = F.when(F.col("row_id") % 9 == 4, 660_000_000).otherwise(0)
    stamped = rows.select("row_id", "table", "severity", (F.unix_micros("timestamp") - drift).alias("us"))
    # the running maximum reads its input twice: once whole, once for its range summaries
    marked = running_max_before(materialise(stamped), "row_id", "us", "seen", SERIAL_WIDTH)
    return marked.groupBy("table", F.floor(F.col("us") / 3_600_000_000).alias("hour")).agg(
        F.count("*").alias("events"),
        F.count_if(F.col("us") < F.col("seen")).alias("late"),
        F.min(syslog_priority(F.lit("user"), F.col("severity"))).alias("top_priority"),
        F.max(cef_severity(F.col("severity"))).alias("top_severity"),
    ).withColumn("late_share", F.round(F.col("late") / F.col("events"), 6))
