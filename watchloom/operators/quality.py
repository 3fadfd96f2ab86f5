"""Checks of exported feeds and tables: each returns the rows that break the rule."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchloom.catalog import dims
from watchloom.catalog.tables import GENERIC
from watchloom.operators.ordered import SERIAL_WIDTH
from watchloom.operators.sequence import time_inversions


def _one_line(line: Column) -> Column:
    return ~line.rlike("[\r\n]")


def auditd_ok(line: Column) -> Column:
    return (line.startswith("type=") | line.startswith("node=")) & _one_line(line)


def fortios_ok(line: Column) -> Column:
    parts = [line.contains(p) for p in (" type=", " time=", " subtype=")]
    return reduce(lambda a, b: a & b, parts) & line.rlike(r"^<\d{1,3}>")


def asa_ok(line: Column) -> Column:
    return line.rlike(r"^<\d{1,3}>.* [A-Za-z][A-Za-z0-9]*: %ASA-\d-\d+: ") & ~line.contains("%FTD")


def idp_ok(line: Column) -> Column:
    present = [F.get_json_object(line, f"$.{k}").isNotNull() for k in ("eventType", "uuid", "published")]
    return reduce(lambda a, b: a & b, present) & _one_line(line)


def winevent_ok(line: Column) -> Column:
    return ~F.regexp_extract(line, r"<EventID>(\d+)</EventID>", 1).isin(*dims.DISCARDED_EVENT_IDS)


def cef_ok(line: Column) -> Column:
    return line.startswith("CEF:0|") & ~line.contains("cs7Label=")


#: feed -> what a line must satisfy
GATES = {
    "auditd": auditd_ok, "fortinet": fortios_ok, "cisco_asa": asa_ok, "okta": idp_ok,
    "winxml": winevent_ok, "cef": cef_ok,
}


def _breaking(df: DataFrame, ok: Column) -> DataFrame:
    return df.filter(~F.coalesce(ok, F.lit(False)))


def gate_auditd(df: DataFrame, line: str = "line") -> DataFrame:
    return _breaking(df, auditd_ok(F.col(line)))


def gate_fortios(df: DataFrame, line: str = "line") -> DataFrame:
    return _breaking(df, fortios_ok(F.col(line)))


def gate_asa(df: DataFrame, line: str = "line") -> DataFrame:
    return _breaking(df, asa_ok(F.col(line)))


def gate_idp(df: DataFrame, line: str = "line") -> DataFrame:
    return _breaking(df, idp_ok(F.col(line)))


def discarded_event_ids(df: DataFrame, line: str = "line") -> DataFrame:
    return _breaking(df, winevent_ok(F.col(line)))


def no_cs7(df: DataFrame, line: str = "line") -> DataFrame:
    return df.filter(F.col(line).contains("cs7Label="))


def gate_summary(df: DataFrame, feed: str = "feed", line: str = "line") -> DataFrame:
    """Lines and lines that break their feed's gate, in one pass over all feeds."""
    ok = F.lit(True)
    for name, gate in GATES.items():
        ok = F.when(F.col(feed) == name, gate(F.col(line))).otherwise(ok)
    return df.groupBy(feed).agg(F.count("*").alias("lines"), F.count_if(~ok).alias("broken"))


def scenario_valid(scenarios: DataFrame) -> DataFrame:
    """Scenario documents without a stage, or stages without a name or events.

    Takes the raw documents of ``read_scenario_documents`` (one row each)."""
    stage_bad = F.exists("stages", lambda s: s["name"].isNull() | (F.coalesce(F.size(s["events"]), F.lit(0)) < 1))
    none = F.coalesce(F.size("stages"), F.lit(0)) < 1
    return scenarios.withColumn(
        "reason", F.when(none, "no stages").when(stage_bad, "stage without name or events")
    ).filter(F.col("reason").isNotNull())


def no_generic_fallback(routed: DataFrame) -> DataFrame:
    return routed.filter(F.col("model") == GENERIC.name)


def labels_present(df: DataFrame) -> list[str]:
    """Label columns an export still carries; must be empty."""
    return [c for c in df.columns if c in dims.LABEL_COLUMNS]


def priority_in_range(df: DataFrame, line: str = "line") -> DataFrame:
    """Lines whose syslog priority is missing or outside 0..191."""
    priority = F.regexp_extract(line, r"^<(\d+)>", 1).try_cast("int")
    return _breaking(df, priority.between(0, 191))


def transition_targets_known(matrix: DataFrame, known: DataFrame, on: str = "next_state") -> DataFrame:
    return matrix.join(known, on, "left_anti")


def conservation(rows_in: DataFrame, rows_out: DataFrame, key: str) -> DataFrame:
    """Rows in and out per key, and whether they agree."""
    a = rows_in.groupBy(key).agg(F.count("*").alias("rows_in"))
    b = rows_out.groupBy(key).agg(F.count("*").alias("rows_out"))
    both = a.join(b, key, "full_outer").na.fill(0, ["rows_in", "rows_out"])
    return both.withColumn("kept", F.col("rows_in") == F.col("rows_out"))


def ordered_output(df: DataFrame, seq: str, ts: str, width: int = SERIAL_WIDTH) -> DataFrame:
    """One row: inversions in serial order and whether there are none."""
    found = time_inversions(df, seq, ts, width)
    return found.select("records", "inversions", (F.col("inversions") == 0).alias("ordered"))


def missing_rows(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Rows that are expected more often than they are there."""
    return expected.exceptAll(actual)
