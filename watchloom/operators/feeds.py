"""Tables to log feeds.

Each job takes the accepted rows of one class (attribute names) and yields
``table, ts, feed, line``. ``feed_lines`` renders all feeds of a class in one pass over its rows.
"""

from __future__ import annotations

import shlex
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from watchloom.catalog import dims
from watchloom.catalog.model import ColumnSpec
from watchloom.catalog.feeds import DEFAULT_SYSLOG, DEFAULT_WINEVENT, SyslogFormat, VendorFormat, WinEventFormat
from watchloom.catalog.tables import GENERIC, spec_of
from watchloom.functions import sqltext as T
from watchloom.functions.hashing import stable_uuid_sql, uuid5_hex_sql
from watchloom.operators.normalize import table_name
from watchloom.operators.ordered import global_rank
from watchloom.operators.rowprogram import given_texts, judged, wide_name, wide_rows
from watchloom.operators.settings import Settings
from watchloom.session import materialise

CEF_SLOTS = 6
#: columns that have a place of their own in a CEF line or are left out of it (fixed values)
CEF_CONSUMED = (
    "TimeGenerated", "SourceSystem", "Type", "AlertSeverity", "IPAddress", "DestinationIP",
    "AccountName", "DeviceName", "CorrelationId", "Id", "TenantId", "OSPlatform",
    "DeviceCategory", "IsManaged", "AccountSid",
)
MITRE_SLOTS = (("MitreTactic", "tactic"), ("MitreTechniqueId", "technique_id"),
               ("MitreTechniqueName", "technique_name"))


def _fill(text: str, name: str, settings: Settings, let: dict | None = None) -> str:
    """A format text with its slots filled from the columns of a class, as SQL."""
    known, extra = spec_of(name).by_attr, let or {}

    def value(slot: str) -> str:
        if slot in extra:
            return T.printed(extra[slot])
        if slot in known:
            return T.printed(slot, known[slot].kind)
        return T.lit(settings.vendor)

    slots = T.slots(text)
    return T.template(text, {slot: value(slot) for slot in slots}) if slots else T.lit(text)


# --- one line per row, as SQL -------------------------------------------------------------

def syslog_sql(name: str, settings: Settings) -> str:
    fmt: SyslogFormat = spec_of(name).feeds.get("syslog", DEFAULT_SYSLOG)
    fill = lambda text: _fill(text, name, settings, fmt.let)
    priority = T.syslog_priority(fmt.facility, fmt.severity)
    host, tag, message = T.or_default(fmt.host_column, fmt.host), fill(fmt.tag), fill(fmt.message)
    if settings.syslog_format == "rfc5424":
        return (f"concat('<', {priority}, '>1 ', {T.iso_ts('timestamp')}, ' ', {host}, ' ', {tag}, ' ', "
                f"{fmt.pid}, ' - - ', {message})")
    return (f"concat('<', {priority}, '>', date_format(timestamp, 'MMM dd HH:mm:ss'), ' ', {host}, ' ', {tag}, "
            f"'[', {fmt.pid}, ']: ', {message})")


def winevent_sql(name: str, settings: Settings) -> str:
    """One Windows event as single-line XML; data without a value are left out."""
    fmt: WinEventFormat = spec_of(name).feeds.get("winevent", DEFAULT_WINEVENT)
    data = ", ".join(
        f"concat({T.lit(f'<Data Name={chr(39)}{label}{chr(39)}>')}, {T.xml_escape(f'CAST({sql} AS STRING)')}, '</Data>')"
        for label, sql in fmt.data)
    provider, channel = (T.xml_escape(_fill(part, name, settings)) for part in fmt.origin)
    host = T.xml_escape(T.or_default(fmt.host_column, fmt.host))
    stamp = "date_format(timestamp, \"yyyy-MM-dd'T'HH:mm:ss.'000Z'\")"
    return f"""concat(
        "<Event xmlns='http://schemas.microsoft.com/win/2004/08/events/event'><System><Provider Name='", {provider},
        "'/><EventID>", {fmt.event_id}, '</EventID><Version>0</Version><Level>', {T.evt_level(fmt.severity)},
        "</Level><TimeCreated SystemTime='", {stamp}, "'/><Channel>", {channel}, '</Channel><Computer>', {host},
        '</Computer><Security/></System><EventData>', concat_ws('', {data}), '</EventData></Event>')"""


def writes_winevents(source: Column) -> Column:
    """Appliances, web servers and cloud services never write Windows events."""
    return ~F.lower(source).isin(*dims.NON_WINDOWS_SOURCES)


MAIL_AUTH = ("concat('SPF: ', if(spf_pass, 'pass', 'fail'), '; DKIM: ', if(dkim_pass, 'pass', 'fail'), "
             "'; DMARC: ', if(dmarc_pass, 'pass', 'fail'))")


def cef_fields(name: str) -> list[tuple[str, str]]:
    """(label, SQL text value) of the scalars that compete for custom strings, in column order."""
    spec = spec_of(name)
    own = {c.public: c for c in spec.columns if not c.hidden}
    shown = {"time": lambda a: f"replace({T.iso_ts(a)}, 'T', ' ')",
             "bool": lambda a: f"CASE WHEN {a} THEN 'True' WHEN NOT {a} THEN 'False' END"}
    fields = [
        (public, shown.get(c.kind, lambda a: f"CAST({a} AS STRING)")(c.attr)) for public, c in own.items()
        if public not in (*CEF_CONSUMED, *dims.LABEL_COLUMNS)
        and c.kind in ("str", "int", "long", "float", "bool", "time")
    ]
    return fields + ([("AuthenticationDetails", MAIL_AUTH)] if "spf_pass" in spec.by_attr else [])


def fit_slots(fields: Column, taken: Column | int = 0, slots: int = CEF_SLOTS) -> tuple[Column, Column]:
    """(fields that fit the remaining slots, names of the others); nulls take no slot."""
    taken = F.lit(taken) if isinstance(taken, int) else taken
    present = F.filter(fields, lambda f: f["value"].isNotNull())
    room = F.lit(slots) - taken
    kept = F.slice(present, F.lit(1), room)
    dropped = F.transform(
        F.slice(present, room + 1, F.greatest(F.size(present), F.lit(1))), lambda f: f["label"])
    return kept, dropped


def cef_line(name: str, settings: Settings) -> tuple[Column, Column]:
    """(CEF line, names of the columns that found no custom string)."""
    listed = ", ".join(
        f"named_struct('label', {T.lit(label)}, 'value', {T.cef_escape(value)})" for label, value in cef_fields(name))
    fields = F.expr(f"array({listed})" if listed else "CAST(array() AS array<struct<label:string,value:string>>)")
    taken = F.expr(f"if(mitre IS NULL, 0, {len(MITRE_SLOTS)})")
    kept, dropped = fit_slots(fields, taken)
    slots = F.transform(kept, lambda f, i: F.concat(
        F.lit("cs"), i + taken + 1, F.lit("Label="), f["label"], F.lit(" cs"), i + taken + 1, F.lit("="), f["value"]))
    pair = lambda key, col: f"if(coalesce({col}, '') = '' OR startswith({col}, '='), NULL, concat('{key}=', {col}))"
    fixed = ", ".join([
        "concat('rt=', unix_millis(timestamp))", pair("src", "source_ip"), pair("dst", "dest_ip"),
        pair("suser", "user_name"), pair("shost", "hostname"), pair("msg", "scenario_id"),
        pair("externalId", "correlation_id"),
        *[f"concat('cs{i}Label={label} cs{i}=', mitre.{part})" for i, (label, part) in enumerate(MITRE_SLOTS, 1)]])
    vendor = T.lit(settings.vendor)
    product = "concat(upper(substring(source, 1, 1)), lower(substring(source, 2)))"
    head = (f"concat('CEF:0|', {vendor}, '|', {product}, '|1.1|', event_type, '|', {vendor}, ' ', event_type, "
            f"' event|', {T.cef_severity('severity')}, '|')")
    return F.concat(F.expr(head), F.concat_ws(" ", F.expr(f"concat_ws(' ', {fixed})"), slots)), dropped


@F.pandas_udf(ArrayType(StringType()))
def argv_split(text: pd.Series) -> pd.Series:
    """Shell-style argument split; plain blanks when the quoting does not close."""
    def split(value):
        if value is None:
            return None
        try:
            return shlex.split(value)
        except ValueError:
            return value.split()

    return text.map(split)


def auditd_lines(name: str, settings: Settings, serial: str = "serial") -> Column | None:
    """Array of the records of a row; the records of one event share its serial."""
    fmt = spec_of(name).feeds.get("auditd")
    if fmt is None:
        return None
    fill = lambda text: _fill(text, name, settings, fmt.let)
    millis = "floor((unix_micros(timestamp) + 500) / 1000)"
    stamp = (f"concat(' msg=audit(', format_string('%d.%03d', CAST(floor({millis} / 1000) AS BIGINT), "
             f"CAST(pmod({millis}, 1000) AS BIGINT)), ':', {serial}, '): ')")
    first = F.expr(f"concat('type=', {fmt.record}, {stamp}, {fill(fmt.fields)})")
    if not fmt.argv:
        return F.array(first)
    split = argv_split(F.col(fmt.argv))
    argv = F.when(F.size(split) == 0, F.array(F.expr(fill("{comm}")))).otherwise(split)
    listed = F.transform(argv, lambda a, i: F.concat(F.lit("a"), i, F.lit('="'), a, F.lit('"')))
    return F.array(first, F.concat(
        F.expr(f"concat('type=EXECVE', {stamp}, 'argc=')"), F.size(argv), F.lit(" "), F.array_join(listed, " ")))


def vendor_line(name: str, settings: Settings) -> tuple[Column, Column] | None:
    """(vendor feed, line); a session came off one appliance, so there is at most one."""
    formats = spec_of(name).feeds.get("vendor")
    if not formats:
        return None

    def line(fmt: VendorFormat) -> str:
        let = {k: v.replace("__uuid", stable_uuid_sql("concat(event_id, '|idp')")).replace(
            "__actor", uuid5_hex_sql("user_principal_name")) for k, v in fmt.let.items()}
        return _fill(fmt.text, name, settings, let)

    feed = " ".join(f"WHEN {f.when} THEN '{f.feed}'" for f in formats)
    text = " ".join(f"WHEN {f.when} THEN {line(f)}" for f in formats)
    return F.expr(f"CASE {feed} END"), F.expr(f"CASE {text} END")


# --- jobs ---------------------------------------------------------------------------------

def _lines(df: DataFrame, feed: str | Column, line: Column, keep: tuple[str, ...]) -> DataFrame:
    return df.select(
        *keep, table_name(F.col("event_type"), F.col("source")).alias("table"),
        F.col("timestamp").alias("ts"), (F.lit(feed) if isinstance(feed, str) else feed).alias("feed"),
        line.alias("line"))


def json_sql(name: str, place_of: Callable[[ColumnSpec], str] = lambda c: c.attr) -> str:
    """The exported record of a class: public names, no labels, ISO times, nulls kept."""
    spec = spec_of(name)
    place = {c.public: c for c in spec.columns if not c.hidden and c.attr not in dims.LABEL_COLUMNS}
    pairs = [f"{T.lit(public)}, {T.iso_ts(c.attr) if c.kind == 'time' else place_of(c)}" for public, c in place.items()]
    if {"location", "city"} <= set(spec.by_attr):
        pairs.append("'LocationDetails', named_struct('countryOrRegion', location, 'city', city)")
    if "spf_pass" in spec.by_attr:
        pairs.append(f"'AuthenticationDetails', {MAIL_AUTH}")
    return f"to_json(named_struct({', '.join(pairs)}), map('ignoreNullFields', 'false'))"


def export_json(df: DataFrame, name: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return _lines(df, "json", F.expr(json_sql(name)), keep)


def export_cef(df: DataFrame, name: str, settings: Settings = Settings(), keep: tuple[str, ...] = ()) -> DataFrame:
    line, dropped = cef_line(name, settings)
    return _lines(df.withColumn("dropped", dropped), "cef", line, (*keep, "dropped"))


def export_syslog(df: DataFrame, name: str, settings: Settings = Settings(), keep: tuple[str, ...] = ()) -> DataFrame:
    return _lines(df, "syslog", F.expr(syslog_sql(name, settings)), keep)


def export_winevent_xml(df: DataFrame, name: str, settings: Settings = Settings(),
                        keep: tuple[str, ...] = (), gate: bool = True) -> DataFrame:
    rows = df.filter(writes_winevents(F.col("source"))) if gate else df
    return _lines(rows, "winxml", F.expr(winevent_sql(name, settings)), keep)


def export_auditd(df: DataFrame, name: str, settings: Settings = Settings(), keep: tuple[str, ...] = (),
                  serial: str = "serial") -> DataFrame:
    lines = auditd_lines(name, settings, serial)
    if lines is None:
        lines = F.expr("CAST(array() AS array<string>)")
    return _lines(df, "auditd", F.explode(lines), keep)


def export_vendor(df: DataFrame, name: str, keep: tuple[str, ...] = (), settings: Settings = Settings()) -> DataFrame:
    """Self-gating: a class without a vendor rendering yields nothing."""
    made = vendor_line(name, settings)
    if made is None:
        return _lines(df.limit(0), "", F.lit(""), keep)
    return _lines(df, made[0], made[1], keep)


def line_parts(name: str, settings: Settings, serial: str | None = None,
               place_of: Callable[[ColumnSpec], str] = lambda c: c.attr) -> Column:
    """Every feed of a class, rendered side by side: an array of ``feed, line``; a feed that has no line has null."""
    pair = lambda feed, line: F.struct(feed.alias("feed"), line.alias("line"))
    parts = [pair(F.lit("json"), F.expr(json_sql(name, place_of))), pair(F.lit("cef"), cef_line(name, settings)[0]),
             pair(F.lit("syslog"), F.expr(syslog_sql(name, settings)))]
    if name == GENERIC.name or spec_of(name).source.lower() not in dims.NON_WINDOWS_SOURCES:
        gated = F.when(writes_winevents(F.col("source")), F.expr(winevent_sql(name, settings)))
        parts.append(pair(F.lit("winxml"), gated))
    made = vendor_line(name, settings)
    if made:
        parts.append(pair(*made))
    lines = F.array(*parts)
    audit = auditd_lines(name, settings, serial) if serial else None
    return lines if audit is None else F.concat(lines, F.transform(audit, lambda a: pair(F.lit("auditd"), a)))


def _exploded(df: DataFrame, lines: Column, keep: tuple[str, ...]) -> DataFrame:
    table = table_name(F.col("event_type"), F.col("source")).alias("table")
    return df.select(*keep, table, F.col("timestamp").alias("ts"), F.inline(lines)).filter(F.col("line").isNotNull())


def feed_lines(df: DataFrame, name: str, settings: Settings = Settings(),
               keep: tuple[str, ...] = (), serial: str | None = None) -> DataFrame:
    """Every feed of a class from one pass: rendered side by side, then exploded."""
    return _exploded(df, line_parts(name, settings, serial), keep)


def audit_serials(texts: DataFrame, models: Sequence[str], settings: Settings = Settings(), first_serial: int = 0) -> DataFrame:
    """``_row, serial``: the place, in order of time, of each record (with its given texts) of a class with audit records.

    Only ids and times are ordered. A record that its class then refuses leaves a gap.
    """
    rows = wide_rows(texts, models, settings, ("row_id",), only=("timestamp",))
    # written once, since ordering reads its input twice
    narrow = materialise(rows.select(F.col("row_id").alias("_row"), F.col("timestamp").alias("_ts")))
    ranked = global_rank(narrow, ["_ts", "_row"], "serial")
    return ranked.select("_row", (F.col("serial") + 1 + first_serial).alias("serial"))


def export_records(routed: DataFrame, models: Sequence[str], settings: Settings = Settings(), first_serial: int = 0,
                   keep: tuple[str, ...] = ()) -> DataFrame:
    """All feeds of all classes from one scan of the routed records: ``table, ts, feed, line`` of what the classes accept.

    Records of classes with audit records meet their serial by id; that reads ids and times once more.
    """
    audited = _audited(models)
    if audited:
        routed = _with_serials(routed, audit_serials(given_texts(routed, audited), audited, settings, first_serial))
    return _lines_of(judged(routed, models), models, settings, keep)


def export_judged(rows: DataFrame, models: Sequence[str], settings: Settings = Settings(), first_serial: int = 0,
                  keep: tuple[str, ...] = ()) -> DataFrame:
    """``export_records`` from ``judged`` records that are there already."""
    audited = _audited(models)
    if audited:
        rows = _with_serials(rows, audit_serials(rows.filter(F.col("model").isin(*audited)), audited, settings, first_serial))
    return _lines_of(rows, models, settings, keep)


def _audited(models: Sequence[str]) -> list[str]:
    return [name for name in models if spec_of(name).feeds.get("auditd") is not None]


def _with_serials(rows: DataFrame, serials: DataFrame) -> DataFrame:
    return rows.join(serials, F.col("row_id") == F.col("_row"), "left").drop("_row")


def _lines_of(rows: DataFrame, models: Sequence[str], settings: Settings, keep: tuple[str, ...]) -> DataFrame:
    """The lines of the accepted among judged records."""
    audited = _audited(models)
    kept = dict.fromkeys(["row_id", "model", *keep, *(["serial"] if audited else [])])
    wide = wide_rows(rows.filter(F.size("errors") == 0), models, settings, list(kept))
    lines = None
    for name in models:
        own = line_parts(name, settings, "serial" if name in audited else None, wide_name)
        lines = F.when(F.col("model") == name, own) if lines is None else lines.when(F.col("model") == name, own)
    return _exploded(wide, lines, keep)


def export_run(tables: dict[str, DataFrame], settings: Settings = Settings(), first_serial: int = 0) -> DataFrame:
    """All feeds of tables that are there already, as one set of lines; ``export_records`` does it from routed records in one scan.

    Rows of classes with audit records get a serial first, in order of time over all those classes, which the
    records of one event share. Only their ids and times are ordered.
    """
    audited = [name for name in tables if spec_of(name).feeds.get("auditd") is not None]
    serials = None
    for name in audited:
        rows = tables[name].select(F.lit(name).alias("_model"), F.col("row_id").alias("_row"), F.col("timestamp").alias("_ts"))
        serials = rows if serials is None else serials.unionByName(rows)
    if serials is not None:
        serials = global_rank(serials, ["_ts", "_row"], "serial").withColumn("serial", F.col("serial") + 1 + first_serial)
    out = None
    for name, table in tables.items():
        if name in audited:
            own = serials.filter(F.col("_model") == name).select("_row", "serial")
            lines = feed_lines(table.join(own, F.col("row_id") == F.col("_row")).drop("_row"), name, settings, serial="serial")
        else:
            lines = feed_lines(table, name, settings)
        out = lines if out is None else out.unionByName(lines)
    return out
