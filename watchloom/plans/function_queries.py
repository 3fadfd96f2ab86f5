"""Column functions over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchloom.catalog import dims
from watchloom.functions import classify, network, severity, text, timefmt
from watchloom.operators.feeds import fit_slots
from watchloom.operators.lookup import add_topology
from watchloom.plans.inputs import EV, events, load
from watchloom.plans.registry import query, sql_case, sql_in
from watchloom.session import dealt

WORDS = ("critical", "HIGH", " medium ", "low", "informational", "emerg", "alert", "crit", "err",
         "warning", "notice", "info", "debug", "weird")
FACILITIES = ("kern", "auth", "authpriv", "local7", "nowhere")
FIELD_NAMES = ("UserAgent", "src_ip", "ParentProcessGuid", "Description", "EventData.TargetUserName",
               "note", "HTTPStatus", "device.hostname")


def _nth(values, index="k"):
    return F.element_at(F.array(*map(F.lit, values)), F.expr(f"{index} % {len(values)} + 1"))


def _sql_nth(values, index="k"):
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][{index} % {len(values)} + 1]"


_WORD = f"lower(trim({_sql_nth(WORDS)}))"
_NORM = sql_case(_WORD, {**{w: w for w in dims.SYSLOG_SEVERITY}, **dims.APP_SEVERITY}, "'info'")


@query(f"""
WITH {EV}, s AS (SELECT event_id, {_WORD} AS word, {_NORM} AS keyword, {_sql_nth(FACILITIES)} AS facility FROM ev)
SELECT event_id, keyword,
  CAST({sql_case('facility', dims.SYSLOG_FACILITY, '1')} * 8 + {sql_case('keyword', dims.SYSLOG_SEVERITY, '6')} AS INT) AS priority,
  CAST({sql_case('keyword', dims.WINEVENT_LEVEL, '4')} AS INT) AS level,
  CAST({sql_case('word', dims.CEF_SEVERITY, '1')} AS INT) AS cef
FROM s""")
def severity_scales(spark, sf):
    word = _nth(WORDS)
    return events(spark, sf).select(
        "event_id", severity.normalize_severity(word).alias("keyword"),
        severity.syslog_priority(_nth(FACILITIES), word).alias("priority"),
        severity.evt_level(word).alias("level"), severity.cef_severity(word).alias("cef"))


@query("""
SELECT event_id, strftime(ts, '%b %d %H:%M:%S') AS syslog,
  CASE WHEN epoch_us(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END || '+00:00' AS iso,
  strftime(ts, '%Y-%m-%dT%H:%M:%S.000Z') AS xml,
  strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST((epoch_us(ts) % 1000000) // 1000 AS VARCHAR), 3, '0') || 'Z' AS milli,
  epoch_us(ts) // 1000 AS ms, epoch_us(ts) * 1000 AS ns,
  ((epoch_us(ts) + 500) // 1000 // 1000) || '.' || lpad(CAST((epoch_us(ts) + 500) // 1000 % 1000 AS VARCHAR), 3, '0') AS audit,
  year(ts) <> 2024 AS redated FROM events""")
def time_renderings(spark, sf):
    ts = F.col("ts")
    return load(spark, sf, "events").select(
        "event_id", timefmt.syslog_ts(ts).alias("syslog"), timefmt.iso_ts(ts).alias("iso"),
        timefmt.xml_ts(ts).alias("xml"), timefmt.milli_ts(ts).alias("milli"), timefmt.epoch_ms(ts).alias("ms"),
        timefmt.epoch_ns(ts).alias("ns"), timefmt.epoch_milli(ts).alias("audit"),
        timefmt.loses_year(ts, 2024).alias("redated"))


@query(r"""
SELECT doc_id,
  md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')) AS xml,
  md5(replace(replace(replace(text, '|', '\|'), chr(10), ' '), chr(13), ' ')) AS cef,
  md5(lower(hex(encode(text)))) AS hex FROM documents""")
def escaped_texts(spark, sf):
    t = F.col("text")
    return load(spark, sf, "documents").select(
        "doc_id", F.md5(text.xml_escape(t)).alias("xml"), F.md5(text.cef_escape(t)).alias("cef"),
        F.md5(text.hex_utf8(t)).alias("hex"))


_PROTO = ("tcp", "UDP", "icmp", "weird")
_QTYPE = ("a", "AAAA", "MX", "zz")
_ACTION = ("Blocked", "allowed", "DROP", "reset", "accept")


@query(f"""
WITH {EV}, x AS (SELECT event_id, k, user_id, ts, {_sql_nth(_PROTO)} AS p, {_sql_nth(_QTYPE)} AS q,
  {_sql_nth(_ACTION)} AS a, 'FW-' || (user_id % 9) AS host, k * 7 AS status FROM ev)
SELECT event_id, CAST({sql_case('upper(p)', dims.PROTOCOL_NUMBER, '6')} AS INT) AS proto,
  CAST({sql_case('upper(q)', dims.DNS_QUERY_TYPE, '1')} AS INT) AS qtype,
  lower(a) IN {sql_in(dims.DENY_ACTIONS)} AS deny,
  CASE WHEN k % 2 = 0 THEN 'outside' ELSE 'inside' END AS src_if,
  CASE WHEN k % 2 = 0 THEN 'inside' ELSE 'outside' END AS dst_if,
  'FG100E' || upper(substr(md5(host), 1, 10)) AS serial,
  CAST(('0x' || substr(md5(host || q), 1, 4)) AS INT) AS xid,
  '0x' || lower(to_hex(event_id + 1)) AS pid,
  CASE WHEN status >= 500 THEN 'err' WHEN status >= 400 THEN 'warning' ELSE 'info' END AS http
FROM x""")
def device_attributes(spark, sf):
    host = F.concat(F.lit("FW-"), F.col("user_id") % 9)
    src, dst = network.interfaces(F.when(F.col("k") % 2 == 0, "Inbound").otherwise("outbound"), "outside", "inside")
    return events(spark, sf).select(
        "event_id", network.proto_number(_nth(_PROTO)).alias("proto"), network.dns_qtype(_nth(_QTYPE)).alias("qtype"),
        network.is_deny(_nth(_ACTION)).alias("deny"), src.alias("src_if"), dst.alias("dst_if"),
        network.device_serial(host).alias("serial"), network.dns_xid(host, _nth(_QTYPE)).alias("xid"),
        text.hex_pid(F.col("event_id") + 1).alias("pid"), severity.http_severity(F.col("k") * 7).alias("http"))


#: value shapes in SQL, in the order they are tested
SQL_CLASS = f"""CASE WHEN regexp_matches(t, '{dims.IPV4}') THEN 'ipv4'
  WHEN regexp_matches(t, '{dims.IPV4_PORT}') THEN 'ipv4:port' WHEN regexp_matches(t, '{dims.IPV6_PORT}') THEN 'ipv6:port'
  WHEN regexp_matches(t, '{dims.ACCOUNT}') THEN 'account' WHEN regexp_matches(t, '{dims.GUID}') THEN 'guid'
  WHEN regexp_matches(t, '{dims.EMAIL}') THEN 'email' WHEN regexp_matches(t, '{dims.SID}') THEN 'sid'
  WHEN regexp_matches(t, '{dims.FQDN}') THEN 'fqdn' END"""
_EDGES = " ".join(f"WHEN length(t) <= {e} THEN '<={e}'" for e in dims.LENGTH_EDGES)
SQL_SHAPE = f"""CASE WHEN c IN ('ipv4', 'ipv4:port', 'ipv6:port', 'guid') THEN c
  WHEN c = 'account' THEN 'account:domain_user'
  WHEN c = 'email' THEN 'email:local_len=' || length(split_part(t, '@', 1)) || ':domain_labels=' || len(string_split(split_part(t, '@', 2), '.'))
  WHEN c = 'sid' THEN 'sid:parts=' || len(string_split(t, '-'))
  WHEN c = 'fqdn' THEN 'fqdn:labels=' || len(string_split(t, '.'))
  ELSE 'str:len_bucket=' || CASE {_EDGES} ELSE '>{dims.LENGTH_EDGES[-1]}' END END"""
SQL_WORDS = r"(SELECT doc_id, lang, source, unnest(string_split_regex(text, '[ \t\n\r]+')) AS t FROM documents)"


def words(spark, sf):
    """Every word of every document, as the values of a field."""
    return dealt(load(spark, sf, "documents")).select(
        "doc_id", "lang", "source", F.explode(F.split("text", r"[ \t\n\r]+")).alias("t")).filter("t <> ''")


@query(f"""
WITH w AS (SELECT t, {SQL_CLASS} AS c FROM {SQL_WORDS} WHERE t <> '')
SELECT coalesce(c, 'none') AS value_class, {SQL_SHAPE} AS shape, count(*) AS n FROM w GROUP BY 1, 2""")
def value_shapes(spark, sf):
    seen = words(spark, sf).withColumn("c", classify.value_class(F.col("t")))
    return seen.groupBy(
        F.coalesce("c", F.lit("none")).alias("value_class"),
        classify.shape_token(F.col("t"), F.col("c")).alias("shape")).agg(F.count("*").alias("n"))


@query(f"""
WITH w AS (SELECT {_sql_nth(FIELD_NAMES, 'length(t)')} AS name, {SQL_CLASS} AS c, t FROM {SQL_WORDS} WHERE t <> '')
SELECT name, CASE WHEN c IS NOT NULL AND c <> 'fqdn' THEN 'identifier'
    WHEN name IN ('UserAgent', 'ParentProcessGuid', 'HTTPStatus') THEN 'freeform'
    WHEN name IN ('src_ip', 'EventData.TargetUserName', 'device.hostname') THEN 'identifier'
    WHEN c = 'fqdn' AND len(string_split(t, '.')) <= 4 THEN 'identifier' ELSE 'freeform' END AS kind,
  count(*) AS n FROM w GROUP BY 1, 2""")
def classified_fields(spark, sf):
    rows = words(spark, sf).withColumn("name", _nth(FIELD_NAMES, "length(t)"))
    return rows.groupBy("name", classify.classify_field(F.col("name"), F.col("t")).alias("kind")).agg(
        F.count("*").alias("n"))


@query("""
SELECT page_id, starts_with(u, 'http://') OR starts_with(u, 'https://') AS ok
FROM (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN substr(url, 5) ELSE url END AS u FROM pages)""")
def valid_urls(spark, sf):
    url = F.expr("CASE WHEN page_id % 5 = 0 THEN substr(url, 5) ELSE url END")
    return load(spark, sf, "pages").select("page_id", network.url_valid(url).alias("ok"))


_LOGIN = "CASE turn % 4 WHEN 0 THEN 'Failed password: ' WHEN 1 THEN 'INVALID user: ' WHEN 2 THEN 'Accepted password: ' ELSE '' END"


@query(f"""
SELECT conv_id, turn, regexp_matches(lower({_LOGIN} || text), 'fail|invalid') AS failed FROM conversations""")
def failed_logins(spark, sf):
    """Turns of conversations as login messages."""
    message = F.expr(f"concat({_LOGIN}, text)")
    return load(spark, sf, "conversations").select("conv_id", "turn", classify.linux_auth_failed(message).alias("failed"))


@query(f"""
WITH {EV}, x AS (SELECT event_id, k, CASE WHEN k % 9 = 0 THEN NULL WHEN k % 9 = 1 THEN 'not-an-ip'
    WHEN k % 9 = 2 THEN '172.' || (k % 40) || '.0.1' WHEN k % 9 = 3 THEN '300.1.1.1'
    WHEN k % 9 = 4 THEN '192.168.' || k || '.1' ELSE '10.' || (user_id % 200) || '.0.9' END AS s,
  CASE WHEN k % 3 = 0 THEN '203.0.113.' || k WHEN k % 3 = 1 THEN '169.254.1.' || k ELSE '127.0.0.1' END AS d FROM ev),
f AS (SELECT event_id, s IS NULL OR k % 9 <> 2 OR (k % 40 BETWEEN 16 AND 31) AS si, k % 3 <> 0 AS di FROM x)
SELECT event_id, si AS src_internal, di AS dst_internal, CASE WHEN si AND di THEN 'fortigate' ELSE 'cisco' END AS appliance FROM f""")
def flow_topology(spark, sf):
    rows = events(spark, sf).select(
        "event_id",
        F.expr("""CASE WHEN k % 9 = 0 THEN NULL WHEN k % 9 = 1 THEN 'not-an-ip'
            WHEN k % 9 = 2 THEN concat('172.', k % 40, '.0.1') WHEN k % 9 = 3 THEN '300.1.1.1'
            WHEN k % 9 = 4 THEN concat('192.168.', k, '.1') ELSE concat('10.', user_id % 200, '.0.9') END""").alias("source_ip"),
        F.expr("""CASE WHEN k % 3 = 0 THEN concat('203.0.113.', k) WHEN k % 3 = 1 THEN concat('169.254.1.', k)
            ELSE '127.0.0.1' END""").alias("dest_ip"))
    return add_topology(rows).select("event_id", "src_internal", "dst_internal", "appliance")


@query(f"""
WITH {EV}, f AS (SELECT event_id, list_filter(list_transform(range(1, 10),
    lambda i: CASE WHEN (event_id + i) % 4 > 0 THEN 'f' || i END), lambda x: x IS NOT NULL) AS present,
  CASE WHEN k % 2 = 0 THEN 3 ELSE 0 END AS taken FROM ev)
SELECT event_id, array_to_string(list_slice(present, 1, 6 - taken), ',') AS kept,
  array_to_string(list_slice(present, 7 - taken, 99), ',') AS dropped FROM f""")
def custom_string_slots(spark, sf):
    """Six custom strings per line; columns without a value take none, the rest is reported."""
    fields = F.array(*[
        F.struct(F.lit(f"f{i}").alias("label"), F.expr(f"CASE WHEN (event_id + {i}) % 4 > 0 THEN 'v' END").alias("value"))
        for i in range(1, 10)])
    kept, dropped = fit_slots(fields, F.expr("CASE WHEN k % 2 = 0 THEN 3 ELSE 0 END"))
    return events(spark, sf).select(
        "event_id", F.array_join(F.transform(kept, lambda f: f["label"]), ",").alias("kept"),
        F.array_join(dropped, ",").alias("dropped"))
