"""Feed exports and their gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchloom.catalog import dims
from watchloom.operators import feeds as X
from watchloom.operators import normalize as N
from watchloom.operators import quality as Q
from watchloom.operators.ordered import serial_rank
from watchloom.operators.settings import Settings
from watchloom.plans.inputs import EV, events, raw_events
from watchloom.plans.normalize_queries import MODELS, RUN, SQL_MODEL, accepted, routed, routed_once
from watchloom.plans.registry import query, sql_in, sql_uuid
from watchloom.session import dealt

SETTINGS = Settings(run_id="run-1", vendor="Acme")
_SEV = "['critical', 'High', 'medium', 'LOW', 'informational'][event_id % 5 + 1]"
_CEF = "[10, 8, 5, 3, 1][event_id % 5 + 1]"
_HOST = "CASE WHEN k % 10 > 0 THEN 'WS-' || (user_id % 97) END"
_SRC = "'10.' || (user_id % 200) || '.' || k || '.7'"
_DST = "CASE WHEN k % 8 > 0 THEN CASE WHEN k % 3 = 0 THEN '203.0.113.' || k ELSE '192.168.1.' || k END END"
_FILE = "CASE WHEN k % 2 = 0 THEN 'proc' || k || '.exe' WHEN k % 4 = 1 THEN 'file' || k || '.exe' ELSE 'late' || k || '.exe' END"
_FOLDER = r"CASE WHEN k % 4 = 0 THEN 'D:\apps\' || k ELSE 'C:\Windows\System32' END"
_PID = "CASE WHEN k % 5 = 0 THEN event_id ELSE event_id + 1 END"
_UPN = "CASE WHEN k % 3 = 0 THEN 'user' || user_id || '@corp.test' ELSE 'acct' || user_id || '@corp.test' END"
_PROCESS_OK = "event_type = 'click' AND k % 7 > 0 AND k % 10 <> 1"
_SIGNIN_OK = "event_type = 'view' AND NOT (k % 3 = 0 AND k % 11 = 0)"
_STAMP = "strftime(ts, '%b %d %H:%M:%S')"


@query(f"""
WITH {EV}, x AS (SELECT *, {_HOST} AS host FROM ev)
SELECT event_id AS row_id, '<14>' || {_STAMP} || ' ' || coalesce(host, 'WKS') || ' Microsoft-Windows-Security-Auditing[' || ({_PID})
  || ']: Process Created: ' || {_FILE} || ' Cmd=run --job ' || k || ' User=None' AS line FROM x WHERE {_PROCESS_OK}
UNION ALL SELECT event_id, '<86>' || {_STAMP} || ' ' || coalesce(host, 'SERVER') || ' AzureAD[0]: Authentication ' ||
  CASE WHEN k % 2 = 0 THEN 'failed' ELSE 'accepted' END || ' for ' || {_UPN} || ' from ' || {_SRC} FROM x WHERE {_SIGNIN_OK}
UNION ALL SELECT event_id, '<' || CASE WHEN k % 4 = 0 THEN 4 ELSE 6 END || '>' || {_STAMP} || ' ' || coalesce(host, 'FW') || ' firewalld[0]: ACTION=' ||
  CASE WHEN k % 4 = 0 THEN 'blocked' ELSE 'allowed' END || ' PROTO=' || CASE WHEN k % 2 = 0 THEN 'udp' ELSE 'TCP' END || ' SRC=' || {_SRC} || ':' ||
  (49152 + user_id % 16384) || ' DST=' || coalesce({_DST}, 'None') || ':' || CASE WHEN k % 6 = 0 THEN 80 ELSE 443 END FROM x WHERE event_type = 'error'
UNION ALL SELECT event_id, '<14>' || {_STAMP} || ' ' || coalesce(host, '-') || ' Office 365[0]: OfficeActivity: severity=high' FROM x WHERE event_type = 'purchase'""")
def syslog_lines(spark, sf):
    rows, out = routed_once(spark, sf), None
    for name in ("process", "signin", "firewall", "office_activity"):
        lines = X.export_syslog(N.normalize(rows, name, RUN)[0], name, SETTINGS, ("row_id",)).select("row_id", "line")
        out = lines if out is None else out.unionByName(lines)
    return out


@query(f"""
WITH {EV}, x AS (SELECT *, {_HOST} AS host FROM ev)
SELECT event_id AS row_id, '<' || 86 || '>1 ' || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END
  || '+00:00 ' || coalesce(host, 'SERVER') || ' AzureAD 0 - - Authentication ' || CASE WHEN k % 2 = 0 THEN 'failed' ELSE 'accepted' END || ' for ' || {_UPN}
  || ' from ' || {_SRC} AS line FROM x WHERE {_SIGNIN_OK}""")
def syslog_lines_with_year(spark, sf):
    settings = Settings(run_id="run-1", syslog_format="rfc5424")
    return X.export_syslog(accepted(spark, sf, "signin"), "signin", settings, ("row_id",)).select("row_id", "line")


_HEX_PARENT = "'0x0'"


@query(f"""
WITH {EV}, x AS (SELECT *, {_HOST} AS host FROM ev)
SELECT event_id AS row_id, '<Event xmlns=''http://schemas.microsoft.com/win/2004/08/events/event''><System><Provider Name=''Microsoft-Windows-Security-Auditing''/><EventID>4688</EventID><Version>0</Version><Level>4</Level><TimeCreated SystemTime='''
  || strftime(ts, '%Y-%m-%dT%H:%M:%S.000Z') || '''/><Channel>Security</Channel><Computer>' || coalesce(host, 'WKS') || '</Computer><Security/></System><EventData><Data Name=''NewProcessId''>0x'
  || lower(to_hex({_PID})) || '</Data><Data Name=''NewProcessName''>' || {_FOLDER} || '\\' || {_FILE} || '</Data><Data Name=''ProcessId''>' || {_HEX_PARENT} || '</Data><Data Name=''ParentProcessName''>'
  || CASE WHEN k % 3 = 0 THEN 'explorer.exe' ELSE '' END || '</Data><Data Name=''CommandLine''>run --job ' || k || '</Data></EventData></Event>' AS line
FROM x WHERE {_PROCESS_OK}""".replace("'\\\\'", "'\\'"))
def windows_event_lines(spark, sf):
    return X.export_winevent_xml(accepted(spark, sf, "process"), "process", SETTINGS, ("row_id",)).select("row_id", "line")


@query(f"""
WITH {EV} SELECT event_id AS row_id, CASE WHEN k % 2 = 0 THEN '4625' ELSE '4624' END AS code FROM ev WHERE {_SIGNIN_OK}
UNION ALL SELECT event_id, '4688' FROM ev WHERE {_PROCESS_OK}
UNION ALL SELECT event_id, '3' FROM ev WHERE event_type = 'error'
UNION ALL SELECT event_id, '0' FROM ev WHERE event_type = 'purchase'""")
def windows_event_ids(spark, sf):
    """Event ids by class and outcome; the gate is open so that appliances show theirs."""
    rows, out = routed_once(spark, sf), None
    for name in ("signin", "process", "firewall", "office_activity"):
        lines = X.export_winevent_xml(N.normalize(rows, name, RUN)[0], name, SETTINGS, ("row_id",), gate=False).select(
            "row_id", F.regexp_extract("line", r"<EventID>(\d+)</EventID>", 1).alias("code"))
        out = lines if out is None else out.unionByName(lines)
    return out


def _sql_cef(product: str, kind: str) -> str:
    return (f"'CEF:0|Acme|{product}|1.1|{kind}|Acme {kind} event|' || {_CEF} || '|rt=' || (epoch_us(ts) // 1000) || ' src=' || {_SRC} || "
            f"coalesce(' dst=' || {_DST}, '')")


@query(f"""
WITH {EV}, x AS (SELECT *, {_HOST} AS host, CASE WHEN k % 4 = 0 THEN 'blocked' ELSE 'allowed' END AS act,
  CASE WHEN k % 2 = 0 THEN 'udp' ELSE 'TCP' END AS proto, CASE WHEN k % 5 = 0 THEN 'Inbound' ELSE 'Outbound' END AS dir FROM ev)
SELECT event_id AS row_id, {_sql_cef('Firewall', 'CommonSecurityLog')} || coalesce(' shost=' || host, '') || ' msg=default externalId=c' || user_id ||
  CASE WHEN k % 2 = 0 THEN ' cs1Label=MitreTactic cs1=Impact cs2Label=MitreTechniqueId cs2=T' || (1400 + k) || ' cs3Label=MitreTechniqueName cs3=n' || k
    || ' cs4Label=DeviceAction cs4=' || act || ' cs5Label=Protocol cs5=' || proto || ' cs6Label=SourcePort cs6=' || (49152 + user_id % 16384)
  ELSE ' cs1Label=DeviceAction cs1=' || act || ' cs2Label=Protocol cs2=' || proto || ' cs3Label=SourcePort cs3=' || (49152 + user_id % 16384)
    || ' cs4Label=DestinationPort cs4=' || CASE WHEN k % 6 = 0 THEN 80 ELSE 443 END || ' cs5Label=NetworkDirection cs5=' || dir || ' cs6Label=RemoteCountry cs6=US' END AS line,
  CASE WHEN k % 2 = 0 THEN 'DestinationPort,NetworkDirection,RemoteCountry,RemoteASN,DeviceVendor' ELSE 'RemoteASN,SentBytes,DeviceVendor' END AS dropped
FROM x WHERE event_type = 'error'
UNION ALL SELECT event_id, {_sql_cef('Endpoint', 'DeviceProcessEvents')} || coalesce(' shost=' || host, '') || ' msg=default externalId=c' || user_id ||
  ' cs1Label=DeviceId cs1=' || {sql_uuid("'run-1|' || event_id || '|device_id'")} || ' cs2Label=ReportId cs2=' ||
  (10000 + (('0x' || substr(md5('run-1|' || event_id || '|report_id'), 1, 8))::BIGINT % 90000)) || ' cs3Label=ActionType cs3=ProcessCreated cs4Label=FileName cs4=' || {_FILE}
  || ' cs5Label=FolderPath cs5=' || {_FOLDER} || ' cs6Label=ProcessId cs6=' || ({_PID}),
  'ProcessCommandLine,ProcessIntegrityLevel,TokenElevationType,IsSigned,Signer' || CASE WHEN k % 3 = 0 THEN ',InitiatingProcessFileName' ELSE '' END
FROM x WHERE {_PROCESS_OK}""")
def cef_lines(spark, sf):
    out = None
    for name in ("firewall", "process"):
        lines = X.export_cef(accepted(spark, sf, name), name, SETTINGS, ("row_id",)).select(
            "row_id", "line", F.array_join("dropped", ",").alias("dropped"))
        out = lines if out is None else out.unionByName(lines)
    return out


_DENY = "k % 4 = 0"
_IN = "k % 5 = 0"


def _inout(a: str, b: str) -> str:
    return f"CASE WHEN {_IN} THEN '{a}' ELSE '{b}' END"


_SQL_FORTIOS = f"""'<' || CASE WHEN {_DENY} THEN 188 ELSE 189 END || '>date=' || strftime(ts, '%Y-%m-%d') || ' time=' || strftime(ts, '%H:%M:%S')
  || ' devname="' || coalesce(host, 'FGT-01') || '" devid="FG100E' || upper(substr(md5(coalesce(host, 'FGT-01')), 1, 10)) || '" logid="0000000013" type="traffic" subtype="forward" level="'
  || CASE WHEN {_DENY} THEN 'warning' ELSE 'notice' END || '" vd="root" eventtime=' || (epoch_us(ts) * 1000) || ' srcip=' || {_SRC} || ' srcport=' || (49152 + user_id % 16384)
  || ' srcintf="' || {_inout('wan1', 'internal')} || '" srcintfrole="' || {_inout('wan', 'lan')} || '" dstip=' || coalesce({_DST}, '0.0.0.0') || ' dstport=' || dport
  || ' dstintf="' || {_inout('internal', 'wan1')} || '" dstintfrole="' || {_inout('lan', 'wan')} || '" proto=' || CASE WHEN k % 2 = 0 THEN 17 ELSE 6 END
  || ' action="' || CASE WHEN {_DENY} THEN 'deny' ELSE 'accept' END || '" policyid=1 service="' || CASE WHEN k % 2 = 0 THEN 'UDP' ELSE 'TCP' END || '-' || dport
  || '" dstcountry="US" sentbyte=' || CASE WHEN k % 2 = 1 THEN k * 10 ELSE 0 END || ' rcvdbyte=0'"""
_FLOW = f"coalesce({_DST}, '0.0.0.0') || '/' || dport"
_FROM = f"{_SRC} || '/' || (49152 + user_id % 16384)"
_SQL_ASA = f"""'<' || CASE WHEN {_DENY} THEN 188 ELSE 190 END || '>' || {_STAMP} || ' ' || coalesce(host, 'ASA-01') || ' asa: ' || CASE WHEN {_DENY}
  THEN '%ASA-4-106023: Deny ' || CASE WHEN k % 2 = 0 THEN 'udp' ELSE 'tcp' END || ' src ' || {_inout('outside', 'inside')} || ':' || {_FROM} || ' dst ' || {_inout('inside', 'outside')} || ':' || {_FLOW}
    || ' by access-group "' || {_inout('INSIDE', 'OUTSIDE')} || '_IN" [0x0, 0x0]'
  ELSE '%ASA-6-302013: Built ' || {_inout('inbound', 'outbound')} || ' ' || CASE WHEN k % 2 = 0 THEN 'UDP' ELSE 'TCP' END || ' connection 0 for ' || {_inout('inside', 'outside')} || ':' || {_FLOW}
    || ' (' || {_FLOW} || ') to ' || {_inout('outside', 'inside')} || ':' || {_FROM} || ' (' || {_FROM} || ')' END"""


@query(f"""
WITH {EV}, x AS (SELECT *, {_HOST} AS host, CASE WHEN k % 6 = 0 THEN 80 ELSE 443 END AS dport FROM ev WHERE event_type = 'error')
SELECT event_id AS row_id, CASE WHEN k % 3 = 0 THEN 'cisco_asa' ELSE 'fortinet' END AS feed,
  CASE WHEN k % 3 = 0 THEN {_SQL_ASA} ELSE {_SQL_FORTIOS} END AS line FROM x""")
def appliance_lines(spark, sf):
    """Each flow in the format of the one appliance that logged it."""
    return X.export_vendor(accepted(spark, sf, "firewall"), "firewall", ("row_id",)).select("row_id", "feed", "line")


@query(f"""
WITH {EV} SELECT event_id AS row_id, CASE WHEN k % 2 = 0 THEN 'FAILURE' ELSE 'SUCCESS' END AS result,
  CASE WHEN k % 2 = 0 THEN 'INVALID_CREDENTIALS' ELSE 'Success' END AS reason, {_UPN} AS actor, split_part({_UPN}, '@', 1) AS shown,
  {_SRC} AS ip, CASE WHEN k % 4 = 0 THEN 'Berlin' ELSE 'Seattle' END AS city,
  strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST((epoch_us(ts) % 1000000) // 1000 AS VARCHAR), 3, '0') || 'Z' AS published,
  CASE WHEN k % 2 = 0 THEN 'WARN' ELSE 'INFO' END AS severity
FROM ev WHERE {_SIGNIN_OK}""")
def identity_provider_records(spark, sf):
    lines = X.export_vendor(accepted(spark, sf, "signin"), "signin", ("row_id",))
    at = lambda path: F.get_json_object("line", f"$.{path}")
    return lines.select(
        "row_id", at("outcome.result").alias("result"), at("outcome.reason").alias("reason"),
        at("actor.alternateId").alias("actor"), at("actor.displayName").alias("shown"), at("client.ipAddress").alias("ip"),
        at("client.geographicalContext.city").alias("city"), at("published").alias("published"), at("severity").alias("severity"))


@query(f"""
WITH {EV} SELECT event_id AS row_id, 'op' || k AS op, 'c' || user_id AS correlation, 'high' AS severity,
  CASE WHEN epoch_us(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END || '+00:00' AS at,
  true AS has_null, false AS has_label
FROM ev WHERE event_type = 'purchase'""")
def json_lines(spark, sf):
    lines = X.export_json(accepted(spark, sf, "office_activity"), "office_activity", ("row_id",))
    at = lambda path: F.get_json_object("line", f"$.{path}")
    return lines.select(
        "row_id", at("Operation").alias("op"), at("CorrelationId").alias("correlation"), at("AlertSeverity").alias("severity"),
        at("TimeGenerated").alias("at"), F.col("line").contains('"mitre":null').alias("has_null"),
        F.col("line").rlike("is_malicious|scenario_id|killchain_phase|\"depth\"").alias("has_label"))


# --- audit records ------------------------------------------------------------------------

def linux_raw():
    """An event as a Linux record of one of five classes."""
    kind = F.expr("CASE event_type WHEN 'click' THEN 'linux_process' WHEN 'view' THEN 'linux_auth' WHEN 'error' THEN 'linux_sudo' WHEN 'signup' THEN 'linux_cron' ELSE 'linux_audit' END")
    return F.create_map(
        F.lit("event_type"), kind, F.lit("source"), F.lit("linux"), F.lit("timestamp"), F.col("ts").cast("string"),
        F.lit("pid"), F.col("k").cast("string"), F.lit("exe"), F.lit("/usr/bin/run"),
        F.lit("args"), F.concat(F.lit("run --job "), F.col("k"), F.lit(' "two words"')),
        F.lit("user"), F.concat(F.lit("u"), F.col("user_id")), F.lit("command"), F.concat(F.lit("cat /tmp/"), F.col("k")),
        F.lit("log_message"), F.when(F.col("k") % 2 == 0, "Failed password").otherwise("Accepted password"),
        F.lit("audit_msg"), F.lit("arch=c000003e"))


def linux_rows(spark, sf):
    """Events as Linux records, with the serial each keeps over its lines."""
    ev = serial_rank(events(spark, sf), "event_id", "rank")
    return N.route_event_type(ev.select(F.col("event_id").alias("row_id"), (F.col("rank") + 1).alias("serial"), linux_raw().alias("raw")))


_AT = """'msg=audit(' || ((epoch_us(ts) + 500) // 1000 // 1000) || '.' || lpad(CAST((epoch_us(ts) + 500) // 1000 % 1000 AS VARCHAR), 3, '0') || ':' || serial || '): '"""


@query(f"""
WITH {EV}, x AS (SELECT *, row_number() OVER (ORDER BY event_id) AS serial FROM ev)
SELECT event_id AS row_id, 'type=SYSCALL ' || {_AT} || 'arch=c000003e syscall=59 success=yes exit=0 ppid=1 pid=' || k || ' auid=1000 uid=1000 gid=1000 ses=1 comm="run" exe="/usr/bin/run" key="exec"' AS line FROM x WHERE event_type = 'click'
UNION ALL SELECT event_id, 'type=EXECVE ' || {_AT} || 'argc=4 a0="run" a1="--job" a2="' || k || '" a3="two words"' FROM x WHERE event_type = 'click'
UNION ALL SELECT event_id, 'type=' || CASE WHEN k % 2 = 0 THEN 'USER_AUTH ' ELSE 'USER_LOGIN ' END || {_AT} || 'pid=' || k || ' uid=0 auid=4294967295 ses=4294967295 msg=''op=login exe="/usr/sbin/sshd" hostname=localhost terminal=ssh res='
  || CASE WHEN k % 2 = 0 THEN 'failed' ELSE 'success' END || '''' FROM x WHERE event_type = 'view'
UNION ALL SELECT event_id, 'type=USER_CMD ' || {_AT} || 'pid=' || k || ' uid=1000 auid=1000 ses=1 msg=''cwd="/home/user" cmd=' || lower(hex(encode('cat /tmp/' || k))) || ' terminal=/dev/pts/0 res=success''' FROM x WHERE event_type = 'error'
UNION ALL SELECT event_id, 'type=CRED_ACQ ' || {_AT} || 'pid=' || k || ' uid=0 auid=0 ses=1 msg=''op=PAM:setcred grantors=pam_env,pam_unix acct="u' || user_id || '" exe="/usr/sbin/cron" terminal=cron res=success''' FROM x WHERE event_type = 'signup'
UNION ALL SELECT event_id, 'type=SYSCALL ' || {_AT} || 'arch=c000003e pid=' || k || ' auid=1000 ses=1' FROM x WHERE event_type = 'purchase'""")
def audit_lines(spark, sf):
    rows, out = linux_rows(spark, sf), None
    for name in ("linux_process", "linux_auth", "linux_sudo", "linux_cron", "linux_audit"):
        good, _ = N.normalize(rows, name, RUN, keep=("row_id", "serial"))
        lines = X.export_auditd(good, name, SETTINGS, ("row_id",)).select("row_id", "line")
        out = lines if out is None else out.unionByName(lines)
    return out


@query("""
SELECT record_type, count(*) AS records FROM (SELECT unnest(CASE event_type WHEN 'click' THEN ['SYSCALL', 'EXECVE']
  WHEN 'view' THEN [CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) % 2 = 0 THEN 'USER_AUTH' ELSE 'USER_LOGIN' END]
  WHEN 'error' THEN ['USER_CMD'] WHEN 'signup' THEN ['CRED_ACQ'] ELSE ['SYSCALL'] END) AS record_type FROM events) GROUP BY 1""")
def audit_record_counts(spark, sf):
    from watchloom.operators.coverage import record_type_counts
    return record_type_counts(audit_lines(spark, sf))


# --- all feeds and their gates ------------------------------------------------------------

LINUX = ("linux_process", "linux_auth", "linux_sudo", "linux_cron", "linux_audit")


def all_lines(spark, sf):
    """The feeds of every class that the event log plays, and of the Linux classes, from one scan of their records."""
    linux = dealt(events(spark, sf)).select((F.col("event_id") + 10 ** 12).alias("row_id"), linux_raw().alias("raw"))
    records = raw_events(spark, sf).unionByName(linux)
    return X.export_records(N.route_event_type(N.flatten_data(records)), (*MODELS, *LINUX), SETTINGS)


#: table and feed of every line of those tables
SQL_LINES = f"""
WITH {EV}, m AS (SELECT *, {SQL_MODEL} AS model FROM ev), g AS (SELECT * FROM m WHERE model <> 'alert' AND (model <> 'process' OR ({_PROCESS_OK})) AND (model <> 'signin' OR ({_SIGNIN_OK}))),
f AS (SELECT CASE model WHEN 'process' THEN 'DeviceProcessEvents' WHEN 'signin' THEN 'SigninLogs' WHEN 'firewall' THEN 'CommonSecurityLog' WHEN 'cloud_activity' THEN 'AzureActivity'
    WHEN 'office_activity' THEN 'OfficeActivity' ELSE 'Unmapped_Odd_source' END AS t,
  unnest(list_concat(['json', 'cef', 'syslog'], CASE WHEN model IN ('firewall', 'cloud_activity') THEN [] ELSE ['winxml'] END,
  CASE WHEN model = 'signin' THEN ['okta'] WHEN model = 'firewall' THEN [CASE WHEN k % 3 = 0 THEN 'cisco_asa' ELSE 'fortinet' END] ELSE [] END)) AS feed FROM g
  UNION ALL SELECT 'LinuxAuditLog', unnest(list_concat(['json', 'cef', 'syslog', 'auditd'], CASE WHEN event_type = 'click' THEN ['auditd'] ELSE [] END)) FROM ev)"""


@query(SQL_LINES + """
SELECT feed, count(*) AS lines, 0::BIGINT AS broken FROM f GROUP BY 1""")
def feed_gates(spark, sf):
    """Every feed of every class, counted and checked in one pass."""
    return Q.gate_summary(all_lines(spark, sf))


@query(f"""
WITH {EV}, x AS (SELECT event_id, k FROM ev WHERE event_type = 'error')
SELECT 'fortinet' AS gate, event_id AS row_id FROM x WHERE k % 3 <> 0 AND k % 10 = 0
UNION ALL SELECT 'cisco_asa', event_id FROM x WHERE k % 3 = 0 AND k % 10 < 2
UNION ALL SELECT 'priority', event_id FROM x WHERE k % 10 = 2""")
def broken_appliance_lines(spark, sf):
    """Lines damaged in a known way are exactly the ones the gates report."""
    lines = X.export_vendor(accepted(spark, sf, "firewall"), "firewall", ("row_id", "source_port", "dest_port", "bytes_sent"))
    k = events(spark, sf).select(F.col("event_id").alias("row_id"), F.col("k").alias("damage"))
    hurt = lines.join(k, "row_id").withColumn("line", F.expr("""CASE
        WHEN feed = 'fortinet' AND damage % 10 = 0 THEN replace(line, ' subtype=', ' sub=')
        WHEN feed = 'cisco_asa' AND damage % 10 = 0 THEN replace(line, ' asa: ', ' ')
        WHEN feed = 'cisco_asa' AND damage % 10 = 1 THEN concat(line, ' %FTD')
        WHEN damage % 10 = 2 THEN regexp_replace(line, '^<[0-9]+>', '<192>') ELSE line END"""))
    fort = Q.gate_fortios(hurt.filter("feed = 'fortinet'")).select(F.lit("fortinet").alias("gate"), "row_id")
    asa = Q.gate_asa(hurt.filter("feed = 'cisco_asa'")).select(F.lit("cisco_asa").alias("gate"), "row_id")
    prio = Q.priority_in_range(hurt).select(F.lit("priority").alias("gate"), "row_id")
    return fort.unionByName(asa).unionByName(prio)


@query(f"""
WITH {EV} SELECT event_id, 'discarded' AS rule FROM ev WHERE CAST(5140 + k % 20 AS VARCHAR) IN {sql_in(dims.DISCARDED_EVENT_IDS)}
UNION ALL SELECT event_id, 'cs7' FROM ev WHERE k % 8 = 7""")
def refused_lines(spark, sf):
    """Windows ids a decoder throws away, and a seventh custom string."""
    rows = events(spark, sf).select("event_id", F.expr(
        "concat('<EventID>', 5140 + k % 20, '</EventID>')").alias("xml"), F.expr("concat('CEF:0| cs', k % 8, 'Label=x')").alias("cef"))
    a = Q.discarded_event_ids(rows, "xml").select("event_id", F.lit("discarded").alias("rule"))
    return a.unionByName(Q.no_cs7(rows, "cef").select("event_id", F.lit("cs7").alias("rule")))


@query(f"WITH {EV} SELECT event_id AS row_id, 'mystery' AS route_type FROM ev WHERE event_type = 'signup' AND k % 9 = 0")
def records_without_class(spark, sf):
    return Q.no_generic_fallback(routed(spark, sf)).select("row_id", "route_type")

