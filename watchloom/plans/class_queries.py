"""Event classes that the event log itself does not play: their records, columns and feed lines.

Every event plays one record of each class. The expected columns and lines are stated here in SQL, apart from the
catalog, so that a wrong entry there shows. Expressions are written in the SQL that Spark and DuckDB share.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import functions as F

from watchloom.operators import feeds as X
from watchloom.operators import normalize as N
from watchloom.operators.settings import Settings
from watchloom.plans.inputs import EV, events
from watchloom.plans.registry import query, sql_uuid
from watchloom.session import dealt, stored

SETTINGS = Settings(run_id="run-1", vendor="Acme")

SEVERITY = "CASE event_id % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'High' WHEN 2 THEN 'medium' WHEN 3 THEN 'LOW' ELSE 'informational' END"
HOST = "CASE WHEN k % 10 > 0 THEN 'H-' || (user_id % 97) END"
USER = "CASE WHEN k % 6 > 0 THEN 'u' || user_id END"
SOURCE_IP = "'10.1.' || k || '.9'"
BAD = "(k % 4 = 0)"
#: syslog code and Windows level of the record's own severity
CODE, LEVEL = "(event_id % 5 + 2)", "CASE event_id % 5 WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 4 END"
COMMON = {"timestamp": "CAST(ts AS STRING)", "severity": SEVERITY, "hostname": HOST, "user_name": USER, "source_ip": SOURCE_IP,
          "is_malicious": f"CASE WHEN {BAD} THEN 'true' END", "source": "'lab'"}
INFO, WARNING, ERROR = "6", "4", "3"


def either(test: str, a: str, b: str) -> str:
    return f"CASE WHEN {test} THEN {a} ELSE {b} END"


@dataclass(frozen=True)
class Play:
    """A class: its event type, the input beside the common one, and what is expected.

    ``syslog``: message, host without a name, tag, facility code, severity code, process id.
    ``event``: id, provider, channel, host without a name, level, data. ``columns``: public name and text.
    """

    name: str
    kind: str
    given: dict[str, str]
    syslog: tuple[str, str, str, int, str, str]
    event: tuple[str, str, str, str, str, tuple[tuple[str, str], ...]]
    columns: dict[str, str]
    host: str = HOST


AUDITING, SYSMON = "Microsoft-Windows-Security-Auditing", "Microsoft-Windows-Sysmon"
URL = "'http://s' || k || '.test/?a=1&b=' || k"
PATH = "'D:' || chr(92) || 'data' || chr(92) || k"
NAME = "'h' || k || '.test'"
ISO = ("(strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END || '+00:00')")
UTC = "(strftime(ts, '%Y-%m-%d %H:%M:%S.') || lpad(CAST(epoch_us(ts) % 1000000 // 1000 AS VARCHAR), 3, '0'))"
FAILED = "k % 3 = 0"
QTYPE, RCODE = either("k % 2 = 0", "'AAAA'", "'A'"), either(FAILED, "'3'", "'0'")
STATUS = "CASE k % 3 WHEN 0 THEN 200 WHEN 1 THEN 404 ELSE 503 END"
HTTP_CODE, HTTP_LEVEL = "CASE k % 3 WHEN 0 THEN 6 WHEN 1 THEN 4 ELSE 3 END", "CASE k % 3 WHEN 0 THEN 4 WHEN 1 THEN 3 ELSE 2 END"
ACTION = either("k % 5 = 0", "'FileDeleted'", "'FileModified'")
RESULT = either(FAILED, "'50126'", "'0'")
LOGON = either(FAILED, "'Failed'", "'Success'")
VERDICT = either("k % 3 = 0", "'Malicious'", "'Clean'")
DONE = either(FAILED, "'denied'", "'success'")


def plain(source: str, type_name: str):
    return ("'0'", source, source, "-", LEVEL, (("Type", f"'{type_name}'"), ("Severity", SEVERITY)))


PLAYS = (
    Play("dns", "dns_query",
         {"Name": NAME, "QueryType": "CASE WHEN k % 2 = 0 THEN 'AAAA' END", "response_code": f"CASE WHEN {FAILED} THEN '3' END",
          "resolved_ip": "CASE WHEN k % 5 = 0 THEN '192.0.2.7' END"},
         (f"'query: ' || {NAME} || ' IN ' || {QTYPE} || ' ' || {either(FAILED, chr(39) + 'NXDOMAIN' + chr(39), chr(39) + 'NOERROR' + chr(39))}", "NS", "'named'", 3, INFO, "0"),
         ("'256'", "Microsoft-Windows-DNSServer", "Microsoft-Windows-DNSServer/Analytical", "NS", "4",
          (("QNAME", NAME), ("QTYPE", either("k % 2 = 0", "28", "1")), ("XID", f"('0x' || substr(md5({NAME} || {ISO}), 1, 4))::INT"), ("Source", SOURCE_IP),
           ("Destination", either("k % 5 = 0", "'192.0.2.7'", "'0.0.0.0'")), ("RCODE", RCODE), ("InterfaceIP", "'0.0.0.0'"))),
         {"SourceSystem": "'DNS'", "Type": "'DnsEvents'", "Name": NAME, "QueryType": QTYPE, "ResultCode": RCODE, "IPAddresses": "CASE WHEN k % 5 = 0 THEN '192.0.2.7' END"}),
    Play("proxy", "web_proxy", {"url": URL, "http_method": "'GET'", "http_status": f"CAST({STATUS} AS STRING)", "user_agent": "'<agent>'"},
         (f"'GET ' || {URL} || ' -> ' || {STATUS}", "PROXY", "'squid'", 3, INFO, "0"),
         ("'1'", "Microsoft-Windows-W3CIISLog", "W3CIISLog", "PROXY", "4", (("cs-uri-stem", URL), ("cs-method", "'GET'"), ("sc-status", STATUS), ("cs-user-agent", "'<agent>'"))),
         {"SourceSystem": "'Proxy'", "Type": "'W3CIISLog'", "RequestURL": URL, "Method": "'GET'", "Status": f"CAST({STATUS} AS STRING)", "UserAgent": "'<agent>'", "ContentType": "NULL"}),
    Play("vpn", "vpn_session", {"client_ip": "'198.51.100.' || k", "assigned_ip": "CASE WHEN k % 2 = 0 THEN '10.9.0.' || k END", "action": "CASE WHEN k % 3 = 0 THEN 'disconnect' END"},
         (f"'client 198.51.100.' || k || ' -> ' || {either('k % 2 = 0', chr(39) + '10.9.0.' + chr(39) + ' || k', chr(39) + 'None' + chr(39))} || ' action=' || {either('k % 3 = 0', chr(39) + 'disconnect' + chr(39), chr(39) + 'connect' + chr(39))}",
          "VPN", "'openvpn'", 3, INFO, "0"),
         ("'20224'", AUDITING, "Security", "VPN", "4", (("ClientIP", "'198.51.100.' || k"), ("AssignedIP", either("k % 2 = 0", "'10.9.0.' || k", "''")), ("SessionDuration", "'3600'"))),
         {"SourceSystem": "'Firewall'", "Type": "'CommonSecurityLog'", "SourceIP": "'198.51.100.' || k", "DeviceCustomString1": "CASE WHEN k % 2 = 0 THEN '10.9.0.' || k END",
          "DeviceCustomNumber1": "'3600'", "DeviceAction": either("k % 3 = 0", "'disconnect'", "'connect'")}),
    Play("cloud_app", "cloud_app_event", {"app_name": "'App ' || k", "action_type": "'Consent'", "risk_level": "CASE WHEN k % 3 = 0 THEN 'High' END", "permissions": "'Mail.Read'"},
         (f"'App=App ' || k || ' Activity=Consent User=' || coalesce({USER}, 'None') || ' Risk=' || {either(FAILED, chr(39) + 'High' + chr(39), chr(39) + 'None' + chr(39))}", "-", "'CAS'", 3, either(BAD, WARNING, INFO), "0"),
         ("'9103'", "Acme-CloudAppEvent", "Application", "-", either(BAD, "2", "4"), (("AppName", "'App ' || k"), ("ActionType", "'Consent'"), ("RiskLevel", either(FAILED, "'High'", "'None'")))),
         {"SourceSystem": "'Cloud App Security'", "Type": "'CloudAppEvents'", "Application": "'App ' || k", "ActivityType": "'Access'", "AppPermissions": "'Mail.Read'", "IsThirdPartyApp": "'true'"}),
    Play("identity_logon", "identity_logon", {"LogonResult": f"CASE WHEN {FAILED} THEN 'Failed' END", "target_device": "CASE WHEN k % 2 = 0 THEN 'DC-' || k END"},
         (f"'Logon Interactive via Kerberos for ' || coalesce({USER}, 'None') || ' from ' || {SOURCE_IP} || ' result=' || {LOGON}", "DC", "'lsass'", 10, either(FAILED, ERROR, INFO), "0"),
         (either(FAILED, "'4625'", "'4624'"), AUDITING, "Security", "DC", either(FAILED, "2", "4"),
          (("LogonType", "'Interactive'"), ("TargetUserName", f"coalesce({USER}, '')"), ("IpAddress", SOURCE_IP), ("WorkstationName", either("k % 2 = 0", "'DC-' || k", "''")))),
         {"SourceSystem": "'Identity Protection'", "Type": "'IdentityLogonEvents'", "LogonType": "'Interactive'", "Protocol": "'Kerberos'", "LogonResult": LOGON, "IsAdminLogon": "'false'"}),
    Play("service_signin", "non_interactive_signin", {"app_id": "'a' || k", "resource_id": "'r' || k", "service_principal_name": "CASE WHEN k % 2 = 0 THEN 'sp' || k END",
                                                      "resource_name": "CASE WHEN k % 5 = 0 THEN 'Vault' END", "status": f"CASE WHEN {FAILED} THEN '50126' END"},
         (f"'Non-interactive sign-in ' || {either(FAILED, chr(39) + 'failed' + chr(39), chr(39) + 'accepted' + chr(39))} || ' for ' || {either('k % 2 = 0', chr(39) + 'sp' + chr(39) + ' || k', chr(39) + 'a' + chr(39) + ' || k')} || ' resource=r' || k",
          "SERVER", "'MicrosoftGraph'", 10, INFO, "0"),
         (either(FAILED, "'4625'", "'4624'"), AUDITING, "Security", "SERVER", either(FAILED, "2", "4"),
          (("ServicePrincipal", either("k % 2 = 0", "'sp' || k", "''")), ("AppId", "'a' || k"), ("Resource", either("k % 5 = 0", "'Vault'", "'r' || k")), ("Result", RESULT))),
         {"SourceSystem": "'Azure AD'", "Type": "'AADNonInteractiveUserSignInLogs'", "AppId": "'a' || k", "ResultType": RESULT, "ConditionalAccessStatus": "'notApplied'", "TokenIssuerType": "'Azure AD'",
          "UserAgent": "'MicrosoftGraph/1.0'", "ClientAppUsed": "'Other'"}),
    Play("email", "email_event", {"sender": "'a' || k || '@x.test'", "Recipient": "'b@y.test'", "subject": "'Offer <' || k || '>'", "SPFPass": "CASE WHEN k % 2 = 0 THEN 'false' END",
                                  "DetectionMethod": "CASE WHEN k % 3 = 0 THEN 'URL' END", "url_count": "CAST(k AS STRING)"},
         ("'Email from=a' || k || '@x.test to=b@y.test subject=Offer <' || k || '> verdict=NoAttachment'", "MAIL", "'msexchange'", 2, either(BAD, WARNING, INFO), "0"),
         ("'1033'", "MSExchange Messaging", "Application", "MAIL", either(BAD, "2", "4"),
          (("Sender", "'a' || k || '@x.test'"), ("Recipient", "'b@y.test'"), ("Subject", "'Offer <' || k || '>'"), ("AttachmentVerdict", "'NoAttachment'"))),
         {"SourceSystem": "'Microsoft Defender for Office 365'", "Type": "'EmailEvents'", "SenderFromAddress": "'a' || k || '@x.test'", "DetectionMethods": either(FAILED, "'URL'", "'None'"),
          "LatestDeliveryLocation": "'Inbox'", "EmailDirection": "'Inbound'", "UrlCount": "CAST(k AS STRING)", "AttachmentCount": "'0'", "SPFPass": "NULL",
          "AuthenticationDetails": "'SPF: ' || CASE WHEN k % 2 = 0 THEN 'fail' ELSE 'pass' END || '; DKIM: pass; DMARC: pass'"}),
    Play("email_attachment", "email_attachment", {"file_name": "'f' || k || '.zip'", "verdict": f"CASE WHEN {FAILED} THEN 'Malicious' END"},
         (f"'Attachment f' || k || '.zip verdict=' || {VERDICT}", "MAIL", "'msexchange'", 2, either(FAILED, WARNING, INFO), "0"),
         ("'1034'", "MSExchange Messaging", "Application", "MAIL", either(FAILED, "2", "4"), (("FileName", "'f' || k || '.zip'"), ("Verdict", VERDICT))),
         {"Type": "'EmailAttachmentInfo'", "FileName": "'f' || k || '.zip'", "Verdict": VERDICT, "NetworkMessageId": sql_uuid("'run-1|' || event_id || '|network_message_id'")}),
    Play("alert", "security_alert", {"AlertName": "'Alert ' || k", "CompromisedEntity": "CASE WHEN k % 2 = 0 THEN 'E-' || k END"},
         ("'ALERT: Alert ' || k || ' [MaliciousActivity] confidence=High'", "-", "'Acme'", 10, CODE, "0"),
         ("'9101'", "Acme-SentinelAlert", "Application", "-", LEVEL, (("AlertName", "'Alert ' || k"), ("AlertType", "'MaliciousActivity'"), ("Severity", SEVERITY), ("Confidence", "'1.0'"))),
         {"SourceSystem": "'SecurityInsights'", "Type": "'SecurityAlert'", "AlertName": "'Alert ' || k", "ProviderName": "'Acme'", "ConfidenceLevel": "'High'", "Entities": "'[]'"},
         "CASE WHEN k % 2 = 0 THEN 'E-' || k END"),
    Play("incident", "security_incident", {"Title": "'Case ' || k"},
         (f"'SecurityIncident: severity=' || {SEVERITY}", "-", "'SecurityInsights'", 1, INFO, "0"),
         ("'9102'", "Acme-SentinelIncident", "Application", "-", LEVEL,
          (("IncidentNumber", "'INC' || (100000 + (('0x' || substr(md5('run-1|' || event_id || '|incident_number'), 1, 8))::BIGINT % 900000))"), ("Title", "'Case ' || k"), ("Status", "'New'"))),
         {"Type": "'SecurityIncident'", "Title": "'Case ' || k", "Status": "'New'", "Owner": "'Unassigned'", "RelatedAnalyticRuleIds": "'[]'"}),
    Play("directory_audit", "directory_audit", {"operation_name": "'Add member ' || k", "initiated_by": "CASE WHEN k % 2 = 0 THEN 'admin' || k END"},
         (f"'Add member ' || k || ' result=success by=' || {either('k % 2 = 0', chr(39) + 'admin' + chr(39) + ' || k', f'coalesce({USER}, ' + chr(39) + '-' + chr(39) + ')')}", "AAD", "'AzureADAudit'", 10, CODE, "0"),
         ("'9104'", "Acme-AzureADAudit", "Application", "-", LEVEL, (("OperationName", "'Add member ' || k"), ("Result", "'success'"), ("TargetResources", "''"))),
         {"SourceSystem": "'Azure AD'", "Type": "'AuditLogs'", "OperationName": "'Add member ' || k", "Category": "'UserManagement'", "Result": "'success'"}),
    Play("workspace_audit", "audit", {"action": "'Rule ' || k || ' changed'"},
         ("'Rule ' || k || ' changed'", "SENTINEL", "'SentinelAudit'", 10, CODE, "0"),
         ("'9105'", "Acme-SentinelAudit", "Application", "-", LEVEL, (("Action", "'Rule ' || k || ' changed'"),)),
         {"SourceSystem": "'sentinel_audit'", "Type": "'audit'", "Action": "'Rule ' || k || ' changed'"}),
    Play("web", "web_request", {"RequestURL": URL, "Method": "'POST'", "Status": f"CAST({STATUS} AS STRING)", "UserAgent": "'agent'", "TimeTaken": "CAST(k AS STRING)"},
         (f"{SOURCE_IP} || ' - \"POST ' || {URL} || '\" ' || {STATUS} || ' ' || k || 'ms'", "WEB", "'httpd'", 3, HTTP_CODE, "0"),
         ("'1'", "Microsoft-Windows-W3CIISLog", "W3CIISLog", "WEB", HTTP_LEVEL,
          (("cs-uri-stem", URL), ("cs-method", "'POST'"), ("sc-status", STATUS), ("cs-user-agent", "'agent'"), ("time-taken", "k"))),
         {"SourceSystem": "'Web'", "Type": "'W3CIISLog'", "RequestURL": URL, "TimeTaken": "CAST(k AS STRING)", "referrer": "NULL"}),
    Play("database", "db_query", {"LogicalServerName": "'db' || k", "QueryText": "rpad('SELECT ' || k, 130, 'x')", "OperationName": "'READ'", "ResultType": f"CASE WHEN {FAILED} THEN 'denied' END"},
         (f"'READ on db' || k || ': ' || rpad('SELECT ' || k, 120, 'x') || ' [' || {DONE} || ']'", "DB", "'postgres'", 3, either(FAILED, ERROR, INFO), "0"),
         ("'33205'", "MSSQLSERVER", "Application", "DB", either(FAILED, "2", "4"), (("Database", "'db' || k"), ("Query", "rpad('SELECT ' || k, 130, 'x')"), ("Operation", "'READ'"), ("Status", DONE))),
         {"SourceSystem": "'Azure'", "Type": "'AzureDiagnostics'", "LogicalServerName": "'db' || k", "ResultType": DONE, "NumAffectedRows": "NULL"}),
    Play("syslog", "system_event", {"Message": "'unit ' || k || ' started'", "Facility": "CASE WHEN k % 2 = 0 THEN 'DAEMON' END"},
         ("'unit ' || k || ' started'", "localhost", "'system'", -1, CODE, "0"), plain("syslog", "Syslog"),
         {"SourceSystem": "'syslog'", "Type": "'Syslog'", "ProcessName": "'system'", "Facility": either("k % 2 = 0", "'DAEMON'", "'user'"), "Message": "'unit ' || k || ' started'"}),
    Play("device_event", "device_event", {"action": "'UsbDriveMounted'"},
         ("'DeviceEvent: UsbDriveMounted'", "WKS", f"'{AUDITING}'", 1, INFO, "0"),
         ("'9106'", "Acme-DeviceEvents", "Application", "WKS", "4", (("ActionType", "'UsbDriveMounted'"),)),
         {"SourceSystem": "'endpoint'", "Type": "'DeviceEvents'", "ActionType": "'UsbDriveMounted'", "DeviceId": sql_uuid("'run-1|' || event_id || '|device_id'")}),
    Play("file", "file_system", {"FileName": "'f' || k || '.txt'", "file_path": PATH, "action": "CASE WHEN k % 5 = 0 THEN 'FileDeleted' END", "file_size": "CAST(event_id AS STRING)"},
         (f"'File ' || {ACTION} || ': ' || {PATH} || chr(92) || 'f' || k || '.txt'", "WKS", f"'{AUDITING}'", 1, INFO, "0"),
         (either("k % 5 = 0", "'23'", "'11'"), SYSMON, SYSMON + "/Operational", "WKS", "4",
          (("RuleName", ACTION), ("UtcTime", UTC), ("Image", "''"), ("TargetFilename", f"{PATH} || chr(92) || 'f' || k || '.txt'"), ("User", f"coalesce({USER}, '')"))),
         {"Type": "'DeviceFileEvents'", "ActionType": ACTION, "FolderPath": PATH, "FileSize": "CAST(event_id AS STRING)", "SHA1": "NULL"}),
    Play("registry_value", "registry", {"key_path": PATH, "value_name": "CASE WHEN k % 2 = 0 THEN 'Run' END", "RegistryValueData": "'it''s ' || k"},
         (f"'Registry RegistryValueSet: Key=' || {PATH} || ' Name=' || {either('k % 2 = 0', chr(39) + 'Run' + chr(39), chr(39) + 'None' + chr(39))}", "WKS", f"'{AUDITING}'", 1, INFO, "0"),
         ("'4657'", AUDITING, "Security", "WKS", "4", (("ObjectName", PATH), ("ObjectValueName", either("k % 2 = 0", "'Run'", "''")), ("NewValue", "'it''s ' || k"))),
         {"Type": "'DeviceRegistryEvents'", "RegistryKey": PATH, "RegistryValueData": "'it''s ' || k", "RegistryValueName": "CASE WHEN k % 2 = 0 THEN 'Run' END"}),
    Play("linux_kernel", "linux_kernel", {"Message": "'usb ' || k || ' attached'"},
         ("'usb ' || k || ' attached'", "localhost", "'kernel'", 0, CODE, "0"), plain("linux", "linux_kernel"),
         {"SourceSystem": "'linux'", "Type": "'linux_kernel'", "OSPlatform": "'Linux'", "DeviceCategory": "'Server'", "ProcessId": "'0'"}),
    Play("macos_log", "macos_process", {"pid": "CAST(k AS STRING)", "proc": "'authd'", "Message": "'check ' || k"},
         ("'check ' || k", "MacBook-Pro", "'authd'", 4, CODE, "k"), plain("macos", "macos_log"),
         {"SourceSystem": "'macos'", "Type": "'macos_log'", "OSPlatform": "'macOS'", "Subsystem": "'com.apple.authd'", "Category": "'default'", "SenderImage": "'/usr/libexec/authd'"}),
    Play("macos_auth", "macos_auth", {"ProcessId": "CAST(k AS STRING)", "log_message": "'login ' || k", "user": "'m' || k"},
         ("'login ' || k", "MacBook-Pro", "'authd'", 4, CODE, "k"), plain("macos", "macos_auth"),
         {"Type": "'macos_auth'", "ProcessName": "'authd'", "AccountName": "'m' || k", "DeviceCategory": "'Workstation'"}),
    Play("macos_exec", "macos_exec", {"pid": "CAST(k AS STRING)", "bundle_id": "'b.' || k", "app_path": "'/A/' || k", "Message": "'exec ' || k"},
         ("'exec ' || k", "MacBook-Pro", "'kernel'", 1, CODE, "k"), plain("macos", "macos_exec"),
         {"Type": "'macos_exec'", "BundleId": "'b.' || k", "AppPath": "'/A/' || k", "Signer": "'Not signed'", "ProcessName": "'kernel'"}),
)


def _xml(text: str) -> str:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        text = f"replace({text}, '{char}', '{entity}')" if char != "''" else f"replace({text}, '''', '{entity}')"
    return text


def _sql(play: Play) -> str:
    message, host, tag, facility, severity, pid = play.syslog
    code = either("k % 2 = 0", "3", "1") if facility < 0 else str(facility)
    syslog = (f"'<' || ({code} * 8 + {severity}) || '>' || strftime(ts, '%b %d %H:%M:%S') || ' ' || coalesce({play.host}, '{host}') || ' ' || {tag} || '[' || {pid} || ']: ' || {message}")
    event_id, provider, channel, host, level, data = play.event
    parts = " || ".join(f"'<Data Name=''{label}''>' || {_xml(f'CAST({value} AS VARCHAR)')} || '</Data>'" for label, value in data)
    event = (f"'<Event xmlns=''http://schemas.microsoft.com/win/2004/08/events/event''><System><Provider Name=''{provider}''/><EventID>' || {event_id} || '</EventID><Version>0</Version><Level>' || {level} "
             f"|| '</Level><TimeCreated SystemTime=''' || strftime(ts, '%Y-%m-%dT%H:%M:%S.000Z') || '''/><Channel>{channel}</Channel><Computer>' || coalesce({play.host}, '{host}') "
             f"|| '</Computer><Security/></System><EventData>' || {parts} || '</EventData></Event>'")
    columns = " || '; ' || ".join(f"'{name}=' || coalesce({value}, '-')" for name, value in play.columns.items())
    return f"""WITH {EV}, x AS (SELECT event_id, {columns} AS json, {syslog} AS syslog, {event} AS winxml FROM ev)
SELECT event_id AS row_id, 'json' AS feed, json AS line FROM x UNION ALL SELECT event_id, 'syslog', syslog FROM x UNION ALL SELECT event_id, 'winxml', winxml FROM x"""


def _run(play: Play):
    def run(spark, sf):
        given = {"event_type": f"'{play.kind}'", **COMMON, **play.given}
        entries = ", ".join(f"named_struct('key', '{name}', 'value', {value})" for name, value in given.items())
        raw = F.expr(f"map_from_entries(transform(filter(array({entries}), e -> e.value IS NOT NULL), e -> struct(e.key, e.value)))")
        records = dealt(events(spark, sf)).select(F.col("event_id").alias("row_id"), raw.alias("raw"))
        good, _ = N.normalize(N.route_event_type(N.flatten_data(records)), play.name, SETTINGS)
        good = stored(good)  # the three exports read it
        json = X.export_json(good, play.name, ("row_id",))
        json = json.select("row_id", "feed", F.json_tuple("line", *play.columns).alias(*play.columns))  # one parse for all of them
        shown = [F.concat(F.lit(f"{name}="), F.coalesce(name, F.lit("-"))) for name in play.columns]
        out = json.select("row_id", "feed", F.concat_ws("; ", *shown).alias("line"))
        for lines in (X.export_syslog(good, play.name, SETTINGS, ("row_id",)), X.export_winevent_xml(good, play.name, SETTINGS, ("row_id",), gate=False)):
            out = out.unionByName(lines.select("row_id", "feed", "line"))
        return out

    run.__name__ = f"class_{play.name}"
    run.__doc__ = f"Columns, syslog line and Windows event of ``{play.name}`` records."
    return run


for _play in PLAYS:
    query(_sql(_play))(_run(_play))
