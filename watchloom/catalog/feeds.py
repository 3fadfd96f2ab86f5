"""Feed formats of the event classes.

Fixed values: message texts, event ids, providers, host defaults and data names are the wire
formats. ``{name}`` in a text is a column printed the way the feeds print it; everything else is
SQL over the columns of the class. ``{vendor}`` in a provider is the configured product name.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from watchloom.catalog import dims
from watchloom.functions.sqltext import iso_ts, lit, lookup, or_default, syslog_priority

AUDITING = ("Microsoft-Windows-Security-Auditing", "Security")
SYSMON = ("Microsoft-Windows-Sysmon", "Microsoft-Windows-Sysmon/Operational")
IIS = ("Microsoft-Windows-W3CIISLog", "W3CIISLog")
EXCHANGE = ("MSExchange Messaging", "Application")


@dataclass(frozen=True)
class SyslogFormat:
    message: str
    host: str
    tag: str
    facility: str = "'user'"
    severity: str = "'info'"
    pid: str = "0"
    host_column: str = "hostname"
    let: dict = field(default_factory=dict)


@dataclass(frozen=True)
class WinEventFormat:
    event_id: str
    origin: tuple[str, str]
    host: str
    data: tuple[tuple[str, str], ...]
    severity: str = "'info'"
    host_column: str = "hostname"


@dataclass(frozen=True)
class VendorFormat:
    """A vendor line: its feed, text and the SQL behind its slots; ``when`` picks among several."""

    feed: str
    text: str
    let: dict
    when: str = "true"


@dataclass(frozen=True)
class AuditdFormat:
    """Records of one event; ``argv`` adds the record that lists split arguments."""

    record: str
    fields: str
    let: dict = field(default_factory=dict)
    argv: str | None = None


BLOCKED = "if(action = 'blocked', 'warning', 'info')"
HTTP = "CASE WHEN status_code >= 500 THEN 'err' WHEN status_code >= 400 THEN 'warning' ELSE 'info' END"
MALICIOUS = "if(is_malicious, 'warning', 'info')"
RESULT_OK = "result_type = '0'"
LOGON_OK = "logon_result = 'Success'"
UNCLEAN = "lower(verdict) <> 'clean'"
FILE_FULL = r"concat(folder_path, '\\', file_name)"
UTC_TIME = "date_format(timestamp, 'yyyy-MM-dd HH:mm:ss.SSS')"
MAC_HOST = "MacBook-Pro"

DEFAULT_SYSLOG = SyslogFormat("{event_type}: severity={severity}", "-", "{source}")
DEFAULT_WINEVENT = WinEventFormat(
    "0", ("{source}", "{source}"), "-", (("Type", "event_type"), ("Severity", "severity")),
    severity="severity",
)

SYSLOG = {
    "process": SyslogFormat(
        "Process Created: {file_name} Cmd={command_line} User={user_name}", "WKS", AUDITING[0],
        pid="process_id"),
    "device_event": SyslogFormat("DeviceEvent: {action_type}", "WKS", AUDITING[0]),
    "file": SyslogFormat(r"File {action_type}: {folder_path}\{file_name}", "WKS", AUDITING[0]),
    "registry_value": SyslogFormat(
        "Registry {action_type}: Key={key_path} Name={value_name}", "WKS", AUDITING[0]),
    "firewall": SyslogFormat(
        "ACTION={action} PROTO={protocol} SRC={source_ip}:{source_port} DST={dest_ip}:{dest_port}",
        "FW", "firewalld", "'kern'", BLOCKED),
    "dns": SyslogFormat(
        "query: {query_name} IN {query_type} {rc}", "NS", "named", "'daemon'",
        let={"rc": "if(response_code = '0', 'NOERROR', 'NXDOMAIN')"}),
    "proxy": SyslogFormat("{http_method} {url} -> {http_status}", "PROXY", "squid", "'daemon'"),
    "signin": SyslogFormat(
        "Authentication {result} for {user_principal_name} from {source_ip}", "SERVER", "AzureAD",
        "'authpriv'", let={"result": f"if({RESULT_OK}, 'accepted', 'failed')"}),
    "vpn": SyslogFormat(
        "client {client_ip} -> {assigned_ip} action={action}", "VPN", "openvpn", "'daemon'"),
    "cloud_app": SyslogFormat(
        "App={app_name} Activity={action_type} User={user_name} Risk={risk_level}", "-", "CAS",
        "'daemon'", MALICIOUS),
    "identity_logon": SyslogFormat(
        "Logon {logon_type} via {protocol} for {user_name} from {source_ip} result={logon_result}",
        "DC", "lsass", "'authpriv'", f"if({LOGON_OK}, 'info', 'err')"),
    "service_signin": SyslogFormat(
        "Non-interactive sign-in {result} for {principal} resource={resource_id}", "SERVER",
        "MicrosoftGraph", "'authpriv'",
        let={"result": f"if({RESULT_OK}, 'accepted', 'failed')",
             "principal": "coalesce(nullif(service_principal_name, ''), app_id)"}),
    "email": SyslogFormat(
        "Email from={sender} to={recipient} subject={subject} verdict={attachment_verdict}", "MAIL",
        "msexchange", "'mail'", MALICIOUS),
    "email_attachment": SyslogFormat(
        "Attachment {file_name} verdict={verdict}", "MAIL", "msexchange", "'mail'",
        f"if({UNCLEAN}, 'warning', 'info')"),
    "alert": SyslogFormat(
        "ALERT: {alert_name} [{alert_type}] confidence={confidence_level}", "-", "{vendor}",
        "'authpriv'", "severity", host_column="compromised_entity"),
    "directory_audit": SyslogFormat(
        "{operation_name} result={result} by={actor}", "AAD", "AzureADAudit", "'authpriv'",
        "severity",
        let={"actor": "coalesce(nullif(initiated_by, ''), nullif(user_name, ''), '-')"}),
    "workspace_audit": SyslogFormat("{action}", "SENTINEL", "SentinelAudit", "'authpriv'", "severity"),
    "web": SyslogFormat(
        '{source_ip} - "{http_method} {url}" {status_code} {response_time_ms}ms', "WEB", "httpd",
        "'daemon'", HTTP),
    "syslog": SyslogFormat("{log_message}", "localhost", "{proc}", "lower(facility)", "severity"),
    "database": SyslogFormat(
        "{operation} on {db_name}: {query} [{status}]", "DB", "postgres", "'daemon'",
        "if(status <> 'success', 'err', 'info')", let={"query": "substring(query_text, 1, 120)"}),
    "linux_auth": SyslogFormat("{log_message}", "localhost", "{proc}", "'auth'", "severity", "pid"),
    "linux_sudo": SyslogFormat(
        "   {user} : TTY={tty} ; PWD={pwd} ; USER={target_user} ; COMMAND={command}", "localhost",
        "sudo", "'authpriv'", "severity", "pid"),
    "linux_audit": SyslogFormat(
        "type={audit_type} msg=audit({epoch}.000:{pid}): {audit_msg}", "localhost", "kernel",
        "'kern'", "severity", "pid", let={"epoch": "unix_seconds(timestamp)"}),
    "linux_kernel": SyslogFormat("{log_message}", "localhost", "kernel", "'kern'", "severity", "pid"),
    "linux_cron": SyslogFormat("({user}) CMD ({command})", "localhost", "CRON", "'cron'", pid="pid"),
    "linux_process": SyslogFormat(
        'audit: execve pid={pid} ppid={ppid} exe="{exe}" args="{args}" uid={uid} gid={gid}',
        "localhost", "auditd", "'authpriv'", pid="pid"),
    "macos_log": SyslogFormat("{log_message}", MAC_HOST, "{proc}", "'auth'", "severity", "pid"),
    "macos_auth": SyslogFormat("{log_message}", MAC_HOST, "{proc}", "'auth'", "severity", "pid"),
    "macos_exec": SyslogFormat("{log_message}", MAC_HOST, "{proc}", "'user'", "severity", "pid"),
}

WINEVENT = {
    "process": WinEventFormat("4688", AUDITING, "WKS", (
        ("NewProcessId", "concat('0x', lower(hex(process_id)))"),
        ("NewProcessName", FILE_FULL),
        ("ProcessId", "concat('0x', lower(hex(coalesce(parent_process_id, 0))))"),
        ("ParentProcessName", "coalesce(parent_process_name, '')"),
        ("CommandLine", "command_line"))),
    "device_event": WinEventFormat("9106", ("{vendor}-DeviceEvents", "Application"), "WKS", (
        ("ActionType", "action_type"),)),
    "file": WinEventFormat("if(lower(action_type) LIKE '%delete%', 23, 11)", SYSMON, "WKS", (
        ("RuleName", "action_type"),
        ("UtcTime", UTC_TIME),
        ("Image", "coalesce(initiating_process_file_name, '')"),
        ("TargetFilename", FILE_FULL),
        ("User", "coalesce(user_name, '')"))),
    "registry_value": WinEventFormat("4657", AUDITING, "WKS", (
        ("ObjectName", "key_path"),
        ("ObjectValueName", "coalesce(value_name, '')"),
        ("NewValue", "coalesce(value_data, '')"))),
    "firewall": WinEventFormat("3", SYSMON, "FW", (
        ("RuleName", "action"),
        ("UtcTime", UTC_TIME),
        ("Protocol", "lower(protocol)"),
        ("Initiated", "if(direction = 'Outbound', 'true', 'false')"),
        ("SourceIp", "coalesce(source_ip, '')"),
        ("SourcePort", "source_port"),
        ("DestinationIp", "coalesce(dest_ip, '')"),
        ("DestinationPort", "dest_port")), BLOCKED),
    "dns": WinEventFormat("256", ("Microsoft-Windows-DNSServer", "Microsoft-Windows-DNSServer/Analytical"), "NS", (
        ("QNAME", "query_name"),
        ("QTYPE", lookup("upper(query_type)", dims.DNS_QUERY_TYPE, 1)),
        ("XID", f"CAST(conv(substring(md5(concat(query_name, {iso_ts('timestamp')})), 1, 4), 16, 10) AS INT)"),
        ("Source", "coalesce(nullif(source_ip, ''), '0.0.0.0')"),
        ("Destination", "coalesce(nullif(resolved_ip, ''), '0.0.0.0')"),
        ("RCODE", "response_code"),
        ("InterfaceIP", "coalesce(nullif(dest_ip, ''), '0.0.0.0')"))),
    "proxy": WinEventFormat("1", IIS, "PROXY", (
        ("cs-uri-stem", "url"), ("cs-method", "http_method"), ("sc-status", "http_status"),
        ("cs-user-agent", "user_agent"))),
    "signin": WinEventFormat(f"if({RESULT_OK}, 4624, 4625)", AUDITING, "SERVER", (
        ("TargetUserName", "user_principal_name"),
        ("LogonType", "client_app_used"),
        ("IpAddress", "coalesce(source_ip, '')")), f"if({RESULT_OK}, 'info', 'err')"),
    "vpn": WinEventFormat("20224", AUDITING, "VPN", (
        ("ClientIP", "client_ip"),
        ("AssignedIP", "coalesce(assigned_ip, '')"),
        ("SessionDuration", "coalesce(session_duration, 0)"))),
    "cloud_app": WinEventFormat("9103", ("{vendor}-CloudAppEvent", "Application"), "-", (
        ("AppName", "app_name"), ("ActionType", "action_type"), ("RiskLevel", "risk_level")),
        "if(is_malicious, 'high', 'informational')"),
    "identity_logon": WinEventFormat(f"if({LOGON_OK}, 4624, 4625)", AUDITING, "DC", (
        ("LogonType", "logon_type"),
        ("TargetUserName", "coalesce(user_name, '')"),
        ("IpAddress", "coalesce(source_ip, '')"),
        ("WorkstationName", "coalesce(target_device, '')")), f"if({LOGON_OK}, 'info', 'err')"),
    "service_signin": WinEventFormat(f"if({RESULT_OK}, 4624, 4625)", AUDITING, "SERVER", (
        ("ServicePrincipal", "coalesce(service_principal_name, '')"),
        ("AppId", "app_id"),
        ("Resource", "coalesce(nullif(resource_display_name, ''), resource_id)"),
        ("Result", "result_type")), f"if({RESULT_OK}, 'info', 'err')"),
    "email": WinEventFormat("1033", EXCHANGE, "MAIL", (
        ("Sender", "sender"), ("Recipient", "recipient"), ("Subject", "subject"),
        ("AttachmentVerdict", "attachment_verdict")), "if(is_malicious, 'err', 'info')"),
    "email_attachment": WinEventFormat("1034", EXCHANGE, "MAIL", (
        ("FileName", "file_name"), ("Verdict", "verdict")), f"if({UNCLEAN}, 'err', 'info')"),
    "alert": WinEventFormat("9101", ("{vendor}-SentinelAlert", "Application"), "-", (
        ("AlertName", "alert_name"), ("AlertType", "alert_type"), ("Severity", "severity"),
        ("Confidence", "confidence_score")), "severity", host_column="compromised_entity"),
    "incident": WinEventFormat("9102", ("{vendor}-SentinelIncident", "Application"), "-", (
        ("IncidentNumber", "incident_number"), ("Title", "title"), ("Status", "status")), "severity"),
    "directory_audit": WinEventFormat("9104", ("{vendor}-AzureADAudit", "Application"), "-", (
        ("OperationName", "operation_name"), ("Result", "result"),
        ("TargetResources", "coalesce(target_resources, '')")), "severity"),
    "workspace_audit": WinEventFormat("9105", ("{vendor}-SentinelAudit", "Application"), "-", (
        ("Action", "action"),), "severity"),
    "web": WinEventFormat("1", IIS, "WEB", (
        ("cs-uri-stem", "url"), ("cs-method", "http_method"), ("sc-status", "status_code"),
        ("cs-user-agent", "user_agent"), ("time-taken", "response_time_ms")), HTTP),
    "database": WinEventFormat("33205", ("MSSQLSERVER", "Application"), "DB", (
        ("Database", "db_name"), ("Query", "query_text"), ("Operation", "operation"),
        ("Status", "status")), "if(status <> 'success', 'err', 'info')"),
}

AUTH_FAILED = f"lower(log_message) RLIKE {lit(dims.AUTH_FAILED)}"

AUDITD = {
    "linux_auth": AuditdFormat(
        f"if({AUTH_FAILED}, 'USER_AUTH', 'USER_LOGIN')",
        "pid={pid} uid=0 auid=4294967295 ses=4294967295 "
        "msg='op=login exe=\"/usr/sbin/{proc}\" hostname={host} terminal=ssh res={result}'",
        let={"host": "coalesce(nullif(hostname, ''), 'localhost')",
             "result": f"if({AUTH_FAILED}, 'failed', 'success')"}),
    "linux_sudo": AuditdFormat(
        "'USER_CMD'",
        "pid={pid} uid=1000 auid=1000 ses=1 "
        "msg='cwd=\"{pwd}\" cmd={command_hex} terminal={tty} res=success'",
        let={"command_hex": "lower(hex(encode(command, 'UTF-8')))"}),
    "linux_audit": AuditdFormat("audit_type", "{audit_msg} pid={pid} auid={auid} ses={ses}"),
    "linux_cron": AuditdFormat(
        "'CRED_ACQ'",
        "pid={pid} uid=0 auid=0 ses=1 msg='op=PAM:setcred grantors=pam_env,pam_unix "
        "acct=\"{user}\" exe=\"/usr/sbin/cron\" terminal=cron res=success'"),
    "linux_process": AuditdFormat(
        "'SYSCALL'",
        "arch=c000003e syscall=59 success=yes exit=0 ppid={ppid} pid={pid} auid={uid} uid={uid} "
        "gid={gid} ses=1 comm=\"{comm}\" exe=\"{exe}\" key=\"exec\"",
        let={"comm": "regexp_extract(rtrim('/', exe), '([^/]*)$', 1)"}, argv="args"),
}

DENY = f"lower(action) IN ({', '.join(map(lit, dims.DENY_ACTIONS))})"
ASA = f"lower(vendor) IN ({', '.join(map(lit, dims.ASA_VENDORS))})"
INBOUND = "lower(direction) = 'inbound'"


def _sides(outside: str, inside: str) -> tuple[str, str]:
    """(source, destination) of a flow by its direction."""
    return f"if({INBOUND}, '{outside}', '{inside}')", f"if({INBOUND}, '{inside}', '{outside}')"


_FORTI_HOST = or_default("hostname", "FGT-01")
_FORTI_LEVEL = f"if({DENY}, 'warning', 'notice')"
_FLOW = {
    "src": or_default("source_ip", "0.0.0.0"), "dst": or_default("dest_ip", "0.0.0.0"),
    "up": "upper(protocol)", "low": "lower(protocol)",
}

FORTIOS = VendorFormat(
    "fortinet",
    "<{prio}>date={date} time={time} devname=\"{host}\" devid=\"{serial}\" logid=\"0000000013\" "
    "type=\"traffic\" subtype=\"forward\" level=\"{level}\" vd=\"root\" eventtime={ns} "
    "srcip={src} srcport={source_port} srcintf=\"{src_if}\" srcintfrole=\"{src_role}\" "
    "dstip={dst} dstport={dest_port} dstintf=\"{dst_if}\" dstintfrole=\"{dst_role}\" "
    "proto={number} action=\"{verdict}\" policyid=1 service=\"{up}-{dest_port}\" "
    "dstcountry=\"{remote_country}\" sentbyte={sent} rcvdbyte={received}",
    {
        **_FLOW,
        "prio": syslog_priority("'local7'", _FORTI_LEVEL),
        "date": "date_format(timestamp, 'yyyy-MM-dd')",
        "time": "date_format(timestamp, 'HH:mm:ss')",
        "host": _FORTI_HOST,
        "serial": f"concat('FG100E', upper(substring(md5({_FORTI_HOST}), 1, 10)))",
        "level": _FORTI_LEVEL,
        "ns": "unix_micros(timestamp) * 1000",
        "src_if": _sides("wan1", "internal")[0], "dst_if": _sides("wan1", "internal")[1],
        "src_role": _sides("wan", "lan")[0], "dst_role": _sides("wan", "lan")[1],
        "number": lookup("upper(protocol)", dims.PROTOCOL_NUMBER, 6),
        "verdict": f"if({DENY}, 'deny', 'accept')",
        "sent": "coalesce(bytes_sent, 0)", "received": "coalesce(bytes_received, 0)",
    },
    f"NOT {ASA}",
)
_ASA_LET = {
    **_FLOW,
    "stamp": "date_format(timestamp, 'MMM dd HH:mm:ss')",
    "host": or_default("hostname", "ASA-01"),
    "src_if": _sides("outside", "inside")[0], "dst_if": _sides("outside", "inside")[1],
    "list": f"upper({_sides('outside', 'inside')[1]})",
    "way": f"if({INBOUND}, 'inbound', 'outbound')",
}
ASA_DENIED = VendorFormat(
    "cisco_asa",
    "<{prio}>{stamp} {host} asa: %ASA-4-106023: Deny {low} src {src_if}:{src}/{source_port} "
    "dst {dst_if}:{dst}/{dest_port} by access-group \"{list}_IN\" [0x0, 0x0]",
    {**_ASA_LET, "prio": syslog_priority("'local7'", "'warning'")}, f"{ASA} AND {DENY}",
)
ASA_BUILT = VendorFormat(
    "cisco_asa",
    "<{prio}>{stamp} {host} asa: %ASA-6-302013: Built {way} {up} connection 0 for "
    "{dst_if}:{dst}/{dest_port} ({dst}/{dest_port}) to {src_if}:{src}/{source_port} ({src}/{source_port})",
    {**_ASA_LET, "prio": syslog_priority("'local7'", "'info'")}, f"{ASA} AND NOT {DENY}",
)
IDP_REASON = (
    f"if({RESULT_OK}, {or_default('result_description', 'Success')}, "
    "if(coalesce(result_description, 'Success') = 'Success', 'INVALID_CREDENTIALS', result_description))"
)
IDP = VendorFormat(
    "okta",
    "{record}",
    {"record": f"""to_json(named_struct(
        'uuid', __uuid,
        'published', date_format(timestamp, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"),
        'eventType', 'user.session.start',
        'version', '0',
        'displayMessage', 'User login to Okta',
        'severity', if({RESULT_OK}, 'INFO', 'WARN'),
        'legacyEventType', if({RESULT_OK}, 'core.user_auth.login_success', 'core.user_auth.login_failed'),
        'outcome', named_struct('result', if({RESULT_OK}, 'SUCCESS', 'FAILURE'), 'reason', {IDP_REASON}),
        'actor', named_struct('id', concat('00u', substring(__actor, 1, 17)), 'type', 'User',
            'alternateId', user_principal_name, 'displayName', substring_index(user_principal_name, '@', 1)),
        'client', named_struct(
            'userAgent', named_struct('rawUserAgent', user_agent, 'browser', client_app_used),
            'ipAddress', {or_default('source_ip', '0.0.0.0')}, 'device', 'Computer',
            'geographicalContext', named_struct('country', location, 'city', city)),
        'authenticationContext', named_struct('authenticationStep', 0),
        'securityContext', from_json('{{}}', 'map<string,string>'),
        'target', array(named_struct('id', app_display_name, 'type', 'AppInstance', 'displayName', app_display_name))))"""},
)
VENDOR = {"firewall": (FORTIOS, ASA_DENIED, ASA_BUILT), "signin": (IDP,)}
