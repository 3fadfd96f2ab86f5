"""The registry of event classes."""

from __future__ import annotations

from watchloom.catalog import columns as c
from watchloom.catalog import feeds
from watchloom.catalog.model import ColumnSpec, EventSpec, extend, parse_columns

#: class name -> (source system, type, column texts from the most general to the most specific)
CLASSES = {
    "process": ("endpoint", "DeviceProcessEvents", (c.ENDPOINT, c.PROCESS)),
    "device_event": ("endpoint", "DeviceEvents", (c.ENDPOINT, c.DEVICE_EVENT)),
    "file": ("endpoint", "DeviceFileEvents", (c.ENDPOINT, c.FILE)),
    "registry_value": ("endpoint", "DeviceRegistryEvents", (c.ENDPOINT, c.REGISTRY_VALUE)),
    "firewall": ("Firewall", "CommonSecurityLog", (c.FIREWALL,)),
    "dns": ("DNS", "DnsEvents", (c.DNS,)),
    "proxy": ("Proxy", "W3CIISLog", (c.PROXY,)),
    "signin": ("Azure AD", "SigninLogs", (c.SIGNIN,)),
    "vpn": ("Firewall", "CommonSecurityLog", (c.VPN,)),
    "cloud_activity": ("Azure", "AzureActivity", (c.CLOUD_ACTIVITY,)),
    "office_activity": ("Office 365", "OfficeActivity", (c.OFFICE_ACTIVITY,)),
    "cloud_app": ("Cloud App Security", "CloudAppEvents", (c.CLOUD_APP,)),
    "identity_logon": ("Identity Protection", "IdentityLogonEvents", (c.IDENTITY_LOGON,)),
    "service_signin": ("Azure AD", "AADNonInteractiveUserSignInLogs", (c.SERVICE_SIGNIN,)),
    "email": ("Microsoft Defender for Office 365", "EmailEvents", (c.EMAIL,)),
    "email_attachment": (
        "Microsoft Defender for Office 365", "EmailAttachmentInfo", (c.EMAIL_ATTACHMENT,)),
    "alert": ("SecurityInsights", "SecurityAlert", (c.ALERT,)),
    "incident": ("SecurityInsights", "SecurityIncident", (c.INCIDENT,)),
    "directory_audit": ("Azure AD", "AuditLogs", (c.DIRECTORY_AUDIT,)),
    "workspace_audit": ("sentinel_audit", "audit", (c.WORKSPACE_AUDIT,)),
    "web": ("Web", "W3CIISLog", (c.WEB,)),
    "syslog": ("syslog", "Syslog", (c.SYSLOG,)),
    "database": ("Azure", "AzureDiagnostics", (c.DATABASE,)),
    "linux_auth": ("linux", "linux_auth", (c.LINUX, c.LINUX_AUTH)),
    "linux_sudo": ("linux", "linux_sudo", (c.LINUX, c.LINUX_SUDO)),
    "linux_audit": ("linux", "linux_audit", (c.LINUX, c.LINUX_AUDIT)),
    "linux_kernel": ("linux", "linux_kernel", (c.LINUX, c.LINUX_KERNEL)),
    "linux_cron": ("linux", "linux_cron", (c.LINUX, c.LINUX_CRON)),
    "linux_process": ("linux", "linux_process", (c.LINUX, c.LINUX_PROCESS)),
    "macos_log": ("macos", "macos_log", (c.MACOS, c.MACOS_LOG)),
    "macos_auth": ("macos", "macos_auth", (c.MACOS, c.MACOS_AUTH)),
    "macos_exec": ("macos", "macos_exec", (c.MACOS, c.MACOS_EXEC)),
}

BASE_COLUMNS = parse_columns(c.BASE)

#: class of records whose event type is not known
GENERIC = EventSpec("generic", "", "", BASE_COLUMNS)

REGISTRY: dict[str, EventSpec] = {}


def register_table(spec: EventSpec) -> EventSpec:
    """Add an event class; its feeds are picked up by every export job."""
    REGISTRY[spec.name] = spec
    return spec


def spec_of(name: str) -> EventSpec:
    return GENERIC if name == GENERIC.name else REGISTRY[name]


def make_spec(name: str, source: str, type_name: str, texts: tuple[str, ...], **formats) -> EventSpec:
    """A class that pins ``SourceSystem`` and ``Type`` and extends the base columns."""
    columns = extend(
        BASE_COLUMNS,
        (
            ColumnSpec("source", "str", "SourceSystem", ("SourceSystem",), default=source, pinned=True),
            ColumnSpec("event_type", "str", "Type", ("Type",), default=type_name, pinned=True),
        ),
    )
    for text in texts:
        columns = extend(columns, parse_columns(text) if text else ())
    return EventSpec(name, source, type_name, columns, formats)


for _name, (_source, _type, _texts) in CLASSES.items():
    register_table(
        make_spec(
            _name, _source, _type, _texts,
            syslog=feeds.SYSLOG.get(_name, feeds.DEFAULT_SYSLOG),
            winevent=feeds.WINEVENT.get(_name, feeds.DEFAULT_WINEVENT),
            auditd=feeds.AUDITD.get(_name),
            vendor=feeds.VENDOR.get(_name),
        )
    )
