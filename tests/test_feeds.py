"""Feed lines."""

import json

import pytest
from pyspark.sql import functions as F

from watchloom.operators import feeds as X
from watchloom.operators import quality as Q
from watchloom.operators.settings import Settings

AT = "2026-09-01T13:45:30Z"
PROCESS = {"FileName": "cmd.exe", "ProcessId": 1234, "ProcessCommandLine": "cmd /c <dir>", "timestamp": AT}
FLOW = {"DeviceAction": "blocked", "Protocol": "TCP", "SourcePort": 51000, "DestinationPort": 8443, "IPAddress": "10.20.30.40",
        "DestinationIP": "203.0.113.9", "bytes_sent": 1200, "bytes_received": 350, "timestamp": AT}


def lines(df):
    return [r["line"] for r in df.collect()]


def test_json_has_public_names_and_no_labels(accept):
    good, _ = accept("process", "process_creation", {**PROCESS, "is_malicious": "true", "scenario_id": "S", "killchain_phase": "x"})
    doc = json.loads(lines(X.export_json(good, "process"))[0])
    assert not {"is_malicious", "scenario_id", "depth", "killchain_phase"} & set(doc)
    assert doc["TimeGenerated"] == "2026-09-01T13:45:30+00:00" and doc["FileName"] == "cmd.exe" and doc["mitre"] is None
    assert list(doc)[:5] == ["Id", "TimeGenerated", "SourceSystem", "Type", "AlertSeverity"]


def test_cef_of_a_dns_row(accept):
    good, _ = accept("dns", "dns_query", {"Name": "outlook.office365.com", "QueryType": "AAAA", "ResultCode": "0", "IPAddresses": "2603::2", "timestamp": AT})
    line = lines(X.export_cef(good, "dns", Settings(vendor="Acme")))[0]
    assert line.startswith("CEF:0|Acme|Dns|1.1|DnsEvents|Acme DnsEvents event|1|rt=1788270330000 msg=default externalId=")
    assert line.endswith("cs1Label=Name cs1=outlook.office365.com cs2Label=QueryType cs2=AAAA cs3Label=ResultCode cs3=0 "
                         "cs4Label=IPAddresses cs4=2603::2")
    assert "OSPlatform" not in line


def test_cef_stops_at_six_and_reports_the_rest(accept):
    good, _ = accept("email", "email_event", {
        "sender": "a@b.com", "recipient": "c@d.com", "subject": "T|x", "NetworkMessageId": "m", "ConfidenceLevel": "0"})
    out = X.export_cef(good, "email")
    row = out.collect()[0]
    assert "cs6Label=" in row["line"] and "cs7Label" not in row["line"] and "cs3=T\\|x" in row["line"]
    assert "ConfidenceLevel" in row["dropped"] and "AuthenticationDetails" in row["dropped"]
    assert Q.no_cs7(out).count() == 0


def test_windows_events(accept):
    line = lines(X.export_winevent_xml(accept("process", "process_creation", PROCESS)[0], "process"))[0]
    assert "<TimeCreated SystemTime='2026-09-01T13:45:30.000Z'/>" in line and "<EventID>4688</EventID>" in line
    assert "<Data Name='NewProcessId'>0x4d2</Data>" in line and "cmd /c &lt;dir&gt;" in line and "<Computer>WKS</Computer>" in line
    files = accept("file", "file_system", {"ActionType": "FileCreated", "FileName": "m.exe", "FolderPath": "C:\\temp"},
                   {"ActionType": "FileDeleted", "FileName": "m.exe", "FolderPath": "C:\\temp"})[0]
    got = lines(X.export_winevent_xml(files.orderBy("row_id"), "file"))
    assert "<EventID>11<" in got[0] and "<EventID>23<" in got[1] and "C:\\temp\\m.exe" in got[0]
    assert "Channel>Microsoft-Windows-Sysmon/Operational<" in got[0]
    flows = accept("firewall", "network_connection", FLOW)[0]
    assert X.export_winevent_xml(flows, "firewall").count() == 0
    assert Q.discarded_event_ids(X.export_winevent_xml(flows, "firewall", gate=False)).count() == 0


def test_fortios_line(accept):
    line = lines(X.export_vendor(accept("firewall", "network_connection", FLOW)[0], "firewall"))[0]
    for part in ("<188>date=2026-09-01 time=13:45:30 devname=\"FGT-01\"", " proto=6 ", ' action="deny"', " sentbyte=1200 rcvdbyte=350",
                 ' service="TCP-8443"', " eventtime=1788270330000000000 ", " srcip=10.20.30.40 "):
        assert part in line
    assert not lines(Q.gate_fortios(X.export_vendor(accept("firewall", "network_connection", FLOW)[0], "firewall")))


def test_asa_lines(accept):
    flows = accept("firewall", "network_connection", {**FLOW, "vendor": "ASA"}, {**FLOW, "vendor": "cisco", "DeviceAction": "allowed", "direction": "Inbound"})[0]
    out = X.export_vendor(flows.orderBy("row_id"), "firewall")
    denied, built = lines(out)
    assert denied == ("<188>Sep 01 13:45:30 ASA-01 asa: %ASA-4-106023: Deny tcp src inside:10.20.30.40/51000 "
                      'dst outside:203.0.113.9/8443 by access-group "OUTSIDE_IN" [0x0, 0x0]')
    assert built == ("<190>Sep 01 13:45:30 ASA-01 asa: %ASA-6-302013: Built inbound TCP connection 0 for "
                     "inside:203.0.113.9/8443 (203.0.113.9/8443) to outside:10.20.30.40/51000 (10.20.30.40/51000)")
    assert {r["feed"] for r in out.collect()} == {"cisco_asa"} and Q.gate_asa(out).count() == 0


def test_identity_provider_record(accept):
    import uuid

    out = X.export_vendor(accept("signin", "authentication", {"UserPrincipalName": "bob@x.org", "status": "50126", "timestamp": AT})[0], "signin")
    doc = json.loads(lines(out)[0])
    assert doc["outcome"] == {"result": "FAILURE", "reason": "INVALID_CREDENTIALS"} and doc["published"] == "2026-09-01T13:45:30.000Z"
    assert doc["actor"]["id"] == "00u" + uuid.uuid5(uuid.NAMESPACE_DNS, "bob@x.org").hex[:17] and doc["actor"]["displayName"] == "bob"
    assert doc["securityContext"] == {} and doc["client"]["geographicalContext"] == {"country": "US", "city": "Seattle"}
    assert Q.gate_idp(out).count() == 0 and Q.gate_idp(out.withColumn("line", F.lit("{}"))).count() == 1


def test_audit_records(accept):
    with_serial = lambda df: df.withColumn("serial", F.col("row_id") + 7)
    sudo = with_serial(accept("linux_sudo", "linux_sudo", {"pid": 5, "user": "bob", "command": "cat /etc/shadow", "timestamp": "2026-09-01T12:00:00Z"})[0])
    assert lines(X.export_auditd(sudo, "linux_sudo")) == [
        "type=USER_CMD msg=audit(1788264000.000:7): pid=5 uid=1000 auid=1000 ses=1 "
        f"msg='cwd=\"/home/user\" cmd={b'cat /etc/shadow'.hex()} terminal=/dev/pts/0 res=success'"]
    run = with_serial(accept("linux_process", "linux_process", {"pid": 5, "user": "u", "exe": "/usr/bin/nmap", "args": "nmap -sS 10.0.0.0/24"},
                             {"pid": 6, "user": "u", "exe": "/usr/bin/id", "args": ""})[0].orderBy("row_id"))
    got = lines(X.export_auditd(run, "linux_process"))
    assert [g.split(" ")[0] for g in got] == ["type=SYSCALL", "type=EXECVE"] * 2
    assert 'argc=3 a0="nmap" a1="-sS" a2="10.0.0.0/24"' in got[1] and 'comm="nmap"' in got[0] and got[3].endswith('argc=1 a0="id"')
    assert ":7): " in got[0] and ":7): " in got[1] and ":8): " in got[2]
    out = X.export_auditd(run, "linux_process")
    assert Q.gate_auditd(out).count() == 0
    assert X.export_auditd(accept("dns", "dns_query", {"Name": "a"})[0].withColumn("serial", F.lit(1)), "dns").count() == 0


@pytest.mark.parametrize("fmt, head", [("rfc3164", "<86>Sep 01 13:45:30 SERVER AzureAD[0]: "), ("rfc5424", "<86>1 2026-09-01T13:45:30+00:00 SERVER AzureAD 0 - - ")])
def test_syslog(accept, fmt, head):
    good, _ = accept("signin", "authentication", {"UserPrincipalName": "a@b.c", "timestamp": AT})
    out = X.export_syslog(good, "signin", Settings(syslog_format=fmt))
    assert lines(out) == [head + "Authentication accepted for a@b.c from None"]
    assert Q.priority_in_range(out).count() == 0


def test_one_pass_yields_every_feed(accept):
    good, _ = accept("signin", "authentication", {"UserPrincipalName": "a@b.c"})
    assert {r["feed"] for r in X.feed_lines(good, "signin").collect()} == {"json", "cef", "syslog", "winxml", "okta"}
    linux, _ = accept("linux_cron", "linux_cron", {"pid": 1, "command": "x"})
    got = X.feed_lines(linux.withColumn("serial", F.lit(3)), "linux_cron", serial="serial")
    assert {r["feed"] for r in got.collect()} == {"json", "cef", "syslog", "auditd"}
    assert {r["broken"] for r in Q.gate_summary(got).collect()} == {0}
