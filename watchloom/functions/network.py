"""Addresses, protocol numbers and appliance attributes."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

from watchloom.catalog import dims
from watchloom.functions.lookup import let, map_value

_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IPV4 = rf"^{_OCTET}(\.{_OCTET}){{3}}$"
_IPV4_TAIL = rf"{_OCTET}(\.{_OCTET}){{3}}$"


def ipv4_number(ip: Column) -> Column:
    """A dotted address as a number; null when it is not a valid IPv4 address."""
    def number(part: Column) -> Column:
        return sum(
            (part[i].cast("bigint") * F.lit(256 ** (3 - i)) for i in range(1, 4)),
            part[0].cast("bigint") * F.lit(256**3))

    return F.when(ip.rlike(_IPV4), let(F.split(ip, r"\."), number))


def _without_v4_tail(ip: Column) -> Column:
    """An embedded dotted tail as the two groups it stands for."""
    number = ipv4_number(F.regexp_extract(ip, _IPV4_TAIL, 0))
    groups = let(number, lambda n: F.format_string(
        "%x:%x", F.floor(n / 65536).cast("bigint"), F.pmod(n, F.lit(65536))))
    return F.when(ip.contains("."), F.concat(F.regexp_replace(ip, r"[0-9.]+$", ""), groups)).otherwise(ip)


def _valid_v6(plain: Column) -> Column:
    groups = F.size(F.filter(F.split(plain, ":"), lambda g: g != ""))
    gaps = F.size(F.split(plain, "::")) - 1
    full = (gaps == 0) & (groups == 8) & ~plain.rlike("^:|:$")
    short = (gaps == 1) & (groups <= 7) & ~plain.rlike("^:[^:]|[^:]:$|:::")
    return plain.rlike(r"^(:|[0-9a-f]{1,4})(:[0-9a-f]{0,4})*$") & (full | short)


def ipv6_text(ip: Column) -> Column:
    """Lower-case IPv6 text without its scope and with an embedded IPv4 tail as two groups;
    null when the text is not a valid IPv6 address."""
    bare = F.lower(F.regexp_replace(ip, r"%[^%]+$", ""))
    return let(let(bare, _without_v4_tail), lambda plain: F.when(_valid_v6(plain), plain))


def _internal_v4(number: Column) -> Column:
    hit = F.lit(False)
    for prefix in dims.INTERNAL_IPV4:
        net = ipaddress.ip_network(prefix)
        hit = hit | number.between(int(net.network_address), int(net.broadcast_address))
    return hit


def _internal_v6(text: Column) -> Column:
    unique_local, loopback = text.rlike("^f[cd][0-9a-f]{2}:"), text.rlike("^[0:]*:0{0,3}1$")
    return F.coalesce(unique_local | loopback, F.lit(True))


def is_internal(ip: Column) -> Column:
    """Inside the site, or unknown: null and text that is no address count as internal."""
    return (
        F.when(ip.rlike(_IPV4), let(ipv4_number(ip), _internal_v4))
        .when(ip.contains(":"), let(ipv6_text(ip), _internal_v6))
        .otherwise(F.lit(True))
    )


def appliance_for(source_ip: Column, dest_ip: Column) -> Column:
    """A flow with a foot outside the site crosses the perimeter appliance."""
    return F.when(is_internal(source_ip) & is_internal(dest_ip), "fortigate").otherwise("cisco")


def proto_number(protocol: Column) -> Column:
    return map_value(F.upper(protocol), dims.PROTOCOL_NUMBER, 6)


def dns_qtype(query_type: Column) -> Column:
    return map_value(F.upper(query_type), dims.DNS_QUERY_TYPE, 1)


def dns_xid(query_name: Column, iso_stamp: Column) -> Column:
    digest = F.md5(F.concat(query_name, iso_stamp).cast("binary"))
    return F.conv(F.substring(digest, 1, 4), 16, 10).cast("int")


def device_serial(host: Column) -> Column:
    return F.concat(F.lit("FG100E"), F.upper(F.substring(F.md5(host.cast("binary")), 1, 10)))


def is_deny(action: Column) -> Column:
    return F.lower(action).isin(*dims.DENY_ACTIONS)


def is_asa(vendor: Column) -> Column:
    return F.lower(vendor).isin(*dims.ASA_VENDORS)


def interfaces(direction: Column, outside: str, inside: str) -> tuple[Column, Column]:
    """(source, destination) interface names of a flow."""
    inbound = F.lower(direction) == "inbound"
    return (
        F.when(inbound, outside).otherwise(inside),
        F.when(inbound, inside).otherwise(outside),
    )


def url_valid(url: Column) -> Column:
    return url.startswith("http://") | url.startswith("https://")
