"""Pieces of SQL text for wide expressions.

A feed line is made of hundreds of small expressions; written as text it is handed to Spark in
one call and planned the same way as columns composed one by one.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from string import Formatter

from watchloom.catalog import dims

XML_ENTITIES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"))


def lit(value) -> str:
    """A SQL literal."""
    if isinstance(value, str):
        body = value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r")
        return f"'{body}'"
    return "true" if value is True else "false" if value is False else str(value)


def literal_map(mapping: Mapping) -> str:
    return "map(" + ", ".join(f"{lit(k)}, {lit(v)}" for k, v in mapping.items()) + ")"


def literal_array(values: Iterable) -> str:
    return "array(" + ", ".join(map(lit, values)) + ")"


def lookup(expr: str, mapping: Mapping, default) -> str:
    return f"coalesce(element_at({literal_map(mapping)}, {expr}), {lit(default)})"


def or_default(expr: str, default: str) -> str:
    return f"coalesce(nullif({expr}, ''), {lit(default)})"


def printed(expr: str, kind: str = "str") -> str:
    """The way the text feeds print a value: ``None`` for null, ``True``/``False``."""
    if kind == "bool":
        return f"CASE WHEN {expr} THEN 'True' WHEN NOT {expr} THEN 'False' ELSE 'None' END"
    return f"coalesce(CAST({expr} AS STRING), 'None')"


def xml_escape(expr: str) -> str:
    for char, entity in XML_ENTITIES:
        expr = f"replace({expr}, {lit(char)}, {lit(entity)})"
    return expr


def cef_escape(expr: str) -> str:
    return f"translate(replace({expr}, '|', {lit(chr(92) + '|')}), {lit(chr(10) + chr(13))}, '  ')"


def _level(severity: str, scale: dict, default: int) -> str:
    """A severity on a scale; a word that stands there as it is needs no trimming and lowering."""
    word = f"coalesce({severity}, 'info')"
    return f"coalesce(element_at({literal_map(scale)}, {word}), {lookup(f'lower(trim({word}))', scale, default)})"


def _app_scale(scale: Mapping) -> dict:
    return {**scale, **{app: scale[word] for app, word in dims.APP_SEVERITY.items()}}


def syslog_priority(facility: str, severity: str) -> str:
    code = lookup(facility, dims.SYSLOG_FACILITY, 1)
    return f"({code} * 8 + {_level(severity, _app_scale(dims.SYSLOG_SEVERITY), 6)})"


def evt_level(severity: str) -> str:
    return _level(severity, _app_scale(dims.WINEVENT_LEVEL), 4)


def cef_severity(severity: str) -> str:
    return _level(severity, dims.CEF_SEVERITY, 1)


def iso_ts(ts: str) -> str:
    """ISO 8601 with offset; the fraction only when it is not zero."""
    return (f"date_format({ts}, 'yyyy-MM-dd\\'T\\'HH:mm:ss') || if(unix_micros({ts}) % 1000000 = 0, '', "
            f"date_format({ts}, '.SSSSSS')) || date_format({ts}, 'xxx')")


def template(text: str, values: Mapping[str, str]) -> str:
    """A fixed text with ``{slots}`` filled by SQL expressions."""
    parts = []
    for fixed, slot, _, _ in Formatter().parse(text):
        if fixed:
            parts.append(lit(fixed))
        if slot:
            parts.append(values[slot])
    return f"concat({', '.join(parts)})"


def slots(text: str) -> set[str]:
    return {slot for _, slot, _, _ in Formatter().parse(text) if slot}
