"""Severity scales."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from watchloom.catalog import dims
from watchloom.functions.lookup import map_value


def _word(severity: Column) -> Column:
    return F.lower(F.trim(F.coalesce(severity, F.lit("info"))))


def normalize_severity(severity: Column) -> Column:
    """Any severity word as a syslog keyword; unknown words and null are ``info``."""
    words = {**{k: k for k in dims.SYSLOG_SEVERITY}, **dims.APP_SEVERITY}
    return map_value(_word(severity), words, "info")


def _by_word(severity: Column, scale: dict, default: int) -> Column:
    """Compose a scale over syslog keywords with the app words in one lookup."""
    merged = {**scale, **{app: scale[word] for app, word in dims.APP_SEVERITY.items()}}
    return map_value(_word(severity), merged, default)


def syslog_priority(facility: Column, severity: Column) -> Column:
    """``facility * 8 + severity``; an unknown facility counts as ``user``."""
    code = map_value(facility, dims.SYSLOG_FACILITY, 1)
    return code * 8 + _by_word(severity, dims.SYSLOG_SEVERITY, 6)


def evt_level(severity: Column) -> Column:
    return _by_word(severity, dims.WINEVENT_LEVEL, 4)


def cef_severity(severity: Column) -> Column:
    """0..10; has its own scale on purpose (``notice`` is 5, ``low`` is 3)."""
    return map_value(_word(severity), dims.CEF_SEVERITY, 1)


def http_severity(status: Column) -> Column:
    return F.when(status >= 500, "err").when(status >= 400, "warning").otherwise("info")
