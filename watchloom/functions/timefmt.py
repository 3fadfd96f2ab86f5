"""Timestamp renderings of the feeds (session time zone; sessions run in UTC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def syslog_ts(ts: Column) -> Column:
    return F.date_format(ts, "MMM dd HH:mm:ss")


def iso_ts(ts: Column) -> Column:
    """ISO 8601 with offset; the fraction only when it is not zero."""
    ts = ts.cast("timestamp")
    whole = F.pmod(F.unix_micros(ts), F.lit(1_000_000)) == 0
    return F.when(whole, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssxxx")).otherwise(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"))


def xml_ts(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.'000Z'")


def milli_ts(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def epoch_ms(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def epoch_ns(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) * 1000


def epoch_milli(ts: Column) -> Column:
    """Seconds with three decimals, rounded to the nearest millisecond."""
    millis = F.floor((F.unix_micros(ts.cast("timestamp")) + 500) / 1000).cast("bigint")
    return F.format_string("%d.%03d", F.floor(millis / 1000).cast("bigint"), F.pmod(millis, F.lit(1000)))


def loses_year(ts: Column, current_year: int) -> Column:
    """A stamp without a year is re-dated at ingest unless it lies in the current year."""
    return F.year(ts) != F.lit(current_year)
