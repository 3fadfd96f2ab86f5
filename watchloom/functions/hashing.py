"""Deterministic picks and ids: the same key always gives the same value, on any cluster."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from watchloom.functions.sqltext import literal_array

_DNS_NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"


def hash32(key: Column) -> Column:
    """The first 32 bits of the MD5 of a text key, as a non-negative number."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("bigint")


def hash_pick(key: Column, n: int | Column) -> Column:
    """A position in ``0..n-1``."""
    return F.pmod(hash32(key), F.lit(n) if isinstance(n, int) else n)


def hash_fraction(key: Column) -> Column:
    """A number in ``[0, 1)``, from the first 52 bits of the MD5 of a text key."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("bigint") / F.lit(4503599627370496.0)


def hash_range(key: Column, low: int, high: int) -> Column:
    return F.lit(low) + hash_pick(key, high - low + 1)


def pick_from(key: Column, pool: Sequence[str]) -> Column:
    return F.element_at(F.expr(literal_array(pool)), (hash_pick(key, len(pool)) + 1).cast("int"))


_GROUPS = "^(.{8})(.{4})(.{4})(.{4})"


def _dashed(h: Column) -> Column:
    return F.regexp_replace(h, _GROUPS, "$1-$2-$3-$4-")


def stable_uuid(key: Column) -> Column:
    """A UUID-shaped digest of a text key."""
    return _dashed(F.substring(F.sha2(key.cast("binary"), 256), 1, 32))


def stable_uuid_sql(key: str) -> str:
    """``stable_uuid`` of a SQL expression, as SQL."""
    return f"regexp_replace(substring(sha2({key}, 256), 1, 32), '{_GROUPS}', '$1-$2-$3-$4-')"


def hash_range_sql(key: str, low: int, high: int) -> str:
    """``hash_range`` of a SQL expression, as SQL."""
    return f"({low} + pmod(CAST(conv(substring(md5({key}), 1, 8), 16, 10) AS BIGINT), {high - low + 1}))"


def uuid5_hex(name: Column) -> Column:
    """Hex digits of the version-5 UUID of a name in the DNS namespace."""
    digest = F.sha1(F.concat(F.unhex(F.lit(_DNS_NAMESPACE)), F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(
        F.substring(digest, 1, 12), F.lit("5"), F.substring(digest, 14, 3), variant,
        F.substring(digest, 18, 15))


def uuid5_hex_sql(name: str) -> str:
    """``uuid5_hex`` of a SQL expression, as SQL."""
    digest = f"sha1(concat(unhex('{_DNS_NAMESPACE}'), encode({name}, 'UTF-8')))"
    return (f"concat(substring({digest}, 1, 12), '5', substring({digest}, 14, 3), "
            f"translate(substring({digest}, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab'), substring({digest}, 18, 15))")


def uuid5(name: Column) -> Column:
    return _dashed(uuid5_hex(name))
