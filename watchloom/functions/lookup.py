"""Small fixed maps as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from watchloom.functions.sqltext import literal_map


def map_value(key: Column, mapping: Mapping, default=None) -> Column:
    """``mapping[key]`` against a literal map; ``default`` (or null) when absent.

    The key appears once, so expressions built on it do not grow with the map.
    """
    found = F.element_at(F.expr(literal_map(mapping)), key)
    if default is None:
        return found
    return F.coalesce(found, default if isinstance(default, Column) else F.lit(default))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def or_default(col: Column, default: str) -> Column:
    """``default`` for null and for the empty string."""
    return F.coalesce(F.nullif(col, F.lit("")), F.lit(default))
