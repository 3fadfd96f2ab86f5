"""String helpers of the feeds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from watchloom.functions.sqltext import XML_ENTITIES


def single_line(col: Column, unicode_space: bool = True) -> Column:
    """Collapse whitespace runs to one blank and trim."""
    pattern = r"(?U)\s+" if unicode_space else r"[ \t\n\r\f\x0B]+"
    return F.trim(F.regexp_replace(col, pattern, " "))


def xml_escape(col: Column) -> Column:
    for char, entity in XML_ENTITIES:
        col = F.replace(col, F.lit(char), F.lit(entity))
    return col


def cef_escape(col: Column) -> Column:
    col = F.replace(col, F.lit("|"), F.lit("\\|"))
    return F.translate(col, "\n\r", "  ")


def hex_utf8(col: Column) -> Column:
    return F.lower(F.hex(F.encode(col, "UTF-8")))


def hex_pid(col: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.hex(col)))


def lowered(col: Column) -> Column:
    """``lower``; a text of ASCII without capitals is taken as it is, which saves the tables of Unicode."""
    return F.when(col.rlike(r"[^\x00-@\[-\x7F]"), F.lower(col)).otherwise(col)


def capitalize(col: Column) -> Column:
    """First letter upper, the rest lower (``initcap`` would raise every word)."""
    return F.concat(F.upper(F.substring(col, 1, 1)), F.lower(F.substring(col, 2, 2147483647)))
