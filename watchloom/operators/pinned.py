"""Compute costly columns exactly once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pinned(df: DataFrame, *columns: Column) -> DataFrame:
    """Add columns whose expressions are not copied into later filters and projections.

    Catalyst moves a filter on a computed column below the projection and repeats the expression
    for every reference in it; for a parsed record that means parsing it again and again. A
    one-element ``inline`` keeps the expression in one place and changes no row.
    """
    return df.select("*", F.inline(F.array(F.struct(*columns))))

