"""Weighted picks from an alias table that is built in parallel.

A pool of n rows becomes n cells of equal mass. A cell holds one row of its own and, where that row is too light to
fill it, one other row for the rest. A draw falls into one cell and meets the table by equality, so it costs the same
whatever the pool.

Light rows lack mass, heavy rows have it over. Running sums of what light rows lack and of what heavy rows have over,
in one order of the pool, say which heavy row fills a light row: the first one whose sum passes the light row's. A heavy
row that is used up is filled by the next one. Running sums are taken in buckets by a digest of the row's key and
carried from bucket to bucket, one row each; the sums are matched in slots of equal width, again with one row each
carried over. All sums are whole numbers, so the table is the same on any cluster and needs no checkpoint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchloom.functions.hashing import hash32, hash_fraction

#: weights are counted in units of one over this
UNIT = 1 << 20
#: rows of a bucket, about
BUCKET = 256
#: cells from which on a draw meets the table by a shuffled hash join, if the table is not small enough to be sent around
WIDE = 1 << 16

_WHOLE = "decimal(38,0)"


def alias_table(pool: DataFrame, order: tuple[str, ...], weight: Column, group: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
    """(cells: the group, ``_n`` cells of the group, ``_cell``, ``_own`` and ``_other`` rows, ``_keep``; rows of the pool).

    ``order`` must tell the rows of a group apart. A weight below one unit counts as one unit. ``_keep`` is the share of
    the cell that belongs to its own row.
    """
    g = list(group)
    row = F.struct(*[F.col(c) for c in pool.columns if c not in g])
    # a group column that is always there, so that pools with and without groups are one case
    rows = pool.select(
        *g, F.struct(*(g or [F.lit(0).alias("_")])).alias("_g"), row.alias("_own"), F.greatest(F.round(weight * UNIT), F.lit(1.0)).cast(_WHOLE).alias("_q"),
        hash32(F.concat_ws("|", *[F.col(c).cast("string") for c in order])).alias("_h"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    if g:
        totals = rows.groupBy("_g").agg(F.count("*").alias("_n"), F.sum("_q").cast(_WHOLE).alias("_w"))
        size = pool.count()
        rows = rows.join(totals, "_g")
    else:
        size, whole = rows.agg(F.count("*"), F.sum("_q").cast(_WHOLE)).first()
        rows = rows.withColumn("_n", F.lit(size).cast("bigint")).withColumn("_w", F.lit(str(whole or 0)).cast(_WHOLE))
    buckets = F.greatest(F.ceil(F.col("_n") / BUCKET), F.lit(1))
    rows = rows.withColumn("_b", F.pmod(F.col("_h"), buckets)).withColumn("_mass", (F.col("_q") * F.col("_n")).cast(_WHOLE))
    zero = F.lit(0).cast(_WHOLE)
    light = F.col("_mass") <= F.col("_w")
    rows = rows.withColumn("_light", light).withColumn("_lacks", F.when(light, (F.col("_w") - F.col("_mass")).cast(_WHOLE)).otherwise(zero)).withColumn(
        "_over", F.when(light, zero).otherwise((F.col("_mass") - F.col("_w")).cast(_WHOLE)))

    inside = Window.partitionBy("_g", "_b").orderBy(*[f"_o{i}" for i in range(len(order))]).rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.groupBy("_g", "_b").agg(F.sum("_lacks").alias("_l"), F.sum("_over").alias("_e"), F.count("*").alias("_c"))
    by_bucket = Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("_g")
    sums = sums.select(
        "_g", "_b", *[F.coalesce(F.sum(c).over(by_bucket), F.lit(0)).cast(_WHOLE).alias(f"{c}0") for c in ("_l", "_e", "_c")],
        F.sum("_e").over(every).cast(_WHOLE).alias("_all"))
    placed = rows.withColumn("_li", F.sum("_lacks").over(inside)).withColumn("_ei", F.sum("_over").over(inside)).withColumn(
        "_ci", F.count("*").over(inside)).join(sums, ["_g", "_b"])
    placed = placed.withColumn("_start", (F.col("_li") + F.col("_l0") - F.col("_lacks")).cast(_WHOLE)).withColumn(
        "_end", (F.col("_ei") + F.col("_e0")).cast(_WHOLE)).withColumn("_cell", (F.col("_ci") + F.col("_c0") - 1).cast("bigint"))
    placed = placed.withColumn("_value", F.when(F.col("_light"), F.col("_start")).otherwise(F.col("_end")))
    slot = F.expr(f"CAST(_value * greatest(ceil(_n / {BUCKET}), 1) AS {_WHOLE}) DIV greatest(_all, CAST(1 AS {_WHOLE}))")
    placed = placed.withColumn("_slot", slot)

    # from the largest value down; at one value the light rows come first, since a heavy row must pass them
    heavy, first = F.when(~F.col("_light"), F.col("_own")), F.when(F.col("_light"), F.col("_start"))
    down = Window.partitionBy("_g", "_slot").orderBy(F.col("_value").desc(), F.col("_light").desc(), F.col("_cell")).rowsBetween(Window.unboundedPreceding, -1)
    low = placed.groupBy("_g", "_slot").agg(F.min_by(heavy, F.when(~F.col("_light"), F.col("_end"))).alias("_h1"), F.min(first).alias("_s1"))
    above = Window.partitionBy("_g").orderBy(F.col("_slot").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carry = low.select("_g", "_slot", F.last("_h1", ignorenulls=True).over(above).alias("_h2"), F.last("_s1", ignorenulls=True).over(above).alias("_s2"))
    met = placed.withColumn("_h0", F.last(heavy, ignorenulls=True).over(down)).withColumn("_s0", F.last(first, ignorenulls=True).over(down)).join(carry, ["_g", "_slot"])
    other, reached = F.coalesce("_h0", "_h2"), F.coalesce("_s0", "_s2", "_all")
    mass = F.when(F.col("_light"), F.col("_mass")).otherwise((F.col("_w") + F.col("_end") - reached).cast(_WHOLE))
    keep = F.when(other.isNull(), F.lit(1.0)).otherwise(mass.cast("double") / F.col("_w").cast("double"))
    return met.select(*g, "_n", "_cell", "_own", other.alias("_other"), keep.alias("_keep")), size


def alias_pick(df: DataFrame, weighted: DataFrame, key: Column, order: tuple[str, ...], weight: Column, group: tuple[str, ...] = ()) -> DataFrame:
    """The rows of ``df``, each with the row of ``weighted`` (of its own group) that the fraction of its key picks by weight."""
    g = list(group)
    cells, size = alias_table(weighted, order, weight, group)
    drawn = df.withColumn("_u", hash_fraction(key))
    if g:
        drawn = drawn.join(weighted.groupBy(*g).agg(F.count("*").alias("_n")), g)
        cells = cells.drop("_n")
    else:
        drawn, cells = drawn.withColumn("_n", F.lit(size)), cells.drop("_n")
    at = F.col("_u") * F.col("_n")
    drawn = drawn.withColumn("_cell", F.floor(at).cast("bigint")).withColumn("_f", at - F.floor(at))
    if size >= WIDE:
        cells = cells.hint("shuffle_hash")
    picked = drawn.join(cells, [*g, "_cell"]).withColumn("_row", F.when(F.col("_f") < F.col("_keep"), F.col("_own")).otherwise(F.col("_other")))
    return picked.select(*df.columns, "_row.*")
