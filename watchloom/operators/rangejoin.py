"""Join points to half-open intervals without comparing every pair.

Both sides are cut into cells of equal width and joined on the cell, so the interval test runs
only against the intervals that touch the point's cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchloom.operators.ordered import carried, range_ordered


def range_join(points: DataFrame, intervals: DataFrame, point: str, low: str, high: str,
               width: float, on: tuple[str, ...] = (), how: str = "inner") -> DataFrame:
    """``point`` in ``[low, high)``, with optional equality columns ``on``.

    ``width`` should be near the usual interval length: an interval is repeated once per cell it
    touches and a point once.
    """
    cell = lambda c: F.floor(c / F.lit(width)).cast("bigint")
    last = F.ceil(F.col(high) / F.lit(width)).cast("bigint") - 1
    first = cell(F.col(low))
    spread = intervals.filter(F.col(low) < F.col(high)).withColumn(
        "_cell", F.explode(F.sequence(first, F.greatest(first, last))))
    placed = points.withColumn("_cell", cell(F.col(point)))
    p, i = placed.alias("p"), spread.alias("i")
    test = (F.col("p._cell") == F.col("i._cell")) & (F.col(f"p.{point}") >= F.col(f"i.{low}")) & (
        F.col(f"p.{point}") < F.col(f"i.{high}"))
    for name in on:
        test = test & (F.col(f"p.{name}") == F.col(f"i.{name}"))
    kept = [F.col(f"i.{c}") for c in intervals.columns if c not in on]
    return p.join(i, test, how).select("p.*", *kept).drop("_cell")


def step_join(points: DataFrame, steps: DataFrame, point: str, start: str, on: tuple[str, ...] = ()) -> DataFrame:
    """Each point with the step of the largest ``start`` that is not above it, within equal ``on`` columns.

    Both sides are put in one order and the last step is carried forward, so the work is a sort of points and
    steps, however steps and points lie. Points before the first step of their group are left out.
    """
    kept = [c for c in steps.columns if c not in on]
    step, row = F.struct(*steps.columns), F.struct(*points.columns)
    a = steps.select(*on, F.col(start).cast("double").alias("_x"), F.lit(0).alias("_side"), F.xxhash64(F.to_json(step)).alias("_tie"),
                     step.alias("_step"), F.lit(None).cast(points.select(row.alias("r")).schema["r"].dataType).alias("_row"))
    b = points.select(*on, F.col(point).cast("double").alias("_x"), F.lit(1).alias("_side"), F.monotonically_increasing_id().alias("_tie"),
                      F.lit(None).cast(a.schema["_step"].dataType).alias("_step"), row.alias("_row"))
    both = carried(a.unionByName(b), [*on, "_x", "_side", "_tie"], "_step", "_found").filter("_side = 1")
    same = F.col("_found").isNotNull()
    for c in on:
        same = same & F.col(f"_found.{c}").eqNullSafe(F.col(f"_row.{c}"))
    return both.filter(same).select("_row.*", *[F.col(f"_found.{c}").alias(c) for c in kept])


def cumulative(df: DataFrame, group: list[str], order: list[str], weight: Column) -> DataFrame:
    """Intervals ``[lo, hi)`` of the running share of ``weight`` inside each group.

    Rows are range-partitioned on group and order (which must tell them apart); each partition adds the total of
    the earlier ones of its group, so no task holds a whole pool.
    """
    placed = range_ordered(df.withColumn("_w", weight), [*group, *order])
    inside = Window.partitionBy("_pid", *group).orderBy("_pos")
    summed = placed.withColumn("_in", F.sum("_w").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    sizes = summed.groupBy("_pid", *group).agg(F.max_by("_in", "_pos").alias("_n"))
    by_pid = Window.partitionBy(*group).orderBy("_pid")
    whole = by_pid.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sizes = sizes.select(
        F.col("_pid").alias("_p"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)],
        F.coalesce(F.sum("_n").over(by_pid.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("_off"),
        F.sum("_n").over(whole).alias("_all"))
    same = F.col("_pid") == F.col("_p")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    summed = summed.withColumn("_before", F.coalesce(F.lag("_in").over(inside), F.lit(0.0))).join(sizes, same)
    # a bound is the same number on both sides of it, so no point falls between two intervals
    return (
        summed.withColumn("lo", (F.col("_before") + F.col("_off")) / F.col("_all"))
        .withColumn("hi", (F.col("_in") + F.col("_off")) / F.col("_all"))
        .drop("_w", "_in", "_before", "_off", "_all", "_pid", "_pos", "_p", *[f"_g{i}" for i in range(len(group))])
    )
