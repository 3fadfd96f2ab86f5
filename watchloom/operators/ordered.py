"""Global order without a one-partition window.

Two ways, both exact:

* rows that carry a unique whole-number serial are cut into serial ranges of fixed width, so a
  task never holds more rows than the width, and what passes between ranges is one summary row
  per range;
* any other order is range-partitioned on the full sort key, which also splits a key that holds
  a large share of the rows, and is written out once so that later passes see the same ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from watchloom.session import materialise

#: rows per serial range
SERIAL_WIDTH = 1 << 20


def _ranged(df: DataFrame, seq: str, width: int) -> DataFrame:
    return df.withColumn("_range", F.floor(F.col(seq) / width).cast("bigint"))


def _before() -> Window:
    # one row per serial range: small next to the data by the factor of the width
    return Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)


def running_max_before(df: DataFrame, seq: str, value: str, name: str,
                       width: int = SERIAL_WIDTH) -> DataFrame:
    """The largest ``value`` of all earlier rows in serial order; null on the first row."""
    cut = _ranged(df, seq, width)
    carry = cut.groupBy("_range").agg(F.max(value).alias("_m"))
    carry = carry.select("_range", F.max("_m").over(_before()).alias("_carry"))
    inside = Window.partitionBy("_range").orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    return (
        cut.withColumn("_in", F.max(value).over(inside))
        .join(carry, "_range")
        .withColumn(name, F.greatest("_in", "_carry"))
        .drop("_range", "_in", "_carry")
    )


def last_known(df: DataFrame, seq: str, value: str, name: str, width: int = SERIAL_WIDTH) -> DataFrame:
    """The row's own ``value`` or, when it is null, the nearest earlier one in serial order."""
    cut = _ranged(df, seq, width)
    carry = cut.filter(F.col(value).isNotNull()).groupBy("_range").agg(F.max_by(value, seq).alias("_m"))
    every = cut.select("_range").distinct().join(carry, "_range", "left")
    every = every.select("_range", F.last("_m", ignorenulls=True).over(_before()).alias("_carry"))
    inside = Window.partitionBy("_range").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    return (
        cut.withColumn("_in", F.last(value, ignorenulls=True).over(inside))
        .join(every, "_range")
        .withColumn(name, F.coalesce("_in", "_carry"))
        .drop("_range", "_in", "_carry")
    )


def serial_rank(df: DataFrame, seq: str, name: str = "rank", width: int = SERIAL_WIDTH) -> DataFrame:
    """Dense 0-based rank in the order of a unique serial."""
    cut = _ranged(df, seq, width)
    carry = cut.groupBy("_range").agg(F.count("*").alias("_n"))
    carry = carry.select("_range", F.coalesce(F.sum("_n").over(_before()), F.lit(0)).alias("_carry"))
    inside = Window.partitionBy("_range").orderBy(seq)
    return (
        cut.withColumn("_in", F.row_number().over(inside) - 1)
        .join(carry, "_range")
        .withColumn(name, (F.col("_in") + F.col("_carry")).cast("bigint"))
        .drop("_range", "_in", "_carry")
    )


def range_ordered(df: DataFrame, by: Sequence[str], partitions: int | None = None) -> DataFrame:
    """Rows sorted on ``by`` over range partitions, with ``_pid`` and ``_pos`` (place inside).

    The sort key must tell rows apart (end it with a unique id), so that no value of its head,
    however frequent, has to stay in one partition. The result is checkpointed: sampling picks
    the ranges, so they must not be drawn again by a second pass or a retry.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialise(df.repartitionByRange(n, *by).sortWithinPartitions(*by))
    position = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return ranged.withColumn("_pid", F.spark_partition_id()).withColumn("_pos", position)


def global_rank(df: DataFrame, by: Sequence[str], name: str = "rank",
                partitions: int | None = None) -> DataFrame:
    """Dense 0-based rank in the order of ``by``: one shuffle, one summary row per partition."""
    placed = range_ordered(df, by, partitions)
    sizes = placed.groupBy("_pid").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    # one row per partition of our own choosing: its size is known before it is broadcast
    return (
        placed.join(F.broadcast(offsets), "_pid")
        .withColumn(name, (F.col("_off") + F.col("_pos")).cast("bigint"))
        .drop("_pid", "_pos", "_off")
    )


def with_previous(df: DataFrame, key: str, order: Sequence[str], cols: dict[str, str], partitions: int | None = None) -> DataFrame:
    """Add the values of the previous row of the same key (``cols``: source column -> new column).

    Rows are range-partitioned on key and order, so a key with a third of all rows is spread over the
    cluster like any other; what passes over a seam is one row per partition.
    """
    placed = range_ordered(df, [key, *order], partitions)
    inside = Window.partitionBy("_pid").orderBy("_pos")
    row = F.struct(F.col(key).alias("k"), *[F.col(c).alias(f"v{i}") for i, c in enumerate(cols)])
    seams = placed.groupBy("_pid").agg(F.max_by(row, "_pos").alias("_last"))
    seams = seams.select("_pid", F.lag("_last").over(Window.orderBy("_pid")).alias("_seam"))
    joined = placed.withColumn("_prev", F.lag(row).over(inside)).join(F.broadcast(seams), "_pid")
    prev = F.when(F.col("_pos") == 0, F.col("_seam")).otherwise(F.col("_prev"))
    same = prev["k"].eqNullSafe(F.col(key)) & prev.isNotNull()
    out = joined
    for i, target in enumerate(cols.values()):
        out = out.withColumn(target, F.when(same, prev[f"v{i}"]))
    return out.drop("_pid", "_pos", "_prev", "_seam")


def carried(df: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    """The row's own ``value`` or, when it is null, that of the nearest earlier row in the order of ``by``.

    Like ``last_known`` for any order: range partitions, and one row per partition that carries the last value over.
    """
    placed = range_ordered(df, by)
    last = placed.filter(F.col(value).isNotNull()).groupBy("_pid").agg(F.max_by(value, "_pos").alias("_m"))
    every = placed.select("_pid").distinct().join(last, "_pid", "left")
    earlier = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    every = every.select("_pid", F.last("_m", ignorenulls=True).over(earlier).alias("_carry"))
    inside = Window.partitionBy("_pid").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    return (
        placed.withColumn("_in", F.last(value, ignorenulls=True).over(inside))
        .join(F.broadcast(every), "_pid")
        .withColumn(name, F.coalesce("_in", "_carry"))
        .drop("_pid", "_pos", "_in", "_carry")
    )
