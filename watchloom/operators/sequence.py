"""Orders, chains and event-to-event transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from watchloom.catalog import dims
from watchloom.operators.ordered import (
    SERIAL_WIDTH, global_rank, last_known, running_max_before, with_previous)


def time_inversions(df: DataFrame, seq: str, ts: str, width: int = SERIAL_WIDTH) -> DataFrame:
    """Rows that arrive after a later-stamped one: count, share, and the largest step back (µs)."""
    stamped = df.select(seq, F.unix_micros(F.col(ts).cast("timestamp")).alias("_us"))
    marked = running_max_before(stamped, seq, "_us", "_seen", width)
    late = F.col("_us") < F.col("_seen")
    return marked.agg(
        F.count("*").alias("records"),
        F.count_if(late).alias("inversions"),
        F.coalesce(F.max(F.when(late, F.col("_seen") - F.col("_us"))), F.lit(0)).alias("max_back_us"),
    ).withColumn("inversion_rate", F.round(F.col("inversions") / F.col("records"), 6))


def transitions(df: DataFrame, key: str, state: str, order: tuple[str, ...], partitions: int | None = None) -> DataFrame:
    """Observed (state, next state) counts and shares, per entity in time order, over so many ranges."""
    narrow = df.select(*dict.fromkeys((key, *order, state)))
    stepped = with_previous(narrow, key, order, {state: "_from"}, partitions)
    counted = (
        stepped.filter(F.col("_from").isNotNull())
        .groupBy(F.col("_from").alias("state"), F.col(state).alias("next_state"))
        .agg(F.count("*").alias("n")))
    by_state = Window.partitionBy("state")
    return counted.withColumn("prob", F.round(F.col("n") / F.sum("n").over(by_state), 6))


def declared_transitions(spark: SparkSession, matrix: dict | None = None) -> DataFrame:
    rows = [(s, n, float(w)) for s, nexts in (matrix or dims.TRANSITIONS).items() for n, w in nexts.items()]
    return spark.createDataFrame(rows, "state string, next_state string, weight double")


def normalise_weights(matrix: DataFrame, weight: str = "weight") -> DataFrame:
    """Weights need not sum to one: a state with a row always yields a successor."""
    return matrix.withColumn(
        "prob", F.col(weight) / F.sum(weight).over(Window.partitionBy("state")))


def transition_conformance(observed: DataFrame, declared: DataFrame) -> DataFrame:
    """Per observed state: the share of steps the declared matrix allows and the distance
    between the two distributions (half the sum of absolute differences)."""
    want = normalise_weights(declared).select("state", "next_state", F.col("prob").alias("_p"))
    both = observed.select("state", "next_state", "n", F.col("prob").alias("_q")).join(
        want, ["state", "next_state"], "full_outer")
    return (
        both.groupBy("state")
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("steps"),
            F.coalesce(F.sum(F.when(F.col("_p").isNotNull(), F.col("n"))), F.lit(0)).cast("bigint").alias("allowed"),
            F.round(F.sum(F.abs(F.coalesce("_p", F.lit(0.0)) - F.coalesce("_q", F.lit(0.0)))) / 2, 4).alias("distance"),
        )
        .filter(F.col("steps") > 0)
        .withColumn("allowed_share", F.round(F.col("allowed") / F.col("steps"), 6))
    )


def chain_depth(df: DataFrame, correlation: str, order: tuple[str, ...],
                max_depth: int = dims.MAX_DEPTH) -> DataFrame:
    """0-based place in the correlation chain, rows beyond ``max_depth`` left out.

    The depth filter directly on the rank lets Spark cut each chain to its first rows before the
    shuffle, so a chain with very many rows costs no more than a short one.
    """
    place = F.row_number().over(Window.partitionBy(correlation).orderBy(*order))
    return (
        df.withColumn("_place", place)
        .filter(F.col("_place") <= max_depth + 1)
        .withColumn("depth", F.col("_place") - 1)
        .drop("_place")
    )


def interleave_batches(attack: DataFrame, noise: DataFrame, stages: int, noise_rows: int,
                       stage: str = "stage_idx", rank: str = "rank", event: str | None = None) -> DataFrame:
    """Attack rows and noise rows in one order: after each stage its contiguous slice of noise.

    Slice ``i`` holds the ranks from ``i*N//S`` up to ``(i+1)*N//S``; solved for the slice of a
    rank this is arithmetic, so no join is needed. ``noise`` carries a dense 0-based ``rank``.
    The order is that of (``stage``, ``is_noise``, ``slot``): ``slot`` is an attack row's ``event`` column (its place
    in the stage; null without one) and a noise row's place in its slice.
    """
    slice_of = F.floor(((F.col(rank) + 1) * F.lit(stages) - 1) / F.lit(noise_rows)).cast("int")
    slot = F.col(event).cast("bigint") if event else F.lit(None).cast("bigint")
    a = attack.withColumn("is_noise", F.lit(False)).withColumn("slot", slot)
    if noise_rows == 0 or stages == 0:
        return a
    n = noise.withColumn(stage, slice_of).withColumn("is_noise", F.lit(True)).withColumn(
        "slot", F.col(rank) - F.floor(F.col(stage).cast("bigint") * F.lit(noise_rows) / F.lit(stages)))
    return a.unionByName(n, allowMissingColumns=True)


def topk_per_group(df: DataFrame, group: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group; Spark limits each group before the shuffle."""
    return df.withColumn(
        name, F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    ).filter(F.col(name) <= k)


def most_common(df: DataFrame, value: str, k: int) -> DataFrame:
    """The ``k`` most frequent values, ties by value."""
    counted = df.groupBy(value).agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), F.asc(value)).limit(k)


def arrival_seq(df: DataFrame, ts: str, row_id: str, name: str = "serial",
                partitions: int | None = None) -> DataFrame:
    """1-based serial in (time, id) order; assign it before a row is split into several lines,
    so that the lines of one event share it."""
    return global_rank(df, [ts, row_id], name, partitions).withColumn(name, F.col(name) + 1)


def forward_fill_key(df: DataFrame, seq: str, key: str, width: int = SERIAL_WIDTH) -> DataFrame:
    """A row without a key takes that of the nearest earlier row; the first ones an empty key."""
    filled = last_known(df, seq, key, "_filled", width)
    return filled.withColumn(key, F.coalesce("_filled", F.lit(""))).drop("_filled")


def time_sorted(df: DataFrame, ts: str, seq: str, name: str = "place") -> DataFrame:
    """Each row's 0-based place in the order by time, ties in order of arrival.

    The ranges of the order are drawn once; numbering an ``orderBy`` in two passes could draw them twice.
    """
    return global_rank(df, [ts, seq], name)


def unify(*tables: DataFrame) -> DataFrame:
    """Tables with different columns as one feed; what a table lacks is null."""
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table, allowMissingColumns=True)
    return out
