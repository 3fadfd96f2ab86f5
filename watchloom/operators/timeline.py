"""Business calendars, the virtual timeline and activity in time."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from watchloom.functions.hashing import hash_fraction
from watchloom.operators.ordered import with_previous
from watchloom.operators.rangejoin import range_join
from watchloom.operators.settings import TimingProfile, check_window

SECONDARY_TIMES = ("start_time", "end_time", "last_modified_time")


def _local(ts: Column, profile: TimingProfile) -> Column:
    shift = F.make_dt_interval(secs=F.lit(profile.utc_offset_hours * 3600).cast("decimal(18,6)"))
    return ts + shift if profile.utc_offset_hours else ts


def calendar_factor(ts: Column, profile: TimingProfile) -> Column:
    """How much longer the wait is at this hour; both tests read the site's local clock."""
    local = _local(ts, profile)
    hour = F.hour(local)
    at_work = (hour >= profile.work_start) & (hour < profile.work_end)
    factor = F.when(at_work, F.lit(1.0)).otherwise(F.lit(1.0 / profile.after_hours_factor))
    if profile.weekends:
        factor = factor * F.when(F.weekday(local) >= 5, F.lit(1.0 / profile.weekend_factor)).otherwise(F.lit(1.0))
    return factor


def expected_delay(ts: Column, profile: TimingProfile, key: Column | None = None) -> Column:
    """Mean wait before the next event; with a ``key``, a repeatable Gaussian draw around it."""
    mean = F.lit(profile.avg_delay_seconds) * calendar_factor(ts, profile)
    if key is None or profile.jitter == 0:
        return F.greatest(F.lit(0.01), mean)
    radius = F.sqrt(-2 * F.log(1 - hash_fraction(F.concat(key, F.lit("|r")))))
    angle = F.cos(2 * F.pi() * hash_fraction(F.concat(key, F.lit("|a"))))
    return F.greatest(F.lit(0.01), mean * (1 + F.lit(profile.jitter) * radius * angle))


def _delay_us(at: datetime, profile: TimingProfile) -> int:
    local = at + timedelta(hours=profile.utc_offset_hours)
    delay = profile.avg_delay_seconds
    if not profile.work_start <= local.hour < profile.work_end:
        delay /= profile.after_hours_factor
    if profile.weekends and local.weekday() >= 5:
        delay /= profile.weekend_factor
    return max(1, round(max(0.01, delay) * 1_000_000))


def hour_table(spark: SparkSession, start: datetime, end: datetime, profile: TimingProfile) -> DataFrame:
    """Stretches of constant pace: first rank, rank after the last, first stamp and step.

    The wait depends on the clock itself, so ranks do not map to time by one formula; within an
    hour of the site's clock they do. The table has one row per hour of the window, whatever the
    number of events.
    """
    check_window(start, end)
    offset = timedelta(hours=profile.utc_offset_hours)
    rows, rank, at = [], 0, start
    while at < end:
        local = at + offset
        edge = local.replace(minute=0, second=0, microsecond=0) + timedelta(hours=1) - offset
        stop = min(edge, end)
        step = _delay_us(at, profile)
        span = (stop - at) // timedelta(microseconds=1)
        count = -(-span // step)
        rows.append((rank, rank + count, at, step))
        rank += count
        at += timedelta(microseconds=count * step)
    return spark.createDataFrame(
        [(a, b, (t - datetime(1970, 1, 1)) // timedelta(microseconds=1), s) for a, b, t, s in rows],
        "rank_from bigint, rank_to bigint, first_us bigint, step_us bigint")


def assign_timestamps(df: DataFrame, start: datetime, end: datetime, profile: TimingProfile,
                      rank: str = "rank", name: str = "ts") -> DataFrame:
    """Place event number ``rank`` on the virtual timeline of the half-open window.

    Rows past the end of the window keep a null stamp. ``progress`` is the share of the window
    covered. Exact when the profile has no jitter.
    """
    spans = hour_table(df.sparkSession, start, end, profile)
    # cells as wide as a busy hour: one or two stretches each
    width = float(max(1, int(3_600_000_000 / _delay_us(datetime(2024, 1, 1, profile.work_start), profile))))
    placed = range_join(df, spans, rank, "rank_from", "rank_to", width, how="left")
    stamp_us = F.col("first_us") + (F.col(rank) - F.col("rank_from")) * F.col("step_us")
    begin = (start - datetime(1970, 1, 1)) // timedelta(microseconds=1)
    length = (end - start) // timedelta(microseconds=1)
    return (
        placed.withColumn(name, F.timestamp_micros(stamp_us))
        .withColumn("progress", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (stamp_us - begin) / F.lit(length))))
        .drop("rank_from", "rank_to", "first_us", "step_us")
    )


def shift_secondary_times(df: DataFrame, old: str, new: str,
                          columns: tuple[str, ...] = SECONDARY_TIMES) -> DataFrame:
    """Move an event's inner times by as much as its own stamp moved."""
    present = [c for c in columns if c in df.columns]
    return df.withColumns({c: F.col(c) + (F.col(new) - F.col(old)) for c in present})


def activity_profile(df: DataFrame, ts: str, profile: TimingProfile = TimingProfile()) -> DataFrame:
    """Observed events per weekday (Monday 0) and hour, with the pace the curve expects."""
    local = _local(F.col(ts), profile)
    counted = df.groupBy(F.weekday(local).alias("weekday"), F.hour(local).alias("hour")).agg(
        F.count("*").alias("n"))
    at_work = (F.col("hour") >= profile.work_start) & (F.col("hour") < profile.work_end)
    pace = F.when(at_work, F.lit(1.0)).otherwise(F.lit(profile.after_hours_factor))
    weekend = F.when(F.col("weekday") >= 5, F.lit(profile.weekend_factor)).otherwise(F.lit(1.0))
    return counted.withColumn("expected_pace", F.round(pace * weekend if profile.weekends else pace, 6))


def interarrival(df: DataFrame, key: str, ts: str, row_id: str) -> DataFrame:
    """Mean, deviation and relative deviation of the gaps between an entity's events (seconds)."""
    stamped = df.select(key, row_id, F.unix_micros(F.col(ts).cast("timestamp")).alias("_us"))
    stepped = with_previous(stamped, key, ("_us", row_id), {"_us": "_before"})
    gaps = stepped.filter(F.col("_before").isNotNull()).withColumn(
        "_gap", (F.col("_us") - F.col("_before")) / F.lit(1e6))
    return gaps.groupBy(key).agg(
        F.count("*").alias("gaps"),
        F.round(F.avg("_gap"), 3).alias("mean_gap"),
        F.round(F.stddev_pop("_gap"), 3).alias("std_gap"),
        F.round(F.stddev_pop("_gap") / F.nullif(F.avg("_gap"), F.lit(0.0)), 4).alias("cv"),
    )
