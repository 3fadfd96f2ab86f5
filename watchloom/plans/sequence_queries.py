"""Orders, chains, timelines."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from watchloom.catalog import dims
from watchloom.operators import quality as Q
from watchloom.operators import sequence as S
from watchloom.operators import timeline as T
from watchloom.operators.ordered import serial_rank
from watchloom.operators.settings import TimingProfile
from watchloom.plans.inputs import EV, events, load, sql_table_of, typed_events
from watchloom.plans.registry import query

#: arrival order by id with a stamp that steps back now and then
_SQL_ARRIVALS = """SELECT event_id AS seq, epoch_us(ts) - CASE WHEN event_id % 9 = 4 THEN 660000000 ELSE 0 END AS us FROM events"""


def arrivals(spark, sf):
    step = F.expr("CASE WHEN event_id % 9 = 4 THEN 660000000 ELSE 0 END")
    us = F.unix_micros(F.col("ts").cast("timestamp")) - step
    return load(spark, sf, "events").select(F.col("event_id").alias("seq"), F.timestamp_micros(us).alias("ts"))


_SQL_SEEN = f"""
WITH a AS ({_SQL_ARRIVALS}), m AS (SELECT seq, us, max(us) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM a)"""


@query(_SQL_SEEN + """
SELECT count(*) AS records, count(*) FILTER (us < seen) AS inversions,
  coalesce(max(seen - us) FILTER (us < seen), 0) AS max_back_us,
  round(count(*) FILTER (us < seen)::DOUBLE / count(*), 6) AS inversion_rate FROM m""")
def time_inversions(spark, sf):
    return S.time_inversions(arrivals(spark, sf), "seq", "ts")


@query(_SQL_SEEN + """
SELECT 'raw' AS feed, count(*) AS records, count(*) FILTER (us < seen) AS inversions, count(*) FILTER (us < seen) = 0 AS ordered FROM m
UNION ALL SELECT 'sorted', count(*), 0, true FROM m""")
def ordered_output(spark, sf):
    """Before and after sorting: the sorted feed must have no inversion."""
    rows = arrivals(spark, sf)
    placed = S.arrival_seq(rows, "ts", "seq", "serial")
    raw = Q.ordered_output(rows, "seq", "ts").withColumn("feed", F.lit("raw"))
    done = Q.ordered_output(placed.select("serial", "ts"), "serial", "ts").withColumn("feed", F.lit("sorted"))
    return raw.unionByName(done)


_SQL_STEPS = f"""
WITH t AS (SELECT user_id, {sql_table_of()} AS state, lead({sql_table_of()}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_state FROM events),
o AS (SELECT state, next_state, count(*) AS n FROM t WHERE next_state IS NOT NULL GROUP BY 1, 2),
p AS (SELECT *, round(n::DOUBLE / sum(n) OVER (PARTITION BY state), 6) AS prob FROM o)"""


def observed(spark, sf):
    return S.transitions(typed_events(spark, sf), "user_id", "table", ("ts", "event_id"))


@query(_SQL_STEPS + "SELECT * FROM p")
def transitions(spark, sf):
    return observed(spark, sf)


@query(_SQL_STEPS + "SELECT * FROM p")
def transitions_split_hot_keys(spark, sf):
    """The same over many more ranges than cores, so that most entities lie across a seam."""
    return S.transitions(typed_events(spark, sf), "user_id", "table", ("ts", "event_id"), partitions=64)


_DECLARED = ", ".join(f"('{s}', '{n}', {w}::DOUBLE)" for s, m in dims.TRANSITIONS.items() for n, w in m.items())


@query(_SQL_STEPS + f""", d(state, next_state, w) AS (VALUES {_DECLARED}),
w AS (SELECT state, next_state, w / sum(w) OVER (PARTITION BY state) AS q FROM d)
SELECT state, CAST(sum(coalesce(n, 0)) AS BIGINT) AS steps, CAST(sum(CASE WHEN q IS NOT NULL THEN coalesce(n, 0) ELSE 0 END) AS BIGINT) AS allowed,
  round(sum(abs(coalesce(q, 0) - coalesce(prob, 0))) / 2, 4) AS distance,
  round(sum(CASE WHEN q IS NOT NULL THEN coalesce(n, 0) ELSE 0 END)::DOUBLE / sum(coalesce(n, 0)), 6) AS allowed_share
FROM p FULL JOIN w USING (state, next_state) GROUP BY 1 HAVING sum(coalesce(n, 0)) > 0""")
def transition_conformance(spark, sf):
    return S.transition_conformance(observed(spark, sf), S.declared_transitions(spark))


@query(f"""
WITH {EV}, o AS (SELECT event_type AS state, 'k' || (k % 4) AS next_state, round(sum(value), 2) AS weight FROM ev GROUP BY 1, 2)
SELECT state, next_state, weight, round(weight / sum(weight) OVER (PARTITION BY state), 6) AS prob FROM o""")
def normalised_weights(spark, sf):
    matrix = events(spark, sf).groupBy(
        F.col("event_type").alias("state"), F.concat(F.lit("k"), F.col("k") % 4).alias("next_state")).agg(
        F.round(F.sum("value"), 2).alias("weight"))
    return S.normalise_weights(matrix).withColumn("prob", F.round("prob", 6))


@query("""
SELECT event_id, CAST(d AS INT) AS depth FROM (
  SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS d FROM events) WHERE d <= 3""")
def chain_depths(spark, sf):
    return S.chain_depth(load(spark, sf, "events"), "user_id", ("ts", "event_id")).select("event_id", "depth")


@query(f"""
WITH n AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS r, count(*) OVER () AS total FROM events WHERE event_type <> 'error'),
b AS (SELECT i, i * (SELECT any_value(total) FROM n) // 23 AS lo, (i + 1) * (SELECT any_value(total) FROM n) // 23 AS hi FROM range(23) t(i))
SELECT event_id, CAST(i AS INT) AS stage_idx, true AS is_noise FROM n JOIN b ON r >= lo AND r < hi
UNION ALL SELECT event_id, CAST(event_id % 23 AS INT), false FROM events WHERE event_type = 'error'""")
def interleaved_batches(spark, sf):
    rows = load(spark, sf, "events").select("event_id", "event_type")
    attack = rows.filter("event_type = 'error'").select("event_id", (F.col("event_id") % 23).cast("int").alias("stage_idx"))
    noise = serial_rank(rows.filter("event_type <> 'error'"), "event_id", "rank").drop("event_type")
    total = rows.filter("event_type <> 'error'").count()
    return S.interleave_batches(attack, noise, 23, total).select("event_id", "stage_idx", "is_noise")


@query("""
SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey, rank FROM (SELECT *, CAST(row_number() OVER (
  PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_quantity) AS INT) AS rank FROM lineitem) WHERE rank <= 10""")
def top_rows_per_group(spark, sf):
    rows = load(spark, sf, "lineitem")
    out = S.topk_per_group(rows, ["l_returnflag"], [
        F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber"), F.asc("l_partkey"), F.asc("l_quantity")], 10)
    return out.select("l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "rank")


@query("SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 20")
def most_common_entities(spark, sf):
    return S.most_common(load(spark, sf, "events"), "user_id", 20)


@query("""SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS serial FROM orders""")
def arrival_serials(spark, sf):
    rows = load(spark, sf, "orders").select("o_orderdate", "o_orderkey")
    return S.arrival_seq(rows, "o_orderdate", "o_orderkey").select("o_orderkey", "serial")


@query(f"""
WITH {EV}, x AS (SELECT event_id, CASE WHEN k % 4 > 0 AND event_id > 2 THEN event_type || k END AS key FROM ev)
SELECT event_id, coalesce(last_value(key IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS key FROM x""")
def forward_filled_keys(spark, sf):
    key = F.expr("CASE WHEN k % 4 > 0 AND event_id > 2 THEN concat(event_type, k) END")
    rows = events(spark, sf).select("event_id", key.alias("key"))
    return S.forward_fill_key(rows, "event_id", "key")


@query("""
SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS place FROM (
  SELECT event_id, date_trunc('hour', ts) AS ts FROM events)""")
def time_sorted_feed(spark, sf):
    """Stable sort by the hour: the place of each row in the sorted output."""
    rows = load(spark, sf, "events").select("event_id", F.date_trunc("hour", "ts").alias("ts"))
    return S.time_sorted(rows, "ts", "event_id").select("event_id", "place")


# --- calendars and the virtual timeline ---------------------------------------------------

WEEK = TimingProfile(avg_delay_seconds=1.0, weekends=True, utc_offset_hours=-8.0)
FAST = TimingProfile(avg_delay_seconds=0.2, weekends=True)
START, END = datetime(2026, 9, 18), datetime(2026, 9, 21)
_LOCAL = "(ts - INTERVAL 8 HOUR)"
_FACTOR = f"""(CASE WHEN hour({_LOCAL}) >= 9 AND hour({_LOCAL}) < 17 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE / 0.1::DOUBLE END *
  CASE WHEN isodow({_LOCAL}) >= 6 THEN 1.0::DOUBLE / 0.15::DOUBLE ELSE 1.0::DOUBLE END)"""


@query(f"""SELECT event_id, round({_FACTOR}, 6) AS factor, round(greatest(0.01, 2.5 * {_FACTOR}), 6) AS delay FROM events""")
def calendar_pace(spark, sf):
    slow = TimingProfile(avg_delay_seconds=2.5, weekends=True, utc_offset_hours=-8.0, jitter=0.0)
    ts = F.col("ts")
    return load(spark, sf, "events").select(
        "event_id", F.round(T.calendar_factor(ts, WEEK), 6).alias("factor"),
        F.round(T.expected_delay(ts, slow), 6).alias("delay"))


def _hours_sql(avg: str) -> str:
    """The pace of each hour stepped through one after the other, in whole microseconds."""
    return f"""
WITH RECURSIVE h AS (
  SELECT 0::BIGINT AS i, 0::BIGINT AS a, TIMESTAMP '2026-09-18 00:00:00' AS st, 0::BIGINT AS n, 0::BIGINT AS step
  UNION ALL
  SELECT i + 1, a + n, st + to_microseconds(n * step), c, s FROM (
    SELECT i, a, st, n, step, s, (epoch_us(least(date_trunc('hour', nxt) + INTERVAL 1 HOUR, TIMESTAMP '2026-09-21')) - epoch_us(nxt) + s - 1) // s AS c, nxt FROM (
      SELECT *, CAST(round(1000000 * {avg} * CASE WHEN hour(nxt) >= 9 AND hour(nxt) < 17 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE / 0.1::DOUBLE END
         * CASE WHEN isodow(nxt) >= 6 THEN 1.0::DOUBLE / 0.15::DOUBLE ELSE 1.0::DOUBLE END) AS BIGINT) AS s
      FROM (SELECT *, st + to_microseconds(n * step) AS nxt FROM h))) WHERE nxt < TIMESTAMP '2026-09-21'),
spans AS (SELECT a AS rank_from, a + n AS rank_to, epoch_us(st) AS first_us, step FROM h WHERE n > 0)"""


@query(_hours_sql("0.2") + """
SELECT o_orderkey, first_us + (r - rank_from) * step AS us
FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS r FROM orders) LEFT JOIN spans ON r >= rank_from AND r < rank_to""")
def virtual_timeline(spark, sf):
    """Orders play the events to be placed on three days with nights and a weekend."""
    ranked = serial_rank(load(spark, sf, "orders").select("o_orderkey"), "o_orderkey", "rank")
    out = T.assign_timestamps(ranked, START, END, FAST)
    return out.select("o_orderkey", F.unix_micros("ts").alias("us"))


@query(_hours_sql("7.0") + """
SELECT count(*) AS records, count(first_us) AS placed, max(first_us + (r - rank_from) * step) AS last_us
FROM (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS r FROM orders) LEFT JOIN spans ON r >= rank_from AND r < rank_to""")
def virtual_timeline_overflow(spark, sf):
    """A slow pace: the window fills up and later rows stay without a stamp."""
    slow = TimingProfile(avg_delay_seconds=7.0, weekends=True)
    ranked = serial_rank(load(spark, sf, "orders").select("o_orderkey"), "o_orderkey", "rank")
    out = T.assign_timestamps(ranked, START, END, slow)
    return out.agg(F.count("*").alias("records"), F.count("ts").alias("placed"),
                   F.max(F.unix_micros("ts")).alias("last_us"))


@query("""
SELECT event_id, epoch_us(ts) + 3600000000 AS end_us, epoch_us(ts) - 60000000 + 3600000000 AS start_us FROM events""")
def shifted_times(spark, sf):
    hour = F.expr("INTERVAL 1 HOUR")
    rows = load(spark, sf, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("old"), (F.col("ts").cast("timestamp") + hour).alias("new"),
        (F.col("ts").cast("timestamp") - F.expr("INTERVAL 1 MINUTE")).alias("start_time"),
        F.col("ts").cast("timestamp").alias("end_time"))
    out = T.shift_secondary_times(rows, "old", "new")
    return out.select("event_id", F.unix_micros("end_time").alias("end_us"), F.unix_micros("start_time").alias("start_us"))


@query("""
SELECT CAST(isodow(ts) - 1 AS INT) AS weekday, CAST(hour(ts) AS INT) AS hour, count(*) AS n,
  round(CASE WHEN hour(ts) >= 9 AND hour(ts) < 17 THEN 1.0::DOUBLE ELSE 0.1 END * CASE WHEN isodow(ts) >= 6 THEN 0.15::DOUBLE ELSE 1.0 END, 6) AS expected_pace
FROM events GROUP BY ALL""")
def activity_by_hour(spark, sf):
    return T.activity_profile(load(spark, sf, "events"), "ts", TimingProfile(weekends=True))


@query("""
WITH g AS (SELECT user_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6 AS gap FROM events)
SELECT user_id, count(gap) AS gaps, round(avg(gap), 3) AS mean_gap, round(stddev_pop(gap), 3) AS std_gap,
  round(stddev_pop(gap) / nullif(avg(gap), 0), 4) AS cv FROM g WHERE gap IS NOT NULL GROUP BY 1""")
def interarrival_gaps(spark, sf):
    return T.interarrival(load(spark, sf, "events"), "user_id", "ts", "event_id")
