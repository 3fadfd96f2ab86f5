"""Counts, coverage, unions, detections and rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchloom.operators import coverage as C
from watchloom.operators import detect as D
from watchloom.operators import quality as Q
from watchloom.operators import sequence as S
from watchloom.plans.inputs import EV, events, load, sql_table_of, typed_events
from watchloom.plans.registry import query
from watchloom.streaming import jobs

TABLES = ("DeviceProcessEvents", "SigninLogs", "CommonSecurityLog", "AzureActivity", "OfficeActivity")


@query(f"""SELECT {sql_table_of()} AS "table", count(*) AS records FROM events GROUP BY 1""")
def table_counts(spark, sf):
    return C.table_counts(typed_events(spark, sf))


@query("""
SELECT count(*) AS events, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 3) AS elapsed_s,
  round(count(*) / round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 3), 6) AS rate, count(*) >= 20 AS enough FROM events""")
def throughput(spark, sf):
    return C.throughput(load(spark, sf, "events"), "ts")


@query("""
SELECT o_orderpriority AS scenario, count(DISTINCT month(o_orderdate)) AS stages, count(*) AS templates,
  CAST(sum(o_orderkey % 5) AS BIGINT) AS events, count(DISTINCT o_orderstatus) AS phases, count(DISTINCT o_custkey % 50) AS techniques
FROM orders GROUP BY 1""")
def scenario_catalog(spark, sf):
    rows = load(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("scenario"), F.month("o_orderdate").alias("stage_idx"),
        (F.col("o_orderkey") % 5).alias("multiply"), F.col("o_orderstatus").alias("phase"),
        (F.col("o_custkey") % 50).alias("technique"))
    return C.scenario_catalog(rows)


@query("""
SELECT l_returnflag AS tactic, l_linestatus AS technique, CAST(grouping(l_returnflag) * 2 + grouping(l_linestatus) AS INT) AS level,
  count(*) AS events FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def attack_coverage(spark, sf):
    rows = load(spark, sf, "lineitem").select(F.col("l_returnflag").alias("tactic"), F.col("l_linestatus").alias("technique"))
    return C.attack_coverage(rows, "tactic", "technique")


@query(f"""
WITH {EV}
SELECT 'mitre' AS framework, 'T' || (k % 7) AS id, count(*) AS events FROM ev WHERE k % 2 = 0 GROUP BY 2
UNION ALL SELECT 'atlas', 'AML' || (k % 3), count(*) FROM ev WHERE k % 3 = 0 GROUP BY 2
UNION ALL SELECT 'd3fend', 'd3f:' || (k % 2), count(*) FROM ev WHERE k % 5 = 0 GROUP BY 2
UNION ALL SELECT 'phase', event_type, count(*) FROM ev WHERE event_type <> 'view' GROUP BY 2""")
def framework_ids(spark, sf):
    rows = events(spark, sf).select(
        F.expr("CASE WHEN k % 2 = 0 THEN named_struct('technique_id', concat('T', k % 7)) END").alias("mitre"),
        F.expr("CASE WHEN k % 3 = 0 THEN named_struct('id', concat('AML', k % 3)) END").alias("atlas"),
        F.expr("CASE WHEN k % 5 = 0 THEN named_struct('id', concat('d3f:', k % 2)) END").alias("d3fend"),
        F.expr("CASE WHEN event_type = 'view' THEN '' ELSE event_type END").alias("killchain_phase"))
    return C.framework_ids(rows)


@query("""SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)""")
def coverage_gaps(spark, sf):
    expected = load(spark, sf, "customer").select("c_custkey")
    seen = load(spark, sf, "events").select(F.col("user_id").alias("c_custkey"))
    return C.coverage_gaps(expected, seen, ["c_custkey"])


@query(f"""
SELECT {sql_table_of()} AS "table", count(*) FILTER (user_id % 3 = 0) AS s0, count(*) FILTER (user_id % 3 = 1) AS s1,
  count(*) FILTER (user_id % 3 = 2) AS s2 FROM events GROUP BY 1""")
def table_source_matrix(spark, sf):
    rows = typed_events(spark, sf).withColumn("source", F.concat(F.lit("s"), F.col("user_id") % 3))
    return C.table_source_matrix(rows, "table", "source", ["s0", "s1", "s2"])


@query("""
WITH s AS (SELECT l_orderkey, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS hit, count(*) AS n,
  count(*) FILTER (l_returnflag = 'R') AS bad FROM lineitem GROUP BY 1)
SELECT CAST(sum(n) FILTER (hit = 1) AS BIGINT) AS events, CAST(sum(bad) AS BIGINT) AS exact FROM s""")
def malicious_stage_size(spark, sf):
    rows = load(spark, sf, "lineitem").select("l_orderkey", (F.col("l_returnflag") == "R").alias("is_malicious"))
    return C.malicious_stage_size(rows, ["l_orderkey"])


@query("""
WITH c AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS records, count(l_orderkey) AS distinct_keys, CAST(sum(n - 1) AS BIGINT) AS surplus FROM c""")
def uniqueness(spark, sf):
    return C.uniqueness(load(spark, sf, "lineitem"), "l_orderkey")


@query("SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def duplicate_keys(spark, sf):
    return C.duplicate_keys(load(spark, sf, "lineitem"), "l_orderkey")


# --- unions and differences ---------------------------------------------------------------

@query("""
SELECT 'SigninLogs' AS "Type", event_id, 'u' || user_id AS who, CAST(NULL AS DOUBLE) AS amount FROM events WHERE event_type = 'view'
UNION ALL SELECT 'OfficeActivity', event_id, NULL, value FROM events WHERE event_type = 'purchase'""")
def unified_feed(spark, sf):
    """Tables with different columns as one feed."""
    rows = load(spark, sf, "events")
    a = rows.filter("event_type = 'view'").select(
        F.lit("SigninLogs").alias("Type"), "event_id", F.concat(F.lit("u"), "user_id").alias("who"))
    b = rows.filter("event_type = 'purchase'").select(F.lit("OfficeActivity").alias("Type"), "event_id", F.col("value").alias("amount"))
    return S.unify(a, b)


@query("""
SELECT n_name AS name FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9950)""")
def expected_minus_actual(spark, sf):
    nation = load(spark, sf, "nation")
    rich = load(spark, sf, "customer").filter("c_acctbal > 9950")
    actual = nation.join(rich, nation.n_nationkey == rich.c_nationkey, "left_semi").select(F.col("n_name").alias("name"))
    return Q.missing_rows(nation.select(F.col("n_name").alias("name")), actual)


@query(f"""
WITH {EV}, m AS (SELECT DISTINCT 'K' || k AS next_state, event_type AS state FROM ev)
SELECT state, next_state FROM m WHERE next_state NOT IN (SELECT DISTINCT 'K' || p_size FROM part)""")
def unknown_transition_targets(spark, sf):
    matrix = events(spark, sf).select(F.concat(F.lit("K"), "k").alias("next_state"), F.col("event_type").alias("state")).distinct()
    known = load(spark, sf, "part").select(F.concat(F.lit("K"), "p_size").alias("next_state")).distinct()
    return Q.transition_targets_known(matrix, known)


@query("""
WITH a AS (SELECT lang, count(*) AS rows_in FROM documents GROUP BY 1),
b AS (SELECT lang, count(*) AS rows_out FROM documents JOIN labels USING (doc_id) GROUP BY 1)
SELECT lang, rows_in, coalesce(rows_out, 0) AS rows_out, rows_in = coalesce(rows_out, 0) AS kept FROM a LEFT JOIN b USING (lang)""")
def conservation(spark, sf):
    docs = load(spark, sf, "documents").select("doc_id", "lang")
    return Q.conservation(docs, docs.join(load(spark, sf, "labels"), "doc_id"), "lang")


# --- detections ---------------------------------------------------------------------------

#: the rules with patterns these texts contain
RULES = (
    D.Rule("100001", 12, "text", "(?i)tion of the", "phrase"),
    D.Rule("100002", 14, "text", "@|http", "address"),
    D.Rule("100003", 14, "text", "[0-9]{3}-[0-9]{3}", "number"),
    D.Rule("100004", 13, "text", "Copyright|License", "licence"),
    D.Rule("100005", 14, "text", "the .* of the", "span"),
)
_SQL_RULES = "r(rule_id, lvl, p) AS (VALUES " + ", ".join(f"('{r.rule_id}', {r.level}, '{r.pattern}')" for r in RULES) + ")"


@query(f"""WITH {_SQL_RULES} SELECT doc_id, rule_id, CAST(lvl AS INT) AS "level" FROM documents, r WHERE regexp_matches(text, p)""")
def detections(spark, sf):
    return D.detect(load(spark, sf, "documents"), RULES, ("doc_id",)).select("doc_id", "rule_id", "level")


@query(f"""WITH {_SQL_RULES} SELECT doc_id, rule_id FROM documents, r WHERE regexp_matches(text, p)""")
def detections_from_rule_table(spark, sf):
    rules = spark.createDataFrame([(r.rule_id, r.level, r.column, r.pattern, r.description) for r in RULES],
                                  "rule_id string, level int, column string, pattern string, description string")
    values = load(spark, sf, "documents").select("doc_id", F.lit("text").alias("column"), F.col("text").alias("value"))
    return D.detect_long(values, D.read_rules(rules), ("doc_id",)).select("doc_id", "rule_id")


@query(f"""WITH {_SQL_RULES} SELECT rule_id, CAST(lvl AS INT) AS "level", count(*) AS hits FROM documents, r WHERE regexp_matches(text, p) GROUP BY 1, 2""")
def rule_hits(spark, sf):
    return D.rule_hits(D.detect(load(spark, sf, "documents"), RULES, ("doc_id",)))


@query(f"""
WITH {_SQL_RULES}, x AS (SELECT rule_id, regexp_matches(text, p) AS hit, toxic = 1 AS bad FROM documents JOIN labels USING (doc_id), r)
SELECT rule_id, count(*) FILTER (hit) AS hits, count(*) FILTER (hit AND bad) AS true_hits,
  round(CASE WHEN count(*) FILTER (hit) > 0 THEN count(*) FILTER (hit AND bad)::DOUBLE / count(*) FILTER (hit) END, 6) AS "precision",
  round(CASE WHEN count(*) FILTER (bad) > 0 THEN count(*) FILTER (hit AND bad)::DOUBLE / count(*) FILTER (bad) END, 6) AS recall
FROM x GROUP BY 1""")
def rule_quality(spark, sf):
    docs = load(spark, sf, "documents").join(load(spark, sf, "labels"), "doc_id").withColumn("bad", F.col("toxic") == 1)
    return D.rule_quality(docs, RULES, "bad")


_RULE_LINES = {
    "click": ("ProcessCommandLine", ("vssadmin.exe delete shadows /all", "Certify.exe request", "run --job", "AnyDesk.exe --install")),
    "view": ("Message", ("Failed password for root from 10.0.0.1 port 22 ssh2", "Accepted password for user")),
    "signup": ("ActionType", ("Consent to application.", "Add user.")),
}


@query(f"""
WITH {EV}, x AS (SELECT event_id, event_type, k FROM ev)
SELECT event_id, CASE k % 4 WHEN 0 THEN '100005' WHEN 1 THEN '100003' ELSE '100002' END AS rule_id, 14 AS "level" FROM x WHERE event_type = 'click' AND k % 4 <> 2
UNION ALL SELECT event_id, '100001', 12 FROM x WHERE event_type = 'view' AND k % 2 = 0
UNION ALL SELECT event_id, '100004', 13 FROM x WHERE event_type = 'signup' AND k % 2 = 0""")
def default_rules(spark, sf):
    """The built-in rules over columns that carry their telltale texts."""
    cols = []
    for kind, (name, lines) in _RULE_LINES.items():
        line = F.element_at(F.array(*map(F.lit, lines)), F.expr(f"k % {len(lines)} + 1"))
        cols.append(F.when(F.col("event_type") == kind, line).alias(name))
    rows = events(spark, sf).select("event_id", *cols)
    return D.detect(rows, keep=("event_id",)).select("event_id", "rule_id", "level")


# --- rates (batch form of the streaming job) ----------------------------------------------

@query(f"""
SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS from_us, {sql_table_of()} AS "table", count(*) AS events FROM events GROUP BY 1, 2""")
def hourly_rate(spark, sf):
    out = jobs.rate(typed_events(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 hour")
    return out.select(F.unix_micros("window_start").alias("from_us"), "table", "events")


@query(f"""
WITH w AS (SELECT epoch_us(time_bucket(INTERVAL 30 MINUTE, ts)) - o * 1800000000 AS from_us, {sql_table_of()} AS "table" FROM events, range(2) t(o))
SELECT from_us, "table", count(*) AS events FROM w GROUP BY 1, 2""")
def sliding_rate(spark, sf):
    out = jobs.rate(typed_events(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 hour", "30 minutes")
    return out.select(F.unix_micros("window_start").alias("from_us"), "table", "events")


@query("""
SELECT event_id, 'r' || c_custkey AS rule_id FROM events JOIN customer ON user_id = c_custkey WHERE event_type IN ('click', 'view')
UNION ALL SELECT event_id, 'short' FROM events WHERE user_id % 1000 = 77
UNION ALL SELECT event_id, 'either' FROM events WHERE event_type IN ('error', 'signup')""")
def detections_indexed(spark, sf):
    """A rule for every customer, from a table, and two without a text that must be there; each event meets only rules it may fire."""
    rule = lambda i, p: F.struct(i.alias("rule_id"), F.lit(3).alias("level"), F.lit("message").alias("column"), p.alias("pattern"), F.lit("").alias("description"))
    own = load(spark, sf, "customer").select(rule(F.concat(F.lit("r"), "c_custkey"), F.concat(F.lit("^(?i)USER"), "c_custkey", F.lit(" did (click|view)$"))).alias("r"))
    other = spark.range(1).select(F.explode(F.array(
        rule(F.lit("short"), F.lit("^user[0-9]*(?:(?<![0-9])77|077) did [a-z]+")), rule(F.lit("either"), F.lit("(error|signup)$")))).alias("r"))
    values = load(spark, sf, "events").select("event_id", F.lit("message").alias("column"), F.concat(F.lit("user"), "user_id", F.lit(" did "), "event_type").alias("value"))
    return D.detect_indexed(values, own.unionByName(other).select("r.*"), ("event_id",)).select("event_id", "rule_id")


@query("SELECT 'r' || c_custkey AS rule_id, 'c' || c_nationkey AS \"column\" FROM customer WHERE c_nationkey > 9")
def unused_rules(spark, sf):
    """Rules by nation over a table that has ten of their columns."""
    rules = load(spark, sf, "customer").select(F.concat(F.lit("r"), "c_custkey").alias("rule_id"), F.concat(F.lit("c"), "c_nationkey").alias("column"))
    return D.unused_rules(rules, [f"c{i}" for i in range(10)])
