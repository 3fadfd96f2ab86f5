"""Joins, lookups and picks."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchloom.catalog import dims
from watchloom.operators import lookup as L
from watchloom.operators import normalize as N
from watchloom.plans.inputs import EV, events, load, raw_events, sql_table_of, typed_events
from watchloom.plans.registry import query, sql_alias, sql_case, sql_drawn, sql_fraction

_PROVIDERS = ("Microsoft-Windows-Sysmon", "Microsoft-Windows-Bits-Client",
              "Microsoft-Windows-RemoteDesktopServices-RdpCoreTS", "Odd  Provider!", None)
_PAIRS = ", ".join(
    f"('{p}', {e}, '{t}')" for p, e, t in dims.WINEVENT_ROUTES)


def _provider():
    return F.element_at(F.array(*map(F.lit, _PROVIDERS)), F.expr(f"user_id % {len(_PROVIDERS)} + 1").cast("int"))


_SQL_PROVIDER = "[" + ", ".join("NULL" if p is None else f"'{p}'" for p in _PROVIDERS) + f"][user_id % {len(_PROVIDERS)} + 1]"
_SQL_WINEVENT = f"""
WITH {EV}, m(p, e, t) AS (VALUES {_PAIRS}),
x AS (SELECT event_id, coalesce({_SQL_PROVIDER}, 'Unknown') AS provider, CASE WHEN k < 95 THEN k % 25 END AS eid FROM ev),
r AS (SELECT event_id, coalesce(t, CASE WHEN provider LIKE '%RdpCoreTS' THEN 'IdentityLogonEvents' END,
    'Unclassified_' || regexp_replace(provider, '[^A-Za-z0-9]+', '_', 'g') || '_' || coalesce(CAST(eid AS VARCHAR), 'None')) AS "table"
  FROM x LEFT JOIN m ON provider = p AND eid = e)"""


def winevents(spark, sf):
    rows = events(spark, sf).select(
        "event_id", _provider().alias("provider"), F.expr("CASE WHEN k < 95 THEN k % 25 END").alias("eid"))
    return L.route_winevent(rows, "provider", "eid")


@query(_SQL_WINEVENT + 'SELECT event_id, "table" FROM r')
def routed_winevents(spark, sf):
    return winevents(spark, sf).select("event_id", "table")


@query(_SQL_WINEVENT + """SELECT "table", count(*) AS records FROM r WHERE "table" LIKE 'Unclassified%' GROUP BY 1""")
def unclassified_winevents(spark, sf):
    from watchloom.operators.profiling import unclassified_report
    return unclassified_report(winevents(spark, sf))


@query(f"""WITH {EV} SELECT event_id, CASE WHEN k % 5 = 0 THEN 'Unclassified' ELSE event_type END AS "table" FROM ev""")
def tables_by_field(spark, sf):
    rows = events(spark, sf).withColumn("kind", F.expr("CASE WHEN k % 5 = 0 THEN '' ELSE event_type END"))
    return L.route_by_field(rows, "kind").select("event_id", "table")


@query(f"""
WITH {EV} SELECT event_type, {sql_case('event_type', {'click': 'process', 'error': 'firewall'}, 'NULL')} AS model,
  {sql_table_of()} AS "table", count(*) AS n FROM ev GROUP BY 1, 2, 3""")
def dimension_lookups(spark, sf):
    """The event type and source registries as joined dimensions."""
    rows = typed_events(spark, sf).select(
        F.col("event_type").alias("kind"),
        F.expr("CASE event_type WHEN 'click' THEN 'process_creation' WHEN 'error' THEN 'network_connection' ELSE 'x' END").alias("event_type"),
        "table")
    registry = L.event_type_registry(spark)
    return rows.join(F.broadcast(registry), "event_type", "left").groupBy(
        F.col("kind").alias("event_type"), "model", "table").agg(F.count("*").alias("n"))


@query("""
SELECT e.event_id, c.c_name AS name, n.n_name AS place, c.c_mktsegment AS dept
FROM events e LEFT JOIN customer c ON e.user_id = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey""")
def persona_enrichment(spark, sf):
    """Customers with their nation play the identity roster."""
    nation = load(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("place"))
    roster = load(spark, sf, "customer").join(nation, "c_nationkey", "left").select(
        "c_custkey", F.col("c_name").alias("name"), "place", F.col("c_mktsegment").alias("dept"))
    rows = load(spark, sf, "events").select("event_id", "user_id")
    return L.enrich_persona(rows, roster, "user_id", "c_custkey").select("event_id", "name", "place", "dept")


@query("""
SELECT c.conv_id, c.turn, coalesce(p.role, c.role) AS role, length(coalesce(p.text, c.text)) AS n
FROM conversations c LEFT JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1""")
def inherited_context(spark, sf):
    """Conversations play correlation chains, turns their depth."""
    rows = load(spark, sf, "conversations")
    out = L.inherit_context(rows, rows, "conv_id", "turn", ("turn",), ("role", "text"))
    return out.select("conv_id", "turn", "role", F.length("text").cast("bigint").alias("n"))


@query(f"""
WITH pool AS (SELECT p_brand AS value, count(*) AS weight FROM part GROUP BY 1),
{sql_alias("pool", "value", "weight")}
SELECT event_id, id AS value FROM ({sql_drawn("events", "event_id", sql_fraction("'pick|' || event_id"))})""")
def weighted_picks(spark, sf):
    pool = load(spark, sf, "part").groupBy(F.col("p_brand").alias("value")).agg(F.count("*").alias("weight"))
    rows = load(spark, sf, "events").select("event_id")
    key = F.concat_ws("|", F.lit("pick"), F.col("event_id").cast("string"))
    return L.range_pick(rows, pool, key).select("event_id", "value")


@query("""
SELECT o_orderpriority AS priority, count(*) AS mails FROM orders o
WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R') GROUP BY 1""")
def mails_with_attachments(spark, sf):
    """Orders play mails and returned lines their attachments."""
    mails = load(spark, sf, "orders").select(F.col("o_orderkey").alias("NetworkMessageId"), "o_orderpriority")
    files = load(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("NetworkMessageId"))
    return L.attachments_for(mails, files, "left_semi").groupBy(F.col("o_orderpriority").alias("priority")).agg(
        F.count("*").alias("mails"))


@query("""
SELECT n_name AS feed FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)""")
def missing_feeds(spark, sf):
    expected = load(spark, sf, "nation").select(F.col("n_name").alias("feed"), "n_nationkey")
    seen = load(spark, sf, "supplier").filter("s_acctbal > 5000").join(
        expected, F.col("s_nationkey") == F.col("n_nationkey")).select("feed")
    return L.missing_feeds(expected.select("feed"), seen)


@query(f"""
WITH {EV} SELECT event_id AS row_id, {sql_table_of()} AS "table" FROM ev
WHERE NOT (event_type = 'signup' AND k % 9 < 2)
UNION ALL SELECT event_id, CASE WHEN k % 9 = 0 THEN 'Unmapped_Odd_source' ELSE 'SecurityAlert' END
FROM ev WHERE event_type = 'signup' AND k % 9 < 2""")
def tables_of_records(spark, sf):
    """Routing and table naming of raw records together."""
    from watchloom.catalog.tables import REGISTRY
    from watchloom.functions.lookup import map_value
    routed = N.route_event_type(raw_events(spark, sf))
    types = {name: spec.type_name for name, spec in REGISTRY.items()}
    kind = map_value(F.col("model"), types, F.col("route_type"))
    return routed.select("row_id", N.table_name(kind, F.col("route_source")).alias("table"))
