"""Replication, placeholder binding, sampling, blending, follow-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchloom.catalog import dims
from watchloom.functions.hashing import hash_pick
from watchloom.operators import coverage as C
from watchloom.operators import expand as G
from watchloom.operators import normalize as N
from watchloom.operators import profiling as P
from watchloom.operators import sequence as S
from watchloom.operators.ordered import serial_rank
from watchloom.operators.settings import Settings
from watchloom.plans.inputs import EV, events, load
from watchloom.plans.registry import query, sql_alias, sql_drawn, sql_fraction, sql_hash, sql_uuid
from watchloom.session import dealt

RUN = Settings(run_id="run-1")


def _list(pool) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in pool) + "]"


def _pick(pool, key: str) -> str:
    return f"{_list(pool)}[{sql_hash(key)} % {len(pool)} + 1]"


@query("""
SELECT o_orderkey, CAST(i AS BIGINT) AS instance FROM orders, range(1, 4) t(i) WHERE i <= o_orderkey % 4""")
def multiplied_rows(spark, sf):
    rows = load(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 4).cast("int").alias("multiply"))
    return G.multiply_rows(rows, spread=True).select("o_orderkey", "instance")


def _templates(spark, sf):
    raw = F.create_map(
        F.lit("ip"), F.lit("{{RANDOM_IP}} to {{RANDOM_IP}}"), F.lit("pid"), F.lit("{{RANDOM_PID}}"),
        F.lit("port"), F.lit("{{RANDOM_PORT}}"), F.lit("city"), F.lit("in {{RANDOM_CITY}}, {{RANDOM_LOCATION}}"),
        F.lit("mail"), F.lit("<{{RANDOM_EMAIL}}>"), F.lit("id"), F.lit("{{RANDOM_GUID}}"),
        F.lit("host"), F.lit("{{RANDOM_SERVER}}"), F.lit("plain"), F.concat(F.lit("v"), F.col("user_id")))
    return dealt(load(spark, sf, "events")).select(F.col("event_id").alias("row_id"), raw.alias("raw"))


def _key(field: str, name: str) -> str:
    return f"'run-1|' || event_id || '|{field}|{name}'"


def _sql_ip(key: str) -> str:
    at = f"({sql_hash(key)} % 1440)"
    return f"{_list(dims.IP_SUBNETS)}[{at} // 240 + 1] || ({at} % 240 + 10)"


@query(f"""
SELECT event_id AS row_id, {_sql_ip(_key('ip', 'RANDOM_IP'))} || ' to ' || {_sql_ip(_key('ip', 'RANDOM_IP'))} AS ip,
  CAST(1000 + {sql_hash(_key('pid', 'RANDOM_PID'))} % 64536 AS VARCHAR) AS pid,
  CAST(49152 + {sql_hash(_key('port', 'RANDOM_PORT'))} % 16384 AS VARCHAR) AS port,
  'in ' || {_pick(dims.CITIES, _key('city', 'RANDOM_CITY'))} || ', ' || {_pick(dims.LOCATIONS, _key('city', 'RANDOM_LOCATION'))} AS city,
  '<' || {_pick(dims.USERS, _key('mail', 'RANDOM_EMAIL|u'))} || '@' || {_pick(dims.EMAIL_DOMAINS, _key('mail', 'RANDOM_EMAIL|d'))} || '>' AS mail,
  {sql_uuid(_key('id', 'RANDOM_GUID'))} AS id,
  'SRV-' || lpad(CAST({sql_hash(_key('host', 'RANDOM_SERVER'))} % 29 + 1 AS VARCHAR), 3, '0') AS host, 'v' || user_id AS plain FROM events""")
def bound_placeholders(spark, sf):
    bound = G.bind_pools(_templates(spark, sf), RUN)
    return bound.select("row_id", *[F.col("raw")[f].alias(f) for f in ("ip", "pid", "port", "city", "mail", "id", "host", "plain")])


_USERS = [p[0] for p in dims.PERSONAS]
_PKEY = "'run-1|' || (event_id % 50) || '|persona'"


@query(f"""
SELECT event_id AS row_id, {_pick(_USERS, _PKEY)} || ' on ' || {_pick([p[3] for p in dims.PERSONAS], _PKEY)} AS who,
  {_pick([str(p[4]).lower() for p in dims.PERSONAS], _PKEY)} AS admin,
  {sql_uuid("'run-1|' || (event_id % 50) || '|session'")} AS session,
  '91.228.' || ({sql_hash("'run-1|' || (event_id % 50) || '|c'")} % 254 + 1) || '.' || ({sql_hash("'run-1|' || (event_id % 50) || '|d'")} % 254 + 1) AS cnc FROM events""")
def bound_identities(spark, sf):
    """Persona and session values: the same for all records of a cycle."""
    raw = F.create_map(
        F.lit("who"), F.lit("{{PERSONA_USER}} on {{PERSONA_HOST}}"), F.lit("admin"), F.lit("{{PERSONA_IS_ADMIN}}"),
        F.lit("session"), F.lit("{{SESSION_ID}}"), F.lit("cnc"), F.lit("{{CNC_IP}}"))
    rows = load(spark, sf, "events").select(
        F.col("event_id").alias("row_id"), (F.col("event_id") % 50).alias("cycle"), raw.alias("raw"))
    bound = G.bind_session(G.bind_persona(rows, RUN), RUN)
    return bound.select("row_id", *[F.col("raw")[f].alias(f) for f in ("who", "admin", "session", "cnc")])


_URL_KEY = "'run-1|' || event_id || '|url|RANDOM_URL'"


@query(f"""
WITH p AS (SELECT url AS value, count(*) AS n FROM pages WHERE url <> '' GROUP BY 1),
r AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY n DESC, value) AS rank FROM p) WHERE rank <= 200),
w AS (SELECT value, rank, CASE WHEN round(n::DOUBLE / sum(n) OVER (), 4) = 0 THEN 1.0::DOUBLE ELSE round(n::DOUBLE / sum(n) OVER (), 4) END AS w FROM r),
b AS (SELECT value, rank, sum(w / total) OVER (ORDER BY rank) AS top FROM w, (SELECT sum(w) AS total FROM w)),
c AS (SELECT value, rank, coalesce(lag(top) OVER (ORDER BY rank), 0.0::DOUBLE) AS low FROM b),
d AS (SELECT event_id, {sql_fraction(_URL_KEY + " || '|corpus'")} AS u, {_pick(dims.URLS, _URL_KEY)} AS fixed FROM events)
SELECT event_id AS row_id, CASE WHEN starts_with(value, 'http://') OR starts_with(value, 'https://') THEN trim(regexp_replace(value, '\\s+', ' ', 'g')) ELSE fixed END AS url
FROM d ASOF JOIN c ON d.u >= c.low""")
def corpus_backed_urls(spark, sf):
    """Page addresses as a profile: draws come from the pool of the first candidate field."""
    long = load(spark, sf, "pages").select(
        F.lit("W3CIISLog").alias("table"), F.lit("csUriStem").alias("path"), F.col("url").alias("value"))
    chosen = G.choose_pools(P.value_pool(P.field_counts(long, kind=None)))
    rows = load(spark, sf, "events").select(
        F.col("event_id").alias("row_id"), F.create_map(F.lit("url"), F.lit("{{RANDOM_URL}}")).alias("raw"))
    bound = G.bind_pools(rows, RUN, chosen=chosen)
    return bound.select("row_id", F.col("raw")["url"].alias("url"))


_NOISE_KEY = "'run-1|noise|' || i"


@query(f"""
WITH t AS (SELECT p_partkey AS template_id, greatest(1, least(p_size, 20)) AS weight FROM part),
{sql_alias("t", "template_id", "weight")},
d AS (SELECT i FROM range((SELECT count(*) FROM events)) t(i))
SELECT i AS rank, id AS template_id, CAST(1000 + {sql_hash("'run-1|' || i || '|pid|RANDOM_PID'")} % 64536 AS VARCHAR) AS pid
FROM ({sql_drawn("d", "i", sql_fraction(_NOISE_KEY))})""")
def sampled_noise(spark, sf):
    """Parts play weighted templates; as many draws as there are events."""
    templates = load(spark, sf, "part").select(
        F.col("p_partkey").alias("template_id"), F.col("p_size").alias("multiply"),
        F.create_map(F.lit("pid"), F.lit("{{RANDOM_PID}}"), F.lit("name"), F.col("p_name")).alias("raw"))
    n = load(spark, sf, "events").count()
    drawn = G.sample_noise(G.noise_pool(templates), n, RUN)
    return drawn.select("rank", "template_id", F.col("raw")["pid"].alias("pid"))


@query("""SELECT p_partkey AS template_id, CAST(greatest(1, least(p_size, 20)) AS INT) AS weight FROM part""")
def noise_weights(spark, sf):
    rows = load(spark, sf, "part").select(F.col("p_partkey").alias("template_id"), F.col("p_size").alias("multiply"))
    return G.noise_pool(rows)


@query("""
SELECT p_partkey, CAST(CASE WHEN r > 0 AND r < 1 THEN trunc(p_size * (r / (1 - r))) ELSE 0 END AS BIGINT) AS n
FROM (SELECT p_partkey, p_size, (p_partkey % 11) / 10.0::DOUBLE AS r FROM part)""")
def noise_counts(spark, sf):
    ratio = (F.col("p_partkey") % 11) / F.lit(10.0)
    return load(spark, sf, "part").select("p_partkey", G.noise_count_column(ratio, F.col("p_size")).alias("n"))


@query(f"""
WITH pool AS (SELECT s_nationkey AS value, count(*) AS weight FROM supplier GROUP BY 1),
{sql_alias("pool", "value", "weight")},
d AS (SELECT i FROM range((SELECT count(*) FROM orders)) t(i))
SELECT id AS value, count(*) AS n FROM ({sql_drawn("d", "i", sql_fraction("'seed|' || i"))}) GROUP BY 1""")
def weighted_sample(spark, sf):
    pool = load(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("value")).agg(F.count("*").alias("weight"))
    n = load(spark, sf, "orders").count()
    return G.weighted_sample(pool, n, "seed").groupBy("value").agg(F.count("*").alias("n"))


@query("""
WITH s AS (SELECT event_id, CAST(event_id % 23 AS INT) AS stage_idx, event_type = 'error' AS bad FROM events WHERE event_type IN ('error', 'view')),
m AS (SELECT sum(n) AS size FROM (SELECT stage_idx, count(*) AS n, max(CAST(bad AS INT)) AS hit FROM s GROUP BY 1) WHERE hit = 1),
q AS (SELECT CAST(trunc(size * (0.3::DOUBLE / (1 - 0.3::DOUBLE))) AS BIGINT) AS n FROM m),
n AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS r FROM events WHERE event_type NOT IN ('error', 'view')),
k AS (SELECT event_id, r FROM n WHERE r < (SELECT n FROM q)),
z AS (SELECT event_id, CAST(((r + 1) * 23 - 1) // (SELECT count(*) FROM k) AS INT) AS stage_idx, true AS is_noise FROM k
  UNION ALL SELECT event_id, stage_idx, false FROM s)
SELECT stage_idx, is_noise, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM z GROUP BY 1, 2""")
def blended_population(spark, sf):
    """Benign events to a share of three tenths, spread over the stages of the attack."""
    rows = load(spark, sf, "events").select("event_id", "event_type")
    attack = rows.filter("event_type IN ('error', 'view')").select(
        "event_id", (F.col("event_id") % 23).cast("int").alias("stage_idx"), (F.col("event_type") == "error").alias("is_malicious"))
    size = C.malicious_stage_size(attack, ["stage_idx"]).first()["events"]
    wanted = G.noise_count(0.3, size)
    noise = serial_rank(rows.filter("event_type NOT IN ('error', 'view')"), "event_id", "rank").filter(F.col("rank") < wanted)
    total = noise.count()
    out = S.interleave_batches(attack.drop("is_malicious"), noise.select("event_id", "rank"), 23, total)
    return out.groupBy("stage_idx", "is_noise").agg(
        F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


# --- follow-ups ---------------------------------------------------------------------------

def _sql_next(state: str, u: str) -> str:
    arms = []
    for name, nexts in dims.TRANSITIONS.items():
        total, run, inner = sum(nexts.values()), 0.0, ""
        items = list(nexts.items())
        for target, w in items[:-1]:
            run += w / total
            inner += f" WHEN {u} < {run!r}::DOUBLE THEN '{target}'"
        arms.append(f"WHEN {state} = '{name}' THEN " + (f"CASE{inner} ELSE '{items[-1][0]}' END" if inner else f"'{items[-1][0]}'"))
    return "CASE " + " ".join(arms) + " END"


def _sql_level(parent: str, depth: int) -> str:
    key = f"'run-1|' || event_id || '|{depth}'"
    return f"""SELECT {sql_uuid(key + " || '|child'")} AS event_id, event_id AS parent_id, {_sql_next('event_type', sql_fraction(key))} AS event_type,
    {depth + 1} AS depth, CASE WHEN {_sql_next('event_type', sql_fraction(key))} = 'SigninLogs' THEN coalesce(user_name, 'unknown@corp.local') ELSE user_name END AS user_name FROM {parent}"""


_SQL_FOLLOW = f"""
WITH {EV}, z AS (SELECT 'e' || event_id AS event_id, ['SigninLogs', 'DeviceProcessEvents', 'CommonSecurityLog', 'AzureActivity', 'DnsEvents'][k % 5 + 1] AS event_type,
  CASE WHEN k % 4 > 0 THEN 'u' || user_id END AS user_name FROM ev),
a AS (SELECT * FROM ({_sql_level('z', 0)}) WHERE event_type IS NOT NULL),
b AS (SELECT * FROM ({_sql_level('a', 1)}) WHERE event_type IS NOT NULL),
c AS (SELECT * FROM ({_sql_level('b', 2)}) WHERE event_type IS NOT NULL),
f AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c)"""


def follow(spark, sf):
    ev = dealt(events(spark, sf))
    state = F.element_at(F.array(*map(F.lit, ("SigninLogs", "DeviceProcessEvents", "CommonSecurityLog", "AzureActivity", "DnsEvents"))), F.expr("k % 5 + 1"))
    return G.follow_ups(ev.select(
        F.concat(F.lit("e"), "event_id").alias("event_id"), state.alias("event_type"), F.lit(0).alias("depth"),
        F.concat(F.lit("c"), "user_id").alias("correlation_id"), F.when(F.col("k") % 4 > 0, F.concat(F.lit("u"), "user_id")).alias("user_name"),
        F.concat(F.lit("WS-"), "k").alias("hostname"), F.concat(F.lit("10.0.0."), "k").alias("source_ip"),
        F.when(F.col("k") % 3 > 0, F.concat(F.when(F.col("k") % 3 == 1, "203.0.113.").otherwise("10.1.1."), F.col("k"))).alias("dest_ip"),
        F.lit("high").alias("severity"), (F.col("k") % 2 == 0).alias("is_malicious"), F.lit("s1").alias("scenario_id"),
        F.lit("execution").alias("killchain_phase")), RUN)


@query(_SQL_FOLLOW + "SELECT event_id, parent_id, event_type, depth, user_name FROM f")
def follow_ups(spark, sf):
    return follow(spark, sf).select("event_id", "parent_id", "event_type", "depth", "user_name")


@query(f"""
WITH {EV}, z AS (SELECT event_id AS id, 'run-1|e' || event_id || '|0' AS key, k FROM ev WHERE k % 5 = 1),
n AS (SELECT *, {_sql_next("'DeviceProcessEvents'", sql_fraction('key'))} AS nxt FROM z)
SELECT 'e' || id AS parent_id, CASE WHEN k % 3 = 1 THEN 'cisco' ELSE 'fortigate' END AS vendor,
  CASE WHEN k % 3 = 0 THEN 80 ELSE 443 END AS dest_port, 'allowed' AS action, 'TCP' AS protocol, 'c' AS first,
  k % 2 = 0 AS is_malicious, 1 AS depth FROM n WHERE nxt = 'CommonSecurityLog'""")
def firewall_follow_ups(spark, sf):
    """Derived flows as normalised rows: appliance by topology, port by destination."""
    flows = follow(spark, sf).filter("depth = 1").select(F.col("event_id").alias("row_id"), "parent_id", "model", "raw")
    parents = events(spark, sf).filter("k % 5 = 1").select(F.concat(F.lit("e"), "event_id").alias("parent_id"))
    good, _ = N.normalize(flows.join(parents, "parent_id", "left_semi"), "firewall", RUN, keep=("row_id", "parent_id"))
    return good.select("parent_id", "vendor", "dest_port", "action", "protocol",
                       F.substring("correlation_id", 1, 1).alias("first"), "is_malicious", "depth")


@query(f"""
WITH {EV} SELECT event_id, {sql_hash("'key' || event_id")} % 7 AS pick FROM ev""")
def hash_picks(spark, sf):
    return load(spark, sf, "events").select(
        "event_id", hash_pick(F.concat(F.lit("key"), F.col("event_id").cast("string")), 7).alias("pick"))
