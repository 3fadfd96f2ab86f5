"""Templates to event populations: replication, placeholder binding, sampling, follow-ups.

Every draw is a digest of (run, row, place), so a retried task draws the same values again.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchloom.catalog import dims
from watchloom.functions.hashing import (
    hash_fraction, hash_pick, hash_range, hash_range_sql, pick_from, stable_uuid, stable_uuid_sql)
from watchloom.functions.lookup import let, map_value, or_default
from watchloom.functions.network import appliance_for, url_valid
from watchloom.functions.text import single_line
from watchloom.operators.lookup import CONTEXT_COLUMNS, range_pick
from watchloom.operators.pinned import pinned
from watchloom.operators.settings import Settings

NOISE_WEIGHT_CAP = 20
#: instances of one template that are spread out as a unit
SPREAD_CHUNK = 10_000


# --- replication --------------------------------------------------------------------------

def multiply_rows(df: DataFrame, multiply: str = "multiply", instance: str = "instance",
                  spread: bool = False) -> DataFrame:
    """Repeat each row ``multiply`` times with a 1-based instance number; below one, not at all.

    Two steps keep the arrays short; ``spread`` shuffles between them, so that one template with
    a huge count is expanded by many tasks.
    """
    m = F.col(multiply).cast("bigint")
    starts = F.when(m >= 1, F.sequence(F.lit(0).cast("bigint"), F.floor((m - 1) / SPREAD_CHUNK).cast("bigint")))
    chunked = df.withColumn("_chunk", F.explode(starts))
    if spread:
        chunked = chunked.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    first = F.col("_chunk") * SPREAD_CHUNK + 1
    last = F.least(m, first + SPREAD_CHUNK - 1)
    return chunked.withColumn(instance, F.explode(F.sequence(first, last))).drop("_chunk")


# --- placeholders -------------------------------------------------------------------------

def _slot(name: str) -> str:
    return "{{" + name + "}}"


def _numbered(key: Column, patterns: Sequence[tuple[str, int]]) -> Column:
    """One of the names ``pattern % 1 .. pattern % n`` over several patterns."""
    at = hash_pick(key, sum(n for _, n in patterns))
    out, low = None, 0
    for pattern, n in patterns:
        name = F.format_string(pattern, (at - low + 1).cast("int"))
        out = F.when(at < low + n, name) if out is None else out.when(at < low + n, name)
        low += n
    return out


def _site_ip(key: Column) -> Column:
    hosts = 240
    at = hash_pick(key, hosts * len(dims.IP_SUBNETS))
    subnet = F.element_at(F.array(*map(F.lit, dims.IP_SUBNETS)), (F.floor(at / hosts) + 1).cast("int"))
    return F.concat(subnet, (F.pmod(at, F.lit(hosts)) + 10).cast("string"))


def _mac_host(key: Column) -> Column:
    names = [f"MBP-{u}" for u in dims.MAC_USERS] + [p % i for p, n in dims.MAC_MINIS for i in range(1, n + 1)]
    return pick_from(key, names)


def _email(key: Column) -> Column:
    return F.concat(pick_from(F.concat(key, F.lit("|u")), dims.USERS), F.lit("@"),
                    pick_from(F.concat(key, F.lit("|d")), dims.EMAIL_DOMAINS))


def _number(low: int, high: int) -> Callable[[Column], Column]:
    return lambda key: hash_range(key, low, high).cast("string")


def _one_of(pool: Sequence[str]) -> Callable[[Column], Column]:
    return lambda key: pick_from(key, pool)


#: placeholder -> how its value is drawn
RANDOM_VALUES: dict[str, Callable[[Column], Column]] = {
    "RANDOM_IP": _site_ip,
    "RANDOM_HOST": lambda key: _numbered(key, dims.WORKSTATIONS),
    "RANDOM_SERVER": lambda key: _numbered(key, dims.SERVERS),
    "RANDOM_LINUX_HOST": lambda key: _numbered(key, dims.LINUX_HOSTS),
    "RANDOM_MAC_HOST": _mac_host,
    "RANDOM_USER": _one_of(dims.USERS),
    "RANDOM_EMAIL": _email,
    "RANDOM_ORG": _one_of(dims.ORGANISATIONS),
    "RANDOM_UA": _one_of(dims.USER_AGENTS),
    "RANDOM_URL": _one_of(dims.URLS),
    "RANDOM_LOCATION": _one_of(dims.LOCATIONS),
    "RANDOM_CITY": _one_of(dims.CITIES),
    "RANDOM_AI_MODEL": _one_of(dims.AI_MODELS),
    "RANDOM_AI_APP": _one_of(dims.AI_APPS),
    "RANDOM_GUID": stable_uuid,
    "RANDOM_PID": _number(1000, 65535),
    "RANDOM_PORT": _number(49152, 65535),
    "RANDOM_INT": _number(100000, 999999),
    "RANDOM_COMMANDLINE": _one_of(dims.COMMAND_LINES),
    "RANDOM_FILE_PATH": _one_of(dims.FILE_PATHS),
    "RANDOM_REGISTRY_VALUE": _one_of(dims.REGISTRY_VALUES),
    "RANDOM_SCRIPT_BLOCK": _one_of(dims.SCRIPT_BLOCKS),
}
VALIDATORS = {"RANDOM_URL": url_valid}


def session_values(cycle: Column, settings: Settings) -> dict[str, Column]:
    """The five values that stay the same through one cycle."""
    key = lambda what: F.concat_ws("|", F.lit(settings.run_id), cycle.cast("string"), F.lit(what))
    octet = lambda what: hash_range(key(what), 1, 254).cast("string")
    digits = lambda what, low, high: hash_range(key(what), low, high).cast("string")
    return {
        "SESSION_ID": stable_uuid(key("session")),
        "CNC_IP": F.concat(F.lit("91.228."), octet("c"), F.lit("."), octet("d")),
        "MALICIOUS_DOMAIN": pick_from(key("domain"), dims.MALICIOUS_DOMAINS),
        "MALICIOUS_URL": pick_from(key("url"), dims.MALICIOUS_URLS),
        "DEEPFAKE_PHONE": F.concat_ws(
            "-", F.lit("+1"), digits("p1", 200, 999), digits("p2", 100, 999), digits("p3", 1000, 9999)),
    }


def persona_values(cycle: Column, settings: Settings) -> dict[str, Column]:
    """The eight values of the identity a cycle acts as."""
    key = F.concat_ws("|", F.lit(settings.run_id), cycle.cast("string"), F.lit("persona"))
    field = lambda values: pick_from(key, values)
    users, roles, depts, hosts, admins, sensitive = zip(*dims.PERSONAS)
    return {
        "PERSONA_USER": field(users),
        "PERSONA_HOST": field(hosts),
        "PERSONA_EMAIL": field([f"{u}@{dims.PERSONA_DOMAIN}" for u in users]),
        "PERSONA_ROLE": field(roles),
        "PERSONA_DEPT": field(depts),
        "PERSONA_DOMAIN": F.lit(dims.PERSONA_DOMAIN),
        "PERSONA_IS_ADMIN": field([str(a).lower() for a in admins]),
        "PERSONA_IS_SENSITIVE": field([str(s).lower() for s in sensitive]),
    }


#: a string of a JSON text, quotes included
_JSON_STRING = r'"(?:[^"\\]|\\.)*"'


def _json_inner(value: Column) -> Column:
    """A text as it stands between the quotes of a JSON string."""
    quoted = F.to_json(F.array(value))
    return F.substring(quoted, F.lit(3), F.length(quoted) - 4)


def _replace_all(text: Column, values: Mapping[str, Column], in_json: bool = False) -> Column:
    out = text
    for name, value in values.items():
        # drawn only where the text asks for it; the text itself is named once per step
        drawn = F.when(text.contains(_slot(name)), _json_inner(value) if in_json else value).otherwise("")
        out = F.replace(out, F.lit(_slot(name)), drawn)
    return F.when(text.contains("{{"), out).otherwise(text)


def _bind(df: DataFrame, raw: str, values_for: Callable[[Column], Mapping[str, Column]]) -> DataFrame:
    """Fill the placeholders of every value. In a nested value (JSON text) each string is bound on its own, with draws
    of its own, and what is put in is escaped, so the value stays JSON."""
    def one(k: Column, v: Column) -> Column:
        strings = F.regexp_extract_all(v, F.lit(_JSON_STRING), F.lit(0))
        bound = F.transform(strings, lambda s, i: _replace_all(s, values_for(F.concat(k, F.lit("#"), i.cast("string"))), True))
        between = F.split(v, _JSON_STRING, -1)
        nested = F.array_join(F.transform(between, lambda g, i: F.concat(g, F.coalesce(F.get(bound, i), F.lit("")))), "")
        is_nested = v.rlike(r"^\s*[\[{]") & v.contains("{{") & F.try_parse_json(v).isNotNull()
        return F.when(is_nested, nested).otherwise(_replace_all(v, values_for(k)))

    return df.withColumn(raw, F.transform_values(raw, one))


def bind_session(df: DataFrame, settings: Settings = Settings(), cycle: str = "cycle", raw: str = "raw") -> DataFrame:
    values = session_values(F.col(cycle), settings)
    return _bind(df, raw, lambda _: values)


def bind_persona(df: DataFrame, settings: Settings = Settings(), cycle: str = "cycle", raw: str = "raw") -> DataFrame:
    values = persona_values(F.col(cycle), settings)
    return _bind(df, raw, lambda _: values)


def choose_pools(pools: DataFrame) -> dict[str, list[tuple[str, float]]]:
    """Placeholder -> (value, upper bound of its share) of the first candidate field that has a
    pool. Reads back at most the pool size for each of the few candidate fields."""
    spark = pools.sparkSession
    wanted = spark.createDataFrame(
        [(p, i, t, f) for p, fields in dims.PROFILE_FIELDS.items() for i, (t, f) in enumerate(fields)],
        "placeholder string, priority int, table string, field string")
    kept = pools.filter(F.col("rank") <= dims.VALUE_POOL_SIZE)
    rows = kept.join(F.broadcast(wanted), ["table", "field"]).select(
        "placeholder", "priority", "value", "weight", "rank").collect()
    out = {}
    for name in {r["placeholder"] for r in rows}:
        own = [r for r in rows if r["placeholder"] == name]
        best = min(r["priority"] for r in own)
        ranked = sorted((r for r in own if r["priority"] == best), key=lambda r: r["rank"])
        weights = [r["weight"] or 1.0 for r in ranked]
        total, run, bounds = sum(weights), 0.0, []
        for row, w in zip(ranked, weights):
            run += w / total
            bounds.append((row["value"], run))
        out[name] = bounds
    return out


def corpus_or_pool(key: Column, name: str, chosen: Mapping[str, list[tuple[str, float]]]) -> Column:
    """A profile value by weight on one line, when there is one and it fits the placeholder;
    else a value of the fixed pool."""
    static = RANDOM_VALUES[name](key)
    bounds = chosen.get(name)
    if not bounds:
        return static
    table = F.from_json(
        F.lit(json.dumps([{"top": top, "value": value} for value, top in bounds])),
        "array<struct<top:double,value:string>>")
    # a share just under one still belongs to the last value
    hit = lambda u: F.coalesce(
        F.get(F.filter(table, lambda b: b["top"] > u), 0), F.element_at(table, -1))["value"]
    drawn = single_line(let(hash_fraction(F.concat(key, F.lit("|corpus"))), hit))
    if name not in VALIDATORS:
        return drawn
    return let(drawn, lambda value: F.when(VALIDATORS[name](value), value).otherwise(static))


def bind_pools(df: DataFrame, settings: Settings = Settings(), row_id: str = "row_id", raw: str = "raw",
               chosen: Mapping[str, list[tuple[str, float]]] | None = None) -> DataFrame:
    """Fill the ``RANDOM_*`` placeholders: one draw per placeholder and string, shared by all its
    occurrences in that string."""
    def values_for(field: Column) -> dict[str, Column]:
        key = lambda name: F.concat_ws(
            "|", F.lit(settings.run_id), F.col(row_id).cast("string"), field, F.lit(name))
        return {name: corpus_or_pool(key(name), name, chosen or {}) for name in RANDOM_VALUES}

    return _bind(df, raw, values_for)


# --- benign populations -------------------------------------------------------------------

def noise_pool(templates: DataFrame, multiply: str = "multiply") -> DataFrame:
    """``multiply`` as a sampling weight between 1 and the cap, instead of a count."""
    weight = F.greatest(F.lit(1), F.least(F.coalesce(F.col(multiply).cast("int"), F.lit(1)), F.lit(NOISE_WEIGHT_CAP)))
    return templates.withColumn("weight", weight).drop(multiply)


def noise_count(ratio: float, malicious: int) -> int:
    """Benign events that make them ``ratio`` of the blend."""
    return int(malicious * (ratio / (1.0 - ratio))) if 0 < ratio < 1 else 0


def noise_count_column(ratio: Column, malicious: Column) -> Column:
    return F.when((ratio > 0) & (ratio < 1), (malicious * (ratio / (1 - ratio))).cast("bigint")).otherwise(
        F.lit(0).cast("bigint"))


def weighted_sample(pool: DataFrame, n: int, seed: str, order: tuple[str, ...] = ("value",),
                    weight: str = "weight") -> DataFrame:
    """``n`` draws with replacement by weight, numbered from 0 in ``rank``."""
    draws = pool.sparkSession.range(n).withColumnRenamed("id", "rank")
    key = F.concat_ws("|", F.lit(seed), F.col("rank").cast("string"))
    return range_pick(draws, pool, key, order=order, weight=weight)


def sample_noise(pool: DataFrame, n: int, settings: Settings = Settings(),
                 order: tuple[str, ...] = ("template_id",)) -> DataFrame:
    """``n`` benign raw records drawn from weighted templates, each bound on its own."""
    drawn = weighted_sample(pool, n, f"{settings.run_id}|noise", order)
    return bind_pools(drawn.withColumn("row_id", F.col("rank")), settings)


# --- follow-ups ---------------------------------------------------------------------------

def next_state(state: Column, u: Column, matrix: Mapping[str, Mapping[str, float]]) -> Column:
    """The successor whose cumulative weight holds ``u``; null for a state without a row."""
    out = F.lit(None).cast("string")
    for name, nexts in matrix.items():
        total, run, pick = sum(nexts.values()), 0.0, None
        items = list(nexts.items())
        for target, w in items[:-1]:
            run += w / total
            pick = F.when(u < run, target) if pick is None else pick.when(u < run, target)
        last = F.lit(items[-1][0])
        out = F.when(state == name, last if pick is None else pick.otherwise(last)).otherwise(out)
    return out


def _child_value(text: str) -> str:
    """A column of a derived event as SQL text over its own row."""
    user = "coalesce(nullif(user_name, ''), 'unknown@corp.local')"
    dynamic = {
        "<parent file>": "coalesce(parent_file, 'explorer.exe')",
        "<appliance>": "appliance",
        "<web port>": "if(coalesce(dest_ip, '') = '', '80', '443')",
        "<user>": user,
        "<client ip>": "coalesce(nullif(source_ip, ''), '127.0.0.1')",
        "<resource>": f"concat('/subscriptions/', {stable_uuid_sql('concat(event_id, ' + repr('|res') + ')')}, '/resourceGroups/default')",
    }
    if text.startswith("<int "):
        return f"CAST({hash_range_sql(f'concat(event_id, {text!r})', *map(int, text[5:-1].split()))} AS STRING)"
    return dynamic.get(text) or "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _records() -> str:
    """The raw record of a derived event as SQL text: its table's columns over its context."""
    context = {c: f"CAST({c} AS STRING)" for c in CONTEXT_COLUMNS}
    arms = []
    for table, (_, values) in dims.FOLLOW_UPS.items():
        entries = {**context, **{k: _child_value(v) for k, v in values.items()},
                   "Id": "event_id", "depth": "CAST(depth AS STRING)"}
        body = ", ".join(f"'{k}', {v}" for k, v in entries.items())
        arms.append(f"WHEN '{table}' THEN map({body})")
    return f"CASE event_type {' '.join(arms)} END"


def follow_ups(df: DataFrame, settings: Settings = Settings(), max_depth: int = dims.MAX_DEPTH,
               matrix: Mapping[str, Mapping[str, float]] | None = None) -> DataFrame:
    """Derived events: each event with a matrix row yields one child, level by level.

    ``df`` holds ``event_id``, ``event_type``, ``depth``, optionally ``file_name``, and the
    context columns. Children come back with the same columns plus ``parent_id``, ``model`` and
    the ``raw`` record that normalisation turns into their table. No shuffle: a child is computed
    from its parent alone, and the levels are bounded by ``max_depth``.
    """
    matrix = matrix or dims.TRANSITIONS
    files = {t: v["file_name"] for t, (_, v) in dims.FOLLOW_UPS.items() if "file_name" in v}
    if "file_name" not in df.columns:
        df = df.withColumn("file_name", F.lit(None).cast("string"))
    level, levels = df.select("event_id", "event_type", "depth", "file_name", *CONTEXT_COLUMNS), []
    for _ in range(max_depth):
        # a given event may already sit at some depth, so the bound is tested per row
        key = F.concat_ws("|", F.lit(settings.run_id), F.col("event_id"), F.col("depth").cast("string"))
        drawn = pinned(level.filter(F.col("depth") < max_depth), hash_fraction(key).alias("_u"),
                       stable_uuid(F.concat(key, F.lit("|child"))).alias("_id"))
        stepped = pinned(drawn, next_state(F.col("event_type"), F.col("_u"), matrix).alias("_next"))
        # a sign-in needs a user and hands it on
        user = F.when(F.col("_next") == "SigninLogs", or_default(F.col("user_name"), "unknown@corp.local"))
        level = stepped.filter(F.col("_next").isNotNull()).select(
            F.col("_id").alias("event_id"), F.col("event_id").alias("parent_id"), F.col("_next").alias("event_type"),
            (F.col("depth") + 1).alias("depth"), map_value(F.col("_next"), files).alias("file_name"),
            F.col("file_name").alias("parent_file"), user.otherwise(F.col("user_name")).alias("user_name"),
            *[c for c in CONTEXT_COLUMNS if c != "user_name"])
        levels.append(level)
    out = levels[0]
    for made in levels[1:]:
        out = out.unionByName(made)
    models = {t: name for t, (name, _) in dims.FOLLOW_UPS.items()}
    placed = out.withColumn("appliance", appliance_for(F.col("source_ip"), F.col("dest_ip")))
    built = pinned(placed, F.expr(_records()).alias("raw"))
    return built.withColumn("model", map_value(F.col("event_type"), models)).drop("appliance", "parent_file")
