"""Raw records to typed tables: routing, input names, defaults, casts, quarantine.

A raw record is a row with a ``row_id`` and a ``raw`` map of input name to text; nested values
are kept as JSON text, which is how ``from_json(line, 'map<string,string>')`` delivers them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchloom.catalog import dims
from watchloom.catalog.model import ColumnSpec, EventSpec
from watchloom.catalog.tables import GENERIC, REGISTRY, spec_of
from watchloom.functions.hashing import hash_range_sql, stable_uuid, stable_uuid_sql
from watchloom.functions.lookup import let, map_value
from watchloom.functions.sqltext import lit as _lit
from watchloom.functions.text import capitalize, lowered
from watchloom.operators.pinned import pinned
from watchloom.operators.settings import Settings

#: keys that steer routing and expansion and are no columns
CONTROL_KEYS = ("source", "event_type", "multiply")


# --- records ------------------------------------------------------------------------------

def flatten_data(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Lift the object under ``data`` over the record; its keys win."""
    def lift(record: Column) -> Column:
        return let(F.from_json(record["data"], "map<string,string>"), lambda inner: F.when(
            inner.isNotNull() & record["data"].rlike(r"^\s*\{"),
            F.map_concat(
                F.map_filter(record, lambda k, _: (k != "data") & ~F.map_contains_key(inner, k)), inner),
        ).otherwise(record))

    return df.withColumn(raw, let(F.col(raw), lift))


def route_event_type(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Add the event class a record belongs to; ``generic`` when nothing claims it."""
    source = lowered(F.coalesce(F.col(raw)["source"], F.lit("")))
    declared = lowered(F.coalesce(F.col(raw)["event_type"], F.lit("")))
    resolved = map_value(source, dims.SOURCE_EVENT_TYPES, declared)
    return pinned(
        df, source.alias("route_source"), declared.alias("route_type"),
        map_value(resolved, dims.EVENT_TYPES, GENERIC.name).alias("model"))


def fallback_generic(df: DataFrame) -> DataFrame:
    """Routed records no class claims, with the source and type they carry."""
    return df.filter(F.col("model") == GENERIC.name).select(
        *[c for c in df.columns if c not in ("model", "route_source", "route_type")],
        F.col("route_source").alias("SourceSystem"), F.col("route_type").alias("Type"))


def unknown_key_report(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Input keys that no column of the record's class accepts, with counts."""
    spark = df.sparkSession
    accepted = spark.createDataFrame(
        [(s.name, key) for s in (GENERIC, *REGISTRY.values()) for key in s.accepted_names],
        "model string, key string")
    keys = df.select("model", F.explode(F.map_keys(raw)).alias("key")).filter(
        ~F.col("key").isin(*CONTROL_KEYS))
    # counting first keeps the join down to distinct (model, key) pairs
    counted = keys.groupBy("model", "key").agg(F.count("*").alias("records"))
    return counted.join(accepted, ["model", "key"], "left_anti")


# --- input names, defaults, types ---------------------------------------------------------
# A class has some forty columns, so these expressions are written as SQL text: one call per
# step instead of thousands of calls into the JVM.

def _given(attr: str) -> str:
    return f"given_{attr}"


def resolve_aliases(df: DataFrame, spec: EventSpec, raw: str = "raw") -> DataFrame:
    """Add ``chosen``, the input name that supplies each column of the class (null when none of
    its names is present), and ``given_<column>``, the value under that name.

    The first accepted name that is present wins: a null under it beats a value under a later one.
    """
    first = ", ".join(
        "CASE " + " ".join(f"WHEN map_contains_key({raw}, {_lit(n)}) THEN {_lit(n)}" for n in c.accepts) + " END" for c in spec.columns)
    return df.selectExpr("*", f"array({first}) AS chosen").selectExpr(
        "*", *[f"{raw}[chosen[{i}]] AS {_given(c.attr)}" for i, c in enumerate(spec.columns)])


def _default(col: ColumnSpec, spec: EventSpec, settings: Settings, row_id: str, now: str) -> str:
    """The default of a column as SQL text."""
    text = col.default
    key = f"concat_ws('|', {_lit(settings.run_id)}, {row_id}, '{col.attr}')"
    if spec is GENERIC and col.pinned_by_route:
        return "route_source" if col.attr == "source" else "route_type"
    if text == "<uuid>":
        return stable_uuid_sql(key)
    if text == "<tenant>":
        return stable_uuid_sql(_lit(settings.run_id))
    if text == "<vendor>":
        return _lit(settings.vendor)
    if text == "<now>":
        return f"CAST({now} AS STRING)"
    if text == "<incident>":
        return f"concat('INC', {hash_range_sql(key, 100000, 999999)})"
    if text.startswith("<int "):
        return f"CAST({hash_range_sql(key, *map(int, text[5:-1].split()))} AS STRING)"
    return _lit({"<map>": "{}", "<list>": "[]", "<empty>": ""}.get(text, text))


def apply_defaults(df: DataFrame, spec: EventSpec, settings: Settings = Settings(),
                   row_id: str = "row_id", now: str = "current_timestamp()") -> DataFrame:
    """Fill a column only when none of its input names was present."""
    filled = {
        _given(c.attr): f"if(chosen[{i}] IS NOT NULL, {_given(c.attr)}, {_default(c, spec, settings, row_id, now)})"
        for i, c in enumerate(spec.columns)
        if c.default is not None or spec is GENERIC and c.pinned_by_route
    }
    return df.selectExpr(*[f"{filled[c]} AS {c}" if c in filled else f"`{c}`" for c in df.columns])


def lax_cast(text: str, col: ColumnSpec) -> str:
    """SQL that reads a text as the declared type; null when it does not read as one."""
    if col.kind == "str":
        return text
    if col.kind in ("int", "long"):
        return f"try_cast(regexp_replace(trim({text}), '[.]0+$', '') AS {col.spark_type})"
    if col.kind == "float":
        return f"try_cast({text} AS double)"
    if col.kind == "bool":
        # the plain spelling first: lowering and trimming a text costs far more than comparing it
        return (f"CASE WHEN {text} = 'true' THEN true WHEN {text} = 'false' THEN false WHEN lower(trim({text})) IN ('true', 't', 'yes', 'y', 'on', '1') THEN true "
                f"WHEN lower(trim({text})) IN ('false', 'f', 'no', 'n', 'off', '0') THEN false END")
    if col.kind == "time":
        # numbers beyond the edge are milliseconds; only a number is cast to one, since a cast that fails raises and catches an exception
        pattern = "'^-?[0-9]+([.][0-9]+)?$'"
        number = f"try_cast(regexp_extract({text}, {pattern}, 0) AS double)"
        return (f"coalesce(CASE WHEN {text} RLIKE {pattern} THEN timestamp_seconds(if(abs({number}) > 2e10, {number} / 1000, {number})) END, "
                f"try_cast({text} AS timestamp))")
    if col.kind in ("mitre", "d3fend", "atlas"):
        whole = " AND ".join(
            f"get_json_object({text}, '$.{part.split(':')[0]}') IS NOT NULL"
            for part in col.spark_type[len("struct<"):-1].split(","))
        return f"if({whole}, from_json({text}, '{col.spark_type}'), NULL)"
    return f"from_json({text}, '{col.spark_type}')"


def _problem(c: ColumnSpec, present: str, given: str, value: str) -> str | None:
    """SQL that says why a column does not accept what it was given; null when it does."""
    tests = []
    if c.required:
        tests.append((f"NOT {present}", "missing"))
    if not c.nullable:
        tests.append((f"{present} AND {given} IS NULL", "null"))
    if c.kind != "str":
        tests.append((f"{given} IS NOT NULL AND {value} IS NULL", "cast"))
    if c.pinned:
        tests.append((f"{given} <> {_lit(c.default)}", "value"))
    branches = [f"WHEN {hit} THEN '{word}:{c.public}'" for hit, word in tests]
    return f"CASE {' '.join(branches)} END" if branches else None


def find_errors(df: DataFrame, spec: EventSpec) -> DataFrame:
    """Add ``errors``, the reasons a record cannot be accepted; takes given values before defaults are filled.

    Only the columns that can fail take part, and the reasons are computed once. All other columns stay plain
    projections, so whatever a later step does not read is not computed.
    """
    problems = [
        _problem(c, f"(chosen[{i}] IS NOT NULL)", _given(c.attr), lax_cast(_given(c.attr), c))
        for i, c in enumerate(spec.columns) if not (spec is GENERIC and c.pinned_by_route)
    ]
    return pinned(df, F.expr(f"array_compact(array({', '.join(p for p in problems if p)}))").alias("errors"))


def cast_columns(df: DataFrame, spec: EventSpec, keep: tuple[str, ...] = ()) -> DataFrame:
    """Typed columns of the class."""
    return df.selectExpr(*keep, *[f"{lax_cast(_given(c.attr), c)} AS {c.attr}" for c in spec.columns])


def cast_and_validate(df: DataFrame, spec: EventSpec, keep: tuple[str, ...] = ("row_id",), raw: str = "raw",
                      fill: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, quarantined records with the reasons); ``fill`` puts in the defaults of what is accepted."""
    checked = find_errors(df, spec)
    good = cast_columns(fill(checked.filter(F.size("errors") == 0)), spec, keep)
    bad = checked.filter(F.size("errors") > 0).select(
        *keep, F.lit(spec.name).alias("model"), raw, F.col("errors").alias("reasons"))
    return good, bad


def normalize(df: DataFrame, name: str, settings: Settings = Settings(), now: str = "current_timestamp()",
              keep: tuple[str, ...] = ("row_id",)) -> tuple[DataFrame, DataFrame]:
    """Routed records of one class as a typed table, and those that do not fit it."""
    spec = spec_of(name)
    own = resolve_aliases(df.filter(F.col("model") == name), spec)
    return cast_and_validate(own, spec, keep, fill=lambda good: apply_defaults(good, spec, settings, now=now))


# --- tables -------------------------------------------------------------------------------

def table_name(event_type: Column, source: Column) -> Column:
    """A known type names its table; else the source decides; else an unmistakable fallback."""
    low = F.lower(source)
    known = map_value(event_type, {name: name for name in dims.KNOWN_TABLES})
    return F.coalesce(known, map_value(low, dims.SOURCE_TABLES), F.concat(F.lit("Unmapped_"), capitalize(low)))


def assign_table(df: DataFrame, event_type: str = "event_type", source: str = "source") -> DataFrame:
    return df.withColumn("table", table_name(F.col(event_type), F.col(source)))


def drop_label_columns(df: DataFrame) -> DataFrame:
    return df.drop(*dims.LABEL_COLUMNS)


def derive_location(df: DataFrame, location: str = "location", city: str = "city") -> DataFrame:
    """The nested place column from the two flat authoring inputs."""
    place = F.struct(F.col(location).alias("countryOrRegion"), F.col(city).alias("city"))
    return df.withColumn("LocationDetails", place).drop(location, city)


def derive_mail_auth(df: DataFrame, spf: str = "spf_pass", dkim: str = "dkim_pass",
                     dmarc: str = "dmarc_pass") -> DataFrame:
    """The verdict text from the three booleans."""
    verdict = lambda c: F.when(F.col(c), "pass").otherwise("fail")
    text = F.concat(F.lit("SPF: "), verdict(spf), F.lit("; DKIM: "), verdict(dkim),
                    F.lit("; DMARC: "), verdict(dmarc))
    return df.withColumn("AuthenticationDetails", text).drop(spf, dkim, dmarc)


def rename_public(df: DataFrame, spec: EventSpec) -> DataFrame:
    """Attribute names to public names. Where a class redeclares a public name, its own column
    takes the place of the inherited one; authoring inputs become their public form."""
    place_of: dict[str, str] = {}
    for c in spec.columns:
        if c.attr in df.columns and not c.hidden:
            place_of[c.public] = c.attr
    derived = [c.attr for c in spec.columns if c.hidden and c.attr in df.columns]
    declared = set(spec.by_attr)
    out = df.select(
        *[c for c in df.columns if c not in declared],
        *[F.col(attr).alias(public) for public, attr in place_of.items()],
        *[F.col(a) for a in derived])
    if {"location", "city"} <= set(derived):
        out = derive_location(out)
    if "spf_pass" in derived:
        out = derive_mail_auth(out)
    return out.drop(*derived)


def public_table(df: DataFrame, name: str) -> DataFrame:
    """An accepted table as it is exported: public names, no labels."""
    return rename_public(drop_label_columns(df), spec_of(name))


def stable_ids(df: DataFrame, run_id: str, key: str = "row_id") -> DataFrame:
    """Unique ``Id``, unique ``CorrelationId`` unless the row inherits one, one tenant per run."""
    ident = lambda salt: stable_uuid(F.concat_ws("|", F.lit(run_id), F.col(key).cast("string"), F.lit(salt)))
    inherited = F.col("CorrelationId") if "CorrelationId" in df.columns else F.lit(None).cast("string")
    return (
        df.withColumn("Id", ident("id"))
        .withColumn("CorrelationId", F.coalesce(inherited, ident("correlation")))
        .withColumn("TenantId", stable_uuid(F.lit(run_id)))
    )


def materialise_routed(df: DataFrame, path: str) -> DataFrame:
    """Write routed records split by class, so each class reads only its own files later.

    One pass over the input whatever the number of classes; use it before a run that
    normalises many of them."""
    df.hint("rebalance", "model").write.mode("overwrite").partitionBy("model").parquet(path)
    return df.sparkSession.read.parquet(path)


# --- label predicates ---------------------------------------------------------------------

def filter_malicious(df: DataFrame, flag: bool = True) -> DataFrame:
    return df.filter(F.col("is_malicious") == flag)


def by_phase(df: DataFrame, *phases: str) -> DataFrame:
    return df.filter(F.col("killchain_phase").isin(*phases))


def by_technique(df: DataFrame, *techniques: str) -> DataFrame:
    return df.filter(F.col("mitre.technique_id").isin(*techniques))


def by_table(df: DataFrame, *tables: str) -> DataFrame:
    return df.filter(F.col("table").isin(*tables))


def by_severity(df: DataFrame, *severities: str) -> DataFrame:
    return df.filter(F.lower("severity").isin(*[s.lower() for s in severities]))
