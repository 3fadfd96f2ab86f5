"""Joins against dimensions and other tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from watchloom.catalog import dims

from watchloom.functions.lookup import map_value
from watchloom.functions.network import appliance_for, is_internal
from watchloom.operators.alias import alias_pick

#: columns a follow-up takes over from the event before it
CONTEXT_COLUMNS = (
    "correlation_id", "user_name", "hostname", "source_ip", "dest_ip", "severity",
    "is_malicious", "scenario_id", "killchain_phase",
)


def event_type_registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(dims.EVENT_TYPES.items()), "event_type string, model string")


def source_table_map(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(dims.SOURCE_TABLES.items()), "source string, table string")


def winevent_map(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(dims.WINEVENT_ROUTES), "provider string, event_id int, table string")


def winevent_id(value: Column) -> Column:
    """An event id given as a number or as an object with the number under ``#text``."""
    text = F.when(value.rlike(r"^\s*\{"), F.get_json_object(value, "$['#text']")).otherwise(value)
    return F.trim(text).try_cast("int")


def route_winevent(df: DataFrame, provider: str = "provider", event_id: str = "event_id",
                   forced: str | None = None) -> DataFrame:
    """Table of an exported Windows record by (provider, event id); unknown pairs get a name
    that says which provider and id to add."""
    if forced:
        return df.withColumn("table", F.lit(forced))
    name = F.coalesce(F.col(provider), F.lit("Unknown"))
    routes = winevent_map(df.sparkSession).select(
        F.col("provider").alias("_p"), F.col("event_id").alias("_e"), F.col("table").alias("_t"))
    # the map has a fixed number of rows (the catalog's), so it may always be broadcast
    joined = df.join(F.broadcast(routes), (name == F.col("_p")) & (F.col(event_id) == F.col("_e")), "left")
    unknown = F.concat(
        F.lit("Unclassified_"), F.regexp_replace(name, "[^A-Za-z0-9]+", "_"), F.lit("_"),
        F.coalesce(F.col(event_id).cast("string"), F.lit("None")))
    table = F.coalesce(F.col("_t"), map_value(name, dims.WINEVENT_PROVIDER_FALLBACK), unknown)
    return joined.withColumn("table", table).drop("_p", "_e", "_t")


def route_by_field(df: DataFrame, field: str | None, default: str | None = None) -> DataFrame:
    """Table from a field of the record, else the default, else ``Unclassified``."""
    own = F.nullif(F.col(field).cast("string"), F.lit("")) if field else F.lit(None).cast("string")
    return df.withColumn("table", F.coalesce(own, F.lit(default), F.lit("Unclassified")))


def persona_dimension(spark: SparkSession) -> DataFrame:
    rows = [
        (i, user, role, dept, dims.PERSONA_DOMAIN, host, f"{user}@{dims.PERSONA_DOMAIN}", admin, sensitive)
        for i, (user, role, dept, host, admin, sensitive) in enumerate(dims.PERSONAS)
    ]
    return spark.createDataFrame(
        rows,
        "persona_no int, username string, role string, department string, domain string, "
        "typical_host string, email string, is_admin boolean, is_sensitive boolean")


def enrich_persona(df: DataFrame, personas: DataFrame, user: str = "user_name",
                   key: str = "username") -> DataFrame:
    """Identity columns by user name. Catalyst broadcasts the roster when its size allows."""
    return df.join(personas, F.col(user) == personas[key], "left")


def add_topology(df: DataFrame, source_ip: str = "source_ip", dest_ip: str = "dest_ip") -> DataFrame:
    return (
        df.withColumn("src_internal", is_internal(F.col(source_ip)))
        .withColumn("dst_internal", is_internal(F.col(dest_ip)))
        .withColumn("appliance", appliance_for(F.col(source_ip), F.col(dest_ip)))
    )


def inherit_context(children: DataFrame, parents: DataFrame, correlation: str = "correlation_id",
                    depth: str = "depth", order: Iterable[str] = ("timestamp", "row_id"),
                    columns: Iterable[str] = CONTEXT_COLUMNS) -> DataFrame:
    """Children take the context of the event one step up their correlation chain.

    Each (chain, depth) is first reduced to its earliest parent, with map-side combining, so the
    join is many-to-one and a chain with very many rows cannot multiply.
    """
    taken = [c for c in columns if c != correlation]
    first = parents.groupBy(F.col(correlation).alias("_c"), F.col(depth).alias("_d")).agg(
        F.min_by(F.struct(*taken), F.struct(*order)).alias("_parent"))
    joined = children.join(
        first, (F.col(correlation) == F.col("_c")) & (F.col(depth) == F.col("_d") + 1), "left")
    found = F.col("_c").isNotNull()
    inherited = {
        c: F.when(found, F.col(f"_parent.{c}")).otherwise(
            F.col(c) if c in children.columns else F.lit(None))
        for c in taken
    }
    return joined.withColumns(inherited).drop("_c", "_d", "_parent")


def range_pick(df: DataFrame, weighted: DataFrame, key: Column, group: tuple[str, ...] = (),
               order: tuple[str, ...] = ("value",), weight: str = "weight") -> DataFrame:
    """Pick by weight: the key's fraction falls into a cell of the alias table of ``weighted``.

    A missing or zero weight counts as one. ``group`` columns choose the pool; ``order`` must tell
    the rows of a pool apart. A draw meets its pool by one equality; the table is linear in the pool.
    """
    share = F.when(F.coalesce(F.col(weight), F.lit(0)) == 0, F.lit(1.0)).otherwise(F.col(weight).cast("double"))
    return alias_pick(df, weighted, key, order, share, group)


def attachments_for(emails: DataFrame, attachments: DataFrame, how: str = "inner") -> DataFrame:
    """Mails with their attachments; ``left_semi`` keeps mails that have one."""
    return emails.join(attachments, "NetworkMessageId", how)


def missing_feeds(expected: DataFrame, actual: DataFrame, feed: str = "feed") -> DataFrame:
    """Feeds that should have rows and have none."""
    return expected.join(actual.select(feed).distinct(), feed, "left_anti")
