"""Corpus profiles: which values or shapes a field takes, without storing identities.

The stored form is uncapped: one row per (table, field, kind, item) with its count. Pools of the
most common items are cut when read, so merging stays exact in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchloom.catalog import dims
from watchloom.functions.classify import classify_field, is_identifier_value, shape_token, value_class
from watchloom.session import stored

COUNTS_SCHEMA = "table string, field string, kind string, item string, count bigint"


# --- records to (field, value) rows -------------------------------------------------------

def flatten_struct(df: DataFrame, keep: tuple[str, ...], record: str) -> DataFrame:
    """Leaves of a typed struct column as rows ``path, value, type``; a list becomes one row
    with its length. Driven by the schema, so it is one projection and one explode."""
    from pyspark.sql import types as T

    leaves: list[Column] = []
    names = {T.StringType: "str", T.BooleanType: "bool", T.DoubleType: "float", T.FloatType: "float",
             T.DecimalType: "float"}

    def walk(node: Column, dtype: T.DataType, path: str) -> None:
        for f in dtype.fields:
            here, child = f"{path}.{f.name}" if path else f.name, node[f.name]
            if isinstance(f.dataType, T.StructType):
                walk(child, f.dataType, here)
                continue
            if isinstance(f.dataType, T.ArrayType):
                here, kind = f"{here}[]", "str"
                text = F.concat(F.lit("list_len="), F.size(child).cast("string"))
                text = F.when(child.isNotNull(), text)
            else:
                kind, text = names.get(type(f.dataType), "int"), child.cast("string")
                if kind == "bool":
                    text = F.initcap(text)
            leaves.append(F.struct(F.lit(here).alias("path"), text.alias("value"), F.lit(kind).alias("type")))

    walk(F.col(record), df.schema[record].dataType, "")
    return df.select(*keep, F.inline(F.array(*leaves)))


def _nesting(record: str) -> Column:
    """An upper bound of the object levels of a variant: the deepest bracket of its schema text,
    key names aside. Taken row by row, since merging the schemas of rows that disagree on a
    field would hide what lies below it."""
    signs = F.expr(f"split(regexp_replace(schema_of_variant({record}), '`[^`]*`|[^<>]', ''), '')")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(state: Column, sign: Column) -> Column:
        now = state["now"] + F.when(sign == "<", 1).when(sign == ">", -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(state["most"], now).alias("most"))

    return F.aggregate(signs, start, step)["most"]


def flatten_record(df: DataFrame, keep: tuple[str, ...], record: str) -> DataFrame:
    """Leaves of a variant column as rows ``path, value, type``.

    Works on records whose keys are not known: one level of objects is opened per step, and the
    number of steps comes from the data (one aggregation), so nothing is cut off.
    """
    spark = df.sparkSession
    depth = df.agg(F.max(_nesting(record))).first()[0] or 0
    level = df.select(*keep, F.lit("").alias("_path"), F.col(record).alias("_v"))
    parts: list[DataFrame] = []
    for _ in range(depth):
        children = spark.tvf.variant_explode(F.col("_v").outer()).select("key", "value")
        opened = level.lateralJoin(children).select(
            *keep,
            F.concat("_path", F.when(F.col("_path") == "", "").otherwise("."), "key").alias("_path"),
            F.col("value").alias("_v"),
            F.expr("schema_of_variant(value)").alias("_s"))
        is_object = F.col("_s").startswith("OBJECT")
        leaf = opened.filter(~is_object)
        is_list = F.col("_s").startswith("ARRAY")
        length = F.size(F.expr("try_cast(_v AS array<variant>)"))
        kind = (
            F.when(is_list | (F.col("_s") == "STRING"), "str").when(F.col("_s") == "BOOLEAN", "bool")
            .when(F.col("_s") == "VOID", "NoneType").when(F.col("_s") == "BIGINT", "int").otherwise("float"))
        text = F.expr("try_cast(_v AS string)")
        text = F.when(is_list, F.concat(F.lit("list_len="), length.cast("string"))).when(
            F.col("_s") == "BOOLEAN", F.initcap(text)).otherwise(text)
        parts.append(leaf.select(
            *keep, F.when(is_list, F.concat("_path", F.lit("[]"))).otherwise(F.col("_path")).alias("path"),
            text.alias("value"), kind.alias("type")))
        level = opened.filter(is_object).select(*keep, "_path", "_v")
    if not parts:
        return df.select(*keep, F.lit("").alias("path"), F.lit("").alias("value"), F.lit("").alias("type")).limit(0)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# --- profiles -----------------------------------------------------------------------------

def field_counts(long: DataFrame, table: str = "table", field: str = "path", value: str = "value",
                 kind: str | None = "type") -> DataFrame:
    """Counts per (table, field, kind, item); nulls and empty values are not observed.

    A value that reads as an identity is reduced to its shape before anything is grouped.
    """
    seen = long.filter(F.col(value).isNotNull() & (F.col(value) != ""))
    text = F.col(value) if kind is None else F.when(F.col(kind) == "str", F.col(value))
    shaped = seen.withColumn("_shape", value_class(text))
    sorted_out = shaped.withColumn("_kind", classify_field(F.col(field), text, F.col("_shape")))
    shape = shape_token(F.col(value), F.col("_shape"))
    if kind is not None:
        shape = F.when(F.col(kind) == "str", shape).otherwise(F.col(kind))
    item = F.when(F.col("_kind") == "identifier", shape).otherwise(F.col(value))
    return sorted_out.groupBy(
        F.col(table).alias("table"), F.col(field).alias("field"), F.col("_kind").alias("kind"), item.alias("item")
    ).agg(F.count("*").alias("count"))


def profile_fields(counts: DataFrame) -> DataFrame:
    """Per (table, field): observations, distinct items and kind. One identity among the values
    makes the whole field an identifier."""
    return counts.groupBy("table", "field").agg(
        F.sum("count").alias("n"),
        F.when(F.max((F.col("kind") == "identifier").cast("int")) == 1, "identifier")
        .otherwise("freeform").alias("kind"),
        F.count("*").alias("items"),
    )


def settle_kinds(counts: DataFrame) -> DataFrame:
    """Counts with one kind per field: in a field that holds identities, free values are reduced
    to their shapes too.

    Both sides of the join read the counts, so they are written once: the values behind them are read and classified once."""
    counts = stored(counts)
    kinds = profile_fields(counts).select("table", "field", F.col("kind").alias("_kind"))
    joined = counts.join(kinds, ["table", "field"])
    item = F.when((F.col("_kind") == "identifier") & (F.col("kind") == "freeform"),
                  shape_token(F.col("item"))).otherwise(F.col("item"))
    return joined.groupBy("table", "field", F.col("_kind").alias("kind"), item.alias("item")).agg(
        F.sum("count").alias("count"))


def _pool(counts: DataFrame, kind: str, k: int) -> DataFrame:
    by_field = Window.partitionBy("table", "field")
    ranked = counts.filter(F.col("kind") == kind).withColumn(
        "rank", F.row_number().over(by_field.orderBy(F.desc("count"), F.asc("item"))))
    return ranked.filter(F.col("rank") <= k)


def value_pool(counts: DataFrame, k: int = dims.VALUE_POOL_SIZE) -> DataFrame:
    """The ``k`` most common values of each free-form field; weights share out what is kept.

    A field with one identity among its values has no values here, whatever the counts' own kinds say.
    """
    kept = _pool(settle_kinds(counts), "freeform", k)
    total = F.sum("count").over(Window.partitionBy("table", "field"))
    return kept.select("table", "field", F.col("item").alias("value"), "count", "rank",
                       F.round(F.col("count") / total, 4).alias("weight"))


def shape_pool(counts: DataFrame, k: int = dims.SHAPE_POOL_SIZE) -> DataFrame:
    """The ``k`` most common shapes of each identifier field; weights are shares of all shapes."""
    counts = settle_kinds(counts)
    own = counts.filter(F.col("kind") == "identifier")
    totals = own.groupBy("table", "field").agg(F.sum("count").alias("_total"))
    return _pool(counts, "identifier", k).join(totals, ["table", "field"]).select(
        "table", "field", F.col("item").alias("shape"), "count", "rank",
        F.round(F.col("count") / F.col("_total"), 4).alias("weight"))


def merge_profiles(*parts: DataFrame) -> DataFrame:
    """Add up stored counts; the order of the parts does not matter."""
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged.groupBy("table", "field", "kind", "item").agg(F.sum("count").alias("count"))


def source_tally(records: DataFrame, table: str = "table", source: str = "source") -> DataFrame:
    return records.groupBy(table, source).agg(F.count("*").alias("records"))


def unclassified_report(records: DataFrame, table: str = "table") -> DataFrame:
    """Records per unmapped key, most frequent first."""
    return (
        records.filter(F.col(table).startswith("Unclassified"))
        .groupBy(table).agg(F.count("*").alias("records"))
        .orderBy(F.desc("records"), table))


def classified(records: DataFrame, table: str = "table", include_unclassified: bool = False) -> DataFrame:
    return records if include_unclassified else records.filter(~F.col(table).startswith("Unclassified"))


def leak_scan(pool: DataFrame, value: str = "value") -> DataFrame:
    """Values of free-form pools that read as identities; must be empty."""
    return pool.filter(is_identifier_value(F.col(value)))
