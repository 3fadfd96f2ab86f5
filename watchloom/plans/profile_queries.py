"""Corpus profiles of the given texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchloom.functions.classify import value_class
from watchloom.operators import profiling as P
from watchloom.plans.function_queries import SQL_CLASS, SQL_SHAPE, SQL_WORDS, words
from watchloom.plans.inputs import load
from watchloom.plans.registry import query

#: words as values of two fields in a table per language: plain ones of ``word``, those with a telling shape of ``note``; whole texts are profiled
_COUNTS = f"""
WITH w AS (SELECT lang AS "table", t, {SQL_CLASS} AS c FROM {SQL_WORDS} WHERE t <> ''),
counts AS (SELECT "table", CASE WHEN c IS NULL THEN 'word' ELSE 'note' END AS field,
    CASE WHEN c IS NOT NULL AND (c <> 'fqdn' OR len(string_split(t, '.')) <= 4) THEN 'identifier' ELSE 'freeform' END AS kind,
    CASE WHEN c IS NOT NULL AND (c <> 'fqdn' OR len(string_split(t, '.')) <= 4) THEN {SQL_SHAPE} ELSE t END AS item,
    count(*) AS "count" FROM w GROUP BY 1, 2, 3, 4)"""

#: the same with one kind per field
_SETTLED = _COUNTS + """, k AS (SELECT "table", field, max(CASE WHEN kind = 'identifier' THEN 1 ELSE 0 END) AS hit FROM counts GROUP BY 1, 2),
j AS (SELECT counts."table" AS tb, field, CASE WHEN hit = 1 THEN 'identifier' ELSE 'freeform' END AS kind, kind AS old, item AS t, "count" FROM counts JOIN k USING ("table", field)),
z AS (SELECT tb AS "table", field, kind, CASE WHEN kind = 'identifier' AND old = 'freeform' THEN
   (CASE WHEN regexp_matches(t, '^[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+$') THEN 'fqdn:labels=' || len(string_split(t, '.'))
    ELSE 'str:len_bucket=' || CASE WHEN length(t) <= 8 THEN '<=8' WHEN length(t) <= 16 THEN '<=16' WHEN length(t) <= 32 THEN '<=32'
      WHEN length(t) <= 64 THEN '<=64' WHEN length(t) <= 128 THEN '<=128' WHEN length(t) <= 256 THEN '<=256' ELSE '>256' END END)
   ELSE t END AS item, "count" FROM j),
settled AS (SELECT "table", field, kind, item, CAST(sum("count") AS BIGINT) AS "count" FROM z GROUP BY 1, 2, 3, 4)"""


def noted(spark, sf):
    """``table, path, value`` and the document of every word."""
    field = F.when(value_class(F.col("t")).isNull(), "word").otherwise("note")
    return words(spark, sf).select(F.col("lang").alias("table"), field.alias("path"), F.col("t").alias("value"), "doc_id")


def counts(spark, sf):
    return P.field_counts(noted(spark, sf).drop("doc_id"), kind=None)


@query(_COUNTS + """
SELECT "table", kind, count(*) AS items, CAST(sum("count") AS BIGINT) AS n, max("count") AS top FROM counts GROUP BY 1, 2""")
def field_value_counts(spark, sf):
    return counts(spark, sf).groupBy("table", "kind").agg(
        F.count("*").alias("items"), F.sum("count").alias("n"), F.max("count").alias("top"))


@query(_COUNTS + """
SELECT "table", field, CAST(sum("count") AS BIGINT) AS n,
  CASE WHEN max(CASE WHEN kind = 'identifier' THEN 1 ELSE 0 END) = 1 THEN 'identifier' ELSE 'freeform' END AS kind,
  count(*) AS items FROM counts GROUP BY 1, 2""")
def profiled_fields(spark, sf):
    return P.profile_fields(counts(spark, sf))


@query(_SETTLED + """, r AS (
SELECT "table", field, item AS value, "count", CAST(row_number() OVER (PARTITION BY "table", field ORDER BY "count" DESC, encode(item)) AS INT) AS rank
FROM settled WHERE kind = 'freeform')
SELECT "table", field, value, "count", rank,
  round("count" / sum("count") OVER (PARTITION BY "table", field), 4) AS weight FROM r WHERE rank <= 200""")
def value_pools(spark, sf):
    return P.value_pool(counts(spark, sf))


@query(_SETTLED + """, s AS (SELECT *, sum("count") OVER (PARTITION BY "table", field) AS total FROM settled WHERE kind = 'identifier'),
r AS (SELECT "table", field, item AS shape, "count", total,
  CAST(row_number() OVER (PARTITION BY "table", field ORDER BY "count" DESC, encode(item)) AS INT) AS rank FROM s)
SELECT "table", field, shape, "count", rank, round("count" / total, 4) AS weight FROM r WHERE rank <= 20""")
def shape_pools(spark, sf):
    return P.shape_pool(counts(spark, sf))


@query(_COUNTS + """
SELECT "table", kind, count(*) AS items, CAST(sum("count") AS BIGINT) AS n FROM counts GROUP BY 1, 2""")
def merged_profiles(spark, sf):
    """Profiles of the even and the odd documents added up equal the profile of all."""
    both = noted(spark, sf).withColumn("half", F.col("doc_id") % 2)
    parts = [P.field_counts(both.filter(F.col("half") == h), kind=None) for h in (1, 0)]
    return P.merge_profiles(*parts).groupBy("table", "kind").agg(
        F.count("*").alias("items"), F.sum("count").alias("n"))


@query("""SELECT lang AS "table", source, count(*) AS records FROM documents GROUP BY 1, 2""")
def source_tallies(spark, sf):
    return P.source_tally(load(spark, sf, "documents").withColumnRenamed("lang", "table"))


@query(f"""
SELECT source, count(*) AS leaks FROM (SELECT source, {SQL_CLASS} AS c FROM {SQL_WORDS} WHERE t <> '')
WHERE c IS NOT NULL AND c <> 'fqdn' GROUP BY 1""")
def leaked_identities(spark, sf):
    """Identity-shaped words a raw pool would leak."""
    return P.leak_scan(words(spark, sf), "t").groupBy("source").agg(F.count("*").alias("leaks"))


@query(_SETTLED + f""", r AS (SELECT item AS t, row_number() OVER (PARTITION BY "table", field ORDER BY "count" DESC, encode(item)) AS rank
  FROM settled WHERE kind = 'freeform')
SELECT CAST(count(*) AS INT) AS leaks FROM (SELECT {SQL_CLASS} AS c FROM r WHERE rank <= 200) WHERE c IS NOT NULL AND c <> 'fqdn'""")
def pools_without_identities(spark, sf):
    """The pools the profiler keeps hold no identity."""
    return P.leak_scan(P.value_pool(counts(spark, sf))).agg(F.count("*").cast("int").alias("leaks"))


@query(_SETTLED + """
SELECT "table", kind, count(*) AS items, CAST(sum("count") AS BIGINT) AS n FROM settled GROUP BY 1, 2""")
def settled_kinds(spark, sf):
    """A field with one identity among its values keeps shapes only."""
    return P.settle_kinds(counts(spark, sf)).groupBy("table", "kind").agg(
        F.count("*").alias("items"), F.sum("count").alias("n"))
