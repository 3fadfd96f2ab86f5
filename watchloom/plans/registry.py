"""Registered queries and, where SQL can say the same, their equivalent in standard SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name."""

    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql.strip()
        return fn

    return add


# --- SQL pieces the equivalents share -----------------------------------------------------

def sql_hash(key: str) -> str:
    return f"(('0x' || substr(md5({key}), 1, 8))::BIGINT)"


def sql_fraction(key: str) -> str:
    return f"(('0x' || substr(md5({key}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


def sql_uuid(key: str) -> str:
    h = f"sha256({key})"
    return " || '-' || ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))


def sql_case(expr: str, mapping: dict, default: str) -> str:
    lit = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    body = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in mapping.items())
    return f"CASE {expr} {body} ELSE {default} END"


def sql_in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def sql_alias(pool: str, key: str, weight: str) -> str:
    """CTEs that end in ``cells`` (cell, own and other key, keep): the alias table of a pool with whole weights."""
    return f"""a1 AS (SELECT {key} AS id, CAST({weight} AS HUGEINT) * 1048576 AS q FROM {pool}),
a2 AS (SELECT *, count(*) OVER () AS n, sum(q) OVER () AS w FROM a1),
a3 AS (SELECT *, q * n AS mass, {sql_hash("CAST(id AS VARCHAR)")} % greatest(CAST(ceil(n / 256.0) AS BIGINT), 1) AS b FROM a2),
a4 AS (SELECT *, mass <= w AS light, CASE WHEN mass <= w THEN w - mass ELSE 0 END AS lacks, CASE WHEN mass <= w THEN 0 ELSE mass - w END AS over_ FROM a3),
a5 AS (SELECT *, row_number() OVER (ORDER BY b, id) - 1 AS cell, sum(lacks) OVER (ORDER BY b, id) - lacks AS start, sum(over_) OVER (ORDER BY b, id) AS until FROM a4),
heavy AS (SELECT until, id FROM a5 WHERE NOT light),
light AS (SELECT DISTINCT start FROM a5 WHERE light),
cells AS (SELECT cell, a5.id AS own, heavy.id AS other, CASE WHEN heavy.id IS NULL THEN 1.0 ELSE CAST(mass AS DOUBLE) / CAST(w AS DOUBLE) END AS keep
  FROM (SELECT * FROM a5 WHERE light) a5 ASOF LEFT JOIN heavy ON a5.start < heavy.until
  UNION ALL SELECT cell, h.id, h.nxt, CASE WHEN h.nxt IS NULL THEN 1.0 ELSE CAST(w + h.until - coalesce(light.start, h.every) AS DOUBLE) / CAST(w AS DOUBLE) END
  FROM (SELECT *, lead(id) OVER (ORDER BY until) AS nxt, max(until) OVER () AS every FROM a5 WHERE NOT light) h ASOF LEFT JOIN light ON h.until <= light.start)"""


def sql_drawn(draws: str, keep: str, u: str) -> str:
    """The picked key of each draw: ``keep`` columns and ``id``."""
    return f"""SELECT {keep}, CASE WHEN u * n - floor(u * n) < keep THEN own ELSE other END AS id
  FROM (SELECT *, {u} AS u, (SELECT count(*) FROM cells) AS n FROM {draws}) JOIN cells ON cell = CAST(floor(u * n) AS BIGINT)"""
