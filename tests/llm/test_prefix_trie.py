import random

import duckdb
import pytest
from pyspark.sql import functions as F

from watchloom.llm import prefix_trie as P
from watchloom.llm.queries import ORACLES, QUERIES

COLUMNS = "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
SCHEMA = "conv_id long, turn long, role string, text string"


def got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def by_sql(table):
    con = duckdb.connect()
    con.register("given", table)
    con.execute("CREATE VIEW conversations AS SELECT * FROM given")
    return sorted(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({ORACLES['op13_prefix_trie']})").fetchall(), key=repr)


def test_query_thirteen_is_its_sql(spark, data):
    assert got(QUERIES["op13_prefix_trie"](spark, data)) == by_sql(spark.read.parquet(f"{data}/conversations.parquet").toArrow())


def test_odd_rows(spark):
    rnd = random.Random(1)
    rows = [(c, t, rnd.choice(["user", None, "system"]), rnd.choice(["a", "b", None, "", "é😀"])) for c in [*range(0, 220, 3), 100, 200, -7, -100, -150, 10 ** 12 + 1] for t in range(rnd.randint(1, 9))]
    rows += [(5, None, "user", "first"), (5, None, "user", "first"), (5, 2, "x", "tie"), (5, 2, "w", "tie"), (None, 1, "user", "no conversation")]
    rows += [(300, t, "u", "deep") for t in range(400)] + [(301, t, "u", "deep") for t in range(0, 300)] + [(377, 1, "u", "deep")]
    table = spark.createDataFrame(rows, SCHEMA).withColumn("depth", F.lit("clash"))
    assert got(P.prefix_trie(table.repartition(5))) == by_sql(table.drop("depth").toArrow())


def test_no_rows(spark):
    assert P.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_pieces_do_not_change_digests(spark, monkeypatch):
    monkeypatch.setattr(P, "PIECE", 2)
    rows = [(c, t, "u", "same") for c in range(40) for t in range(2)]
    table = spark.createDataFrame(rows, SCHEMA)
    assert got(P.prefix_trie(table)) == by_sql(table.toArrow())


@pytest.mark.parametrize("shape", ["chain", "star", "random", "comb"])
def test_contraction_recovers_every_subtree(spark, shape):
    rnd = random.Random(shape)
    n = 150
    parent = {0: None}
    for i in range(1, n):
        parent[i] = {"chain": i - 1, "star": 0, "random": rnd.randrange(max(0, i - 9), i), "comb": i - 1 if i % 2 else max(i - 2, 0)}[shape]
    depth = {}
    for i in range(n):
        depth[i] = 0 if parent[i] is None else depth[parent[i]] + 1
    value = {i: rnd.randint(-5, 50) for i in range(n)}
    want, kids = dict(value), dict.fromkeys(range(n), 0)
    for i in reversed(range(1, n)):
        want[parent[i]] += want[i]
        kids[parent[i]] += 1
    nodes = spark.createDataFrame([(i, depth[i], parent[i], kids[i], value[i]) for i in range(n)], "id long, depth long, up long, n_children long, v long")
    found = P.subtree_totals(nodes, {"total": F.col("v")})
    assert {r["id"]: r["total"] for r in found.collect()} == want and found.count() == n
