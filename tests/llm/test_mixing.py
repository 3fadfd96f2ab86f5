import duckdb
from pyspark.sql import functions as F

from watchloom.llm import mixing as M
from watchloom.llm.queries import ORACLES, QUERIES


def test_query_six_equals_its_sql(spark, data):
    con = duckdb.connect()
    for table in ("documents", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{data}/{table}.parquet'")
    cursor = con.execute(ORACLES["op6_mixing"])
    names = [c[0] for c in cursor.description]
    df = QUERIES["op6_mixing"](spark, data)
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, cursor.fetchall())) == sorted(str(tuple(r)) for r in df.select(*names).collect())


def corpus(spark):
    kinds = {"good": "plain words in calm lines.\n", "low": "A | B | C | D\n", "toxic": "SHOUT!!! SHOUT!!! NO!!!\n"}
    rows, labels = [], []
    for i in range(600):
        kind = ("good", "good", "good", "low", "toxic")[i % 5]
        rows.append((i, kinds[kind] * (1 + i % 9)))
        if i % 2:
            labels.append((i, kind))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, domain string")


def test_expected_totals_meet_the_targets(spark):
    docs, labels = corpus(spark)
    out = M.rates(docs, labels).collect()
    total = sum(r["n_words"] for r in out)
    for d, want in M.TARGETS.items():
        assert abs(sum(r["rate"] * r["n_words"] * r[f"p_{d}"] for r in out) / total - want) < 0.01
    assert all(r["rate"] >= 0 for r in out) and abs(sum(r["copies"] for r in out) / sum(r["rate"] for r in out) - 1) < 0.1
    assert sum(r["p_toxic"] > 0.9 for r in out) == 120


def test_copies_take_effect_and_columns_stay(spark):
    docs, labels = corpus(spark)
    docs = docs.withColumn("rate", F.lit("mine")).withColumn("domain", F.lit(1))
    wanted = {r["doc_id"]: r["copies"] for r in M.rates(docs, labels).collect()}
    out = M.mixed(docs, labels)
    assert out.columns == docs.columns
    got = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert got == {i: n for i, n in wanted.items() if n}


def test_odd_rows_and_empty_tables(spark, odd, empty):
    labels = spark.createDataFrame([(1, "good"), (1, "low"), (4, "toxic"), (5, None), (6, "other")], "doc_id long, domain string")
    out = M.rates(odd, labels).collect()
    assert len(out) == 12 and all(r["rate"] >= 0 and abs(r["p_good"] + r["p_low"] + r["p_toxic"] - 1) < 1e-5 for r in out)
    assert {r["n_words"] for r in out if r["doc_id"] in (2, 3, 9)} == {0}
    assert M.rates(empty, labels).count() == 0 and M.mixed(empty, labels).count() == 0
    assert M.rates(odd, labels.limit(0)).count() == 12
    blank = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert {r["rate"] for r in M.rates(blank, labels).collect()} == {1.0}


def test_given_documents_meet_the_targets(spark, data):
    """On the given tables, from their own labels: totals, and how far toxic documents stand apart."""
    larger = data.replace("sf0.001", "sf0.1")
    labels = spark.read.parquet(f"{larger}/labels.parquet")
    out = QUERIES["op6_mixing"](spark, larger).join(labels, "doc_id", "left").toPandas()
    assert out.residual.max() <= M.TOLERANCE + 1e-4
    for d, want in M.TARGETS.items():
        assert abs((out.rate * out.n_words * out[f"p_{d}"]).sum() / out.n_words.sum() - want) < 0.005
    good = (out.toxic == 0) & (out.quality == 1)
    assert out.p_toxic[out.toxic == 1].mean() > 5 * out.p_toxic[good].mean() and out.p_toxic[out.toxic == 1].mean() > 0.9
