import random

import numpy as np
from pyspark.sql import functions as F

from watchloom.llm import common as C


def test_components_equal_union_find(spark):
    rnd = random.Random(1)
    links = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    parent = {}

    def find(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    want = {n: find(n) for a, b in links if a != b for n in (a, b)}
    got = C.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == want and len(got) == len(want)
    assert C.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_buckets_grow_with_the_key(spark):
    rows = spark.createDataFrame([(i % 700 - 300,) for i in range(3000)], "k long")
    placed = C.with_bucket(rows, "k", 9).groupBy("bucket").agg(F.min("k").alias("a"), F.max("k").alias("b"), F.count("*").alias("n")).orderBy("bucket").collect()
    assert len(placed) == 9 and all(x["b"] < y["a"] for x, y in zip(placed, placed[1:])) and max(r["n"] for r in placed) < 500
    assert C.with_bucket(rows.limit(0), "k", 9).count() == 0


def test_ragged_and_totals():
    flat = np.arange(10)
    assert C.ragged(flat, np.array([7, 2, 0]), np.array([2, 0, 3])).tolist() == [7, 8, 0, 1, 2]
    assert C.totals(np.array([1, 2, 3]), np.array([0, 2, 0, 1])).tolist() == [0, 3, 0, 3]


def test_pool_forgets_the_later_half():
    pool = C.Pool(lambda units: (np.array([len(u) for u in units], np.int32), np.ones(len(units), np.int64)), 10)
    for step in range(30):
        pool.begin()
        units = ["a", "bb", f"x{step}" * 3, "a"]
        at = pool.indices(units)
        assert pool.ids(at).tolist() == [len(u) for u in units]
    assert pool.count <= 12


def test_long_texts_are_slices_of_their_own(spark):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"text": ["a" * 5, None, "b" * 100, "", "c"]})
    assert [s.num_rows for s in C.slices(batch, "text", 10)] == [2, 1, 2]


def test_a_worker_holds_the_cache_of_one_operator():
    from watchloom.llm import common, near_dups, pieces

    near_dups.strips(["a few words of a text"])
    pieces.encode_texts(["a few words of a text"], pieces.MODEL)
    assert list(common._held) == [("units", pieces.MODEL)]
    again = pieces.unit_pool(pieces.MODEL)
    assert pieces.unit_pool(pieces.MODEL) is again and again.count
