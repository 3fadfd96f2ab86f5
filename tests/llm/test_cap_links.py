import numpy as np

from watchloom.llm import cap_links as C
from watchloom.llm.queries import QUERIES


def brute(rows, cosine=0.93):
    """(n_links, component) of each row by comparing all pairs."""
    def good(label, v):
        return label is not None and v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)

    unit = [np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64)) if good(label, v) else None for _, label, v in rows]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and rows[i][1] == rows[j][1] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i in range(len(rows)):
        least[find(i)] = min(least.get(find(i), rows[i][0]), rows[i][0])
    return [(links[i], least[find(i)]) for i in range(len(rows))]


def planted():
    rng = np.random.default_rng(3)
    rows, n = [], 0
    for label in (1, 2):
        for size, spread in ((1, 0), (60, 0.02), (40, 0.05), (30, 0.07), (2, 0.03), (3, 0.045)) * 3 + ((1, 0),) * 60:
            centre = rng.standard_normal(32)
            centre /= np.linalg.norm(centre)
            for _ in range(size):
                rows.append((n, label, [float(x) for x in np.float32(centre + spread * rng.standard_normal(32))]))
                n += 1
    rows += [(n + i, r[1], r[2]) for i, r in enumerate(rows[:25])]
    return rows


def test_links_equal_comparing_all_pairs(spark):
    rows = planted()
    out = {r["vec_id"]: r for r in C.link(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")).collect()}
    want = brute(rows)
    got = [(out[i]["n_links"], out[i]["component_id"]) for i, _, _ in rows]
    assert sum(g[0] for g in got) >= 0.99 * sum(w[0] for w in want) and all(g[0] <= w[0] for g, w in zip(got, want))
    assert np.mean([g == w for g, w in zip(got, want)]) > 0.99
    assert all(out[i]["kept"] == (out[i]["component_id"] == i) for i in out)


def test_pairs_at_the_threshold_share_a_filter():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z = rng.standard_normal(x.shape)
    z -= (z * x).sum(1)[:, None] * x
    z /= np.linalg.norm(z, axis=1)[:, None]
    for n in (500, 20_000):
        t, words = C.plan(n, 0.93)
        books = C.codebooks(64, words)
        a, b = C.list_decode(x, books, t)[0], C.list_decode(0.93 * x + np.sqrt(1 - 0.93 ** 2) * z, books, t)[0]
        assert np.mean([bool(set(p.tolist()) & set(q.tolist())) for p, q in zip(a, b)]) >= 0.98


def test_odd_vectors(spark, empty):
    nan, inf = float("nan"), float("inf")
    rows = [(1, 1, [1.0, 0.0, 0.0]), (2, 1, [2.0, 0.0, 0.0]), (3, 1, None), (4, 1, [0.0, 0.0, 0.0]), (5, 1, [1.0, None, 0.0]), (6, 1, [nan, 1.0, 0.0]),
            (7, 1, [inf, 1.0, 0.0]), (8, None, [1.0, 0.0, 0.0]), (9, 2, [1.0, 0.0, 0.0]), (10, 1, [1.0, 0.0]), (11, 1, []), (2, 1, [2.0, 0.0, 0.0]),
            (12, 1, [-1.0, 0.0, 0.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<float>, weight string")
    out = C.link(df)
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in out.collect())
    assert got == sorted((r[0], *w) for r, w in zip(rows, brute(rows)))
    assert C.link(empty.withColumnRenamed("doc_id", "vec_id").select("vec_id", "label", "embedding")).count() == 0


def test_query_five_covers_the_table(spark, data):
    table = spark.read.parquet(f"{data}/embeddings.parquet").collect()
    rows = [(r["vec_id"], r["label"], r["embedding"]) for r in table]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in QUERIES["op5_embedding_links"](spark, data).collect()}
    assert [got[i] for i, _, _ in rows] == brute(rows)


def test_vectors_of_one_component_have_a_sign(spark):
    rows = [(i, 1, [v]) for i, v in enumerate([2.0, 0.5, -3.0, 0.0, 1e30, -1e-30])] + [(10, 2, [4.0]), (11, 1, [1.0, 0.0]), (12, 1, [float("nan")]), (13, None, [1.0])]
    out = {r["vec_id"]: r for r in C.link(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")).collect()}
    assert [(out[i]["n_links"], out[i]["component_id"]) for i, _, _ in rows] == brute(rows)
