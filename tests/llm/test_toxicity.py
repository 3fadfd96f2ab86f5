import random
import time

import numpy as np
from pyspark.sql import functions as F

from watchloom.llm import toxicity as T
from watchloom.llm.queries import QUERIES


def slow_segments(scores, low, high):
    """All maximal segments by their definition: the best segment of a stretch (shortest, leftmost), then both sides."""
    best = None
    for i in range(low, high):
        for j in range(i + 1, high + 1):
            s = sum(scores[i:j])
            if s > 1e-12 and (best is None or s > best[0] + 1e-12 or (abs(s - best[0]) <= 1e-12 and j - i < best[2] - best[1])):
                best = (s, i, j)
    if best is None:
        return []
    s, i, j = best
    return slow_segments(scores, low, i) + [(i, j - 1, s)] + slow_segments(scores, j, high)


def test_segments_equal_their_definition():
    rnd = random.Random(4)
    for _ in range(150):
        scores = [rnd.choice([-0.5, -1.25, -0.3, 2.0, 3.5, 0.7]) + rnd.random() / 1000 for _ in range(rnd.randint(0, 18))]
        got = T.segments(np.array(scores))
        want = slow_segments(scores, 0, len(scores))
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert np.allclose([s for _, _, s in got], [s for _, _, s in want])


def test_segments_take_linear_time():
    def seconds(n):
        scores = np.where(np.arange(3 * n) % 3 == 0, 1.0 + np.arange(3 * n) % 7 / 10, -0.9)
        scores[::50] = -30.0 - np.arange(len(scores[::50])) % 5
        start = time.perf_counter()
        assert len(T.segments(scores)) > n / 60
        return time.perf_counter() - start

    seconds(1000)
    assert seconds(16_000) < 0.5 and seconds(64_000) < 10 * max(seconds(16_000), 0.01)
    falling = np.tile([1.0, -1.5], 100_000)
    start = time.perf_counter()
    assert len(T.segments(falling)) == 100_000 and time.perf_counter() - start < 3


def test_evidence_looks_at_all_segments():
    for n, hits, value in ((20_000, 400, 4.0), (200_000, 500, 6.0)):
        scores = np.full(n, -0.1)
        scores[:: n // hits] = value
        got, passages = T.evidence(scores, 1.0)
        base = np.log(T.CHANCE * n)
        want = max(r * (value - base) + sum(np.log(np.arange(1, r + 1))) for r in range(1, hits + 1))
        assert abs(got - want) < 1e-6 and got > 500 and not passages
    rnd = random.Random(6)
    scores = np.array([rnd.choice([-0.5, -1.25, 2.0, 3.5]) for _ in range(300)])
    ordered = sorted((s for _, _, s in T.segments(scores)), reverse=True)
    base = np.log(T.CHANCE * 300)
    want = max(0.7 * sum(ordered[:r]) - r * base + sum(np.log(np.arange(1, r + 1))) for r in range(1, len(ordered) + 1))
    assert abs(T.evidence(scores, 0.7)[0] - want) < 1e-9


def test_scale_makes_the_mean_one():
    positive = {6.5: 3, 2.0: 40}
    x = T.chance_scale(positive, 100_000)
    shares = {v: c / 100_001 for v, c in positive.items()}
    mean = sum(s * np.exp(x * v) for v, s in shares.items()) + (1 - sum(shares.values())) * np.exp(-x * T.COST)
    assert abs(mean - 1) < 0.05


def planted(spark):
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 7 == 0
        text = [rnd.choice(words) for _ in range(rnd.randint(3, 200))]
        at = rnd.randrange(len(text) + 1)
        text[at:at] = [rnd.choice(["vileness", "vilefolk", f"grimly{rnd.randint(0, 10_000)}"]) for _ in range(rnd.randint(1, 4) if toxic else 0)]
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_planted_words_are_found_and_others_left_alone(spark):
    docs, labels = planted(spark)
    model = T.fit(docs, labels, F.col("doc_id") % 3 != 1)
    rows = T.score(docs, model, drop_text=False).join(labels, "doc_id").where("doc_id % 3 = 1").collect()
    assert all(r["predicted"] == 0 for r in rows if not r["toxic"])
    assert np.mean([r["predicted"] for r in rows if r["toxic"]]) > 0.95
    found = [(r, p) for r in rows for p in r["passages"]]
    assert found and all(w.startswith(("vile", "grimly")) for r, p in found for w in (T._words(r["text"])[p["first"]], T._words(r["text"])[p["last"]]))


def test_odd_rows_and_missing_labels(spark, odd, empty):
    docs, labels = planted(spark)
    model = T.fit(docs, labels, F.lit(True))
    out = T.score(odd.withColumn("score", F.lit("old")), model).collect()
    assert len(out) == 12 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in out)
    assert T.score(empty.select("doc_id", "text"), model).count() == 0
    none = T.fit(docs, labels.limit(0), F.lit(True))
    assert {r["predicted"] for r in T.score(odd, none).collect()} == {0}
    clean = T.fit(docs, labels.withColumn("toxic", F.lit(0)), F.lit(True))
    assert max(r["score"] for r in T.score(odd, clean).collect()) < 1e-6


def test_query_seven_covers_the_table(spark, data, docs):
    rows = QUERIES["op7_toxicity"](spark, data).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
