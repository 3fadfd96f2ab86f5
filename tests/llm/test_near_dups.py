import random
from collections import Counter

import numpy as np

from watchloom.llm import near_dups as N
from watchloom.llm.queries import QUERIES


def bag(text):
    words = (text or "").lower().split()
    runs = [tuple(words[i:i + 5]) for i in range(len(words) - 4)] if len(words) >= 5 else [tuple(words)] if words else []
    return Counter(runs)


def alike(a, b):
    common = sum((a & b).values())
    total = sum(a.values()) + sum(b.values()) - common
    return common / total if total else 1.0


def classes(rows):
    """Least id of each row's class, by comparing all pairs."""
    bags = [bag(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            same = (rows[i][1] or "").lower().split() == (rows[j][1] or "").lower().split()
            if same or (bags[i] and bags[j] and alike(bags[i], bags[j]) >= N.SIMILAR):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    least = {}
    for members in groups.values():
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        for i in members:
            least[i] = (min(ids) if ids else None, len(members))
    return [least[i] for i in range(len(rows))]


def test_strips_are_the_runs_with_their_weights():
    texts = ["a b c d e a b c d e a b c d e", "x y", "", "A  b\nc d E a b c d e a b c d e"]
    runs, counts, names = N.strips(texts)
    assert counts.tolist() == [11, 1, 0, 11] and names[0] == names[3]
    assert runs[:11].tolist() == runs[-11:].tolist() and len(set(runs[:11].tolist())) == 11


def test_equal_entries_estimate_weighted_similarity():
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(5000)]
    for change in (0, 3, 12, 40):
        a = [rnd.choice(words) for _ in range(400)] + ["rep eat rep eat rep"] * 20
        b = list(a)
        for _ in range(change):
            b[rnd.randrange(400)] = rnd.choice(words)
        texts = [" ".join(a), " ".join(b)]
        runs, counts, _ = N.strips(texts)
        sig = N.signatures(runs, counts, 2000)
        exact = alike(bag(texts[0]), bag(texts[1]))
        cut = counts[0]
        assert abs(N.similarity(np.sort(runs[:cut]), np.sort(runs[cut:])) - exact) < 1e-9
        assert abs((sig[0] == sig[1]).mean() - exact) < 0.05


def test_signatures_of_one_strip_and_of_many_are_full():
    texts = ["one", " ".join(f"w{i}" for i in range(20_000)), ""]
    runs, counts, _ = N.strips(texts)
    sig = N.signatures(runs, counts)
    assert (sig[0] != np.iinfo(np.uint64).max).all() and (sig[1] != np.iinfo(np.uint64).max).all() and (sig[2] == 0).all()


def planted(n=260):
    rnd = random.Random(6)
    words = [f"w{i}" for i in range(900)]
    rows, made = [], []
    for i in range(n):
        kind = rnd.random()
        if made and kind < 0.55:
            text = rnd.choice(made).split()
            for _ in range(rnd.choice([0, 1, 2, 3, 5, 8])):
                text[rnd.randrange(len(text))] = rnd.choice(words)
        else:
            text = [rnd.choice(words) for _ in range(rnd.choice([3, 6, 40, 120, 300]))]
        made.append(" ".join(text))
        rows.append((i, made[-1]))
    return rows


def test_classes_equal_comparing_all_pairs(spark):
    rows = planted()
    got = {r["doc_id"]: (r["class_id"], r["class_size"]) for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i, _ in rows] == classes(rows)


def test_one_large_group_of_near_copies(spark):
    rnd = random.Random(8)
    base = [f"b{i}" for i in range(300)]
    rows = []
    for i in range(300):
        text = list(base)
        for _ in range(rnd.randint(1, 5)):
            text[rnd.randrange(300)] = f"x{rnd.randint(0, 10**6)}"
        rows.append((i, " ".join(text)))
    rows += [(1000 + i, " ".join(base)) for i in range(200)]
    out = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["class_id"], r["class_size"]) for r in out} == {(0, 500)} and sum(r["kept"] for r in out) == 1


def test_odd_rows(spark, odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    out = N.near_duplicates(odd).collect()
    want = Counter(zip([r[0] for r in rows], classes(rows)))
    assert Counter((r["doc_id"], (r["class_id"], r["class_size"])) for r in out) == want
    n_classes = round(sum(1 / size for _, size in classes(rows)))
    assert sum(r["kept"] for r in out) == n_classes
    assert N.near_duplicates(empty).count() == 0
    left = N.deduplicated(odd)
    assert left.columns == odd.columns and left.count() == n_classes
    assert left.where("doc_id = 1").count() == 1 and left.where("doc_id = 8").count() == 0


def test_query_ten_equals_comparing_all_pairs(spark, data, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = {r["doc_id"]: (r["class_id"], r["class_size"]) for r in QUERIES["op10_near_duplicates"](spark, data).collect()}
    assert [got[i] for i, _ in rows] == classes(rows)
