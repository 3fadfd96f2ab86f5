import hashlib
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from watchloom.llm import suffixes as S
from watchloom.llm.queries import ORACLES, QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def expected(docs, tests):
    """The contract, window by window."""
    out = []
    items = [("" if i is None else str(i), words(t)) for i, t in tests]
    windows = {(i, tuple(w[s:s + 10])) for i, w in items if w for s in range(max(len(w) - 9, 1))}
    for doc_id, text in docs:
        own, hit, met = words(text), set(), set()
        for item, win in windows:
            for s in range(len(own) - len(win) + 1):
                if tuple(own[s:s + len(win)]) == win:
                    hit.update(range(s, s + len(win)))
                    met.add(item)
        out.append((doc_id, len(own), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in df.collect()), key=repr)


def test_words_are_those_of_the_pattern():
    texts = ["", None, "Hello, WORLD 12a", "ÀÉ x\x7fy 日本", "...", "a", " lead and trail ", "end", "start"]
    found, counts = S.words_of(pa.array(texts))
    assert [w.decode() for w in found.to_pylist()] == [w for t in texts for w in words(t)]
    assert counts.tolist() == [len(words(t)) for t in texts]


@pytest.mark.parametrize("alphabet, sizes", [(2, [50, 0, 1, 60]), (1, [300, 300, 7]), (40, [400, 400]), (1000, [2000])])
def test_suffix_arrays_are_sorted_to_the_end(alphabet, sizes):
    rnd = np.random.default_rng(alphabet)
    n = len(sizes)
    sequence = np.concatenate([np.append(rnd.integers(0, alphabet, s) + n, i) for i, s in enumerate(sizes)]).astype(np.int32)
    found = S.suffix_array(sequence, n)
    tails = [sequence[i:].tolist() for i in range(len(sequence))]
    upto = [t[:next(k for k, v in enumerate(t) if v < n) + 1] for t in tails]
    assert found.tolist() == sorted((i for i in range(len(sequence)) if sequence[i] >= n), key=lambda i: upto[i])


def corpus(seed, n_docs=30):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)]
    tests = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([0, 1, 3, 9, 10, 11, 25])))) for i in range(12)]
    docs = []
    for i in range(n_docs):
        parts = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(0, 60)))]
        if rnd.random() < 0.5:
            own = words(rnd.choice(tests)[1])
            cut = rnd.randint(0, max(len(own) - 10, 0))
            parts.append(" ".join(own[cut:cut + rnd.randint(5, 25)]).upper())
        docs.append((i, ", ".join(parts)))
    return docs + docs[:4], tests


def test_query_twelve_is_its_sql(spark, data):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    want = sorted((tuple(r) for r in con.execute(f"SELECT doc_id, n_words, n_hit, n_items, items_sha256, contaminated FROM ({ORACLES['op12_decontamination']})").fetchall()), key=repr)
    assert got(QUERIES["op12_decontamination"](spark, data)) == want


@pytest.mark.parametrize("blocks", [1, 4])
def test_against_every_window(spark, odd, monkeypatch, blocks):
    docs, tests = corpus(blocks)
    docs += [(r["doc_id"], r["text"]) for r in odd.collect() if len(r["text"] or "") < 10_000]
    tests += [(None, "no id at all"), (3, None), (4, ""), (7, "..."), (77, "ONE two three"), (77, "one two three"), ("5", "12345")]
    table = spark.createDataFrame([(None if i is None else int(i), t, 9) for i, t in tests], "item_id long, text string, n_hit int")
    if blocks > 1:
        monkeypatch.setattr(S, "TEST_BYTES", 300)
    found = S.contamination(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), table)
    assert got(found) == expected(docs, tests)


def test_small_shards_long_texts_and_windows(spark, odd, monkeypatch):
    monkeypatch.setattr(S, "SHARD_BYTES", 200)
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    tests = [(1, "word5 the word6 the word7 the word8 the word9 the word10"), (2, "the")]
    assert got(S.contamination(odd, spark.createDataFrame(tests, "item_id long, text string"))) == expected(rows, tests)


def test_longest_matches_and_what_is_removed(spark, empty):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k l", 1), (2, "x a b c d e f g h i j y a b c", 2), (3, "q a b c d", 3), (None, "k l m n o p q r s t u", 4)], "doc_id long, text string, n int")
    tests = spark.createDataFrame([(7, "0 a b c d e f g h i j k l m n")], "item_id long, text string")
    found = sorted(tuple(r) for r in S.longest_matches(S.suffix_shards(docs.where("n < 4").coalesce(1)), tests, least=3).collect())
    assert ("7", 1, 1, 0, 12) in found and all(length >= 3 for *_, length in found)
    assert [r["n"] for r in S.decontaminated(docs, tests).collect()] == [3, 4] and S.decontaminated(docs, tests).columns == docs.columns
    none = empty.select(empty.doc_id.alias("item_id"), "text")
    assert S.contamination(empty.select("doc_id", "text"), tests).count() == 0
    assert got(S.contamination(docs, none)) == expected([(r["doc_id"], r["text"]) for r in docs.collect()], [])
