import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from watchloom.llm import lm as L
from watchloom.llm.queries import QUERIES


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(2)
    counts = np.zeros(400)
    counts[:120] = rng.integers(1, 500, 120)
    windows = rng.integers(0, 120, (500, 2 * L.BLOCK + 1)).astype(np.int32)
    windows[:40, :20] = -1
    windows[:, 1::2] = (windows[:, :-1:2] + 1) % 120
    steps, L.STEPS = L.STEPS, 30
    made = L.fit(windows, counts)
    L.STEPS = steps
    return made


def plain_scores(m, symbols):
    """Log probability of each symbol, one at a time, from the definition."""
    rows = np.append(m.row_of[-1], m.row_of[symbols[:-1]])
    rows = np.concatenate([np.full(L.BLOCK, m.row_of[-1]), rows])
    q, k, v = (m.qkv[rows][:, i * L.WIDTH:(i + 1) * L.WIDTH].astype(np.float64) for i in range(3))
    out = []
    for i, s in enumerate(symbols):
        at = L.BLOCK + i
        first = (at // L.BLOCK - 1) * L.BLOCK
        keys = np.arange(first, at + 1)
        weight = np.exp(k[keys] @ q[at] + m.near[at - keys])
        logits = (weight / weight.sum()) @ v[keys] @ m.out + m.base[rows[at]]
        group, inside = m.class_of[s] // L.SIZE, logits[L.GROUPS:].reshape(L.GROUPS, L.SIZE)
        out.append(logits[group] - np.log(np.exp(logits[:L.GROUPS]).sum()) + inside[group, m.class_of[s] % L.SIZE] - np.log(np.exp(inside[group]).sum()) + m.inside[s])
    return out


def test_every_symbol_is_scored_once_in_its_window(model):
    rng = np.random.default_rng(5)
    texts = [rng.integers(0, 400, n) for n in (1, 5, L.BLOCK, L.BLOCK + 1, 100, 3)]
    got = L.score_symbols(model, np.concatenate(texts), np.array([len(t) for t in texts]), chunk=3)
    assert np.allclose(got, [sum(plain_scores(model, t)) for t in texts], rtol=1e-4)


def test_probabilities_of_the_next_symbol_sum_to_one(model):
    start = [3, 77, 12] * 9
    total = sum(math.exp(plain_scores(model, np.array(start + [s]))[-1]) for s in range(400))
    assert abs(total - 1) < 1e-4


def test_gradient_is_the_slope_of_the_loss():
    rng = np.random.default_rng(1)
    rows, width, wide = 9, L.WIDTH, L.GROUPS + L.CLASSES
    values = [rng.standard_normal(s) * 0.5 for s in ((rows, width), (width, 3 * width), (width, wide), (2 * L.BLOCK,), (rows, wide))]
    x, y = rng.integers(0, rows, (3, 2 * L.BLOCK)), rng.integers(0, 40, (3, 2 * L.BLOCK))
    real = rng.random((3, 2 * L.BLOCK)) < 0.9
    back = L.BLOCK + np.arange(L.BLOCK)[:, None] - np.arange(2 * L.BLOCK)[None, :]

    def loss():
        embed, project, out, near, base = values
        qkv = embed[x] @ project
        q, k, v = qkv[:, L.BLOCK:, :width] / math.sqrt(width), qkv[:, :, width:2 * width], qkv[:, :, 2 * width:]
        w = np.exp(q @ k.transpose(0, 2, 1) + np.where(back >= 0, near[np.clip(back, 0, len(near) - 1)], -1e9))
        logits = (w / w.sum(2, keepdims=True)) @ v @ out + base[x[:, L.BLOCK:]]
        groups, inside = logits[:, :, :L.GROUPS], logits[:, :, L.GROUPS:].reshape(*logits.shape[:2], L.GROUPS, L.SIZE)
        logp = (groups - np.log(np.exp(groups).sum(2, keepdims=True)))[..., None] + inside - np.log(np.exp(inside).sum(3, keepdims=True))
        own = np.take_along_axis(logp.reshape(*logits.shape[:2], L.CLASSES), y[:, L.BLOCK:, None], 2)[:, :, 0]
        return -(own * real[:, L.BLOCK:]).sum() / real[:, L.BLOCK:].sum()

    slopes = L._slopes(values, x, y, real, back)
    for value, slope in zip(values, slopes):
        for _ in range(3):
            at = tuple(int(rng.integers(0, n)) for n in value.shape)
            old = value[at]
            value[at] = old + 1e-5
            up = loss()
            value[at] = old - 1e-5
            down = loss()
            value[at] = old
            assert abs((up - down) / 2e-5 - slope[at]) < 1e-4


def test_words_are_spelled_with_their_ends():
    speller = L.Speller(L.MODEL)
    words = ["the", "théâtre", "日本", "▁odd▁", "x" * 300, "don't", "\x00", "😀"]
    flat, lengths = speller.spell([w.encode() for w in words])
    ends = np.cumsum(lengths) - 1
    assert (flat[ends] >= speller.size).all() and (np.delete(flat, ends) < speller.size).all()
    for w, a, b in zip(words, ends - lengths + 1, ends + 1):
        assert [s % speller.size for s in flat[a:b].tolist()] == speller.model.encode(w)


def base_of(texts, held):
    words = [(t or "").encode().lower().split() + [L.END_WORD] for t in texts]
    counts = Counter(w for own, h in zip(words, held) if not h for w in own)
    n, v = sum(counts.values()), len(counts)
    return n, [(len(own), sum(counts[w] > 0 for w in own), sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)) for own in words]


def test_query_one_has_the_baseline_and_scores(spark, data, docs):
    table = docs.select("doc_id", "text").collect()
    held = [zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1 for r in table]
    n, want = base_of([r["text"] for r in table], held)
    got = {r["doc_id"]: r for r in QUERIES["op1_lm_scores"](spark, data).collect()}
    for r, h, (tokens, known, base) in zip(table, held, want):
        g = got[r["doc_id"]]
        assert (g["held_out"], g["n_tokens"], g["n_known"], g["train_tokens"]) == (h, tokens, known, n)
        assert abs(g["base_score"] - base) < 1e-6 * abs(base) + 1e-9 and g["score"] < 0


def test_odd_rows(spark, odd, empty):
    rows = odd.collect()
    n, want = base_of([r["text"] for r in rows], [r["doc_id"] in (5, 9) for r in rows])
    held = F.coalesce(F.col("doc_id").isin(5, 9), F.lit(False))
    small, L.TABLE_WORDS, steps, L.STEPS = L.TABLE_WORDS, 20, L.STEPS, 3
    try:
        out = L.score(odd, held).collect()
    finally:
        L.TABLE_WORDS, L.STEPS = small, steps
    assert sorted((r["n_tokens"], r["n_known"], round(r["base_score"], 4)) for r in out) == sorted((t, k, round(b, 4)) for t, k, b in want)
    assert all(r["score"] < 0 and r["train_tokens"] == n for r in out)
    assert L.score(empty, F.lit(False)).count() == 0
    nothing = L.score(odd, F.lit(True)).collect()
    assert len(nothing) == 12 and {(r["n_known"], r["train_tokens"]) for r in nothing} == {(0, 0)}


def test_transitions_come_from_all_training_texts_not_from_the_windows(spark):
    left = ["time", "people", "water", "house", "music", "world", "night", "money", "paper", "light"]
    right = ["school", "family", "city", "story", "book", "power", "game", "line", "team", "road"]
    rows = [(i, f"{left[i % 10]} {right[i % 10]}") for i in range(3000)]
    rows += [(9000 + 10 * a + b, f"{left[a]} {right[b]}") for a in range(10) for b in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    old = L.FIT_WINDOWS, L.STEPS
    L.FIT_WINDOWS, L.STEPS = 1, 3
    try:
        out = {r["doc_id"]: r["score"] for r in L.score(docs, F.col("doc_id") >= 9000).where("held_out").collect()}
    finally:
        L.FIT_WINDOWS, L.STEPS = old
    met = [out[9000 + 11 * a] for a in range(10)]
    other = [v for i, v in out.items() if (i - 9000) % 11]
    assert min(met) > max(other)


def test_pairs_are_counted_over_all_coded_texts(spark):
    texts = [[3, 5, 9], [5, 9], [9], [3, 3, 5, 9]]
    coded = spark.createDataFrame([(bytearray(np.array(sum(texts[a:a + 2], []), np.uint16).tobytes()),) for a in (0, 2)], "codes binary")
    got = L.count_pairs(coded, 10, 9, 110, lambda before, symbol: (before + 1) * 10 + symbol)
    want = Counter((a + 1) * 10 + b for t in texts for a, b in zip([-1, *t], t))
    assert {i: int(got[i]) for i in np.flatnonzero(got)} == want


def test_parts_grow_with_the_windows_and_learn_together(spark, model):
    rng = np.random.default_rng(4)
    windows = rng.integers(0, 120, (900, 2 * L.BLOCK + 1)).astype(np.int32)
    windows[:, 2:] = windows[:, :1]
    counts = np.bincount(windows.ravel(), minlength=400).astype(float)
    before, symbol = windows[:, :-1].ravel(), windows[:, 1:].ravel()
    near = np.bincount(L.neighbour_cells(counts)(before, symbol), minlength=L.ROWS * 2 * L.CONTEXT + 1)
    rows = L.rows_of(L.cluster(near, counts), counts)
    flat = np.full((len(rows.class_of_row), L.CLASSES), 0.0)
    base = L.base_of_counts(rows, flat)
    old = L.FIT_WINDOWS, L.STEPS
    L.FIT_WINDOWS, L.STEPS = 300, 60
    try:
        df = spark.createDataFrame([(bytearray(w.tobytes()),) for w in windows], "window binary")
        first = L.fit_parts(df, rows, base)
        again = L.fit_parts(df, rows, base)
    finally:
        L.FIT_WINDOWS, L.STEPS = old
    assert all(np.array_equal(a, b) for a, b in zip(first, again))
    flat, sizes = windows[:50, 2:].ravel(), np.full(50, 2 * L.BLOCK - 1)
    start = L.score_symbols(L.made(rows, base, L.fresh(rows)), flat, sizes).sum()
    assert L.score_symbols(L.made(rows, base, first), flat, sizes).sum() > start + 0.1 * abs(start)


def test_every_block_of_the_texts_is_a_window_of_its_own_text():
    rng = np.random.default_rng(6)
    texts = [np.append(rng.integers(0, 90, n), 99) for n in (0, 1, L.BLOCK - 1, L.BLOCK, 3 * L.BLOCK + 5)]
    windows = L.windows_of(np.concatenate(texts).astype(np.uint16), 99)
    assert len(windows) == sum(-(-len(t) // L.BLOCK) for t in texts)
    at = 0
    for t in texts:
        padded = np.concatenate([np.full(L.BLOCK + 1, -1), t, np.full(L.BLOCK, -1)])
        for a in range(0, len(t), L.BLOCK):
            assert windows[at].tolist() == padded[a:a + 2 * L.BLOCK + 1].tolist()
            at += 1


def test_attention_is_fitted_on_all_windows_whatever_their_number(spark):
    symbols, end = 3000, 2999
    counts = np.ones(symbols)
    rows = L.rows_of(np.arange(symbols) % L.CLASSES, counts)
    base = L.base_of_counts(rows, np.zeros((len(rows.class_of_row), L.CLASSES)))
    texts = [np.array([i] * 20 + [end], np.uint16) for i in range(2900)]
    old = L.FIT_WINDOWS, L.STEPS
    for L.FIT_WINDOWS, L.STEPS in ((10_000, 60), (300, 60), (40, 60)):  # the first step moves no rows: all windows are visited twice
        try:
            coded = spark.createDataFrame([(bytearray(np.concatenate(texts[a:a + 100]).tobytes()),) for a in range(0, 2900, 100)], "codes binary")
            state = L.fit_coded(coded, symbols, end, 2900 * 21, rows, base)
        finally:
            L.FIT_WINDOWS, L.STEPS = old
        moved = (state[0] != L.fresh(rows)[0]).any(axis=1)
        assert moved[rows.row_of[:2900]].all()


def test_runs_of_blocks_are_the_windows_of_each_text():
    rng = np.random.default_rng(7)
    texts = [np.append(rng.integers(0, 90, n), 99) for n in (0, 1, L.BLOCK - 1, L.BLOCK, 2 * L.BLOCK - 1, 9 * L.BLOCK + 5)]
    flat = np.concatenate(texts).astype(np.uint16)
    windows, runs = L.windows_of(flat, 99), L.runs_of_blocks(flat, 99)
    blocks = [run[a:a + 2 * L.BLOCK + 1] for run in runs for a in range(0, L.RUN * L.BLOCK, L.BLOCK)]
    blocks = np.array([b for b in blocks if (b[L.BLOCK + 1:] >= 0).any()])
    # a symbol that stands for none, and the one before it, are never seen
    blocks[:, :-1][blocks[:, 1:] < 0] = -1
    windows[:, :-1][windows[:, 1:] < 0] = -1
    assert np.array_equal(blocks, windows)


def test_runs_have_the_slopes_of_their_windows():
    rng = np.random.default_rng(8)
    rows, wide = 30, L.GROUPS + L.CLASSES
    values = [rng.standard_normal(s) * 0.5 for s in ((rows, L.WIDTH), (L.WIDTH, 3 * L.WIDTH), (L.WIDTH, wide), (2 * L.BLOCK,), (rows, wide))]
    size = (3, (1 + L.RUN) * L.BLOCK)
    x, y, real = rng.integers(0, rows, size), rng.integers(0, L.CLASSES, size), rng.random(size) < 0.9
    back = L.BLOCK + np.arange(L.BLOCK)[:, None] - np.arange(2 * L.BLOCK)[None, :]
    apart = [np.concatenate([a[:, i * L.BLOCK:(i + 2) * L.BLOCK] for i in range(L.RUN)]) for a in (x, y, real)]
    for one, other in zip(L._slopes(values, x, y, real, back), L._slopes(values, *apart, back)):
        assert np.allclose(one, other, atol=1e-7)


def test_all_texts_are_spelled_once_and_scored_from_their_symbols(spark):
    texts = ["One two three", None, "two  two\nfour", "", "five " * 70_000, "six One"]
    docs = spark.createDataFrame([(i, t, i % 3 == 2) for i, t in enumerate(texts)], "doc_id long, text string, held_out boolean").coalesce(1)
    rows, end, met = L._gather(docs, L.MODEL).collect(), L.Speller(L.MODEL).end, {}
    for r in rows:
        if r["kind"] >= 2:
            hashes, counts = np.frombuffer(r["hashes"], np.uint64), np.frombuffer(r["sizes"], np.int64)
            words = hashes[np.frombuffer(r["words"], L._number(len(hashes)))]
            assert (np.frombuffer(r["codes"], np.uint16) == end).sum() == len(r["ids"]) == len(counts)
            assert all(h == (r["kind"] == 3) for h in r["held"])
            for i, own in zip(r["ids"], np.split(words, np.cumsum(counts)[:-1])):
                assert i not in met
                met[i] = own.tolist()
    assert met == {i: [L._HASH(w) for w in (t or "").lower().encode().split()] for i, t in enumerate(texts)}
    learnt = Counter()
    for r in rows:
        if r["kind"] == 0:
            learnt[r["key"] % (1 << 64)] += r["n"]
    want = Counter(w for i, own in met.items() if i % 3 != 2 for w in own)
    assert learnt == want + Counter({L._HASH(L.END_WORD): 4})
