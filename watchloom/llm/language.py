"""Operator 3: language of a text by a bidirectional gated recurrent network over bytes.

The network reads the UTF-8 bytes of a text in windows of WINDOW bytes, once forwards and once backwards, and gives each byte
a distribution over the learned languages; the mean over all bytes of the whole text is the document's distribution. It is
trained in numpy by backpropagation through time on windows of a bounded sample: at most SAMPLE_DOCS labelled documents, equal
shares for each language, WINDOWS_EACH windows of each.

A text that is null or has no letter is `und` with score 0. With one learned language all other texts get it, with none all
are `und`. Ties go to the language that sorts first. Repeated rows give repeated results, an empty table an empty one; a
new column replaces an input column of its name, others stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchloom.llm.common import map_texts, slices, small_batches, texts_of

WINDOW, HIDDEN = 64, 8
SAMPLE_DOCS, WINDOWS_EACH = 6000, 3
#: A language's documents are drawn in so many parts first, so that a frequent one is not sorted in one task.
SALTS = 64
STEPS, BATCH, RATE, SEED = 500, 192, 0.02, 7
#: Windows that are read side by side when texts are labelled.
LANES = 2048
UNKNOWN = "und"


@dataclass
class Network:
    """inputs[d]: 256 x 3H gate inputs of a byte; state[d]: H x 3H; out: 2H x L; bias: L. Gates: update, reset, new."""

    languages: list[str]
    inputs: list[np.ndarray]
    state: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [*self.inputs, *self.state, self.out, self.bias]


def new_network(languages: list[str], hidden: int = HIDDEN) -> Network:
    rng = np.random.default_rng(SEED)
    table = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
    return Network(languages, [table(256, 3 * hidden) for _ in range(2)], [table(hidden, 3 * hidden) for _ in range(2)],
                   table(2 * hidden, len(languages)), np.zeros(len(languages), np.float32))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def run_direction(inputs: np.ndarray, state: np.ndarray, codes: np.ndarray, order: range, keep: bool = False):
    """States (time, lane, H) of one direction; with keep also what the backward pass needs."""
    h_size = state.shape[0]
    lanes = codes.shape[1]
    h = np.zeros((lanes, h_size), np.float32)
    states = np.empty((*codes.shape, h_size), np.float32)
    saved = []
    for t in order:
        x = inputs[codes[t]]
        u = h @ state
        gates = sigmoid(x[:, :2 * h_size] + u[:, :2 * h_size])
        z, r = gates[:, :h_size], gates[:, h_size:]
        n = np.tanh(x[:, 2 * h_size:] + r * u[:, 2 * h_size:])
        if keep:
            saved.append((t, h, gates, n, u[:, 2 * h_size:]))
        h = n + z * (h - n)
        states[t] = h
    return (states, saved) if keep else states


def probabilities(net: Network, codes: np.ndarray) -> np.ndarray:
    """(time, lane, language) for windows of bytes (time, lane)."""
    steps = range(len(codes))
    forward = run_direction(net.inputs[0], net.state[0], codes, steps)
    backward = run_direction(net.inputs[1], net.state[1], codes, steps[::-1])
    h = net.state[0].shape[0]
    logits = forward.reshape(-1, h) @ net.out[:h] + backward.reshape(-1, h) @ net.out[h:] + net.bias
    logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=1, keepdims=True)
    return logits.reshape(*codes.shape, -1)


def gradients(net: Network, codes: np.ndarray, lengths: np.ndarray, target: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean loss over bytes, and its gradient by backpropagation through time."""
    time, lanes = codes.shape
    h = net.state[0].shape[0]
    steps = range(time)
    runs = [run_direction(net.inputs[0], net.state[0], codes, steps, True), run_direction(net.inputs[1], net.state[1], codes, steps[::-1], True)]
    both = np.concatenate([runs[0][0], runs[1][0]], axis=2)
    logits = both @ net.out + net.bias
    logits -= logits.max(axis=2, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(axis=2, keepdims=True)
    mask = (np.arange(time)[:, None] < lengths[None, :]).astype(np.float32)
    weight = mask / mask.sum()
    loss = -float((np.log(p[:, np.arange(lanes), target] + 1e-9) * weight).sum())
    p[:, np.arange(lanes), target] -= 1
    p *= weight[:, :, None]
    d_out = both.reshape(-1, 2 * h).T @ p.reshape(-1, p.shape[2])
    d_both = p @ net.out.T
    d_inputs, d_state = [], []
    for d, (_, saved) in enumerate(runs):
        g_in, g_state = np.zeros_like(net.inputs[d]), np.zeros_like(net.state[d])
        carry = np.zeros((lanes, h), np.float32)
        for t, before, gates, n, u_new in reversed(saved):
            dh = carry + d_both[t, :, d * h:(d + 1) * h]
            z, r = gates[:, :h], gates[:, h:]
            d_n = dh * (1 - z) * (1 - n * n)
            d_z = dh * (before - n) * z * (1 - z)
            d_r = d_n * u_new * r * (1 - r)
            d_x = np.concatenate([d_z, d_r, d_n], axis=1)
            d_u = np.concatenate([d_z, d_r, d_n * r], axis=1)
            np.add.at(g_in, codes[t], d_x)
            g_state += before.T @ d_u
            carry = dh * z + d_u @ net.state[d].T
        d_inputs.append(g_in)
        d_state.append(g_state)
    return loss, [*d_inputs, *d_state, d_out, p.sum(axis=(0, 1))]


def train(languages: list[str], windows: list[bytes], target: np.ndarray, steps: int = STEPS) -> Network:
    """Adam over random batches with equal shares of each language."""
    net = new_network(languages)
    rng = np.random.default_rng(SEED + 1)
    codes, lengths = lay_out(windows)
    rows = [np.flatnonzero(target == k) for k in range(len(languages))]
    values = net.parameters()
    first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    for step in range(1, steps + 1):
        at = np.concatenate([rng.choice(r, BATCH // len(rows) + 1) for r in rows])
        _, slopes = gradients(net, codes[:, at], lengths[at], target[at])
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        for v, g, a, b in zip(values, slopes, first, second):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            v -= (rate * (a / (1 - 0.9 ** step)) / (np.sqrt(b / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
    return net


def lay_out(windows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes (time, lane), padded with 0, and the windows' lengths."""
    lengths = np.array([len(w) for w in windows], np.int64)
    codes = np.frombuffer(b"".join(w.ljust(WINDOW, b"\0") for w in windows), np.uint8).reshape(-1, WINDOW)
    return np.ascontiguousarray(codes.T), lengths


def windows_of(doc_id: str, text: str, count: int) -> list[bytes]:
    """Windows at places that a hash of the id picks from the whole text."""
    data = text.encode()
    last = max(0, len(data) - WINDOW)
    places = {xxhash.xxh3_64_intdigest(f"{doc_id}/{i}") % (last + 1) for i in range(count)}
    return [data[p:p + WINDOW] for p in sorted(places)]


def fit(docs: DataFrame, usable: Column) -> Network:
    """Learn from the documents (doc_id, text, lang) that are usable and labelled."""
    spark = docs.sparkSession
    small_batches(spark)
    labelled = docs.where(usable & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "lang")
    languages = sorted(r["lang"] for r in labelled.select("lang").distinct().limit(SAMPLE_DOCS).collect())
    if len(languages) < 2:
        return new_network(languages)
    each = max(1, SAMPLE_DOCS // len(languages))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    salted = labelled.withColumn("salt", F.pmod(F.xxhash64("doc_id", F.lit("salt")), F.lit(SALTS)))
    some = salted.withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("place") <= -(-4 * each // SALTS))
    few = some.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("place") <= each)
    ids = few.select("doc_id", "lang").distinct()
    ids = spark.createDataFrame(ids.collect(), "doc_id long, lang string")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id").select("doc_id", "lang", "text")

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = [(lang, w) for i, lang, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts_of(part.column(2)))
                        if has_letter(t) for w in windows_of(str(i), t, WINDOWS_EACH)]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], names=["lang", "window"])

    found = sorted((r["lang"], bytes(r["window"])) for r in texts.mapInArrow(pick, "lang string, window binary").collect())
    known = sorted({lang for lang, _ in found})
    if len(known) < 2:
        return new_network(known or languages)
    return train(known, [w for _, w in found], np.array([known.index(lang) for lang, _ in found]))


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def label_texts(net: Network, texts: list[str]) -> np.ndarray:
    """Mean distribution over the bytes of each whole text (text, language); zeros for empty texts."""
    data = [t.encode() for t in texts]
    windows = [-(-len(d) // WINDOW) for d in data]
    codes, lengths = lay_out([d[i:i + WINDOW] for d in data for i in range(0, len(d), WINDOW)])
    owner = np.repeat(np.arange(len(texts)), windows)
    sums = np.zeros((len(texts), len(net.languages)))
    for start in range(0, codes.shape[1], LANES):
        part = slice(start, start + LANES)
        p = probabilities(net, codes[:, part])
        short = np.flatnonzero(lengths[part] < WINDOW)
        p[:, short] *= (np.arange(WINDOW)[:, None] < lengths[part][short]).astype(np.float32)[:, :, None]
        np.add.at(sums, owner[part], p.sum(axis=0))
    return sums / np.maximum([len(d) for d in data], 1)[:, None]


def identify(docs: DataFrame, net: Network, text: str = "text", drop_text: bool = True) -> DataFrame:
    """The documents with lang_pred and score (the mean share of the predicted language)."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def make():
        own = shared.value
        names = [*own.languages, UNKNOWN]

        def work(texts: list[str]) -> list:
            spoken = np.array([bool(own.languages) and has_letter(t) for t in texts], bool)
            if len(own.languages) < 2:
                best, score = np.zeros(len(texts), int), np.ones(len(texts))
            else:
                p = label_texts(own, texts)
                best, score = p.argmax(axis=1), p.max(axis=1)
            best = np.where(spoken, best, len(names) - 1)
            return [pa.array([names[k] for k in best], pa.string()), np.clip(np.where(spoken, score, 0.0), 0, 1)]
        return work

    return map_texts(docs, "lang_pred string, score double", make, text, drop_text)
