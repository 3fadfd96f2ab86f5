"""Operator 7: toxic passages by maximum-scoring segments.

Tokens get log-odds between toxic and clean training documents, with a Dirichlet prior in proportion to the token's rate in
both; a token that is unknown or too rare takes the log-odds of its longest known prefix, counted over other such tokens.
Tokens without clear and high positive odds cost a small constant. A linear scan over a document finds all maximal segments
of positive sum; extreme-value statistics of such segments (scale from the clean training tokens) turn their scores and the
document's length into one figure, and a logistic curve fitted on the training documents turns that into the score.

The model learns from a bounded sample: at most SAMPLE_TOXIC and SAMPLE_CLEAN labelled documents, one of each group that
shares its least shingle hash (so that copies count once). Every document is scored over its whole text.

Null texts count as empty and get the score of no evidence. Without labels of both kinds every score is the share of toxic
labels (0 without any). A document with several labels counts as toxic if one says so. Repeated rows give repeated
results, an empty table an empty one; a new column replaces an input column of its name, others stay.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchloom.llm.common import map_texts, slices, small_batches, texts_of

#: Bounds of the training sample and of the model's table.
SAMPLE_TOXIC, SAMPLE_CLEAN, MODEL_TOKENS = 4000, 8000, 50_000
#: Prior strength in documents; least z-score, log-odds and documents of a scoring token; the cost of other tokens.
PRIOR, LEAST_Z, LEAST_ODDS, LEAST_DOCS, COST = 100.0, 4.0, 2.0, 6, 0.1
PREFIXES = (8, 7, 6, 5, 4)
#: Evidence beyond these bounds counts as the bound on the logistic curve.
EVIDENCE = (-10.0, 40.0)
#: Factor of the expected number of chance segments, and the largest share of such a one that counts as significant.
CHANCE, SIGNIFICANT = 0.1, 0.05
THRESHOLD = 0.7
WORD = re.compile(r"\w+")


@dataclass
class Model:
    """Scores of tokens and prefixes, the scale of chance segments and the logistic curve."""

    tokens: dict[str, float] = field(default_factory=dict)
    prefixes: dict[str, float] = field(default_factory=dict)
    scale: float = 1.0
    slope: float = 0.0
    offset: float = -50.0

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * np.clip(evidence, *EVIDENCE) + self.offset, -50, 50)))


class Weights(dict):
    """Token -> score; unknown tokens fall back on their prefixes and are remembered."""

    def __init__(self, model: Model) -> None:
        super().__init__(model.tokens)
        self.prefixes, self.first = model.prefixes, dict(model.tokens)

    def __missing__(self, token: str) -> float:
        value = -COST
        for n in PREFIXES:
            if len(token) > n and token[:n] in self.prefixes:
                value = self.prefixes[token[:n]]
                break
        if len(token) <= 40:
            self[token] = value
        return value

    def trim(self, limit: int = 500_000) -> None:
        if len(self) > limit:
            self.clear()
            self.update(self.first)


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, sum), found in one pass.

    Each run from one positive token up to the next is joined to earlier candidates while that raises the sum: a candidate
    is merged with the latest one whose left total is smaller, if that one's right total is smaller too. Each candidate keeps a
    link to that one, so no list is walked twice and the scan is linear.
    """
    found: list[tuple[int, int, float, float]] = []  # first, last, total left of it, total at its end
    link: list[int] = []  # the latest earlier candidate whose left total is smaller; those between need not be looked at again
    total, before = 0.0, 0
    for i in np.flatnonzero(scores > 0).tolist():
        left = total + float(scores[before:i].sum())
        total = left + float(scores[i])
        before = i + 1
        first, low, high = i, left, total
        j = len(found) - 1
        while j >= 0 and found[j][2] >= low:
            j = link[j]
        while j >= 0 and found[j][3] < high:
            first, low = found[j][0], found[j][2]
            above = link[j]
            del found[j:], link[j:]
            j = above
        found.append((first, i, low, high))
        link.append(j)
    return [(a, b, high - low) for a, b, low, high in found]


_factorials = np.zeros(1)


def _log_factorials(n: int) -> np.ndarray:
    """ln r! for r from 1 to n, from a table that grows."""
    global _factorials
    if n >= len(_factorials):
        _factorials = np.cumsum(np.log(np.maximum(np.arange(max(n + 1, 2 * len(_factorials))), 1)))
    return _factorials[1:n + 1]


def evidence(scores: np.ndarray, scale: float) -> tuple[float, list[tuple[int, int, float]]]:
    """The figure of a document's best number of its highest segments, any up to all, and its significant segments."""
    n = max(1, len(scores))
    found = segments(scores)
    base = math.log(CHANCE * n)
    best = -base
    if found:
        sums = scale * np.cumsum(np.sort([s for _, _, s in found])[::-1])
        best = float((sums - np.arange(1, len(found) + 1) * base + _log_factorials(len(found))).max())
    limit = (base - math.log(SIGNIFICANT)) / scale
    return (best if found else min(0.0, -base)), [x for x in found if x[2] >= limit]


def chance_scale(positive: dict[float, int], tokens: int) -> float:
    """The scale at which a clean token's exponentiated score has mean 1; unseen kinds count half a time."""
    values = np.array(list(positive)) if positive else np.array([8.0])
    counts = np.array([positive[v] for v in positive], float) if positive else np.array([0.5])
    shares = counts / (tokens + 1.0)
    low, high = 1e-3, 20.0
    while high - low > 1e-4:
        x = (low + high) / 2
        mean = float((shares * np.exp(np.minimum(x * values, 600))).sum()) + (1 - shares.sum()) * math.exp(-x * COST)
        low, high = (low, x) if mean > 1 else (x, high)
    return low


def _words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def _least_shingle(words: list[str]) -> int:
    """The least hash of the runs of five words: equal for most near copies."""
    if len(words) < 5:
        return xxhash.xxh3_64_intdigest(" ".join(words)) >> 1
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    run = h[:-4].copy()
    for i in range(1, 5):
        run = run * np.uint64(0x9E3779B97F4A7C15) + h[i:len(h) - 4 + i]
    run ^= run >> np.uint64(29)
    return int((run * np.uint64(0xBF58476D1CE4E5B9)).min() >> np.uint64(1))


def _sample(labels: DataFrame, usable: Column) -> DataFrame:
    """At most so many labelled ids of each kind, in the order of a hash."""
    one = labels.where(usable & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    return one.where("toxic = 1").orderBy(*order).limit(SAMPLE_TOXIC).unionAll(one.where("toxic != 1").orderBy(*order).limit(SAMPLE_CLEAN))


def fit(docs: DataFrame, labels: DataFrame, usable: Column) -> Model:
    """Learn from labels (doc_id, toxic) whose rows are usable, and the texts of docs (doc_id, text)."""
    spark = docs.sparkSession
    small_batches(spark)
    chosen = _sample(labels.select("doc_id", "toxic"), usable).collect()
    kind = {r["doc_id"]: int(r["toxic"] == 1) for r in chosen}
    if len(set(kind.values())) < 2:
        return _constant(sum(kind.values()), len(kind) - sum(kind.values()))
    ids = spark.createDataFrame([(i,) for i in kind], "doc_id long")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id")

    least = map_texts(texts, "least long", lambda: lambda ts: [np.array([_least_shingle(_words(t)) for t in ts], np.int64)])
    groups = {r["least"]: r["doc_id"] for r in least.orderBy(F.desc("doc_id")).collect()}
    kept = sorted(set(groups.values()))
    kinds = spark.createDataFrame([(i, kind[i]) for i in kept], "doc_id long, toxic int")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(kinds), "doc_id")
    n1 = sum(kind[i] for i in kept)
    n0 = len(kept) - n1
    if not n1 or not n0:
        return _constant(n1, n0)

    counts = texts.select("toxic", "text").mapInArrow(_count_features, "feature string, whole boolean, toxic_docs long, clean_docs long")
    counts = counts.groupBy("feature", "whole").agg(F.sum("toxic_docs").alias("y1"), F.sum("clean_docs").alias("y0"))
    # the same odds as in _odds, to leave most features where they are
    prior = (F.col("y1") + F.col("y0")) * (PRIOR / (n1 + n0))
    odds = lambda y, n: F.log((F.col(y) + prior) / (n + PRIOR - F.col(y) - prior))
    scored = counts.where(F.col("y1") + F.col("y0") >= LEAST_DOCS).withColumn("odds", odds("y1", n1) - odds("y0", n0))
    scored = scored.withColumn("z", F.col("odds") / F.sqrt(1 / (F.col("y1") + prior) + 1 / (F.col("y0") + prior)))
    scored = scored.where((F.col("z") >= LEAST_Z) & (F.col("odds") >= LEAST_ODDS))
    found = scored.orderBy(F.desc("z"), "feature", "whole").limit(MODEL_TOKENS).select("feature", "whole", "y1", "y0", "odds").collect()
    model = Model(tokens={r["feature"]: r["odds"] for r in found if r["whole"]})
    held: dict[str, tuple[int, int]] = {}
    for r in found:
        for n in PREFIXES if r["whole"] else ():
            if len(r["feature"]) > n:
                a, b = held.get(r["feature"][:n], (0, 0))
                held[r["feature"][:n]] = a + r["y1"], b + r["y0"]
    for r in found:
        if not r["whole"]:
            a, b = held.get(r["feature"], (0, 0))
            y1, y0 = max(0, r["y1"] - a), max(0, r["y0"] - b)
            value, z = _odds(y1, y0, n1, n0)
            if y1 + y0 >= LEAST_DOCS and z >= LEAST_Z and value >= LEAST_ODDS:
                model.prefixes[r["feature"]] = value
    return _calibrate(model, texts)


def _constant(toxic: int, clean: int) -> Model:
    """No evidence to learn from: the share of toxic labels for every text, 0 without labels."""
    return Model(offset=math.log(max(toxic, 1e-20) / max(clean, 1e-20)) if toxic else -50.0)


def _odds(y1: int, y0: int, n1: int, n0: int) -> tuple[float, float]:
    """Log-odds and z-score of a feature that y1 of n1 toxic and y0 of n0 clean documents hold."""
    prior = (y1 + y0) * PRIOR / (n1 + n0)
    if not prior:
        return 0.0, 0.0
    value = math.log((y1 + prior) / (n1 + PRIOR - y1 - prior)) - math.log((y0 + prior) / (n0 + PRIOR - y0 - prior))
    return value, value / math.sqrt(1 / (y1 + prior) + 1 / (y0 + prior))


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each kind that hold a token, or a token with a prefix; sums of what the task has read."""
    seen: dict[tuple[str, bool], list[int]] = {}

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([
            pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.bool_()),
            pa.array([v[0] for v in seen.values()], pa.int64()), pa.array([v[1] for v in seen.values()], pa.int64())],
            names=["feature", "whole", "toxic_docs", "clean_docs"])

    for batch in batches:
        for part in slices(batch, "text"):
            for toxic, text in zip(part.column(0).to_pylist(), texts_of(part.column(1))):
                words = {w for w in _words(text) if len(w) <= 40}
                features = {(w, True) for w in words} | {(w[:n], False) for w in words for n in PREFIXES if len(w) > n}
                for f in features:
                    seen.setdefault(f, [0, 0])[1 - toxic] += 1
            if len(seen) > 400_000:
                yield out()
                seen.clear()
    yield out()


def _calibrate(model: Model, texts: DataFrame) -> Model:
    """The scale from clean tokens, then the logistic curve over the sample's documents."""
    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = Weights(model)
        for batch in batches:
            for part in slices(batch, "text"):
                rows = [np.fromiter(map(weights.__getitem__, _words(t)), float) for t in texts_of(part.column(1))]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(r) for r in rows], pa.int64()), pa.array([r[r > 0].round(3).tolist() for r in rows], pa.list_(pa.float64()))],
                    names=["toxic", "n", "hits"])
                weights.trim()

    hits = texts.select("toxic", "text").mapInArrow(tally, "toxic int, n long, hits array<double>").where("toxic = 0")
    tokens = hits.agg(F.sum("n")).first()[0] or 0
    positive = {r["s"]: r["c"] for r in hits.select(F.explode("hits").alias("s")).groupBy("s").agg(F.count("*").alias("c")).collect()}
    model.scale = chance_scale(positive, tokens)

    found = map_texts(texts, "evidence double", lambda: _evidence_of(model)).select("toxic", "evidence").collect()
    x = np.clip([r["evidence"] for r in found], *EVIDENCE)
    y = np.array([r["toxic"] for r in found], float)
    model.slope, model.offset = logistic(x, y)
    return model


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-5) -> tuple[float, float]:
    """Slope and offset of the logistic curve of least loss, by Newton's steps on scaled values."""
    centre, spread = x.mean(), x.std() + 1e-9
    a = np.column_stack([(x - centre) / spread, np.ones(len(x))])
    w = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a / len(x) + ridge * np.eye(2)
        step = np.linalg.solve(h, a.T @ (p - y) / len(x) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    slope = max(0.0, float(w[0] / spread))
    return slope, float(w[1] - slope * centre)


def _evidence_of(model: Model):
    weights = Weights(model)

    def work(texts: list[str]) -> list:
        out = [evidence(np.fromiter(map(weights.__getitem__, _words(t)), float), model.scale)[0] for t in texts]
        weights.trim()
        return [np.array(out)]
    return work


def score(docs: DataFrame, model: Model, text: str = "text", drop_text: bool = True, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with score, predicted and passages (first and last token, sum) of significant segments."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own = shared.value
        weights = Weights(own)

        def work(texts: list[str]) -> list:
            found = [evidence(np.fromiter(map(weights.__getitem__, _words(t)), float), own.scale) for t in texts]
            weights.trim()
            scores = own.score(np.array([e for e, _ in found]))
            passages = [[{"first": a, "last": b, "sum": s} for a, b, s in p] for _, p in found]
            kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("sum", pa.float64())]))
            return [scores, (scores >= threshold).astype(np.int32), pa.array(passages, kind)]
        return work

    return map_texts(docs, "score double, predicted int, passages array<struct<first:long,last:long,sum:double>>", make, text, drop_text)
