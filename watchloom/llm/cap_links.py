"""Operator 5: links between embeddings of a high cosine, by spherical-cap filters.

A filter is a direction made of one codeword from each of two small random codebooks, after one of TURNS fixed rotations; a
unit vector belongs to every filter whose direction it exceeds by a threshold, and at least to its LEAST best ones of each
rotation (its cap is then wider). Because a direction is a sum of codewords, a vector lists its filters by decoding (best
words of one half against best words of the other) without trying all of them. Vectors of one label meet on equal
filters; what meets is verified in double precision. Threshold and codebook size follow from the number of vectors, so that
a filter holds few unrelated vectors and a linked pair is expected to share SHARED filters.

Equal vectors of a label are one node with a weight. Nodes of one best filter near their mean form a ball: within half the
link's angle of the centre, so all in it are linked. Two balls are linked as a whole, or not at all, where their radii say
so; only other pairs of balls are compared vector by vector. So a large group of near copies costs the square of its few
balls, not of its members, and no pair within a group is written.

Vectors that are null, empty, zero or hold null or non-finite components, and rows without label, link with nothing: no links,
their own component. Vectors of different lengths do not link. Rows that share a vec_id count as vectors of their own.
An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchloom.llm.common import components, written

TURNS, SHARED, LEAST, OCCUPANTS, SEED = 3, 18.0, 10, 2.0, 20_011
SLACK = 1e-9


def _tail(t: float) -> float:
    return 0.5 * math.erfc(t / math.sqrt(2))


def plan(vectors: int, cosine: float) -> tuple[float, int]:
    """(threshold, codewords of a half) for so many vectors of one label."""
    p = min(0.01, OCCUPANTS / max(vectors, 1))
    low, high = 0.0, 12.0
    while high - low > 1e-6:
        t = (low + high) / 2
        low, high = (t, high) if _tail(t) > p else (low, t)
    x = np.linspace(low, low + 6, 2000)
    density = np.exp(-x * x / 2)
    other = np.array([_tail((low - cosine * v) / math.sqrt(1 - cosine * cosine)) for v in x])
    both = float((density * other).sum() / density.sum()) * p
    return low, max(2, math.ceil(math.sqrt(SHARED / TURNS / both)))


def codebooks(dim: int, words: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """A rotation and words x dim random codewords for each turn; a half uses its own coordinates of both."""
    rng = np.random.default_rng(SEED + dim)
    return [(np.linalg.qr(rng.standard_normal((dim, dim)))[0], rng.standard_normal((words, dim))) for _ in range(TURNS)]


def list_decode(unit: np.ndarray, books: list[tuple[np.ndarray, np.ndarray]], t: float) -> tuple[list[np.ndarray], np.ndarray]:
    """Of each unit vector: all filters of its caps, and its best filter of the first turn."""
    half, k = unit.shape[1] // 2, len(books[0][1])
    lists: list[list[np.ndarray]] = [[] for _ in unit]
    best = np.zeros(len(unit), np.int64)
    few = min(LEAST, k)
    for turn, (rotation, words) in enumerate(books):
        turned = unit @ rotation
        lefts, rights = turned[:, :half] @ words[:, :half].T, turned[:, half:] @ words[:, half:].T
        for i in range(len(unit)):
            left, right = lefts[i], rights[i]
            top = np.partition(left, k - few)[k - few:], np.partition(right, k - few)[k - few:]
            sums = np.add.outer(*top).ravel()
            own = min(t, float(np.partition(sums, len(sums) - few)[len(sums) - few]) - 1e-12)
            near, also = np.flatnonzero(left >= own - top[1].max()), np.flatnonzero(right >= own - top[0].max())
            a, b = np.nonzero(np.add.outer(left[near], right[also]) >= own)
            lists[i].append((turn * k + near[a]) * k + also[b])
            if not turn:
                best[i] = int(left.argmax()) * k + int(right.argmax())
    return [np.concatenate(x) for x in lists], best


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def angle(a: str, b: str) -> Column:
    cosine = dot(a, b)
    return F.when(cosine.isNotNull(), F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))


def link(vectors: DataFrame, cosine: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of (vec_id, label, embedding)."""
    plain = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    e = F.col("embedding")
    fit = F.col("label").isNotNull() & e.isNotNull() & (F.size(e) >= 1) & F.forall(e, plain) & F.exists(e, lambda x: x != 0)
    # vectors of one component have a sign only
    unit = F.when(F.size(e) == 1, F.transform(e, lambda x: F.signum(x))).otherwise(e).cast(vectors.schema["embedding"].dataType)
    rows = vectors.select("vec_id", "label", F.when(F.coalesce(fit, F.lit(False)), unit).otherwise(e).alias("embedding")).withColumn("node", F.when(F.coalesce(fit, F.lit(False)), F.xxhash64("label", "embedding")))
    nodes = rows.where("node IS NOT NULL").groupBy("node", "label", "embedding").agg(F.count("*").alias("weight"))
    lists = written(_listed(nodes, cosine), "cap-lists")

    half = math.acos(cosine) / 2 - SLACK
    balls_of, balls = _balls(lists, half)
    full, single = _ball_links(balls_of, balls, cosine)

    weight_full = full.select(F.col("x").alias("ball"), F.col("wy").alias("w")).unionAll(full.select(F.col("y").alias("ball"), F.col("wx").alias("w")))
    weight_full = weight_full.groupBy("ball").agg(F.sum("w").alias("w_full"))
    weight_single = single.select(F.col("a").alias("node"), F.col("wb").alias("w")).unionAll(single.select(F.col("b").alias("node"), F.col("wa").alias("w")))
    weight_single = weight_single.groupBy("node").agg(F.sum("w").alias("w_single"))
    edges = full.select(F.col("x").alias("a"), F.col("y").alias("b")).unionAll(single.select("a", "b")).unionAll(
        balls_of.where("ball != node").select(F.col("node").alias("a"), F.col("ball").alias("b")))
    groups = components(edges).withColumnRenamed("component", "root")

    per_node = (balls_of.select("node", "ball")
                .join(balls.select("ball", "weight"), "ball").join(weight_full, "ball", "left").join(weight_single, "node", "left")
                .join(groups, "node", "left")
                .select("node", F.coalesce("root", "node").alias("root"),
                        (F.col("weight") - 1 + F.coalesce("w_full", F.lit(0)) + F.coalesce("w_single", F.lit(0))).alias("n_links")))
    rows = rows.select("vec_id", "node").join(per_node, "node", "left")
    least = rows.where("node IS NOT NULL").groupBy("root").agg(F.min("vec_id").alias("least"))
    return rows.join(least, "root", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("least", "vec_id").alias("component_id"),
        (F.col("vec_id") == F.coalesce("least", "vec_id")).alias("kept"))


def _listed(nodes: DataFrame, cosine: float) -> DataFrame:
    """node, label, weight, unit vector, its filters and its best filter."""
    most = nodes.groupBy("label").count().agg(F.max("count")).first()[0] or 1
    t, words = plan(most, cosine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books: dict[int, list] = {}
        for batch in batches:
            kept, raw = batch.select(["node", "label", "weight"]), batch.column("embedding").to_pylist()
            sizes = np.array([len(v) for v in raw])
            for dim in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dim)
                x = np.array([raw[i] for i in at], np.float64)
                x /= np.abs(x).max(axis=1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                if dim == 1:
                    best = (x[:, 0] > 0).astype(np.int64)
                    found = list(best[:, None])
                else:
                    if dim not in books:
                        books[dim] = codebooks(dim, words)
                    found, best = list_decode(x, books[dim], t)
                base = dim << 44
                filters = pa.ListArray.from_arrays(
                    pa.array(np.append(0, np.cumsum([len(f) for f in found])), pa.int32()), pa.array(np.concatenate(found) + base, pa.int64()))
                unit = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, dim), pa.int32()), pa.array(x.ravel()))
                own = kept.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*own.columns, unit, filters, pa.array(best + base)],
                                                 names=["node", "label", "weight", "unit", "filters", "best"])

    label = nodes.schema["label"].dataType.simpleString()
    return nodes.mapInArrow(run, f"node long, label {label}, weight long, unit array<double>, filters array<long>, best long")


def _balls(lists: DataFrame, half: float) -> tuple[DataFrame, DataFrame]:
    """(node, ball, label, weight, unit, filters) and (ball, weight, centre, radius)."""
    dim = lists.agg(F.max(F.size("unit"))).first()[0] or 0
    sums = [F.sum(F.get("unit", F.lit(i))).alias(f"s{i}") for i in range(dim)]
    means = lists.groupBy("label", "best").agg(F.count("*").alias("members"), *sums).where("members > 1")
    means = means.select("label", "best", F.filter(F.array(*[f"s{i}" for i in range(dim)]), lambda s: s.isNotNull()).alias("sums"))
    length = F.sqrt(dot("sums", "sums"))
    means = means.withColumn("length", length).where("length > 1e-6").select(
        "label", "best", F.transform("sums", lambda s: s / F.col("length")).alias("centre"))
    near = lists.join(means, ["label", "best"], "left").withColumn("off", angle("unit", "centre"))
    inside = F.coalesce(F.col("off") <= half, F.lit(False))
    placed = near.withColumn("inside", inside).select(
        "node", "label", "weight", "unit", "filters", F.when(F.col("inside"), F.xxhash64("label", "best", F.lit("ball"))).otherwise(F.col("node")).alias("ball"),
        F.when(F.col("inside"), F.col("centre")).otherwise(F.col("unit")).alias("centre"),
        F.when(F.col("inside"), F.col("off")).otherwise(0.0).alias("off"))
    placed = written(placed, "cap-members")
    balls = placed.groupBy("ball").agg(F.sum("weight").alias("weight"), F.max("off").alias("radius"), F.any_value("centre").alias("centre"))
    return placed.drop("centre", "off"), written(balls, "cap-balls")


def _ball_links(members: DataFrame, balls: DataFrame, cosine: float) -> tuple[DataFrame, DataFrame]:
    """Pairs of balls linked as a whole (x, y, weights), and linked nodes (a, b, weights) of the other pairs."""
    theta = math.acos(cosine)
    met = members.select("label", "ball", F.explode("filters").alias("filter")).distinct()
    pairs = met.select("label", "filter", F.col("ball").alias("x")).join(
        met.select("label", "filter", F.col("ball").alias("y")), ["label", "filter"]).where("x < y").select("x", "y").distinct()
    x = balls.select(F.col("ball").alias("x"), F.col("weight").alias("wx"), F.col("radius").alias("rx"), F.col("centre").alias("cx"))
    y = balls.select(F.col("ball").alias("y"), F.col("weight").alias("wy"), F.col("radius").alias("ry"), F.col("centre").alias("cy"))
    seen = pairs.join(x, "x").join(y, "y").select("x", "y", "wx", "wy", (F.col("rx") + F.col("ry")).alias("r"), angle("cx", "cy").alias("d"))
    seen = written(seen.where(F.col("d") - F.col("r") <= theta + SLACK), "cap-pairs")
    whole = F.col("d") + F.col("r") <= theta - SLACK
    full = seen.where(whole).select("x", "y", "wx", "wy")
    a = members.select(F.col("ball").alias("x"), F.col("node").alias("a"), F.col("weight").alias("wa"), F.col("unit").alias("ua"))
    b = members.select(F.col("ball").alias("y"), F.col("node").alias("b"), F.col("weight").alias("wb"), F.col("unit").alias("ub"))
    single = seen.where(~whole).select("x", "y").join(a, "x").join(b, "y").where(dot("ua", "ub") >= cosine).select("a", "b", "wa", "wb")
    return full, written(single, "cap-links")
