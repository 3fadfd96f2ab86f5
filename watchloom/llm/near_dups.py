"""Operator 10: near-duplicate documents by DartMinHash signatures.

A text is the multiset of its runs of five lower-case words; the similarity of two texts is weighted Jaccard, the sum of
the smaller weights over the sum of the larger ones. Darts are thrown into the region of each element (its weight times
time): each strip of unit weight has its own sequence of hits at exponential gaps, all from hashes of the element, so
that two texts see the same darts wherever their regions overlap. A dart names one of COORDINATES coordinates, and the
earliest dart of each is kept; equal entries of two signatures have the probability of the similarity. Only strips whose
next dart comes before a text's time limit are looked at, so a long text costs little more than one pass over its words.

Signatures are cut into bands; texts that share a band are candidates. Equal texts are one node. In each band value the
least node is compared with all others (a star); pairs that pass join components. What then still lies in different components
of one band value is cut into blocks of BLOCK nodes; a task gets two blocks, compares them by a matrix product over their
strips and gives only the links that join components. So no link between components is lost that shares a band, no task
holds a whole group, and no group's pairs are written. Every link passes by the exact similarity of the whole texts.

Texts of fewer than five words are one run of all their words; texts without words are equal to one another. Null texts
count as empty. Rows that share a doc_id are documents of their own. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchloom.llm.common import components, held, map_texts, mix64, slices, small_batches, texts_of, written

WORDS, SIMILAR = 5, 0.8
BANDS, ROWS = 24, 5
COORDINATES = BANDS * ROWS
#: Share of a signature that must agree before two texts are compared exactly: 5.5 deviations under SIMILAR.
SIGNATURE_SHARE = 0.6
#: Nodes of a block, and strips that are multiplied at a time, where blocks are compared.
BLOCK, COLUMNS = 256, 4096
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """Word -> 64-bit hash, remembered."""

    def __missing__(self, word: str) -> int:
        value = xxhash.xxh3_64_intdigest(word.encode())
        if len(word) <= 40:
            self[word] = value
        return value

    def trim(self, limit: int = 600_000) -> None:
        if len(self) > limit:
            kept = list(self.items())[: limit // 2]
            self.clear()
            self.update(kept)


def name_of(words: list[str]) -> int:
    """The hash by which texts of the same words are one node."""
    return xxhash.xxh3_64_intdigest(" ".join(words).encode())


def strips(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all strips of unit weight, flat and sorted by element within a text; how many each text has; text hashes.

    The k-th occurrence of an element is its k-th strip, so that equal weights give equal strips.
    """
    words: list[str] = []
    n_words = np.zeros(len(texts), np.int64)
    names = np.zeros(len(texts), np.uint64)
    for i, text in enumerate(texts):
        own = text.lower().split()
        n_words[i] = len(own)
        names[i] = name_of(own)
        words += own
    hashes = held(("words",), WordHashes)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    hashes.trim()
    counts = np.where(n_words >= WORDS, n_words - WORDS + 1, np.minimum(n_words, 1))
    starts = np.cumsum(n_words) - n_words
    ends = np.cumsum(counts)
    own = np.repeat(np.arange(len(texts)), counts)
    at = np.arange(int(counts.sum())) + np.repeat(starts - (ends - counts), counts)
    runs = np.zeros(len(at), np.uint64)
    last = (starts + n_words)[own]
    for k in range(WORDS):
        inside = at + k < last
        runs = runs * _MULTIPLIER + np.where(inside, w[np.minimum(at + k, max(len(w) - 1, 0))] if len(w) else 0, np.uint64(k + 1)).astype(np.uint64)
    runs = mix64(runs)
    for a, b in zip((ends - counts).tolist(), ends.tolist()):
        runs[a:b].sort()
    place = np.arange(len(runs))
    first = np.concatenate([[True], (runs[1:] != runs[:-1]) | (own[1:] != own[:-1])])[:len(runs)]
    occurrence = place - np.maximum.accumulate(np.where(first, place, 0)) if len(runs) else place
    repeated = occurrence > 0
    runs[repeated] = mix64(runs[repeated] ^ (occurrence[repeated].astype(np.uint64) * _MULTIPLIER), 3)
    return runs, counts, names.view(np.int64)


def signatures(runs: np.ndarray, counts: np.ndarray, k: int = COORDINATES) -> np.ndarray:
    """The earliest dart of each coordinate (text, k): time in the high half, dart in the low half. Zeros: no strips."""
    n = len(counts)
    out = np.full(n * k, np.iinfo(np.uint64).max, np.uint64)
    owner = np.repeat(np.arange(n), counts)
    limit = k * (np.log(k) + 3) / np.maximum(counts, 1)
    todo = counts > 0
    while todo.any():
        strip = np.flatnonzero(todo[owner])
        u, own = runs[strip], owner[strip]
        time = np.zeros(len(u))
        dart = 0
        while len(u):
            h = mix64(u, 10 + dart)
            time = time - np.log(((h >> np.uint64(11)).astype(np.float64) + 1) * 2.0 ** -53)
            hit = time < limit[own]
            u, own, time, h = u[hit], own[hit], time[hit], h[hit]
            g = mix64(h, 5)
            entry = (time.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | (g & np.uint64(0xFFFFFFFF))
            np.minimum.at(out, own * k + ((g >> np.uint64(32)) % np.uint64(k)).astype(np.int64), entry)
            dart += 1
        full = (out.reshape(n, k) != np.iinfo(np.uint64).max).all(axis=1)
        todo &= ~full
        limit = limit * 2
    out = out.reshape(n, k)
    out[counts == 0] = 0
    return out


def band_values(signature: np.ndarray) -> np.ndarray:
    """A hash of each band (text, BANDS)."""
    value = np.zeros((len(signature), BANDS), np.uint64)
    for r in range(ROWS):
        value = mix64(value ^ signature[:, r::ROWS][:, :BANDS], 20 + r)
    return mix64(value + np.arange(BANDS, dtype=np.uint64)[None, :], 40).view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard of two sorted arrays of distinct strips."""
    if not len(a) and not len(b):
        return 1.0
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def _signed(docs: DataFrame) -> DataFrame:
    """doc_id, row (its own number), node (hash of the words) and, once a task for a node, its bands and signature."""
    def make():
        seen: set[int] = set()
        number = iter(range(TaskContext.get().partitionId() << 40, 1 << 62))

        def work(texts: list[str]) -> list:
            runs, counts, names = strips(texts)
            new = np.zeros(len(texts), bool)
            for i, name in enumerate(names.tolist()):
                if name not in seen:
                    new[i] = True
                    seen.add(name)
            if len(seen) > 300_000:
                seen.clear()
            keep = np.repeat(new, counts)
            sig = signatures(runs[keep], counts[new])
            ends = np.append(0, np.cumsum(np.where(new, BANDS, 0))).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(band_values(sig).ravel()), mask=pa.array(~new))
            packed = iter((sig & np.uint64(0xFFFF)).astype("<u2"))
            return [[next(number) for _ in texts], names, bands, pa.array([next(packed).tobytes() if x else None for x in new], pa.binary())]
        return work

    return map_texts(docs, "row long, node long, bands array<long>, signature binary", make)


def _agree(a: str, b: str):
    """A map that keeps pairs whose 16-bit signatures (columns a and b) agree in enough coordinates."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, COORDINATES) for c in (a, b))
            yield batch.select(["a", "b"]).filter(pa.array((left == right).mean(axis=1) >= SIGNATURE_SHARE))
    return run


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        passed = [similarity(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")) >= SIMILAR
                  for x, y in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist())]
        yield batch.select(["a", "b"]).filter(pa.array(passed, pa.bool_()))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (least doc_id of the group), class_size and kept of every row of (doc_id, text).

    kept is true for one row of each class: the one with the least doc_id (of rows that share it, one).
    """
    return _classified(docs).drop("node")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents with all their columns, one row of each near-duplicate class."""
    kept = _classified(docs).where("kept").select(F.col("doc_id").alias("__id"), F.col("node").alias("__kept"))
    named = map_texts(docs, "__node long", lambda: lambda texts: [np.array([name_of(t.lower().split()) for t in texts], np.uint64).view(np.int64)], drop_text=False)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__node") == F.col("__kept"))
    return named.join(kept, same).dropDuplicates(["__id", "__kept"]).select(*[f"`{c}`" for c in docs.columns])


def _classified(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = written(_signed(docs), "near-signed")
    rows = written(_shared_bands(signed.where("bands IS NOT NULL").dropDuplicates(["node"])), "near-bands")
    sets = written(_sets(docs, signed, rows.select("node").distinct()), "near-sets")
    links = written(_verified_pairs(signed, sets, _star(rows)), "near-links")
    groups = components(links)
    more = written(_block_links(_open(rows, groups), sets), "near-links")
    if not more.isEmpty():
        groups = components(groups.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(more))
    return _classes(signed, groups)


def _shared_bands(nodes: DataFrame) -> DataFrame:
    """(band, node) of the band values that several nodes share."""
    rows = nodes.select("node", F.explode("bands").alias("band"))
    shared = rows.groupBy("band").agg(F.count("*").alias("n"), F.min("node").alias("hub")).where("n > 1")
    return rows.join(shared.select("band"), "band").select("band", "node")


def _star(rows: DataFrame) -> DataFrame:
    """Distinct pairs (a < b) of the least node of each band value with its other nodes."""
    hubs = rows.groupBy("band").agg(F.min("node").alias("a"))
    return rows.join(hubs, "band").where("a != node").select("a", F.col("node").alias("b")).distinct()


def _open(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """(band, node, component) of the band values whose nodes are not all in one component, without the least nodes:
    their stars have settled all their pairs."""
    placed = rows.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    several = placed.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("node").alias("hub")).where("low != high")
    return placed.join(several.select("band", "hub"), "band").where("node != hub").select("band", "node", "component")


def _sets(docs: DataFrame, signed: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, members): the sorted strips of the wanted nodes, from one text of each."""
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    one = signed.select("node", key.alias("k")).join(wanted, "node").groupBy("node").agg(F.min("k").alias("k"))

    def sets(texts: list[str]) -> list:
        runs, counts, names = strips(texts)
        ends = np.cumsum(counts).tolist()
        return [names, pa.array([np.sort(runs[x:y]).astype("<u8").tobytes() for x, y in zip([0, *ends], ends)], pa.binary())]

    texts = docs.select(key.alias("k"), "text").join(one.select("k").distinct(), "k").select("text")
    return map_texts(texts, "node long, members binary", lambda: sets).join(wanted, "node").dropDuplicates(["node"])


def _verified_pairs(signed: DataFrame, sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) that are similar: first by signatures, then by the whole multisets."""
    signature = signed.where("signature IS NOT NULL").select("node", "signature").dropDuplicates(["node"])
    met = pairs.join(signature.select(F.col("node").alias("a"), F.col("signature").alias("sa")), "a").join(
        signature.select(F.col("node").alias("b"), F.col("signature").alias("sb")), "b")
    likely = met.select("a", "b", "sa", "sb").mapInArrow(_agree("sa", "sb"), "a long, b long")
    full = likely.join(sets.select(F.col("node").alias("a"), F.col("members").alias("set_a")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("members").alias("set_b")), "b").select("a", "b", "set_a", "set_b")
    return full.mapInArrow(_verified, "a long, b long")


def _block_links(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) that join different components within a band value, from pairs of bounded blocks."""
    counts = rows.groupBy("band").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("blocks > 0")
    placed = rows.join(counts, "band").withColumn("own", F.pmod(F.xxhash64("node", "band"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("band", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "node", "component")
    return placed.join(sets, "node").groupBy("band", "x", "y").applyInArrow(_joining, "a long, b long")


def _joining(table: pa.Table) -> pa.Table:
    """Of a task's two blocks (or one): the links that join components, at most one for each component."""
    own = table["own"].to_numpy()
    left = np.flatnonzero(own == own.min())
    right = np.flatnonzero(own == own.max())
    component, node = table["component"].to_numpy(), table["node"].to_numpy()
    members = [np.frombuffer(m, "<u8") for m in table["members"].to_pylist()]
    lonely = own.min() == own.max() and table["x"][0].as_py() != table["y"][0].as_py()
    if lonely or (component == component[0]).all():
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    alike = matrix_similarity([members[i] for i in left], [members[i] for i in right]) >= SIMILAR
    root = {c: c for c in component.tolist()}

    def find(c: int) -> int:
        while root[c] != c:
            c = root[c]
        return c

    links = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(alike & (component[left][:, None] != component[right][None, :])))):
        a, b = find(int(component[left[i]])), find(int(component[right[j]]))
        if a != b:
            root[max(a, b)] = min(a, b)
            links.append((int(node[left[i]]), int(node[right[j]])))
    return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([x for _, x in links], pa.int64())})


def matrix_similarity(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Weighted Jaccard of all left with all right sets of strips, over the strips that both sides hold."""
    sizes = np.array([len(m) for m in left])[:, None] + np.array([len(m) for m in right])[None, :]
    common = np.zeros(sizes.shape, np.float32)
    shared = np.intersect1d(np.concatenate([*left, np.zeros(0, np.uint64)]), np.concatenate([*right, np.zeros(0, np.uint64)]))
    for start in range(0, len(shared), COLUMNS):
        columns = shared[start:start + COLUMNS]
        common += _held(left, columns) @ _held(right, columns).T
    return np.where(sizes > 0, common / np.maximum(sizes - common, 1), 1.0)


def _held(sets: list[np.ndarray], columns: np.ndarray) -> np.ndarray:
    """Row by set, column by strip: 1 where the set holds the strip."""
    out = np.zeros((len(sets), len(columns)), np.float32)
    for row, members in zip(out, sets):
        at = np.minimum(np.searchsorted(columns, members), len(columns) - 1)
        row[at[columns[at] == members]] = 1
    return out


def _classes(signed: DataFrame, groups: DataFrame) -> DataFrame:
    rows = signed.select("doc_id", "node", "row").join(groups, "node", "left")
    rows = rows.withColumn("class", F.coalesce("component", "node"))
    # written, so that both sides of the join are plain and a large class is split as a skewed key
    tops = written(rows.groupBy("class").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("top"), F.count("*").alias("class_size")), "near-classes")
    return rows.join(tops, "class").select("doc_id", "node", F.col("top.doc_id").alias("class_id"), "class_size", (F.col("row") == F.col("top.row")).alias("kept"))

