"""Operator 8: document fingerprints by invertible Bloom lookup sketches.

A paragraph is a line; a longer line counts as pieces of eight words. A sketch adds the digest of every paragraph (with its
occurrence, so that repeats differ) to three of its cells; a cell holds a count, the exclusive or of the digests and of their
checks. Two sketches of one size subtract cell by cell, what both hold vanishes, and peeling takes out the rest: a cell with
one digest names it, and removing it frees others. If cells are left over, both texts are sketched again four times
larger with other hashes, until peeling ends. The likeness of two texts is the share of digests both hold (Jaccard,
occurrences counted); the fingerprint is the smallest sketch as text.

Sketches of a batch are one flat array and are subtracted and peeled together. The next document in id order is found by
cutting the documents into ranges; the first document of a range also goes, as a guest, to the range before it.

Null texts count as empty; a text without paragraphs has an empty sketch, and two such texts have likeness 1. Null ids come
first in id order. Rows that share an id are ordered by text. A single document is its own next one. An empty table gives no
rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchloom.llm.common import mix64, range_counts, slices, small_batches, texts_of, with_bucket

#: Cells of the fingerprint, and hashes of a digest.
CELLS, HASHES = 24, 3
PARAGRAPH = re.compile(r"\s*(?:\S+[^\S\n]*){1,8}\n*|\s+")
LEAST = -(1 << 63)


def paragraph_digests(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit digests of all paragraphs of the texts, flat, and how many each text has."""
    counts = np.zeros(len(texts), np.int64)
    flat: list[int] = []
    for i, text in enumerate(texts):
        found = PARAGRAPH.findall(text)
        counts[i] = len(found)
        flat += map(xxhash.xxh3_64_intdigest, found)
    digests = np.array(flat, np.uint64)
    ends = np.cumsum(counts)
    for a, b in zip((ends - counts).tolist(), ends.tolist()):
        digests[a:b].sort()
    at = np.arange(len(digests))
    owner = np.repeat(np.arange(len(texts)), counts)
    first = np.concatenate([[True], (digests[1:] != digests[:-1]) | (owner[1:] != owner[:-1])])[:len(digests)]
    occurrence = at - np.maximum.accumulate(np.where(first, at, 0)) if len(at) else at
    return mix64(digests ^ (occurrence.astype(np.uint64) << np.uint64(40)), 1), counts


class Sketches:
    """One sketch for each of several owners, with sizes of their own, in flat arrays."""

    def __init__(self, sizes: np.ndarray, salt: int) -> None:
        self.sizes, self.salt = sizes, salt
        self.starts = np.cumsum(sizes) - sizes
        n = int(sizes.sum())
        self.count, self.key, self.check = np.zeros(n, np.int32), np.zeros(n, np.uint64), np.zeros(n, np.uint32)

    def cells(self, digests: np.ndarray, owner: np.ndarray) -> list[np.ndarray]:
        """The cells of each digest: one in each third of its owner's sketch."""
        third = (self.sizes // HASHES)[owner]
        return [self.starts[owner] + k * third + (mix64(digests, self.salt + k) % third.astype(np.uint64)).astype(np.int64) for k in range(HASHES)]

    def add(self, digests: np.ndarray, owner: np.ndarray, sign: int | np.ndarray) -> None:
        checks = checks_of(digests)
        for at in self.cells(digests, owner):
            np.add.at(self.count, at, np.int32(sign) if np.isscalar(sign) else sign)
            np.bitwise_xor.at(self.key, at, digests)
            np.bitwise_xor.at(self.check, at, checks)

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Digests left in each owner's sketch with sign +1 and -1 (counts), and whether its cells are all empty."""
        plus, minus = np.zeros(len(self.sizes), np.int64), np.zeros(len(self.sizes), np.int64)
        place = np.repeat(np.arange(len(self.sizes)), self.sizes)
        look = np.flatnonzero(np.abs(self.count) == 1)
        while len(look):
            pure = look[(np.abs(self.count[look]) == 1) & (checks_of(self.key[look]) == self.check[look])]
            if not len(pure):
                break
            digests, owner, sign = self.key[pure], place[pure], self.count[pure].astype(np.int32)
            own = np.unique(np.stack([owner.astype(np.uint64), digests]), axis=1, return_index=True)[1]
            digests, owner, sign = digests[own], owner[own], sign[own]
            np.add.at(plus, owner, sign > 0)
            np.add.at(minus, owner, sign < 0)
            self.add(digests, owner, -sign)
            look = np.unique(np.concatenate(self.cells(digests, owner)))
        left = np.zeros(len(self.sizes), np.int64)
        np.add.at(left, place, (self.count != 0) | (self.key != 0) | (self.check != 0))
        return plus, minus, left == 0


def checks_of(digests: np.ndarray) -> np.ndarray:
    return (mix64(digests, 97) >> np.uint64(32)).astype(np.uint32)


def fingerprints(digests: np.ndarray, counts: np.ndarray, cells: int = CELLS) -> list[str]:
    """The smallest sketch of each text as text: its number of paragraphs and its cells."""
    s = Sketches(np.full(len(counts), cells, np.int64), 0)
    s.add(digests, np.repeat(np.arange(len(counts)), counts), 1)
    raw = np.concatenate([a.reshape(len(counts), cells).view(np.uint8).reshape(len(counts), -1) for a in (s.count, s.key, s.check)], axis=1) if len(counts) else []
    return [f"{n}:{base64.b64encode(r.tobytes()).decode()}" for n, r in zip(counts.tolist(), raw)]


def likeness(a: np.ndarray, a_counts: np.ndarray, b: np.ndarray, b_counts: np.ndarray, cells: int = CELLS) -> np.ndarray:
    """Share of digests that texts a[i] and b[i] both hold, from their peeled differences."""
    out = np.ones(len(a_counts))
    open_ = np.arange(len(a_counts))
    a_owner, b_owner = np.repeat(open_, a_counts), np.repeat(open_, b_counts)
    attempt = 0
    while len(open_):
        size = cells * 4 ** attempt
        most = np.maximum(cells, 2 * (a_counts + b_counts)[open_] * (1 + attempt // 4))
        sizes = np.minimum(size, -(-most // HASHES) * HASHES) if attempt else np.full(len(open_), cells)
        place = np.full(len(a_counts), -1)
        place[open_] = np.arange(len(open_))
        s = Sketches(sizes.astype(np.int64), 10 * attempt)
        for digests, owner, sign in ((a, a_owner, 1), (b, b_owner, -1)):
            mine = place[owner] >= 0
            s.add(digests[mine], place[owner[mine]], sign)
        only_a, only_b, done = s.peel()
        at = open_[done]
        common = a_counts[at] - only_a[done]
        union = common + only_a[done] + only_b[done]
        out[at] = np.where(union > 0, common / np.maximum(union, 1), 1.0)
        open_ = open_[~done]
        attempt += 1
    return out


def edited(text: str, following: str) -> str:
    """The text with its last quarter of code points replaced by the first as many of the following text."""
    n = len(text) // 4
    return text[:len(text) - n] + following[:n]


def fingerprint(docs: DataFrame) -> DataFrame:
    """Fingerprints of each document (doc_id, text) and its edited text, and their likenesses."""
    small_batches(docs.sparkSession)
    rows, size = docs.select(F.count("*"), F.sum(F.octet_length("text"))).first()
    buckets, partitions = range_counts(rows, size or 0)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("k", F.coalesce("doc_id", F.lit(LEAST)))
    placed = with_bucket(keyed, "k", buckets)

    firsts = sorted((r["bucket"], r["k"]) for r in placed.groupBy("bucket").agg(F.min("k").alias("k")).collect())
    hosts = [(k, firsts[i - 1][0]) for i, (_, k) in enumerate(firsts)]
    spark = docs.sparkSession
    guests = F.broadcast(spark.createDataFrame(hosts, "k long, host int"))
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("guest"))
    both = F.when(F.col("host").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("host").alias("bucket"), F.lit(1).alias("guest"))))
    ranged = placed.join(guests, "k", "left").withColumn("at", F.explode(both)).select("at.bucket", "at.guest", "k", "doc_id", "text")
    ranged = ranged.repartitionByRange(partitions, "bucket").sortWithinPartitions("bucket", "guest", "k", "text").drop("k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: tuple[int | None, str] | None = None
        bucket = None
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                pairs = []
                for b, guest, doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), texts_of(part.column(3))):
                    if waiting is not None:
                        if b != bucket:
                            raise RuntimeError("a range ended without its guest")
                        pairs.append((*waiting, text))
                        waiting = None
                    if not guest:
                        waiting, bucket = (doc_id, text), b
                if pairs:
                    yield _described(pairs)
        if waiting is not None:
            raise RuntimeError("a range ended without its guest")

    return ranged.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _described(pairs: list[tuple[int | None, str, str]]) -> pa.RecordBatch:
    texts = [t for _, t, _ in pairs]
    after = [edited(t, n) for _, t, n in pairs]
    own, own_counts = paragraph_digests(texts)
    new, new_counts = paragraph_digests(after)
    nxt, nxt_counts = paragraph_digests([n for _, _, n in pairs])
    return pa.RecordBatch.from_arrays([
        pa.array([i for i, _, _ in pairs], pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in after]), pa.array(fingerprints(own, own_counts)),
        pa.array(fingerprints(new, new_counts)), pa.array(likeness(own, own_counts, new, new_counts)),
        pa.array(likeness(own, own_counts, nxt, nxt_counts))],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
