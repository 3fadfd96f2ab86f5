"""Operator 12: benchmark decontamination by suffix arrays of the training texts.

Training texts are cut into shards of about SHARD_BYTES. A shard holds its words as numbers of its own dictionary, one
closing number of its own behind each document, and the suffix array: the places of all words, sorted by the words from
there on to the end of the document. It is made by numpy: several ranks are packed into one 64-bit key and sorted, ranks
of runs of k words give those of runs of 3k or 4k, and from the second round on only places that are still tied are sorted.

Every suffix of every test item is looked for in every shard, all at once: word by word, each suffix keeps the range of the
array that starts with the words so far and narrows it by binary search. The last range that is not empty gives the longest
verbatim match and all its places; the range at the tenth word gives the places of that window. Shards are written once
and serve any number of tests. Tests go to the workers in blocks of bounded size; more tests are more blocks, each a pass
over the shards.

Words are lower-case (A-Z) runs of digits, letters a-z and characters beyond ASCII. A window is ten consecutive words of
an item, or all words of a shorter one. Null and empty texts have no words. Rows that share a doc_id are documents of their
own; rows that share an item_id are one item; a null item id reads as the empty text. Empty tables give no hits or no rows.
A text longer than a shard is a shard of its own. Other columns are ignored; decontaminated() keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from watchloom.llm.common import ragged, runs_of, shared_path, slices, small_batches, written

WINDOW = 10
#: Bytes of text in a shard, and of test texts that are looked for in one pass.
SHARD_BYTES, TEST_BYTES = 1 << 20, 8 << 20
#: Each byte of a text: itself or its lower case where it belongs to a word, else a blank.
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 32 for b in range(256))
SHARD = ("shard long, doc_ids binary, no_id binary, n_words binary, dictionary binary, sequence binary, suffixes binary")
FOUND = "shard long, place int, doc_id long, n_words long, hit_starts array<int>, hit_ends array<int>, items array<string>"
MATCHES = "item_id string, item_start int, doc_id long, doc_start int, n_words int"


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts as one binary array, and how many each text has."""
    return runs_of(texts, LOWER)


def _packed(rank: np.ndarray, at: np.ndarray, step: int, bits: int, k: int) -> np.ndarray:
    """One key of the ranks at at, at + step, ... (k of them); behind the end lies rank 0."""
    key = rank[at]
    for i in range(1, k):
        place = at + i * step
        key = (key << np.int64(bits)) | np.where(place < len(rank), rank[np.minimum(place, len(rank) - 1)], 0)
    return key


def suffix_array(sequence: np.ndarray, closings: int) -> np.ndarray:
    """Places of all words, sorted by what follows. Numbers below closings close a document, each one only once."""
    rank = sequence.astype(np.int64) + 1
    at = np.flatnonzero(sequence >= closings)
    if not len(at):
        return at.astype(np.int32)
    bits = int(rank.max()).bit_length()
    step = max(2, 63 // bits)
    key = _packed(rank, at, 1, bits, step)
    order = np.argsort(key)
    out, key = at[order], key[order]
    open_ = np.arange(len(out))
    bits = int(len(sequence) + 1).bit_length()
    wide = max(2, 63 // bits)
    rank[sequence < closings] = sequence[sequence < closings] + 1
    while True:
        # ranks of the places just sorted: closings first, then the place of the first of equal ones
        first = np.concatenate([[True], key[1:] != key[:-1]])
        rank[out[open_]] = closings + 1 + np.maximum.accumulate(np.where(first, open_, 0))
        tied = ~first | np.concatenate([~first[1:], [False]])
        open_ = open_[tied]
        if not len(open_):
            return out.astype(np.int32)
        key = _packed(rank, out[open_], step, bits, wide)
        order = np.argsort(key)
        out[open_], key = out[open_][order], key[order]
        step *= wide


def suffix_shards(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The suffix arrays of the documents (doc_id, text), written to the shared folder: one row a shard."""
    spark = docs.sparkSession
    small_batches(spark)
    path = path or shared_path(spark, "suffix-shards")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in _gathered(batches):
            for part in slices(batch, "text", SHARD_BYTES):
                yield _shard(part, number)
                number += 1

    source.mapInArrow(run, SHARD).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(SHARD).parquet(path)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together until they hold a shard's bytes."""
    waiting, size = [], 0
    for batch in batches:
        waiting.append(batch)
        size += pc.sum(pc.binary_length(batch.column(1))).as_py() or 0
        if size >= SHARD_BYTES:
            yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
            waiting, size = [], 0
    for batch in pa.Table.from_batches(waiting).combine_chunks().to_batches() if waiting else []:
        yield batch


def _shard(part: pa.RecordBatch, number: int) -> pa.RecordBatch:
    n = part.num_rows
    words, counts = words_of(part.column(1))
    coded = words.dictionary_encode()
    sequence = np.zeros(len(words) + n, np.int32)
    closing = np.cumsum(counts) + np.arange(n)
    inside = np.ones(len(sequence), bool)
    inside[closing] = False
    sequence[closing] = np.arange(n)
    sequence[inside] = coded.indices.to_numpy().astype(np.int32) + n
    suffixes = suffix_array(sequence, n)
    row = {
        "shard": number, "doc_ids": np.array(part.column(0).fill_null(0), np.int64).tobytes(),
        "no_id": part.column(0).is_null().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes(),
        "n_words": counts.astype(np.int64).tobytes(), "dictionary": b" ".join(coded.dictionary.to_pylist()),
        "sequence": sequence.tobytes(), "suffixes": suffixes.tobytes()}
    return pa.RecordBatch.from_pylist([row], schema=pa.schema(
        [("shard", pa.int64())] + [(c, pa.binary()) for c in ("doc_ids", "no_id", "n_words", "dictionary", "sequence", "suffixes")]))


class Tests:
    """A block of test items: their words as numbers, their suffixes and their distinct windows."""

    def __init__(self, ids: list[str], texts: list[str | None]) -> None:
        words, counts = words_of(pa.array(texts, pa.string()))
        coded = words.dictionary_encode()
        self.words = coded.dictionary
        self.names, self.item = np.unique(np.array(ids, object), return_inverse=True) if ids else (np.array([], object), np.zeros(0, np.int64))
        n = len(texts)
        #: all items' words, -1 behind each item; row of each place
        self.flat = np.full(len(words) + n, -1, np.int64)
        ends = np.cumsum(counts) + np.arange(n)
        inside = np.ones(len(self.flat), bool)
        inside[ends] = False
        self.flat[inside] = coded.indices.to_numpy()
        self.row = np.repeat(np.arange(n), counts + 1)
        self.starts = ends - counts
        #: places where windows start, one for each distinct window, its length, and the items that have it
        place = np.arange(len(self.flat))
        left = ends[self.row] - place
        size = np.minimum(counts, WINDOW)[self.row]
        opens = np.flatnonzero((left >= size) & (size > 0) & (place - self.starts[self.row] <= np.maximum(counts[self.row] - WINDOW, 0)))
        padded = np.concatenate([self.flat, np.full(WINDOW, -1)])
        table = np.stack([np.where(k < size[opens], padded[opens + k], -1) for k in range(WINDOW)], axis=1) if len(opens) else np.zeros((0, WINDOW), np.int64)
        _, first, window = np.unique(table, axis=0, return_index=True, return_inverse=True)
        self.window_at, self.window_size = opens[first], size[opens[first]]
        pairs = np.unique(window.ravel().astype(np.int64) * max(len(self.names), 1) + self.item[self.row[opens]])
        self.window_items = pairs % max(len(self.names), 1)
        self.window_first = np.searchsorted(pairs // max(len(self.names), 1), np.arange(len(first) + 1))


class Shard:
    """One row of suffix_shards() with what searching needs."""

    def __init__(self, row: dict) -> None:
        self.number = row["shard"]
        self.doc_ids, self.no_id = np.frombuffer(row["doc_ids"], np.int64), np.frombuffer(row["no_id"], np.uint8).astype(bool)
        self.counts = np.frombuffer(row["n_words"], np.int64)
        self.sequence, self.suffixes = np.frombuffer(row["sequence"], np.int32), np.frombuffer(row["suffixes"], np.int32)
        self.words = pa.array(row["dictionary"].split(b" ") if row["dictionary"] else [], pa.large_binary())
        self.starts = np.cumsum(self.counts + 1) - self.counts - 1

    def documents_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, places, side="right") - 1

    def _bound(self, lo: np.ndarray, hi: np.ndarray, depth: int, word: np.ndarray, after: bool) -> np.ndarray:
        """First place of each range of the array whose word at depth is not below word (after: is above it)."""
        lo, hi = lo.copy(), hi.copy()
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            found = self.sequence[self.suffixes[mid] + depth]
            below = found <= word[open_] if after else found < word[open_]
            lo[open_[below]] = mid[below] + 1
            hi[open_[~below]] = mid[~below]
            open_ = open_[lo[open_] < hi[open_]]
        return lo

    def search(self, tests: Tests) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each place of the tests the length of its longest match and its range of the array; for each window its range."""
        n = len(tests.flat)
        length, low, high = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        known = pc.index_in(tests.words, value_set=self.words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        known = np.where(known >= 0, known + len(self.counts), -1)
        wanted = np.where(tests.flat >= 0, known[tests.flat] if len(known) else -1, -1)
        per_word = np.bincount(self.sequence, minlength=len(self.counts) + len(self.words))
        per_word[:len(self.counts)] = 0
        below = np.concatenate([[0], np.cumsum(per_word)])
        live = np.flatnonzero(wanted >= 0)
        lo, hi = below[wanted[live]], below[wanted[live] + 1]
        window_low, window_high = np.zeros(len(tests.window_at), np.int64), np.zeros(len(tests.window_at), np.int64)
        window_of = np.full(n, -1, np.int64)
        window_of[tests.window_at] = np.arange(len(tests.window_at))
        size_of = np.zeros(n, np.int64)
        size_of[tests.window_at] = tests.window_size
        depth = 0
        while len(live):
            depth += 1
            length[live], low[live], high[live] = depth, lo, hi
            whole = size_of[live] == depth
            window_low[window_of[live[whole]]], window_high[window_of[live[whole]]] = lo[whole], hi[whole]
            word = wanted[np.minimum(live + depth, n - 1)]
            go = word >= 0
            live, lo, hi, word = live[go], lo[go], hi[go], word[go]
            lo = self._bound(lo, hi, depth, word, False)
            hi = self._bound(lo, hi, depth, word, True)
            go = lo < hi
            live, lo, hi = live[go], lo[go], hi[go]
        return length, low, high, window_low, window_high


def _hits(shard: Shard, tests: Tests) -> pa.RecordBatch:
    """A row for each document of the shard: the runs of its words that windows cover, and the items they belong to."""
    *_, low, high = shard.search(tests)
    n, counts = len(shard.counts), high - low
    places = ragged(shard.suffixes, low, counts).astype(np.int64)
    window = np.repeat(np.arange(len(counts)), counts)
    cover = np.zeros(len(shard.sequence) + 1, np.int64)
    np.add.at(cover, places, 1)
    np.add.at(cover, places + tests.window_size[window], -1)
    inside = np.cumsum(cover) > 0
    turn = np.diff(np.concatenate([[False], inside]).astype(np.int8))
    opens, closes = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    own = shard.documents_of(opens)
    runs = np.append(0, np.cumsum(np.bincount(own, minlength=n))).astype(np.int32)
    width = max(len(tests.window_at), 1)
    pairs = np.unique(shard.documents_of(places) * width + window)
    doc, window = pairs // width, pairs % width
    first, size = tests.window_first[window], tests.window_first[window + 1] - tests.window_first[window] if len(window) else np.zeros(0, np.int64)
    width = max(len(tests.names), 1)
    pairs = np.unique(np.repeat(doc, size) * width + ragged(tests.window_items, first, size))
    cuts = np.searchsorted(pairs // width, np.arange(n + 1)).astype(np.int32)
    names = pa.array(list(tests.names), pa.string())
    return pa.RecordBatch.from_arrays([
        pa.array(np.full(n, shard.number)), pa.array(np.arange(n, dtype=np.int32)), pa.array(shard.doc_ids, mask=shard.no_id),
        pa.array(shard.counts), pa.ListArray.from_arrays(pa.array(runs), pa.array((opens - shard.starts[own]).astype(np.int32))),
        pa.ListArray.from_arrays(pa.array(runs), pa.array((closes - shard.starts[own]).astype(np.int32))),
        pa.ListArray.from_arrays(pa.array(cuts), names.take(pa.array(pairs % width)) if len(pairs) else names[:0])],
        names=["shard", "place", "doc_id", "n_words", "hit_starts", "hit_ends", "items"])


def test_blocks(tests: DataFrame) -> Iterator[tuple[list[str], list[str | None]]]:
    """Ids (as text) and texts of the distinct test items (item_id, text), in blocks of about TEST_BYTES."""
    rows = tests.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").distinct()
    size = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    blocks = max(1, -(-size // TEST_BYTES))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    for block in range(blocks):
        some = rows.where(F.col("block") == block).select("item_id", "text").collect()
        yield [r[0] for r in some], [r[1] for r in some]


def _searched(shards: DataFrame, packed: tuple[list[str], list[str | None]], ddl: str, look) -> DataFrame:
    """The shards with look(shard, tests) in place of each."""
    data = shards.sparkSession.sparkContext.broadcast(packed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = Tests(*data.value)
        for batch in batches:
            for i in range(batch.num_rows):
                yield look(Shard(batch.slice(i, 1).to_pylist()[0]), tests)

    return shards.mapInArrow(run, ddl)


def contaminated_words(shards: DataFrame, tests: DataFrame) -> DataFrame:
    """Of every document in the shards: n_words, its runs of words inside windows of tests (hit_starts, hit_ends) and the items."""
    found = [_searched(shards, block, FOUND, _hits) for block in test_blocks(tests)]
    if len(found) == 1:
        return found[0]
    # a document's hits by several blocks are put together; those without hits pass as they are
    parts = [written(f, "suffix-hits") for f in found]
    every = parts[0].withColumn("first", F.lit(True))
    for part in parts[1:]:
        every = every.unionByName(part.where("size(items) > 0").withColumn("first", F.lit(False)))
    grouped = every.groupBy("shard", "place").agg(
        F.max(F.when(F.col("first"), F.struct("doc_id", "n_words"))).alias("doc"),
        F.array_sort(F.flatten(F.collect_list(F.arrays_zip("hit_starts", "hit_ends")))).alias("runs"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    merged = F.aggregate("runs", F.expr("cast(array() as array<struct<hit_starts:int,hit_ends:int>>)"), lambda done, r: F.when(
        (F.size(done) == 0) | (F.element_at(done, -1)["hit_ends"] < r["hit_starts"]), F.concat(done, F.array(r))).otherwise(F.concat(
            F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["hit_starts"].alias("hit_starts"), F.greatest(
                F.element_at(done, -1)["hit_ends"], r["hit_ends"]).alias("hit_ends"))))))
    grouped = grouped.withColumn("runs", merged)
    return grouped.select("shard", "place", "doc.doc_id", "doc.n_words", F.col("runs.hit_starts").alias("hit_starts"), F.col("runs.hit_ends").alias("hit_ends"), "items")


def longest_matches(shards: DataFrame, tests: DataFrame, least: int = WINDOW) -> DataFrame:
    """The longest verbatim match of every test suffix in every shard and all its places, of at least so many words.

    A suffix whose match only continues the one of the suffix before it is left out. item_start and doc_start count words.
    """
    def look(shard: Shard, block: Tests) -> pa.RecordBatch:
        length, low, high, _, _ = shard.search(block)
        size = high - low
        inner = np.concatenate([[False], (length[1:] == length[:-1] - 1) & (size[1:] == size[:-1])])
        at = np.flatnonzero((length >= least) & ~inner)
        places = ragged(shard.suffixes, low[at], size[at]).astype(np.int64)
        at = np.repeat(at, size[at])
        own = shard.documents_of(places)
        return pa.RecordBatch.from_arrays([
            pa.array(list(block.names[block.item[block.row[at]]]), pa.string()), pa.array((at - block.starts[block.row[at]]).astype(np.int32)),
            pa.array(shard.doc_ids[own], mask=shard.no_id[own]), pa.array((places - shard.starts[own]).astype(np.int32)),
            pa.array(length[at].astype(np.int32))], names=["item_id", "item_start", "doc_id", "doc_start", "n_words"])

    out = None
    for block in test_blocks(tests):
        found = _searched(shards, block, MATCHES, look)
        out = found if out is None else out.unionByName(found)
    return out


def n_hit() -> Column:
    """Words inside windows, of a row of contaminated_words()."""
    return F.aggregate(F.zip_with("hit_starts", "hit_ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda s, x: s + x)


def contamination(docs: DataFrame, tests: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 (the items' ids, sorted as text, joined by commas) and contaminated."""
    found = contaminated_words(suffix_shards(docs), tests)
    return found.select(
        "doc_id", "n_words", n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.size("items") > 0).alias("contaminated"))


def decontaminated(docs: DataFrame, tests: DataFrame) -> DataFrame:
    """The documents without those that hold a window of a test. Rows that share a doc_id (also null) go together."""
    affected = contaminated_words(suffix_shards(docs), tests).where("size(items) > 0").select("doc_id").distinct()
    gone = affected.select(F.col("doc_id").alias("__gone"))
    return docs.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col("__gone")), "left_anti")


#: The same rows in SQL: all windows of the items, joined with all runs of words of the documents.
ORACLE = r"""
WITH low AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(list_slice(w, s, s + least(len(w), 10) - 1), ' ') AS win
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
runs AS (
  SELECT r, s, n, array_to_string(list_slice(w, s, s + n - 1), ' ') AS win
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM low, sizes WHERE len(w) >= n)),
met AS (SELECT r, s, n, item FROM runs JOIN windows USING (n, win)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, unnest(range(s, s + n)) AS p FROM met) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM met) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM low LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""
