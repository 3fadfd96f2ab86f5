"""Operator 11: alignment of two tokenizers by lockstep merging.

A text gets the tokens of tokenizer A (of the text with a blank before it) and of tokenizer B (which puts that blank itself).
Byte offsets where tokens of both end cut them into groups. All documents of a batch are merged at once: one vector holds each
document's place in A and in B. A step compares the ends of the two tokens there, moves on the side that is behind (or both), emits
a cut where both end, and drops documents that are done. A long document takes several places in the vector, parted where
both tokenizers must end, so that a batch takes few steps. Links are all pairs of an A and a B token of one group; in large
groups they are counted by distinct ids.

Tokens come from the libraries through a cache of units: a blank and what follows up to the next blank that has no white space
beside it. Neither tokenizer has a token over such a place.

For counts over the corpus each document's distinct linked id pairs are written, counted by one grouping, and looked up in two
tiers: a table of at most TABLE_PAIRS frequent pairs is broadcast, and the rest meets its counts in a join.

Null and empty texts, and texts whose tokens do not spell the blank and the text, have no tokens: zeros, and '' as digest. Repeated rows
have their own results and count as documents of their own. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchloom.llm.common import held, ragged, slices, small_batches, totals, written

TOKENIZER_A, TOKENIZER_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
MARK = "▁"
#: Bytes of text of a batch, and A tokens after which a document takes another place in the vector.
BATCH_BYTES, LANE = 2 << 20, 192
#: Units kept by a worker, characters of the longest that is kept, rows of the broadcast table.
CACHE_UNITS, LONG_UNIT, TABLE_PAIRS = 250_000, 48, 1 << 18
#: Links that are laid out at a time, and links of a group beyond which its distinct ids are paired.
LINKS, LARGE = 2_000_000, 64
#: Characters that some library takes for white space and Python does not.
BLANKS = "\u180e\u200b\u200c\u200d\u2060\ufeff"


def byte_of_char() -> dict[str, int]:
    """The printable characters that stand for bytes in a byte-level vocabulary: printable Latin-1 for itself, others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Pair:
    """Both tokenizers, the byte lengths of their tokens and the units seen so far."""

    def __init__(self, name_a: str, name_b: str) -> None:
        import public_tokenizers
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(public_tokenizers.path(name_a))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name_b))
        spelled = byte_of_char()
        self.size_a, self.size_b = self.a.get_vocab_size(), self.b.vocab_size()
        entry = {i: t for t, i in self.a.get_vocab().items()}
        self.bytes_a = [bytes(spelled.get(c, 63) for c in entry[i]) for i in range(self.size_a)]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode()
                        for i, p in ((i, self.b.id_to_piece(i)) for i in range(self.size_b))]
        self.length_a, self.length_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.index: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.starts = np.zeros(1 << 14, np.int64)
        self.n_a, self.n_b = np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32)
        self.spelt = np.zeros(1 << 14, bool)
        self.count = self.used = self.kept = self.kept_used = 0
        width = max(len(str(max(self.size_a, self.size_b))), 1) + 1
        self.digits = np.array([len(str(i)) + 1 for i in range(max(self.size_a, self.size_b))], np.int64)
        self.shown = np.array([[f"{i}{s}".encode() for i in range(max(self.size_a, self.size_b))] for s in ",|;"], f"S{width}")

    def tokens(self, unit: str) -> tuple[list[int], list[int], bool]:
        """A and B ids of a unit (which starts with a blank), and whether both spell it."""
        a, b, raw = self.a.encode(unit, add_special_tokens=False).ids, self.b.encode(unit[1:]), unit.encode()
        return a, b, b"".join([self.bytes_a[i] for i in a]) == raw and b"".join([self.bytes_b[i] for i in b]) == raw

    def _together(self, units: list[str]) -> list[tuple[np.ndarray, np.ndarray]] | None:
        """Ids of many units by one call of each library, cut where units end; None if a token goes over an end."""
        text = "".join(units)
        a = np.array(self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)
        b = np.array(self.b.encode(text[1:]), np.int64)
        ends = np.cumsum([len(u.encode()) for u in units])
        out = []
        for ids, length in ((a, self.length_a), (b, self.length_b)):
            reached = np.cumsum(length[ids])
            at = np.searchsorted(reached, ends)
            if not len(reached) or reached[-1] != ends[-1] or (reached[at] != ends).any():
                return None
            out.append((ids, np.diff(at + 1, prepend=0)))
        return out

    def _put(self, ids: np.ndarray, starts: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, spelt: np.ndarray) -> None:
        n, used = self.count + len(starts), self.used + len(ids)
        if used > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(used, 2 * len(self.flat)) - len(self.flat), np.int32)])
        if n > len(self.starts):
            more = max(n, 2 * len(self.starts)) - len(self.starts)
            self.starts, self.n_a, self.n_b, self.spelt = (np.concatenate([x, np.zeros(more, x.dtype)]) for x in (self.starts, self.n_a, self.n_b, self.spelt))
        self.flat[self.used:used] = ids
        for own, new in ((self.starts, self.used + starts), (self.n_a, n_a), (self.n_b, n_b), (self.spelt, spelt)):
            own[self.count:n] = new
        self.count, self.used = n, used

    def _add(self, units: list[str], solid: bool) -> None:
        """Put units behind those that are there; solid: without white space at either end but the first blank."""
        for some in (units[i:i + 20_000] for i in range(0, len(units), 20_000)):
            found = self._together(some) if solid and MARK not in "".join(some) else None
            if found:
                (a, n_a), (b, n_b) = found
                start_a, start_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
                both = np.concatenate([a, b])
                starts, sizes = np.stack([start_a, len(a) + start_b], 1).ravel(), np.stack([n_a, n_b], 1).ravel()
                self._put(ragged(both, starts, sizes), np.cumsum(n_a + n_b) - n_a - n_b, n_a, n_b, np.ones(len(some), bool))
            else:
                each = [self.tokens(u) for u in some]
                n_a, n_b = (np.array([len(t[k]) for t in each], np.int64) for k in (0, 1))
                ids = np.array([i for a, b, _ in each for i in (*a, *b)], np.int32)
                self._put(ids, np.cumsum(n_a + n_b) - n_a - n_b, n_a, n_b, np.array([t[2] for t in each], bool))

    def slots(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Slot of each unit of the texts, and how many units each text has. Slots hold until the next call."""
        self.count, self.used = self.kept, self.kept_used
        if self.count > CACHE_UNITS:
            half = CACHE_UNITS // 2
            self.index = {u: at for u, at in self.index.items() if at < half}
            self.count = self.kept = half
            self.used = self.kept_used = int(self.starts[half])
        parts = pc.split_pattern(texts, " ")
        counts = parts.value_lengths().to_numpy().astype(np.int64)
        coded = parts.flatten().dictionary_encode()
        part = coded.indices.to_numpy().astype(np.int64)
        names = coded.dictionary.to_pylist()
        opens, closes = (np.array([bool(p) and not (p[k].isspace() or p[k] in BLANKS) for p in names], bool) for k in (0, -1))
        first = np.zeros(len(part), bool)
        first[(np.cumsum(counts) - counts)[counts > 0]] = True
        cut = first.copy()
        cut[1:] |= closes[part[:-1]] & opens[part[1:]]
        starts = np.flatnonzero(cut)
        sizes = np.diff(np.append(starts, len(part)))
        several = np.flatnonzero(sizes > 1)
        # what most texts have: a part is a unit
        whole = np.zeros(len(names), bool)
        whole[part[starts[sizes == 1]]] = True
        joined = [" ".join([names[p] for p in part[a:a + n].tolist()]) for a, n in zip(starts[several].tolist(), sizes[several].tolist())]
        unit_of = np.zeros(len(names), np.int64)
        wanted = np.flatnonzero(whole)
        unit_of[wanted] = self._found([names[i] for i in wanted.tolist()], opens[wanted] & closes[wanted])
        out = unit_of[part[starts]]
        if joined:
            out[several] = self._found(joined, np.zeros(len(joined), bool))
        owner = np.repeat(np.arange(len(counts)), counts)[starts]
        return out, np.bincount(owner, minlength=len(counts))

    def _found(self, names: list[str], solid: np.ndarray) -> np.ndarray:
        """Slots of the units, a blank and each name; new ones are encoded, long ones for this call only."""
        get = self.index.get
        out = np.fromiter((get(n, -1) for n in names), np.int64, len(names))
        new = np.flatnonzero(out < 0)
        if not len(new):
            return out
        short = np.array([len(names[i]) <= LONG_UNIT for i in new.tolist()], bool)
        # units kept so far, then those of this call only
        passing = self.count > self.kept
        for keep, plain in ((True, True), (True, False), (False, True), (False, False)):
            at = new[(short == keep) & (solid[new] == plain)]
            if not len(at):
                continue
            units = list(dict.fromkeys(names[i] for i in at.tolist()))
            place = dict(zip(units, range(self.count, self.count + len(units))))
            self._add([" " + u for u in units], plain)
            if keep and not passing:
                self.index.update(place)
                self.kept, self.kept_used = self.count, self.used
            out[at] = np.fromiter((place[names[i]] for i in at.tolist()), np.int64, len(at))
        return out


def tokenizer_pair(name_a: str, name_b: str) -> Pair:
    return held(("pair", name_a, name_b), lambda: Pair(name_a, name_b))


class Aligned:
    """The tokens of a batch of texts and their groups.

    a, b: ids of all texts, flat; n_a, n_b, n_groups: of each text; a_ends, b_ends: where each group ends in them.
    """

    def __init__(self, pair: Pair, texts: pa.Array) -> None:
        self.pair = pair
        slots, units = pair.slots(texts)
        given = np.asarray(pc.binary_length(texts)) > 0
        right = given & (totals((~pair.spelt[slots]).astype(np.int64), units) == 0)
        slots = slots[np.repeat(right, units)]
        units = np.where(right, units, 0)
        own_a, own_b = pair.n_a[slots].astype(np.int64), pair.n_b[slots].astype(np.int64)
        self.a = ragged(pair.flat, pair.starts[slots], own_a)
        self.b = ragged(pair.flat, pair.starts[slots] + own_a, own_b)
        self.n_a, self.n_b = totals(own_a, units), totals(own_b, units)
        cut_a, cut_b = self._merged(own_a, own_b, units)
        self.a_ends, self.b_ends = np.flatnonzero(cut_a) + 1, np.flatnonzero(cut_b) + 1
        self.n_groups = np.diff(np.searchsorted(self.a_ends, np.append(0, np.cumsum(self.n_a)), side="right"))

    def _merged(self, own_a: np.ndarray, own_b: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether a group ends behind each A token and each B token: the merge of all documents in lockstep."""
        end_a, end_b = np.cumsum(self.pair.length_a[self.a]), np.cumsum(self.pair.length_b[self.b])
        before_a, before_b = np.cumsum(own_a) - own_a, np.cumsum(own_b) - own_b
        owner = np.repeat(np.arange(len(units)), units)
        lane = (before_a - np.repeat(before_a[(np.cumsum(units) - units)[units > 0]], units[units > 0])) // LANE
        opens = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (lane[1:] != lane[:-1])])[:len(lane)])
        at_a, at_b = before_a[opens], before_b[opens]
        last_a = np.append(at_a[1:], len(self.a))
        cut_a, cut_b = np.zeros(len(self.a), bool), np.zeros(len(self.b), bool)
        while len(at_a):
            x, y = end_a[at_a], end_b[at_b]
            both = x == y
            cut_a[at_a[both]] = True
            cut_b[at_b[both]] = True
            at_a = at_a + (x <= y)
            at_b = at_b + (y <= x)
            on = at_a < last_a
            if not on.all():
                at_a, at_b, last_a = at_a[on], at_b[on], last_a[on]
        return cut_a, cut_b

    def sizes(self) -> tuple[np.ndarray, np.ndarray]:
        """A tokens and B tokens of each group."""
        return np.diff(self.a_ends, prepend=0), np.diff(self.b_ends, prepend=0)

    def n_links(self) -> np.ndarray:
        size_a, size_b = self.sizes()
        return totals(size_a * size_b, self.n_groups)

    def digests(self) -> list[str]:
        """SHA-256 of each text's groups as `a1,a2|b1;a3|b2,b3`; '' without tokens."""
        size_a, size_b = self.sizes()
        n = len(self.a) + len(self.b)
        ids, kind = np.zeros(n, np.int64), np.zeros(n, np.int8)
        # behind the B tokens of earlier groups, and behind the A tokens of the own group
        ids[np.arange(len(self.a)) + np.repeat(self.b_ends - size_b, size_a)] = self.a
        ids[np.arange(len(self.b)) + np.repeat(self.a_ends, size_b)] = self.b
        kind[self.a_ends + self.b_ends - size_b - 1] = 1
        kind[self.a_ends + self.b_ends - 1] = 2
        text = self.pair.shown[kind, ids].tobytes().replace(b"\0", b"")
        ends = np.append(0, np.cumsum(self.pair.digits[ids]))[np.cumsum(self.n_a + self.n_b)].tolist() if n else [0] * len(self.n_a)
        view = memoryview(text)
        return [hashlib.sha256(view[x:y - 1]).hexdigest() if y > x else "" for x, y in zip([0, *ends], ends)]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct linked id pairs (A id * size of B + B id) of each text, ascending, flat; how often each is linked; how many a text has."""
        size_a, size_b = self.sizes()
        links = size_a * size_b
        owner = np.repeat(np.arange(len(self.n_groups)), self.n_groups)
        small = links <= LARGE
        found = [self._products(owner[small], self.a, (self.a_ends - size_a)[small], size_a[small], None, self.b, (self.b_ends - size_b)[small], size_b[small], None)]
        if not small.all():
            large = np.flatnonzero(~small)
            a, first_a, n_a, times_a = _distinct(self.a, (self.a_ends - size_a)[large], size_a[large], self.pair.size_a)
            b, first_b, n_b, times_b = _distinct(self.b, (self.b_ends - size_b)[large], size_b[large], self.pair.size_b)
            found.append(self._products(owner[large], a, first_a, n_a, times_a, b, first_b, n_b, times_b))
        key, times = _summed(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))
        span = self.pair.size_a * self.pair.size_b
        return key % span, times, np.bincount(key // span, minlength=len(self.n_groups))

    def _products(self, owner, a, first_a, n_a, times_a, b, first_b, n_b, times_b) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of each group's A and B ids, keyed by the text too, and their numbers of links; LINKS at a time."""
        links = n_a * n_b
        part = (np.cumsum(links) - links) // LINKS
        cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])[:len(part)])
        keys, sums = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(links)]):
            n = links[lo:hi]
            inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            wide = np.repeat(n_b[lo:hi], n)
            at_a, at_b = np.repeat(first_a[lo:hi], n) + inside // wide, np.repeat(first_b[lo:hi], n) + inside % wide
            key = (np.repeat(owner[lo:hi], n) * self.pair.size_a + a[at_a]) * self.pair.size_b + b[at_b]
            times = None if times_a is None else times_a[at_a] * times_b[at_b]
            key, times = _summed(key, times)
            keys.append(key)
            sums.append(times)
        return np.concatenate(keys), np.concatenate(sums)


def _summed(key: np.ndarray, times: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their times (None: one each)."""
    if times is None:
        return np.unique(key, return_counts=True)
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[:len(key)])
    return key[first], np.add.reduceat(times[order], first) if len(first) else times


def _distinct(ids: np.ndarray, starts: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Distinct ids of each group, flat; where each group starts, how many it has, and how often each occurs."""
    group = np.repeat(np.arange(len(starts)), counts)
    key, times = np.unique(group * size + ragged(ids, starts, counts), return_counts=True)
    n = np.bincount(key // size, minlength=len(starts))
    return key % size, np.cumsum(n) - n, n, times


def _batches(batches: Iterator[pa.RecordBatch], names: tuple[str, str]) -> Iterator[tuple[pa.RecordBatch, Aligned]]:
    pair = tokenizer_pair(*names)
    for batch in batches:
        for part in slices(batch, "text", BATCH_BYTES):
            yield part, Aligned(pair, pc.fill_null(part.column("text"), ""))


def _lists(flat: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(flat, kind))


def align(docs: DataFrame, name_a: str = TOKENIZER_A, name_b: str = TOKENIZER_B) -> DataFrame:
    """doc_id, the ids of both tokenizers and, for each group, where it ends in them (a_ends, b_ends)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in _batches(batches, (name_a, name_b)):
            before = [np.repeat(np.cumsum(n) - n, found.n_groups) for n in (found.n_a, found.n_b)]
            yield pa.RecordBatch.from_arrays([
                part.column(0), _lists(found.a, found.n_a, pa.int32()), _lists(found.b, found.n_b, pa.int32()),
                _lists(found.a_ends - before[0], found.n_groups, pa.int32()), _lists(found.b_ends - before[1], found.n_groups, pa.int32())],
                names=["doc_id", "a_ids", "b_ids", "a_ends", "b_ends"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, a_ids array<int>, b_ids array<int>, a_ends array<int>, b_ends array<int>")


def _linked(docs: DataFrame, names: tuple[str, str]) -> DataFrame:
    """row (its own number), the counts and the digest of each document, and its distinct linked pairs with their links."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for part, found in _batches(batches, names):
            key, times, counts = found.pairs()
            yield pa.RecordBatch.from_arrays([
                pa.array(np.arange(row, row + part.num_rows)), part.column(0), *[pa.array(n.astype(np.int64)) for n in (found.n_a, found.n_b, found.n_groups, found.n_links())],
                pa.array(found.digests()), _lists(key, counts, pa.int64()), _lists(times, counts, pa.int64())],
                names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])
            row += part.num_rows

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>")


def pair_counts(linked: DataFrame, size_b: int) -> DataFrame:
    """pair, n (documents that hold it linked) and best (whether n is the highest of its A id), written."""
    counts = written(linked.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "alignment-counts")
    counts = counts.withColumn("a", F.floor(F.col("pair") / size_b))
    highest = counts.groupBy("a").agg(F.max("n").alias("highest"))
    return written(counts.join(highest, "a").select("pair", "n", (F.col("n") == F.col("highest")).alias("best")), "alignment-pairs")


def frequent_pairs(pairs: DataFrame, most: int = TABLE_PAIRS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs, counts and best of the pairs with at least 2^k documents, for the least k that leaves at most so many."""
    bins = {r[0]: r[1] for r in pairs.groupBy(F.floor(F.log2("n")).cast("int").alias("k")).agg(F.count("*")).collect()}
    least, rows = 63, 0
    for k in sorted(bins, reverse=True):
        rows += bins[k]
        if rows > most:
            break
        least = k
    table = pairs.where(F.col("n") >= (1 << least if least < 63 else (1 << 63) - 1)).toArrow()
    table = table.sort_by("pair")
    return table["pair"].to_numpy(), table["n"].to_numpy(), table["best"].to_numpy()


def linked_counts(docs: DataFrame, name_a: str = TOKENIZER_A, name_b: str = TOKENIZER_B, most: int = TABLE_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best (links whose count is the highest of their A id), count_sum and groups_sha256."""
    spark = docs.sparkSession
    small_batches(spark)
    linked = written(_linked(docs, (name_a, name_b)), "alignment-links")
    pairs = pair_counts(linked, tokenizer_pair(name_a, name_b).size_b)
    table = spark.sparkContext.broadcast(frequent_pairs(pairs, most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = table.value
        for batch in batches:
            counts = batch.column("pairs").value_lengths().to_numpy().astype(np.int64)
            pair, times = batch.column("pairs").flatten().to_numpy(), batch.column("times").flatten().to_numpy()
            at = np.minimum(np.searchsorted(known, pair), max(len(known) - 1, 0))
            found = known[at] == pair if len(known) else np.zeros(len(pair), bool)
            sums, bests = (np.where(found, times * x[at], 0) if len(known) else np.zeros(len(pair), np.int64) for x in (n, best))
            left = totals((~found).astype(np.int64), counts)
            yield pa.RecordBatch.from_arrays([
                *batch.columns[:-2], pa.array(totals(bests, counts)), pa.array(totals(sums, counts)),
                _lists(pair[~found], left, pa.int64()), _lists(times[~found], left, pa.int64())],
                names=[*batch.schema.names[:-2], "n_best", "count_sum", "pairs", "times"])

    head = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
    met = written(linked.mapInArrow(run, f"{head}, n_best long, count_sum long, pairs array<long>, times array<long>"), "alignment-met")
    rest = met.select("row", F.inline(F.arrays_zip("pairs", "times"))).withColumnRenamed("pairs", "pair").join(pairs, "pair")
    rest = rest.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    added = lambda c, more: (F.col(c) + F.coalesce(F.col(more), F.lit(0))).alias(c)
    return met.join(rest, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", added("n_best", "more_best"), added("count_sum", "more_sum"), "groups_sha256")
