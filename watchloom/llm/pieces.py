"""Operator 4: SentencePiece encoding and decoding by vectorised merge rounds.

A text is cut into units that no piece of the vocabulary spans: a word with the white space marks before it, or one line
break. All new units of a batch are merged together on flat numpy arrays of symbols. Every round looks up the rank of
each neighbouring pair, takes the smallest rank of each run by a segmented minimum, merges its occurrences from the left and
compacts the arrays; runs without a mergeable pair leave. Runs are units, cut further where no piece holds both neighbours.
Occurrences of one round are merged together only if no pair with the new piece ranks before it; else only the leftmost.

Null and empty texts encode to nothing (or the begin and end ids). Characters outside the vocabulary become byte pieces.
Repeated rows give repeated results, an empty table an empty one; other columns are kept by the general functions.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from watchloom.llm.common import Pool, held, map_texts, ragged, small_batches

MODEL = "piece_bpe_32k.model"
MARK = "▁"
UNIT = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
NONE = np.int32(np.iinfo(np.int32).max)
#: Symbols from here on stand for a character that is no piece: OUTSIDE + code point.
OUTSIDE = 1 << 20
SLOT_BITS = 20


class Vocabulary:
    """Pairs, ranks and bytes of a SentencePiece BPE model, as arrays."""

    def __init__(self, name: str) -> None:
        import public_tokenizers
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        self.size, self.begin, self.end = model.vocab_size(), model.bos_id(), model.eos_id()
        self.first_byte = model.piece_to_id("<0x00>")
        special = lambda i: model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i)
        plain = {model.id_to_piece(i): i for i in range(self.size) if not special(i)}
        scores = np.array([model.get_score(i) for i in range(self.size)])
        self.rank = np.unique(-scores, return_inverse=True)[1].astype(np.int32)

        self.of_char = (OUTSIDE + np.arange(0x110000)).astype(np.int32)
        for piece, i in plain.items():
            if len(piece) == 1:
                self.of_char[ord(piece)] = i
        symbol = lambda s: int(self.of_char[ord(s)]) if len(s) == 1 else plain.get(s)
        pairs: dict[int, int] = {}
        inside: set[int] = set()
        for piece, i in plain.items():
            inside.update((ord(a) << 21) | ord(b) for a, b in zip(piece, piece[1:]))
            for cut in range(1, len(piece)):
                left, right = symbol(piece[:cut]), symbol(piece[cut:])
                if left is not None and right is not None:
                    pairs[(left << 21) | right] = i
        self.inside = np.array(sorted(inside), np.int64)
        keys, merged = np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int32)
        self._fill(keys, merged)

        least = np.full(self.size, NONE)
        for side in (keys >> 21, keys & ((1 << 21) - 1)):
            known = side < self.size
            np.minimum.at(least, side[known], self.rank[merged[known]])
        self.together = least > self.rank

        shown = [b"" if special(i) and not model.is_byte(i) else bytes([i - self.first_byte]) if model.is_byte(i)
                 else model.id_to_piece(i).replace(MARK, " ").encode() for i in range(self.size)]
        if model.unk_id() >= 0:
            shown[model.unk_id()] = " ⁇ ".encode()
        self.byte_lengths = np.array([len(b) for b in shown], np.int64)
        self.byte_starts = np.cumsum(self.byte_lengths) - self.byte_lengths
        self.bytes = np.frombuffer(b"".join(shown), np.uint8)
        self.marked = np.zeros(self.size, bool)
        self.marked[[i for piece, i in plain.items() if piece.startswith(MARK)]] = True
        self.silent = self.byte_lengths == 0

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def _fill(self, keys: np.ndarray, values: np.ndarray) -> None:
        """An open-addressed table: a key lies in the first free slot from its own on."""
        self.keys = np.full(1 << SLOT_BITS, -1, np.int64)
        self.values = np.zeros(1 << SLOT_BITS, np.int32)
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[free]
            placed = self.keys[slot] == keys
            self.values[slot[placed]] = values[placed]
            keys, values, slot = keys[~placed], values[~placed], (slot[~placed] + 1) & ((1 << SLOT_BITS) - 1)

    def merges(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair makes, or -1."""
        key = (left.astype(np.int64) << 21) | right
        slot = self._slot(key)
        found = self.keys[slot]
        out = np.where(found == key, self.values[slot], np.int32(-1))
        open_ = np.flatnonzero((found != key) & (found >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << SLOT_BITS) - 1)
            found = self.keys[slot[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units that are already marked, flat, and how many each has."""
        chars = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32).astype(np.int64)
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        owner = np.repeat(np.arange(len(units), dtype=np.int64), sizes)
        symbols = self.of_char[chars]
        pair = (chars[:-1] << 21) | chars[1:]
        at = np.searchsorted(self.inside, pair)
        apart = (owner[1:] != owner[:-1]) | (self.inside[np.minimum(at, len(self.inside) - 1)] != pair)
        run = np.concatenate([[0], np.cumsum(apart)]) if len(chars) else np.zeros(0, np.int64)
        place = np.arange(len(chars))
        done_at, done_symbol = [], []
        while len(symbols):
            piece = np.full(len(symbols), -1, np.int32)
            near = np.flatnonzero(run[1:] == run[:-1])
            piece[near] = self.merges(symbols[near], symbols[near + 1])
            rank = np.where(piece >= 0, self.rank[piece], NONE)
            starts = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
            lengths = np.diff(np.append(starts, len(run)))
            least = np.repeat(np.minimum.reduceat(rank, starts), lengths)
            over = least == NONE
            if over.any():
                done_at.append(place[over])
                done_symbol.append(symbols[over])
                live = ~over
                symbols, run, place, piece, rank, least = (a[live] for a in (symbols, run, place, piece, rank, least))
                if not len(symbols):
                    break
            chosen = np.flatnonzero(rank == least)
            chosen = self._leftmost(chosen, run, piece)
            symbols[chosen] = piece[chosen]
            keep = np.ones(len(symbols), bool)
            keep[chosen + 1] = False
            symbols, run, place = symbols[keep], run[keep], place[keep]
        if not done_at:
            return np.zeros(0, np.int32), np.zeros(len(units), np.int64)
        place, symbols = np.concatenate(done_at), np.concatenate(done_symbol)
        order = np.argsort(place)
        owner, symbols = owner[place[order]], symbols[order]
        ids, owner = self._fall_back(symbols, owner)
        return ids, np.bincount(owner, minlength=len(units))

    def _leftmost(self, chosen: np.ndarray, run: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Of the pairs to merge: no two that overlap, the left one first; one a run where later ones may change."""
        group = run[chosen]
        alone = ~self.together[piece[chosen]]
        if alone.any():
            first = np.concatenate([[True], group[1:] != group[:-1]])
            waits = np.isin(group, group[alone])
            chosen = chosen[first | ~waits]
        touch = np.concatenate([[False], chosen[1:] == chosen[:-1] + 1])
        if touch.any():
            at = np.arange(len(chosen))
            chosen = chosen[(at - np.maximum.accumulate(np.where(touch, 0, at))) % 2 == 0]
        return chosen

    def _fall_back(self, symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters outside the vocabulary as byte pieces."""
        outside = symbols >= OUTSIDE
        if not outside.any():
            return symbols, owner
        code = symbols - OUTSIDE
        width = np.where(outside, 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF), 1)
        raw = np.frombuffer("".join(map(chr, code[outside])).encode(), np.uint8)
        ids = np.repeat(symbols, width)
        ids[np.repeat(outside, width)] = raw.astype(np.int32) + self.first_byte
        return ids, np.repeat(owner, width)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of sequences of ids, flat, and how many bytes each has. The mark that encoding puts first goes.

        Byte pieces are given as they are: of ids that encoding made, they always form whole characters.
        """
        lengths = self.byte_lengths[ids]
        data = ragged(self.bytes, self.byte_starts[ids], lengths)
        sizes = np.zeros(len(counts), np.int64)
        owner = np.repeat(np.arange(len(counts)), counts)
        np.add.at(sizes, owner, lengths)
        spoken = np.flatnonzero(~self.silent[ids])
        first = spoken[np.concatenate([[True], owner[spoken][1:] != owner[spoken][:-1]])] if len(spoken) else spoken
        first = first[self.marked[ids[first]]]
        keep = np.ones(len(data), bool)
        keep[(np.cumsum(lengths) - lengths)[first]] = False
        sizes[owner[first]] -= 1
        return data[keep], sizes


@lru_cache(maxsize=2)
def vocabulary(name: str) -> Vocabulary:
    return Vocabulary(name)


def unit_pool(name: str) -> Pool:
    """The worker's cache of units, kept between tasks."""
    return held(("units", name), lambda: Pool(vocabulary(name).encode_units))


def units_of(text: str) -> list[str]:
    return UNIT.findall(MARK + text.replace(" ", MARK)) if text else []


def encode_texts(texts: list[str], name: str, ends: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, flat, and how many each has; ends: with the begin and end ids."""
    words, pool = vocabulary(name), unit_pool(name)
    pool.begin()
    units: list[str] = []
    cuts = np.zeros(len(texts) + 1, np.int64)
    for i, text in enumerate(texts):
        units += units_of(text)
        cuts[i + 1] = len(units)
    at = pool.indices(units)
    flat = pool.ids(at)
    sums = np.concatenate([[0], np.cumsum(pool.lengths[at], dtype=np.int64)])[cuts]
    counts = np.diff(sums)
    if ends:
        flat = np.insert(flat, np.repeat(sums, 2)[1:-1], np.tile([words.begin, words.end], len(texts))) if len(texts) else flat
        counts = counts + 2
    return flat, counts


def encode(docs: DataFrame, name: str = MODEL, ends: bool = True, text: str = "text") -> DataFrame:
    """The documents with ids array<int> in place of the text."""
    small_batches(docs.sparkSession)

    def make():
        def work(texts: list[str]) -> list:
            flat, counts = encode_texts(texts, name, ends)
            return [pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(flat, pa.int32()))]
        return work

    return map_texts(docs, "ids array<int>", make, text)


def decode(encoded: DataFrame, name: str = MODEL, ids: str = "ids") -> DataFrame:
    """The encoded documents with column decoded; null ids give the empty text."""
    small_batches(encoded.sparkSession)
    from pyspark.sql import types as T

    out = T.StructType([f for f in encoded.schema if f.name != "decoded"] + [T.StructField("decoded", T.StringType())])
    names = [f.name for f in out][:-1]

    def run(batches):
        words = vocabulary(name)
        for batch in batches:
            lists = batch.column(ids).to_pylist()
            counts = np.array([len(x or ()) for x in lists], np.int64)
            flat = np.array([i for x in lists for i in x or ()], np.int64)
            data, sizes = words.decode(flat, counts)
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(cut(data.tobytes(), sizes))], names=[*names, "decoded"])

    return encoded.mapInArrow(run, out)


def encode_and_decode(docs: DataFrame, name: str = MODEL, ends: bool = True, text: str = "text") -> DataFrame:
    """The documents with ids array<int> and decoded, the text decoded from them, in one pass."""
    small_batches(docs.sparkSession)

    def make():
        words = vocabulary(name)

        def work(texts: list[str]) -> list:
            flat, counts = encode_texts(texts, name, ends)
            data, sizes = words.decode(flat, counts)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(flat, pa.int32()))
            return [lists, pa.array(cut(data.tobytes(), sizes), pa.string())]
        return work

    return map_texts(docs, "ids array<int>, decoded string", make, text)


def cut(data: bytes, sizes: np.ndarray) -> list[str]:
    ends = np.cumsum(sizes).tolist()
    return [data[a:b].decode("utf-8", "replace") for a, b in zip([0, *ends], ends)]


def round_trip_digests(docs: DataFrame, name: str = MODEL, text: str = "text") -> DataFrame:
    """n_tokens, SHA-256 of the ids (little-endian unsigned 32-bit, begin and end included) and of the decoded text."""
    small_batches(docs.sparkSession)

    def make():
        words = vocabulary(name)

        def work(texts: list[str]) -> list:
            flat, counts = encode_texts(texts, name)
            data, sizes = words.decode(flat, counts)
            return [counts, digests(flat.astype("<u4").tobytes(), 4 * counts), digests(data.tobytes(), sizes)]
        return work

    return map_texts(docs, "n_tokens long, ids_sha256 string, decoded_sha256 string", make, text)


def digests(data: bytes, sizes: np.ndarray) -> list[str]:
    view, ends = memoryview(data), np.cumsum(sizes).tolist()
    return [hashlib.sha256(view[a:b]).hexdigest() for a, b in zip([0, *ends], ends)]
