"""Operator 1: scores of texts by a causal self-attention model on subword ids, beside a smoothed word baseline.

A text is its words in lower case (A-Z only) and one end. A word is spelled in SentencePiece ids; the id that ends a word is
its own symbol, so a sequence of symbols gives the words back and the product over symbols is a probability of the text.

The model predicts the next symbol in three steps: a group of classes, a class of the group, the symbol within its class. Groups
and classes come from the row of the last symbol plus causal self-attention over a window: the text is cut into blocks of BLOCK symbols, and the queries of a block see
their own block up to themselves and the whole block before. Windows overlap by a block and every symbol is scored once, by
batched masked attention in numpy. Classes are clusters of symbols with like neighbours. Shares of symbols within classes, neighbours
and the rows' counts of next classes come from all training texts: all texts are spelled once, in symbols that are written and read by
every later pass, and two passes over those of the training texts count in tables of bounded size. Attention is fitted in numpy on the
windows of all blocks of all training texts, whatever their number, RUN neighbouring blocks at a time: each 2 * FIT_WINDOWS of them are a
part that visits all its windows in STEPS steps, and the parts' weights and moments are averaged ROUNDS times on the way.

The baseline needs the count of every word in all training texts: counted by Spark; the TABLE_WORDS most frequent are broadcast as
two arrays of numbers, and only the other words of a text meet their counts in a join. Words are told apart by 64-bit hashes.

Null texts count as empty: one token, the end. Without training texts every count is 0 and all symbols are alike. Repeated rows
give repeated results, an empty table an empty one. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import product, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from numpy.lib.stride_tricks import as_strided
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchloom.llm.common import Pool, held, objects, runs_of, slices, small_batches, totals, written
from watchloom.llm.pieces import MARK, MODEL

BLOCK, WIDTH, CLASSES, RARE_CLASSES, GROUPS = 16, 16, 256, 8, 16
#: Classes of a group: class c belongs to group c // SIZE. Scores stand side by side, of the groups first, then of the classes.
SIZE = CLASSES // GROUPS
FIT_WINDOWS, ROWS, CONTEXT, STEPS, BATCH, RATE, SEED = 60_000, 4096, 512, 300, 256, 0.01, 5
ROUNDS, CODED, FAN = 3, 1 << 17, 8
#: Consecutive blocks that are fitted together, so that what a block shows as keys is worked out once.
RUN = 4
TABLE_WORDS = 131_072
#: The end of a text as a word: no word holds a line break.
END_WORD = b"\n"
_HASH = xxhash.xxh3_64_intdigest


#: Each byte of a text: a blank for ASCII white space, the lower case of A-Z, else itself. Words stand between blanks.
LOWER = bytes(32 if b in b" \t\n\r\x0b\x0c" else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


class Speller:
    """Symbols of words by the sentencepiece library: ids, and id + size where the word ends."""

    def __init__(self, name: str) -> None:
        import public_tokenizers
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        self.size = self.model.vocab_size()
        self.end = self.model.eos_id() + self.size
        self.marked = np.array([self.model.id_to_piece(i).startswith(MARK) for i in range(self.size)])
        self.symbols = 2 * self.size

    def spell(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat symbols of words, and how many each has."""
        done: list[tuple[np.ndarray, np.ndarray]] = []
        for a in range(0, len(words), 500):
            self._spell(words[a:a + 500], done)
        flat = np.concatenate([f for f, _ in done] or [np.zeros(0, np.int32)])
        lengths = np.concatenate([n for _, n in done] or [np.zeros(0, np.int64)])
        flat[np.cumsum(lengths) - 1] += self.size
        return flat, lengths

    def _spell(self, words: list[bytes], done: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Words as one text, cut where a piece begins a word; those that cannot be told apart so are halved down to single words."""
        text = b" ".join(words).decode()
        if len(words) == 1 or MARK not in text:
            ids = np.array(self.model.encode(text), np.int32)
            starts = np.flatnonzero(self.marked[ids]) if len(words) > 1 else np.zeros(1, np.int64)
            if len(starts) == len(words):
                done.append((ids, np.diff(starts, append=len(ids))))
                return
        half = len(words) // 2
        self._spell(words[:half], done)
        self._spell(words[half:], done)


class Distinct(Pool):
    """A pool whose calls bring no unit twice, so that the new ones are found and numbered at once."""

    def indices(self, units: list[bytes]) -> np.ndarray:
        out = np.fromiter(map(self.index.get, units, repeat(-1)), np.int64, len(units))
        new = np.flatnonzero(out < 0)
        if len(new):
            out[new] = np.arange(len(self.index), len(self.index) + len(new))
            self.pending = [units[i] for i in new.tolist()]
            self.index.update(zip(self.pending, out[new].tolist()))
            super().indices([])
        return out


class Words:
    """The worker's cache of words: symbols and hash."""

    def __init__(self, name: str) -> None:
        self.speller = Speller(name)
        self.pool = Distinct(self._new, 300_000)
        self.hashes = np.zeros(1 << 14, np.uint64)

    def _new(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        n = self.pool.count + len(words)
        self.hashes = self.pool._grown(self.hashes, n)
        self.hashes[self.pool.count:n] = np.fromiter(map(_HASH, words), np.uint64, len(words))
        return self.speller.spell(words)

    def read(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct words as places in the pool, the number of each word among them, flat, and how many words each text has."""
        self.pool.begin()
        words, counts = runs_of(texts, LOWER)
        coded = words.dictionary_encode()
        return self.pool.indices(objects(coded.dictionary)), coded.indices.to_numpy(), counts

    def symbols(self, at: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of texts with the end of each, flat, and how many each has."""
        flat = self.pool.ids(at)
        sizes = totals(self.pool.lengths[at], counts)
        return np.insert(flat, np.cumsum(sizes), self.speller.end), sizes + 1


def look_up(table: tuple[np.ndarray, np.ndarray], hashes: np.ndarray) -> np.ndarray:
    keys, counts = table
    if not len(keys):
        return np.zeros(len(hashes), np.int64)
    at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    return np.where(keys[at] == hashes, counts[at], 0)


# --- what the corpus gives ------------------------------------------------------------------

def _gather(docs: DataFrame, name: str) -> DataFrame:
    """Of (doc_id, text, held_out), task by task: of the training texts word counts (kind 0), symbol counts (1) and chunks of texts (2);
    chunks of the other texts (3). A chunk has ids, held_out and numbers of words (sizes) of its texts, the symbols of all of them
    (codes), the hashes of its distinct words and the number of each word among these (words): texts are spelled only here. Chunks are of
    about CODED symbols, so that no row is large; a longer text is a chunk of its own."""
    id_kind = docs.schema["doc_id"].dataType.simpleString()
    kind_of = "kind int, key long, n long, codes binary, words binary, hashes binary, sizes binary, ids array<" + id_kind + ">, held array<boolean>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held(("gather", name), lambda: Words(name))
        code, end = _code(known.speller.symbols), np.uint64(_HASH(END_WORD))
        pieces = np.zeros(known.speller.symbols, np.int64)
        chunks: dict[int, list[tuple]] = {2: [], 3: []}
        counted: list[tuple[np.ndarray, np.ndarray]] = []

        def rows(kind: int, keys: np.ndarray, counts: np.ndarray, *more: pa.Array) -> pa.RecordBatch:
            n = len(keys)
            more = more or [pa.nulls(n, f) for f in (*[pa.binary()] * 4, pa.list_(of_id), pa.list_(pa.bool_()))]
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(keys.astype(np.int64)), pa.array(counts.astype(np.int64)), *more],
                                              names=["kind", "key", "n", "codes", "words", "hashes", "sizes", "ids", "held"])

        def chunk(kind: int) -> pa.RecordBatch:
            codes, words, hashes, sizes, ids, away = zip(*chunks[kind])
            chunks[kind].clear()
            before = np.cumsum([0, *map(len, hashes)]).tolist()
            words = [(w + b).astype(_number(before[-1])) for w, b in zip(words, before)]
            raw = [pa.array([np.concatenate(v).tobytes()], pa.binary()) for v in (codes, words, hashes, sizes)]
            lists = [pa.concat_arrays(v) for v in (ids, away)]
            return rows(kind, np.zeros(1), np.array([sum(map(len, codes))]), *raw, *[pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in lists])

        of_id = None
        for batch in batches:
            of_id = batch.schema.field("doc_id").type
            for part in slices(batch, "text"):
                places, local, counts = known.read(part.column("text"))
                hashes = known.hashes[places]
                flat, symbols = known.symbols(places[local], counts)
                learnt = np.asarray(pc.fill_null(pc.invert(part.column("held_out")), False))
                # texts side by side that make a chunk, then those of them that are learnt from, and the others
                group = np.cumsum(symbols) // CODED
                cuts = np.flatnonzero(np.diff(group, prepend=-1, append=-1)).tolist()
                of_word, of_symbol = np.append(0, np.cumsum(counts)), np.append(0, np.cumsum(symbols))
                for (x, y), (kind, wanted) in product(zip(cuts, cuts[1:]), ((2, learnt), (3, ~learnt))):
                    own = wanted[x:y]
                    if not own.any():
                        continue
                    words = local[of_word[x]:of_word[y]][np.repeat(own, counts[x:y])]
                    codes = flat[of_symbol[x]:of_symbol[y]][np.repeat(own, symbols[x:y])]
                    met = np.bincount(words, minlength=len(places))
                    used = np.flatnonzero(met)
                    number = np.zeros(len(places), np.int32)
                    number[used] = np.arange(len(used))
                    if kind == 2:
                        counted += [(hashes[used], met[used]), (np.array([end]), np.array([own.sum()]))]
                        pieces += np.bincount(codes, minlength=len(pieces))
                    ids, mine = part.slice(x, y - x), pa.array(own)
                    chunks[kind].append((codes.astype(code), number[words], hashes[used], counts[x:y][own].astype(np.int64),
                                         ids.column("doc_id").filter(mine), ids.column("held_out").filter(mine)))
                    if sum(len(c[0]) for c in chunks[kind]) >= CODED:
                        yield chunk(kind)
                if sum(len(h) for h, _ in counted) > 800_000:
                    counted = [summed_by_key(counted)]
                    if len(counted[0][0]) > 400_000:
                        yield rows(0, *counted.pop())
        if of_id is not None:
            for kind in (2, 3):
                if chunks[kind]:
                    yield chunk(kind)
            if counted:
                yield rows(0, *summed_by_key(counted))
            used = np.flatnonzero(pieces)
            yield rows(1, used, pieces[used])

    return docs.select("doc_id", "text", "held_out").mapInArrow(run, kind_of)


def summed_by_key(counted: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of (keys, counts), and their counts in all."""
    keys, counts = (np.concatenate(v) for v in zip(*counted))
    order = np.argsort(keys)
    keys = keys[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[starts], np.add.reduceat(counts[order], starts)


def _code(symbols: int) -> type:
    return np.uint16 if symbols <= 1 << 16 else np.int32


def _number(words: int) -> type:
    return np.uint16 if words <= 1 << 16 else np.uint32


def _drop_words() -> None:
    """The words a worker has kept from spelling go: they are not needed again."""
    held(("spelt",), lambda: None)


def count_pairs(coded: DataFrame, symbols: int, end: int, cells: int, place: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """How often each cell is met in all coded texts: place gives the cells of (symbol before or -1, symbol), summed by task."""
    code = _code(symbols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _drop_words()
        seen = np.zeros(cells, np.int64)
        for batch in batches:
            for raw in batch.column(0):
                flat = np.frombuffer(raw.as_buffer(), code).astype(np.int32)
                last = np.append(np.int32(-1), flat[:-1])
                last[last == end] = -1
                seen += np.bincount(place(last, flat), minlength=cells)
        met = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(seen[met])], names=["cell", "n"])

    out = np.zeros(cells)
    found = coded.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out[found["cell"].to_numpy()] = found["n"].to_numpy()
    return out


# --- the model ------------------------------------------------------------------------------

@dataclass
class Attention:
    """row_of: row of a symbol (the last row: before the text); class_of and inside (log share in its class) of a symbol.

    qkv: queries, keys and values of a row; base: group and class scores of a row; out: those of attended values;
    near: what attention adds for a key so many places back.
    """

    row_of: np.ndarray
    class_of: np.ndarray
    inside: np.ndarray
    qkv: np.ndarray
    base: np.ndarray
    out: np.ndarray
    near: np.ndarray


def causal_bias(near: np.ndarray) -> np.ndarray:
    """(query, key) of a window of two blocks: near by distance, closed for keys after the query."""
    back = BLOCK + np.arange(BLOCK)[:, None] - np.arange(2 * BLOCK)[None, :]
    return np.where(back >= 0, near[np.clip(back, 0, len(near) - 1)], np.float32(-1e9)).astype(np.float32)


def pairs_of(blocks: np.ndarray) -> np.ndarray:
    """Every two neighbouring blocks of (runs, blocks, BLOCK, d) as one of 2 * BLOCK: a view, whose rows must not be written."""
    n, m, _, d = blocks.shape
    return as_strided(blocks, (n, m - 1, 2 * BLOCK, d), blocks.strides)


def turned(a: np.ndarray) -> np.ndarray:
    return a.swapaxes(-1, -2)


def attend(q: np.ndarray, kv: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights of the queries (runs, blocks, BLOCK, d) over the keys of the block before and their own, the sums of these, and the
    attended values; kv has keys and values of one block more. Scores stay where exp does."""
    d = q.shape[-1]
    weight = q @ turned(pairs_of(kv[..., :d]))
    np.clip(weight, -40, 40, out=weight)
    weight += bias
    np.exp(weight, out=weight)
    every = summed(weight)[..., None]
    out = weight @ pairs_of(kv[..., d:])
    out /= every
    return weight, every, out


def neighbour_cells(counts: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Cells of (frequent symbol, CONTEXT symbols after it and CONTEXT before it), for count_pairs; none for other pairs."""
    order = np.argsort(-counts, kind="stable")
    top = order[:ROWS][counts[order[:ROWS]] > 0]
    place_of = np.full(len(counts) + 1, -1, np.int32)
    place_of[top] = np.arange(len(top))

    def place(before: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        left, right = place_of[before], place_of[symbol]
        both = np.flatnonzero((left >= 0) & (right >= 0))
        left, right = left[both], right[both]
        after, ahead = right < CONTEXT, left < CONTEXT
        return np.append(left[after] * (2 * CONTEXT) + right[after], right[ahead] * (2 * CONTEXT) + (CONTEXT + left[ahead]))
    return place


def cluster(near: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A class for every symbol: frequent ones by the counts of their neighbours (k-means), others by frequency and word end."""
    symbols, size = len(counts), len(counts) // 2
    order = np.argsort(-counts, kind="stable")
    top = order[:ROWS][counts[order[:ROWS]] > 0]
    near = near[:ROWS * 2 * CONTEXT].reshape(ROWS, 2 * CONTEXT)[:max(len(top), 1)].astype(np.float32)
    near = np.sqrt((near + 0.02 * near.mean(axis=0)) / (near.sum(axis=1, keepdims=True) + 1))
    near -= near.mean(axis=0)
    values, vectors = np.linalg.eigh((near.T @ near).astype(np.float64))
    x = near @ vectors[:, -24:].astype(np.float32)
    rng = np.random.default_rng(SEED)
    groups = CLASSES - RARE_CLASSES
    weight = np.sqrt(counts[top] + 1.0) if len(top) else np.ones(1)
    centres = x[rng.choice(len(x), groups, replace=len(x) < groups, p=weight / weight.sum())].copy()
    own = np.zeros(len(x), int)
    for _ in range(25):
        own = ((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)).argmin(axis=1)
        for g in range(groups):
            mine = own == g
            if mine.any():
                centres[g] = np.average(x[mine], axis=0, weights=weight[mine])
    # classes that are like one another stand together, so that they share a group
    own = np.argsort(np.argsort(centres[:, -1], kind="stable"))[own]
    classes = np.zeros(symbols, np.int64)
    rest = order[len(top):]
    level = np.digitize(counts[rest], [1, 30, 300])
    classes[rest] = groups + np.minimum(RARE_CLASSES - 1, 2 * level + (rest >= size))
    classes[top] = own[:len(top)]
    return classes


@dataclass
class Rows:
    """row_of, class_of and inside as in Attention, and the class of each row."""

    row_of: np.ndarray
    class_of: np.ndarray
    inside: np.ndarray
    class_of_row: np.ndarray
    unused: np.ndarray

    def place(self, before: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Cells of (row, next class), for count_pairs."""
        return self.row_of[before] * CLASSES + self.class_of[symbol]


def rows_of(classes: np.ndarray, counts: np.ndarray) -> Rows:
    in_class = np.bincount(classes, weights=counts + 0.1, minlength=CLASSES)
    order = np.argsort(-counts, kind="stable")[:ROWS]
    row_of = np.append(ROWS + classes, ROWS + CLASSES)
    row_of[order] = np.arange(len(order))
    class_of_row = np.append(np.append(classes[order], np.zeros(ROWS - len(order), int)), np.append(np.arange(CLASSES), CLASSES))
    return Rows(row_of, classes, np.log((counts + 0.1) / in_class[classes]), class_of_row, in_class == 0)


def base_of_counts(rows: Rows, own: np.ndarray) -> np.ndarray:
    """Group and class scores of each row from its counts of next classes, smoothed by those of its class."""
    own = own.reshape(-1, CLASSES)
    shares = own.sum(axis=0) + 1.0
    shares /= shares.sum()
    pair = np.zeros((CLASSES + 1, CLASSES))
    np.add.at(pair, rows.class_of_row, own)
    pair = (pair + 20 * shares) / (pair.sum(axis=1, keepdims=True) + 20)
    share = (own + 30 * pair[rows.class_of_row]) / (own.sum(axis=1, keepdims=True) + 30)
    of_group = share.reshape(-1, GROUPS, SIZE).sum(axis=2)
    return np.log(np.concatenate([of_group, share / np.repeat(of_group, SIZE, axis=1)], axis=1)).astype(np.float32)


def fresh(rows: Rows) -> list[np.ndarray]:
    """Weights of attention before the first step, and their two moments."""
    rng = np.random.default_rng(SEED)
    n = len(rows.class_of_row)
    embed = (rng.standard_normal((n, WIDTH)) * 0.3 + rng.standard_normal((CLASSES + 1, WIDTH))[rows.class_of_row] * 0.5).astype(np.float32)
    project = (rng.standard_normal((WIDTH, 3 * WIDTH)) / math.sqrt(WIDTH)).astype(np.float32)
    values = [embed, project, np.zeros((WIDTH, GROUPS + CLASSES), np.float32), np.zeros(2 * BLOCK, np.float32)]
    return [*values, *[np.zeros_like(v) for v in values + values]]


def stepped(rows: Rows, base: np.ndarray, state: list[np.ndarray], windows: np.ndarray, steps: range, seed: int) -> list[np.ndarray]:
    """Weights and moments after the given steps on windows of BLOCK + 1 symbols before (-1: before the text) and one or more blocks."""
    state = [v.copy() for v in state]
    values, first, second = state[:4], state[4:8], state[8:]
    back = BLOCK + np.arange(BLOCK)[:, None] - np.arange(2 * BLOCK)[None, :]
    # all STEPS together visit every window once, or, of fewer windows, each about as often
    order = np.random.default_rng((SEED, seed)).permutation(len(windows))
    batch = max(BATCH // max(1, windows.shape[1] // BLOCK - 1), -(-len(windows) // STEPS))
    for step in steps if len(windows) else ():
        own = windows.take(order[((step - 1) * batch + np.arange(batch)) % len(windows)], axis=0)
        real = own[:, 1:] >= 0
        # what stands before a text is the same whatever text stood there
        slopes = _slopes([*values, base], rows.row_of.take(np.where(real, own[:, :-1], -1)), rows.class_of.take(own[:, 1:]), real, back, False)
        rate = RATE * min(1.0, 2 * (1 - step / (STEPS + 1)))
        for v, g, a, b, r in zip(values, slopes, first, second, (1, 0.5, 1, 2)):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            v -= (r * rate * (a / (1 - 0.9 ** step)) / (np.sqrt(b / (1 - 0.99 ** step)) + 1e-6)).astype(np.float32)
    return state


def rounds_of(steps: int) -> list[range]:
    cuts = [1 + steps * i // ROUNDS for i in range(ROUNDS + 1)]
    return [range(a, b) for a, b in zip(cuts, cuts[1:])]


def made(rows: Rows, base: np.ndarray, state: list[np.ndarray]) -> Attention:
    """The model of fitted weights."""
    embed, project, out, near = state[:4]
    base = base.copy()
    base[:, GROUPS:][:, rows.unused] = -80
    base[:, :GROUPS][:, rows.unused.reshape(GROUPS, SIZE).all(axis=1)] = -80
    qkv = embed @ project
    qkv[:, :WIDTH] /= math.sqrt(WIDTH)
    return shrunk(Attention(rows.row_of.astype(np.int32), rows.class_of.astype(np.int32), rows.inside, qkv, base, out, near))


def fit(windows: np.ndarray, counts: np.ndarray) -> Attention:
    """The model of windows that are all there is, in memory; counts: of each symbol in all training texts."""
    before, symbol = windows[:, :-1].ravel(), windows[:, 1:].ravel()
    before, symbol = before[symbol >= 0], symbol[symbol >= 0]
    near = np.bincount(neighbour_cells(counts)(before, symbol), minlength=ROWS * 2 * CONTEXT + 1)
    rows = rows_of(cluster(near, counts), counts)
    base = base_of_counts(rows, np.bincount(rows.place(before, symbol), minlength=len(rows.class_of_row) * CLASSES).astype(float))
    state = fresh(rows)
    for steps in rounds_of(STEPS):
        state = stepped(rows, base, state, windows, steps, 0)
    return made(rows, base, state)


def windows_of(flat: np.ndarray, end: int) -> np.ndarray:
    """A window for every block of whole texts in symbols, each text with its end: the symbols of the block, BLOCK before them, and
    one more (-1: before or after the text). Blocks lie as in ``score_symbols``, so every symbol is predicted in one window."""
    ends = np.flatnonzero(flat == end) + 1
    sizes = np.diff(ends, prepend=0)
    blocks = -(-sizes // BLOCK)
    block = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    at = (block * BLOCK - BLOCK - 1)[:, None] + np.arange(2 * BLOCK + 1)
    inside = (at >= 0) & (at < np.repeat(sizes, blocks)[:, None])
    at += np.repeat(ends - sizes, blocks)[:, None]
    return np.where(inside, flat[np.where(inside, at, 0)].astype(np.int32), np.int32(-1))


def laid_out(sizes: np.ndarray) -> tuple[np.ndarray, int]:
    """Places of the symbols of texts in whole blocks, an empty one before each text, and the number of blocks."""
    blocks = 1 + -(-sizes // BLOCK)
    starts = (np.cumsum(blocks) - blocks + 1) * BLOCK
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes), int(blocks.sum())


def runs_of_blocks(flat: np.ndarray, end: int) -> np.ndarray:
    """The windows of ``windows_of``, RUN neighbours as one: RUN blocks after BLOCK + 1 symbols before them. An empty block (-1) stands
    between texts, so that neighbours may be of two texts and none sees the other's symbols."""
    at, blocks = laid_out(np.diff(np.flatnonzero(flat == end) + 1, prepend=0))
    runs = -(-(blocks - 1) // RUN)
    laid = np.full((1 + runs * RUN) * BLOCK + 1, -1, np.int32)
    laid[at + 1] = flat
    return as_strided(laid, (runs, (1 + RUN) * BLOCK + 1), (RUN * BLOCK * 4, 4)).copy()


def fit_coded(coded: DataFrame, symbols: int, end: int, total: float, rows: Rows, base: np.ndarray) -> list[np.ndarray]:
    """Weights and moments fitted on the windows of all blocks of the coded texts, total symbols in all.

    The codes are read where they lie, not shuffled: a task makes parts of its chunks, of 2 * FIT_WINDOWS or somewhat more.
    """
    code = _code(symbols)

    def parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        made, n = [], 0
        for batch in batches:
            for raw in batch.column(0):
                made.append(runs_of_blocks(np.frombuffer(raw.as_buffer(), code), end))
                n += RUN * len(made[-1])
                if n >= 2 * FIT_WINDOWS:
                    yield np.concatenate(made)
                    made, n = [], 0
        if n:
            yield np.concatenate(made)

    return _fit(coded.coalesce(max(1, int(total / BLOCK / (2 * FIT_WINDOWS)))), parts_of, rows, base) if total else fresh(rows)


def fit_parts(windows: DataFrame, rows: Rows, base: np.ndarray) -> list[np.ndarray]:
    """Weights and moments fitted on given windows: parts of about FIT_WINDOWS take their steps at once and are averaged in every round."""
    n = windows.count()

    def parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        raw = sorted(w for batch in batches for w in batch.column(0).to_pylist())
        if raw:
            yield np.frombuffer(b"".join(raw), np.int32).reshape(-1, 2 * BLOCK + 1)

    return _fit(windows.repartition(max(1, round(n / FIT_WINDOWS))), parts_of, rows, base) if n else fresh(rows)


def _fit(source: DataFrame, parts_of: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], rows: Rows, base: np.ndarray) -> list[np.ndarray]:
    """Rounds of steps on the parts of each task, averaged by their windows: in the task, in FAN tasks, then on the driver."""
    spark = source.sparkSession
    state = fresh(rows)
    shapes = [v.shape for v in state]

    for steps in rounds_of(STEPS):
        shared = spark.sparkContext.broadcast((rows, base, state))

        def run(batches: Iterator[pa.RecordBatch], steps: range = steps, shared=shared) -> Iterator[pa.RecordBatch]:
            _drop_words()
            task = TaskContext.get().partitionId()
            total = sum_of((len(own), np.concatenate([v.ravel() for v in stepped(*shared.value, own, steps, task + (i << 32))]).astype(np.float64) * len(own))
                           for i, own in enumerate(parts_of(batches)))
            if total:
                yield _weighted(total)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = sum_of((n, np.frombuffer(v, np.float64)) for batch in batches for n, v in zip(*(c.to_pylist() for c in batch.columns)))
            if total:
                yield _weighted(total)

        kind = "n long, weights binary"
        summed = source.mapInArrow(run, kind).repartition(FAN).mapInArrow(add, kind).collect()
        weight, flat = sum_of((r["n"], np.frombuffer(bytes(r["weights"]), np.float64)) for r in sorted(summed))
        cuts = np.cumsum([math.prod(s) for s in shapes])[:-1]
        state = [v.reshape(s).astype(np.float32) for v, s in zip(np.split(flat / weight, cuts), shapes)]
        shared.unpersist()
    return state


def sum_of(weighted) -> tuple[int, np.ndarray] | None:
    total = None
    for n, v in weighted:
        total = (n, v) if total is None else (total[0] + n, total[1] + v)
    return total


def _weighted(total: tuple[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([total[0]], pa.int64()), pa.array([total[1].tobytes()], pa.binary())], names=["n", "weights"])


def shrunk(model: Attention, most: float = 60.0) -> Attention:
    """The model with scores that cannot leave the range of exp: what could is scaled down (usually nothing)."""
    length = lambda rows: float(np.sqrt((rows * rows).sum(axis=1)).max())
    d = WIDTH
    pairs = length(model.qkv[:, :d]) * length(model.qkv[:, d:2 * d])
    model.qkv[:, :d] *= min(1.0, most / 2 / max(pairs, 1e-9))
    np.clip(model.near, -most / 2, most / 2, out=model.near)
    model.out *= min(1.0, most / 2 / max(length(model.qkv[:, 2 * d:]) * length(model.out.T), 1e-9))
    np.clip(model.base, -80, most / 2, out=model.base)
    return model


def summed(rows: np.ndarray) -> np.ndarray:
    """Sums over the last, short axis: as a product, which is several times faster."""
    return rows @ np.ones(rows.shape[-1], rows.dtype)


def by_group(classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """Places by group of their class, their groups, and the groups that occur with their first and last place: each is one product."""
    group = classes // SIZE
    order = np.argsort(group.astype(np.uint8), kind="stable")
    group = group.take(order)
    cuts = np.searchsorted(group, np.arange(GROUPS + 1)).tolist()
    return order, group, [(g, a, b) for g, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]


def _surplus(scores: np.ndarray, chosen: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Gradient of the loss by the scores, in their place: shares of each row less one for the chosen, weighted. Scores stay where exp does."""
    np.clip(scores, -80, 60, out=scores)
    np.exp(scores, out=scores)
    scores *= (share / summed(scores))[:, None]
    scores.ravel()[np.arange(len(scores)) * SIZE + chosen] -= share
    return scores


def _slopes(values: list[np.ndarray], x: np.ndarray, y: np.ndarray, real: np.ndarray, back: np.ndarray, of_base: bool = True) -> list[np.ndarray]:
    """Gradient of the mean loss over the queries of the later blocks of each window, each seeing its own block and the one before;
    that of base only if asked for.

    The loss is of the group of the next class among all, and of the class among those of its group.
    """
    embed, project, out, near, base = values
    d, n, m = WIDTH, len(x), x.shape[1] // BLOCK - 1
    table = embed @ project
    table[:, :d] /= math.sqrt(d)
    xs, ys = x[:, BLOCK:].ravel(), y[:, BLOCK:].ravel()
    q = np.ascontiguousarray(table[:, :d]).take(xs, axis=0).reshape(n, m, BLOCK, d)
    kv = np.ascontiguousarray(table[:, d:]).take(x.ravel(), axis=0).reshape(n, m + 1, BLOCK, 2 * d)
    weight, every, got = attend(q, kv, causal_bias(near))
    # scores in pieces of SIZE, those of the groups first: of a query only its row's first piece and that of its next group are needed
    order, group, cuts = by_group(ys)
    pieces, wide = base.reshape(-1, SIZE), base.shape[1] // SIZE
    out_of = np.ascontiguousarray(out.reshape(d, wide, SIZE).transpose(1, 0, 2))
    first = xs.take(order) * wide
    share = (real[:, BLOCK:].ravel().take(order) / max(1, real[:, BLOCK:].sum())).astype(embed.dtype)
    near_got = got.reshape(-1, d).take(order, axis=0)
    whole, inside = pieces.take(first, axis=0), pieces.take(first + 1 + group, axis=0)
    whole += near_got @ out_of[0]
    for g, a, b in cuts:
        inside[a:b] += near_got[a:b] @ out_of[1 + g]
    _surplus(whole, group, share)
    _surplus(inside, ys.take(order) % SIZE, share)
    g_base = []
    if of_base:
        g_base.append(np.zeros_like(base))
        np.add.at(g_base[0].reshape(-1, SIZE), first, whole)
        np.add.at(g_base[0].reshape(-1, SIZE), first + 1 + group, inside)
    g_out, g_got = np.zeros_like(out_of), whole @ out_of[0].T
    g_out[0] = near_got.T @ whole
    for g, a, b in cuts:
        g_out[1 + g] = near_got[a:b].T @ inside[a:b]
        g_got[a:b] += inside[a:b] @ out_of[1 + g].T
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    g_got = g_got.take(place, axis=0).reshape(got.shape)
    # of weights that are not yet divided by their sums
    g_got /= every
    g_score = g_got @ turned(pairs_of(kv[..., d:]))
    g_score -= summed(g_got * got)[..., None]
    g_score *= weight
    g_near = np.bincount(back[back >= 0], weights=g_score.reshape(-1, BLOCK, 2 * BLOCK).sum(axis=0)[back >= 0], minlength=len(near))[:len(near)].astype(near.dtype)
    g_qkv = np.zeros((n, m + 1, BLOCK, 3 * d), embed.dtype)
    np.divide(g_score @ pairs_of(kv[..., :d]), math.sqrt(d), out=g_qkv[:, 1:, :, :d])
    for a, g in ((d, turned(g_score) @ q), (2 * d, turned(weight) @ g_got)):
        g_qkv[:, 1:, :, a:a + d] = g[:, :, BLOCK:]
        g_qkv[:, :-1, :, a:a + d] += g[:, :, :BLOCK]
    g_qkv, at = g_qkv.reshape(-1, 3 * d), x.ravel()
    by_row = np.argsort(at.astype(np.uint16) if len(embed) <= 1 << 16 else at, kind="stable")
    met = at.take(by_row)
    starts = np.flatnonzero(np.append(True, met[1:] != met[:-1]))
    g_embed = np.zeros_like(embed)
    g_embed[met[starts]] = np.add.reduceat((g_qkv @ project.T).take(by_row, axis=0), starts, axis=0)
    return [g_embed, embed.take(at, axis=0).T @ g_qkv, g_out.transpose(1, 0, 2).reshape(out.shape), g_near, *g_base]


def score_symbols(model: Attention, flat: np.ndarray, sizes: np.ndarray, chunk: int = 384) -> np.ndarray:
    """Natural log probability of each sequence of symbols; every symbol is scored once, chunk blocks at a time."""
    at, last = laid_out(sizes)
    target = np.zeros(last * BLOCK, np.int64)
    target[at] = model.class_of.take(flat)
    before = np.full(last * BLOCK, model.row_of[-1], np.int64)
    before[at[1:]] = model.row_of.take(flat[:-1])
    before[at[np.cumsum(sizes) - sizes]] = model.row_of[-1]
    bias = causal_bias(model.near)
    gained = np.zeros(last * BLOCK)
    q_of, kv_of = np.ascontiguousarray(model.qkv[:, :WIDTH]), np.ascontiguousarray(model.qkv[:, WIDTH:])
    pieces, wide = np.ascontiguousarray(model.base).reshape(-1, SIZE), model.base.shape[1] // SIZE
    out_of = np.ascontiguousarray(model.out.reshape(WIDTH, wide, SIZE).transpose(1, 0, 2))
    for a in range(1, last, chunk):
        b = min(last, a + chunk)
        own, aim = before[(a - 1) * BLOCK:b * BLOCK], target[a * BLOCK:b * BLOCK]
        order, group, cuts = by_group(aim)
        got = attend(q_of.take(own[BLOCK:], axis=0).reshape(1, -1, BLOCK, WIDTH), kv_of.take(own, axis=0).reshape(1, -1, BLOCK, 2 * WIDTH), bias)[2]
        got, first = got.reshape(-1, WIDTH).take(order, axis=0), own[BLOCK:].take(order) * wide
        whole, inside = pieces.take(first, axis=0), pieces.take(first + 1 + group, axis=0)
        whole += got @ out_of[0]
        for g, x, y in cuts:
            inside[x:y] += got[x:y] @ out_of[1 + g]
        place = np.arange(0, inside.size, SIZE)
        gain = whole.ravel().take(place + group) + inside.ravel().take(place + aim.take(order) % SIZE)
        gain -= np.log(summed(np.exp(inside, out=inside)))
        gain -= np.log(summed(np.exp(whole, out=whole)))
        gained[a * BLOCK + order] = gain
    return totals(gained.take(at) + model.inside.take(flat), sizes)


# --- the operator ---------------------------------------------------------------------------

def score(docs: DataFrame, held_out: Column, name: str = MODEL) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of (doc_id, text).

    Learns from the rows that are not held out. Logarithms are to base 10.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", "text", held_out.alias("held_out"))
    gathered = written(_gather(docs, name), "lm-gathered", compression="zstd")

    counts = written(gathered.where("kind = 0").groupBy(F.col("key").alias("word")).agg(F.sum("n").alias("c")), "lm-words")
    seen, distinct = counts.agg(F.sum("c"), F.count("*")).first()
    seen = seen or 0
    top = counts.orderBy(F.desc("c"), "word").limit(TABLE_WORDS).toArrow()
    keys, values = top["word"].to_numpy().view(np.uint64), top["c"].to_numpy()
    order = np.argsort(keys)
    symbols = 2 * Speller(name).size
    of_symbol = np.zeros(symbols)
    for r in gathered.where("kind = 1").groupBy("key").agg(F.sum("n").alias("n")).collect():
        of_symbol[r["key"]] = r["n"]
    coded, end = gathered.where("kind = 2").select("codes"), Speller(name).end
    rows = rows_of(cluster(count_pairs(coded, symbols, end, ROWS * 2 * CONTEXT, neighbour_cells(of_symbol)), of_symbol), of_symbol)
    base = base_of_counts(rows, count_pairs(coded, symbols, end, len(rows.class_of_row) * CLASSES, rows.place))
    state = fit_coded(coded, symbols, end, of_symbol.sum(), rows, base)
    shared = spark.sparkContext.broadcast((made(rows, base, state), keys[order], values[order]))

    scored = written(_scored(gathered.where("kind >= 2"), symbols, end, shared), "lm-scored")
    rare = scored.select("row", F.explode("rare").alias("word")).join(counts, "word", "left")
    rare = rare.groupBy("row").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("rare_sum"), F.count("c").alias("rare_known"))
    below = math.log10(seen + 0.5 * (distinct + 1))
    return scored.drop("rare").join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(seen).cast("long").alias("train_tokens"),
        (F.col("sum") + F.coalesce("rare_sum", F.lit(0.0)) - F.col("n_tokens") * F.lit(below)).alias("base_score"), "score")


def _scored(chunks: DataFrame, symbols: int, end: int, shared) -> DataFrame:
    """Scores, what the broadcast table knows of each text, and the hashes of its other words; row is the row's own number."""
    code, id_kind = _code(symbols), chunks.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _drop_words()
        model, *table = shared.value
        last = np.array([_HASH(END_WORD)], np.uint64)
        ended = int(look_up(table, last)[0])
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for codes, words, hashes, sizes, ids, away in zip(*batch.columns):
                flat, hashes, counts = (np.frombuffer(v.as_buffer(), t) for v, t in ((codes, code), (hashes, np.uint64), (sizes, np.int64)))
                words = np.frombuffer(words.as_buffer(), _number(len(hashes)))
                c = look_up(table, hashes)
                common = c > 0
                sums = totals(np.where(common, np.log10(c + 0.5), 0.0)[words], counts) + (math.log10(ended + 0.5) if ended else 0.0)
                common = common[words]
                rare = hashes[words[~common]].view(np.int64)
                ends = np.cumsum(totals(~common, counts))
                if not ended:
                    rare = np.insert(rare, ends, last.view(np.int64)[0])
                    ends = ends + np.arange(1, len(ids) + 1)
                ends = np.append(0, ends).astype(np.int32)
                scores = score_symbols(model, flat.astype(np.int32), np.diff(np.flatnonzero(flat == end) + 1, prepend=0))
                yield pa.RecordBatch.from_arrays([
                    pa.array(number + np.arange(len(counts))), ids.values, away.values, pa.array(counts + 1),
                    pa.array(totals(common, counts) + (ended > 0)), pa.array(sums), pa.array(scores / math.log(10)),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(rare))],
                    names=["row", "doc_id", "held_out", "n_tokens", "known", "sum", "score", "rare"])
                number += len(counts)

    kind = f"row long, doc_id {id_kind}, held_out boolean, n_tokens long, known long, sum double, score double, rare array<long>"
    return chunks.select("codes", "words", "hashes", "sizes", "ids", "held").mapInArrow(run, kind)
