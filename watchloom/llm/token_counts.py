"""Operator 2: token counts by a two-tier lookup on the map side.

A text is cut into pre-tokens that no piece of the vocabulary spans. The first tier is a compact table of the frequent
ones and their token counts, made once from a bounded sample of documents and broadcast; the second is a cache in each
worker, where the library encodes what neither tier has. Nothing is shuffled. The sample only decides what is looked up
where: every count is exact whatever the table holds.

Null texts count as empty: no bytes, no tokens. Repeated rows give repeated results, an empty table an empty one; a new
column replaces an input column of its name, others stay.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchloom.llm.common import held, map_texts, slices, small_batches, texts_of, totals
from watchloom.llm.pieces import MARK, MODEL, units_of

#: Bounds of the sample (documents, distinct pre-tokens a document), of the broadcast table and of a worker's cache.
SAMPLE_DOCS, SAMPLE_UNITS, TABLE_UNITS, CACHE_UNITS = 500, 1000, 32_768, 300_000
#: Pre-tokens longer than this are not cached.
LONG_UNIT = 64


class Library:
    """Counts of single pre-tokens by the sentencepiece library."""

    def __init__(self, name: str) -> None:
        import public_tokenizers
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))

    def count(self, unit: str) -> int:
        """The library puts a mark before a text, so a marked unit goes without its first mark; others follow a line
        break, which takes two ids (the mark and the byte piece)."""
        if unit[0] == MARK:
            return len(self.model.encode(unit[1:])) if len(unit) > 1 else 1
        return len(self.model.encode("\n" + unit)) - 2


def frequent_units(docs: DataFrame, name: str, text: str) -> tuple[bytes, bytes, bytes]:
    """The most frequent pre-tokens of a bounded sample: texts on end, their characters and token counts as 16-bit numbers.

    At most SAMPLE_UNITS of each of about SAMPLE_DOCS documents reach the driver, as counts of each task.
    """
    n = docs.count()
    if not n:
        return b"", b"", b""
    share = min(1.0, SAMPLE_DOCS / n)
    sample = docs.select(F.col(f"`{text}`").alias("text")).where(F.rand(7) < share)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for part in slices(batch, "text"):
                for t in texts_of(part.column(0)):
                    seen.update(dict(Counter(u for u in units_of(t) if len(u) <= LONG_UNIT).most_common(SAMPLE_UNITS)))
        top = seen.most_common(TABLE_UNITS)
        yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in top], pa.string()), pa.array([c for _, c in top], pa.int64())], names=["unit", "n"])

    total: Counter[str] = Counter()
    for unit, c in sample.mapInArrow(counts, "unit string, n long").collect():
        total[unit] += c
    library = Library(name)
    units = [u for u, _ in total.most_common(TABLE_UNITS)]
    return "".join(units).encode(), np.array([len(u) for u in units], "<u2").tobytes(), np.array([library.count(u) for u in units], "<u2").tobytes()


def count_tokens(docs: DataFrame, name: str = MODEL, limit: int = 4096, text: str = "text") -> DataFrame:
    """The documents with n_bytes, n_tokens and over_limit (more than limit tokens) in place of the text."""
    small_batches(docs.sparkSession)
    table = docs.sparkSession.sparkContext.broadcast(frequent_units(docs, name, text))
    token = uuid.uuid4().hex

    def make():
        known = _tiers(token, name, table)

        def work(texts: list[str]) -> list:
            units: list[str] = []
            counts = np.zeros(len(texts), np.int64)
            for i, t in enumerate(texts):
                own = units_of(t)
                counts[i] = len(own)
                units += own
            tokens = totals(np.fromiter(map(known.__getitem__, units), np.int64, len(units)), counts)
            known.trim()
            return [np.array([len(t.encode()) for t in texts], np.int64), tokens, tokens > limit]
        return work

    return map_texts(docs, "n_bytes long, n_tokens long, over_limit boolean", make, text)


class Tiers(dict):
    """The frequent table and, behind it, the worker's cache."""

    def __init__(self, name: str, packed: tuple[bytes, bytes, bytes]) -> None:
        texts, lengths, counts = packed
        texts, ends = texts.decode(), np.cumsum(np.frombuffer(lengths, "<u2"), dtype=np.int64).tolist()
        super().__init__(zip((texts[a:b] for a, b in zip([0, *ends], ends)), np.frombuffer(counts, "<u2").tolist()))
        self.first, self.library = len(self), Library(name)

    def __missing__(self, unit: str) -> int:
        count = self.library.count(unit)
        if len(unit) <= LONG_UNIT:
            self[unit] = count
        return count

    def trim(self) -> None:
        """Forget the later half of the cache when it is full; the table stays."""
        if len(self) > self.first + CACHE_UNITS:
            kept = list(self.items())[: self.first + CACHE_UNITS // 2]
            self.clear()
            self.update(kept)


def _tiers(token: str, name: str, table) -> Tiers:
    """One for a worker and call, kept between tasks."""
    return held(("tiers", token), lambda: Tiers(name, table.value))
