"""Operator 9: token ids in files of fixed-width packed numbers.

Documents are cut into ranges of ascending id and encoded in order. A file is a Parquet file of blocks; a block holds
the ids of consecutive documents, each id in the least number of bits that the vocabulary needs, with the documents' ids
and lengths beside them and the block's number of ids as its offset step. Blocks are written by Spark, so any store
works and a lost task is repeated without a trace. One block can be read alone, and within it any id, because id k lies
at bit k * width. Packing and unpacking are numpy operations on whole blocks.

Null texts are empty: only the end id. Rows that share a document id keep their own entries, ordered by text. Null document
ids come first. An empty table gives no blocks and no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchloom.llm.common import Pool, held, objects, ragged, range_counts, shared_path, slices, small_batches, totals, with_bucket

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
#: Stands for a null id where rows are ordered.
LEAST = -(1 << 63)
BLOCKS = "part long, block long, width int, n_ids long, doc_ids binary, no_id binary, lengths binary, payload binary"
#: Latin-1 characters whose splitting and lower-casing is plain: letters, digits, and marks but for ' and <.
PLAIN = (b"\n !\"#$%&()*+,-./0123456789:;=>?@ABCDEFGHIJKLMNOPQRSTUVWXYZ[\\]^_`abcdefghijklmnopqrstuvwxyz{|}~"
         + bytes(c for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7)))
#: Bytes of UTF-8 that no plain text has: the lead byte C3 with any byte after it but those of the two marks is a plain letter.
ODD = np.array([chr(b).encode() not in {bytes([c]) for c in PLAIN if c < 128} and not (b == 0xC3 or 0x80 <= b < 0xC0 and b not in (0x97, 0xB7))
                for b in range(256)])
#: What the vocabulary's own splitting gives on plain lower-case text; line breaks part units.
PART = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[!-&(-/:;=-@\[-`{-~]+|\n")
#: Marks a unit that is no plain text.
RAW = "\x00"


class Library:
    """The tokenizers library behind two caches: of units between blanks, and of the parts that plain units have."""

    def __init__(self, name: str) -> None:
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.size = self.tokenizer.get_vocab_size()
        self.closes = np.zeros(self.size, bool)
        self.closes[[i for piece, i in self.tokenizer.get_vocab().items() if piece.endswith("</w>")]] = True
        self.parts = Pool(self.encode_parts, 400_000)
        self.units = Pool(self.encode_units, 300_000)

    def encode(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def encode_parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain parts, many in one call: a piece with the word end closes each. A line break has none."""
        flat, lengths = [], []
        for i in range(0, len(parts), 2000):
            some = parts[i:i + 2000]
            ids = np.array(self.encode(" ".join(some)), np.int32)
            cuts = np.flatnonzero(self.closes[ids]) + 1
            if "\n" not in some and len(cuts) == len(some):
                flat.append(ids)
                lengths.append(np.diff(cuts, prepend=0))
            else:
                each = [self.encode(u) for u in some]
                flat.append(np.array([k for ids in each for k in ids], np.int32))
                lengths.append(np.array([len(ids) for ids in each], np.int64))
        return np.concatenate(flat), np.concatenate(lengths)

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units, flat, and how many each has; plain units from their parts."""
        raw = [i for i, u in enumerate(units) if u[0] == RAW]
        each = [self.encode(units[i][1:]) for i in raw]
        for i in raw:
            units[i] = ""
        self.parts.begin()
        found = PART.findall("\n".join(units))
        at = self.parts.indices(found)
        breaks = np.flatnonzero(np.fromiter(map("\n".__eq__, found), bool, len(found)))
        ends = np.cumsum(self.parts.lengths[at], dtype=np.int64)
        flat, lengths = self.parts.ids(at), np.diff(np.concatenate([[0], ends[breaks], ends[-1:]]))
        if not raw:
            return flat, lengths
        starts = np.cumsum(lengths) - lengths
        lengths = np.resize(lengths, len(units)) if len(lengths) else np.zeros(len(units), np.int64)
        starts = np.resize(starts, len(units)) if len(starts) else np.zeros(len(units), np.int64)
        own = np.array([len(ids) for ids in each], np.int64)
        lengths[raw], starts[raw] = own, len(flat) + np.cumsum(own) - own
        return ragged(np.concatenate([flat, np.array([k for ids in each for k in ids], np.int32)]), starts, lengths), lengths


def units_of(text: str) -> list[str]:
    """Units between blanks: of a plain text in lower case, of others marked, for the library to split."""
    try:
        plain = not text.encode("latin-1").translate(None, PLAIN)
    except UnicodeEncodeError:
        plain = False
    if plain:
        return text.lower().split()
    return [RAW + u for u in text.replace("\n", " ").split(" ") if u]


def distinct_units(pieces: pa.Array) -> tuple[np.ndarray, list[str]]:
    """Places of the pieces that are not empty, and the unit of each, as units_of gives it; pieces hold no blanks or line breaks.

    Plain pieces are told by their bytes, all at once: letters of Latin-1 beyond ASCII are the byte C3 and one more.
    """
    pieces = pieces.cast(pa.large_string())
    sizes = pc.binary_length(pieces).to_numpy()
    filled = np.flatnonzero(sizes)
    if not len(filled):
        return filled, []
    ends = np.frombuffer(pieces.buffers()[1], np.int64)[pieces.offset:pieces.offset + len(pieces) + 1]
    odd = ODD[np.frombuffer(pieces.buffers()[2], np.uint8)[ends[0]:ends[-1]]]
    raw = np.add.reduceat(odd, ends[filled] - ends[0], dtype=np.int64) > 0
    units = objects(pc.utf8_lower(pieces if len(filled) == len(pieces) else pieces.take(pa.array(filled))))
    marked = np.flatnonzero(raw)
    for i, text in zip(marked.tolist(), objects(pieces.take(pa.array(filled[marked])))):
        units[i] = RAW + text
    return filled, units


def library(name: str) -> Library:
    return held(("library", name), lambda: Library(name))


def encode_texts(texts: pa.Array | list[str], name: str, end: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, flat, each text followed by the end id, and how many each has.

    Arrow cuts the texts at blanks and numbers the distinct pieces; only those are looked up.
    """
    pool = library(name).units
    pool.begin()
    texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
    parts = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
    cuts = np.append(0, np.cumsum(parts.value_lengths().to_numpy().astype(np.int64)))
    coded = parts.flatten().dictionary_encode()
    piece = coded.indices.to_numpy()
    filled, units = distinct_units(coded.dictionary)
    at = pool.indices(units)
    lengths = np.zeros(len(coded.dictionary), np.int64)
    lengths[filled] = pool.lengths[at]
    starts = np.zeros(len(coded.dictionary), np.int64)
    starts[filled] = pool.starts[at]
    flat = ragged(pool.flat, starts[piece], lengths[piece])
    sums = np.append(0, np.cumsum(lengths[piece]))[cuts]
    if end is None:
        return flat, np.diff(sums)
    return np.insert(flat, sums[1:], end), np.diff(sums) + 1


def pack(ids: np.ndarray, width: int) -> bytes:
    """Each id in width bits, lowest bit first."""
    if width == 16:
        return ids.astype("<u2").tobytes()
    bits = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
    return np.packbits(bits, bitorder="little").tobytes()


def unpack(payload: bytes, width: int, start: int, count: int) -> np.ndarray:
    """Ids start .. start + count - 1 of a block; only their bytes are touched."""
    if width == 16:
        return np.frombuffer(payload, "<u2", count, 2 * start).astype(np.uint32)
    first, last = start * width // 8, -(-(start + count) * width // 8)
    bits = np.unpackbits(np.frombuffer(payload, np.uint8, last - first, first), bitorder="little")
    bits = bits[start * width - 8 * first:][: count * width].reshape(count, width)
    whole = np.zeros((count, 32), np.uint8)
    whole[:, :width] = bits
    return np.packbits(whole, axis=1, bitorder="little").view("<u4").ravel().astype(np.uint32)


def write_token_files(docs: DataFrame, path: str | None = None, name: str = VOCABULARY, end: int = END_ID) -> str:
    """Write the documents (doc_id, text) in ascending id order; gives the folder."""
    spark = docs.sparkSession
    small_batches(spark)
    path = path or shared_path(spark, "token-files")
    rows, size = docs.select(F.count("*"), F.sum(F.octet_length("text"))).first()
    buckets, partitions = range_counts(rows, size or 0)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("k", F.coalesce("doc_id", F.lit(LEAST)))
    ranged = with_bucket(keyed, "k", buckets).repartitionByRange(partitions, "bucket").sortWithinPartitions("k", "text").drop("k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = max(1, int(max(library(name).size - 1, end)).bit_length())
        part, block = TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece in slices(batch, "text", 1 << 20):
                flat, counts = encode_texts(piece.column(1), name, end)
                ids = np.array(piece.column(0).fill_null(0), np.int64)
                missing = np.array(piece.column(0).is_null().to_numpy(zero_copy_only=False), np.uint8)
                yield pa.RecordBatch.from_pylist([{
                    "part": part, "block": block, "width": width, "n_ids": len(flat), "doc_ids": ids.astype("<i8").tobytes(),
                    "no_id": missing.tobytes(), "lengths": counts.astype("<u4").tobytes(), "payload": pack(flat, width)}],
                    schema=SCHEMA)
                block += 1

    ranged.mapInArrow(run, BLOCKS).write.option("compression", "none").parquet(path)
    return path


SCHEMA = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("width", pa.int32()), ("n_ids", pa.int64()),
                    ("doc_ids", pa.binary()), ("no_id", pa.binary()), ("lengths", pa.binary()), ("payload", pa.binary())])


def block_offsets(spark: SparkSession, path: str) -> DataFrame:
    """part, block, first: the ids before each block in the order of the files.

    Blocks are numbered within the part that wrote them; what is ordered in one place is one sum a part.
    """
    from pyspark.sql import Window

    blocks = spark.read.parquet(path).select("part", "block", "n_ids")
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = Window.partitionBy("part").orderBy("block")
    blocks = blocks.withColumn("inside", F.sum("n_ids").over(inside) - F.col("n_ids"))
    return blocks.join(parts, "part").select("part", "block", (F.col("before") + F.col("inside")).alias("first"))


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every document, from the files."""
    blocks = spark.read.parquet(path).join(block_offsets(spark, path), ["part", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                counts = np.frombuffer(b["lengths"], "<u4").astype(np.int64)
                ends = np.cumsum(counts)
                data = memoryview(unpack(b["payload"], b["width"], 0, b["n_ids"]).astype("<u4").tobytes())
                crc = [zlib.crc32(data[4 * (e - n):4 * e]) for e, n in zip(ends.tolist(), counts.tolist())]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.frombuffer(b["doc_ids"], "<i8"), mask=np.frombuffer(b["no_id"], np.uint8).astype(bool)),
                    pa.array(b["first"] + ends - counts), pa.array(counts), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return blocks.select("width", "n_ids", "doc_ids", "no_id", "lengths", "payload", "first").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_ids(spark: SparkSession, path: str, first: int, count: int) -> np.ndarray:
    """Ids first .. first + count - 1 of the whole corpus; reads only the blocks that hold them."""
    found = block_offsets(spark, path).where((F.col("first") < first + count)).join(
        spark.read.parquet(path).select("part", "block", "width", "n_ids", "payload"), ["part", "block"]).where(
        F.col("first") + F.col("n_ids") > first).orderBy("first").collect()
    return np.concatenate([np.zeros(0, np.uint32)] + [
        unpack(b["payload"], b["width"], max(0, first - b["first"]), min(first + count, b["first"] + b["n_ids"]) - max(first, b["first"])) for b in found])
