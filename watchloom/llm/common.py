"""What the operators of this package share: folds, the shared folder, Arrow maps, ragged arrays, ranges."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from watchloom.session import checkpoint_dir

#: Rows of one Arrow batch, and bytes of text that are worked on at a time.
BATCH_ROWS, SLICE_BYTES = 1000, 4 << 20


def fold(key: str, parts: int) -> Column:
    """crc32 of the id as text, modulo parts. A null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % parts


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows, so that a batch of very long texts fits a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors can reach."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """The rows, written once and read again: a cut in the lineage that survives lost executors. options: of the writer."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def texts_of(column: pa.Array) -> list[str]:
    """Texts of a string column; null counts as the empty text."""
    return [t or "" for t in column.to_pylist()]


def objects(array: pa.Array) -> list:
    """The values of a text or binary array without nulls as Python objects, made in one go."""
    return array.to_numpy(zero_copy_only=False).tolist()


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in consecutive slices of about limit bytes of text; a longer text is a slice of its own."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
    ends = np.cumsum(lengths, dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def map_texts(
    docs: DataFrame, new: str, make: Callable[[], Callable[[list[str]], list]], text: str = "text", drop_text: bool = True,
) -> DataFrame:
    """The documents with new columns computed from whole texts, batch by batch.

    new: DDL of the new columns; make() runs once a task and gives a function from texts to one array a new
    column. A new column replaces an input column of the same name. The text itself is left out unless asked for.
    """
    added = T.StructType.fromDDL(new)
    names = {f.name.lower() for f in added}
    kept = [f for f in docs.schema if f.name.lower() not in names and not (drop_text and f.name == text)]
    out = T.StructType([*kept, *added])
    source = docs.select(*[F.col(f"`{f.name}`") for f in kept], *([F.col(f"`{text}`")] if drop_text or text not in [f.name for f in kept] else []))
    width = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch, text):
                arrays = work(texts_of(part.column(text)))
                arrays = [a if isinstance(a, pa.Array) else pa.array(a) for a in arrays]
                yield pa.RecordBatch.from_arrays([*part.columns[:width], *arrays], names=[f.name for f in out])

    return source.mapInArrow(run, out)


def runs_of(texts: pa.Array, table: bytes) -> tuple[pa.Array, np.ndarray]:
    """The runs of bytes that the table does not turn into blanks, of all texts as one binary array; how many each text has."""
    texts = pc.fill_null(texts, "")
    if not len(texts):
        return pa.array([], pa.large_binary()), np.zeros(0, np.int64)
    texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = (data.to_pybytes() if data else b"")[ends[0]:ends[-1]].translate(table)
    ends = ends - ends[0]
    if not raw:
        return pa.array([], pa.large_binary()), np.zeros(len(texts), np.int64)
    plain = np.frombuffer(raw, np.uint8)
    inside = plain != 32
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    borders = ends[1:-1][(ends[1:-1] > 0) & (ends[1:-1] < len(plain))]
    opens[borders] = inside[borders]
    closes[borders - 1] = inside[borders - 1]
    starts, stops = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    counts = np.diff(np.searchsorted(starts, ends))
    offsets = np.append(0, np.cumsum(stops - starts)).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(plain[inside].tobytes())]), counts


def ragged(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """flat[starts[0]:starts[0]+lengths[0]], then the next slice, and so on, in one array."""
    if not len(starts):
        return flat[:0]
    ends = np.cumsum(lengths)
    at = np.arange(ends[-1]) + np.repeat(starts - (ends - lengths), lengths)
    return flat[at]


def mix64(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective 64-bit mix (fixed shifts and multipliers of the splitmix64 generator)."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def with_bucket(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """The rows with an integer column bucket that grows with a never-null integer key, cut at about equal counts.

    The cuts are approximate quantiles of one narrow column; rows of one key are always in one bucket.
    """
    from pyspark.ml.feature import Bucketizer

    cuts: list[int] = []
    if buckets > 1:
        shares = [i / buckets for i in range(1, buckets)]
        cuts = sorted({float(c) for c in df.select(F.percentile_approx(key, F.array(*map(F.lit, shares)), F.lit(10 * buckets))).first()[0] or []})
    if not cuts:
        return df.withColumn("bucket", F.lit(0))
    cut = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="as_double", outputCol="bucket_of")
    placed = cut.transform(df.withColumn("as_double", F.col(key).cast("double")))
    return placed.withColumn("bucket", F.col("bucket_of").cast("int")).drop("as_double", "bucket_of")


def range_counts(rows: int, size: int, per_range: int = 1 << 20) -> tuple[int, int]:
    """(buckets, partitions) for so many rows and bytes of text."""
    buckets = int(max(1, min(size // per_range, rows // 16, 20_000)))
    return buckets, max(1, buckets // 4)


_held: dict[tuple, object] = {}


def held(key: tuple, make: Callable[[], object]) -> object:
    """The one large cache of a worker, kept between the tasks of an operator; another operator's goes before the new one is made.

    Workers live as long as the session: a cache an operator would keep for itself would lie beside those of all later ones.
    """
    if key not in _held:
        _held.clear()
        pa.default_memory_pool().release_unused()
        _held[key] = make()
    return _held[key]


class Pool:
    """Units (words of a text) and the ids each stands for, as slices of one flat array.

    encode_new(units) -> (flat ids, lengths) is called once for the units a batch brings that are not known yet.
    Beyond limit units the later half is forgotten; frequent units come early and stay. Indices hold for one batch.
    """

    def __init__(self, encode_new: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = 400_000) -> None:
        self.encode_new, self.limit = encode_new, limit
        pool = self

        class Index(dict):
            def __missing__(self, unit: str) -> int:
                at = self[unit] = len(self)
                pool.pending.append(unit)
                return at

        self.kind = Index
        self.index: dict[str, int] = Index()
        self.pending: list[str] = []
        self.flat = np.zeros(1 << 16, np.int32)
        self.starts = np.zeros(1 << 14, np.int64)
        self.lengths = np.zeros(1 << 14, np.int32)
        self.count = self.used = 0

    def _grown(self, array: np.ndarray, size: int) -> np.ndarray:
        return array if size <= len(array) else np.concatenate([array, np.zeros(max(size, 2 * len(array)) - len(array), array.dtype)])

    def begin(self) -> None:
        if self.count > self.limit:
            half = self.limit // 2
            kept = self.kind()
            for unit, at in self.index.items():
                if at >= half:
                    break
                dict.__setitem__(kept, unit, at)
            self.index, self.count, self.used = kept, half, int(self.starts[half])

    def indices(self, units: list[str]) -> np.ndarray:
        out = np.fromiter(map(self.index.__getitem__, units), np.int64, len(units))
        if self.pending:
            flat, lengths = self.encode_new(self.pending)
            self.pending = []
            n, used = self.count + len(lengths), self.used + len(flat)
            self.flat = self._grown(self.flat, used)
            self.starts, self.lengths = self._grown(self.starts, n), self._grown(self.lengths, n)
            self.flat[self.used:used] = flat
            self.lengths[self.count:n] = lengths
            self.starts[self.count:n] = self.used + np.cumsum(lengths) - lengths
            self.count, self.used = n, used
        return out

    def ids(self, at: np.ndarray) -> np.ndarray:
        return ragged(self.flat, self.starts[at], self.lengths[at])


def totals(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive groups of values; counts has the size of each group, which may be 0."""
    sums = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(counts)
    return sums[ends] - sums[ends - counts]


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each node of the links (a, b) reaches.

    Rounds of large and small stars: each node points its larger neighbours, then all its neighbours, to the smallest
    of them. Every round is two groupings on the node; a hub's neighbours are spread by a join, never gathered. It ends
    when every node points to a node that points nowhere. The rounds grow with the logarithm of the longest path.
    Raises if they do not end.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    for _ in range(rounds):
        per_node = edges.groupBy("u").agg(F.min("v").alias("low"), F.max("v").alias("high"))
        roots = edges.select("v").distinct()
        if per_node.join(roots, F.col("u") == F.col("v"), "left").where("low != high OR v IS NOT NULL").isEmpty():
            break
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = written(small.where("u != v").distinct(), "edges")
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
