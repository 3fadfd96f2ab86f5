"""Records that do not end with their line, from files that all tasks read.

Spark cuts a text file into splits and each split into lines, of which one may lie inside a quoted value or an object.
Whether it does depends on all the text before it, but only through a few numbers: the parity of the quotes, the depth
of the brackets. A first pass takes these numbers of each split; their running sums over the splits of a file, one row
a split, tell every split how it starts. A second pass reads the splits again, puts together what belongs together and
gives out whole records; only the pieces of records that go over the end of a split are shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PIECES = "file string, block long, whole boolean, first boolean, place long, value string"


def _pieces_of(spark: SparkSession, path: str | Sequence[str], separator: str) -> DataFrame:
    return spark.read.option("lineSep", separator).text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.Array]]:
    """Consecutive lines of one split, batch by batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        file, block = batch.column("file").dictionary_encode(), batch.column("block").to_numpy()
        code = file.indices.to_numpy()
        cuts = [0, *(np.flatnonzero((code[1:] != code[:-1]) | (block[1:] != block[:-1])) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield file.dictionary[int(code[a])].as_py(), int(block[a]), batch.column("value").slice(a, b - a)


def _batch(rows: list[tuple], ddl: Sequence[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(ddl)], names=[n for n, _ in ddl])


_PIECE = [("file", pa.string()), ("block", pa.int64()), ("whole", pa.bool_()), ("first", pa.bool_()), ("place", pa.int64()), ("value", pa.string())]


def _joined(pieces: DataFrame, glue: str) -> DataFrame:
    """Whole records, and those put together from the pieces that several splits hold: file, first, place, value.

    ``block`` of a piece is the split its record starts in; ``place`` orders the pieces of a record.
    """
    whole = pieces.filter("whole").select("file", "first", "place", "value")
    parts = pieces.filter("NOT whole").groupBy("file", "block").agg(
        F.max("first").alias("first"), F.min("place").alias("place"), F.array_sort(F.collect_list(F.struct("place", "value"))).alias("parts"))
    return whole.unionByName(parts.select(
        "file", "first", "place", F.array_join(F.transform("parts", lambda p: p["value"]), glue).alias("value")))


# --- quoted text in columns ---------------------------------------------------------------

def _quote_summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each split: the parity of its quotes, whether some line ends with an odd number of quotes so far, and whether
    its first line ends with a carriage return."""
    seen: dict[tuple[str, int], list] = {}
    for file, block, values in _runs(batches):
        state = seen.setdefault((file, block), [0, False, values[0].as_py().endswith("\r")])
        odd = (np.cumsum(pc.count_substring(values, '"').to_numpy()) + state[0]) % 2
        state[0], state[1] = int(odd[-1]), state[1] or bool(odd.any())
    yield _batch([(f, b, *state) for (f, b), state in seen.items()], [
        ("file", pa.string()), ("block", pa.int64()), ("quotes", pa.int64()), ("odd", pa.bool_()), ("crlf", pa.bool_())])


def csv_texts(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Records of CSV files as texts: ``file, first`` (of its file)``, place, value``. A quoted value may hold line breaks.

    Quotes stand around values and are doubled inside them (RFC 4180); a lone quote inside a bare value is not expected.
    One row for each split of the input reaches the driver and the workers.
    """
    lines = _pieces_of(spark, path, "\n")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = lines.mapInArrow(_quote_summary, "file string, block long, quotes long, odd boolean, crlf boolean")
    splits = splits.withColumn("inside", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1)
    # a record that starts in this split and does not end in it
    open_ = ((F.col("inside").cast("int") + F.col("quotes")) % 2 == 1) & (~F.col("inside") | F.col("odd"))
    splits = splits.withColumn("opened", F.max(F.when(open_, F.col("block"))).over(before))
    # as the reader of whole files does it: the first line tells how the lines of a file end, in values too
    splits = splits.withColumn("crlf", F.first("crlf").over(Window.partitionBy("file").orderBy("block")))
    start = spark.sparkContext.broadcast({(r["file"], r["block"]): (r["inside"], r["opened"], r["crlf"]) for r in splits.collect()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, inside, key, number = None, [], False, None, 0

        def rest() -> list[tuple]:
            if not held:
                return []
            return [(at[0], key, False, at[1] == 0 and number == 0, at[1], "\n".join(held))]

        for file, block, values in _runs(batches):
            out: list[tuple] = []
            if (file, block) != at:
                out += rest()
                at, held, number = (file, block), [], 0
                inside, opened, crlf = start.value[at]
                key = opened if inside else block
                carried = inside
            odd = (np.cumsum(pc.count_substring(values, '"').to_numpy()) + int(inside)) % 2 == 1
            texts = [t[:-1] if t.endswith("\r") else t for t in values.to_pylist()] if crlf else values.to_pylist()
            begin = 0
            for end in np.flatnonzero(~odd).tolist():
                value = "\n".join([*held, *texts[begin:end + 1]]) if held or end > begin else texts[end]
                if carried:  # the end of a record of an earlier split
                    out.append((file, key, False, False, block, value))
                    carried, key, number = False, block, number + 1
                elif value:
                    out.append((file, block, True, block == 0 and number == 0, block, value))
                    number += 1
                held, begin = [], end + 1
            held += texts[begin:]
            inside = bool(odd[-1])
            if out:
                yield _batch(out, _PIECE)
        if held:
            yield _batch(rest(), _PIECE)

    return _joined(lines.mapInArrow(run, PIECES), "\n")


def read_csv_records(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Header row, every value as text; quoted values may hold line breaks, empty text stays empty.

    A file of any size is read by all tasks, with line breaks in values too.
    """
    options = {"header": "true", "inferSchema": "false", "multiLine": "true", "nullValue": "\u0000", "emptyValue": "", "escape": '"'}
    schema = spark.read.options(**options).csv(path).schema
    own = {k: v for k, v in options.items() if k not in ("header", "inferSchema")}
    texts = csv_texts(spark, path).filter("NOT first")
    return texts.select(F.inline(F.array(F.from_csv("value", _ddl(schema), own))))


def _ddl(schema) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` string" for f in schema)


# --- lists of objects ---------------------------------------------------------------------

#: a string (which may go on behind the end), a bracket or a comma; group 1: its closing quote
TOKEN = re.compile(r'"(?:[^"\\]|\\.)*(?:(")|\Z)|[\[\]{},]', re.S)
#: the rest of a string that started before
STRING = re.compile(r'(?:[^"\\]|\\.)*(?:(")|\Z)', re.S)


def _signs(text: str, inside: bool) -> tuple[list[tuple[int, str]], bool]:
    """(places of brackets and commas outside strings, whether the text ends inside a string)."""
    at = 0
    if inside:
        rest = STRING.match(text)
        if not rest or not rest[1]:
            return [], True
        at, inside = rest.end(), False
    found = []
    for token in TOKEN.finditer(text, at):
        if text[token.start()] == '"':
            inside = not token[1]
        else:
            found.append((token.start(), token[0]))
    return found, inside


def _bracket_summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each split, if it starts outside and inside a string: how it ends, its change of depth, its commas by depth; its first bracket."""
    seen: dict[tuple[str, int], list] = {}
    for file, block, values in _runs(batches):
        # the two cases: inside a string now, depth so far, commas by depth
        state = seen.setdefault((file, block), [None, [False, 0, Counter()], [True, 0, Counter()]])
        for text in values.to_pylist():
            for case in state[1:]:
                signs, inside = _signs(text, case[0])
                for _, sign in signs:
                    if sign == ",":
                        case[2][case[1]] += 1
                    else:
                        case[1] += 1 if sign in "[{" else -1
                        state[0] = state[0] or sign
                # the separator behind the piece closes an object, unless it stands in a string
                case[0], case[1] = inside, case[1] - (not inside)
    rows = [(f, b, first, *[x for c in cases for x in (c[0], c[1], list(c[2].items()))]) for (f, b), (first, *cases) in seen.items()]
    commas = pa.map_(pa.int64(), pa.int64())
    yield _batch(rows, [("file", pa.string()), ("block", pa.int64()), ("bracket", pa.string()), ("in0", pa.bool_()), ("d0", pa.int64()), ("c0", commas),
                        ("in1", pa.bool_()), ("d1", pa.int64()), ("c1", commas)])


def _starts(rows: list) -> dict[tuple[str, int], tuple[bool, int, int, int]]:
    """How each split starts: inside a string, depth, members before, and the depth at which members lie (0: the file is one object)."""
    out, state = {}, {}
    for r in sorted(rows, key=lambda r: (r["file"], r["block"])):
        now = state.setdefault(r["file"], [False, 0, 0, int(r["bracket"] != "{")])
        out[r["file"], r["block"]] = tuple(now)
        end, change, commas = (r["in1"], r["d1"], r["c1"]) if now[0] else (r["in0"], r["d0"], r["c0"])
        now[2] += (commas or {}).get(1 - now[1], 0) * now[3]
        now[0], now[1] = end, now[1] + change
    return out


_MEMBER = [("file", pa.string()), ("pos", pa.int64()), ("block", pa.int64()), ("whole", pa.bool_()), ("value", pa.string())]


class _Members:
    """The walk over one split: texts of the objects and lists that are members, as pieces where they go over its ends."""

    def __init__(self, file: str, block: int, start: tuple[bool, int, int, int]) -> None:
        self.file, self.block = file, block
        self.inside, self.depth, self.pos, self.base = start
        # what is open at the start belongs to a member of an earlier split
        self.member = self.late = self.depth > self.base
        self.held: list[str] = []

    def _out(self, text: str, ends: bool) -> tuple:
        row = (self.file, self.pos, self.block, ends and not self.late, "".join([*self.held, text]))
        self.held, self.member, self.late = [], False, False
        return row

    def walk(self, text: str) -> list[tuple]:
        out, begin = [], 0
        signs, self.inside = _signs(text, self.inside)
        for place, sign in signs:
            if sign == ",":
                self.pos += self.depth == self.base == 1
            elif sign in "[{":
                if self.depth == self.base and not self.member:
                    self.member, begin = True, place
                self.depth += 1
            else:
                self.depth -= 1
                if self.member and self.depth == self.base:
                    out.append(self._out(text[begin:place + 1], True))
        # the last piece of a file has no brace behind it, and then all is closed
        if self.inside or self.depth > 0:
            self.depth -= not self.inside
            if self.member:
                if not self.inside and self.depth == self.base:
                    out.append(self._out(text[begin:] + "}", True))
                else:
                    self.held.append(text[begin:] + "}")
        return out

    def rest(self) -> list[tuple]:
        return [self._out("", False)] if self.held else []


def read_json_array(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Members of a file that holds a list of objects, or its one object; other members are left
    out. One row per member: ``file, pos, line`` (the object as JSON text).

    Files are cut at closing braces, so neither a file nor a list is ever one row. ``pos`` counts all members. Members that
    do not parse are left out. One row for each split of the input reaches the driver and the workers.
    """
    pieces = _pieces_of(spark, path, "}")
    start = spark.sparkContext.broadcast(_starts(pieces.mapInArrow(
        _bracket_summary, "file string, block long, bracket string, in0 boolean, d0 long, c0 map<long,long>, in1 boolean, d1 long, c1 map<long,long>").collect()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for file, block, values in _runs(batches):
            out: list[tuple] = []
            if own is None or (file, block) != (own.file, own.block):
                out += own.rest() if own else []
                own = _Members(file, block, start.value[file, block])
            for text in values.to_pylist():
                out += own.walk(text)
            yield _batch(out, _MEMBER)
        yield _batch(own.rest() if own else [], _MEMBER)

    found = pieces.mapInArrow(run, "file string, pos long, block long, whole boolean, value string")
    parts = found.filter("NOT whole").groupBy("file", "pos").agg(F.array_sort(F.collect_list(F.struct("block", "value"))).alias("parts"))
    both = found.filter("whole").select("file", "pos", "value").unionByName(
        parts.select("file", "pos", F.array_join(F.transform("parts", lambda p: p["value"]), "").alias("value")))
    parsed = both.withColumn("_v", F.expr("try_parse_json(value)")).filter(F.expr("schema_of_variant(_v)").startswith("OBJECT"))
    return parsed.select("file", F.col("pos").cast("int").alias("pos"), F.expr("to_json(_v)").alias("line"))
