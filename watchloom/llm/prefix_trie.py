"""Operator 13: the trie of conversation prefixes, with subtree totals by parallel tree contraction.

Turns are placed by a range-partitioned sort on (conversation, turn), so a conversation of any length is spread; what passes
between ranges is one row for each range and conversation. A node is known by its depth and two 64-bit exclusive ors over
the hashes of (place, turn), which a running window gives for every prefix; equal prefixes are one group.

Subtree totals come from rounds of joins on the parent. Rake: every leaf adds its total to its parent and goes. Compress: a
node with one child is taken out of its chain, its own value moves to the edge below it; the bits of the depth choose nodes
so that no two neighbours go at once and a chain halves in a round. When all nodes are gone, the rounds are read backwards:
a node taken out of a chain gets its own value, that of its edge and the total of its child. Rounds grow with the logarithm of
the longest chain and of the tree; what is left is written after each.

Rows without conv_id belong to no conversation. Turns are ordered by turn, null first; turns of one number by the MD5 of role,
NUL and text. Null roles and texts are empty. Repeated rows are turns of their own. An empty table gives no rows. Other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchloom.llm.common import written

#: Conversations of one hundred share what they start with; up to PREFIXES - 1 turns of it.
FAMILY, PREFIXES = 100, 6
#: Ids in one piece of the text that is hashed.
PIECE = 4096


def prefix_turns(conv_id: Column) -> Column:
    """Turns that a conversation takes from the first of its family."""
    return F.crc32(conv_id.cast("string").cast("binary")) % PREFIXES


def placed_turns(turns: DataFrame) -> DataFrame:
    """conv_id, place (from 1), digest (of role and text), n_chars and piece of every turn; pieces of a conversation follow one another."""
    spark = turns.sparkSession
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    narrow = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.md5(F.concat(role, F.lit("\0"), text)).alias("digest"),
        F.char_length(text).cast("long").alias("n_chars"))
    order = [F.col("turn").asc_nulls_first(), F.col("digest")]
    ranged = narrow.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "conv_id", *order)
    # written, because the ranges are drawn from a sample and must not be drawn again
    ranged = written(ranged.withColumn("piece", F.spark_partition_id()), "trie-turns")
    inside = Window.partitionBy("conv_id", "piece").orderBy(*order)
    local = ranged.withColumn("local", F.row_number().over(inside))
    return _carried(local, ranged.groupBy("conv_id", "piece").agg(F.count("*").alias("n")), F.sum("n")).withColumn(
        "place", (F.col("local") + F.col("carry")).cast("long")).select("conv_id", "place", "digest", "n_chars", "piece")


def _earlier():
    """The pieces of a conversation before a row's own."""
    return Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)


def _carried(rows: DataFrame, sums: DataFrame, total: Column) -> DataFrame:
    """The rows with carry, the total over the earlier pieces of their conversation; one row of sums a piece."""
    return rows.join(sums.select("conv_id", "piece", F.coalesce(total.over(_earlier()), F.lit(0)).alias("carry")), ["conv_id", "piece"])


def _salted(place: Column, salt: int) -> Column:
    return F.xxhash64(F.lit(salt), place.cast("long"), F.col("digest"))


def prefixes(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations: conv_id, depth, x, y of the whole; prefixes: conv_id, depth, x, y, up_x, up_y, n_chars), rebuilt."""
    placed = written(placed_turns(turns), "trie-placed")
    sizes = placed.groupBy("conv_id").agg(F.count("*").alias("length"))
    sizes = sizes.withColumn("h", prefix_turns(F.col("conv_id"))).withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY)
    heads = placed.where(F.col("place") < PREFIXES)
    lent = sizes.where("base != conv_id AND h > 0").select("conv_id", "h", "base").join(
        heads.select(F.col("conv_id").alias("base"), "place", "digest", "n_chars"), "base").where("place <= h")
    own_base = heads.where(F.col("conv_id") % FAMILY == 0).join(sizes.select("conv_id", "h"), "conv_id").where("place <= h")
    lent = lent.select("conv_id", "place", "digest", "n_chars").unionByName(own_base.select("conv_id", "place", "digest", "n_chars"))
    taken = lent.groupBy("conv_id").agg(F.count("*").alias("k"))
    convs = sizes.join(taken, "conv_id", "left").select("conv_id", "h", "length", F.coalesce("k", F.lit(0)).alias("k"))
    convs = written(convs.withColumn("depth", F.col("k") + F.greatest(F.col("length") - F.col("h"), F.lit(0))), "trie-conversations")
    own = placed.join(convs.select("conv_id", "h", "k"), "conv_id").where("place > h").withColumn("depth", F.col("place") - F.col("h") + F.col("k"))
    # lent turns stand before all own pieces
    every = lent.select("conv_id", F.lit(-1).alias("piece"), F.col("place").alias("depth"), "digest", "n_chars").unionByName(
        own.select("conv_id", "piece", "depth", "digest", "n_chars"))
    every = written(every.withColumn("s", _salted(F.col("depth"), 1)).withColumn("t", _salted(F.col("depth"), 2)).drop("digest"), "trie-rows")
    running = Window.partitionBy("conv_id", "piece").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    sums = every.groupBy("conv_id", "piece").agg(F.bit_xor("s").alias("s"), F.bit_xor("t").alias("t"))
    carry = sums.select("conv_id", "piece", F.coalesce(F.bit_xor("s").over(_earlier()), F.lit(0)).alias("cs"), F.coalesce(F.bit_xor("t").over(_earlier()), F.lit(0)).alias("ct"))
    rows = every.withColumn("ls", F.bit_xor("s").over(running)).withColumn("lt", F.bit_xor("t").over(running)).join(carry, ["conv_id", "piece"])
    x, y = F.col("ls").bitwiseXOR(F.col("cs")), F.col("lt").bitwiseXOR(F.col("ct"))
    rows = rows.select("conv_id", "depth", x.alias("x"), y.alias("y"), x.bitwiseXOR(F.col("s")).alias("up_x"), y.bitwiseXOR(F.col("t")).alias("up_y"), "n_chars")
    rows = written(rows, "trie-prefixes")
    whole = rows.select("conv_id", "depth", "x", "y").join(convs.select("conv_id", "depth"), ["conv_id", "depth"])
    return whole.unionByName(convs.where("depth = 0").select("conv_id", "depth", F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"))), rows


def trie_nodes(convs: DataFrame, rows: DataFrame) -> DataFrame:
    """One row a node: x, y, depth, conv_id (least member), parent_conv_id, n_convs, n_children, own (saved by this node)."""
    nodes = rows.groupBy("depth", "x", "y").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("n_chars").alias("n_chars"),
        F.max("up_x").alias("up_x"), F.max("up_y").alias("up_y"))
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(
        zero.alias("depth"), zero.alias("x"), zero.alias("y"), "conv_id", "n_convs", zero.alias("n_chars"),
        F.lit(None).cast("long").alias("up_x"), F.lit(None).cast("long").alias("up_y"))
    nodes = written(nodes.unionByName(root), "trie-nodes")
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("x").alias("up_x"), F.col("y").alias("up_y"), F.col("conv_id").alias("parent_conv_id"))
    nodes = nodes.join(above, ["depth", "up_x", "up_y"], "left")
    children = nodes.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, ["conv_id", "depth"], "left")
    return written(nodes.select(
        "conv_id", "depth", "x", "y", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"),
        ((F.col("n_convs") - 1) * F.col("n_chars")).alias("own")), "trie-nodes")


def subtree_totals(nodes: DataFrame, values: dict[str, Column], rounds: int = 200) -> DataFrame:
    """id, depth and, for each of values (a number of a node), its sum over the node's subtree.

    nodes: id, depth, up (the parent's id, whose depth is one less; null: root), n_children. (id, depth) tells nodes apart.
    Each round rakes all leaves and takes every second node or so out of chains. Raises if nodes are left after the rounds.
    """
    names = list(values)
    zero = F.lit(0).cast("long")
    live = written(nodes.select(
        "id", "depth", "up", F.when(F.col("up").isNotNull(), F.col("depth") - 1).alias("up_depth"), F.col("n_children").alias("open"),
        *[v.cast("long").alias(f"w_{n}") for n, v in values.items()], *[zero.alias(f"e_{n}") for n in names]), "trie-live")
    bits = int(live.agg(F.max("depth")).first()[0] or 0).bit_length() or 1
    log = []
    for k in range(rounds):
        # the bit of this round; after a whole cycle chains that rakes have made are met again
        odd = lambda c: F.expr(f"shiftright({c}, {k % bits}) & 1") == 1
        leaves = live.where("open = 0")
        raked = leaves.where("up IS NOT NULL").groupBy(F.col("up").alias("id"), F.col("up_depth").alias("depth")).agg(
            F.count("*").alias("gone"), *[F.sum(F.col(f"w_{n}") + F.col(f"e_{n}")).alias(f"r_{n}") for n in names])
        rest = live.where("open > 0").join(raked, ["id", "depth"], "left").select(
            "id", "depth", "up", "up_depth", (F.col("open") - F.coalesce("gone", zero)).alias("open"),
            *[(F.col(f"w_{n}") + F.coalesce(f"r_{n}", zero)).alias(f"w_{n}") for n in names], *[f"e_{n}" for n in names])
        rest = written(rest.withColumn("taken", F.coalesce((F.col("open") == 1) & odd("depth") & ~odd("up_depth"), F.lit(False))), "trie-rest")
        cut = rest.where("taken").select(
            F.col("id").alias("up"), F.col("depth").alias("up_depth"), F.col("up").alias("over"), F.col("up_depth").alias("over_depth"),
            *[(F.col(f"w_{n}")).alias(f"c_{n}") for n in names], *[F.col(f"e_{n}").alias(f"d_{n}") for n in names])
        # the only child of a node that is taken out; it stays, by the choice of the bits
        met = rest.join(cut, ["up", "up_depth"], "left")
        after = written(met.select(
            "id", "depth", "open", "taken", F.col("up").alias("was"), F.col("up_depth").alias("was_depth"), F.col("over_depth").isNotNull().alias("moved"),
            F.coalesce("over", "up").alias("up"), F.coalesce("over_depth", "up_depth").alias("up_depth"), *[f"w_{n}" for n in names],
            *[(F.col(f"e_{n}") + F.coalesce(F.col(f"c_{n}") + F.col(f"d_{n}"), zero)).alias(f"e_{n}") for n in names],
            *[(F.col(f"e_{n}") + F.coalesce(F.col(f"c_{n}"), zero)).alias(f"x_{n}") for n in names]), "trie-after")
        # x: what lies on the way from a node that was taken out to its child's total
        moved = after.where("moved").select(
            F.col("was").alias("id"), F.col("was_depth").alias("depth"), F.col("id").alias("child"), F.col("depth").alias("child_depth"), *[f"x_{n}" for n in names])
        log.append((leaves.select("id", "depth", *[F.col(f"w_{n}").alias(n) for n in names]), moved))
        live = after.where("NOT taken").drop("taken", "was", "was_depth", "moved", *[f"x_{n}" for n in names])
        if live.isEmpty():
            break
    else:
        raise RuntimeError("the tree is not contracted after so many rounds")
    totals = None
    for leaves, moved in reversed(log):
        if totals is None:
            totals = leaves
            continue
        below = totals.select(F.col("id").alias("child"), F.col("depth").alias("child_depth"), *[F.col(n).alias(f"t_{n}") for n in names])
        back = moved.join(below, ["child", "child_depth"]).select("id", "depth", *[(F.col(f"x_{n}") + F.col(f"t_{n}")).alias(n) for n in names])
        totals = written(totals.unionByName(back).unionByName(leaves), "trie-totals")
    return totals


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Consecutive ids of one node joined by commas, in pieces of at most PIECE ids; first tells the order of pieces."""
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in ("depth", "x", "y"))))
        ids = batch.column("conv_id").to_pylist()
        out, start = [], 0
        for i in range(1, len(ids) + 1):
            if i == len(ids) or keys[i] != keys[start] or i - start == PIECE:
                out.append((*keys[start], ids[start], ",".join(map(str, ids[start:i]))))
                start = i
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(
            [pa.int64()] * 4 + [pa.string()])], names=["depth", "x", "y", "first", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the pieces of each node, which come one after the other in order."""
    key, state = None, None
    schema = pa.schema([("depth", pa.int64()), ("x", pa.int64()), ("y", pa.int64()), ("ends_sha256", pa.string())])
    for batch in batches:
        done = []
        for depth, x, y, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "x", "y", "ids"))):
            if (depth, x, y) != key:
                if key is not None:
                    done.append((*key, state.hexdigest()))
                key, state = (depth, x, y), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in done], schema=schema)
    if key is not None:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (*key, state.hexdigest())))], schema=schema)


def end_digests(convs: DataFrame) -> DataFrame:
    """SHA-256 of the ascending ids of the conversations that end at each node.

    Ids are sorted over ranges that may part a node, and joined to pieces there. A digest is taken of one byte after the
    other, so the pieces of a node pass through one task, as a stream of which it holds nothing.
    """
    n = int(convs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    node = ["depth", "x", "y"]
    pieces = convs.repartitionByRange(n, *node, "conv_id").sortWithinPartitions(*node, "conv_id").mapInArrow(
        _joined_ids, "depth long, x long, y long, first long, ids string")
    return pieces.repartition(n, *node).sortWithinPartitions(*node, "first").mapInArrow(_hashed, "depth long, x long, y long, ends_sha256 string")


def prefix_trie(turns: DataFrame) -> DataFrame:
    """Every node of the trie of the rebuilt conversations (conv_id, turn, role, text), with counts and subtree totals."""
    convs, rows = prefixes(turns)
    convs = written(convs, "trie-ends")
    nodes = trie_nodes(convs, rows)
    if nodes.isEmpty():
        totals = nodes.select(F.col("conv_id").alias("id"), "depth", F.lit(0).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"))
    else:
        totals = subtree_totals(
            nodes.select(F.col("conv_id").alias("id"), "depth", F.col("parent_conv_id").alias("up"), "n_children", "own"),
            {"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": F.col("own")})
    totals = totals.select(F.col("id").alias("conv_id"), "depth", "n_leaves", "saved_tokens")
    return nodes.join(totals, ["conv_id", "depth"]).join(end_digests(convs), ["depth", "x", "y"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


#: The same rows in SQL: every node's ancestors are the prefixes of its least conversation.
ORACLE = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(coalesce(role, '') || chr(0) || coalesce(text, ''))) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base,
         xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: ord(ch)::BIGINT),
             lambda s, b: list_reduce([xor(s, b)] || range(8), lambda v, i: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
lent AS (SELECT c.conv_id, t.place AS depth, t.role, t.text FROM c JOIN t ON t.conv_id = c.base AND t.place <= c.h),
k AS (SELECT conv_id, count(*) AS k FROM lent GROUP BY conv_id),
own AS (
  SELECT c.conv_id, t.place - c.h + coalesce(k.k, 0) AS depth, t.role, t.text
  FROM c JOIN t USING (conv_id) LEFT JOIN k USING (conv_id) WHERE t.place > c.h),
r AS (SELECT * FROM lent UNION ALL SELECT * FROM own),
p AS (
  SELECT conv_id, depth, length(text) AS n_chars,
         md5(string_agg(md5(role || chr(0) || text), '' ) OVER (PARTITION BY conv_id ORDER BY depth)) AS node FROM r
  UNION ALL SELECT conv_id, 0, 0, '' FROM c),
ends AS (SELECT p.conv_id, p.node, p.depth FROM p JOIN (SELECT conv_id, max(depth) AS depth FROM p GROUP BY conv_id) USING (conv_id, depth)),
n AS (SELECT depth, node, min(conv_id) AS conv_id, count(*) AS n_convs, max(n_chars) AS n_chars FROM p GROUP BY depth, node),
up AS (SELECT n.depth, n.node, q.node AS up_node FROM n JOIN p q ON q.conv_id = n.conv_id AND q.depth = n.depth - 1),
kids AS (SELECT depth - 1 AS depth, up_node AS node, count(*) AS n_children FROM up GROUP BY ALL),
below AS (
  SELECT q.depth, q.node, sum(CASE WHEN kids.node IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((n.n_convs - 1) * n.n_chars) AS saved
  FROM n JOIN p q ON q.conv_id = n.conv_id AND q.depth <= n.depth LEFT JOIN kids ON kids.depth = n.depth AND kids.node = n.node GROUP BY ALL),
e AS (SELECT depth, node, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS digest FROM ends GROUP BY ALL)
SELECT n.conv_id, n.depth, a.conv_id AS parent_conv_id, n.n_convs, CAST(coalesce(kids.n_children, 0) AS BIGINT) AS n_children,
       CAST(below.n_leaves AS BIGINT) AS n_leaves, CAST(below.saved AS BIGINT) AS saved_tokens, coalesce(e.digest, sha256('')) AS ends_sha256
FROM n JOIN below USING (depth, node) LEFT JOIN kids USING (depth, node) LEFT JOIN up USING (depth, node)
LEFT JOIN n a ON a.depth = n.depth - 1 AND a.node = up.up_node LEFT JOIN e ON e.depth = n.depth AND e.node = n.node
"""
