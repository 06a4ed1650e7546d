"""A prefix trie of conversations as a Patricia tree, expanded to all its nodes.

A node is a distinct sequence of first turns. It is known by its depth and a 128-bit sum of hashes of (place, turn), so a
sequence's key at every depth is a running sum, which needs no task that holds a whole conversation.

1. Sort: turns are range-partitioned by conversation and turn and numbered; conversations are rebuilt; a second sort by
   conversation and place gives running sums of keys and of bytes. Running sums cross partitions by way of the sums of
   those conversations that lie on a border, two for each partition at most.
2. Points: rows with one key are counted with their smallest conversation, their ends and their smallest and largest
   next turn; only the root, ends and leaves (somebody ends there) and branches (the next turns differ) are kept.
3. Compressed edges: a conversation owns the nodes whose smallest member it is, which are the lower end of its path. The
   points on its path, in order, are the ends of its edges; the first of them hangs from the last point that it doesn't
   own.
4. Aggregates on the points alone: every conversation gives all points on its path its bytes, the bytes of the nodes it
   owns, and whether it owns its leaf; sums of these give leaves, children and saved tokens of whole subtrees without
   walking levels, so a chain of any depth takes no more rounds.
5. Unary nodes: an edge is unrolled to its depths, and what an edge saves below a depth is a difference of its running
   bytes.

Rows of one conversation, or of one node that all share, spread over tasks; counts are pre-aggregated before shuffles. The
SHA-256 of a node's ends reads their ids in order, which can't be divided: ids are joined to pieces in parallel, and one
task feeds the pieces of a node through the hash, holding one piece. Everything that is read twice is checkpointed in the
shared folder; nothing comes to the driver but the sums of border keys (broadcast), two for each partition.

Two different sequences are taken for one with a chance of 2^-128 a pair, and a branch of two for none with 2^-60.

Defined cases: rows without conv_id are no conversation; a null role or text is empty; turns are ordered with null
first, then by role and the text's MD5, and repeated rows are repeated turns; conv_id % 5 has the sign of conv_id; a
conversation none of whose turns remain is a member of the root only; an empty table has no nodes; very long texts are
hashed in the JVM once and dropped; columns that are not named are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, prepare, read

#: Conversations of a family, and the first turns that a member may take from its head, less one.
FAMILY, HEADS = 5, 9
#: Conversation ids of a piece that goes through a hash at once.
PIECE = 4096
#: Depths of an edge that one row unrolls to.
UNROLL = 1024
NOBODY = hashlib.sha256(b"").hexdigest()
KEY = ("depth", "k0", "k1")
_SUMS = ("x0", "x1", "x2", "x3")


def running(rows: DataFrame, key: str, order: list[Column | str], **found: tuple) -> DataFrame:
    """rows with the aggregates `found` (F.sum or F.max, and a column) over the earlier rows of the same key; null for the first.

    Rows are sorted over all tasks, and a key with any share of them spreads over as many. Only keys that lie in several
    partitions need what comes from other tasks; there are fewer than two (key, partition) of these for each partition.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cut(rows.repartitionByRange(parts, key, *order).withColumn("__part", F.spark_partition_id()))
    before = W.partitionBy(key, "__part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    each = rows.groupBy(key, "__part").agg(*[how(c).alias(f"__t_{n}") for n, (how, c) in found.items()])
    ahead = W.partitionBy(key).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)  # a row for each partition
    each = each.withColumn("__several", F.count("*").over(W.partitionBy(key))).where("__several > 1")
    each = each.select(key, "__part", *[how(f"__t_{n}").over(ahead).alias(f"__b_{n}") for n, (how, _) in found.items()])
    out = rows.withColumns({n: how(c).over(before) for n, (how, c) in found.items()}).join(F.broadcast(each), [key, "__part"], "left")
    both = lambda n: F.greatest(n, f"__b_{n}") if found[n][0] is F.max else F.when(F.col(n).isNotNull() | F.col(f"__b_{n}").isNotNull(), F.coalesce(n, F.lit(0)) + F.coalesce(f"__b_{n}", F.lit(0)))
    return out.withColumns({n: both(n) for n in found}).drop("__part", *[f"__b_{n}" for n in found])


def heads(conv: Column) -> Column:
    """How many first turns a conversation takes from the head of its family."""
    return (F.crc32(conv.cast("string").cast("binary")) % F.lit(HEADS)).cast("int")


def rebuilt(talks: DataFrame) -> DataFrame:
    """conv, d (1, 2, ...), m (MD5 of the turn, null in a last row behind the turns) and bytes of every rebuilt conversation."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    said = F.concat(F.octet_length(text("role")).cast("string"), F.lit(":"), text("role"), text("text"))
    turns = talks.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"), "turn", text("role").alias("role"), F.md5(said.cast("binary")).alias("m"), F.octet_length(text("text")).cast("long").alias("bytes"),
    ).withColumn("row", F.monotonically_increasing_id())
    turns = running(turns, "conv", [F.asc_nulls_first("turn"), "role", "m", "row"], p=(F.sum, F.lit(1)))
    turns = cut(turns.select("conv", (F.coalesce("p", F.lit(0)) + 1).alias("p"), "m", "bytes"))
    sizes = turns.groupBy("conv").agg(F.count("*").alias("n"))
    head = F.col("conv") - F.col("conv") % FAMILY
    first = sizes.select(F.col("conv").alias("head"), F.least("n", F.lit(HEADS - 1)).alias("head_n"))
    sizes = cut(sizes.withColumns({"head": head, "h": heads(F.col("conv"))}).join(first, "head", "left").withColumn("taken", F.least("h", F.coalesce("head_n", F.lit(0)))))
    given = turns.where(F.col("p") < HEADS).withColumnRenamed("conv", "head")
    copied = given.join(sizes.where("taken > 0").select("head", "conv", "taken"), "head").where("p <= taken").select("conv", F.col("p").alias("d"), "m", "bytes")
    # taken < h where the head has fewer turns: what follows moves up
    moved = sizes.where("taken < h").select("conv", (F.col("h") - F.col("taken")).alias("by"))
    own = turns.where(F.col("p") > heads(F.col("conv"))).join(moved, "conv", "left").select("conv", (F.col("p") - F.coalesce("by", F.lit(0))).alias("d"), "m", "bytes")
    last = sizes.select("conv", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0)) + 1).alias("d"), F.lit(None).cast("string").alias("m"), F.lit(0).cast("long").alias("bytes"))
    return copied.unionByName(own).unionByName(last)


def steps(turns: DataFrame) -> DataFrame:
    """conv, depth, k0, k1 (the node), bytes (of all texts up to the node), next (the turn that follows, null at the end)."""
    placed = F.md5(F.concat_ws(":", F.col("d").cast("string"), F.coalesce("m", F.lit(""))).cast("binary"))
    word = lambda i: F.when(F.col("m").isNotNull(), F.conv(F.substring(placed, 8 * i + 1, 8), 16, 10).cast("long")).otherwise(0)
    x = running(turns, "conv", ["d"], **{c: (F.sum, word(i)) for i, c in enumerate(_SUMS)}, before=(F.sum, F.col("bytes")))
    low = lambda c: F.coalesce(c, F.lit(0)).bitwiseAND(F.lit(0xFFFFFFFF))
    pair = lambda a, b: F.shiftleft(low(a), 32).bitwiseOR(low(b))
    return x.select("conv", (F.col("d") - 1).alias("depth"), pair("x0", "x1").alias("k0"), pair("x2", "x3").alias("k1"), F.coalesce("before", F.lit(0)).alias("bytes"), F.col("m").alias("next"))


def points(rows: DataFrame) -> DataFrame:
    """The root, ends, leaves and branches: depth, k0, k1, first (smallest member), n, ends, leaf and upto (bytes)."""
    turn = F.conv(F.substring("next", 1, 15), 16, 10).cast("long")  # 60 bits, of the children of one node
    x = rows.select("conv", *KEY, "bytes", F.col("next").isNull().alias("end"), turn.alias("next"))
    x = x.groupBy(*KEY).agg(F.min("conv").alias("first"), F.count("*").alias("n"), F.count_if("end").alias("ends"), F.min("next").alias("lo"), F.max("next").alias("hi"), F.max("bytes").alias("upto"))
    kept = (F.col("depth") == 0) | (F.col("ends") > 0) | (F.col("lo") != F.col("hi"))
    return x.where(kept).select(*KEY, "first", "n", "ends", F.col("lo").isNull().alias("leaf"), "upto")


def compressed(rows: DataFrame, tops: DataFrame) -> DataFrame:
    """The points with above (depth of the point above, null at the root), above_conv, n_children, n_leaves, below (what is
    saved below the point)."""
    on = cut(rows.select("conv", *KEY, F.col("next").isNull().alias("end")).join(tops, list(KEY)))
    mine = F.col("first") == F.col("conv")
    # of each conversation: its bytes, the bytes and depth of the last point that it doesn't own, whether it owns its leaf
    convs = on.groupBy("conv").agg(
        F.max("upto").alias("all"), F.max(F.when(~mine, F.struct("depth", "upto", "first"))).alias("from"), F.max("depth").alias("last"),
        F.max((F.col("end") & F.col("leaf") & mine).cast("int")).alias("leaves"), F.max((F.col("end") & mine).cast("int")).alias("owner"),
    )
    convs = cut(convs.select("conv", "all", "last", "leaves", "owner", F.col("from.depth").alias("from_depth"), F.col("from.first").alias("from_conv"), (F.col("all") - F.coalesce("from.upto", F.lit(0))).alias("owned")))
    x = on.join(convs, "conv")
    begins = (F.col("owner") == 1) & (F.col("from_depth") == F.col("depth"))
    got = x.groupBy(*KEY).agg(
        F.sum("all").alias("all"), F.sum("leaves").alias("n_leaves"), F.sum(F.when(~mine, F.col("owned")).otherwise(0)).alias("owned"),
        F.max(F.when(mine, F.col("all"))).alias("own_all"),
        (F.count_if(begins) + F.max((mine & (F.col("last") > F.col("depth"))).cast("int"))).alias("n_children"),
    )
    tops = on.where(mine).drop("conv", "end").join(got, list(KEY))
    # the sum of n * bytes of the nodes below, less that of bytes: each node once, by its owner
    below = (F.col("all") - F.col("n") * F.col("upto")) - (F.col("owned") + F.col("own_all") - F.col("upto"))
    tops = running(tops.withColumn("below", below).drop("all", "owned", "own_all"), "first", ["depth"], above=(F.max, F.col("depth")))
    start = convs.select(F.col("conv").alias("first"), "from_depth", "from_conv")
    tops = tops.join(start, "first")
    return tops.select(*tops.columns[:-3], F.coalesce("above", "from_depth").alias("above"), F.when(F.col("above").isNull(), F.col("from_conv")).otherwise(F.col("first")).alias("above_conv"))


def ends_digest(rows: DataFrame) -> DataFrame:
    """first, depth and the SHA-256 of the ids that end there, in order; rows: first, depth, conv."""
    key = ["first", "depth"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def joined(batches):
        now, ids, at = None, [], None

        def out():
            return pa.RecordBatch.from_arrays([pa.array([now[0]], "int64"), pa.array([now[1]], "int64"), pa.array([at], "int64"), pa.array([",".join(map(str, ids))])], names=["first", "depth", "at", "ids"])

        for b in batches:
            for first, depth, conv in zip(*(b.column(c).to_pylist() for c in (*key, "conv"))):
                if now != (first, depth) or len(ids) >= PIECE:
                    if ids:
                        yield out()
                    now, ids, at = (first, depth), [], conv
                ids.append(conv)
        if ids:
            yield out()

    def hashed(batches):
        now, h = None, None
        for b in batches:
            got = []
            for first, depth, ids in zip(*(b.column(c).to_pylist() for c in (*key, "ids"))):
                if now == (first, depth):
                    h.update(b"," + ids.encode())
                    continue
                if now is not None:
                    got.append((*now, h.hexdigest()))
                now, h = (first, depth), hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], t) for i, t in enumerate(("int64", "int64", "string"))], names=[*key, "sha"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now[0]], "int64"), pa.array([now[1]], "int64"), pa.array([h.hexdigest()])], names=[*key, "sha"])

    rows = rows.select(F.col("first").cast("long").alias("first"), F.col("depth").cast("long").alias("depth"), "conv")
    pieces = rows.repartitionByRange(parts, *key, "conv").sortWithinPartitions(*key, "conv").mapInArrow(joined, "first long, depth long, at long, ids string")
    return pieces.repartition(parts, *key).sortWithinPartitions(*key, "at").mapInArrow(hashed, "first long, depth long, sha string")


def trie(talks: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of every node."""
    prepare(talks.sparkSession)
    rows = cut(steps(rebuilt(talks)))
    tops = cut(points(rows))
    tree = cut(compressed(rows, tops))
    ends = rows.where("next IS NULL").select("conv", *KEY).join(tops.select(*KEY, "first"), list(KEY)).select("first", "depth", "conv")
    tree = tree.join(ends_digest(ends), ["first", "depth"], "left")
    root = tree.where("depth = 0").select(
        F.col("first").alias("conv_id"), F.col("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", "n_leaves", F.col("below").alias("saved_tokens"), "sha",
    )
    # the depths of each edge, in two steps, so that a very long edge is unrolled by many tasks
    edges = tree.where("depth > 0").withColumn("at", F.explode(F.sequence(F.col("above") + 1, F.col("depth"), F.lit(UNROLL))))
    edges = edges.withColumn("d", F.explode(F.sequence("at", F.least(F.col("at") + UNROLL - 1, F.col("depth")))))
    before = rows.select(F.col("conv").alias("first"), (F.col("depth") + 1).alias("d"), F.col("bytes").alias("start"))
    x = edges.join(before, ["first", "d"])
    top, whole = F.col("d") == F.col("above") + 1, F.col("d") == F.col("depth")
    nodes = x.select(
        F.col("first").alias("conv_id"), F.col("d").alias("depth"), F.when(top, F.col("above_conv")).otherwise(F.col("first")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.when(whole, F.col("n_children")).otherwise(1).alias("n_children"), "n_leaves",
        (F.col("below") + (F.col("n") - 1) * (F.col("upto") - F.col("start"))).alias("saved_tokens"), F.when(whole, F.col("sha")).alias("sha"),
    )
    numbers = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
    return root.unionByName(nodes).select(*[F.col(c).cast("long").alias(c) for c in numbers], F.coalesce("sha", F.lit(NOBODY)).alias("ends_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: the trie of all conversations."""
    return trie(read(spark, sf_dir, "conversations"))


#: CRC-32 of a decimal number, bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(string_split(c::VARCHAR, ''), lambda y: ascii(y)::BIGINT)),
    lambda a, y: list_reduce([xor(a, y), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda b, z: CASE WHEN b % 2 = 1 THEN xor(b >> 1, 3988292384) ELSE b >> 1 END)), 4294967295)"""
ORACLE = f"""
WITH turns AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS p,
    md5(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS m, strlen(coalesce(text, '')) AS bytes
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, {_CRC} % {HEADS} AS h, c - c % {FAMILY} AS head FROM (SELECT DISTINCT c FROM turns)),
again AS (
  SELECT c.c, 0 AS late, t.p, t.m, t.bytes FROM convs c JOIN turns t ON t.c = c.head AND t.p <= c.h
  UNION ALL SELECT c.c, 1, t.p, t.m, t.bytes FROM convs c JOIN turns t ON t.c = c.c AND t.p > c.h),
placed AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY late, p) AS d FROM again),
ways AS (
  SELECT c, d, bytes, string_agg(m, ',') OVER (PARTITION BY c ORDER BY d) AS k, coalesce(string_agg(m, ',') OVER (PARTITION BY c ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS up,
    count(*) OVER (PARTITION BY c) AS last FROM placed
  UNION ALL SELECT c, 0, 0, '', NULL, (SELECT count(*) FROM placed p WHERE p.c = convs.c) FROM convs),
nodes AS (
  SELECT d, k, any_value(up) AS up, min(c) AS conv, count(*) AS n, any_value(bytes) AS bytes, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (last = d) AS ends FROM ways GROUP BY d, k),
kids AS (SELECT d - 1 AS d, up AS k, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1, 2),
tree AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids USING (d, k)),
sums AS (
  SELECT a.d, a.k, sum((b.n - 1) * b.bytes) AS saved, count(*) FILTER (b.n_children = 0) AS leaves
  FROM tree a JOIN tree b ON b.d >= a.d AND (a.k = '' OR b.k = a.k OR starts_with(b.k, a.k || ',')) GROUP BY 1, 2)
SELECT t.conv AS conv_id, t.d::BIGINT AS depth, u.conv AS parent_conv_id, t.n AS n_convs, t.n_children::BIGINT AS n_children, s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(coalesce(t.ends, '')) AS ends_sha256
FROM tree t JOIN sums s USING (d, k) LEFT JOIN tree u ON u.d = t.d - 1 AND u.k = t.up
"""
