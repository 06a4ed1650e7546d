"""Sharding by a k-d tree over metadata, with leaves of equal bytes.

The tree is built level by level until leaves reach the target bytes: shards_for() gives the number of leaves of a
target, and a node is divided as long as it holds more than one. Every row carries its node from level to level. For
every open node one aggregation gives its weight and the extent of each dimension; the widest dimension is cut at the
weighted median (for an odd number of leaves, at the matching weighted quantile, so that all leaves end at the same
size). The cut is found exactly without sorting: the node's key range is divided into BUCKETS equal parts, their weights
are summed, and the part that the cut falls into is divided again until it holds a single text, then a single row.
Searches and cuts are tables, a row for each open node, so the plan is the same for 40 leaves and for 800,000; the
driver sees their numbers of rows only. A table of nodes is broadcast up to MOST_NODES rows; a level with more of them is
shuffled by node, where no node holds more than about a part in MOST_NODES of all bytes.

A dimension's key is 63 bits: 23 bits of the dimension's own value, 24 bits of the text's hash, 16 bits of the
id's hash. So rows with the same metadata can still be divided, and copies lie beside each other. A cut that falls into a
text's copies moves to the nearer end of them if that changes the sides by SLACK of a leaf's share at most; only larger
groups of copies are divided. Over all levels a leaf's bytes change by less than twice SLACK.

Defined cases: null text counts as no bytes; null metadata has the lowest value; repeated rows are separate rows, and
ties in a key go to the same side of a cut; a text longer than a shard's share makes that shard larger, as rows aren't
divided; a text of any length is hashed in the JVM and not held besides; an empty table gives no rows; columns that are
not named in the arguments are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, folder, read

SHARDS = 40
#: Parts of a key range whose weights are summed at once.
BUCKETS = 2048
#: Bytes that a row takes besides its text.
OVERHEAD = 16
#: Rows of a shard that are numbered together.
RUN = 1024
CODE_BITS, TEXT_BITS, ID_BITS = 23, 24, 16
LOW_BITS = TEXT_BITS + ID_BITS
#: Share of a leaf's bytes by which a cut may miss its place to keep the copies of a text together.
SLACK = 0.05
#: Rows of a table of nodes that are broadcast, at most (about 100 bytes each).
MOST_NODES = 50_000


def category(col: str) -> Column:
    """A categorical column on an axis of 23 bits: equal values at one place, null at 0."""
    return F.coalesce(F.pmod(F.xxhash64(F.col(col).cast("string")), F.lit((1 << CODE_BITS) - 1)) + 1, F.lit(0)).cast("long")


def magnitude(col: Column) -> Column:
    """A non-negative number on a logarithmic axis of 23 bits (up to 2^40)."""
    x = F.log2(F.greatest(col.cast("double"), F.lit(0.0)) + 1.0) / 40.0
    return F.least(F.floor(x * float(1 << CODE_BITS)), F.lit((1 << CODE_BITS) - 1)).cast("long")


def keyed(docs: DataFrame, dims: Sequence[str], id_col: str, text_col: str) -> DataFrame:
    """The rows to shard: id, size, checksum, and one key k0, k1, ... for each dimension ('size' or a column)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    size = (F.octet_length(text) + OVERHEAD).cast("long")
    low = F.shiftleft(F.pmod(F.xxhash64(text), F.lit(1 << TEXT_BITS)), ID_BITS) + F.pmod(F.xxhash64(F.col(id_col), F.lit(7)), F.lit(1 << ID_BITS))
    code = [magnitude(size) if d == "size" else category(d) for d in dims]
    return docs.select(
        F.col(id_col).alias("doc_id"), size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        *[(F.shiftleft(c, LOW_BITS) + low).alias(f"k{i}") for i, c in enumerate(code)],
    )


def _written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder. With checkpoint() planning took longer from level to level and
    then didn't end; what the optimizer keeps of a checkpointed plan is the likely cause."""
    path = folder(df.sparkSession, "kd")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _with(rows: DataFrame, nodes: DataFrame, n: int, how: str = "inner") -> DataFrame:
    """rows with the columns of their node; n: rows of nodes."""
    return rows.join(F.broadcast(nodes) if n <= MOST_NODES else nodes, "node", how)


def _searches(rows: DataFrame, dims: int, span: Sequence[int]) -> DataFrame:
    """A search for each node that is to be divided: its widest dimension, the weight wanted on the left, what a cut may miss
    it by, and the range [lo, hi) of keys, in units, that the cut is in; below is the weight left of the range."""
    stats = rows.groupBy("node", "leaves").agg(
        F.sum("size").alias("w"), *[f(f"k{i}").alias(f"{name}{i}") for i in range(dims) for name, f in (("lo", F.min), ("hi", F.max))],
    )
    extent = lambda i: (F.shiftright(f"hi{i}", LOW_BITS) - F.shiftright(f"lo{i}", LOW_BITS)) / F.lit(float(span[i]))
    wide = F.array_max(F.array(*[F.struct(extent(i).alias("e"), F.lit(-i).alias("i")) for i in range(dims)]))  # ties: the first
    stats = stats.withColumn("dim", -wide["i"])
    of = lambda name: F.element_at(F.array(*[F.col(f"{name}{i}") for i in range(dims)]), F.col("dim") + 1)
    unit, left = F.lit(1 << ID_BITS).cast("long"), F.expr("leaves div 2")
    return stats.select(
        "node", "leaves", "dim", (F.col("w") * left / F.col("leaves")).alias("want"), (F.col("w") / F.col("leaves") * SLACK).alias("slack"),
        unit.alias("unit"), F.shiftleft(F.shiftright(of("lo"), ID_BITS), ID_BITS).alias("lo"), F.shiftleft(F.shiftright(of("hi"), ID_BITS) + 1, ID_BITS).alias("hi"),
        F.lit(0).cast("long").alias("below"), F.lit(None).cast("long").alias("at"),
    )


def _narrowed(rows: DataFrame, search: DataFrame, n: int, dims: int) -> DataFrame:
    """The searches after one more division of their ranges; at is the cut of those that have found it."""
    unit = F.col("unit")
    step = F.expr(f"greatest(1, (hi - lo + unit * {BUCKETS} - 1) div (unit * {BUCKETS}))") * unit
    given = search.select("node", "dim", "lo", "hi", step.alias("step"))
    key = F.element_at(F.array(*[F.col(f"k{i}") for i in range(dims)]), F.col("dim") + 1)
    x = _with(rows.select("node", "size", *[f"k{i}" for i in range(dims)]), given, n).withColumn("key", key)
    x = x.where((F.col("key") >= F.col("lo")) & (F.col("key") < F.col("hi")))
    x = x.groupBy("node", F.expr("(key - lo) div step").alias("part")).agg(F.sum("size").alias("w"), F.count("*").alias("n"), F.min("key").alias("first"), F.max("key").alias("last"))
    x = x.join(search.withColumn("step", step), "node")
    upto = F.sum("w").over(W.partitionBy("node").orderBy("part").rowsBetween(W.unboundedPreceding, 0))  # BUCKETS rows at most
    x = x.withColumn("upto", F.col("below") + upto).where(F.col("upto") >= F.col("want"))
    x = x.groupBy("node").agg(F.min_by(F.struct(*[c for c in x.columns if c not in ("node", "part")], "part"), "part").alias("x")).select("node", "x.*")
    # of the part that the cut is in: it holds one unit, which is a text (then a key), or is divided again
    whole = lambda c: F.col(c) - F.pmod(F.col(c), unit)
    one = whole("first") == whole("last")
    under = F.col("upto") - F.col("w")
    after = (F.col("upto") - F.col("want")) < (F.col("want") - under)
    miss = F.least(F.col("upto") - F.col("want"), F.col("want") - under)
    found = one & ((unit == 1) | (F.col("n") == 1) | (miss <= F.col("slack")))
    start = F.col("lo") + F.col("part") * F.col("step")
    lo, hi = F.when(one, whole("first")).otherwise(start), F.when(one, whole("first") + unit).otherwise(start + F.col("step"))
    return x.select(
        "node", "leaves", "dim", "want", "slack", F.when(one, F.lit(1).cast("long")).otherwise(unit).alias("unit"), lo.alias("lo"), hi.alias("hi"),
        under.alias("below"), F.when(found, F.when(after, hi).otherwise(lo)).alias("at"),
    )


def build(rows: DataFrame, dims: int, shards: int) -> DataFrame:
    """Keyed rows with node, their shard; node is the first leaf under a node."""
    spans = rows.agg(*[f(f"k{i}").alias(f"{name}{i}") for i in range(dims) for name, f in (("lo", F.min), ("hi", F.max))]).first()
    if spans["lo0"] is None:
        return rows.withColumn("node", F.lit(0).cast("long"))
    span = [max(1, (spans[f"hi{i}"] >> LOW_BITS) - (spans[f"lo{i}"] >> LOW_BITS)) for i in range(dims)]
    rows = rows.withColumns({"node": F.lit(0).cast("long"), "leaves": F.lit(shards).cast("long")})
    for _ in range((shards - 1).bit_length()):
        open_ = rows.where("leaves > 1")
        search, cuts = _written(_searches(open_, dims, span)), None
        while n := search.count():
            search = _written(_narrowed(open_, search, n, dims))
            done = search.where("at IS NOT NULL").select("node", "dim", "at")
            cuts, search = done if cuts is None else cuts.unionByName(done), search.where("at IS NULL")
        if cuts is None:
            break
        key = F.element_at(F.array(*[F.col(f"k{i}") for i in range(dims)]), F.col("dim") + 1)
        left = F.expr("leaves div 2")
        x = _with(rows, cuts, cuts.count(), "left").withColumn("right", key >= F.col("at"))
        rows = _written(x.select(
            *[c for c in rows.columns if c not in ("node", "leaves")],
            F.when(F.col("right"), F.col("node") + left).otherwise(F.col("node")).alias("node"),
            F.when(F.col("at").isNull(), F.col("leaves")).when(F.col("right"), F.col("leaves") - left).otherwise(left).alias("leaves"),
        ))
    return rows.drop("leaves")


def numbered(rows: DataFrame, total: int, shards: int) -> DataFrame:
    """slot: 0, 1, 2, ... within each shard, by runs whose counts are summed beforehand; no task gets a whole shard."""
    runs = max(8, -(-total // (shards * RUN)))
    rows = rows.withColumn("run", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(runs)).cast("int"))
    counts = rows.groupBy("shard", "run").agg(F.count("*").alias("n"))
    before = W.partitionBy("shard").orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select("shard", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    own = F.row_number().over(W.partitionBy("shard", "run").orderBy("doc_id", "text_crc32", "size"))
    return rows.withColumn("own", own).join(counts, ["shard", "run"]).withColumn("slot", (F.col("start") + F.col("own") - 1).cast("long"))


def shards_for(rows: DataFrame, target_bytes: int) -> int:
    """The least number of leaves with which none need be larger than the target (rows being indivisible, some may be)."""
    if target_bytes < 1:
        raise ValueError("target_bytes must be 1 or more")
    total = rows.agg(F.sum("size")).first()[0] or 0
    return max(1, -(-total // target_bytes))


def shard_kd(docs: DataFrame, shards: int | None = SHARDS, dims: Sequence[str] = ("lang", "size"), id_col: str = "doc_id", text_col: str = "text", target_bytes: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot for every row of docs.

    dims: 'size' (UTF-8 bytes of the text, on a logarithmic axis) or names of categorical columns. target_bytes: the
    bytes of a leaf, instead of a number of shards.
    """
    rows = cut(keyed(docs, dims, id_col, text_col))
    if target_bytes is not None:
        shards = shards_for(rows, target_bytes)
    placed = build(rows, len(dims), shards).select("doc_id", "size", "text_crc32", F.col("node").cast("int").alias("shard"))
    return numbered(placed, rows.count(), shards).select("doc_id", "size", "text_crc32", "shard", "slot")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: all documents into 40 shards by bytes. Equal texts of one lang have equal keys but for the id, so copies
    share a shard unless a cut has to pass through their group."""
    out = shard_kd(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
