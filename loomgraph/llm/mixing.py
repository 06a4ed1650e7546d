"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets an exponential key -ln(u) / w, where u is a hash of its id in (0, 1) and w its quality weight;
the smallest keys are a weighted sample without replacement. A source whose target is e times its size plus a rest
gives e complete epochs, then its documents in the order of their keys until their sizes reach the rest; the
document on the border is taken in part, so that targets are met to the word.

The order within a source is never made in one task: rows are range-partitioned on (source, key), each partition's
part of a source is summed, those sums are prefix-summed (as many rows as partitions plus sources), and running
sums within a part start from there. A source with a third of all rows spreads over a third of the partitions.
Sources are numbered in the same way, and their targets found by aggregates over them, so they may be many. The table
of sources (one row each) is broadcast up to BROADCAST_SOURCES rows, else joined with AQE's skew split.

Defined cases: null text has size 0; a null source is a source of its own, ordered last; a source of size 0 has
target 0; repeated rows are separate documents, ordered by id and text, and rows equal in both take what they take
in any order; a text of any length is counted whole, in the JVM, and isn't held besides; an empty table gives no rows;
columns that are not named in the arguments are ignored, whatever their names; a name in keep that the result has
already is refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, clash, cut, read

SEED = "mix-1"
#: A source gives its words this many times at most.
MOST = 3
#: Source weights in code-point order, repeating.
WEIGHTS = (1, 2, 3)
BROADCAST_SOURCES = 20_000
#: Characters that lower a document's quality weight.
SYMBOLS = "#*$%&|<>!"
LEAST_WEIGHT = 0.05


def quality_weight(text: Column) -> Column:
    """1 for running text, falling with the share of symbol characters to LEAST_WEIGHT."""
    n = F.length(text)
    share = (n - F.length(F.translate(text, SYMBOLS, ""))).cast("double") / F.greatest(n, F.lit(1)).cast("double")
    return F.greatest(F.lit(LEAST_WEIGHT), F.lit(1.0) - F.lit(4.0) * share)


def uniform(doc_id: Column, seed: str) -> Column:
    """48 bits of an md5 as a number in (0, 1)."""
    h = F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f":{seed}")).cast("binary")), 1, 12)
    return (F.conv(h, 16, 10).cast("long").cast("double") + 0.5) / float(1 << 48)


def numbered(rows: DataFrame, *order: Column | str) -> DataFrame:
    """rows with __place: 0, 1, 2, ... in that order, from the counts of range partitions."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cut(rows.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))
    before = W.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)  # a row for each partition
    starts = rows.groupBy("__part").agg(F.count("*").alias("n")).select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    own = F.row_number().over(W.partitionBy("__part").orderBy(*order))
    return rows.withColumn("__own", own).join(F.broadcast(starts), "__part").withColumn("__place", F.col("__start") + F.col("__own") - 1).drop("__part", "__start", "__own")


def targets(sources: DataFrame) -> DataFrame:
    """src, source_size -> and target: all words shared by weight, no source above MOST times its size.

    The excess of the sources above their limit is shared again by weight until none is above; every round is one
    aggregate and holds at least one source more, and few rounds do, as each rate comes from all sources that are free.
    """
    x = numbered(sources, F.col("src").isNull(), "src")
    kinds = F.array(*[F.lit(w) for w in WEIGHTS])
    x = cut(x.select("src", "source_size", F.element_at(kinds, (F.pmod("__place", F.lit(len(WEIGHTS))) + 1).cast("int")).cast("long").alias("w")))
    limit = F.col("source_size") * MOST
    rate, above = None, -1
    while True:
        held = F.lit(False) if rate is None else F.lit(rate) * F.col("w") > limit
        got = x.agg(F.sum("source_size").alias("total"), F.sum("w").alias("w"), F.sum(F.when(held, limit)).alias("held"), F.sum(F.when(held, F.col("w"))).alias("held_w"), F.count_if(held).alias("n")).first()
        free = (got["w"] or 0) - (got["held_w"] or 0)
        if got["n"] == above or not free:
            break
        rate, above = ((got["total"] or 0) - (got["held"] or 0)) / free, got["n"]
    return x.select("src", "source_size", F.least(limit.cast("double"), F.lit(rate or 0.0) * F.col("w")).alias("target"))


def mix(docs: DataFrame, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target and taken for every row of docs; keep: further columns to carry along."""
    clash(keep, ("doc_id", "size", "source_size", "target", "taken"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    kept = [F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)]
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("src"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        (-F.log(uniform(F.col(id_col), seed)) / quality_weight(text)).alias("key"), F.md5(text.cast("binary")).alias("tie"), *kept,
    )
    rows = cut(rows)
    sources = cut(targets(rows.groupBy("src").agg(F.sum("size").alias("source_size"))))
    small = sources.count() <= BROADCAST_SOURCES
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, "src", "key", "doc_id", "tie").withColumn("part", F.spark_partition_id())
    rows = cut(rows)
    sums = rows.groupBy("src", "part").agg(F.sum("size").alias("n"))
    ahead = W.partitionBy("src").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("src", "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("start"))
    plan = sums.join(F.broadcast(sources) if small else sources, sums["src"].eqNullSafe(sources["src"])).select(
        sums["src"].alias("s"), sums["part"].alias("p"), "start", "source_size", "target"
    )
    own = W.partitionBy("src", "part").orderBy("key", "doc_id", "tie").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("own", F.coalesce(F.sum("size").over(own), F.lit(0)))
    rows = rows.join(plan, F.col("src").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
    budget = F.floor(F.col("target") + 0.5)
    epochs = F.when(F.col("source_size") == 0, F.lit(0)).otherwise(F.expr("floor(target + 0.5D) div source_size"))
    rest = budget - epochs * F.col("source_size")
    part = F.least(F.greatest(rest - F.col("start") - F.col("own"), F.lit(0)), F.col("size"))
    out = [F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)]
    return rows.select("doc_id", "size", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken"), *out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: the mix of all documents."""
    return mix(read(spark, sf_dir, "documents"))


ORACLE = rf"""
WITH docs AS (
  SELECT doc_id, source AS src, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size, md5(coalesce(text, '')) AS tie,
    -ln((('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':{SEED}'), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0::DOUBLE)
      / greatest({LEAST_WEIGHT}::DOUBLE, 1.0::DOUBLE - 4.0::DOUBLE * ((length(coalesce(text, '')) - length(translate(coalesce(text, ''), '{SYMBOLS}', '')))::DOUBLE / greatest(length(coalesce(text, '')), 1)::DOUBLE)) AS key
  FROM documents),
sources AS (SELECT src, sum(size)::BIGINT AS source_size FROM docs GROUP BY src),
weighted AS (SELECT *, ((row_number() OVER (ORDER BY src NULLS LAST) - 1) % 3 + 1)::BIGINT AS w FROM sources),
held AS (
  SELECT *, (sum(source_size) OVER ())::BIGINT AS total, (sum(w) OVER ())::BIGINT AS weights,
    coalesce(sum(source_size) OVER o, 0)::BIGINT * {MOST} AS held, coalesce(sum(w) OVER o, 0)::BIGINT AS held_w
  FROM weighted WINDOW o AS (ORDER BY source_size::DOUBLE / w, src NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
rated AS (SELECT *, (total - held)::DOUBLE / (weights - held_w)::DOUBLE AS rate FROM held),
chosen AS (SELECT rate FROM rated WHERE rate * w <= source_size * {MOST} ORDER BY source_size::DOUBLE / w, src NULLS LAST LIMIT 1),
target AS (
  SELECT src, source_size, CASE WHEN total = 0 THEN 0.0 ELSE least((source_size * {MOST})::DOUBLE, (SELECT rate FROM chosen) * w) END AS target FROM rated),
ordered AS (
  SELECT doc_id, size, source_size, target, floor(target + 0.5)::BIGINT AS budget,
    coalesce(sum(size) OVER (PARTITION BY d.src ORDER BY key, doc_id, tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS own
  FROM docs d JOIN target t ON d.src IS NOT DISTINCT FROM t.src)
SELECT doc_id, size, source_size, target,
  CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size + least(greatest(budget % source_size - own, 0), size) END::BIGINT AS taken
FROM ordered
"""
