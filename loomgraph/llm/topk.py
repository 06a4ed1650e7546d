"""Exact top-k search by distributed histogram selection.

1. Vectors become integers, floor(SCALE x). Queries and candidates are dealt to a grid of cells, each a group of queries
   against a group of candidates; a cell streams its candidates past its queries as matrix products and scores every pair.
2. A cell counts each query's scores in at most BINS bins between the bounds that Cauchy-Schwarz gives, and returns the
   highest bins until its own counts reach what the query still needs; the lower ones can't hold the kth score. The sums
   over all cells name the bin of the kth score. The next round scores again and counts within that bin only, until
   bins are one integer wide (or a bin gives just what is needed): two rounds for scores up to 2^14, three up to 2^21.
3. A last pass returns what lies above the kth score, and of the scores equal to it only as many of the smallest ids as
   are needed, from each cell; a window of these orders them by score, then id.

Nothing but counts and bounds comes to the driver, and nothing is broadcast. A copy of a vector is a row like any other:
rows are dealt by a number of their own, so equal vectors or ids spread over all cells, and thousands of scores equal to
the kth leave a cell as `need` rows. Products are exact: in 32-bit floats while the product of the largest norms is below
2^24, in 64-bit floats below 2^53, in 64-bit integers above; scores that need more bits are refused.

Memory: a cell holds at most QUERIES queries and their counts, and candidates in tiles. A round shuffles every candidate
once for each group of queries, and every query once for each group of candidates. Lost executors cost tasks: the
vectors and the bounds of every round are checkpointed in the shared folder.

Defined cases: vectors that are null or hold null, NaN or infinite components take no part, neither as queries nor as
candidates; a row whose id is null is a candidate, behind all others of its score, and no query; vectors meet those of
their own length only, and empty ones score 0; rows with the same id are separate queries and candidates, and rows equal
in score and id come in any order; a query's own row is no candidate of its own, its copies are; fewer than k candidates
are all returned; an empty table gives no rows; columns that are not named are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, read

#: Factor of the components before they are floored.
SCALE = 64
#: Results of a query.
K = 20
#: Bins of a histogram, as a power of two.
BIN_BITS = 7
BINS = 1 << BIN_BITS
#: Queries of a cell, at most on average, and candidates of a cell, at least on average.
QUERIES, CANDIDATES = 32_768, 1024
#: Candidates and queries whose scores are held at once.
TILE, QUERY_TILE = 2048, 1024
#: Scores equal to the kth that a cell holds before it keeps the smallest ids only.
TIES = 1 << 20


def integers(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """__row (a number of the row's own), __id, __v (array<bigint>) of the vectors that take part."""
    v = F.col(vec_col).cast("array<double>")
    fit = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    ints = F.when(F.coalesce(fit, F.lit(False)), F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x)))
    out = vectors.select(F.col(id_col).cast("long").alias("__id"), ints.alias("__v")).where("__v IS NOT NULL")
    return cut(out.select(F.monotonically_increasing_id().alias("__row"), "__id", "__v"))


def _batches(batches, dtype):
    """(queries, candidates): rows of a cell, queries first; of each length a matrix, row numbers, ids, lo and need."""
    for b in batches:
        v = b.column("v")
        sizes = v.value_lengths().to_numpy(zero_copy_only=False)
        starts = np.r_[0, np.cumsum(sizes)]
        flat = v.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
        kind = b.column("kind").to_numpy(zero_copy_only=False)
        cols = {c: b.column(c).fill_null(0).to_numpy(zero_copy_only=False) for c in ("row", "id", "lo", "need")}
        cols["none"] = np.asarray(b.column("id").is_null())
        for k in (0, 1):
            for d in np.unique(sizes[kind == k]):
                at = np.flatnonzero((kind == k) & (sizes == d))
                m = flat[starts[at][:, None] + np.arange(d)] if d else np.zeros((len(at), 0), dtype)
                yield k, int(d), m, {c: x[at] for c, x in cols.items()}


def _tiles(batches, dtype):
    """Of a cell: first None and the queries by length, then (length, candidates' matrix, their columns) in tiles."""
    queries: dict[int, list] = {}
    waiting: dict[int, list] = {}

    def joined(parts):
        return np.concatenate([m for m, _ in parts]), {c: np.concatenate([x[c] for _, x in parts]) for c in parts[0][1]}

    told = False
    for k, d, m, cols in _batches(batches, dtype):
        if k == 0:
            queries.setdefault(d, []).append((m, cols))
            continue
        if not told:
            told = True
            yield None, {x: joined(q) for x, q in queries.items()}, None
        if d not in queries:
            continue
        waiting.setdefault(d, []).append((m, cols))
        if sum(len(x) for x, _ in waiting[d]) >= TILE:
            yield (d, *joined(waiting.pop(d)))
    if not told:
        yield None, {x: joined(q) for x, q in queries.items()}, None
    for d, parts in waiting.items():
        yield (d, *joined(parts))


def _scores(q: np.ndarray, c: np.ndarray, rows: np.ndarray, crows: np.ndarray, none) -> np.ndarray:
    """Scores of a tile of queries and candidates, with `none` where a query meets its own row."""
    s = q @ c.T
    _, i, j = np.intersect1d(rows, crows, return_indices=True)
    s[i, j] = none[i]
    return s


def count(batches, dtype, bits: int):
    """(row, bin, n): the counts of every query's scores, in bins of 2^bits from its lo, down to the need of the query."""
    held = {}
    for d, c, cols in _tiles(batches, dtype):
        if d is None:
            held = {x: (m, own, np.zeros((len(m), BINS), np.int64)) for x, (m, own) in c.items()}
            continue
        m, own, n = held[d]
        for a in range(0, len(m), QUERY_TILE):
            lo = own["lo"][a : a + QUERY_TILE].astype(dtype)
            s = _scores(m[a : a + QUERY_TILE], c, own["row"][a : a + QUERY_TILE], cols["row"], lo - 1)
            s -= lo[:, None]
            s = s >> bits if s.dtype.kind == "i" else np.floor(np.ldexp(s, -bits), out=s)
            inside = (s >= 0) & (s < BINS)
            at = s.astype(np.int32)
            at += (np.arange(len(lo), dtype=np.int32) * BINS)[:, None]
            at = at.reshape(-1) if inside.all() else at[inside]
            n[a : a + QUERY_TILE] += np.bincount(at, minlength=len(lo) * BINS).reshape(len(lo), BINS)
    for m, own, n in held.values():
        above = np.cumsum(n[:, ::-1], 1)[:, ::-1] - n
        q, b = np.nonzero((n > 0) & (above < own["need"][:, None]))
        yield pa.RecordBatch.from_arrays([pa.array(own["row"][q]), pa.array(b.astype(np.int32)), pa.array(n[q, b])], names=["row", "bin", "n"])


def found(batches, dtype):
    """(row, query_id, vec_id, score): scores above a query's lo, and of those equal to it the `need` smallest ids."""
    held, ties = {}, {}

    def smallest(d):
        q, ids, none = (np.concatenate(x) for x in zip(*ties[d]))
        order = np.lexsort((ids, none, q))
        q, ids, none = q[order], ids[order], none[order]
        place = np.arange(len(q)) - np.searchsorted(q, q, side="left")
        keep = place < held[d][1]["need"][q]
        ties[d] = [(q[keep], ids[keep], none[keep])]
        return ties[d][0]

    def rows(d, q, ids, none, score):
        own = held[d][1]
        return pa.RecordBatch.from_arrays(
            [pa.array(own["row"][q]), pa.array(own["id"][q]), pa.array(ids, mask=none), pa.array(score.astype(np.int64))], names=["row", "query_id", "vec_id", "score"]
        )

    for d, c, cols in _tiles(batches, dtype):
        if d is None:
            held = c
            continue
        m, own = held[d]
        for a in range(0, len(m), QUERY_TILE):
            lo = own["lo"][a : a + QUERY_TILE].astype(dtype)
            s = _scores(m[a : a + QUERY_TILE], c, own["row"][a : a + QUERY_TILE], cols["row"], lo - 1)
            q, j = np.nonzero(s > lo[:, None])
            if len(q):
                yield rows(d, q + a, cols["id"][j], cols["none"][j], s[q, j])
            q, j = np.nonzero(s == lo[:, None])
            if len(q):
                ties.setdefault(d, []).append((q + a, cols["id"][j], cols["none"][j]))
                if sum(len(x) for x, _, _ in ties[d]) > TIES:
                    smallest(d)
    for d in ties:
        q, ids, none = smallest(d)
        yield rows(d, q, ids, none, held[d][1]["lo"][q])


class Grid:
    """Cells of queries and candidates over the integer vectors of one search."""

    def __init__(self, base: DataFrame, is_query: Column):
        self.spark = base.sparkSession
        chosen = F.col("__id").isNotNull() & F.coalesce(is_query, F.lit(False))
        norm = F.aggregate("__v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
        x = base.agg(F.count("*").alias("n"), F.count_if(chosen).alias("queries"), F.max(F.when(chosen, norm)).alias("q"), F.max(norm).alias("c")).first()
        self.n, self.queries = x["n"], x["queries"]
        #: No score is larger, whatever its sign.
        self.bound = int(((x["q"] or 0.0) * (x["c"] or 0.0)) ** 0.5 * (1 + 1e-9)) + 1
        if self.bound >= 1 << 62:
            raise ValueError("scores of these vectors may need more than 64 bits")
        largest = max(int((x["c"] or 0.0) ** 0.5) + 1, self.bound)
        self.dtype, kind = ("f4", "float") if largest < 1 << 23 else ("f8", "double") if largest < 1 << 52 else ("i8", "bigint")
        self.base = base.withColumn("__v", F.col("__v").cast(f"array<{kind}>"))
        self.chosen = chosen
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.down = max(1, -(-self.queries // QUERIES))
        self.across = max(1, min(-(-self.n // CANDIDATES), -(-parts // self.down)))

    def over(self, state: DataFrame, fn, schema: str) -> DataFrame:
        """fn over every cell that the queries in state (row, lo, need) meet."""
        deal = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "__row"), F.lit(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        cell = (F.col("g") * self.across + F.col("h")).alias("cell")
        q = self.base.where(self.chosen).join(state.withColumnRenamed("row", "__row"), "__row")
        q = q.select("*", deal("queries", self.down).alias("g")).select("*", every(self.across).alias("h"))
        c = self.base.withColumns({"lo": F.lit(None).cast("long"), "need": F.lit(None).cast("int")})
        c = c.select("*", deal("candidates", self.across).alias("h")).select("*", every(self.down).alias("g"))
        side = lambda x, k: x.select(cell, F.lit(k).alias("kind"), F.col("__row").alias("row"), F.col("__id").alias("id"), F.col("__v").alias("v"), "lo", "need")
        both = side(q, 0).unionByName(side(c, 1)).repartitionById(self.down * self.across, F.col("cell"))
        return both.sortWithinPartitions("kind").drop("cell").mapInArrow(fn, schema)


def search(vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: of each query the k rows of highest integer inner product, ties to the smaller id.

    is_query: a condition on __id, the ids as numbers.
    """
    spark = vectors.sparkSession
    grid = Grid(integers(vectors, id_col, vec_col, scale), is_query)
    if not grid.queries or k < 1:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dtype = grid.dtype
    state = grid.base.where(grid.chosen).select(F.col("__row").alias("row"), F.lit(-grid.bound).cast("long").alias("lo"), F.lit(k).alias("need"), F.lit(False).alias("done"))
    bits, first = max(0, (2 * grid.bound + 1).bit_length() - BIN_BITS), True
    while True:
        wanted = state.where("NOT done")
        if not first and wanted.isEmpty():
            break
        n = grid.over(wanted.drop("done"), lambda batches, b=bits: count(batches, dtype, b), "row long, bin int, n long")
        down = W.partitionBy("row").orderBy(F.desc("bin"))  # BINS rows at most
        n = n.groupBy("row", "bin").agg(F.sum("n").alias("n")).withColumn("above", F.sum("n").over(down) - F.col("n"))
        n = n.join(wanted.select("row", "need"), "row").where("above < need AND above + n >= need").select("row", "bin", "n", "above")
        x = state.join(n, "row", "left")
        left = F.col("need") - F.coalesce("above", F.lit(0)).cast("int")
        state = cut(x.select(
            "row", (F.col("lo") + F.coalesce(F.col("bin"), F.lit(0)).cast("long") * (1 << bits)).alias("lo"), left.alias("need"),
            (F.col("done") | F.col("bin").isNull() | F.lit(bits == 0) | (F.col("n") == left)).alias("done"),
        ))
        bits, first = max(0, bits - BIN_BITS), False
    hits = grid.over(state.drop("done"), lambda batches: found(batches, dtype), "row long, query_id long, vec_id long, score long")
    place = F.row_number().over(W.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    return hits.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: the 20 best of all other embeddings for every embedding whose id is divisible by 20."""
    return search(read(spark, sf_dir, "embeddings"), F.col("__id") % 20 == 0)


ORACLE = f"""
WITH x AS (
  SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda e: floor({SCALE} * e::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = len(embedding)),
pairs AS (
  SELECT q.i, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM x q JOIN x c ON q.i <> c.i AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, vec_id NULLS LAST)::INT AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM placed WHERE rank <= {K}
"""
