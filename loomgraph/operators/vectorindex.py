"""An inverted file over vectors: cells around k-means centers, some of them probed for a query, exact re-ranking.

build() trains the centers by Lloyd's rounds on a bounded sample (SAMPLE vectors a center), as sums on the executors, and
puts every vector into the cell of its nearest center, in Parquet partitioned by cell. The driver holds the centers
(MOST_CELLS at most) and, of each cell, its size and radius.

near() compares a query with the vectors of its `probes` nearest cells. With exact=True it goes on to every cell that
may hold something as near as what it has: a member is no nearer to the query than the query's distance from the center
less the cell's radius. Cells of any size are dealt to tasks in parts of PART vectors and QUERIES queries, so neither a
cell that holds a third of all vectors nor one that all queries probe is one task's work. The cells that an exact search
goes on to are most of them where vectors have many dimensions, so a query isn't sent to each: cells are put together in
slabs, a query is sent once to a slab, and there compared with the cells that may hold something.

Vectors count by direction (unit length, a norm of 1e-12 at least). Null vectors and ids take no part. Similarities are
rounded to nine places, so that equal vectors tie in any order of sums; ties go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from . import nearby
from .workspace import checkpointed, ship

MOST_CELLS = 4096
#: Vectors of the training sample for each cell, and rounds of training.
SAMPLE, ROUNDS = 100, 8
PROBES = 8
#: Vectors and queries that meet in one group, on average, and queries whose similarities are held at once.
PART, QUERIES, TILE = 8192, 4096, 512
#: Queries that are dealt to cells at once, and rows of what that gives.
DEAL = 1024
#: Vectors of neighbouring cells that queries are sent to at once by an exact search, and queries that are compared at once.
SLAB, ROWS = 32768, 1024


def unit(vectors) -> np.ndarray:
    x = np.array([np.asarray(v, float) for v in vectors])
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) if len(x) else x


def _distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    d = (x * x).sum(1)[:, None] - 2 * (x @ centers.T) + (centers * centers).sum(1)[None]
    return np.sqrt(np.maximum(d, 0))


def train(vectors: DataFrame, cells: int, n: int, rounds: int = ROUNDS, seed: int = 0) -> np.ndarray:
    """Centers of about `cells` groups of vectors (embedding), n in number."""
    spark = vectors.sparkSession
    ship(spark)
    if not n:
        return np.zeros((0, 0))
    place = F.xxhash64(F.lit(seed), F.col("embedding").cast("string"))
    share = min(1.0, SAMPLE * cells / max(1, n))
    some = vectors if share == 1 else vectors.where(F.pmod(F.xxhash64(F.lit(seed + 1), "id"), F.lit(1 << 40)) < int(share * (1 << 40)))
    some = checkpointed(some.select("embedding", place.alias("place")))
    first = some.groupBy("place").agg(F.first("embedding").alias("embedding")).orderBy("place").limit(cells).collect()
    centers = unit([r["embedding"] for r in first])
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(centers)

        def sums(batches, sent=sent):
            total, n = np.zeros_like(sent.value), np.zeros(len(sent.value), np.int64)
            for pdf in batches:
                if len(pdf):
                    x = unit(pdf["embedding"])
                    at = _distances(x, sent.value).argmin(1)
                    np.add.at(total, at, x)
                    n += np.bincount(at, minlength=len(n))
            there = np.flatnonzero(n)
            if len(there):
                yield pd.DataFrame({"cell": there, "n": n[there], "total": list(total[there])})

        parts = some.mapInPandas(sums, "cell int, n long, total array<double>")
        each = parts.select("cell", "n", F.posexplode("total").alias("i", "x")).groupBy("cell", "i").agg(F.sum("x").alias("x"))
        got = each.groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("x")).select("cell", F.transform("x", lambda s: s["x"]).alias("x"))
        new = centers.copy()
        for r in got.toLocalIterator():  # a row for each center
            new[r["cell"]] = r["x"]
        new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)
        moved = np.abs(new - centers).max() if len(new) else 0
        centers = new
        if moved < 1e-6:
            break
    return centers


class VectorIndex:
    """A stored index; build() makes one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        rows = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()  # MOST_CELLS at most
        self.centers = np.array([r["center"] for r in rows], float)
        self.sizes = np.array([r["n"] for r in rows], np.int64)
        self.radius = np.array([r["radius"] for r in rows], float)
        self.table = spark.read.parquet(f"{path}/vectors")

    @classmethod
    def build(cls, vectors: DataFrame, path: str, cells: int | None = None, rounds: int = ROUNDS, seed: int = 0) -> VectorIndex:
        """Index all vectors (id, embedding) into the folder path."""
        spark = vectors.sparkSession
        vectors = vectors.where("id IS NOT NULL AND embedding IS NOT NULL").select("id", F.col("embedding").cast("array<double>").alias("embedding"))
        n = vectors.count()
        cells = min(MOST_CELLS, max(1, int(n**0.5)) if cells is None else max(1, cells))
        centers = train(vectors, cells, n, rounds, seed)
        sent = spark.sparkContext.broadcast(centers)
        kind = dict(vectors.dtypes)["id"]

        def place(batches):
            for pdf in batches:
                if len(pdf):
                    x = unit(pdf["embedding"])
                    d = _distances(x, sent.value)
                    at = d.argmin(1)
                    yield pd.DataFrame({"id": pdf["id"], "v": list(x), "cell": at, "away": d[np.arange(len(at)), at]})

        schema = f"id {kind}, v array<double>, cell int, away double"
        if n:
            put = vectors.mapInPandas(place, schema)
            put.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(64))).write.partitionBy("cell").parquet(f"{path}/vectors")
            found = spark.read.parquet(f"{path}/vectors").groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius"))
            rows = {r["cell"]: (r["n"], r["radius"]) for r in found.collect()}
        else:
            spark.createDataFrame([], schema).write.parquet(f"{path}/vectors")
            rows = {}
        table = [(i, c.tolist(), *rows.get(i, (0, 0.0))) for i, c in enumerate(centers)]
        spark.createDataFrame(table, "cell int, center array<double>, n long, radius double").write.parquet(f"{path}/cells")
        return cls(spark, path)

    def _deal(self, queries: DataFrame, choose, kind: str) -> DataFrame:
        """qid, v, cell: queries (qid, v, least) with the cells that choose(distances, least) gives, as pairs of indexes."""
        centers = self.spark.sparkContext.broadcast(self.centers)

        def run(batches):
            for pdf in batches:
                if len(pdf):
                    for c in range(0, len(pdf), DEAL):
                        part = pdf.iloc[c : c + DEAL]
                        names, v = part["qid"].to_numpy(), part["v"].to_numpy()
                        i, j = choose(_distances(np.stack([np.asarray(x, float) for x in v]), centers.value), part["least"].to_numpy(float))
                        for d in range(0, len(i), DEAL):
                            yield pd.DataFrame({"qid": names[i[d : d + DEAL]], "v": list(v[i[d : d + DEAL]]), "cell": j[d : d + DEAL]})

        return queries.mapInPandas(run, f"qid {kind}, v array<double>, cell int")

    def _scan(self, dealt: DataFrame, k: int | None, min_sim: float, kind: str, same: bool) -> DataFrame:
        """qid, id, sim: of each query the k best of each part of its cells."""
        own = dict(self.table.dtypes)["id"]
        asked = {r["cell"]: r["n"] for r in dealt.groupBy("cell").agg(F.count("*").alias("n")).collect()}
        if not asked:
            return self.spark.createDataFrame([], f"qid {kind}, id {own}, sim double")
        rows = [(c, int(-(-self.sizes[c] // PART)), int(-(-n // QUERIES))) for c, n in asked.items() if self.sizes[c]]
        deal = F.broadcast(self.spark.createDataFrame(rows, "cell int, parts int, turns int"))  # MOST_CELLS at most
        turn, part = F.pmod(F.xxhash64("qid"), F.col("turns")).cast("int"), F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        q = dealt.join(deal, "cell").select("cell", turn.alias("turn"), every("parts").alias("part"), "qid", F.col("v").alias("qv"))
        v = self.table.where(F.col("cell").isin([c for c, _, _ in rows])).join(deal, "cell").select("cell", part.alias("part"), every("turns").alias("turn"), "id", "v")

        def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            found = []
            if len(left) and len(right):
                ids, m = right["id"].to_numpy(), np.stack([np.asarray(x, float) for x in right["v"]])
                names, qs = left["qid"].to_numpy(), np.stack([np.asarray(x, float) for x in left["qv"]])
                for a in range(0, len(qs), TILE):
                    sim = np.round(qs[a : a + TILE] @ m.T, 9)
                    if not same:
                        sim[names[a : a + TILE, None] == ids[None, :]] = -2
                    i, j = np.nonzero(sim >= min_sim)
                    order = np.lexsort((ids[j], -sim[i, j], i))
                    i, j = i[order], j[order]
                    if k is not None:
                        keep = np.arange(len(i)) - np.searchsorted(i, i, side="left") < k
                        i, j = i[keep], j[keep]
                    found.append(pd.DataFrame({"qid": names[a + i], "id": ids[j], "sim": sim[i, j]}))
            return pd.concat(found) if found else pd.DataFrame({"qid": left["qid"][:0], "id": right["id"][:0], "sim": pd.Series([], dtype=float)})

        key = ["cell", "part", "turn"]
        return q.groupBy(*key).cogroup(v.groupBy(*key)).applyInPandas(meet, f"qid {kind}, id {own}, sim double")

    def _rest(self, queries: DataFrame, k: int, kind: str, few: int, same: bool) -> DataFrame:
        """qid, id, sim: of queries (qid, v, least) the k best of each slab, from the cells beyond the `few` nearest that
        may hold a similarity of `least`."""
        own, sizes, radius = dict(self.table.dtypes)["id"], self.sizes, self.radius
        parts = np.maximum(1, -(-sizes // SLAB))
        of = np.cumsum(sizes) // SLAB  # cells of one slab are together; larger cells are in several parts
        width = int(parts.max())
        used = sorted({int(a) * width + b for a, n in zip(of, parts) for b in range(n)})
        number = {a: i for i, a in enumerate(used)}
        rows = [(c, [number[int(of[c]) * width + b] for b in range(parts[c])]) for c in range(len(sizes)) if sizes[c]]
        deal = F.broadcast(self.spark.createDataFrame(rows, "cell int, slabs array<int>"))  # MOST_CELLS at most
        slabs = len(used)
        n = queries.count()
        groups = max(1, -(-n // nearby.GROUP), min(-(-n // ROWS), -(-4 * self.spark.sparkContext.defaultParallelism // slabs)))
        every = lambda most: F.explode(F.sequence(F.lit(0), F.lit(most - 1)))
        none = lambda t: F.lit(None).cast(t)
        pick = F.get("slabs", F.pmod(F.xxhash64("id"), F.size("slabs")).cast("int"))
        v = self.table.join(deal, "cell").select(pick.alias("slab"), every(groups).alias("group"), F.lit(False).alias("asks"), "cell", none(kind).alias("qid"), "id", "v", none("double").alias("least"))
        q = queries.select(every(slabs).alias("slab"), F.pmod(F.xxhash64("qid"), F.lit(groups)).cast("int").alias("group"), F.lit(True).alias("asks"), F.lit(-1).alias("cell"), "qid", none(own).alias("id"), "v", "least")
        task = (F.col("group") * slabs + F.col("slab")).cast("int").alias("task")
        both = v.unionByName(q).select(task, "asks", "cell", "qid", "id", "v", "least").repartitionById(groups * slabs, F.col("task")).sortWithinPartitions("task", "asks", "cell")
        sent = self.spark.sparkContext.broadcast(self.centers)
        there = sizes > 0
        arrow = to_arrow_schema(self.spark.createDataFrame([], f"qid {kind}, id {own}, sim double").schema)
        column = lambda b, c: b.column(c).to_numpy(zero_copy_only=False)

        def best(slab, names, x, least):
            """Of one batch of queries and one slab (cell -> Slab)."""
            d = np.where(there[None], _distances(x, sent.value), np.inf)
            done = np.argpartition(d, few - 1, axis=1)[:, :few]
            cells = np.array(sorted(slab))
            may = 1 - np.maximum(d[:, cells] - radius[None, cells] - 1e-9, 0) ** 2 / 2
            open_ = (may >= least[:, None] - 1e-9) & ~(done[:, :, None] == cells[None, None]).any(1)
            found, least = [], least.copy()
            for c in np.argsort(-may.max(0)):
                at = np.flatnonzero(open_[:, c] & (may[:, c] >= least - 1e-9))
                if len(at):
                    for i, ids, sim in slab[cells[c]].best(names[at], x[at], least[at], 9, same):
                        found.append((at[i], ids, sim))
                        # k of one cell are enough to know what is too far in others
                        n = np.bincount(i, minlength=len(at))
                        low = np.full(len(at), np.inf)
                        np.minimum.at(low, i, sim)
                        least[at] = np.where(n >= k, np.maximum(least[at], low), least[at])
            if found:
                i, ids, sim = (np.concatenate(x) for x in zip(*found))
                order = np.lexsort((ids, -sim, i))
                i, ids, sim = i[order], ids[order], sim[order]
                keep = np.arange(len(i)) - np.searchsorted(i, i, side="left") < k
                yield pa.RecordBatch.from_pandas(pd.DataFrame({"qid": names[i[keep]], "id": ids[keep], "sim": sim[keep]}), arrow, preserve_index=False)

        def run(batches):
            at, held, slab = None, [], None
            for batch in batches:
                tasks, asks = column(batch, "task"), column(batch, "asks").astype(bool)
                key = 2 * tasks.astype(np.int64) + asks
                starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else []
                for a, b in zip(starts, [*starts[1:], len(key)]):
                    if tasks[a] != at:
                        at, held, slab = tasks[a], [], None
                    part = batch.slice(a, b - a)
                    if not asks[a]:
                        held.append((column(part, "cell"), column(part, "id"), nearby.vectors(part.column("v"))))
                        continue
                    if slab is None:
                        if not held:
                            continue
                        cell, ids, x = (np.concatenate(x) for x in zip(*held))
                        held, edges = [], np.flatnonzero(np.r_[True, cell[1:] != cell[:-1], True])
                        slab = {int(cell[i]): nearby.Slab(ids[i:j], x[i:j], k) for i, j in zip(edges, edges[1:])}
                    names, x, least = column(part, "qid"), nearby.vectors(part.column("v")), column(part, "least")
                    for c in range(0, len(x), ROWS):
                        yield from best(slab, names[c : c + ROWS], x[c : c + ROWS], least[c : c + ROWS])

        return both.mapInArrow(run, f"qid {kind}, id {own}, sim double")

    def near(self, queries: DataFrame, k: int | None = 1, min_sim: float = -1.0, probes: int = PROBES, exact: bool = False, same: bool = False) -> DataFrame:
        """src, dst, sim: of every query (id, embedding) the k most similar vectors (all, for None, which is always exact)
        of min_sim or more. same: a vector with the query's id counts too."""
        ship(self.spark)
        kind = dict(queries.dtypes)["id"]
        x = queries.where("id IS NOT NULL AND embedding IS NOT NULL").select(F.col("id").alias("qid"), F.col("embedding").cast("array<double>").alias("v"))

        def ready(batches):
            for pdf in batches:
                if len(pdf):
                    yield pd.DataFrame({"qid": pdf["qid"], "v": list(unit(pdf["v"])), "least": np.full(len(pdf), min_sim)})

        x = checkpointed(x.mapInPandas(ready, f"qid {kind}, v array<double>, least double"))
        there, radius = self.sizes > 0, self.radius
        few = min(probes, int(there.sum()))

        def nearest(d, least):
            d = np.where(there[None], d, np.inf)
            at = np.argpartition(d, few - 1, axis=1)[:, :few]
            return np.repeat(np.arange(len(d)), few), at.reshape(-1)

        def within(d, least):
            """Cells that may hold a similarity of `least`: sim <= 1 - distance^2 / 2."""
            bound = 1 - np.maximum(d - radius[None] - 1e-9, 0) ** 2 / 2
            return np.nonzero((bound >= least[:, None] - 1e-9) & there[None])

        if not few:
            return self.spark.createDataFrame([], f"src {kind}, dst {dict(self.table.dtypes)['id']}, sim double")
        best = lambda found: found.withColumn("rn", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("sim"), "id"))).where(F.col("rn") <= k)
        if k is None:
            found = self._scan(self._deal(x, within, kind), None, min_sim, kind, same)
            return found.select(F.col("qid").alias("src"), F.col("id").alias("dst"), "sim")
        found = best(self._scan(checkpointed(self._deal(x, nearest, kind)), k, min_sim, kind, same))
        if exact:
            found = checkpointed(found)
            kth = found.where(F.col("rn") == k).select("qid", F.col("sim").alias("kth"))
            more = x.join(kth, "qid", "left").select("qid", "v", F.coalesce("kth", F.lit(min_sim)).alias("least"))
            late = self._rest(checkpointed(more), k, kind, few, same)
            found = best(found.select("qid", "id", "sim").unionByName(late))
        return found.select(F.col("qid").alias("src"), F.col("id").alias("dst"), "sim")
