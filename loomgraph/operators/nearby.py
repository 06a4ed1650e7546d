"""The most similar vectors of every query in slabs: exact, in bounded memory, with few rows.

Vectors are dealt by id into slabs and queries into groups. A task holds one slab and streams one group of queries past
it; it gives at most k rows for each query and slab, not k for each pair of small blocks. Products are made in single
precision, and what may be among a query's k best by the bound of their error is computed again in double precision, value
by value, so equal vectors tie whatever they are multiplied with. Of equal vectors in a slab only the k + 1 with the
smallest ids are compared: others can't be among anybody's k best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .workspace import ship

#: Vectors of a slab and queries of a group, on average; queries and vectors that are multiplied at once.
SLAB, GROUP = 32768, 131072
ROWS, TILE = 1024, 2048
#: Pairs whose similarity is computed again at once.
AGAIN = 1 << 16


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def vectors(column: pa.Array) -> np.ndarray:
    """A column of lists of the same length as a matrix."""
    n = column.value_lengths().to_numpy(zero_copy_only=False)
    if len(n) and (n != n[0]).any():
        raise ValueError("vectors differ in length")
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(n), -1 if len(n) and n[0] else 0)


class Slab:
    """Vectors in the order of their ids; those of equal vectors that can be among a query's k best."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int | None):
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], unit(x[order])
        if k is not None and len(ids):
            _, same = np.unique(np.ascontiguousarray(x + 0.0).view(f"V{8 * x.shape[1]}").ravel(), return_inverse=True)
            by = np.argsort(same, kind="stable")
            s, i = same[by], ids[by]
            first = np.r_[True, s[1:] != s[:-1]]
            # the place of an id among the different ids of its vector
            fresh = np.cumsum(first | np.r_[True, i[1:] != i[:-1]])
            place = fresh - np.repeat(fresh[first], np.diff(np.r_[np.flatnonzero(first), len(s)]))
            keep = np.sort(by[place <= k])
            ids, x = ids[keep], x[keep]
        self.ids, self.x, self.k = ids, x, k
        self.thin = x.astype(np.float32)

    def best(self, names: np.ndarray, q: np.ndarray, min_sim: float | np.ndarray, places: int | None, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places of queries, ids and similarities of the k best (all, for None) of at least min_sim (one, or one for each query)."""
        min_sim = np.broadcast_to(np.asarray(min_sim, float), len(q))
        k, err = self.k, (q.shape[1] + 8) * 1.2e-7 + 1e-9
        thin = q.astype(np.float32)
        lo, hi = np.searchsorted(self.ids, names, "left"), np.searchsorted(self.ids, names, "right")
        least = min_sim - err  # what a pair needs in single precision to count
        held = [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]
        for a in range(0, len(self.ids), TILE):
            b = min(a + TILE, len(self.ids))
            sim = thin @ self.thin[a:b].T
            if not same:
                for r in np.flatnonzero((lo < b) & (hi > a) & (lo < hi)):
                    sim[r, max(lo[r], a) - a : hi[r] - a] = -9
            hit = sim >= least[:, None].astype(np.float32) - np.float32(1e-7)
            if k is not None and b - a > k > 0 and np.count_nonzero(hit) > 4 * k * len(q):
                kth = np.partition(np.nan_to_num(sim, nan=-9.0), b - a - k, axis=1)[:, b - a - k]
                least = np.maximum(least, kth - 2 * err - 1e-6)
                hit &= sim >= least[:, None].astype(np.float32) - np.float32(1e-7)
            i, j = np.divmod(np.flatnonzero(hit), b - a)  # a matrix's own nonzero() takes ten times as long
            if not len(i):
                continue
            j = j + a
            exact = np.concatenate([np.einsum("ij,ij->i", q[i[c : c + AGAIN]], self.x[j[c : c + AGAIN]]) for c in range(0, len(i), AGAIN)])
            if places is not None:
                exact = np.round(exact, places)
            ok = exact >= min_sim[i]
            found = i[ok], j[ok], exact[ok]
            if k is None:
                yield found[0], self.ids[found[1]], found[2]
                continue
            i, j, s = (np.concatenate(x) for x in zip(held, found))
            order = np.lexsort((j, -s, i))
            i, j, s = i[order], j[order], s[order]
            keep = np.arange(len(i)) - np.searchsorted(i, i, side="left") < k
            held = [i[keep], j[keep], s[keep]]
            full = np.bincount(held[0], minlength=len(q)) >= k if k else np.ones(len(q), bool)
            last = np.full(len(q), np.inf)
            np.minimum.at(last, held[0], held[2])
            least = np.where(full, np.maximum(least, last - err), least)
        if k is not None:
            yield held[0], self.ids[held[1]], held[2]


def nearest(queries: DataFrame, nodes: DataFrame, k: int | None, min_sim: float, slab: int = SLAB, places: int | None = None, same: bool = False) -> DataFrame:
    """src, dst, sim: of every query (id, embedding), for each slab of nodes (id, embedding), the k most similar of min_sim
    or more (all, for None); ties go to the smaller id. same: a node with the query's id counts too. Null ids and vectors
    take no part. What is best in all slabs is the caller's to choose."""
    spark = nodes.sparkSession
    ship(spark)
    kinds = dict(queries.dtypes)["id"], dict(nodes.dtypes)["id"]
    kind = "array<float>" if dict(queries.dtypes)["embedding"] == dict(nodes.dtypes)["embedding"] == "array<float>" else "array<double>"
    ready = lambda df: df.where("id IS NOT NULL AND embedding IS NOT NULL").select("id", F.col("embedding").cast(kind).alias("v"))
    n, m = queries.count(), nodes.count()
    slabs = max(1, -(-m // max(1, slab)))
    groups = max(1, -(-n // GROUP), min(-(-n // ROWS), -(-4 * spark.sparkContext.defaultParallelism // slabs)))
    at = lambda most: F.pmod(F.xxhash64("id"), F.lit(most)).cast("int")
    every = lambda most: F.explode(F.sequence(F.lit(0), F.lit(most - 1)))
    none = lambda t: F.lit(None).cast(t)
    left = ready(nodes).select(at(slabs).alias("slab"), every(groups).alias("group"), F.lit(False).alias("asks"), none(kinds[0]).alias("src"), F.col("id").alias("dst"), "v")
    right = ready(queries).select(every(slabs).alias("slab"), at(groups).alias("group"), F.lit(True).alias("asks"), F.col("id").alias("src"), none(kinds[1]).alias("dst"), "v")
    cell = (F.col("group") * slabs + F.col("slab")).cast("int").alias("cell")
    both = left.unionByName(right).select(cell, "asks", "src", "dst", "v").repartitionById(groups * slabs, F.col("cell")).sortWithinPartitions("cell", "asks")
    arrow = to_arrow_schema(spark.createDataFrame([], f"src {kinds[0]}, dst {kinds[1]}, sim double").schema)
    column = lambda b, c: b.column(c).to_numpy(zero_copy_only=False)

    def run(batches):
        at, slab, held = None, None, []
        for batch in batches:
            cells, asks = column(batch, "cell"), column(batch, "asks").astype(bool)
            key = 2 * cells.astype(np.int64) + asks
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else []
            for a, b in zip(starts, [*starts[1:], len(key)]):
                if cells[a] != at:
                    at, slab, held = cells[a], None, []
                part = batch.slice(a, b - a)
                if not asks[a]:
                    held.append((column(part, "dst"), vectors(part.column("v"))))
                    continue
                if slab is None:
                    if not held:
                        continue
                    slab = Slab(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]), k)
                    held = []
                names, q = column(part, "src"), unit(vectors(part.column("v")))
                for c in range(0, len(q), ROWS):
                    for i, ids, sim in slab.best(names[c : c + ROWS], q[c : c + ROWS], min_sim, places, same):
                        for d in range(0, len(i), AGAIN):
                            e = slice(d, d + AGAIN)
                            yield pa.RecordBatch.from_pandas(pd.DataFrame({"src": names[c + i[e]], "dst": ids[e], "sim": sim[e]}), arrow, preserve_index=False)

    return both.mapInArrow(run, f"src {kinds[0]}, dst {kinds[1]}, sim double")
