"""What candidates hold and reach, met with descriptions, without a row for each way between them.

A candidate's skills times the paths from them are many more rows than either table, and times the descriptions many more
again. So candidates are dealt into groups and wanted skills into blocks; a cell has one group's holdings and one block's
paths and wants, and a candidate's ways are made, reduced and summed there, CHUNK holdings at a time. What is shuffled is
the holdings, once for each block, the paths and wants, once for each group, and what is made of them. Rows are packed for
it: one for each candidate, source and piece of a description, with arrays of its skills.

A task streams its cell in order: wants, then paths (BLOCK on average, 8 bytes each), which it holds, then candidates, of
which it holds one chunk. Up to BLOCK paths there is one block, and what a cell gives of a candidate is whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.scoring import ScoringParams
from .workspace import checkpointed, ship

#: Paths of a block and holdings of a group, on average.
BLOCK, GROUP = 24_000_000, 24_000_000
#: Holdings whose ways are made at once, descriptions that are summed at once, and wants in a row.
CHUNK, WIDE, PIECE = 4096, 256, 2048
#: Wants are held as a table of skills and descriptions if one of so many of its places is filled.
SPARSE = 16
_FAR = np.iinfo(np.int32).max


def _at(names: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of x in sorted names, and whether they are there."""
    at = np.searchsorted(names, x)
    at[at == len(names)] = 0
    return at, (names[at] == x if len(names) else np.zeros(len(x), bool)).astype(bool)


def ordered(key: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """The stable order of keys from 0 to below top, and the keys in it."""
    bits = len(key).bit_length()
    if top.bit_length() + bits > 62:
        order = np.argsort(key, kind="stable")
        return order, key[order]
    x = (key.astype(np.int64) << bits) | np.arange(len(key))
    x.sort()
    return x & ((1 << bits) - 1), x >> bits


class Cell:
    """The wants (jd, skill, demand) and paths of a block; size: how many paths will be added."""

    def __init__(self, jd: np.ndarray, skill: np.ndarray, demand: np.ndarray, size: int = 0):
        self.skills = np.unique(skill)
        self.jd, self.jds = pd.factorize(jd, use_na_sentinel=False)
        self.skill, self.demand = _at(self.skills, skill)[0], demand
        self.whole, self.kept = False, {}
        self._size, self._sources, self._parts = 0, [], []
        self.dst, self.code, self.hops = np.empty(size, np.int32), np.empty(size, np.uint16), np.empty(size, np.int16)

    def add(self, src: np.ndarray, n: np.ndarray, dst: np.ndarray, dist: np.ndarray, hops: np.ndarray) -> None:
        """n paths from each of src, in order; dist: nan if there is none, hops: -1."""
        a, b = self._size, self._size + len(dst)
        code, values = pd.factorize(dist)  # nan: -1
        if len(values) > 65534 and self.code.dtype == np.uint16:
            self.code = self.code.astype(np.uint32)
        if len(hops) and hops.max() > 32767 and self.hops.dtype == np.int16:
            self.hops = self.hops.astype(np.int32)
        self.dst[a:b], self.hops[a:b] = _at(self.skills, dst)[0], hops
        self.code[a:b] = np.where(code < 0, len(values), code)
        self._sources.append((src, n))
        self._parts.append((a, b, values))
        self._size = b

    def ready(self) -> Cell:
        """All paths are there: their sources in order, and one order of distances; the last stands for none."""
        src = np.concatenate([s for s, _ in self._sources]) if self._sources else np.zeros(0, np.int64)
        n = np.concatenate([n for _, n in self._sources]) if self._sources else np.zeros(0, np.int64)
        order = np.argsort(src, kind="stable")
        self.sources, self.count, self.start = src[order], n[order].astype(np.int64), (np.cumsum(n) - n)[order].astype(np.int64)
        values = np.unique(np.concatenate([v for *_, v in self._parts])) if self._parts else np.zeros(0)
        if len(values) > 65534 and self.code.dtype == np.uint16:
            self.code = self.code.astype(np.uint32)
        for a, b, v in self._parts:
            self.code[a:b] = np.r_[np.searchsorted(values, v), len(values)].astype(self.code.dtype)[self.code[a:b]]
        self.dists = np.r_[values, np.nan]
        self._sources, self._parts = [], []
        return self

    def dense(self) -> bool:
        return len(self.skills) * len(self.jds) <= SPARSE * len(self.skill)

    def slices(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """jds, and of every skill the demand and whether it is wanted, WIDE descriptions at once."""
        if not hasattr(self, "_slices"):
            self._slices = []
            kind = np.float32 if np.array_equal(self.demand.astype(np.float32), self.demand) else np.float64
            for a in range(0, len(self.jds), WIDE):
                own = (self.jd >= a) & (self.jd < a + WIDE)
                shape = len(self.skills), len(self.jds[a : a + WIDE])
                d, n = np.zeros(shape, kind), np.zeros(shape, np.float32)
                d[self.skill[own], self.jd[own] - a], n[self.skill[own], self.jd[own] - a] = self.demand[own], 1.0
                self._slices.append((self.jds[a : a + WIDE], d, n))
        return iter(self._slices)

    def by_skill(self) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the wants by skill, and where each skill's begin."""
        if not hasattr(self, "_wants"):
            order = np.argsort(self.skill, kind="stable")
            self._wants = order, np.searchsorted(self.skill[order], np.arange(len(self.skills) + 1))
        return self._wants

    def ways(self, cand: np.ndarray, skill: np.ndarray, weight: np.ndarray) -> Ways:
        return Ways(self, cand, skill, weight)


class Ways:
    """Of each candidate (0, 1, ... in order) and skill that it holds or reaches, in their order: weight, dist (nan: none),
    its code in the cell's order of distances, hops, via."""

    def __init__(self, cell: Cell, cand: np.ndarray, skill: np.ndarray, weight: np.ndarray):
        self.cell, width, none = cell, max(1, len(cell.skills)), len(cell.dists) - 1
        at, there = _at(cell.skills, skill)
        there &= ~np.isnan(weight)
        own, held = cand[there] * width + at[there], weight[there]
        s, there = _at(cell.sources, skill)
        s, c = s[there], cand[there]
        n = cell.count[s]
        row = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - cell.start[s], n)
        key = np.r_[np.repeat(c * width, n) + cell.dst[row], own]
        order, key = ordered(key, (int(cand[-1]) + 1 if len(cand) else 1) * width)
        first = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
        new, again, way = np.flatnonzero(first), np.flatnonzero(~first), np.cumsum(first) - 1
        of = np.full(len(own), none, np.int64)
        d = np.r_[cell.code[row].astype(np.int64), of][order]
        h = cell.hops[row].astype(np.int32)
        h = np.r_[np.where(h < 0, np.int32(_FAR), h), np.full(len(own), _FAR, np.int32)][order]
        self.code, self.hops = d[new], h[new]
        np.minimum.at(self.code, way[again], d[again])
        np.minimum.at(self.hops, way[again], h[again])
        self.cand = key[new] // width
        self.skill = key[new] - self.cand * width
        self.dist, self.weight = cell.dists[self.code], np.full(len(new), np.nan)
        mine = np.flatnonzero(order >= len(row))
        self.weight[way[mine]] = held[order[mine] - len(row)]
        self.matched = ~np.isnan(self.weight)
        self._entries = lambda: (np.r_[np.repeat(s, n), np.zeros(len(own), np.int64)][order], np.r_[row, np.full(len(own), -1)][order], d, way, new, again)

    @property
    def via(self) -> np.ndarray:
        """The smallest source of the nearest, as its place among the cell's sources."""
        self._nearest()
        return self._via

    @property
    def path(self) -> np.ndarray:
        """The row of the cell's paths that leads there from via; -1 without a distance."""
        self._nearest()
        return self._path

    def _nearest(self) -> None:
        if hasattr(self, "_via"):
            return
        s, row, d, way, new, again = self._entries()
        most = len(self.cell.sources)
        s = np.where((d == self.code[way]) & (d < len(self.cell.dists) - 1), s, most)
        via = s[new]
        np.minimum.at(via, way[again], s[again])
        some = np.flatnonzero((s < most) & (s == via[way]))
        self._path = np.full(len(new), -1, np.int64)
        self._path[way[some]] = row[some]
        self._via = np.where(via < most, via, 0)

    def bridgeable(self, p: ScoringParams) -> np.ndarray:
        ok = ~np.isnan(self.dist) & bool(p.enable_bridging)
        if p.bridge_cutoff is not None:
            ok &= self.dist <= p.bridge_cutoff
        return ok if p.max_hops is None else ok & (self.hops <= p.max_hops)

    def bridge(self, p: ScoringParams) -> np.ndarray:
        credit = np.maximum(0.0, 1.0 - self.dist) * float(p.bridge_credit_scale)
        return credit if p.max_bridge_credit is None else np.minimum(credit, float(p.max_bridge_credit))

    def own(self, p: ScoringParams) -> np.ndarray:
        if not p.use_weights:
            return np.ones(len(self.weight))
        return np.maximum(float(p.min_proficiency_credit), np.minimum(self.weight / p.proficiency_reference, 1.0))

    def rated(self, p: ScoringParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """credit, floored and bridged, as matching.terms() has them."""
        ok, own = self.bridgeable(p), self.own(p)
        bridge = np.where(ok, self.bridge(p), 0.0)
        floored = self.matched & (own < 1.0) & ok & (np.minimum(bridge, 1.0) > own)
        return np.where(floored, np.minimum(bridge, 1.0), np.where(self.matched, own, bridge)), floored, ~self.matched & ok

    def sums(self, names: np.ndarray, by_demand: dict[str, np.ndarray], by_count: dict[str, np.ndarray], every: bool = False) -> Iterator[pd.DataFrame]:
        """jd, cand and the sums of demand times each of by_demand, and of each of by_count over wanted skills; every: also
        where all of them are 0."""
        x, y = np.array([np.asarray(v, float) for v in by_demand.values()]), np.array([np.asarray(v, float) for v in by_count.values()])
        x, y = x.reshape(len(by_demand), len(self.cand)), y.reshape(len(by_count), len(self.cand))
        use = np.flatnonzero(np.any(x != 0, axis=0) | np.any(y != 0, axis=0))
        x, y, skill, cand = x[:, use], y[:, use], self.skill[use], self.cand[use]

        def rows(jds, i, j, got):
            out = {"jd": jds[j], "cand": names[i]}
            out.update({c: got[k] if k < len(x) else np.rint(got[k]).astype(np.int64) for k, c in enumerate([*by_demand, *by_count])})
            return pd.DataFrame(out)

        if not self.cell.dense():
            i, j = self.terms(use)
            n = len(self.cell.jds)
            pair = self.cand[i] * n + self.cell.jd[j]
            pairs, of = (np.arange(len(names) * n), pair) if every else np.unique(pair, return_inverse=True)
            at = np.searchsorted(use, i)
            got = [np.bincount(of, v[at] * self.cell.demand[j], len(pairs)) for v in x] + [np.bincount(of, v[at], len(pairs)) for v in y]
            keep = np.ones(len(pairs), bool) if every else np.any(np.array(got) != 0, axis=0)
            yield rows(self.cell.jds, pairs[keep] // n, pairs[keep] % n, [g[keep] for g in got])
            return
        ends = np.searchsorted(cand, np.arange(len(names) + 1))
        for jds, demand, wanted in self.cell.slices():
            got = np.zeros((len(names), len(x) + len(y), len(jds)))
            for i, (a, b) in enumerate(zip(ends, ends[1:])):
                if b > a:
                    at = skill[a:b]
                    if len(x):
                        got[i, : len(x)] = x[:, a:b] @ demand[at]
                    if len(y):
                        got[i, len(x) :] = y[:, a:b] @ wanted[at]
            i, j = np.nonzero(np.ones((len(names), len(jds)), bool) if every else np.any(got != 0, axis=1))
            yield rows(jds, i, j, [got[i, k, j] for k in range(len(x) + len(y))])

    def terms(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of these ways, and of the cell's wants for the same skill: every pair."""
        order, first = self.cell.by_skill()
        n = first[self.skill[at] + 1] - first[self.skill[at]]
        of = np.repeat(np.arange(len(at)), n)
        return at[of], order[np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + first[self.skill[at]][of]]

    def nearest(self, which: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """terms() of the `most` nearest of these ways, by dist, then skill, for each candidate and description, and their
        places from 1."""
        at = np.flatnonzero(which)
        codes, top = len(self.cell.dists), int(self.cand[-1]) + 1 if len(self.cand) else 1
        # ways are in the order of skills already
        at = at[ordered(self.cand[at] * codes + self.code[at], top * codes)[0]]
        number, wide = self.cand[at], max(1, len(self.cell.jds))
        begin = np.searchsorted(number, np.arange(top + 1))
        had, a, step, out = np.zeros(top * wide, np.int64), 0, 8 * most, []
        left = np.arange(top)
        while len(left):
            # the next ways of each candidate that still lacks some
            x, y = np.minimum(begin[left] + a, begin[left + 1]), np.minimum(begin[left] + a + step, begin[left + 1])
            n = y - x
            some = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - x, n)
            way, want = self.terms(at[some])
            pair = self.cand[way] * wide + self.cell.jd[want]
            order, pair = ordered(pair, top * wide)
            place = np.arange(len(pair)) - np.searchsorted(pair, pair, side="left") + 1 + had[pair]
            good = place <= most
            out.append((way[order][good], want[order][good], place[good]))
            np.add.at(had, pair, 1)
            open_ = np.any(had.reshape(top, wide)[left] < most, axis=1) & (y < begin[left + 1])
            left, a, step = left[open_], a + step, step * 4
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def _flat(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False)


def _sizes(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return pc.list_value_length(batch.column(name)).to_numpy(zero_copy_only=False).astype(np.int64)


def met(wants: DataFrame, have: DataFrame, paths: DataFrame | None, each: Callable[[Ways, np.ndarray], Iterator[pd.DataFrame]], schema: str, last: Callable[[Cell], Iterator[pd.DataFrame]] | None = None) -> tuple[DataFrame, bool]:
    """What each(ways, names of the candidates) gives of every chunk of candidates in every cell, and last(cell) at the end
    of a cell; and whether there is one block, so that a candidate and all that is wanted are in one cell (cell.whole).

    wants: jd, skill, demand. have: cand, skill, weight, one row for each. paths: src, dst, dist, hops, or none. What
    concerns one candidate and skill is in one cell; sums over skills are to be added up over the cells.
    """
    spark = have.sparkSession
    ship(spark)
    wants, kinds = checkpointed(wants.where("skill IS NOT NULL")), dict(have.dtypes)
    kind, jd = kinds["skill"], dict(wants.dtypes)["jd"]
    left = have.where("cand IS NOT NULL AND skill IS NOT NULL").select("cand", "skill", F.coalesce(F.col("weight").cast("double"), F.lit(float("nan"))).alias("v"))
    large = F.max(F.abs("skill")) if kind == "bigint" else F.lit(None).cast("long")
    rows, most = left.agg(F.count("*"), large).first()
    wanted, most_wanted = wants.agg(F.count("*"), large).first()
    # numbers that fit are sent as such
    small = kind == "bigint" and max(most or 0, most_wanted or 0) < 1 << 31
    skill = lambda c: F.col(c).cast("int") if small else F.col(c)
    total, ways = 0, None
    if paths is not None:
        ends = wants.select(F.col("skill").alias("dst")).distinct()
        ways = paths.join(ends, "dst", "left_semi").where("src IS NOT NULL").select("src", "dst", F.coalesce("dist", F.lit(float("nan"))).alias("v"), F.coalesce(F.col("hops").cast("int"), F.lit(-1)).alias("h"))
        total = ways.count()
    blocks = max(1, -(-(total if paths is not None else wanted) // BLOCK))
    groups = max(-(-2 * spark.sparkContext.defaultParallelism // blocks), -(-rows // GROUP))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int") if blocks > 1 else F.lit(0)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    none = lambda t, name: F.lit(None).cast(t).alias(name)
    list_of = lambda c, name: F.collect_list(c).alias(name)
    key = lambda own, cand=None, j=None, src=None: [
        F.lit(own).alias("own"), none(kinds["cand"], "cand") if cand is None else F.col(cand).alias("cand"), none(jd, "jd") if j is None else F.col(j).alias("jd"), none(kind, "src") if src is None else F.col(src).alias("src"),
    ]
    pieces = F.pmod(F.xxhash64("skill", F.lit(1)), F.lit(max(1, wanted // PIECE))).alias("piece")
    w = wants.groupBy("jd", block("skill").alias("block"), pieces).agg(list_of(skill("skill"), "a"), list_of(F.coalesce(F.col("demand").cast("double"), F.lit(float("nan"))), "v"))
    right = w.select("block", *key(0, j="jd"), "a", "v", none("array<int>", "h"))
    sizes = {}
    if ways is not None:
        ways = ways.withColumn("block", block("dst"))
        sizes = {0: total} if blocks == 1 else {r["block"]: r["n"] for r in ways.groupBy("block").agg(F.count("*").alias("n")).collect()}  # a row a block
        x = ways.groupBy("src", "block").agg(list_of(skill("dst"), "a"), list_of("v", "v"), list_of("h", "h"))
        right = right.unionByName(x.select("block", *key(1, src="src"), "a", "v", "h"))
    right = right.withColumn("group", every(groups))
    held = list_of(skill("skill"), "a"), list_of("v", "v")
    # a holding is the start of paths to any block; without paths only its own skill's matters
    left = left.withColumn("group", F.pmod(F.xxhash64("cand"), F.lit(groups)).cast("int"))
    if paths is None:
        left = left.groupBy("group", "cand", block("skill").alias("block")).agg(*held)
    else:
        left = left.groupBy("group", "cand").agg(*held).withColumn("block", every(blocks) if blocks > 1 else F.lit(0))
    left = left.select("block", *key(2, cand="cand"), "a", "v", none("array<int>", "h"), "group")
    cell_of = (F.col("group") * blocks + F.col("block")).cast("int").alias("cell")
    both = right.unionByName(left).select(cell_of, "own", "cand", "jd", "src", "a", "v", "h")
    both = both.repartitionById(groups * blocks, F.col("cell")).sortWithinPartitions("cell", "own")

    def run(batches):
        at, cell, begun, parts = None, None, False, []

        def opened():
            """The cell of what has come so far."""
            nonlocal cell
            if cell is None:
                got = [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 3
                cell = Cell(*got, size=sizes.get(at % blocks, 0))
                cell.whole = blocks == 1
                parts.clear()
            return cell

        def finish():
            if at is not None and last is not None and cell is not None and begun:
                yield from last(cell)

        for batch in batches:
            if not batch.num_rows:
                continue
            step = _column(batch, "cell").astype(np.int64) * 3 + _column(batch, "own")
            starts = np.flatnonzero(np.r_[True, step[1:] != step[:-1]])
            for a, b in zip(starts, np.r_[starts[1:], len(step)]):
                if step[a] // 3 != at:
                    yield from finish()
                    at, cell, begun, parts = step[a] // 3, None, False, []
                part, own = batch.slice(a, b - a), step[a] % 3
                n = _sizes(part, "a")
                if own == 0:
                    parts.append((np.repeat(_column(part, "jd"), n), _flat(part, "a"), _flat(part, "v")))
                    continue
                if own == 1:
                    opened().add(_column(part, "src"), n, _flat(part, "a"), _flat(part, "v"), _flat(part, "h"))
                    continue
                if not begun:
                    opened().ready()
                    begun = True
                cand, skill, v = _column(part, "cand"), _flat(part, "a"), _flat(part, "v")
                ends, i = np.cumsum(n), 0
                while i < len(cand):
                    j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + CHUNK, side="right")))
                    x, y = ends[i] - n[i], ends[j - 1]
                    yield from each(cell.ways(np.repeat(np.arange(j - i), n[i:j]), skill[x:y], v[x:y]), cand[i:j])
                    i = j
        yield from finish()

    arrow = to_arrow_schema(spark.createDataFrame([], schema).schema)

    def out(batches):
        for pdf in run(batches):
            if len(pdf):
                yield pa.RecordBatch.from_pandas(pdf, arrow, preserve_index=False)

    return both.mapInArrow(out, schema), blocks == 1


def reached(have: DataFrame, paths: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """cand, skill, dist, hops, via of every skill (of targets, if given) that a path leads to from one that a candidate has."""

    def each(ways, names):
        some, cell = ~np.isnan(ways.dist), ways.cell
        at = np.flatnonzero(some | (ways.hops < _FAR))
        for a in range(0, len(at), 1 << 16):
            i = at[a : a + (1 << 16)]
            hops = pd.arrays.IntegerArray(ways.hops[i], ways.hops[i] == _FAR)
            via = pd.Series(cell.sources[ways.via[i]]).convert_dtypes().where(some[i])
            yield pd.DataFrame({"cand": names[ways.cand[i]], "skill": cell.skills[ways.skill[i]], "dist": ways.dist[i], "hops": hops, "via": via})

    kinds = dict(have.dtypes)
    ends = (paths.select(F.col("dst").alias("skill")) if targets is None else targets.select("skill")).where("skill IS NOT NULL").distinct()
    wants = ends.select(F.lit(0).alias("jd"), "skill", F.lit(1.0).alias("demand"))
    held = have.select("cand", "skill", F.lit(None).cast("double").alias("weight"))
    return met(wants, held, paths, each, f"cand {kinds['cand']}, skill {kinds['skill']}, dist double, hops int, via {kinds['skill']}")[0]
