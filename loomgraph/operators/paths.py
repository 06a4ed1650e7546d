"""Shortest paths over an undirected similarity graph, as relaxations over DataFrames.

edges: lo, hi, weight; one row for each pair. The distance of an edge is 1 - weight. Hops come from a search of their
own with unit weights, so they are not the length of the shortest path by distance.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import grid
from .hublabels import HubLabels
from .workspace import checkpoint_folder, checkpointed, dropped  # noqa: F401 (callers take them from here)


def symmetric(edges: DataFrame) -> DataFrame:
    """a, b, distance in both directions."""
    d = (F.lit(1.0) - F.col("weight")).alias("distance")
    return edges.select(F.col("lo").alias("a"), F.col("hi").alias("b"), d).union(edges.select(F.col("hi").alias("a"), F.col("lo").alias("b"), d))


def apsp(edges: DataFrame, search_cutoff: float | None = None, hops_within: int | None = None, sources: DataFrame | None = None) -> DataFrame:
    """src, dst, dist, hops for every reachable pair of different nodes; sources (src): from these only.

    Paths grow outwards from the source by one edge a round, so that distances add up in path order; a round extends
    only the pairs that the one before made nearer, and the search ends when there are none. search_cutoff bounds dist
    (null where it is larger), hops_within bounds hops (null where there are more); a pair that neither has isn't kept.
    """
    sym = checkpointed(symmetric(edges))
    first = sym if sources is None else sym.join(sources.select(F.col("src").alias("a")).distinct(), "a", "left_semi")
    return relaxed(None, first.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("distance").alias("dist"), F.lit(1).alias("hops")), sym, search_cutoff, hops_within)


def relaxed(known: DataFrame | None, offers: DataFrame, sym: DataFrame, search_cutoff: float | None, hops_within: int | None) -> DataFrame:
    """known and offers (src, dst, dist, hops), grown along the steps of sym (a, b, distance) from what offers made nearer."""
    bounded = lambda c: c if search_cutoff is None else F.when(c <= search_cutoff, c)
    within = lambda h: h if hops_within is None else F.when(h <= hops_within, h)
    kept = "dist IS NOT NULL OR hops IS NOT NULL"

    def better(old: DataFrame | None, new: DataFrame) -> DataFrame:
        new = new.select("src", "dst", bounded(F.col("dist")).alias("dist"), within(F.col("hops")).alias("hops")).where(kept)
        none = {"dist0": F.lit(None).cast("double"), "hops0": F.lit(None).cast("int")}
        both = new.withColumns(none) if old is None else old.select("src", "dst", "dist", "hops", F.col("dist").alias("dist0"), F.col("hops").alias("hops0")).unionByName(new.withColumns(none))
        both = both.groupBy("src", "dst").agg(*[F.min(c).alias(c) for c in ("dist", "hops", "dist0", "hops0")])
        moved = ~(F.col("dist").eqNullSafe(F.col("dist0")) & F.col("hops").eqNullSafe(F.col("hops0")))
        return checkpointed(both.select("src", "dst", "dist", "hops", moved.alias("moved")))

    best = better(known, offers)
    while not best.where("moved").isEmpty():
        x = best.where("moved").join(sym, F.col("dst") == F.col("a")).where("src <> b")
        before, best = best, better(best, x.select("src", F.col("b").alias("dst"), (F.col("dist") + F.col("distance")).alias("dist"), (F.col("hops") + 1).alias("hops")))
        del x
        dropped(before)  # a round's table replaces the one before
    return best.drop("moved")


def toward(edges: DataFrame, targets: DataFrame, search_cutoff: float | None = None, hops_within: int | None = None) -> DataFrame:
    """The rows of apsp() whose dst is among targets (skill), grown backwards from these, as paths have no direction.

    Work and rows are in proportion to the targets; sums are made from the target's end, so the last bit may differ.
    """
    back = apsp(edges, search_cutoff, hops_within, targets.select(F.col("skill").alias("src")))
    return back.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "dist", "hops")


def within(edges: DataFrame, sources: DataFrame, max_hops: int = 2, max_distance: float | None = None) -> DataFrame:
    """src, dst, dist, hops of the cheapest path of 1 to max_hops edges (3 at most) from each source (column src).

    Of paths with as many edges only the cheapest to each node goes on, so a round has as many rows as pairs.
    """
    if max_hops < 1:
        raise ValueError("max_hops must be 1 or more")
    sym = symmetric(edges)
    level = sources.select("src").join(sym, F.col("src") == F.col("a")).groupBy("src", F.col("b").alias("dst")).agg(F.min("distance").alias("dist"))
    out = level.withColumn("hops", F.lit(1))
    for h in range(2, min(max_hops, 3) + 1):
        level = level.join(sym, level["dst"] == sym["a"]).groupBy("src", F.col("b").alias("dst")).agg(F.min(F.col("dist") + F.col("distance")).alias("dist"))
        out = out.union(level.withColumn("hops", F.lit(h)))
    if max_distance is not None:
        out = out.where(F.col("dist") <= max_distance)
    return out.groupBy("src", "dst").agg(F.min(F.struct("dist", "hops")).alias("x")).select("src", "dst", "x.dist", "x.hops")


def _steps(have: DataFrame, paths: DataFrame | HubLabels, targets: DataFrame | None) -> DataFrame:
    """cand, skill, weight (null), dist, hops, src: a row for each path from a skill that a candidate has."""
    if isinstance(paths, HubLabels):
        paths = paths.toward(targets)
    elif targets is not None:
        paths = paths.join(targets.select(F.col("skill").alias("dst")).distinct(), "dst", "left_semi")
    x = have.select("cand", F.col("skill").alias("src")).join(paths, "src")
    return x.select("cand", F.col("dst").alias("skill"), F.lit(None).cast("double").alias("weight"), "dist", "hops", "src")


def _via():
    return F.min(F.when(F.col("dist").isNotNull(), F.struct("dist", "src")))["src"].alias("via")


def reach(have: DataFrame, paths: DataFrame | HubLabels, targets: DataFrame | None = None) -> DataFrame:
    """cand, skill, dist, hops, via: of every skill reachable from another skill that a candidate has.

    have: cand, skill. paths: apsp() or HubLabels. targets: skill; only these are of interest, and restrict paths before the join.
    A candidate's own skills are reached from its other skills (what the held floor needs). The ways to a skill are made
    and reduced in cells (grid), so rows are those of the result.
    """
    if isinstance(paths, HubLabels):
        paths, targets = checkpointed(paths.toward(targets)), None
    out = grid.reached(have, paths, targets)
    nobody = have.where("cand IS NULL")  # a group like any other in an aggregate, but no candidate of a cell
    if nobody.isEmpty():
        return out
    rest = _steps(nobody, paths, targets).groupBy("cand", "skill").agg(F.min("dist").alias("dist"), F.min("hops").alias("hops"), _via())
    return out.unionByName(rest)


def held_or_reached(have: DataFrame, paths: DataFrame | HubLabels, targets: DataFrame) -> DataFrame:
    """reach() with weight, the candidate's own for a skill that it has: held and reached skills in one aggregate."""
    own = have.join(targets.select("skill").distinct(), "skill", "left_semi")
    own = own.select("cand", "skill", F.col("weight").cast("double").alias("weight"), F.lit(None).cast("double").alias("dist"), F.lit(None).cast("int").alias("hops"), F.lit(None).cast(dict(have.dtypes)["skill"]).alias("src"))
    both = own.union(_steps(have, paths, targets))
    return both.groupBy("cand", "skill").agg(F.max("weight").alias("weight"), F.min("dist").alias("dist"), F.min("hops").alias("hops"), _via())
