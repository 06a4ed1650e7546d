"""Cells of one block and of several give the same, and give what belongs to a cell once."""

import os

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.functions.scoring import ScoringParams
from loomgraph.operators import grid, matching, paths, workspace

P = ScoringParams(bridge_cutoff=0.9, bridge_credit_scale=2.0, max_bridge_credit=0.9, bridgeable_penalty=0.05, unreachable_penalty=0.1, max_hops=2)


@pytest.fixture(scope="module")
def made(spark):
    rng = np.random.default_rng(5)
    edges = spark.createDataFrame([(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, 40, 90), rng.integers(0, 40, 90), rng.integers(45, 95, 90) / 100)], "lo long, hi long, weight double")
    edges = edges.where("lo < hi").dropDuplicates(["lo", "hi"])
    have = spark.createDataFrame([(int(c), int(s), float(w) / 2) for c, s, w in zip(rng.integers(0, 30, 260), rng.integers(0, 44, 260), rng.integers(1, 4, 260))], "cand long, skill long, weight double")
    have = have.unionByName(spark.createDataFrame([(77, None, 1.0), (None, 3, 1.0)], have.schema)).dropDuplicates(["cand", "skill"])
    wants = spark.createDataFrame([(f"j{j}", int(s), float(d) / 2) for j, s, d in zip(rng.integers(0, 5, 70), rng.integers(0, 48, 70), rng.integers(1, 4, 70))], "jd string, skill long, demand double").dropDuplicates(["jd", "skill"])
    return wants.persist(), have.persist(), paths.apsp(edges, 1.0, hops_within=3)


def rows(df, *cs):
    return sorted(repr(tuple(round(r[c], 6) if isinstance(r[c], float) else r[c] for c in cs)) for r in df.collect())


def test_scores_of_one_block_need_no_pairs(spark, made, monkeypatch):
    """Every pair is there, with candidates that have no skill, and nothing is joined or shuffled by pair to get them."""
    wants, have, near = made
    x = matching.scores(wants, have, near, P)
    plan = x._jdf.queryExecution().executedPlan().toString()
    assert "jd#" not in "".join(line for line in plan.splitlines() if "hashpartitioning(jd" in line and "cand" in line) and "SortMergeJoin [jd" not in plan
    few = {(r["jd"], r["cand"]) for r in x.collect()}
    assert len(few) == x.count() == have.select("cand").distinct().count() * wants.select("jd").distinct().count()
    one = rows(x, *x.columns)
    monkeypatch.setattr(grid, "BLOCK", 60)
    assert rows(matching.scores(wants, have, near, P), *x.columns) == one
    assert rows(matching.scores(wants, have, near, P, candidates=have.select("cand").distinct()), *x.columns) == one


@pytest.mark.parametrize("block, sparse", [(10**6, 16), (60, 16), (10**6, 0)])
def test_nearest_gaps_have_their_place(spark, made, monkeypatch, block, sparse):
    wants, have, near = made
    own = have.where("cand IS NOT NULL AND skill IS NOT NULL")
    monkeypatch.setattr(grid, "BLOCK", block)
    place = F.row_number().over(W.partitionBy("jd", "cand").orderBy("dist", "skill")).cast("long")
    want = matching.terms(wants, own, near, P).where("bridged").withColumn("place", place).where("place <= 3")
    cs = ("jd", "cand", "skill", "dist", "via", "place")
    assert rows(matching.picked(wants, own, near, P, "bridged", 3), *cs) == rows(want, *cs)


def test_sums_of_few_wants(spark, made):
    """A table of skills and descriptions isn't made where hardly any place is filled."""
    wants, have, near = made
    ends = [(float(x["skill"]), x["jd"]) for x in wants.collect()]
    jd, skill = np.array([j for _, j in ends], object), np.array([int(s) for s, _ in ends])
    cells = [grid.Cell(jd, skill, np.ones(len(jd)), 0).ready() for _ in range(2)]
    cells[1].dense = lambda: False
    got = []
    for cell in cells:
        ways = cell.ways(np.repeat(np.arange(3), 20), np.r_[np.arange(20), np.arange(10, 30), np.arange(60, 80)], np.linspace(0.1, 2, 60))
        for every in (False, True):
            x = next(iter(ways.sums(np.array([5, 6, 7]), {"a": ways.weight}, {"n": ways.matched}, every)))
            got.append(sorted((r.jd, r.cand, round(r.a, 9), r.n) for r in x.itertuples()))
    assert got[0] == got[2] and got[1] == got[3] and len(got[1]) == 3 * len(set(jd)) > len(got[0])


def test_counts_are_given_once_a_cell(spark, made):
    """Reasons and bridges are counted where they are made: a row for each skill and reason, or path, of a cell."""
    wants, have, near = made
    groups = 2 * spark.sparkContext.defaultParallelism
    n = matching._reasons(matching._demand(wants, P), matching._have(have), near, P).count()
    assert n <= groups * 5 * wants.select("skill").distinct().count()
    b = matching.bridges(wants, have, near, P)
    own = have.where("cand IS NOT NULL AND skill IS NOT NULL")
    assert b.count() == b.groupBy(F.col("skill"), "via", F.col("n")).count().agg(F.sum("count")).first()[0] <= groups * near.count()
    want = matching.terms(wants, own, near, P).where("bridged").groupBy("skill", "via").agg(F.count("*").alias("n"))
    assert rows(b.groupBy("skill", "via").agg(F.sum("n").alias("n")), "skill", "via", "n") == rows(want, "skill", "via", "n")


def test_a_round_of_paths_replaces_the_one_before(spark):
    """Of the rounds' tables only the last is left on disk."""
    edges = spark.createDataFrame([(i, i + 1, 0.9) for i in range(8)], "lo long, hi long, weight double")
    n = len(workspace._OWN)
    got = paths.apsp(edges)
    assert got.count() == 72
    left = [p for _, p in workspace._OWN[n:]]
    assert len(left) == 2 and len([p for p in left if os.path.exists(p.removeprefix("file:"))]) == 2  # steps, and paths
