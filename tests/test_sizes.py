"""What only larger tables show: limits that were cuts, and steps whose rows grew faster than the tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.functions.scoring import ScoringParams
from loomgraph.operators import dynamic, embedding, evaluation, graph, grid, matching, nearby, paths, topk, workspace
from loomgraph.operators.vectorindex import VectorIndex
from loomgraph.plans import build
from loomgraph.sources import store


def test_counts_are_of_all_words(spark, monkeypatch):
    """Only the learnt embedder stops at the most frequent words; the counts and the mutual information don't."""
    monkeypatch.setattr(embedding, "MOST_WORDS", 2)
    df = spark.createDataFrame([("a b a c",), ("b a",), (None,)], "text string")
    words, pairs = embedding.counted(df, span=2, least=1)
    assert {r["word"] for r in words.collect()} == {"a", "b", "c"} and pairs.where("i = 2 OR j = 2").count() == 4
    assert set(embedding.learn(df, least=1).words) == {"a", "b"}


def test_a_built_graph_has_no_ceiling(spark, tmp_path, monkeypatch):
    """The tariff of a hosted graph bounds migrate() as before, not what is built into a store."""
    rows = [(f"15-{i}", f"role {i}", f"skill {j}") for i in range(3) for j in range(2)]
    taxonomy = spark.createDataFrame(rows, "soc string, title string, skill string")
    skills = taxonomy.select("soc", "skill", F.lit("tool").alias("element"), F.lit("Y").alias("hot"), F.lit("Y").alias("demand"))
    monkeypatch.setattr(store, "check_ceilings", lambda nodes, edges, most_nodes=1, most_edges=1: (_ for _ in ()).throw(ValueError("too many")))
    made = store.Store(spark, f"{tmp_path}/s")
    build.build(made, taxonomy.select("soc", "title").distinct(), skills, custom=False, max_density=None)
    assert {r["kind"]: r["n"] for r in made.counts().collect()}["requires"] == 6
    with pytest.raises(ValueError):
        made.migrate({k: made.read(k) for k in ("skills", "roles", "requires", "similar")}, dry_run=True)


@pytest.mark.parametrize("kind", ["string", "long"])
def test_cells_give_what_terms_give(spark, monkeypatch, kind):
    """Several blocks, groups and chunks, against a row for each term; no stage shuffles more rows than the tables times
    the blocks and groups."""
    monkeypatch.setattr(grid, "BLOCK", 150)
    monkeypatch.setattr(grid, "GROUP", 40)
    monkeypatch.setattr(grid, "CHUNK", 7)
    monkeypatch.setattr(grid, "WIDE", 2)
    rng = np.random.default_rng(3)
    skill = lambda c: f"concat('s', {c})" if kind == "string" else f"cast({c} + (1L << 60) AS bigint)"
    pick = lambda n, *most: spark.createDataFrame([tuple(int(x) for x in row) for row in rng.integers(0, most, (n, len(most)))], ", ".join(f"x{i} long" for i in range(len(most)))).distinct()
    edges = pick(90, 40, 40, 50).where("x0 < x1").dropDuplicates(["x0", "x1"]).selectExpr(f"{skill('x0')} AS lo", f"{skill('x1')} AS hi", "0.45 + x2 / 100 AS weight")
    have = pick(260, 30, 44, 3).selectExpr("x0 AS cand", f"{skill('x1')} AS skill", "0.5 + x2 * 0.5 AS weight")
    wants = pick(70, 5, 48, 3).selectExpr("concat('j', x0) AS jd", f"{skill('x1')} AS skill", "0.5 + x2 * 0.5 AS demand")
    p = ScoringParams(bridge_cutoff=0.9, bridge_credit_scale=2.0, max_bridge_credit=0.9, bridgeable_penalty=0.05, unreachable_penalty=0.1, max_hops=2)
    near = paths.apsp(edges, 1.0, hops_within=3)
    rows = lambda df, *cs: sorted(tuple(round(r[c], 6) if isinstance(r[c], float) else r[c] for c in cs) for r in df.collect())
    t = matching.terms(wants, have, near, p).persist()
    for k in ("floored", "bridged"):
        assert rows(matching.picked(wants, have, near, p, k), "jd", "cand", "skill", "dist", "via", "credit") == rows(t.where(k), "jd", "cand", "skill", "dist", "via", "credit")
    n = matching.bridges(wants, have, near, p).groupBy("skill", "via").agg(F.sum("n").alias("n"))
    assert rows(n, "skill", "via", "n") == rows(t.where("bridged").groupBy("skill", "via").agg(F.count("*").alias("n")), "skill", "via", "n")
    got = matching._sums(wants, have, near, p)
    want = matching._labelled_sums(wants, have, near, p, None).fillna(0).where("n_matched + n_bridged > 0")
    assert rows(got, *sorted(got.columns)) == rows(want, *sorted(got.columns))
    g = matching.gaps(wants, have, near, p).groupBy("jd", F.regexp_extract("reason", "^[a-z_]+", 0).alias("reason")).agg(F.count("*").alias("n"))
    assert rows(matching.gap_counts(wants, have, near, p), "jd", "reason", "n") == rows(g, "jd", "reason", "n")
    few = list(enumerate([ScoringParams(bridge_cutoff=0.5, max_hops=1), p]))
    base = ScoringParams(bridge_cutoff=None)
    swept, labelled = matching._swept(wants, have, near, base, few), matching._labelled_sweep(matching.terms(wants, have, near, base), base, few)
    assert rows(swept, *sorted(swept.columns)) == rows(labelled, *sorted(swept.columns))


def test_tfidf_of_all_pairs(spark, monkeypatch):
    """Cells against a row for each query, candidate and skill; what nobody holds, and candidates without a wanted skill."""
    monkeypatch.setattr(grid, "BLOCK", 5)
    monkeypatch.setattr(grid, "CHUNK", 3)
    have = spark.createDataFrame([(i, f"s{(i * k) % 13}") for i in range(1, 12) for k in (1, 3, 5)] + [(99, "alone")], "cand long, skill string")
    wants = spark.createDataFrame([(q, f"s{k}") for q, ks in (("a", (1, 2, 3, 40)), ("b", (5, 7, 1))) for k in ks], "query string, skill string")
    graded = have.select("cand").distinct().crossJoin(wants.select("query").distinct())
    rows = lambda df: sorted((r["query"], r["cand"], round(r["score"], 9)) for r in df.collect())
    assert rows(evaluation.tfidf_of_all(wants, have)) == rows(evaluation.tfidf(wants, have, graded))


def test_category_pairs_are_not_compared(spark):
    """Nodes of several categories meet once; pairs of others aren't shuffled to find that out."""
    rows = [(f"n{i:02d}", f"c{i % 3}") for i in range(20)] + [("n01", "c2"), ("n02", "c1"), ("n04", "c2"), ("n07", None)]
    nodes = spark.createDataFrame(rows, "name string, category string")
    by = {c: {n for n, d in rows if d == c} for c in ("c0", "c1", "c2")}
    want = {(a, b) for s in by.values() for a in s for b in s if a < b}
    got = graph.category_edges(nodes)[0].select("lo", "hi")
    assert len(found := [tuple(r) for r in got.collect()]) == len(set(found)) and set(found) == want
    vectors = nodes.dropDuplicates(["name"]).select("name", F.array(F.hash("name") / 2e9, F.lit(1.0)).alias("embedding"))
    both = graph.typed_candidates(nodes.join(vectors, "name").withColumnRenamed("name", "id"))
    assert len(found := [tuple(r) for r in both.collect()]) == len(set(found)) and want <= set(found)


def test_reach_over_labels_makes_no_row_for_a_way(spark, monkeypatch):
    """Ways are reduced in cells, over labels and over paths: nothing is shuffled by candidate and skill. No candidate is a
    group too, and a skill that is only few hops away has no via."""
    monkeypatch.setattr(grid, "BLOCK", 40)
    monkeypatch.setattr(grid, "CHUNK", 5)
    edges = spark.createDataFrame([(i, (i * 7 + 3) % 30, 0.5 + (i % 4) / 10) for i in range(30)] + [(28, 40, 0.05)], "a long, b long, weight double")
    edges = edges.where("a <> b").selectExpr("least(a, b) AS lo", "greatest(a, b) AS hi", "weight").dropDuplicates(["lo", "hi"])
    have = spark.createDataFrame(list({(c if c else None, (c * 5 + k * k) % 33) for c in range(9) for k in range(4)} | {(8, 28)}), "cand long, skill long")
    targets = spark.createDataFrame([(s,) for s in range(0, 42, 2)], "skill long")
    near = paths.apsp(edges, 0.8, 2)
    plain = lambda t: paths._steps(have, near, t).groupBy("cand", "skill").agg(F.min("dist").alias("dist"), F.min("hops").alias("hops"), paths._via())
    rows = lambda df: sorted(repr((r["cand"], r["skill"], r["dist"] and round(r["dist"], 6), r["hops"], r["via"])) for r in df.collect())
    labels = paths.HubLabels(edges, 0.8, 2)
    for t, way in ((targets, labels), (None, near)):
        want = rows(plain(t))
        assert "(8, 40, None, 1, None)" in want and any(x.startswith("(None") for x in want)
        assert rows(paths.reach(have, way, t)) == want
    plan = paths.reach(have.where("cand IS NOT NULL"), labels, targets)._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate(keys=[cand" not in plan and "MapInArrow" in plan


def test_threshold_ranking_has_few_rounds(spark, monkeypatch):
    """Where the bound tells nobody apart all are scored, in three rounds and not in one for each doubling."""
    calls = []
    monkeypatch.setattr(topk, "scores", lambda *a, **k: calls.append(1) or matching.scores(*a, **k))
    edges = spark.createDataFrame([(0, 1, 0.9)], "lo long, hi long, weight double")
    have = spark.createDataFrame([(c, 5, 1.0) for c in range(60)], "cand long, skill long, weight double")
    wants = spark.createDataFrame([("a", 0, 1.0)], "jd string, skill long, demand double")
    p = ScoringParams(bridge_cutoff=0.6, bridge_credit_scale=1.0, max_bridge_credit=0.4, bridgeable_penalty=0.05, unreachable_penalty=0.1, max_hops=2)
    got, scored = topk.rank_top(wants, have, paths.apsp(edges, 0.9, 2), edges, p, 2, begin=1)
    assert [r["cand"] for r in got.orderBy("rank").collect()] == [0, 1] and scored == 60 and len(calls) == 3
    none, scored = topk.rank_top(wants, have.limit(0), paths.apsp(edges, 0.9, 2), edges, p, 2)
    assert none.count() == scored == 0


@pytest.mark.parametrize("kind", ["string", "long"])
@pytest.mark.parametrize("k", [1, 3, None])
def test_slabs_keep_ties_in_order(monkeypatch, kind, k):
    """Copies tie exactly, whatever they are multiplied with, and go by id; equal ids never meet; of many copies few are compared."""
    monkeypatch.setattr(nearby, "TILE", 7)
    rng = np.random.default_rng(1)
    x = np.concatenate([np.repeat(rng.normal(size=(4, 5)), 30, axis=0), rng.normal(size=(40, 5)), np.zeros((2, 5)), np.full((1, 5), np.nan)])
    ids = rng.permutation(len(x))
    ids[3] = ids[2]  # one id twice
    ids = np.array([f"n{i:03d}" for i in ids], object) if kind == "string" else ids
    u = nearby.unit(x)
    slab = nearby.Slab(ids, x, k)
    got = sorted((ids[i], d, round(s, 12)) for a, b, c in slab.best(ids, u, 0.2, None, False) for i, d, s in zip(a, b, c))
    want = []
    for i in range(len(x)):
        sims = sorted((-round(float(np.einsum("i,i->", u[i], u[j])), 12), ids[j]) for j in range(len(x)) if ids[j] != ids[i])
        want += [(ids[i], d, -s) for s, d in [t for t in sims if -t[0] >= 0.2][:k]]
    assert got == sorted(want)
    assert k is None or len(slab.ids) <= 4 * (k + 2) + 44


def test_nearest_gives_few_rows(spark):
    """At most k rows a node and slab, where a row for each pair of small blocks had been more than the nodes times those."""
    rng = np.random.default_rng(2)
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(3000, 4)))], "id long, embedding array<double>")
    before = graph.nearest(nodes, 5, 0.3)._jdf.queryExecution()
    near = nearby.nearest(nodes, nodes, 5, 0.3)
    assert near.count() <= 3000 * 5 and near.join(graph.nearest(nodes, 5, 0.3).select("src", "dst"), ["src", "dst"]).count() == near.count()
    assert "CartesianProduct" not in before.executedPlan().toString() and "NestedLoop" not in before.executedPlan().toString()
    with pytest.raises(Exception, match="differ in length"):
        nearby.nearest(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0, 3.0])], nodes.schema), nodes, 1, 0.0).collect()


def test_exact_search_sends_queries_to_slabs(spark, tmp_path, monkeypatch):
    """Where every cell may hold something near, a query isn't sent to each: one row for each slab, also of a cell in parts."""
    from loomgraph.operators import vectorindex

    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(300, 24)), np.repeat(rng.normal(size=(2, 24)), 60, axis=0)])
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    index = VectorIndex.build(vectors, f"{tmp_path}/i", cells=20)
    monkeypatch.setattr(vectorindex, "SLAB", 50)
    dealt, deal = [], VectorIndex._deal
    monkeypatch.setattr(VectorIndex, "_deal", lambda self, *a: dealt.append(deal(self, *a)) or dealt[-1])
    got = index.near(vectors, 5, 0.1, probes=2, exact=True).collect()
    assert sum(d.count() for d in dealt) == 2 * len(x)
    u = nearby.unit(x)
    sim = np.round(np.einsum("id,jd->ij", u, u), 9)
    want = {(i, j) for i in range(len(x)) for s, j in sorted((-sim[i, j], j) for j in range(len(x)) if j != i and sim[i, j] >= 0.1)[:5]}
    assert len(got) == len(want) and {(r["src"], r["dst"]) for r in got} == want


def test_a_lost_step_meets_only_what_it_is_on_the_way_of(spark, monkeypatch):
    """A step longer than the way around it is met with no pair, however many end and begin at it."""
    made = []
    monkeypatch.setattr(dynamic, "checkpointed", lambda df: made.append(paths.checkpointed(df)) or made[-1])
    edges = spark.createDataFrame([(0, i, 0.9) for i in range(1, 12)] + [(1, 2, 0.4)], "lo long, hi long, weight double")
    near = paths.checkpointed(paths.apsp(edges, 1.2, 2))
    lost = paths.symmetric(edges.where("lo = 1")).withColumn("one", F.lit(1.0))
    assert dynamic._through(near, lost, "dist", "distance", 1.2).count() == 0 and [df.count() for df in made] == [0]
    assert {tuple(r) for r in dynamic._through(near, lost, "hops", "one", 2).collect()} == {(1, 2), (2, 1)}


def test_tasks_grow_in_number_with_the_rows(spark, monkeypatch):
    """Partitions that a setting fixes would grow with the tables; small tables stay as they are."""
    df = spark.range(1000).selectExpr("id", "id % 7 AS k")
    assert "RepartitionByExpression" not in workspace.spread(df, 1000, "id")._jdf.queryExecution().logical().toString()
    monkeypatch.setattr(workspace, "SPREAD", 100)
    got = workspace.spread(df, 1000, "id")
    assert got.rdd.getNumPartitions() == 10 and got.count() == 1000
