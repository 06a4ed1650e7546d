"""Hub labels, paths kept up to date, the threshold ranking and the vector index, against the plain ways."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.functions.scoring import ScoringParams
from loomgraph.operators import dynamic, graph, hublabels, linking, matching, paths, topk
from loomgraph.operators.vectorindex import VectorIndex

WEIGHTS = [0.9, 0.8, 0.75, 0.5, 0.5, 0.25]


def graph_of(rng, n, m):
    """Random edges with few different weights, so that many paths tie."""
    return {tuple(sorted(rng.sample(range(n), 2))): rng.choice(WEIGHTS) for _ in range(m)}


def frame(spark, edges):
    return spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "lo long, hi long, weight double")


def rows(df):
    return {(r["src"], r["dst"]): (None if r["dist"] is None else round(r["dist"], 6), r["hops"]) for r in df.collect()}


def lengths(n, edges, unit=False):
    d = np.full((n, n), np.inf)
    for (a, b), w in edges.items():
        d[a, b] = d[b, a] = 1.0 if unit else round(1 - w, 9)
    np.fill_diagonal(d, 0)
    for k in range(n):
        d = np.minimum(d, np.round(d[:, k : k + 1] + d[k : k + 1], 9))
    return d


def canonical(n, edges, unit):
    """How many labels the order of degrees needs: a hub counts if no earlier node is on a shortest path."""
    d = lengths(n, edges, unit)
    degree = {v: sum(v in e for e in edges) for v in range(n)}
    order = sorted((v for v in range(n) if degree[v]), key=lambda v: (-degree[v], v))
    place = {v: i for i, v in enumerate(order)}
    return sum(
        np.isfinite(d[v, h]) and not any(place[o] < place[h] and round(d[v, o] + d[o, h], 9) <= d[v, h] for o in order) for v in order for h in order
    )


@pytest.mark.parametrize("seed", [1, 2])
def test_labels_give_the_paths(spark, seed):
    rng = random.Random(seed)
    n, edges = 24, graph_of(rng, 24, 34)
    e = frame(spark, edges)
    cutoff, hops = (None, None) if seed == 1 else (0.8, 2)
    got = hublabels.HubLabels(e, cutoff, hops, first=3)
    ap = paths.apsp(e, cutoff, hops)
    pairs = spark.createDataFrame([(a, b) for a in range(n) for b in range(n) if a != b], "src long, dst long")
    assert rows(got.between(pairs).where("dist IS NOT NULL OR hops IS NOT NULL")) == rows(ap)
    if seed == 1:
        assert got.dist.count() == canonical(n, edges, False) < ap.count()
        assert got.hops.count() == canonical(n, edges, True)
    # candidates' own skills are reached from their others, and ties go to the smallest source
    have = spark.createDataFrame([(c, s, 1.0) for c in range(8) for s in rng.sample(range(n), 4)], "cand long, skill long, weight double")
    targets = spark.createDataFrame([(s,) for s in range(0, n, 2)], "skill long")
    for way in (paths.reach, paths.held_or_reached):
        key = lambda df: sorted((r["cand"], r["skill"], None if r["dist"] is None else round(r["dist"], 6), r["hops"], r["via"]) for r in df.collect())
        assert key(way(have, got, targets)) == key(way(have, ap.withColumn("dist", F.round("dist", 9)), targets))


def test_labels_of_small_graphs(spark):
    none = hublabels.HubLabels(frame(spark, {(0, 1): 0.5}).limit(0))
    assert none.dist.count() == none.hops.count() == 0
    one = hublabels.HubLabels(frame(spark, {(0, 1): 0.5}))
    assert sorted((r["node"], r["hub"], r["d"]) for r in one.dist.collect()) == [(0, 0, 0.0), (1, 0, 0.5), (1, 1, 0.0)]


@pytest.mark.parametrize("cutoff,hops", [(None, None), (0.9, 3)])
def test_updated_paths_equal_new_ones(spark, cutoff, hops):
    rng = random.Random(7)
    edges = graph_of(rng, 14, 18)
    now = frame(spark, edges)
    table = paths.apsp(now, cutoff, hops)
    for _ in range(2):
        gone = rng.sample(sorted(edges), 3)
        put = graph_of(rng, 14, 2) | {rng.choice(sorted(edges)): rng.choice(WEIGHTS)}
        after = dynamic.edited(now, frame(spark, put), spark.createDataFrame(gone, "lo long, hi long")).persist()
        edges = {k: w for k, w in edges.items() if k not in gone} | put
        assert {(r["lo"], r["hi"]): r["weight"] for r in after.collect()} == edges
        table = dynamic.updated(table, now, after, cutoff, hops)
        assert rows(table) == rows(paths.apsp(after, cutoff, hops))
        now = after


@pytest.mark.parametrize("bridging", [True, False])
def test_threshold_ranking(spark, bridging):
    rng = random.Random(3)
    edges = frame(spark, graph_of(rng, 30, 45))
    p = ScoringParams(enable_bridging=bridging, bridge_cutoff=0.6, bridge_credit_scale=1.0, max_bridge_credit=0.4, bridgeable_penalty=0.05, unreachable_penalty=0.1, max_hops=2)
    have = spark.createDataFrame([(f"c{c:03d}", s, rng.choice([0.5, 1.0, 1.5])) for c in range(200) for s in rng.sample(range(30), rng.choice([1, 2, 3, 8]))], "cand string, skill long, weight double")
    cands = have.select("cand").distinct().unionByName(spark.createDataFrame([("none",), ("zero",)], "cand string"))
    wants = spark.createDataFrame([(j, s, rng.choice([0.5, 1.0, 1.5])) for j in ("a", "b", "c") for s in rng.sample(range(30), 5)] + [("nil", 1, 0.0)], "jd string, skill long, demand double")
    ap = paths.apsp(edges, 0.9, 2)
    got, scored = topk.rank_top(wants, have, ap, edges, p, 5, cands)
    key = lambda df: sorted((r["jd"], r["rank"], r["cand"], r["total"], r["n_bridged"]) for r in df.collect())
    full = matching.scores(wants, have, ap, p, cands)
    assert key(got) == key(matching.rank(full, 5))
    assert scored < full.where("jd <> 'nil'").count() / 2 + full.where("jd = 'nil'").count()


def clustered(seed, n, dims=16, groups=12):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(groups, dims))
    x = centers[rng.integers(0, groups, n)] + 0.35 * rng.normal(size=(n, dims))
    x[: n // 3] = x[0]  # copies of one vector
    return x


def test_index_recall_and_exactness(spark, tmp_path, monkeypatch):
    from loomgraph.operators import vectorindex

    monkeypatch.setattr(vectorindex, "PART", 50)
    monkeypatch.setattr(vectorindex, "QUERIES", 40)
    x = clustered(5, 600)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (None, x[0].tolist())], "id long, embedding array<double>")
    index = VectorIndex.build(df, str(tmp_path / "index"), cells=24)
    assert index.sizes.sum() == 600
    again = VectorIndex(spark, index.path)
    want = {(r["src"], r["dst"]) for r in graph.nearest(df.where("id IS NOT NULL AND embedding IS NOT NULL"), 5, 0.3).collect() if r["src"] >= 200}
    few = {(r["src"], r["dst"]) for r in again.near(df, 5, 0.3, probes=6).collect() if r["src"] >= 200}
    assert len(want & few) / len(want) >= 0.95
    exact = again.near(df, 5, 0.3, probes=1, exact=True)
    sims = lambda d: sorted((r["src"], round(r["sim"], 6)) for r in d.collect())
    assert sims(exact) == sims(graph.nearest(df.where("id IS NOT NULL AND embedding IS NOT NULL"), 5, 0.3))
    some = df.where("id % 40 = 7")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = sorted((i, j) for i in range(7, 600, 40) for j in range(600) if i != j and round(float(u[i] @ u[j]), 9) >= 0.8)
    assert sorted((r["src"], r["dst"]) for r in again.near(some, None, 0.8).collect()) == want


def test_index_of_nothing(spark, tmp_path):
    df = spark.createDataFrame([], "id long, embedding array<double>")
    index = VectorIndex.build(df, str(tmp_path / "none"))
    assert index.near(spark.createDataFrame([(1, [1.0, 0.0])], "id long, embedding array<double>"), 3).count() == 0


def test_edges_and_links_through_the_index(spark, tmp_path):
    x = clustered(9, 120)[40:]
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    index = VectorIndex.build(nodes, str(tmp_path / "nodes"), cells=6)
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(graph.semantic_edges(nodes, 3, 0.4, 0.85, max_density=None, index=index, exact=True)) == key(graph.semantic_edges(nodes, 3, 0.4, 0.85, max_density=None))
    named = spark.createDataFrame([(n, n) for n in ("Docker", "Kubernetes", "Amazon Web Services", "PostgreSQL", "Python", "Terraform")], "name string, text string")
    phrases = spark.createDataFrame([(s, 1.0) for s in ("Dockers", "kubernetes cluster", "Pythons", "cooking", "", "Terra form")], "surface string, weight double")
    vectors = linking.node_index(named, str(tmp_path / "named"))
    for exact in (True, False):
        got = linking.link(phrases, named, min_score=0.6, vectors=vectors, exact=exact)
        assert key(got.select("surface", "node", F.round("score", 6), "method")) == key(linking.link(phrases, named, min_score=0.6).select("surface", "node", F.round("score", 6), "method"))
