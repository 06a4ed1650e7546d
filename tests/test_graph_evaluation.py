import hashlib

import pytest
from pyspark.sql import functions as F

from loomgraph.functions.scoring import ScoringParams
from loomgraph.operators import evaluation, graph, matching


@pytest.fixture(scope="module")
def data(spark):
    jds = evaluation.Generator().jds()
    assert evaluation.dataset_hash(jds) == "21677c440a88343f" and sum(len(j["candidates"]) for j in jds) == 540
    return [df.persist() for df in evaluation.dataset(spark, jds)]


def metrics(scored):
    r = evaluation.ranked(scored)
    w = evaluation.pairwise(scored, 2, 1).agg(F.sum("wins2") / F.sum("pairs2")).first()[0]
    return w, evaluation.ndcg(scored).agg(F.avg("ndcg")).first()[0], evaluation.precision_at(r, 5).agg(F.avg("p_at_k")).first()[0], evaluation.mrr(r).agg(F.avg("mrr")).first()[0]


def graded(g, s):
    return g.where("split = 'heldout'").select(F.col("jd").alias("query"), "cand", "grade", "pos").join(s, ["query", "cand"])


def test_published_no_bridging(spark, data):
    wants, g, have = data
    none = spark.createDataFrame([], "src string, dst string, dist double, hops int")
    s = matching.scores(wants, have, none, ScoringParams(enable_bridging=False)).select(F.col("jd").alias("query"), "cand", F.col("total").alias("score"))
    # ties rank by name there
    x = graded(g, s)
    got = metrics(x.drop("pos").withColumn("pos", F.dense_rank().over(evaluation.W.partitionBy("query").orderBy("cand"))))
    assert got == pytest.approx((0.000, 0.819, 0.373, 1.000), abs=5e-4)


def test_published_tfidf(spark, data):
    wants, g, have = data
    s = evaluation.tfidf(wants.select(F.col("jd").alias("query"), "skill"), have, g.select(F.col("jd").alias("query"), "cand"))
    assert metrics(graded(g, s)) == pytest.approx((0.002, 0.819, 0.373, 1.000), abs=5e-4)


@pytest.mark.parametrize("k, want", [(0.9, 0.017), (1.0, 0.208), (1.2, 0.522), (1.5, 0.916), (1.5238, 0.981)])
def test_published_count_only(spark, data, k, want):
    wants, g, have = data
    s = matching.count_only(wants, have, k).select(F.col("jd").alias("query"), "cand", F.col("total").alias("score"))
    x = graded(g, s)
    assert evaluation.pairwise(x, 2, 1).agg(F.sum("wins2") / F.sum("pairs2")).first()[0] == pytest.approx(want, abs=5e-4)


def test_graph_build(spark):
    occ = spark.createDataFrame([("15-1", "Dev"), ("15-2", "All Other"), ("17-1", "Eng")], "soc string, title string")
    rows = [("15-1", "Git", "VCS", "Y", "N"), ("15-1", "Git", "Aaa", "N", "Y"), ("15-1", "Microsoft Word", "x", "Y", "Y"), ("15-1", "Web server software", "x", "Y", "Y"), ("15-1", "Rare", "x", "N", "N"), ("17-1", "CAD", "x", "Y", "Y")]
    nodes, roles, requires = graph.skill_graph(occ, spark.createDataFrame(rows, "soc string, skill string, element string, hot string, demand string"))
    got = {r["name"]: r for r in nodes.collect()}
    assert got["Git"]["category"] == "Aaa" and got["Git"]["category_n"] == 2 and "PyTorch" in got and len(got) == 16
    assert roles.count() == 2 and [tuple(r) for r in requires.collect()] == [("Dev", "Git")]


def test_neighbours_in_blocks_equal_one_block(spark):
    import numpy as np

    x = np.random.default_rng(1).normal(size=(60, 8))
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    a = {tuple(r)[:2] for r in graph.nearest(nodes, 5, 0.1).collect()}
    assert a == {tuple(r)[:2] for r in graph.nearest(nodes, 5, 0.1, block=16).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = u @ u.T - 3 * np.eye(60)
    assert a == {(i, int(j)) for i in range(60) for j in np.argsort(-sim[i])[:5] if sim[i, j] >= 0.1}
    with pytest.raises(graph.DensityError):
        graph.semantic_edges(nodes, max_density=0.01)


def test_seeds_fill_holes(spark):
    nodes = spark.createDataFrame([("A",), ("B",), ("C",)], "name string")
    edges = spark.createDataFrame([("A", "B", 0.5, "embedding")], graph.EDGE_SCHEMA)
    seeds = spark.createDataFrame([("B", "A", 0.9), ("C", "A", 0.8), ("A", "Z", 0.7)], "a string, b string, weight double")
    assert {(r["lo"], r["hi"]): r["status"] for r in graph.seed_overlay(edges, seeds, nodes).collect()} == {("A", "B"): "already", ("A", "C"): "added", ("A", "Z"): "absent"}
    got = graph.with_seeds(edges, seeds, nodes)
    assert {(r["lo"], r["hi"], r["weight"]) for r in got.collect()} == {("A", "B", 0.5), ("A", "C", 0.8)}
    assert graph.orphans(nodes, edges).first()[0] == "C"


def test_categories_and_types(spark):
    nodes = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "x"), ("d", "y")], "name string, category string")
    edges, skipped = graph.category_edges(nodes, max_size=2)
    assert edges.count() == 0 and skipped.first()["category"] == "x"
    rows = [("a", "b", "substitute", "symmetric", 1.0, 1), ("b", "a", "prerequisite", "a_to_b", 0.5, 2), ("a", "c", "complement", "symmetric", 1.0, 3)]
    c = spark.createDataFrame(rows, "a string, b string, edge_type string, direction string, confidence double, seq long")
    assert [tuple(r) for r in graph.typed_edges(c).collect()] == [("a", "b", 0.1, "prerequisite")]


def test_bootstrap_draws_from_every_source(spark, tmp_path):
    """bootstrap_ci over more and fewer sources than the 20 of the supplied tables, by brute force."""
    from loomgraph.plans import catalog

    for n in (27, 7):
        d = str(tmp_path / str(n))
        rows = [(10 * s + k, f"t{s} {k}", "en", f"s{s:02}", 50 + 3 * k + s) for s in range(n) for k in range(5)]
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(r[0], int(r[0] % 10 < 1 + r[0] // 10 % 5), 0) for r in rows], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        values = [(1 + s % 5) / 5 for s in range(n)]
        draw = lambda i, slot: int(hashlib.md5(f"draw:{i}:{slot}".encode()).hexdigest()[:12], 16) % n
        means = sorted(sum(values[draw(i, slot)] for slot in range(n)) / n for i in range(1000))
        got = catalog.QUERIES["bootstrap_ci"](spark, d).first()
        assert (got["lo"], got["hi"]) == (round(means[25], 6), round(means[975], 6))
