import random

import pytest

from loomgraph.operators import classify
from loomgraph.sources import reports
from loomgraph.streaming import retry


def test_retry_policy():
    assert not retry.retryable("429 quota exceeded") and retry.retryable("503 unavailable") and retry.retryable("odd") and retry.retryable("the network is unreachable") and retry.retryable(None) and not retry.retryable("could not generate: api_key missing")
    assert 60 <= retry.delay(10, random.Random(1)) <= 60.5


def test_classify(spark):
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "c")], "lo string, hi string")
    cache = spark.createDataFrame([("b", "a")], "a string, b string")
    answer = lambda group: [("substitute" if p == ("a", "c") else "nonsense", "symmetric", 0.9, "r") for p in group]
    assert [(r["a"], r["b"], r["edge_type"]) for r in classify.classify(pairs, answer, cache).collect()] == [("a", "c", "substitute")]

    def broken(group):
        raise RuntimeError("503")

    assert classify.classify(pairs, broken).count() == 0


def test_bridge_path(spark):
    edges = spark.createDataFrame([("A", "B", 0.9), ("B", "C", 0.9)], "lo string, hi string, weight double")
    nodes = spark.createDataFrame([(n, "skill") for n in "ABCE"] + [("R", "role")], "name string, node_type string")
    got = classify.bridge_path(edges, nodes, ["A", "R"], "C")
    assert got["path"] == [("A", "B", 0.9), ("B", "C", 0.9)] and got["distance"] == pytest.approx(0.2) and got["ignored"] == ["R"]
    assert [classify.bridge_path(edges, nodes, ["A"], t)["status"] for t in ("E", "R", "Z")] == ["orphan", "not a skill", "not a node"]
    assert classify.bridge_path(edges, nodes, ["E"], "C")["status"] == "no path"


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("x", 0.5), ("y", None)], "name string, v double")
    assert reports.markdown(df).splitlines()[2:] == ["| x | 0.500 |", "| y | – |"]
    linked = spark.createDataFrame([("a", "N", 1.0)], "surface string, node string, score double")
    assert not reports.log_unresolved(linked, str(tmp_path / "log"))
    assert reports.log_unresolved(linked.selectExpr("surface", "cast(null as string) node", "score"), str(tmp_path / "log"))
    texts = spark.createDataFrame([("a", "Docker"), ("b", "Helm")], "name string, text string")
    for _ in range(2):
        assert reports.cached_vectors(texts, str(tmp_path / "v"), "m").where("size(embedding) = 64").count() == 2
    assert spark.read.parquet(str(tmp_path / "v")).count() == 2
    names = {r["name"] for r in reports.extraction_files(spark.createDataFrame([("r", 1), ("r", 2)], "source_id string, n int"), str(tmp_path / "x")).collect()}
    assert names == {"r", "r-2"}
