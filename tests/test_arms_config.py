import os

import pytest

from loomgraph import config
from loomgraph.operators import evaluation, graph
from loomgraph.plans import arms


def test_env(tmp_path, monkeypatch):
    (tmp_path / ".env").write_text("# note\nexport LOOMGRAPH_STORE='/a'\nLOOMGRAPH_SHUFFLE_PARTITIONS=7\n")
    monkeypatch.setenv("LOOMGRAPH_STORE", "/shell")
    monkeypatch.delenv("LOOMGRAPH_SHUFFLE_PARTITIONS", raising=False)
    assert config.load_env(tmp_path / ".env") == {"LOOMGRAPH_SHUFFLE_PARTITIONS": "7"}
    c = config.Config.from_env()
    assert c.store == "/shell" and c.shuffle_partitions == 7 and c.configured and config.load_env(tmp_path / "none") == {}
    os.environ.pop("LOOMGRAPH_SHUFFLE_PARTITIONS")


def test_arm_of_true_substitutes(spark):
    """On a graph of the curated substitutes every bridge is right and bridgeable candidates beat weak ones."""
    pairs = [(min(a, b), max(a, b), 0.8) for g in evaluation.SUBSTITUTION_GROUPS for a in g for b in g if a < b]
    edges = spark.createDataFrame(pairs, "lo string, hi string, weight double")
    wants, graded, have = evaluation.dataset(spark, evaluation.Generator().jds())
    grid = [{"cutoff": c, "scale": s, "unreachable": 0.0, "hops": 1} for c in (0.1, 0.3) for s in (1.0, 2.0)]
    got = arms.run_arm(edges, wants, graded, have, grid, iterations=50)
    assert got["config"]["cutoff"] == 0.3
    for m in got["splits"].values():
        assert m["gap_precision"] == (1.0, 1.0, 1.0) and m["bridge_over_weak"][0] > 0.9
        assert m["ndcg"][1] <= m["ndcg"][0] <= m["ndcg"][2]


def test_probes(spark):
    c = spark.createDataFrame([("b", "a", "substitute")], "a string, b string, edge_type string")
    p = spark.createDataFrame([("a", "b", "substitute"), ("a", "c", "complement")], "a string, b string, expected string")
    assert {(r["hi"], r["ok"]) for r in graph.probe_report(c, p).collect()} == {("b", True), ("c", False)}
    assert arms.GRID and len(arms.GRID) == 216


def test_cli_needs_a_store(monkeypatch):
    from loomgraph.__main__ import main

    monkeypatch.delenv("LOOMGRAPH_STORE", raising=False)
    with pytest.raises(SystemExit):
        main(["stats"])
