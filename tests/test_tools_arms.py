"""Nested responses, tools, the chat loop, the JSON server, the registry of arms, and lazily made links."""

import base64
import json
import threading
import urllib.request

import pytest

from loomgraph.functions import text as T
from loomgraph.operators import classify, evaluation, linking, matching
from loomgraph.plans import arms, tools
from loomgraph.plans.engine import MatchEngine, get_engine, set_engine
from loomgraph.sources import readers
from loomgraph.sources.store import Store


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    s = Store(spark, str(tmp_path_factory.mktemp("engine")))
    s.upsert_skills(spark.createDataFrame([(n, "c") for n in ("Docker", "Kubernetes", "AWS", "React", "JavaScript")], "name string, category string"))
    s.upsert_similar(spark.createDataFrame([("Docker", "Kubernetes", 0.8, "e"), ("React", "JavaScript", 0.9, "e")], "lo string, hi string, weight double, edge_source string"))
    e = MatchEngine(s, use_embedding=False, path_table=True)
    e.ingest(readers.read_bytes(spark, [("devops.txt", b"Ran Docker and AWS."), ("frontend.txt", b"React, JavaScript")]), "b1")
    return e


def test_ranking_response(engine):
    r = engine.ranking_response({"Kubernetes": 1.0, "k8s": 1.5, "AWS": 1.0, "React": 0.5}, top_k=1).first()
    assert r["n_candidates"] == 1 and r["params"]["max_hops"] == 2
    assert [(x["surface"], x["node"]) for x in r["jd_links"]] == [("AWS", "AWS"), ("Kubernetes", "Kubernetes"), ("React", "React"), ("k8s", "Kubernetes")]
    c = r["candidates"][0]
    assert (c["rank"], c["name"], c["matched_skills"]) == (1, "devops", ["AWS"])
    assert [(g["skill"], g["via"], g["distance"]) for g in c["bridged_skills"]] == [("Kubernetes", "Docker", 0.2)]
    assert [(g["skill"], g["distance"]) for g in c["missing_skills"]] == [("React", -1.0)]


def test_gap_and_explain_responses(engine):
    r = engine.gap_response(["Kubernetes", "React", "AWS"], ["Docker"]).first()
    assert [g["skill"] for g in r["bridgeable"]] == ["Kubernetes"] and [g["skill"] for g in r["missing"]] == ["AWS", "React"]
    assert [x["node"] for x in r["candidate_links"]] == ["Docker"] and r["params"]["bridge_cutoff"] == 0.3
    r = engine.explain_response(["Docker"], ["Docker", "nothing such"]).first()
    assert "matched: Docker" in r["explanation"] and [x["method"] for x in r["candidate_links"]] == ["surface", "unresolved"]


def test_old_names(engine):
    full = matching.results(engine.wants(["Docker", "React"]), engine.pool().where("name = 'devops' AND skill IS NOT NULL").select("cand", "skill", "weight"), engine.paths(), engine.params)
    r = matching.legacy(full).first()
    assert r["score"] == r["total"] and r["matched"] == ["Docker"] and [g["skill"] for g in r["gaps"]] == ["React"]


def test_tools_and_chat(engine):
    assert "batch" not in json.dumps(tools.schemas()) and len(tools.schemas()) == len(tools.TOOLS)
    got = tools.call("rank_candidates", {"jd_skills": {"Docker": 1.0}}, "b1", engine)
    assert [r["name"] for r in got["result"]] == ["devops", "frontend"]
    assert tools.call("rank_candidates", {"jd_skills": {"Docker": 1.0}}, "other", engine)["result"] == []
    assert "unknown arguments" in tools.call("rank_candidates", {"batch": "b2"}, "b1", engine)["error"] and "error" in tools.call("nothing", {}, None, engine)
    asked = []

    def client(messages, schemas):
        asked.append(len(schemas))
        return {"calls": [{"name": "graph_stats", "arguments": {}}]} if schemas else {"text": "done"}

    r = tools.chat(client, "how large?", "b1", engine)
    assert r.text == "done" and len(r.calls) == tools.ROUNDS and r.calls[0]["result"][0]["skills"] == 5 and asked[-1] == 0
    assert tools.extraction_node({"text": "We need Docker"}, engine)["skills"] == {"Docker": 1.0}
    set_engine(None)
    with pytest.raises(RuntimeError):
        get_engine()


def test_server(engine):
    s = tools.server(engine, 0)
    threading.Thread(target=s.serve_forever, daemon=True).start()

    def ask(path, body=None):
        req = urllib.request.Request(f"http://127.0.0.1:{s.server_port}{path}", None if body is None else json.dumps(body).encode())
        try:
            with urllib.request.urlopen(req, timeout=120) as r:
                return r.status, json.loads(r.read())
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read())

    assert ask("/health") == (200, {"status": "ok"})
    assert len(ask("/api/jds?split=train")[1]["jds"]) == 15
    assert ask("/api/rank_pool", {"jd_skills": {"Docker": 1.0}, "batch_id": "b1", "top_k": 1})[1]["candidates"][0]["name"] == "devops"
    assert ask("/api/rank", {"jd_skills": {"Docker": 1.0}})[0] == 400 and ask("/nothing")[0] == 404 and ask("/api/chat", {"message": "hi"})[0] == 503
    up = ask("/api/candidates", {"name": "new.txt", "content": base64.b64encode(b"Kubernetes here").decode(), "batch_id": "b7"})[1]
    assert up["status"] == "complete" and up["in_pool"] and up["skill_count"] == 1 and up["thread_id"].startswith("upload-")
    assert [c["name"] for c in ask("/api/candidates?batch_id=b7")[1]["candidates"]] == ["new"]
    s.shutdown()


def test_lazy_linker(spark):
    class Broken:
        def encode(self, texts):
            raise OSError("no model")

    nodes = spark.createDataFrame([("Docker", "Docker"), ("Kafka", "Kafka")], "name string, text string")
    phrases = spark.createDataFrame([("docker",), ("Dockers",), ("zzz",)], "surface string")
    good = linking.Linker(nodes).warm()
    assert good.available() and [r["node"] for r in good.names(phrases).collect()] == ["Docker"]
    bad = linking.Linker(nodes, Broken())
    assert not bad.available() and {r["surface"]: r["method"] for r in bad.link(phrases.selectExpr("surface", "1.0D weight")).collect()} == {"docker": "surface", "Dockers": "unresolved", "zzz": "unresolved"}
    cases = spark.createDataFrame([("Dockers", "Docker"), ("zzz", None)], "surface string, expected string")
    got = {r["threshold"]: (r["correct"], r["missed"], r["wrong"]) for r in linking.calibration_report(cases, good, [0.5, 0.99]).collect()}
    assert got == {0.5: (1, 0, 0), 0.99: (0, 1, 0)}


def test_arms_and_ablations(spark):
    pairs = [(min(a, b), max(a, b), 0.8) for g in evaluation.SUBSTITUTION_GROUPS for a in g for b in g if a < b]
    similar = spark.createDataFrame(pairs, "lo string, hi string, weight double")
    nodes = spark.createDataFrame([(s, str(i)) for s, i in evaluation.GROUP_OF.items()], "name string, category string")
    classified = spark.createDataFrame([(a, b, "substitute", "symmetric", 0.9, 1) for a, b, _ in pairs], "a string, b string, edge_type string, direction string, confidence double, seq int")
    wants, graded, have = evaluation.dataset(spark, [j for j in evaluation.Generator().jds() if j["domain"] in ("devops", "ml")])
    grid = [{"cutoff": 0.6, "scale": 2.0, "unreachable": 0.0, "hops": 1}]
    got = {(r["arm"], r["split"]): r for r in arms.run_arms(wants, graded, have, nodes, similar, classified, ("categorical", "typed_sub", "count_only_k1", "cosine-only", "tfidf"), grid).collect()}
    assert len(got) == 10 and got["categorical", "train"]["bridge_over_weak"] > 0.9 > 0.5 > got["tfidf", "train"]["bridge_over_weak"]
    assert len(arms.ARMS) == 11 and set(arms.ABLATIONS) >= {"selected config"}
    from loomgraph.operators import paths

    apsp = paths.apsp(similar).persist()
    cut = {r["arm"]: r["bridge_over_weak"] for r in arms.ablate(wants, graded, have, apsp, grid[0]).where("split = 'train'").collect()}
    assert cut["no bridging (direct match only)"] < cut["selected config"] == cut["max_hops = 1"]
    rows = arms.head_to_head(wants, graded, have, apsp, arms.chosen(grid[0]))
    assert {r["lift_ndcg"] for r in rows.where("ranker = 'cosine-only'").collect()} == {0.0}
    assert "## Lift" in arms.report("Results", {"Lift": rows})


def test_long_bridges(spark):
    edges = spark.createDataFrame([(f"n{i:02}", f"n{i + 1:02}", 0.95) for i in range(9)], "lo string, hi string, weight double")
    nodes = spark.createDataFrame([(f"n{i:02}", "skill") for i in range(10)], "name string, node_type string")
    got = classify.bridge_path(edges, nodes, ["n00"], "n09")
    assert got["status"] == "path" and len(got["path"]) == 9 and got["distance"] == pytest.approx(0.45)


def test_casefold(spark):
    words = ["Straße", "ΣΑΣ", "ﬁn", "ABC", None]
    got = [r["y"] for r in spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, x string").select("i", T.casefold("x").alias("y")).orderBy("i").collect()]
    assert got == [None if w is None else w.casefold() for w in words]
