"""The matcher on small graphs whose answers are known by construction."""

from dataclasses import replace

import pytest

from loomgraph.functions.scoring import TUNED_PARAMS, ScoringParams
from loomgraph.operators import matching, paths


def edges(spark, rows):
    return spark.createDataFrame([(min(a, b), max(a, b), w) for a, b, w in rows], "lo string, hi string, weight double")


@pytest.fixture(scope="module")
def chain(spark):
    return paths.apsp(edges(spark, [("A", "B", 0.9), ("B", "C", 0.9), ("C", "D", 0.5)])).persist()


@pytest.fixture(scope="module")
def serving(spark):
    return paths.apsp(edges(spark, [("Docker", "Kubernetes", 0.8), ("Kubernetes", "Helm", 0.9), ("AWS", "Terraform", 0.75), ("Docker", "AWS", 0.65), ("React", "JavaScript", 0.9)])).persist()


def wants(spark, jd):
    jd = jd if isinstance(jd, dict) else dict.fromkeys(jd, 1.0)
    return spark.createDataFrame([("j", s, float(w)) for s, w in jd.items()], "jd string, skill string, demand double")


def have(spark, cands):
    rows = [(c, s, float(w)) for c, skills in cands.items() for s, w in (skills.items() if isinstance(skills, dict) else ((s, 1.0) for s in skills))]
    return spark.createDataFrame(rows, "cand string, skill string, weight double")


def match(spark, graph, jd, cand, p):
    cands = spark.createDataFrame([("c",)], "cand string")
    s = matching.scores(wants(spark, jd), have(spark, {"c": cand}), graph, p, cands).first()
    g = {r["skill"]: r for r in matching.gaps(wants(spark, jd), have(spark, {"c": cand}), graph, p, cands).collect()}
    return s, g


def test_reachability_has_independent_distance_and_hops(chain):
    got = {(r["src"], r["dst"]): r for r in chain.collect()}
    assert got["A", "C"]["dist"] == pytest.approx(0.2) and got["A", "C"]["hops"] == 2
    assert got["A", "D"]["dist"] == pytest.approx(0.7) and got["A", "D"]["hops"] == 3
    assert not any("E" in k for k in got)


def test_hops_are_not_the_length_of_the_weighted_path(spark):
    got = paths.apsp(edges(spark, [("A", "B", 0.9), ("B", "C", 0.9), ("A", "C", 0.2)])).where("src = 'A' AND dst = 'C'").first()
    assert got["dist"] == pytest.approx(0.2) and got["hops"] == 1


def test_cutoff_splits_bridged_and_missing(spark, chain):
    _, g = match(spark, chain, ["C", "D"], ["A"], ScoringParams(bridge_cutoff=0.25))
    assert g["C"]["bridgeable"] and not g["D"]["bridgeable"] and g["D"]["reason"].startswith("beyond_distance(d=0.70>0.25")


def test_via_is_the_source_of_the_cheapest_path(spark, chain):
    _, g = match(spark, chain, ["C"], ["A", "D"], ScoringParams(bridge_cutoff=1.0))
    assert g["C"]["via"] == "A" and g["C"]["distance"] == pytest.approx(0.2)


def test_scores(spark, chain):
    assert match(spark, chain, ["C"], ["A"], ScoringParams())[0]["bridge"] == pytest.approx(0.8)
    assert match(spark, chain, {"A": 1}, {"A": 0.5}, ScoringParams(enable_bridging=False))[0]["total"] == 0.5
    assert match(spark, chain, {"A": 1}, {"A": 1.5}, ScoringParams())[0]["total"] == 1.0
    assert match(spark, chain, ["E"], ["A"], ScoringParams(unreachable_penalty=1.0))[0]["total"] == -1.0
    capped = ScoringParams(bridge_credit_scale=2.0, max_bridge_credit=0.6)
    assert match(spark, chain, ["B"], ["A"], capped)[0]["bridge"] == pytest.approx(0.6)
    assert match(spark, chain, ["B"], ["A"], replace(capped, max_bridge_credit=10.0))[0]["bridge"] == pytest.approx(1.8)


def test_held_floor(spark, chain):
    s, _ = match(spark, chain, {"B": 1}, {"A": 1, "B": 0.5}, TUNED_PARAMS)
    assert s["direct"] == pytest.approx(0.9) and s["n_floored"] == 1
    s, _ = match(spark, chain, {"B": 1}, {"A": 1, "B": 0.5}, replace(TUNED_PARAMS, max_bridge_credit=None))
    assert s["direct"] == pytest.approx(1.0)


def test_serving_graph(spark, serving):
    _, g = match(spark, serving, ["Helm"], ["Docker"], TUNED_PARAMS)
    assert g["Helm"]["bridgeable"] and g["Helm"]["hops"] == 2 and g["Helm"]["distance"] == pytest.approx(0.3)
    _, g = match(spark, serving, ["Helm"], ["Docker"], replace(TUNED_PARAMS, max_hops=1))
    assert g["Helm"]["reason"] == "beyond_hops(2>1)"
    _, g = match(spark, serving, ["React"], ["Kubernetes"], TUNED_PARAMS)
    assert g["React"]["reason"] == "no_path" and g["React"]["hops"] is None


def test_ties_go_by_name_and_top_k(spark, chain):
    s = matching.scores(wants(spark, ["A"]), have(spark, {"y": ["A"], "x": ["A"], "z": ["D"]}), chain, ScoringParams(enable_bridging=False))
    assert [r["cand"] for r in matching.rank(s, 2).orderBy("rank").collect()] == ["x", "y"]
    assert matching.rank(s, 0).count() == 0


@pytest.mark.parametrize("scale", [0.5, 1.0, 2.0, 5.0])
def test_bridging_never_beats_holding_under_the_cap(spark, chain, scale):
    p = replace(TUNED_PARAMS, bridge_credit_scale=scale)
    assert match(spark, chain, ["B"], ["A"], p)[0]["total"] <= match(spark, chain, ["B"], ["B"], p)[0]["total"]


def test_bounded_path(spark):
    e = edges(spark, [("A", "B", 0.9), ("B", "C", 0.9), ("C", "D", 0.5)])
    src = spark.createDataFrame([("A",)], "src string")
    assert {r["dst"] for r in paths.within(e, src, 2).collect()} == {"A", "B", "C"}
    with pytest.raises(ValueError):
        paths.within(e, src, 0)


def test_results_and_explanation(spark, serving):
    w, h = wants(spark, {"Kubernetes": 1.5, "React": 1.0, "Docker": 1.0}), have(spark, {"c": ["Docker"]})
    r = matching.explain(matching.results(w, h, serving, TUNED_PARAMS)).first()
    assert r["matched_skills"] == ["Docker"] and [g["skill"] for g in r["bridged_skills"]] == ["Kubernetes"]
    assert r["missing_skills"][0]["distance"] == -1.0 and "bridged: Kubernetes" in r["explanation"]


def test_paths_toward_targets(spark):
    import random

    rng = random.Random(3)
    rows = sorted({tuple(sorted(rng.sample(range(30), 2))) for _ in range(60)})
    e = edges(spark, [(f"n{a:02}", f"n{b:02}", round(rng.uniform(0.3, 0.95), 2)) for a, b in rows])
    targets = spark.createDataFrame([("n01",), ("n05",), ("absent",)], "skill string")
    key = lambda df: sorted((r["src"], r["dst"], None if r["dist"] is None else round(r["dist"], 9), r["hops"]) for r in df.collect())
    for cutoff, hops in ((None, None), (0.9, None), (0.9, 2)):
        whole = paths.apsp(e, cutoff, hops)
        assert key(paths.toward(e, targets, cutoff, hops)) == key(whole.where("dst IN ('n01', 'n05')"))
    # against Floyd and Warshall
    d = {(r["lo"], r["hi"]): 1 - r["weight"] for r in e.collect()}
    d |= {(b, a): x for (a, b), x in d.items()}
    names = sorted({a for a, _ in d})
    for k in names:
        for a in names:
            for b in names:
                if a != b and (a, k) in d and (k, b) in d:
                    d[a, b] = min(d.get((a, b), 9e9), d[a, k] + d[k, b])
    assert {(r["src"], r["dst"]): round(r["dist"], 9) for r in paths.apsp(e).collect()} == {k: round(v, 9) for k, v in d.items()}
