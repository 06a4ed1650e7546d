"""The build in one call, the layout for lookups, and the cases of link calibration."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.functions.vectors import BigramEmbedder
from loomgraph.operators import graph, linkcases, linking
from loomgraph.operators.graph import DensityError
from loomgraph.plans.build import artifact, build
from loomgraph.plans.engine import MatchEngine
from loomgraph.sources.store import ParityError, Store

NAMES = ["Docker", "Kubernetes", "Flask", "Django", "React", "Apache Kafka", "Kafka", "MySQL", "PostgreSQL", "Redis", "Redis Stack", "Go"]


@pytest.fixture
def taxonomy(spark):
    occupations = spark.createDataFrame([("15-1", "Developer"), ("15-2", "Analyst"), ("17-1", "Surveyor"), ("15-3", None)], "soc string, title string")
    rows = [("15-1" if i % 2 else "15-2", n, "Tools" if i % 3 else "Systems", "Y", "N") for i, n in enumerate(NAMES)]
    rows += [("17-1", "Theodolite", "Tools", "Y", "Y"), ("15-1", "Old thing", "Tools", "N", "N"), ("15-1", None, "Tools", "Y", "Y")]
    return occupations, spark.createDataFrame(rows, "soc string, skill string, element string, hot string, demand string")


def brute(texts, k, least):
    """Pairs of the k nearest of each, by numpy."""
    names = sorted(texts)
    v = BigramEmbedder().encode([texts[n] for n in names])
    sim = v @ v.T
    out = {}
    for i, a in enumerate(names):
        near = sorted((j for j in range(len(names)) if j != i and sim[i, j] >= least), key=lambda j: (-round(sim[i, j], 9), names[j]))[:k]
        out |= {tuple(sorted((a, names[j]))): round(float(sim[i, j]), 3) for j in near}
    return out


@pytest.mark.parametrize("way", ["exact", "index"])
def test_build_from_taxonomy_to_stored_edges(spark, taxonomy, tmp_path, way):
    store = Store(spark, str(tmp_path / "store"))
    settings = {} if way == "exact" else {"index": str(tmp_path / "index")}
    report = {r["kind"]: (r["rows"], r["good"], r["errors"]) for r in build(store, *taxonomy, k=2, max_density=None, custom=False, **settings).collect()}
    assert report["skills"] == (12, 12, 0) and report["roles"] == (2, 2, 0) and report["requires"] == (12, 12, 0)
    nodes = store.read("skills")
    texts = {r["name"]: f"{r['name']} ({r['category']})" for r in nodes.collect()}
    want = brute(texts, 2, 0.30)
    got = {(r["lo"], r["hi"]): r["weight"] for r in store.read("similar").where("edge_source = 'embedding'").collect()}
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) <= 0.001 for p in want)
    v = {r["name"]: r["embedding"] for r in nodes.collect()}
    assert np.allclose(v["Redis"], BigramEmbedder().encode([texts["Redis"]])[0])
    engine = MatchEngine(store, aliases={"pg": "PostgreSQL"})
    assert engine.graph_stats().first() is not None
    assert store.version() == 1


def test_build_keeps_the_pool_and_refuses_to_lose_skills(spark, taxonomy, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    with pytest.raises(DensityError):
        build(store, *taxonomy, k=11, min_sim=-1.0, custom=False)
    build(store, *taxonomy, dry_run=True, max_density=None)
    assert store.version() == 0
    build(store, *taxonomy, max_density=None)
    custom = {r[0] for r in store.read("skills").where("source = 'custom'").select("name").collect()}
    assert custom == {n for n, _ in graph.CUSTOM_SKILLS}
    assert store.read("similar").where("edge_source = 'seed'").count() > 0
    occupations, skills = taxonomy
    with pytest.raises(ParityError):
        build(store, occupations, skills.where("skill <> 'Go'"), max_density=None)
    with pytest.raises(ParityError):
        build(store, occupations, skills, custom=False, max_density=None)
    assert store.version() == 1


def test_empty_taxonomy(spark, taxonomy):
    made = artifact(taxonomy[0].limit(0), taxonomy[1].limit(0), custom=False)
    assert all(df.count() == 0 for df in made.values())


def rows_scanned(df):
    """Rows that the scan of a plan gave, after row groups were skipped."""
    plan = df._jdf.queryExecution()
    df._jdf.collectToPython()
    return plan.executedPlan().collectLeaves().head().metrics().apply("numOutputRows").value()


def test_lookups_read_few_row_groups(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), row_group_bytes=64 << 10)
    n = 40_000
    empty = store.read("candidates")
    own = {"candidate_id": F.format_string("c%07d", "id"), "content_hash": F.sha2(F.col("id").cast("string"), 256)}
    store.commit({"candidates": spark.range(n).select(*[own.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in empty.schema])})
    digest = spark.range(1).select(F.sha2(F.lit("31007"), 256)).first()[0]
    found = store.find_by_hash(digest)
    assert [r["candidate_id"] for r in found.collect()] == ["c0031007"]
    groups = [store.read("candidates").where(F.col("content_hash") == digest), store.read("candidates").where("candidate_id = 'c0000123'")]
    assert all(0 < rows_scanned(x) < n / 4 for x in groups)
    none = store.read("candidates").where(F.col("content_hash") == "0" * 64)
    assert none.count() == 0 and rows_scanned(none) < n / 4


def test_stored_files_are_sorted_and_whole(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    rows = [("b", "y"), ("a", "x"), ("a", "y"), (None, "z")]
    store.commit({"requires": spark.createDataFrame(rows, "role string, skill string")})
    got = [tuple(r) for r in store.read("requires").collect()]
    assert sorted(got, key=str) == sorted(rows, key=str)
    store.commit({"skills": store.read("skills")})
    assert store.read("skills").count() == 0


def test_link_cases(spark):
    cases = linkcases.cases(spark)
    assert cases.count() == len(linkcases.KNOWN) + len(linkcases.FOREIGN) == 145
    nodes = spark.createDataFrame([(n, n) for n in sorted({*linkcases.KNOWN.values()})], "name string, text string")
    assert linkcases.absent(cases, nodes).count() == 0
    assert [r[0] for r in linkcases.absent(cases, nodes.where("name <> 'Go'")).collect()] == ["Go"]
    rest = linkcases.open_cases(cases, nodes)
    resolved = {r[0] for r in cases.select("surface").subtract(rest.select("surface")).collect()}
    assert "Golang" in resolved and "kubernities" not in resolved and not resolved & set(linkcases.FOREIGN)
    judged = linkcases.judged(cases, linking.Linker(nodes))
    table = linkcases.table(judged).collect()
    rows = judged.collect()
    assert len(rows) == rest.count()
    for t in table:
        known = [r for r in rows if r["expected"]]
        hit = [r for r in known if r["score"] >= t["threshold"]]
        assert t["correct"] == sum(r["found"] == r["expected"] for r in hit) and t["wrong_known"] == len(hit) - t["correct"]
        assert t["missed"] == len(known) - len(hit) and t["wrong_foreign"] == sum(r["score"] >= t["threshold"] for r in rows if not r["expected"])
    clean = [t["threshold"] for t in table if not t["wrong_known"] + t["wrong_foreign"]]
    assert linkcases.chosen(linkcases.table(judged)) == (min(clean) if clean else None)
    assert linkcases.chosen(linkcases.table(judged.where("false"))) is None
