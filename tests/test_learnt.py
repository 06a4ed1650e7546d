"""The learnt embedder against numpy, and bulk registration against the loop."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.functions.vectors import BigramEmbedder
from loomgraph.operators import embedding, linking, registration

TOPICS = (("docker", "kubernetes", "helm", "containers", "cluster"), ("react", "javascript", "css", "frontend", "browser"), ("sql", "postgres", "index", "query", "tables"))


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(rng.choice(TOPICS[i % 3 : i % 3 + 1])) for _ in range(12))) for i in range(150)] + [(200, None), (201, ""), (202, "!!")]
    return spark.createDataFrame(rows, "id long, text string").repartition(4)


def test_svd_is_numpys(spark):
    """On a matrix of known rank the product with its basis loses nothing; on any, little more than the best one."""
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 8)) * (0.5 ** np.arange(8))
    m = base @ base.T
    table = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(60) for j in range(60)], "i long, j long, x double").repartition(5)
    u, s = embedding.truncated_svd(table, 60, 8)
    assert np.allclose(s, np.linalg.svd(m)[1][:8], rtol=1e-6, atol=1e-9) and np.linalg.norm(m - u @ (u.T @ m)) < 1e-8
    noisy = m + (lambda e: e + e.T)(rng.normal(size=(60, 60)) * 0.01)
    table = spark.createDataFrame([(i, j, float(noisy[i, j])) for i in range(60) for j in range(60)], "i long, j long, x double")
    u, _ = embedding.truncated_svd(table, 60, 8)
    full, sv, _ = np.linalg.svd(noisy)
    assert np.linalg.norm(noisy - u @ (u.T @ noisy)) <= 1.02 * np.linalg.norm(sv[8:])


def test_counts_and_ppmi(spark):
    df = spark.createDataFrame([("a b a c",), ("b a",), (None,)], "text string")
    w, p = embedding.counted(df, span=2, least=1)
    words = {r["word"]: (r["i"], r["n"]) for r in w.collect()}
    assert words == {"a": (0, 3), "b": (1, 2), "c": (2, 1)}
    n = np.zeros((3, 3))
    for text in ("aabc"[0:0] + "abac", "ba"):
        for k, x in enumerate(text):
            for y in text[k + 1 : k + 3]:
                i, j = words[x][0], words[y][0]
                n[i, j] += 1
                n[j, i] += 1
    assert {(r["i"], r["j"]): r["n"] for r in p.collect()} == {(i, j): n[i, j] for i in range(3) for j in range(3) if n[i, j]}
    want = np.log(np.where(n > 0, n * n.sum() / np.outer(n.sum(1), n.sum(1)), 1))
    got = {(r["i"], r["j"]): r["x"] for r in embedding.ppmi(p).collect()}
    assert got == pytest.approx({(i, j): want[i, j] for i in range(3) for j in range(3) if want[i, j] > 1e-12})


def test_learnt_words_and_links(spark, texts, tmp_path):
    e = embedding.learn(texts, dims=6)
    v = lambda t: e.encode([t])[0]
    assert v("docker") @ v("helm") > 0.8 > 0.3 > abs(v("docker") @ v("css"))
    assert e.encode_queries(["kubernetes"])[0] @ v("kuberntes") > 0.9 and not e.encode(["zzz", "", None]).any()
    nodes = spark.createDataFrame([(n, n) for n in ("Docker containers", "React frontend", "SQL tables")], "name string, text string")
    phrases = spark.createDataFrame([("kubernetes helm", 1.0), ("css in browsers", 1.0), ("postgres queries", 1.0), ("zzz", 1.0)], "surface string, weight double")
    for vectors in (None, linking.node_index(nodes, str(tmp_path / "v"), e)):
        got = {r["surface"]: r["node"] for r in linking.link(phrases, nodes, embedder=e, min_score=0.5, vectors=vectors, exact=True).collect()}
        assert got == {"kubernetes helm": "Docker containers", "css in browsers": "React frontend", "postgres queries": "SQL tables", "zzz": None}


def test_learning_from_nothing(spark):
    e = embedding.learn(spark.createDataFrame([(None,), ("",)], "text string"), dims=4)
    assert e.encode(["x"]).shape == (1, 4) and not e.encode(["x"]).any()


def on_a_circle():
    """Names are numbers on a circle, so that chains of near names can be made."""

    class Line:  # local, so that it is sent to the workers whole
        def encode(self, texts):
            a = np.array([float(t) if t.replace(".", "").isdigit() else 3.0 for t in texts])
            return np.c_[np.cos(a), np.sin(a)]

    return Line()


@pytest.mark.parametrize("seed", range(3))
def test_bulk_registration_is_the_loop(spark, seed):
    rng = random.Random(seed)
    chain = [f"{0.1 + 0.05 * i + 0.0005 * i * i:.4f}" for i in range(12)]  # each near its neighbours only, and to one of them more
    names = rng.sample(chain, len(chain)) if seed else chain
    names = [*names, names[0], "2.5", "2.5", "2.51", "1.9"]
    nodes = spark.createDataFrame([("2.5",), ("1.95",), (None,)], "name string")
    threshold = float(np.cos(0.07))
    want = [(r["surface"], r["node"], r["status"], round(r["score"], 6)) for r in linking.register(names, nodes, threshold, on_a_circle())]
    rows = spark.createDataFrame(list(enumerate(names)), "seq long, surface string").repartition(3)
    got = registration.register_all(rows, nodes, threshold, on_a_circle()).orderBy("seq").collect()
    assert [(r["surface"], r["node"], r["status"], round(r["score"], 6)) for r in got] == want


def test_bulk_registration_of_nothing(spark):
    nodes = spark.createDataFrame([], "name string")
    assert registration.register_all(spark.createDataFrame([(1, None)], "seq long, surface string"), nodes).count() == 0
    got = registration.register_all(spark.createDataFrame([(1, "Go"), (2, "Rust")], "seq long, surface string"), nodes, embedder=BigramEmbedder())
    assert {r["status"] for r in got.collect()} == {"created"}
