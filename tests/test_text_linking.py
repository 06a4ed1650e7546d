import collections
import random
import time

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators import documents, linking


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first()["y"]


def test_normalize_and_core_form(spark):
    assert one(spark, T.normalize, "  C++ / C#  ") == "c++ c#"
    assert one(spark, T.normalize, "Élan/ç") == "élan ç"
    assert one(spark, T.core_form, "Microsoft SQL Server") == "sql server"
    assert one(spark, T.core_form, "Amazon Web Services AWS software") == "web services aws"
    assert one(spark, T.embedded_acronyms, "Structured query language SQL") == ["sql"]


def test_normalize_document(spark):
    assert one(spark, T.normalize_document, "a  b\n\n\n\nc   d") == "a b\n\nc d"
    assert one(spark, T.normalize_document, "a\r\nb\x0bc") == "a\nb\nc"


def test_windows_cover_every_word(spark):
    """Over generated lengths and sizes: windows start every stride, only the last one reaches the end, and none is lost."""
    rng = random.Random(5)
    for _ in range(6):
        size = rng.randint(1, 30)
        overlap = rng.randrange(size)
        docs = [(i, " ".join(f"w{j}" for j in range(rng.choice((0, 1, size - 1, size, size + 1, rng.randint(0, 200)))))) for i in range(12)]
        got = collections.defaultdict(list)
        for r in documents.chunked(spark.createDataFrame(docs, "doc_id long, text string"), size, overlap).collect():
            got[r["doc_id"]].append((r["index"], r["text"].split()))
        for i, text in docs:
            w, own = text.split(), sorted(got[i])
            assert [k for k, _ in own] == list(range(len(own))) and bool(own) == bool(w)
            for k, part in own:
                start = k * (size - overlap)
                assert part == w[start : start + size] and (start + size >= len(w)) == (k == len(own) - 1)


def test_a_long_text_is_cut_in_linear_time(spark):
    df = spark.range(1).select(F.col("id").alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(300_000)), lambda i: i.cast("string")), " ").alias("text"))
    began = time.time()
    assert documents.chunked(df).agg(F.max("index")).first()[0] == -(-(300_000 - 375) // 335)
    assert time.time() - began < 30


@pytest.mark.parametrize("chunks", [1, 2, 7, 12])
def test_groups_hold_size_chunks(spark, chunks):
    df = spark.createDataFrame([(1, i, f"t{i}") for i in range(chunks)], "doc_id long, index int, text string")
    for size in (0, 1, 3, chunks, chunks + 5):
        rows = documents.chunk_groups(df, size).orderBy("group").collect()
        per = max(1, size)
        assert len(rows) == -(-chunks // per) and sum(r["n"] for r in rows) == chunks
        assert [r["first_index"] for r in rows] == list(range(0, chunks, per))
        assert all(("SECTION" in r["text"]) == (r["n"] > 1) for r in rows)


@pytest.fixture(scope="module")
def nodes(spark):
    names = ["Docker", "Kubernetes", "Amazon Web Services AWS software", "Structured query language SQL", "Apache Kafka", "Microsoft SQL Server"]
    return spark.createDataFrame([(n, n) for n in names], "name string, text string")


def test_cascade(spark, nodes):
    rows = [("k8s", 0.5), ("kubernetes", 1.5), ("Kafka", 1.0), ("", 1.0), ("zzqx", 1.0), ("Dockers", 1.0)]
    df = spark.createDataFrame([(1, s, w, "c", i) for i, (s, w) in enumerate(rows)], "doc_id long, surface string, weight double, context string, seq int")
    got = {r["surface"]: r for r in linking.link(df, nodes).collect()}
    assert got["k8s"]["method"] == "alias" and got["Kafka"]["node"] == "Apache Kafka" and got["Kafka"]["method"] == "surface"
    assert got[""]["method"] == "unresolved" and got[""]["score"] == 0 and got["zzqx"]["node"] is None
    assert got["Dockers"]["method"] == "embedding" and got["Dockers"]["node"] == "Docker"
    flat = {r["node"]: r["weight"] for r in linking.collapse(linking.link(df, nodes)).collect()}
    assert flat["Kubernetes"] == 1.5


def test_merge_keeps_the_heaviest(spark):
    df = spark.createDataFrame([(1, "Python", 0.5, "a", 0), (1, "python", 1.5, "led", 1), (1, "Docker", 1.0, "d", 2)], "doc_id long, skill string, weight double, context string, seq int")
    got = {r["skill"]: r for r in linking.merge_mentions(df).collect()}
    assert len(got) == 2 and got["python"]["context"] == "led"


def test_gazetteer_respects_word_borders(spark):
    names = spark.createDataFrame([("Git",), ("C++",), ("Microsoft Azure software",), ("++ --",)], "name string")
    docs = spark.createDataFrame([(1, "GitHub and c++ on azure"), (2, "git, indeed"), (3, None), (4, "a ++ -- b"), (4, "azure")], "doc_id long, text string")
    got = {(r["doc_id"], r["node"]) for r in linking.gazetteer_matches(docs, linking.gazetteer(names)).collect()}
    assert got == {(1, "C++"), (1, "Microsoft Azure software"), (2, "Git"), (4, "++ --"), (4, "Microsoft Azure software")}


def test_register_sees_what_it_created(spark, nodes):
    got = linking.register(["Docker", "Zig", "Zig"], nodes)
    assert [r["status"] for r in got] == ["exact", "created", "exact"]


def test_register_searches_all_nodes(spark, monkeypatch):
    monkeypatch.setattr(linking, "BROADCAST_NODES", 3)
    many = spark.createDataFrame([(x,) for x in ("Ada", "Basic", "Cobol", "Kubernetes", "PostgreSQL", "Zig")], "name string").repartition(3)
    got = linking.register(["Zig", "PostgreSQLs", "quantum basket", "quantum baskets"], many)
    assert [(r["node"], r["status"]) for r in got] == [("Zig", "exact"), ("PostgreSQL", "near_duplicate"), ("quantum basket", "created"), ("quantum basket", "near_duplicate")]


def test_upsert_and_scope(spark):
    old = spark.createDataFrame([("a", "x", ["b1"]), ("b", "y", ["b1"])], "id string, v string, batch_ids array<string>")
    new = spark.createDataFrame([("b", None, ["b2"]), ("c", "z", ["b2"])], "id string, v string, batch_ids array<string>")
    got = {r["id"]: (r["v"], r["batch_ids"]) for r in documents.upsert(old, new, "id", ("v",), ("batch_ids",)).collect()}
    assert got == {"a": ("x", ["b1"]), "b": ("y", ["b1", "b2"]), "c": ("z", ["b2"])}
    assert documents.in_batch(old, "nope").count() == 0 and documents.in_batch(old, "").count() == 2


def test_dedupe_of_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a "), (3, None), (4, "")], "doc_id long, text string")
    got = {r["doc_id"]: r["original"] for r in documents.first_of_each(documents.hashed(df)).collect()}
    assert got[2] == 1 and got[3] == 3
    assert documents.first_of_each(documents.hashed(df.where("false"))).count() == 0
