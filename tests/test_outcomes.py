"""Copies share their original's outcome; a batch of a stream is written once; long results and unread filters are refused."""

import zlib

import pytest

from loomgraph.plans import engine, tools
from loomgraph.sources import pdf, readers
from loomgraph.sources.store import Store
from loomgraph.streaming import ingest as ingestion

FILES = [("a.txt", b"Ran Docker and React."), ("b.txt", b"Ran  Docker and React."), ("c.txt", b"AWS only")]


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    s.upsert_skills(spark.createDataFrame([(n, "t") for n in ("Docker", "React", "AWS")], "name string, source string"))
    return s


def told(df):
    return {r["path"]: (r["action"], r["status"], r["in_pool"], r["candidate_id"]) for r in df.collect()}


def test_copies(spark, store):
    docs = readers.read_bytes(spark, FILES)
    got = told(ingestion.ingest(docs, store))
    assert got["a.txt"][:3] == ("new", "complete", True) and got["b.txt"][:3] == ("copy", "reused", True)
    assert got["a.txt"][3] == got["b.txt"][3] and {r["candidate_id"] for r in store.read("candidates").collect()} == {got["a.txt"][3], got["c.txt"][3]}
    assert {x[1] for x in told(ingestion.ingest(docs, store)).values()} == {"reused"} and told(ingestion.ingest(docs, store))["b.txt"][3] == got["a.txt"][3]


def test_copies_of_what_failed(spark, store, monkeypatch):
    def broken(phrases, nodes):
        raise RuntimeError("no model")

    docs = readers.read_bytes(spark, FILES)
    got = told(ingestion.ingest(docs, store, linker=broken))
    assert {x[1:3] for x in got.values()} == {("link_failed", False)} and store.read("candidates").count() == 0

    def full(*_):
        raise OSError("constraint: the disk is full")

    monkeypatch.setattr(Store, "upsert_candidates", full)
    assert {x[1:3] for x in told(ingestion.ingest(docs, store)).values()} == {("persist_failed", False)}


def test_a_replayed_batch_is_written_once(spark, store, tmp_path, monkeypatch):
    """The first run ends between its commit and the stream's checkpoint."""
    folder = tmp_path / "in"
    folder.mkdir()
    for name, content in FILES:
        (folder / name).write_bytes(content)
    real, seen = ingestion.ingest, []

    def once(*args, **kw):
        out = real(*args, **kw)
        seen.append((told(out), store.version()))
        if len(seen) == 1:
            raise RuntimeError("the machine has gone")
        return out

    monkeypatch.setattr(ingestion, "ingest", once)
    run = lambda: ingestion.stream(spark, str(folder), store, str(tmp_path / "checkpoint")).awaitTermination()
    with pytest.raises(Exception):  # noqa: B017 (as the stream reports it)
        run()
    run()
    assert len(seen) == 2 and seen[0] == seen[1] and store.read("candidates").count() == 2
    (folder / "d.txt").write_bytes(b"React again")
    run()
    assert len(seen) == 3 and store.read("outcomes").count() == 1 and store.read("candidates").count() == 3


def test_long_results(spark, store):
    many = spark.createDataFrame([(f"c{i:03d}", f"n{i:03d}") for i in range(201)], "candidate_id string, name string")
    store.upsert_candidates(many.selectExpr("*", "'resume' doc_type", "'' content_hash", "array('b') batch_ids", "cast(array() as array<int>) failed_chunks", "cast(array() as array<string>) unresolved", "current_timestamp() extracted_at"), store.read("has_skill"))
    e = engine.MatchEngine(store)
    got = tools.call("list_candidates", {}, engine=e)
    assert "201 rows" in got["error"]
    pages = [tools.call("list_candidates", {"offset": o}, engine=e)["result"] for o in (0, 200)]
    assert [r["candidate_id"] for p in pages for r in p] == [f"c{i:03d}" for i in range(201)]
    status, out = tools.answer(e, "GET", "/api/candidates?offset=200", {})
    assert status == 200 and out["total"] == 201 and len(out["candidates"]) == 1 and tools.answer(e, "GET", "/api/candidates", {})[0] == 400


def test_other_filters_are_errors(spark):
    page = zlib.compress(b"BT (Docker) Tj ET")
    for name, raw, good in ((b"/FlateDecode", page, True), (b"[/FlateDecode]", page, True), (b"/ASCII85Decode", b"87cURD]j~>", False), (b"[/ASCII85Decode /FlateDecode]", b"x", False)):
        whole = b"%%PDF-1.4\n1 0 obj <</Type /Catalog /Pages 2 0 R>> endobj\n2 0 obj <</Type /Pages /Kids [3 0 R] /Count 1>> endobj\n3 0 obj <</Type /Page /Contents 4 0 R>> endobj\n4 0 obj <</Length %d /Filter %s>> stream\n%s\nendstream endobj\ntrailer <</Root 1 0 R>>" % (len(raw), name, raw)
        row = readers.read_bytes(spark, [("x.pdf", whole)]).first()
        assert (row["error"] is None) == good and (not good or "Docker" in row["text"]) and (good or "can't be read" in row["error"])
    assert pdf  # read through readers


def test_edges_and_aliases_of_the_engine(spark, store):
    """Edits keep the table of paths right and make labels anew; aliases can be given."""
    edges = spark.createDataFrame([("AWS", "Docker", 0.8, "x"), ("Docker", "React", 0.5, "x")], "lo string, hi string, weight double, edge_source string")
    store.upsert_similar(edges)
    for table in (True, False):
        e = engine.MatchEngine(store, path_table=table, aliases={"whale": "Docker"})
        rank = lambda: [(r["name"], r["total"]) for r in e.rank_candidates({"whale": 1.0}, {"x": {"AWS": 1.0}, "y": {"React": 1.0}}, top_k=2, bridge_cutoff=0.9, bridge_credit_scale=1.0, max_bridge_credit=1.0).collect()]
        before = rank()
        assert before[0][0] == "x" and before[0][1] > before[1][1]
        e.edit_edges(spark.createDataFrame([("React", "Docker", 0.95, "y")], "lo string, hi string, weight double, edge_source string"), spark.createDataFrame([("Docker", "AWS")], "lo string, hi string"))
        assert rank()[0][0] == "y" and rank()[0][1] > before[0][1]
        e.edit_edges(edges, None)
        assert rank() == before
