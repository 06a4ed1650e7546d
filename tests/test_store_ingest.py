import io
import json
import zipfile
import zlib
from pathlib import Path

import pytest

from loomgraph.plans.engine import MatchEngine
from loomgraph.sources import readers
from loomgraph.sources.store import ConflictError, ParityError, Store, summarise, vectors_of
from loomgraph.streaming import ingest as I


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    s.upsert_skills(spark.createDataFrame([(n, "c") for n in ("Docker", "Kubernetes", "AWS", "Terraform", "React", "JavaScript")], "name string, category string"))
    s.upsert_similar(spark.createDataFrame([("Docker", "Kubernetes", 0.8, "e"), ("Terraform", "AWS", 0.75, "e"), ("React", "JavaScript", 0.9, "e")], "lo string, hi string, weight double, edge_source string"))
    return s


def docx(cells):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    rows = "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in r) + "</w:tr>" for r in cells)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{p('Head')}<w:tbl>{rows}</w:tbl></w:body></w:document>")
    return out.getvalue()


def test_readers(spark):
    rows = {r["path"]: r for r in readers.read_bytes(spark, [("a.txt", b"x \xff\xfe y"), ("b.docx", docx([["Languages", "Python, Go"]])), ("c.docx", b"no"), ("d.pdf", b""), ("e.txt", b" "), ("f.xlsx", b"kept")]).collect()}
    assert rows["a.txt"]["error"] is None and "�" in rows["a.txt"]["text"]
    assert "Languages | Python, Go" in rows["b.docx"]["text"]
    assert all(rows[k]["error"].startswith("ValueError") for k in ("c.docx", "d.pdf", "e.txt")) and rows["f.xlsx"]["text"] == "kept"
    with pytest.raises(ValueError):
        readers.parse(b"", "xlsx")


def pdf(pages, packed=False, extra=b""):
    """A PDF with a content stream for each page; packed: Flate streams, and objects in an object stream."""
    z = (lambda x: (b"/Filter/FlateDecode", zlib.compress(x))) if packed else (lambda x: (b"", x))
    kids = b" ".join(b"%d 0 R" % (10 + 2 * i) for i in range(len(pages)))
    plain = {1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Type/Pages/Kids[%s]/Count %d>>" % (kids, len(pages)), 5: b"<</Type/Font/Subtype/Type1/BaseFont/Helvetica>>"}
    streams = {}
    for i, content in enumerate(pages):
        plain[10 + 2 * i] = b"<</Type/Page/Parent 2 0 R/Contents %d 0 R/Resources<</Font<</F1 5 0 R/F2 6 0 R>>>>>>" % (11 + 2 * i)
        streams[11 + 2 * i] = z(content)
    plain[6] = b"<</Type/Font/ToUnicode 7 0 R>>"
    streams[7] = z(extra)
    out = b"%PDF-1.5\n"
    if packed:
        heads, bodies = b"", b""
        for n, body in plain.items():
            heads += b"%d %d " % (n, len(bodies))
            bodies += body + b" "
        raw = zlib.compress(heads + bodies)
        out += b"99 0 obj<</Type/ObjStm/N %d/First %d/Filter/FlateDecode/Length %d>>stream\n" % (len(plain), len(heads), len(raw)) + raw + b"\nendstream endobj\n"
    else:
        out += b"".join(b"%d 0 obj%sendobj\n" % x for x in plain.items())
    for n, (f, body) in streams.items():
        out += b"%d 0 obj<<%s/Length %d>>stream\n" % (n, f, len(body)) + body + b"\nendstream endobj\n"
    return out + b"trailer<</Root 1 0 R>>\n%%EOF\n"


@pytest.mark.parametrize("packed", [False, True])
def test_pdf(packed):
    cmap_ = b"1 beginbfchar <0001> <00C9> endbfchar 1 beginbfrange <0002> <0004> <0061> endbfrange"
    pages = [
        b"BT /F1 12 Tf 72 720 Td (Docker and \\(old\\) Kub\\145rnetes) Tj 0 -14 Td [(Py)-20(thon)-300(Go)] TJ T* (next) Tj ET",
        b"q 1 0 0 1 0 0 cm /Im1 Do Q",
        b"BT /F2 9 Tf <00010002 0003> Tj /F1 9 Tf 5 0 Td ( same line) Tj ET",
    ]
    assert readers.parse(pdf(pages, packed, cmap_), "pdf") == "Docker and (old) Kubernetes\nPython Go\nnext\n\nÉab same line"
    with pytest.raises(ValueError):
        readers.parse(b"%PDF-1.4 cut off", "pdf")
    with pytest.raises(ValueError):
        readers.parse(pdf(pages).replace(b"trailer<<", b"trailer<</Encrypt 1 0 R"), "pdf")


def test_payloads(spark):
    good = [{"skill": " Docker ", "weight": 1.5, "context": "ran  Docker"}]
    rows = [json.dumps(good), "```json\n" + json.dumps({"skills": good}) + "\n```", json.dumps([*good, {"skill": "x", "weight": 9, "context": "c"}]), "nonsense"]
    got = readers.from_payload(spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, payload string")).orderBy("i").collect()
    assert [bool(r["error"]) for r in got] == [False, False, True, True] and got[1]["skills"][0]["skill"] == "Docker"


def test_ingest_is_idempotent(spark, store):
    docs = readers.read_bytes(spark, [("devops.txt", b"Ran Docker and AWS."), ("copy.txt", b"Ran  Docker and AWS."), ("bad.docx", b"?"), ("fe.txt", b"React, JavaScript")])
    first = {r["path"]: r for r in I.ingest(docs, store, "b1").collect()}
    assert first["bad.docx"]["status"] == "failed" and {first["devops.txt"]["action"], first["copy.txt"]["action"]} == {"new", "copy"}
    assert store.read("candidates").count() == 2 and store.read("has_skill").count() == 4
    again = {r["path"]: r["action"] for r in I.ingest(docs, store, "b2").collect()}
    assert again["fe.txt"] == "reused" and store.read("candidates").count() == 2 and store.read("has_skill").count() == 4
    assert all(r["batch_ids"] == ["b1", "b2"] for r in store.read("candidates").collect())


def test_stream_resumes(spark, store, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "one.txt").write_text("Docker at work")
    run = lambda: I.stream(spark, str(folder), store, str(tmp_path / "cp"), "s").awaitTermination()
    run()
    v = store.version()
    run()
    assert store.version() == v
    (folder / "two.md").write_text("React at work")
    (folder / "skip.bin").write_text("React")
    run()
    assert sorted(r["name"] for r in store.read("candidates").collect()) == ["one", "two"]


def test_store_rules(spark, store):
    with pytest.raises(ParityError):
        store.load_graph(expected_skills=213)
    with pytest.raises(ValueError):
        store.add_to_batch("x", " ")
    assert not store.add_to_batch("x", "b") and not store.delete_candidate("x") and store.ping()
    edges = store.read("similar")
    with pytest.raises(ParityError):
        store.replace_similar(edges, store.read("skills").where("name <> 'Docker'"))
    store.replace_similar(edges.where("weight > 0.76"), store.read("skills"))
    assert store.read("similar").count() == 2


def test_engine(spark, store):
    e = MatchEngine(store, use_embedding=False, path_table=True)
    assert e.rank_candidates(["Docker"]).count() == 0
    e.ingest(readers.read_bytes(spark, [("devops.txt", b"Ran Docker and AWS."), ("frontend.txt", b"React, JavaScript")]), "b1")
    top = e.rank_candidates({"Docker": 1.0, "k8s": 1.0, "AWS": 1.0}).collect()
    assert [r["name"] for r in top] == ["devops", "frontend"] and top[0]["n_bridged"] == 1
    assert e.rank_candidates(["Docker"], candidates={}).count() == 0
    assert e.rank_candidates(["Docker"], batch="nope").count() == 0
    with pytest.raises(ValueError):
        e.rank_candidates(["Docker"], candidates={"a": ["Docker"]}, batch="b1")
    gaps = {r["skill"]: r["reason"] for r in e.get_bridgeable_gaps(["Kubernetes", "React"], ["Docker"]).collect()}
    assert gaps == {"Kubernetes": "bridgeable", "React": "no_path"}
    assert "matched: Docker" in e.explain_score(["Docker"], ["Docker"]).first()["explanation"]
    assert [r["skill"] for r in e.extract_jd_skills("We need Docker and React").collect()] == ["Docker", "React"]
    assert e.register_skills(["Zig", "Docker"]).where("status = 'created'").count() == 1 and e.graph_stats().first()["skills"] == 7
    assert {r["name"]: r["skill_count"] for r in e.list_candidates("b1").collect()} == {"devops": 2, "frontend": 2}


def flaky(fails):
    """An extractor that fails for a group as often as fails (group text's first word -> messages) says, then names it."""
    import pandas as pd

    def run(chunks, nodes):
        seen = Path(fails["dir"])

        def ask(batches):
            for pdf in batches:
                rows = []
                for sid, i, text in pdf[["source_id", "index", "text"]].itertuples(index=False):
                    word = text.split()[0] if not text.startswith("---") else text.split("\n")[1].split()[0]
                    mark = seen / f"{word}"
                    n = len(mark.read_text()) if mark.exists() else 0
                    mark.write_text("x" * (n + 1))
                    errors = fails.get(word, [])
                    rows.append((sid, i, None, None, None, errors[n]) if n < len(errors) else (sid, i, "Docker", 1.0, word, None))
                yield pd.DataFrame(rows, columns=["source_id", "index", "skill", "weight", "context", "error"])

        return chunks.coalesce(1).mapInPandas(ask, "source_id string, index int, skill string, weight double, context string, error string")

    return run


def tried(fails):
    return {p.name: len(p.read_text()) for p in Path(fails["dir"]).iterdir() if p.is_file()}


def text_of(*words):
    """A chunk of ten words for each word."""
    return " ".join(" ".join([w] + [f"{w}{i}" for i in range(9)]) for w in words).encode()


CONFIG = I.IngestConfig(chunk_words=10, overlap_words=0, attempts=3, wait=lambda n: 0)


def test_groups_are_tried_again_and_given_up(spark, store, tmp_path):
    fails = {"dir": str(tmp_path), "bb": ["503", "odd"], "cc": ["503"] * 9, "dd": ["401 unauthorized"]}
    docs = readers.read_bytes(spark, [("one.txt", text_of("aa", "bb", "cc", "dd")), ("two.txt", text_of("ee"))])
    got = {r["path"]: r for r in I.ingest(docs, store, "b", CONFIG, flaky(fails)).collect()}
    assert tried(fails) == {"aa": 1, "bb": 3, "cc": 3, "dd": 1, "ee": 1}
    assert got["one.txt"]["status"] == "partial" and got["two.txt"]["status"] == "complete" and got["one.txt"]["in_pool"]
    stored = {r["name"]: r["failed_chunks"] for r in store.read("candidates").collect()}
    assert stored == {"one": [2, 3], "two": []} and store.read("extractions").count() == 0
    # a profile with failed chunks is extracted again, a whole one isn't
    again = {r["path"]: r for r in I.ingest(docs, store, "c", CONFIG, flaky({"dir": str(tmp_path)})).collect()}
    assert again["one.txt"]["status"] == "complete" and again["two.txt"]["status"] == "reused" and tried(fails)["ee"] == 1


def test_an_interrupted_run_goes_on_at_its_cursor(spark, store, tmp_path, monkeypatch):
    fails = {"dir": str(tmp_path)}
    docs = readers.read_bytes(spark, [("one.txt", text_of("aa", "bb", "cc"))])
    whole = store.upsert_candidates
    monkeypatch.setattr(store, "upsert_candidates", lambda *a: (_ for _ in ()).throw(OSError("disk is away")))
    row = I.ingest(docs, store, "b", CONFIG, flaky(fails)).first()
    assert row["status"] == "persist_failed" and not row["in_pool"] and "disk" in row["error"] and store.read("candidates").count() == 0
    monkeypatch.setattr(store, "upsert_candidates", whole)
    row = I.ingest(docs, store, "b", I.IngestConfig(chunk_words=10, overlap_words=0, chunks_per_call=2, wait=lambda n: 0), flaky(fails)).first()
    assert row["status"] == "complete" and tried(fails) == {"aa": 1, "bb": 1, "cc": 1} and store.read("candidates").count() == 1


def test_groups_hold_several_chunks_and_fail_as_one(spark, store, tmp_path):
    fails = {"dir": str(tmp_path), "cc": ["quota"]}
    docs = readers.read_bytes(spark, [("one.txt", text_of("aa", "bb", "cc", "dd", "ee"))])
    row = I.ingest(docs, store, None, I.IngestConfig(chunk_words=10, overlap_words=0, chunks_per_call=2, wait=lambda n: 0), flaky(fails)).first()
    assert row["status"] == "partial" and store.read("candidates").first()["failed_chunks"] == [2, 3]


def test_persist_policy(spark, store, monkeypatch):
    calls = []

    def fail(text):
        def run(*a):
            calls.append(text)
            raise OSError(text)
        return run

    c, k = store.read("candidates"), store.read("has_skill")
    for text, n in (("network", 3), ("forbidden", 1)):
        calls.clear()
        monkeypatch.setattr(store, "upsert_candidates", fail(text))
        assert text in I.persist(store, c, k, CONFIG) and len(calls) == n


def test_a_broken_linker_loses_no_extraction(spark, store, tmp_path):
    fails = {"dir": str(tmp_path)}
    docs = readers.read_bytes(spark, [("one.txt", text_of("aa"))])

    def broken(phrases, nodes):
        raise RuntimeError("no embedder")

    row = I.ingest(docs, store, "b", CONFIG, flaky(fails), broken).first()
    assert row["status"] == "link_failed" and not row["in_pool"] and store.read("candidates").count() == 0
    assert I.ingest(docs, store, "b", CONFIG, flaky(fails)).first()["status"] == "complete" and tried(fails) == {"aa": 1}


def test_manifests_are_whole_and_old_versions_go(spark, tmp_path):
    s = Store(spark, str(tmp_path / "v"))
    for i in range(4):
        s.upsert_skills(spark.createDataFrame([(f"s{i}", "c")], "name string, source string"))
    with pytest.raises(ConflictError):
        s._put("{}", f"{s.path}/_versions/{s.version():08d}")
    assert s.vacuum(keep=1) == 3 and s.read("skills").count() == 4 and s.version() == 4
    with s as same:
        assert same is s


def test_migration(spark, tmp_path):
    s = Store(spark, str(tmp_path / "m"))
    art = {
        "skills": spark.createDataFrame([("A", [1.0]), ("B", None), ("B", None), (None, None), (" ", None)], "name string, embedding array<double>"),
        "roles": spark.createDataFrame([("R", "15-1")], "name string, soc string"),
        "requires": spark.createDataFrame([("R", "A"), ("R", "Z"), ("Q", "A")], "role string, skill string"),
        "similar": spark.createDataFrame([("B", "A", 0.8), ("A", "A", 0.5), ("A", "B", 2.0), ("A", "Z", 0.4)], "lo string, hi string, weight double"),
    }
    want = {"skills": (5, 2, 3), "roles": (1, 1, 0), "requires": (3, 1, 2), "similar": (4, 1, 3)}
    for dry in (True, False):
        got = {r["kind"]: (r["rows"], r["good"], r["errors"]) for r in s.migrate(art, dry_run=dry).collect()}
        assert got == want and s.version() == (0 if dry else 1)
    assert [tuple(r)[:3] for r in s.read("similar").collect()] == [("A", "B", 0.8)]
    n = {r["kind"]: r["n"] for r in summarise(s.read("skills"), s.read("roles"), s.read("requires"), s.read("similar")).collect()}
    assert n == {"skills": 2, "roles": 1, "requires": 1, "similar": 1, "node_total": 3, "relationship_total": 3}
    assert [r["name"] for r in vectors_of(s.read("skills")).collect()] == ["A"]
