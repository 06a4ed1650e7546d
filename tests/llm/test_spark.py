"""The operators as plans: against brute force on the smallest tables and on awkward rows."""

import collections
import itertools
import os

import pytest
from pyspark.sql import functions as F

from loomgraph.llm import bpe, langid, licenses, linefirst, media, mixing, neardup, quality, queries, sharding, toxicity
from loomgraph.llm.common import prepare, read, remainder

DIR = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(DIR), reason="test tables are not here")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, part int, score double, n long"
AWKWARD = [
    (1, "One two three four five six. " * 3, "en", "a", 9, 1, 1, 1.0, 1), (2, None, None, None, None, None, None, None, None), (3, "", "en", "b", 0, 1, 1, 1.0, 1),
    (4, "x " * 60_000, "de", "a", 9, 1, 1, 1.0, 1), (1, "One two three four five six. " * 3, "en", "a", 9, 1, 1, 1.0, 1), (5, "One two three four five six. " * 3, "en", None, 9, 1, 1, 1.0, 1),
    (None, "lost id", "en", "a", 9, 1, 1, 1.0, 1), (6, "1 2 3", "fr", "b", 9, 1, 1, 1.0, 1),
]


@pytest.fixture(scope="module")
def awkward(spark):
    prepare(spark)
    return spark.createDataFrame(AWKWARD, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    prepare(spark)
    return spark.createDataFrame([], SCHEMA)


def labels(spark, rows=((1, 1, 0), (4, 0, 1), (6, None, None), (3, 1, 0))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def all_operators(spark, docs):
    lab, learn = labels(spark), F.lit(True)
    path, pattern = bpe.vocabulary()
    yield toxicity.score(docs, toxicity.train(docs, lab, learn), ["doc_id"])
    yield mixing.mix(docs)
    yield licenses.scan(docs, licenses.Model(), ["doc_id"])
    yield quality.score(docs, quality.train(docs, lab, learn), ["doc_id"])
    yield langid.identify(docs, langid.train(docs), ["doc_id"])
    yield sharding.shard_kd(docs)
    yield neardup.groups(docs)
    yield linefirst.clean(docs, ["doc_id"])
    yield media.store(docs, ["doc_id"])
    yield bpe.tokenize(docs, path, pattern, ["doc_id"])


def test_awkward_rows_keep_their_number(spark, awkward):
    for out in all_operators(spark, awkward):
        assert sorted(str(r["doc_id"]) for r in out.collect()) == sorted(str(r[0]) for r in AWKWARD)


def test_empty_tables(spark, empty):
    for out in all_operators(spark, empty):
        assert out.count() == 0


KEPT = ["doc_id", "text", "lang", "shard", "part", "n"]


def test_columns_of_any_name_are_kept(spark, awkward):
    """Names that operators use inside come through with their values."""
    lab, learn = labels(spark), F.lit(True)
    path, pattern = bpe.vocabulary()
    want = sorted(repr(tuple(r[c] for c in KEPT)) for r in awkward.collect())
    keyed = [c for c in KEPT if c != "doc_id"]
    for out, keep in (
        (toxicity.score(awkward, toxicity.train(awkward, lab, learn), KEPT), KEPT), (licenses.scan(awkward, licenses.Model(), KEPT), KEPT),
        (quality.score(awkward, quality.train(awkward, lab, learn), KEPT), KEPT), (langid.identify(awkward, langid.train(awkward), KEPT), KEPT),
        (linefirst.clean(awkward, KEPT), KEPT), (media.store(awkward, KEPT), KEPT), (bpe.tokenize(awkward, path, pattern, KEPT), KEPT), (mixing.mix(awkward, keep=keyed), KEPT),
    ):
        assert sorted(repr(tuple(r[c] for c in keep)) for r in out.collect()) == want


def test_clashing_names_are_refused(spark, awkward):
    path, pattern = bpe.vocabulary()
    clashing = (
        lambda: toxicity.score(awkward, toxicity.Model({}), ["doc_id", "score"]), lambda: quality.score(awkward, quality.Trees(0.0), ["score"]),
        lambda: langid.identify(awkward.withColumn("Lang_Pred", F.lit(1)), langid.Model({}), ["Lang_Pred"]), lambda: linefirst.clean(awkward.withColumn("kept", F.lit(1)), ["kept"]),
        lambda: licenses.scan(awkward.withColumn("family", F.lit(1)), licenses.Model(), ["family"]), lambda: media.store(awkward.withColumn("feature", F.lit(1)), ["feature"]),
        lambda: bpe.tokenize(awkward.withColumn("token_ids", F.lit(1)), path, pattern, ["token_ids"]), lambda: mixing.mix(awkward.withColumn("size", F.lit(1)), keep=("size",)),
        lambda: langid.identify(awkward, langid.Model({}), ["doc_id", "doc_id"]),
    )
    for make in clashing:
        with pytest.raises(ValueError, match="rename them first"):
            make()


def test_batches_are_cut_by_bytes():
    import numpy as np

    from loomgraph.llm.common import pieces

    assert pieces(np.array([5, 5, 5, 20, 1, 1]), 10) == [(0, 2), (2, 3), (3, 4), (4, 6)] and pieces(np.array([99]), 10) == [(0, 1)]


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from loomgraph.llm import common

    class Away:
        master, environment = "spark://host:7077", {}
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda s: type("O", (), {"isDefined": lambda o: False})()})()})()

    class Session:
        sparkContext = Away()
        conf = type("C", (), {"get": lambda self, k, d="1": d, "set": lambda *a: None})()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.prepare(Session())


@pytest.mark.parametrize("seed", [1, 2])
def test_target_bytes(spark, seed):
    import random

    rng = random.Random(seed)
    docs = spark.createDataFrame([(i, "x" * rng.randint(0, 400), rng.choice("ab")) for i in range(600)], "doc_id long, text string, lang string")
    total = docs.agg(F.sum(F.length("text") + 16)).first()[0]
    for target in (total + 1, total, 5000, 30_000):
        sizes = [r["s"] for r in sharding.shard_kd(docs, None, target_bytes=target).groupBy("shard").agg(F.sum("size").alias("s")).collect()]
        assert len(sizes) == max(1, -(-total // target)) and max(sizes) <= target + 416
    with pytest.raises(ValueError):
        sharding.shard_kd(docs, None, target_bytes=0)


@tables
def test_held_out_rule_of_queries(spark):
    from zlib import crc32

    for query, n, k in ((toxicity.query, 3, 1), (quality.query, 4, 2), (langid.query, 4, 2)):
        rows = query(spark, DIR).select("doc_id", "held_out").collect()
        assert rows and all(r["held_out"] == (crc32(str(r["doc_id"]).encode()) % n == k) for r in rows)


def test_every_query_is_registered():
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 14))


@tables
def test_mix_equals_brute_force(spark):
    rows = [r.asDict() for r in mixing.query(spark, DIR).collect()]
    by = collections.defaultdict(list)
    docs = {r["doc_id"]: r["source"] for r in read(spark, DIR, "documents").collect()}
    for r in rows:
        by[docs[r["doc_id"]]].append(r)
    sizes = {s: sum(r["size"] for r in x) for s, x in by.items()}
    weights = {s: i % 3 + 1 for i, s in enumerate(sorted(sizes))}
    total, held = sum(sizes.values()), {}
    while True:  # share, cap, share the excess again
        free = [s for s in sizes if s not in held]
        rate = (total - sum(held.values())) / sum(weights[s] for s in free)
        over = [s for s in free if rate * weights[s] > 3 * sizes[s] + 1e-9]
        if not over:
            break
        held |= {s: 3 * sizes[s] for s in over}
    for s, x in by.items():
        want = held.get(s, rate * weights[s])
        assert x[0]["target"] == pytest.approx(want) and abs(sum(r["taken"] for r in x) - want) <= 0.51
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in x)
    assert rows and sorted(map(repr, rows)) == sorted(repr(r.asDict()) for r in mixing.query(spark, DIR).collect())


@tables
def test_shards(spark):
    docs = read(spark, DIR, "documents")
    rows = sharding.query(spark, DIR).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
    assert len(rows) == docs.count() and set(by) <= set(range(40))
    assert all(sorted(r["slot"] for r in x) == list(range(len(x))) for x in by.values())
    sizes = [sum(r["size"] for r in x) for x in by.values()]
    assert max(sizes) - sum(sizes) / 40 <= max(r["size"] for r in rows)
    # the tree by brute force over the same keys
    keyed = [r.asDict() for r in sharding.keyed(docs, ("lang", "size"), "doc_id", "text").collect()]
    span = [max(1, (max(r[f"k{i}"] for r in keyed) >> 40) - (min(r[f"k{i}"] for r in keyed) >> 40)) for i in (0, 1)]

    def split(x, leaves, first):
        if leaves == 1:
            return {r["doc_id"]: first for r in x}
        wide = [((max(r[f"k{i}"] for r in x) >> 40) - (min(r[f"k{i}"] for r in x) >> 40)) / span[i] if x else 0 for i in (0, 1)]
        i = 0 if wide[0] >= wide[1] else 1
        x, total = sorted(x, key=lambda r: r[f"k{i}"]), sum(r["size"] for r in x)
        want, near = total * (leaves // 2) / leaves, lambda ends: min(ends, key=lambda e: (abs(e[1] - want), e[1]))
        sums = [0, *itertools.accumulate(r["size"] for r in x)]
        hit = next((n for n in range(len(x)) if sums[n + 1] >= want), None)
        if hit is None:
            return {}
        of = lambda shift: [n for n, r in enumerate(x) if r[f"k{i}"] >> shift == x[hit][f"k{i}"] >> shift]
        text, same = of(16), of(0)
        at, sum_at = near([(text[0], sums[text[0]]), (text[-1] + 1, sums[text[-1] + 1])])
        if len(text) > 1 and abs(sum_at - want) > total / leaves * sharding.SLACK:
            at, _ = near([(same[0], sums[same[0]]), (same[-1] + 1, sums[same[-1] + 1])])
        return split(x[:at], leaves // 2, first) | split(x[at:], leaves - leaves // 2, first + leaves // 2)

    want = split(keyed, 40, 0)
    assert all(r["shard"] == want[r["doc_id"]] for r in rows)
    # copies share a shard, but for groups larger than what a cut may miss its place by, or of several languages
    share, groups = sum(sizes) / 40, collections.defaultdict(list)
    for r in read(spark, DIR, "documents").select("doc_id", "text", "lang").collect():
        groups[r["text"], r["lang"]].append(r["doc_id"])
    size = {r["doc_id"]: r["size"] for r in rows}
    small = [g for g in groups.values() if len(g) > 1 and sum(size[d] for d in g) <= 2 * sharding.SLACK * share]
    assert small and all(len({want[d] for d in g}) == 1 for g in small)


def test_many_shards(spark):
    """A leaf for three rows, one text a third of all rows, and nodes that aren't broadcast."""
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same").otherwise(F.repeat(F.lit("x"), (F.col("id") % 97).cast("int"))).alias("text"), F.lit("a").alias("lang"))
    few = {r["doc_id"]: r["shard"] for r in sharding.shard_kd(docs, 200).collect()}
    assert len(few) == 600 and set(few.values()) <= set(range(200)) and len(set(few.values())) > 150
    most, sharding.MOST_NODES = sharding.MOST_NODES, 4
    try:
        assert few == {r["doc_id"]: r["shard"] for r in sharding.shard_kd(docs, 200).collect()}
    finally:
        sharding.MOST_NODES = most


def brute_groups(docs):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    sets = {i: shingles(t) for i, t in docs}
    boss = {i: i for i in sets}

    def top(a):
        while boss[a] != a:
            a = boss[a]
        return a

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                p, q = sorted((top(i), top(j)))
                boss[q] = p
    return {i: (len(sets[i]), top(i)) for i in sets}


def check_groups(spark, docs):
    prepare(spark)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute_groups(docs)
    got = {r["doc_id"]: r for r in neardup.groups(df).collect()}
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


@tables
def test_groups_of_the_smallest_table(spark):
    check_groups(spark, [(r["doc_id"], r["text"]) for r in read(spark, DIR, "documents").collect()])


def test_groups_of_planted_copies(spark):
    """Chains of edits around the threshold, shared passages, and short texts."""
    import random

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    docs, passage = [], [word() for _ in range(60)]
    for _ in range(8):
        base = [word() for _ in range(120)]
        for _ in range(10):
            x = base[:]
            for _ in range(rng.randint(0, 4)):
                x[rng.randrange(len(x))] = word()
            docs.append(" ".join(x))
            base = x if rng.random() < 0.5 else base
    docs += [" ".join(passage + [word() for _ in range(rng.randint(0, 60))]) for _ in range(60)]
    docs += ["a b", "A  b", "a b c", "", None, " "]
    rng.shuffle(docs)
    check_groups(spark, list(enumerate(docs)))


def test_prefix_join_finds_every_link(spark):
    """Against all pairs, with a heavy element, sets of other components only, and both bounds near their limits."""
    import random

    prepare(spark)
    rng = random.Random(2)
    sets = []
    for _ in range(25):
        base = rng.sample(range(10**6), rng.randint(1, 60))
        sets += [sorted({*rng.sample(base, max(1, len(base) - rng.randint(0, 8))), *rng.sample(range(10**6), rng.randint(0, 6)), 7}) for _ in range(8)]
    for similar in (80, 85, 100):
        rows = [(i, i if i % 5 else 1000, s) for i, s in enumerate(sets)]
        df = spark.createDataFrame(rows, "id long, component long, set array<long>")
        want = {(i, j) for i, ci, a in rows for j, cj, b in rows if i > j and ci != cj and 100 * len({*a} & {*b}) >= similar * len({*a} | {*b})}
        pairs = neardup.close(df, similar)
        got = neardup.verify(df.withColumnRenamed("id", "doc_id"), pairs, similar)
        assert {tuple(r) for r in got.collect()} == want and (want or similar == 100)
        assert pairs.count() <= max(60, 4 * len(want))


def test_elements_with_many_holders_are_dealt(spark, monkeypatch):
    prepare(spark)
    monkeypatch.setattr(neardup, "HOLDERS", 4)
    rows = [(i, i, [1, 2, 3, 4, 100 + i]) for i in range(30)] + [(50, 50, [1, 2, 3, 4])]
    df = spark.createDataFrame(rows, "id long, component long, set array<long>")
    assert {tuple(r) for r in neardup.close(df, 80).collect()} == {(50, i) for i in range(30)}


def test_ids_through_the_bitmap(spark):
    prepare(spark)
    docs = spark.createDataFrame([(i if i % 7 else None, f"t{i}") for i in range(5000)], "doc_id long, text string")
    want = {i for i in range(5000) if i % 7 and i % 13 == 0}
    ids = spark.createDataFrame([(i,) for i in want], "doc_id long")
    assert {r["doc_id"] for r in neardup.among(docs, ids).collect()} == want
    assert neardup.among(docs, ids.where("false")).count() == 0


def test_components(spark):
    prepare(spark)
    rows = [(1, 2), (2, 3), (3, 4), (9, 8), (7, 8), (20, 21), *((i, i + 1) for i in range(100, 140))]
    got = {r["id"]: r["component"] for r in neardup.components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 7: 7, 8: 7, 9: 7, 20: 20, 21: 20, **{i: 100 for i in range(100, 141)}}


@tables
def test_held_out_accuracy(spark):
    d = DIR.replace("0.001", "0.01")
    lab = {r["doc_id"]: r for r in read(spark, d, "labels").collect()}
    lang = {r["doc_id"]: r["lang"] for r in read(spark, d, "documents").select("doc_id", "lang").collect()}
    rows = [r for r in quality.query(spark, d).collect() if r["held_out"] and r["doc_id"] in lab]
    assert sum(r["predicted"] == lab[r["doc_id"]]["quality"] for r in rows) / len(rows) > 0.95
    rows = [r for r in langid.query(spark, d).collect() if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in rows) / len(rows) > 0.97
    rows = [r for r in toxicity.query(spark, d).collect() if r["held_out"] and r["doc_id"] in lab]
    assert sum(r["predicted"] == lab[r["doc_id"]]["toxic"] for r in rows) / len(rows) > 0.93


@tables
def test_clips(spark):
    prepare(spark)
    df = spark.createDataFrame([(1, bytearray(media.write_avi(b"\x10" * 6144 + b"\xf0" * 5120))), (2, bytearray(b"junk")), (3, None)], "id long, media binary")
    got = [(r["id"], r["clip"], r["error"] is None) for r in media.clips(df, "media", ["id"]).orderBy("id", "clip").collect()]
    assert got == [(1, 0, True), (1, 1, True), (2, None, False)]


def pipeline_docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_stages_of_awkward_and_empty_documents(spark, awkward, empty):
    """Every stage takes nulls, repeats, other columns of any name, and nothing at all."""
    import corpus_pipeline as P

    for docs in (awkward, empty):
        for name, stage in P.STAGES:
            out = stage(spark, docs, DIR)
            assert name == "tokens" or out.columns == list(P.COLUMNS)
            rows = out.collect()
            assert bool(rows) == bool(docs.count()) or name == "toxicity"
    assert {r["doc_id"] for r in dict(P.STAGES)["near_dups"](spark, awkward, DIR).collect()} == {1, 2, 3, 4, 6, None}


def test_same_id_with_different_texts(spark):
    """Rows that share an id, or have none, are kept by their texts, and mixing takes every word that is due."""
    import corpus_pipeline as P

    other = " ".join(f"w{i}" for i in range(30))
    rows = [(7, "a b c d e f g h", "en", "s", 15), (7, other, "en", "s", 9), (7, other, "en", "s", 9), (None, other, "en", "s", 9), (None, other, "en", "s", 9), (8, other, "en", "s", 9)]
    left = dict(P.STAGES)["near_dups"](spark, pipeline_docs(spark, rows), DIR).collect()
    assert sorted((str(r["doc_id"]), r["text"][:3]) for r in left) == [("7", "a b"), ("7", "w0 "), ("None", "w0 "), ("None", "w0 ")]
    docs = pipeline_docs(spark, [(None, other, "en", "s", 9)] * 3 + [(i, "x y z", "en", "t", 5) for i in range(4)])
    want = sum(r["taken"] for r in mixing.mix(docs).collect())
    got = sum(len((r["text"] or "").split()) for r in P.mixed(spark, docs, DIR).collect())
    assert got == want


@tables
def test_toxicity_and_tokens_stages(spark):
    """Against the operators, row by row: what is marked goes, and the tokens are the library's."""
    import tiktoken

    import corpus_pipeline as P

    docs = read(spark, DIR, "documents")
    marked = {r["doc_id"] for r in toxicity.query(spark, DIR).collect() if r["predicted"]}
    assert {r["doc_id"] for r in P.toxic(spark, docs, DIR).collect()} == {r["doc_id"] for r in docs.collect()} - marked
    path, pattern = bpe.vocabulary()
    lib = tiktoken.Encoding("x", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(bpe.load_ranks(path))}, special_tokens={})
    few = docs.where("doc_id < 40")
    texts = {r["doc_id"]: r["text"] for r in few.collect()}
    for r in P.tokens(spark, few, DIR).collect():
        assert r["token_ids"] == lib.encode_ordinary(texts[r["doc_id"]] or "") and r["n_tokens"] == len(r["token_ids"])


@tables
def test_run_is_its_stages_in_order(spark):
    import corpus_pipeline as P

    docs = read(spark, DIR, "documents")
    for _, stage in P.STAGES:
        docs = stage(spark, docs, DIR)
    key = lambda df: sorted((str(r["doc_id"]), r["ids_sha256"]) for r in df.collect())
    assert key(P.run(spark, DIR)) == key(docs)


@tables
def test_pipeline(spark):
    import corpus_pipeline as P

    docs = read(spark, DIR, "documents")
    assert [n for n, _ in P.STAGES] == ["language", "toxicity", "near_dups", "mixing", "tokens"]
    odd = docs.union(spark.createDataFrame([(900_001, "12 34", "en", "src1", 5), (900_002, None, None, None, None)], docs.schema))
    left = P.language(spark, odd, DIR)
    assert left.columns == docs.columns and {r["doc_id"] for r in odd.select("doc_id").collect()} - {r["doc_id"] for r in left.collect()} == {900_001, 900_002}
    kept = {r["doc_id"] for r in P.near_dups(spark, docs, DIR).collect()}
    want = brute_groups([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert kept == {i for i, (_, c) in want.items() if i == c}
    taken = {r["doc_id"]: r for r in mixing.mix(docs).collect()}
    mixed = collections.Counter()
    for r in P.mixed(spark, docs, DIR).collect():
        mixed[r["doc_id"]] += len((r["text"] or "").encode().split())
    assert {i: n for i, n in mixed.items() if n} == {i: r["taken"] for i, r in taken.items() if r["taken"]}


def test_remainder_is_crc32(spark):
    from zlib import crc32

    df = spark.createDataFrame([(i,) for i in range(50)], "doc_id long")
    assert all(r["m"] == crc32(str(r["doc_id"]).encode()) % 3 for r in df.withColumn("m", remainder("doc_id", 3)).collect())


def test_pipeline_links_from_four_fifths(spark):
    """Pairs between 0.75 and 0.9, against brute force at the stage's own similarity."""
    import random

    import corpus_pipeline as P

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    docs = []
    for i in range(120):
        base, n = [word() for _ in range(104)], 4 + i % 11
        docs += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(base[n:] + [word() for _ in range(n)]))]
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in docs)}
    share = {i: len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) for i in sets if i % 2 == 0}
    assert sum(0.8 <= x < 0.85 for x in share.values()) >= 20 and min(share.values()) < 0.8
    df = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in dict(P.STAGES)["near_dups"](spark, df, DIR).collect()} == set(sets) - {i + 1 for i, x in share.items() if x >= 0.8}


def test_every_language_is_learnt(spark):
    """More languages than 64, one of them rare, and text beyond a long document's first characters."""
    prepare(spark)
    rows = [(100 * k + i, "".join(chr(0x4E00 + 40 * k + j) for j in range(30)), f"l{k:02}") for k in range(70) for i in range(2 if k < 69 else 1)]
    rows += [(10**6 + i, "1" * langid.DOC_CHARS + " late words" * 2_000, "late") for i in range(20)]
    df = spark.createDataFrame([*rows, (-1, "no label", None)], "doc_id long, text string, lang string")
    m = langid.train(df)
    assert m.languages == sorted({r[2] for r in rows})
    assert all(r["lang_pred"] == r["lang"] for r in langid.identify(df.where("lang IS NOT NULL"), m, ["lang"]).collect())
