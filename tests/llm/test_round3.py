"""Exact top-k, the prefix trie and collocations against brute force on awkward rows, and through SQL elsewhere."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import collocation, topk, trie

VECTORS = "vec_id long, embedding array<float>, label int, row long, score long, cell int"


def best(rows, k, every=20):
    """(query_id, rank, vec_id, score) by comparing all."""
    ok = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (q, x) in enumerate(ok):
        if q is None or q % every:
            continue
        got = [(-sum(s * t for s, t in zip(x, y)), c is None, c or 0, c) for b, (c, y) in enumerate(ok) if a != b and len(y) == len(x)]
        out += [(q, r, c, -s) for r, (s, _, _, c) in enumerate(sorted(got, key=lambda g: g[:3])[:k], 1)]
    return collections.Counter(out)


def found(df):
    assert df.columns == ["query_id", "rank", "vec_id", "score"]
    return collections.Counter(tuple(r) for r in df.collect())


def awkward_vectors(seed, n=160, scale=1.0):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 6)) * scale, 1).astype(np.float32)
    x[40:100] = x[40]  # ties far beyond k
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(20, x[20].tolist()), (20, x[40].tolist()), (None, x[40].tolist()), (-40, x[41].tolist()), (500, None), (520, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (540, [float("nan")] * 6), (560, [float("inf")] * 6)]
    return rows + [(580, []), (581, []), (600, [1.0, 2.0]), (601, [1.5, -2.0]), (602, [0.25, 0.25])]


@pytest.mark.parametrize("seed,scale,k", [(1, 1.0, 20), (2, 3000.0, 3), (3, 3e6, 5), (4, 0.0, 7)])
def test_topk_equals_all_pairs(spark, monkeypatch, seed, scale, k):
    """Many ties, every width of numbers, and cells of a few rows."""
    monkeypatch.setattr(topk, "CANDIDATES", 16)
    monkeypatch.setattr(topk, "QUERIES", 4)
    rows = awkward_vectors(seed, scale=scale)
    df = spark.createDataFrame([(i, v, 1, 2, 3, 4) for i, v in rows], VECTORS).repartition(3)
    assert found(topk.search(df, F.col("__id") % 20 == 0, k)) == best([(i, None if v is None else [None if x is None else np.float32(x) for x in v]) for i, v in rows], k)


def test_ties_of_a_cell(monkeypatch):
    """However many candidates tie, and in whatever order they come, the smallest ids stay."""
    monkeypatch.setattr(topk, "TIES", 8)
    monkeypatch.setattr(topk, "TILE", 4)
    ids = list(range(100, 160))
    random.Random(1).shuffle(ids)
    cols = {"kind": [0] + [1] * 60, "row": range(61), "id": [20, *ids[:-1], None], "v": [[1.0]] + [[2.0]] * 60, "lo": [2] + [None] * 60, "need": [5] + [None] * 60}
    types = {"kind": "int32", "row": "int64", "id": "int64", "v": pa.list_(pa.float32()), "lo": "int64", "need": "int32"}
    whole = pa.RecordBatch.from_arrays([pa.array(list(v), types[c]) for c, v in cols.items()], names=list(cols))
    got = pa.Table.from_batches(list(topk.found([whole.slice(i, 7) for i in range(0, 61, 7)], "f4"))).to_pydict()
    assert got["vec_id"] == sorted(ids[:-1])[:5] and set(got["score"]) == {2} and set(got["query_id"]) == {20}


def test_topk_of_little(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert topk.search(empty, F.col("__id") % 20 == 0).count() == 0
    two = spark.createDataFrame([(0, [1.0], 1, 1, 1, 1), (1, [2.0], 1, 1, 1, 1)], VECTORS)
    assert [tuple(r) for r in topk.search(two, F.col("__id") % 20 == 0).collect()] == [(0, 1, 1, 64 * 128)]
    with pytest.raises(ValueError, match="64 bits"):
        topk.search(spark.createDataFrame([(0, [3e18], 1, 1, 1, 1)], VECTORS), F.lit(True))


TALKS = "conv_id long, turn long, role string, text string, depth long, first long, n long"


def expected(rows):
    """Nodes of the trie, from sequences held whole."""
    md5 = lambda role, text: hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
    by = collections.defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            by[c].append((t is not None, t or 0, role or "", md5(role or "", text or ""), text or ""))
    own = {c: [(r, x) for _, _, r, _, x in sorted(v)] for c, v in by.items()}
    ways = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        head = c - int(math.fmod(c, 5))
        ways[c] = own.get(head, [])[:h] + turns[h:]
    nodes = collections.defaultdict(list)
    for c, w in ways.items():
        for d in range(len(w) + 1):
            nodes[tuple(w[:d])].append(c)
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        kids = [p for p in below if len(p) == len(path) + 1]
        leaves = [p for p in below if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below)]
        saved = sum((len(nodes[p]) - 1) * (len(p[-1][1].encode()) if p else 0) for p in below)
        ends = ",".join(str(c) for c in sorted(members) if len(ways[c]) == len(path))
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_trie_equals_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(trie, "PIECE", 3)
    monkeypatch.setattr(trie, "UNROLL", 4)
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-6, 60), 40):
        for t in range(rng.choice([1, 2, 5, 12])):
            rows.append((c, rng.choice([None, t, t]), rng.choice(["user", "bot", None]), rng.choice(["a", "bé", "", None])))
    rows += [(70 + i, t, "user", f"same {t}") for i in range(12) for t in range(11)]  # copies
    rows += [(90, t, "user", "long " * 40) for t in range(60)]  # one that is much longer than the others
    rows += [rows[0], rows[0], (None, 1, "user", "lost")]
    df = spark.createDataFrame([(*r, 1, 1, 1) for r in rows], TALKS).repartition(5)
    got = [tuple(r) for r in trie.trie(df).collect()]
    assert sorted(got, key=repr) == expected(rows)


def test_trie_of_nothing(spark):
    assert trie.trie(spark.createDataFrame([], TALKS)).count() == 0
    assert trie.trie(spark.createDataFrame([(None, 1, "user", "x", 1, 1, 1)], TALKS)).count() == 0


def mined(rows, least, most):
    n, f = collections.Counter(), collections.Counter()
    for lang, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for m in range(1, 5):
                f.update((lang or "und", *w[i : i + m]) for i in range(len(w) - m + 1))
    ok = {p: a for p, a in f.items() if a >= least}
    by = collections.defaultdict(list)
    for (lang, *p), a in ok.items():
        if len(p) < 2:
            continue
        if any(100 * b >= 80 * a for (other, *q), b in ok.items() if other == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))):
            continue
        cuts = [(2_000_000 * a // (ok[lang, *p[:k]] + ok[lang, *p[k:]]), k) for k in range(1, len(p))]
        s, k = min(cuts)
        by[lang].append((-s, -a, " ".join(p).encode(), ok[lang, *p[:k]], ok[lang, *p[k:]]))
    return {(lang, i, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0]) for lang, xs in by.items() for i, x in enumerate(sorted(xs)[:most], 1)}


DOCS = "doc_id long, text string, lang string, p string, f long, k int"


@pytest.mark.parametrize("seed", range(3))
def test_collocations_equal_brute_force(spark, monkeypatch, seed):
    """Divided prefixes, repeated words, and counts that leave a worker early."""
    monkeypatch.setattr(collocation, "WORDS", 5)
    monkeypatch.setattr(collocation, "LANGS", 1)
    monkeypatch.setattr(collocation, "SHARES", 1)
    rng = random.Random(seed)
    words = ["The", "the", "a", "big", "é", "house", "\x1cx", "A", "is", "x"]
    rows = [(rng.choice(["en", "de", None, "und"]), "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ", ", "\r\n", " "]) for _ in range(rng.randint(0, 60)))) for _ in range(30)]
    rows += [("en", "the the the the the " * 8), ("en", "to be or not to be. " * 5), ("fr", None), (None, ""), ("fr", "...")]
    df = spark.createDataFrame([(i, t, lang, "p", 1, 1) for i, (lang, t) in enumerate(rows)], DOCS).repartition(3)
    got = [tuple(r) for r in collocation.mine(df, least=3, most=9).collect()]
    assert set(got) == mined(rows, 3, 9) and len(set(got)) == len(got)


def test_windows_go_over_chunks(monkeypatch):
    """Every word begins one run of neighbours, however small the chunks are."""

    class Any:
        def has_one(self, x):
            return True

    texts = ["a b c d e f g h. i j", None, "k " * 9, "one, two three four five six seven"]
    batch = pa.RecordBatch.from_pydict({"lang": ["en", "en", "de", "en"], "text": texts})
    runs = lambda: collections.Counter(tuple(map(int, x[i : i + 4])) for x, n in collocation.windows([batch], 0, Any(), 4) for i in range(n) if x[i])
    want, real = runs(), collocation.chunks
    assert sum(want.values()) == 10 + 9 + 7
    for most in (1, 5, 11):
        monkeypatch.setattr(collocation, "chunks", lambda raw, most=most: real(raw, most))
        got = runs()
        tidy = lambda c: collections.Counter({w[: w.index(0)] if 0 in w else w: 0 for w in c}) + collections.Counter([w[: w.index(0)] if 0 in w else w for w in c.elements()])
        assert tidy(got) == tidy(want)


def test_words_that_share_a_hash_get_another_seed(spark, monkeypatch):
    """Were two words one hash, their phrases would be one; a run under a hash of one bit must notice."""
    seeds = []
    real = collocation.count_words

    def counted(rows, seed):
        seeds.append(seed)
        x = real(rows, seed)
        return x.withColumn("id", F.lit(1).cast("long")) if seed == 0 else x

    monkeypatch.setattr(collocation, "count_words", counted)
    df = spark.createDataFrame([(1, "a b " * 9, "en", "p", 1, 1)], DOCS)
    assert {r["phrase"] for r in collocation.mine(df, least=3).collect()} == {p for _, _, p, *_ in mined([("en", "a b " * 9)], 3, 9)}
    assert seeds == [0, 1]


def test_collocations_of_nothing(spark):
    assert collocation.mine(spark.createDataFrame([], DOCS)).count() == 0
    assert collocation.mine(spark.createDataFrame([(1, None, None, "p", 1, 1)], DOCS)).count() == 0
