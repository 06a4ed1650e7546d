"""Near-duplicate groups by SuperMinHash, banding, verification and union-find.

1. Every document becomes its set of distinct 5-word shingles (64-bit hashes) and a SuperMinHash signature: each
   element walks its own random permutation of the HASHES places; in step j it offers the value j + r at the place
   that step j of its permutation names, and stops as soon as j exceeds the largest value of the signature. Values at
   different places exclude each other, so the estimate varies less than with independent hashes.
2. Documents with equal sets form a class and its smallest id represents it, so copies cost one row each.
3. BANDS bands of rows_for(similar) values put representatives into buckets: at 0.85 they hold 8 values, and two
   sets of that similarity share none with probability (1 - 0.85^8)^36 = 1e-5; at 0.80 they hold 6, with 2e-5.
4. In each bucket every representative is paired with the smallest one (as many pairs as rows), and each pair is
   verified on its full sets.
5. Components of the verified links. Members of buckets that are then still in different components are searched by an
   exact prefix join: elements are ordered by a sketch of their frequency (any order is right, rare ones first are
   fast), two sets of the wanted similarity share one of their first n - ceil(similar n / 100) + 1 elements, and what
   follows the first shared one bounds their intersection. Only pairs of different components that pass both bounds
   become rows; they are verified on their full sets. Elements with many holders are dealt to several tasks.
6. Components of all links by the large-star / small-star form of union-find, in rounds over the links, until the links
   are stars; nothing of it is collected to the driver.

Sets are made a second time for members of buckets only, from texts that a bitmap of their ids (at most MOST_BITS,
broadcast) has let through before the shuffle. To the driver come counts, that bitmap and the sketch (SLOTS numbers).
Shingles are told apart by 64 bits and sets by 128 bits more: among 10^10 documents two different sets are taken for
equal with a chance of 1e-18, and a shingle of two sets of 1,000 for shared with 1e-13.

The prefix join makes as many rows as pairs pass its bounds. A group whose members are all just below the wanted
similarity to each other has the square of its size of these, which no exact search avoids.

Intermediate tables are checkpointed in the shared folder; a lost executor costs tasks, not the job.

Defined cases: null texts and texts without words have the empty set, are linked with nothing and are kept; a null id
has a null component and is kept; rows with the same id are one document with several texts, linked with all that any
of them is linked with; fewer than five words make one shingle; repeated rows are copies; a similarity that equals the
limit links; a text of any length is shingled whole, in memory of some 50 times its bytes; an empty table gives no
rows; columns that are not named in the arguments are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import cut, map_texts, read, splitmix

BANDS, ROWS = 36, 8
HASHES = BANDS * ROWS
SHINGLE = 5
#: Similarity that links, in hundredths, where the caller names none.
SIMILAR = 85
#: Probability, at most, that two sets of just that similarity share no bucket.
MISSED = 2e-5
#: Counters of the frequency sketch.
SLOTS = 1 << 20
#: Holders of an element that meet all its holders in one task.
HOLDERS = 2048
#: Bits of the bitmap of wanted ids, at most, and for each id.
MOST_BITS, ID_BITS = 1 << 28, 16
#: Bits of one row of it.
BITMAP = 32_768
#: Elements whose permutations are held at once.
ELEMENTS = 32_768

_RNG = np.random.default_rng(20240229)
BYTE_CODES = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PLACES = _RNG.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHORT = _RNG.integers(1, 1 << 63, SHINGLE + 1, dtype=np.uint64)
BASE = 0x9E3779B97F4A7C15
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: dict[str, np.ndarray] = {}


def rows_for(similar: int) -> int:
    """Values of a band: the most with which BANDS bands miss a pair of that similarity (hundredths) with MISSED at most."""
    return max((r for r in range(1, 65) if (1 - (similar / 100) ** r) ** BANDS <= MISSED), default=1)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64 for i < n."""
    if not _POWERS or len(_POWERS["up"]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        with np.errstate(over="ignore"):
            for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
                x = np.full(size, base, np.uint64)
                x[0] = 1
                _POWERS[name] = np.cumprod(x, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def shingles(text: str | None) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes."""
    raw = (text or "").encode().lower()  # bytes: A-Z only
    b = np.frombuffer(raw, np.uint8)
    solid = ~SPACE[b]
    edge = np.flatnonzero(np.diff(solid, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    k = len(starts)
    if not k:
        return np.zeros(0, np.uint64)
    up, down = powers(len(b) + 1)
    with np.errstate(over="ignore"):
        prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(BYTE_CODES[b] * up[:-1], dtype=np.uint64)))
        words = splitmix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))
        n = min(k, SHINGLE)
        s = words[: k - n + 1] * PLACES[0]
        for i in range(1, n):
            s = s + words[i : k - n + 1 + i] * PLACES[i]
        return np.unique(splitmix(s + SHORT[n]))


def signatures(sets: list[np.ndarray], hashes: int = HASHES) -> np.ndarray:
    """SuperMinHash signatures (sets x hashes): step << 32 | fraction; all ones for the empty set."""
    h = np.full((len(sets), hashes), np.iinfo(np.uint64).max, np.uint64)
    flat = h.reshape(-1)
    sizes = np.array([len(s) for s in sets], np.int64)
    x = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    for at in range(0, len(x), ELEMENTS):
        own, e = owner[at : at + ELEMENTS], x[at : at + ELEMENTS]
        own0 = own[0]
        place = np.tile(np.arange(hashes, dtype=np.uint16), (len(e), 1)).reshape(-1)
        row = np.arange(len(e), dtype=np.int64) * hashes
        for j in range(hashes):
            with np.errstate(over="ignore"):
                z = splitmix(e + np.uint64(j) * np.uint64(BASE))
            k = j + ((z & np.uint64(0xFFFFFFFF)) * np.uint64(hashes - j) >> np.uint64(32)).astype(np.int64)
            target = place[row + k].astype(np.int64)
            place[row + k] = place[row + j]
            np.minimum.at(flat, own * hashes + target, np.uint64(j) << np.uint64(32) | z >> np.uint64(32))
            most = h[own0 : own[-1] + 1].max(1) >> np.uint64(32)
            live = most[own - own0] > j
            if not live.all():
                own, e, row = own[live], e[live], row[live]
                if not len(e):
                    break
    return h


def band_keys(h: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key of each band of each signature."""
    with np.errstate(over="ignore"):
        x = h.reshape(-1, BANDS, rows)
        acc = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * np.uint64(BASE)
        for i in range(rows):
            acc = splitmix(acc ^ x[:, :, i])
        return acc.view(np.int64)


def describe(texts: list[str | None], rows: int = ROWS) -> dict[str, list]:
    """n: set size; h1, h2: 128 bits of the set; bands: bucket keys."""
    sets = [shingles(t) for t in texts]
    keys = band_keys(signatures(sets, BANDS * rows), rows)
    with np.errstate(over="ignore"):
        h1 = [splitmix(s).sum(dtype=np.uint64).view(np.int64) for s in sets]
        h2 = [np.bitwise_xor.reduce(splitmix(s + np.uint64(BASE))).view(np.int64) for s in sets]
    return {"n": [len(s) for s in sets], "h1": h1, "h2": h2, "bands": list(keys)}


def flagged(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs with __hit: false only where doc_id isn't in ids, by a broadcast bitmap (or null)."""
    rows = max(1, -(-min(MOST_BITS, ID_BITS * ids.count()) // BITMAP))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(rows * BITMAP))
    row, bit = F.floor(place / BITMAP).cast("int"), (place % BITMAP).cast("int")
    maps = ids.groupBy(row.alias("__row")).agg(F.bitmap_construct_agg(place % BITMAP).alias("__map"))
    byte = F.conv(F.hex(F.substring("__map", F.floor(F.col("__bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.floor(byte / F.pow(F.lit(2), F.col("__bit") % 8)) % 2 == 1, F.lit(False))
    out = docs.withColumns({"__row": row, "__bit": bit}).join(F.broadcast(maps), "__row", "left")
    return out.withColumn("__hit", hit & (F.spark_partition_id() >= 0)).drop("__row", "__bit", "__map")  # not deterministic: joins stay above it


def among(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is in ids; most others don't reach the shuffle of the join."""
    return flagged(docs, ids).where("__hit").drop("__hit").join(ids, "doc_id", "left_semi")


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id isn't in ids; only those that the bitmap can't tell are shuffled."""
    x = flagged(docs, ids)
    return x.where("NOT __hit").drop("__hit").union(x.where("__hit").drop("__hit").join(ids, "doc_id", "left_anti"))


def sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id and set for the documents in ids."""
    return map_texts(among(docs, ids), ["doc_id"], "set array<long>", lambda texts: {"set": [shingles(t).view(np.int64) for t in texts]})


def linked(a: DataFrame | str, b: str, similar: int = SIMILAR):
    """Whether two sets are similar enough, on their full content."""
    both = F.size(F.array_intersect(a, b))
    return F.lit(100) * both >= F.lit(similar) * (F.size(a) + F.size(b) - both)


def verify(sets: DataFrame, pairs: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """The pairs (a, b) whose full sets (doc_id, set) are similar enough."""
    x = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("set").alias("sa")), "a")
    x = x.join(sets.select(F.col("doc_id").alias("b"), F.col("set").alias("sb")), "b")
    return x.where(linked("sa", "sb", similar)).select("a", "b")  # no distinct: it would keep a hot b in one task


def components(links: DataFrame) -> DataFrame:
    """id and component (smallest id) of every id in links (a, b)."""
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        # stars already: every node has one smaller neighbour, which has none itself
        many = edges.groupBy("u").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).where("lo <> hi")
        if many.isEmpty() and edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
        # large star: the larger neighbours of a node go to the smallest of its neighbourhood
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        edges = cut(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        # small star: a node and its smaller neighbours go to the smallest of them
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        hung = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = cut(hung.union(least.select("u", F.col("m").alias("v"))).distinct())


def slots(s: np.ndarray) -> np.ndarray:
    return (s.view(np.uint64) % np.uint64(SLOTS)).astype(np.int64)


def sketch(sets: DataFrame) -> np.ndarray:
    """Elements by slot: how often the elements of a slot are in sets, all together."""

    def run(batches):
        n = np.zeros(SLOTS, np.int64)
        for b in batches:
            n += np.bincount(slots(b.column(0).flatten().to_numpy(zero_copy_only=False)), minlength=SLOTS)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], ["slot", "n"])

    got = sets.select("set").mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SLOTS, np.int64)
    out[got.column("slot").to_numpy()] = got.column("n").to_numpy()
    return out


def prefix(s: np.ndarray, frequency: np.ndarray, similar: int) -> np.ndarray:
    """The elements, rarest first, of which a set of the wanted similarity has one."""
    order = np.lexsort((s, frequency[slots(s)]))
    return s[order[: len(s) - -(-similar * len(s) // 100) + 1]]


def prefixes(sets: DataFrame, frequency: np.ndarray, similar: int) -> DataFrame:
    """element, id, component, n (set size) and rest (elements from this one on) for each element of each prefix."""
    sent = sets.sparkSession.sparkContext.broadcast(frequency)
    kind = dict(sets.dtypes)["id"]
    schema = StructType.fromDDL(f"element long, id {kind}, component {kind}, n int, rest int")

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for b in batches:
            own = [prefix(s.values.to_numpy(zero_copy_only=False), sent.value, similar) for s in b.column(2)]
            k = np.array([len(x) for x in own], np.int64)
            if not k.sum():
                continue
            n = pc.list_value_length(b.column(2)).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(k)), k)
            place = np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k)
            cols = [pa.array(np.concatenate(own)), b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), pa.array(n[row]), pa.array(n[row] - place)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, arrow)], schema=arrow)

    return sets.select("id", "component", "set").mapInArrow(run, schema)


def close(named: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """Pairs (a, b) of sets (id, component, set) in different components that the bounds of the prefix join let pass."""
    rows = cut(prefixes(named, sketch(named), similar))
    holders = rows.groupBy("element").agg(F.count("*").alias("k"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    holders = holders.select("element", F.ceil(F.col("k") / HOLDERS).cast("int").alias("shares"))
    dealt = rows.join(holders, "element")
    one = dealt.select("element", F.pmod(F.xxhash64("id"), F.col("shares")).cast("int").alias("share"), F.col("id").alias("a"), F.col("component").alias("ca"), F.col("n").alias("na"), F.col("rest").alias("ra"))
    other = dealt.select("element", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.col("id").alias("b"), F.col("component").alias("cb"), F.col("n").alias("nb"), F.col("rest").alias("rb"))
    most = F.least("ra", "rb")
    fits = F.lit(100) * most >= F.lit(similar) * (F.col("na") + F.col("nb") - most)  # holds for the first element shared, if the sets are close
    pairs = one.join(other, ["element", "share"]).where((F.col("a") > F.col("b")) & (F.col("ca") != F.col("cb")) & fits)
    return pairs.select("a", "b").distinct()


def rest(sets: DataFrame, members: DataFrame, comps: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """Links between members of a bucket that were not paired with its smallest member and are in different components."""
    named = members.where("rep <> center").join(comps.withColumnRenamed("id", "rep"), "rep", "left").select("bucket", "rep", F.coalesce("component", "rep").alias("component"))
    named = cut(named)
    mixed = named.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("bucket")
    open_ = named.join(mixed, "bucket", "left_semi").groupBy("rep").agg(F.min("component").alias("component"))
    open_ = cut(open_.select(F.col("rep").alias("doc_id"), "component").join(sets, "doc_id").select(F.col("doc_id").alias("id"), "component", "set"))
    return verify(sets, cut(close(open_, similar)), similar)


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: int = SIMILAR) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs; similar: hundredths of similarity that link."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    width = rows_for(similar)
    rows = cut(map_texts(docs, ["doc_id"], "n long, h1 long, h2 long, bands array<long>", lambda texts: describe(texts, width)))
    full = rows.where("n > 0 AND doc_id IS NOT NULL")
    classes = full.groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("rep"), F.min("bands").alias("bands"))
    classes = cut(classes)
    exploded = classes.select("rep", F.explode("bands").alias("bucket"))
    centers = exploded.groupBy("bucket").agg(F.min("rep").alias("center"), F.max("rep").alias("far")).where("center <> far").drop("far")
    members = cut(exploded.join(centers, "bucket"))
    sets = cut(sets_of(docs, cut(members.select(F.col("rep").alias("doc_id")).distinct())))
    pairs = cut(members.where("rep <> center").select(F.col("rep").alias("a"), F.col("center").alias("b")).distinct())
    links = cut(verify(sets, pairs, similar))
    comps = components(links)
    more = cut(rest(sets, members, comps, similar))
    # an id with several texts joins their classes
    several = full.join(classes.select("n", "h1", "h2", "rep"), ["n", "h1", "h2"]).select("doc_id", "n", "rep")
    several = cut(several)
    twice = several.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b")
    joined = several.join(twice.select("doc_id"), "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    extra = cut(more.union(joined))
    if not extra.isEmpty():
        comps = components(links.union(extra))
    comps = cut(comps)
    found = several.join(comps.withColumnRenamed("id", "rep"), "rep", "left").select("doc_id", "n", F.coalesce("component", "rep").alias("component_id"))
    alone = rows.where("n = 0 OR doc_id IS NULL").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    out = found.unionByName(alone)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: the near-duplicate groups of all documents."""
    return groups(read(spark, sf_dir, "documents"))


#: All pairs that share a shingle, and components by transitive closure: exact, and fit for small tables only.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
reach AS (SELECT doc_id, doc_id AS c FROM w UNION SELECT b, c FROM reach JOIN links ON a = doc_id)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, c AS component_id, w.doc_id = c AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN (SELECT doc_id, min(c) AS c FROM reach GROUP BY 1) r ON r.doc_id = w.doc_id
"""
