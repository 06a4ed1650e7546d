"""Phrase collocations by contiguous pattern growth over projected occurrences (PrefixSpan for neighbouring words).

Everything is per language. A word is known by a 64-bit hash of its language and itself.

1. Words are counted. Their hashes are compared with their texts; should two words share a hash, all is done again under
   another seed, so counts are exact.
2. Prefixes: pairs of neighbouring words that both occur LEAST times (a bitmap of these words, of at most MOST_BITS bits,
   is broadcast) are counted in four times as many buckets as there are words. A prefix can be frequent only if its
   bucket is; a bitmap of these buckets is broadcast. What a bitmap lets through in error is counted and found too rare.
3. Projection: every occurrence of such a prefix sends what follows it, up to LONGEST words, and no further than a pair
   whose bucket is rare: nothing longer can be frequent there. Equal ones of a chunk are counted before they move.
4. Growth: one task gets all that follows a prefix, in the order of the words that follow, and extends it to the right,
   depth first: all occurrences of an extension are neighbours, so its count is the length of a run, and only the
   current run of each depth is held. A prefix with more than a task's share of all occurrences is divided by its next
   word, and its own count summed over these; fewer than SHARES prefixes for each partition can be so frequent.
5. Scores and drops are joins over the frequent phrases. Sums and products are decimals of 38 digits.

Defined cases: a null text is empty, a null language `und`; a piece of one word gives no phrase; overlapping occurrences
all count; repeated rows count each; texts of any length are read in chunks of CHUNK bytes, over whose borders the last
words are carried; equal scores and counts are ordered by the phrase's bytes; an empty table gives no rows; columns that
are not named are ignored, whatever their names. Everything that is read twice is checkpointed in the shared folder.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, pieces, prepare, read, splitmix

#: Occurrences of a candidate, at least, its words at most, and rows of a language's result.
LEAST, LONGEST, MOST = 30, 4, 2000
#: Factor of the score, and the share (hundredths) of a phrase's occurrences inside a longer one from which it is dropped.
FACTOR, INSIDE = 2_000_000, 80
UNKNOWN = "und"
#: Bytes that are tokenised at once, and words of a language, and languages, that a worker keeps with hashes or counts.
CHUNK, WORDS, LANGS = 4 << 20, 1 << 19, 16
#: Bits of the bitmap of frequent words or pairs, at most, and for each of them; bits of one row of it.
MOST_BITS, ID_BITS, BITMAP = 1 << 28, 64, 32_768
#: Prefixes that may have more than their share, for each partition.
SHARES = 8

# Fixed values of the contract: the characters that end a piece; each becomes a line feed, and tabs become spaces. A-Z
# are lower-cased, so an upper-case letter can stand for the border of pieces.
BREAK = b"A"
_LETTERS = bytes(range(65, 91))
_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
TABLE = bytes.maketrans(_LETTERS + _ENDS + b"\t", _LETTERS.lower() + b"\n" * len(_ENDS) + b" ")


def words(raw: bytes) -> list[bytes]:
    """The words of a text with BREAK between pieces."""
    return raw.translate(TABLE).replace(b"\n", b" " + BREAK + b" ").split()


def chunks(raw: bytes, most: int = CHUNK):
    """raw in parts that end before a space, tab or line feed, or where raw ends."""
    at = 0
    while len(raw) - at > most:
        end = min((x for x in (raw.find(s, at + most) for s in (b" ", b"\t", b"\n")) if x >= 0), default=len(raw))
        yield raw[at:end]
        at = end
    yield raw[at:]


class Ids(dict):
    """Hashes of the words of one language; 0 for BREAK and for what isn't in `only`, as no phrase goes across either."""

    def __init__(self, lang: str, seed: int, only: Bits | None = None):
        super().__init__()
        self.key, self.only = hashlib.blake2b(f"{seed}:{lang}".encode(), digest_size=16).digest(), only

    def __missing__(self, word: bytes) -> int:
        x = 0 if word == BREAK else int.from_bytes(hashlib.blake2b(word, digest_size=8, key=self.key).digest(), "little") or 1
        if x and self.only is not None and not self.only.has_one(x):
            x = 0
        self[word] = x
        return x


def _texts(batches):
    """(language, texts as bytes) of parts of Arrow batches."""
    for whole in batches:
        text = whole.column("text").cast(pa.binary())
        sizes = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)
        for a, b in pieces(sizes) if whole.num_rows else ():
            by: dict[str, list] = {}
            for lang, t in zip(whole.column("lang").slice(a, b - a).to_pylist(), text.slice(a, b - a).to_pylist()):
                if t:
                    by.setdefault(lang, []).append(t)
            yield from by.items()


def _streams(batches, seed: int, only: Bits):
    """(ids, whole): hashes of words in order, 0 for borders and rare words; whole: nothing is carried to the next one."""
    known: dict[str, Ids] = {}
    for lang, texts in _texts(batches):
        if lang not in known and len(known) >= LANGS:
            known.clear()
        ids = known.setdefault(lang, Ids(lang, seed, only))
        for part in chunks((b"\n").join(texts)):
            if len(ids) > WORDS:
                ids.clear()
            ws = words(part)
            yield np.fromiter(map(ids.__getitem__, ws), np.uint64, len(ws)), False
        yield np.zeros(LONGEST, np.uint64), True


def windows(batches, seed: int, only: Bits, width: int):
    """(x, n): hashes in order, of which the first n begin runs of `width` neighbours; every word begins one once."""
    left = np.zeros(0, np.uint64)
    for got, whole in _streams(batches, seed, only):
        x = np.concatenate((left, got))
        n = max(0, len(x) - width + 1)
        if n:
            yield x, n
        left = np.zeros(0, np.uint64) if whole else x[n:]


class Bits:
    """A bitmap of 64-bit hashes, as rows of BITMAP bits; it may say yes in error, never no."""

    def __init__(self, spark: SparkSession, hashes: DataFrame, n: int):
        self.rows = max(1, -(-min(MOST_BITS, ID_BITS * n) // BITMAP))
        place = F.pmod(F.col("hash"), F.lit(self.rows * BITMAP))
        got = hashes.groupBy(F.floor(place / BITMAP).cast("int").alias("row")).agg(F.bitmap_construct_agg((place % BITMAP).cast("int")).alias("map"))
        bits = np.zeros((self.rows, BITMAP // 8), np.uint8)
        for r in got.toLocalIterator():  # at most MOST_BITS bits
            bits[r["row"]] = np.frombuffer(r["map"], np.uint8)
        self.sent = spark.sparkContext.broadcast(bits.reshape(-1))

    def has(self, hashes: np.ndarray) -> np.ndarray:
        place = np.mod(hashes.view(np.int64), self.rows * BITMAP)
        return (self.sent.value[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)


    def has_one(self, x: int) -> bool:
        place = (x - (x >> 63 << 64)) % (self.rows * BITMAP)
        return bool(self.sent.value[place >> 3] >> (place & 7) & 1)


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return splitmix(a * np.uint64(0x9E3779B97F4A7C15) + b)


def count_words(rows: DataFrame, seed: int) -> DataFrame:
    """id, lang, word, n of every word of rows (lang, text)."""

    def run(batches):
        held: dict[str, Counter] = {}

        def out(lang, n):
            ids = Ids(lang, seed)
            hashes = np.fromiter(map(ids.__missing__, n), np.uint64, len(n)).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(hashes), pa.array([lang] * len(n)), pa.array([w.decode() for w in n]), pa.array(list(n.values()), "int64")], names=["id", "lang", "word", "n"])

        for lang, texts in _texts(batches):
            if lang not in held and len(held) >= LANGS:
                yield from (out(x, c) for x, c in held.items() if c)
                held.clear()
            n = held.setdefault(lang, Counter())
            for part in chunks((b"\n").join(texts)):
                n.update(words(part))
                n.pop(BREAK, None)
                if len(n) > WORDS:
                    yield out(lang, n)
                    n.clear()
        for lang, n in held.items():
            if n:
                yield out(lang, n)

    return rows.mapInArrow(run, "id long, lang string, word string, n long").groupBy("id", "lang", "word").agg(F.sum("n").alias("n"))


def bucket(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """The bucket, of 2^bits, of a pair of neighbours."""
    return (pair_hash(a, b) >> np.uint64(64 - bits)).view(np.int64)


def count_buckets(rows: DataFrame, seed: int, frequent: Bits, bits: int) -> DataFrame:
    """bucket, n: how many pairs of frequent neighbours fall into each bucket."""

    def run(batches):
        for x, n in windows(batches, seed, frequent, 2):
            both = (x[:n] != 0) & (x[1:] != 0)
            yield pa.RecordBatch.from_arrays([pa.array(bucket(x[:n][both], x[1:][both], bits))], names=["bucket"])

    return rows.mapInArrow(run, "bucket long").groupBy("bucket").agg(F.count("*").alias("n"))


def project(rows: DataFrame, seed: int, frequent: Bits, pairs: Bits, hot: np.ndarray, bits: int) -> DataFrame:
    """w1 to w4, hot and n: each prefix (w1, w2) in a frequent bucket with the words that follow, w3 and w4, or 0.

    Equal rows of a chunk are counted together. hot: the prefix's bucket is among those with more than their share.
    """

    def run(batches):
        for x, n in windows(batches, seed, frequent, LONGEST):
            both = np.flatnonzero((x[:-1] != 0) & (x[1:] != 0))
            own = bucket(x[both], x[both + 1], bits)
            there = pairs.has(own)
            ok, first = np.zeros(len(x), bool), np.zeros(len(x), np.int64)
            ok[both], first[both] = there, own
            at = np.flatnonzero(ok[:n])
            a, b, first = x[at], x[at + 1], first[at]
            c = np.where(ok[at + 1], x[at + 2], np.uint64(0))
            d = np.where(ok[at + 1] & ok[at + 2], x[at + 3], np.uint64(0))
            order = np.argsort(pair_hash(pair_hash(a, b), pair_hash(c, d)))
            cols = [x[order] for x in (a, b, c, d)]
            new = np.ones(len(order), bool)
            new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in cols])
            at = np.flatnonzero(new)
            n = np.diff(np.r_[at, len(order)])
            yield pa.RecordBatch.from_arrays([*(pa.array(x[at].view(np.int64)) for x in cols), pa.array(np.isin(first[order][at], hot)), pa.array(n)], names=["w1", "w2", "w3", "w4", "hot", "n"])

    return rows.mapInArrow(run, "w1 long, w2 long, w3 long, w4 long, hot boolean, n long")


def grow(projected: DataFrame, least: int) -> DataFrame:
    """p (array of 2 to 4 hashes) and f of the frequent prefixes and their frequent extensions."""
    parts = int(projected.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = projected.withColumn("by", F.when(F.col("hot"), F.col("w3")).otherwise(0))

    def run(batches):
        runs: dict[int, list] = {}  # by depth: the phrase that grows, its count so far, and whether its prefix is divided

        def step(depth, keys, n, hot):
            """Counts of runs of equal phrases of one depth; the last run stays open."""
            new = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)]) if len(keys) else np.zeros(0, int)
            sums = np.add.reduceat(n, new) if len(new) else np.zeros(0, np.int64)
            keys, hot = keys[new], hot[new]
            if depth in runs and len(keys):
                key, had, was = runs.pop(depth)
                if (key == keys[0]).all():
                    sums[0] += had
                else:
                    keys, sums, hot = np.vstack((key[None], keys)), np.r_[had, sums], np.r_[was, hot]
            if len(keys):
                runs[depth] = [keys[-1], int(sums[-1]), bool(hot[-1])]
            return out(depth, keys[:-1], sums[:-1], hot[:-1])

        def out(depth, keys, sums, hot):
            part = hot & (depth == 2)
            ok = part | (sums >= least)
            return pa.RecordBatch.from_arrays([pa.array(list(keys[ok]), pa.list_(pa.int64())), pa.array(sums[ok]), pa.array(part[ok])], names=["p", "f", "part"])

        for b in batches:
            rows = np.stack([b.column(f"w{i}").to_numpy(zero_copy_only=False) for i in range(1, LONGEST + 1)], 1)
            n, hot = (b.column(c).to_numpy(zero_copy_only=False) for c in ("n", "hot"))
            for depth in range(2, LONGEST + 1):
                there = rows[:, depth - 1] != 0
                yield step(depth, rows[there, :depth], n[there], hot[there])
        for depth, (key, had, was) in runs.items():
            yield out(depth, key[None], np.array([had]), np.array([was]))

    x = x.repartition(parts, "w1", "w2", "by").sortWithinPartitions("w1", "w2", "w3", "w4")
    got = cut(x.select("w1", "w2", "w3", "w4", "hot", "n").mapInArrow(run, "p array<long>, f long, part boolean"))
    divided = got.where("part").groupBy("p").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    return got.where("NOT part").select("p", "f").unionByName(divided)


def _frequent(docs: DataFrame, lang_col: str, text_col: str, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frequent words (id, lang, word, n), words of each language (lang, total) and frequent phrases (p, f) of any length."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    seed = 0
    while True:
        counted = cut(count_words(rows, seed))
        if counted.groupBy("id").count().where("count > 1").isEmpty():
            break
        seed += 1  # two words share a hash
    total = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    kept = cut(counted.where(F.col("n") >= least))
    frequent = Bits(spark, kept.select(F.col("id").alias("hash")), kept.count())
    every = counted.agg(F.sum("n")).first()[0] or 0
    bits = min(63, (4 * every).bit_length() + 1)
    found = cut(count_buckets(rows, seed, frequent, bits).where(F.col("n") >= least))
    n, occurrences = found.agg(F.count("*"), F.sum("n")).first()
    pairs = Bits(spark, found.select(F.col("bucket").alias("hash")), n)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = (occurrences or 0) // (SHARES * parts) + 1
    hot = np.array([r[0] for r in found.where(F.col("n") > share).select("bucket").collect()], np.int64)  # fewer than SHARES * parts
    longer = grow(project(rows, seed, frequent, pairs, hot, bits), least)
    one = kept.select(F.array("id").alias("p"), F.col("n").alias("f"))
    return kept, total, cut(one.unionByName(longer))


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(FACTOR a / (left + right)), exact for any counts of 64 bits."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", wide(a) * F.lit(FACTOR).cast("decimal(7,0)"), wide(left) + wide(right))


def mine(docs: DataFrame, least: int = LEAST, most: int = MOST, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: of every language the `most` best collocations."""
    prepare(docs.sparkSession)
    kept, total, f = _frequent(docs, lang_col, text_col, least)
    phrases = f.where(F.size("p") > 1)
    at = F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("k")
    cuts = phrases.select("p", F.col("f").alias("a"), at).withColumns({"first": F.slice("p", F.lit(1), F.col("k")), "rest": F.expr("slice(p, k + 1, size(p) - k)")})
    cuts = cuts.join(f.select(F.col("p").alias("first"), F.col("f").alias("l")), "first").join(f.select(F.col("p").alias("rest"), F.col("f").alias("r")), "rest")
    lowest = F.min(F.struct(score(F.col("a"), F.col("l"), F.col("r")).alias("score"), "k", "l", "r")).alias("x")
    cuts = cuts.groupBy("p", "a").agg(lowest).select("p", "a", "x.l", "x.r", "x.score")
    # contiguous parts of 2 or more words of longer phrases
    parts = F.expr("flatten(transform(sequence(2, size(p) - 1), m -> transform(sequence(1, size(p) - m + 1), i -> slice(p, i, m))))")
    inside = f.where(F.size("p") > 2).select(F.explode(parts).alias("p"), "f").groupBy("p").agg(F.max("f").alias("longer"))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    drop = wide("longer") * F.lit(100).cast("decimal(3,0)") >= wide("a") * F.lit(INSIDE).cast("decimal(3,0)")
    left = cuts.join(inside, "p", "left").where(~F.coalesce(drop, F.lit(False))).drop("longer")
    each = left.select("*", F.posexplode("p").alias("i", "id")).join(kept.select("id", "lang", "word"), "id")
    named = each.groupBy("p", "a", "l", "r", "score").agg(F.min("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("i", "word"))).alias("x"))  # LONGEST rows a group
    named = named.withColumn("phrase", F.array_join(F.transform("x", lambda w: w["word"]), " "))
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = named.select("lang", place.alias("rank"), "phrase", "a", "l", "r", "score").where(F.col("rank") <= most)
    return best.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").cast("long").alias("n"), F.col("score").cast("long").alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: the collocations of each language over all documents."""
    return mine(read(spark, sf_dir, "documents"))


_UP, _LOW = _LETTERS.decode(), _LETTERS.decode().lower()
ORACLE = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '{UNKNOWN}') AS lang, translate(coalesce(text, ''), '{_UP}', '{_LOW}') AS t FROM documents),
piece AS (SELECT d, lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece, generate_subscripts(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]'), 1) AS i FROM docs),
word AS (
  SELECT lang, d, i, unnest(regexp_extract_all(piece, '[^\x20\x09]+')) AS w, generate_subscripts(regexp_extract_all(piece, '[^\x20\x09]+'), 1) AS j FROM piece),
runs AS (SELECT lang, w AS w1, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(w, 3) OVER o AS w4 FROM word WINDOW o AS (PARTITION BY d, i ORDER BY j)),
f AS (
  SELECT lang, [w1] AS p, count(*) AS f FROM runs GROUP BY lang, w1 HAVING count(*) >= {LEAST}
  UNION ALL SELECT lang, [w1, w2], count(*) FROM runs WHERE w2 IS NOT NULL GROUP BY lang, w1, w2 HAVING count(*) >= {LEAST}
  UNION ALL SELECT lang, [w1, w2, w3], count(*) FROM runs WHERE w3 IS NOT NULL GROUP BY lang, w1, w2, w3 HAVING count(*) >= {LEAST}
  UNION ALL SELECT lang, [w1, w2, w3, w4], count(*) FROM runs WHERE w4 IS NOT NULL GROUP BY lang, w1, w2, w3, w4 HAVING count(*) >= {LEAST}),
total AS (SELECT lang, count(*) AS n FROM word GROUP BY lang),
cuts AS (
  SELECT x.lang, x.p, x.f AS a, l.f AS l, r.f AS r, ({FACTOR}::HUGEINT * x.f // (l.f + r.f))::BIGINT AS score, row_number() OVER (PARTITION BY x.lang, x.p ORDER BY {FACTOR}::HUGEINT * x.f // (l.f + r.f), k) AS place
  FROM (SELECT *, unnest(range(1, len(p))) AS k FROM f WHERE len(p) > 1) x
  JOIN f l ON l.lang = x.lang AND l.p = x.p[1:k] JOIN f r ON r.lang = x.lang AND r.p = x.p[k + 1:]),
longer AS (
  SELECT lang, p[i:i + m - 1] AS p, max(f) AS f FROM (SELECT lang, p, f, unnest([2, 2, 2, 3, 3]) AS m, unnest([1, 2, 3, 1, 2]) AS i FROM f) WHERE m < len(p) AND i + m - 1 <= len(p) GROUP BY 1, 2),
kept AS (
  SELECT c.lang, array_to_string(c.p, ' ') AS phrase, c.a, c.l, c.r, c.score FROM cuts c LEFT JOIN longer g ON g.lang = c.lang AND g.p = c.p
  WHERE place = 1 AND NOT coalesce(100::HUGEINT * g.f >= {INSIDE}::HUGEINT * c.a, false))
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT *, (row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase))::INT AS rank FROM kept JOIN total USING (lang)) WHERE rank <= {MOST}
"""
