"""Toxicity by maximum-scoring segment search.

Words and word beginnings get log-odds of toxic against clean documents with an informative Dirichlet prior (the
pooled frequencies, PRIOR counts strong, LEAST_PRIOR for each unit at least); those that are in more toxic documents
than chance explains, at a false discovery rate of FALSE_SHARE over all units, keep their log-odds if they are
LEAST_ODDS or more, every other word costs DRIFT. A linear-time scan (Ruzzo and Tompa) finds all maximal scoring segments of a document. In clean
text the number of segments scoring S or more is about K n exp(-lambda S) for n words; lambda solves
sum p exp(lambda s) = 1 over the clean word frequencies and K is counted on clean training documents. A segment is
significant if that number is below E_VALUE. A document's evidence is the sum of lambda S - ln(K n) over its
significant segments, turned into a score by a logistic regression on the training documents.

Learning takes at most SAMPLE labelled documents, one of each group with the same smallest 5-word shingle (so that
copies don't make a vocabulary of their own). Word counts are made on the executors; the significant units, bounded
by the sample, come to the driver and are broadcast. Scoring is row by row: no shuffle, no state.

Defined cases: null and empty texts have no segments and get the score of no evidence; without labels, or with one
class only, no unit is significant and every score is the share of toxic documents (0 without labels); a label that is
null, or of a null id, isn't learnt from, and an id with several labels counts as the highest; a text of any length is
scanned whole, in memory in proportion to its words; units of equal significance rank by their text, and segments of
equal score are all kept; repeated rows are scored each for themselves; an empty table gives no rows; columns that are
not named in the arguments are ignored, whatever their names; a name in keep that the result has already is refused.
"""

from __future__ import annotations

import math
import re
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, labelled_sample, logistic, map_texts, read, remainder

SAMPLE = 12_000
PRIOR = 1_000.0
LEAST_PRIOR = 0.5
FALSE_SHARE = 0.1
#: Toxic documents that a unit must be in.
LEAST_DOCS = 3
LEAST_ODDS = 1.5
DRIFT = -0.08
E_VALUE = 0.05
POSITIVE = 0.7
#: Word beginnings that are units besides whole words, marked with a star.
STEMS = (4, 5, 6, 7, 8)
#: Words whose score a worker remembers.
CACHE = 500_000

words_of = re.compile(r"[^\W\d_]+").findall


def units(word: str) -> list[str]:
    """The units of a word, the most specific first."""
    return [word, *(f"{word[:n]}*" for n in reversed(STEMS) if len(word) >= n)]


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments as (start, end, score), end exclusive, in linear time (Ruzzo and Tompa 1999)."""
    out: list[list] = []  # start, end, cumulative score before it, cumulative score at its end
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        new = [i, i + 1, before, total]
        while True:
            j = len(out) - 1
            # segments whose start lies higher than new's can't be extended to the left by it: look further
            while j >= 0 and out[j][2] >= new[2]:
                j = out[j][4]
            if j < 0 or out[j][3] >= new[3]:
                new.append(j)
                out.append(new)
                break
            new = [out[j][0], new[1], out[j][2], new[3]]
            del out[j:]
    return [(a, b, r - left) for a, b, left, r, _ in out]


class Memo(dict):
    """Values of a function, each computed once."""

    def __init__(self, fn):
        super().__init__()
        self.fn = fn

    def __missing__(self, key):
        value = self[key] = self.fn(key)
        return value


class Model:
    def __init__(self, weights: dict[str, float], lam: float = 1.0, k: float = 1.0, calibration: np.ndarray | None = None, share: float = 0.0):
        self.weights, self.lam, self.k, self.calibration, self.share = weights, lam, k, calibration, share

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "known"}

    def score_of(self, word: str) -> float:
        """Log-odds of a word: of its most specific significant unit, else 0 (a drift word)."""
        return next((s for u in units(word) if (s := self.weights.get(u)) is not None), 0.0)

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        """Number of words, and the maximal segments in word positions."""
        words = words_of(text.lower()) if text else []
        known = self.__dict__.get("known")
        if known is None or len(known) > CACHE:
            known = self.known = Memo(self.score_of)
        hits = [(i, s) for i, s in enumerate(map(known.__getitem__, words)) if s]
        if not hits:
            return len(words), []
        runs, spans, at = [], [], 0  # words between hits count as one run
        for i, s in hits:
            if i > at:
                runs.append(DRIFT * (i - at))
                spans.append((at, i))
            runs.append(s)
            spans.append((i, i + 1))
            at = i + 1
        return len(words), [(spans[a][0], spans[b - 1][1], s) for a, b, s in segments(runs)]

    def passages(self, text: str | None) -> tuple[list[tuple[int, int, float, float]], float]:
        """Significant segments as (start, end, score, expected number), and the evidence."""
        n, found = self.scan(text)
        out, evidence = [], 0.0
        for a, b, s in found:
            x = self.lam * s - math.log(self.k * max(n, 1))
            if (e := math.exp(-x) if x > -700 else math.inf) < E_VALUE:
                out.append((a, b, s, e))
                evidence += x
        return out, evidence

    def probability(self, evidence: float, passages: int) -> float:
        if self.calibration is None:
            return self.share
        z = float(self.calibration @ [math.log1p(evidence), math.log1p(passages), 1.0])
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))

    def predict(self, texts: list[str | None]) -> dict[str, list]:
        out: dict[str, list] = {"score": [], "predicted": [], "evidence": [], "passages": []}
        for t in texts:
            found, evidence = self.passages(t)
            p = self.probability(evidence, len(found))
            out["score"].append(p)
            out["predicted"].append(int(p >= POSITIVE))
            out["evidence"].append(evidence)
            out["passages"].append([{"start": a, "end": b, "score": s, "expected": e} for a, b, s, e in found])
        return out


PREDICTED = "score double, predicted int, evidence double, passages array<struct<start:int,end:int,score:double,expected:double>>"


def shape(text: str | None) -> tuple[list[str], str, int]:
    """Distinct units, the smallest 5-word shingle's hash as text, and the number of words."""
    words = words_of((text or "").lower())
    first = min((crc32(" ".join(words[i : i + 5]).encode()) for i in range(max(1, len(words) - 4))), default=0)
    return sorted({u for w in set(words) for u in units(w)}), f"{first}", len(words)


def log_tail(a: int, n: int, share: float) -> float:
    """The logarithm of the chance of a or more in n independent cases of chance `share` each; 0 up to the expected number."""
    if a <= n * share:
        return 0.0
    if share <= 0:
        return -math.inf
    first = math.lgamma(n + 1) - math.lgamma(a + 1) - math.lgamma(n - a + 1) + a * math.log(share) + (n - a) * math.log1p(-share)
    total = term = 1.0
    for k in range(a, n):  # terms fall from here on
        term *= (n - k) / (k + 1) * share / (1 - share)
        total += term
        if term < 1e-17 * total:
            break
    return first + math.log(total)


def significant(rows: list, tested: int, share: float) -> list:
    """Rows (unit, a toxic documents, b clean ones) that pass the Benjamini-Hochberg procedure among `tested` units."""
    memo = Memo(lambda ab: log_tail(ab[0], sum(ab), share))
    ranked = sorted(rows, key=lambda r: (memo[r["a"], r["b"]], r["unit"]))
    limit = lambda i: math.log(FALSE_SHARE * i / max(1, tested))
    last = max((i for i, r in enumerate(ranked, 1) if memo[r["a"], r["b"]] <= limit(i)), default=0)
    return ranked[:last]


def train(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic") -> Model:
    """docs: doc_id and text; labels: doc_id and label."""

    def run(texts):
        got = [shape(t) for t in texts]
        return {"units": [g[0] for g in got], "same": [g[1] for g in got], "n": [g[2] for g in got]}

    sample = map_texts(labelled_sample(docs, labels, label, SAMPLE, learn, "toxicity").withColumn("t", F.col("text")), ["doc_id", "label", "t"], "units array<string>, same string, n long", run)
    one = F.row_number().over(W.partitionBy("same").orderBy("doc_id"))
    sample = cut(sample.withColumn("one", one).where("one = 1").drop("one", "same"))
    bad = F.col("label") > 0
    sizes = sample.agg(F.count("*").alias("n"), F.sum(bad.cast("int")).alias("toxic"), F.sum(F.size("units")).alias("units"), F.sum(F.when(bad, F.size("units"))).alias("toxic_units"), F.sum("n").alias("words")).first()
    docs_n, toxic_n = sizes["n"], sizes["toxic"] or 0
    if not toxic_n or toxic_n == docs_n:
        return Model({}, share=toxic_n / docs_n if docs_n else 0.0)
    counts = sample.select(F.explode("units").alias("unit"), bad.cast("int").alias("bad")).groupBy("unit").agg(F.sum("bad").alias("a"), F.sum(1 - F.col("bad")).alias("b")).where(F.col("a") + F.col("b") >= LEAST_DOCS)
    na, nb = float(sizes["toxic_units"]), float(sizes["units"] - sizes["toxic_units"])
    prior = F.lit(LEAST_PRIOR) + F.lit(PRIOR) * (F.col("a") + F.col("b")) / (na + nb)
    odds = lambda y, n: F.log((F.col(y) + prior) / (n + PRIOR - F.col(y) - prior))
    counts = cut(counts.withColumn("s", odds("a", na) - odds("b", nb)))
    tested = counts.count()
    chosen = significant(counts.where((F.col("a") >= LEAST_DOCS) & (F.col("s") >= LEAST_ODDS)).collect(), tested, na / (na + nb))
    model = Model({r["unit"]: float(r["s"]) for r in chosen}, share=toxic_n / docs_n)
    # lambda over the clean word frequencies: drift words, and each unit as often as in clean documents (half a time at least)
    total = float(max(sizes["words"], 1))
    rare = [(r["b"] + 0.5) / total for r in chosen]
    rise = lambda lam: (1 - sum(rare)) * math.exp(lam * DRIFT) + sum(p * math.exp(min(700.0, lam * r["s"])) for p, r in zip(rare, chosen)) - 1
    low, high = 0.0, 5.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if rise(mid) < 0 else (low, mid)
    model.lam = max(low, 0.05)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def tops(texts):
        got = [sent.value.scan(t) for t in texts]
        return {"words": [n for n, _ in got], "scores": [[s for _, _, s in found] for _, found in got]}

    rows = map_texts(sample, ["doc_id", "label"], "words long, scores array<double>", tops, "t").collect()
    least = min(model.weights.values(), default=1.0)
    clean = [r for r in rows if not r["label"] > 0]
    passed = sum(s >= least for r in clean for s in r["scores"]) + 0.5
    model.k = min(1.0, passed / (max(1, sum(r["words"] for r in clean)) * math.exp(-model.lam * least)))
    x, y = [], []
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        found = [v for s in r["scores"] if (v := model.lam * s - math.log(model.k * max(r["words"], 1))) > -math.log(E_VALUE)]
        x.append([math.log1p(sum(found)), math.log1p(len(found))])
        y.append(float(r["label"] > 0))
    model.calibration = logistic(np.array(x), np.array(y))
    return model


def score(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """keep, score, predicted, evidence and passages (word positions, score, expected number) for every row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return map_texts(docs, keep, PREDICTED, lambda texts: sent.value.predict(texts), text_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: the toxicity of every document."""
    docs, held = read(spark, sf_dir, "documents"), remainder("doc_id", 3) == 1
    model = train(docs, read(spark, sf_dir, "labels"), ~held)
    out = score(docs.withColumn("held_out", held), model, ["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "score", "predicted", "evidence", F.size("passages").cast("long").alias("n_passages"))
