"""Quality classifier: histogram gradient-boosted trees over document statistics.

Each text gives FEATURES numbers (statistics() below). Trees are grown on at most SAMPLE labelled documents: features
are cut into BINS ranges at their quantiles, and each level of a tree takes, for every node, the cut with the largest
gain from histograms of gradients and hessians of the logistic loss. All trees have DEPTH levels and are stored as
flat arrays (feature and threshold of node i, whose children are 2i+1 and 2i+2; one value per leaf), so that scoring
is DEPTH array steps over documents x trees.

Scoring is row by row, in Arrow batches, from a broadcast model of a few hundred KB. Nothing is shuffled but the
labelled sample.

Defined cases: null and empty texts get the statistics of the empty text and a score like any other; with no labels,
or one class only, the score is the share of that class (0.5 without labels); of cuts with equal gain the first feature's
first is taken, and a value equal to a threshold goes left; a text of any length gives its numbers in time and memory in
proportion to it; repeated rows are scored each for themselves; an empty table gives no rows; columns that are not named
in the arguments are ignored, whatever their names; a name in keep that the result has already is refused.
"""

from __future__ import annotations

import math
import string

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import labelled_sample, map_texts, read, remainder
from .linefirst import repeated_words

SAMPLE = 6_000
TREES = 80
DEPTH = 4
BINS = 64
RATE = 0.15
#: Added to the hessians of a leaf.
RIDGE = 1.0
LEAST_HESSIAN = 2.0
POSITIVE = 0.7

MARKS = string.punctuation.encode()
FEATURES = (
    "log_words", "log_bytes", "log_lines", "word_bytes", "words_a_line", "mark_share", "bang_share", "bar_share",
    "symbol_share", "digit_share", "upper_share", "wide_share", "distinct_share", "repeat_share", "echo_share",
    "ended_share", "dup_line_share", "short_share", "long_share", "first_line_words",
)


def _count(raw: bytes, what: bytes) -> int:
    return len(raw) - len(raw.translate(None, what))


def statistics(text: str | None) -> list[float]:
    """The FEATURES of a text."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    n = max(1, len(words))
    solid = max(1, sum(map(len, words)))
    lines = [x for x in text.split("\n") if x.strip()]
    m = max(1, len(lines))
    upper = sum(map(str.isupper, text)) if raw.upper() == raw else _count(raw, string.ascii_uppercase.encode())
    lengths = list(map(len, words))
    return [
        math.log1p(len(words)), math.log1p(len(raw)), math.log1p(len(lines)), solid / n, n / m, _count(raw, MARKS) / solid,
        raw.count(b"!") / solid, raw.count(b"|") / solid, _count(raw, b"#*$%&<>@^~=_") / solid, _count(raw, b"0123456789") / solid,
        upper / solid, 1 - len(text) / max(1, len(raw)), len(set(words)) / n, repeated_words(words) / n,
        sum(map(bytes.__eq__, words, words[1:])) / n, sum(x.rstrip().endswith((".", "!", "?", "\"", ":", ";")) for x in lines) / m,
        1 - len(set(lines)) / m if lines else 0.0, sum(x < 3 for x in lengths) / n, sum(x > 12 for x in lengths) / n,
        len(lines[0].split()) if lines else 0,
    ]


class Trees:
    """A boosted ensemble; see the module's text."""

    def __init__(self, base: float):
        self.base = base
        self.feature = np.zeros((0, 2**DEPTH - 1), np.int64)
        self.threshold = np.zeros((0, 2**DEPTH - 1))
        self.leaf = np.zeros((0, 2**DEPTH))

    def raw(self, x: np.ndarray) -> np.ndarray:
        rows, trees = np.arange(len(x))[:, None], np.arange(len(self.leaf))[None, :]
        node = np.zeros((len(x), len(self.leaf)), np.int64)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.threshold[trees, node])
        return self.base + self.leaf[trees, node - (2**DEPTH - 1)].sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Trees:
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    model = Trees(math.log(share / (1 - share)))
    if len(np.unique(y)) < 2:
        return model
    n, k = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(k)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(k)], 1)
    flat = binned + np.arange(k)[None, :] * BINS
    value = np.full(n, model.base)
    inner = 2**DEPTH - 1
    features, thresholds, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-value))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for depth in range(DEPTH):
            first, width = 2**depth - 1, 2**depth
            cell = ((node - first)[:, None] * (k * BINS) + flat).reshape(-1)
            sums = [np.bincount(cell, np.repeat(v, k), width * k * BINS).reshape(width, k, BINS) for v in (g, h)]
            gl, hl = (s.cumsum(2) for s in sums)
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gr, hr = gt - gl, ht - hl
            gain = gl**2 / (hl + RIDGE) + gr**2 / (hr + RIDGE) - gt**2 / (ht + RIDGE)
            gain[(hl < LEAST_HESSIAN) | (hr < LEAST_HESSIAN)] = -1
            best = gain.reshape(width, -1).argmax(1)
            for i in range(width):
                j, b = divmod(int(best[i]), BINS)
                if gain[i, j, b] > 1e-6 and b < len(edges[j]):
                    feature[first + i], threshold[first + i] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        own = node - inner
        leaf = -RATE * np.bincount(own, g, inner + 1) / (np.bincount(own, h, inner + 1) + RIDGE)
        value = value + leaf[own]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(leaf)
    model.feature, model.threshold, model.leaf = np.stack(features), np.stack(thresholds), np.stack(leaves)
    return model


def train(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality") -> Trees:
    """docs: doc_id and text; labels: doc_id and label. Collects SAMPLE x FEATURES numbers."""
    sample = labelled_sample(docs, labels, label, SAMPLE, learn, "quality")
    got = map_texts(sample, ["doc_id", "label"], "x array<double>", lambda texts: {"x": [statistics(t) for t in texts]})
    rows = sorted((r["doc_id"], r["label"], tuple(r["x"])) for r in got.collect())
    return fit(np.array([r[2] for r in rows]).reshape(-1, len(FEATURES)), np.array([r[1] > 0 for r in rows], float))


def score(docs: DataFrame, model: Trees, keep: list[str], text_col: str = "text") -> DataFrame:
    """keep, score and predicted for every row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts):
        s = sent.value.score(np.array([statistics(t) for t in texts]))
        return {"score": s, "predicted": (s >= POSITIVE).astype(np.int32)}

    return map_texts(docs, keep, "score double, predicted int", run, text_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: the quality of every document."""
    docs, held = read(spark, sf_dir, "documents"), remainder("doc_id", 4) == 2
    model = train(docs, read(spark, sf_dir, "labels"), ~held)
    return score(docs.withColumn("held_out", held), model, ["doc_id", "held_out"])
