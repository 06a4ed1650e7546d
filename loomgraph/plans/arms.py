"""Evaluation arms: a parameter sweep on the training split, then metrics, gap precision and intervals on both splits.

An arm ranks the candidates of every description by one scorer. Arms over a graph choose their parameters on the training
split; controls count unmet skills at a flat credit; baselines see skill lists only.
"""

from __future__ import annotations

import json
from dataclasses import replace
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scoring import ScoringParams
from ..operators import evaluation, graph, matching, paths
from ..sources import reports

#: 8 x 3 x 3 x 3 settings; the first of equal ones wins.
GRID = [
    {"cutoff": c, "scale": s, "unreachable": u, "hops": h}
    for c, s, u, h in product((0.2, 0.25, 0.3, 0.35, 0.4, 0.5, 0.6, 0.7), (1.0, 1.5, 2.0), (0.0, 0.25, 0.5), (1, 2, None))
]


# The arms by name, each with the graph or baseline that it uses and what it changes.
ARMS: dict[str, dict] = {
    "embedding": {"graph": "embedding"},
    "categorical": {"graph": "categorical"},
    "typed_sub": {"graph": "typed", "types": ("substitute",)},
    "typed_sub_prereq": {"graph": "typed", "types": ("substitute", "prerequisite")},
    "no_bridging": {"graph": "embedding", "bridging": False},
    "count_only": {"credit": 0.9},
    "count_only_k1": {"credit": 1.0},
    "count_only_weighted": {"credit": 1.0, "weighted": True},
    "count_only_matched": {"credit": 1.5238},
    "cosine-only": {"baseline": "cosine"},
    "tfidf": {"baseline": "tfidf"},
}
#: One change each from the chosen setting; None: the default parameters.
ABLATIONS: dict[str, dict | None] = {
    "selected config": {}, "no bridging (direct match only)": {"enable_bridging": False}, "uniform weights (no JD demand)": {"use_weights": False},
    "max_hops = 1": {"max_hops": 1}, "max_hops = 2": {"max_hops": 2}, "default (pre-tuning)": None,
}
METRICS = ("bridge_over_weak", "ndcg", "p_at_k", "mrr")


def edges_of(arm: str, nodes: DataFrame, similar: DataFrame | None = None, classified: DataFrame | None = None) -> DataFrame:
    """The edges (lo, hi, weight) of an arm's graph: stored similarity, categories, or classified pairs of its types."""
    kind = ARMS[arm].get("graph")
    if kind == "categorical":
        return graph.category_edges(nodes)[0]
    if kind == "typed":
        if classified is None:
            raise ValueError(f"{arm} needs classified pairs")
        return graph.typed_edges(classified, nodes, ARMS[arm]["types"])
    if similar is None:
        raise ValueError(f"{arm} needs similarity edges")
    return similar


def chosen(config: dict) -> ScoringParams:
    return ScoringParams(bridge_cutoff=config.get("cutoff"), bridge_credit_scale=config.get("scale", 1.0), unreachable_penalty=config.get("unreachable", 0.0), max_hops=config.get("hops"))


def arm_scores(arm: str, wants: DataFrame, graded: DataFrame, have: DataFrame, apsp: DataFrame | None = None, config: dict | None = None, embedder=None) -> DataFrame:
    """jd, cand, total of every graded pair by an arm; a graph's arm needs its paths and setting."""
    a, pairs = ARMS[arm], graded.select("jd", "cand").distinct()
    if "baseline" in a:
        w = wants.select(F.col("jd").alias("query"), "skill")
        q = pairs.withColumnRenamed("jd", "query")
        x = evaluation.cosine_text(w, have, q, embedder) if a["baseline"] == "cosine" else evaluation.tfidf(w, have, q)
        return x.select(F.col("query").alias("jd"), "cand", F.col("score").alias("total"))
    if "credit" in a:
        x = matching.count_only(wants, have, a["credit"], pairs, weighted=a.get("weighted", False))
    else:
        p = chosen(config or {})
        none = wants.sparkSession.createDataFrame([], "src string, dst string, dist double, hops int")
        bridging = a.get("bridging", True)
        x = matching.scores(wants, have, apsp if bridging and apsp is not None else none, replace(p, enable_bridging=bridging), pairs)
    return x.join(pairs, ["jd", "cand"], "left_semi").select("jd", "cand", "total")


def metrics(scored: DataFrame, graded: DataFrame) -> DataFrame:
    """split and METRICS, means over descriptions (pairs pooled for the first), of scored pairs (jd, cand, total)."""
    x = _graded(scored, graded, ["split", "jd"]).persist()
    r = evaluation.ranked(x)
    m = evaluation.precision_at(r, 5).join(evaluation.mrr(r), "query").join(evaluation.ndcg(x), "query").join(evaluation.pairwise(x, 2, 1), "query")
    return m.groupBy(F.split("query", "/")[0].alias("split")).agg((F.sum("wins2") / F.sum("pairs2")).alias("bridge_over_weak"), *[F.avg(c).alias(c) for c in METRICS[1:]])


def run_arms(wants: DataFrame, graded: DataFrame, have: DataFrame, nodes: DataFrame, similar: DataFrame | None = None, classified: DataFrame | None = None, names=tuple(ARMS), grid: list[dict] = GRID, embedder=None) -> DataFrame:
    """arm, split, config and METRICS of each named arm; graphs' arms are swept on the training split."""
    out, train = None, graded.where("split = 'train'")
    for arm in names:
        apsp = config = None
        if "graph" in ARMS[arm] and ARMS[arm].get("bridging", True):
            apsp = paths.apsp(edges_of(arm, nodes, similar, classified)).persist()
            config = grid[sweep(wants, train, have, apsp, grid).first()["config"]]
        x = metrics(arm_scores(arm, wants, graded, have, apsp, config, embedder), graded)
        x = x.select(F.lit(arm).alias("arm"), "split", F.lit(json.dumps(config)).alias("config"), *METRICS)
        out = x if out is None else out.unionByName(x)
    return out


def ablate(wants: DataFrame, graded: DataFrame, have: DataFrame, apsp: DataFrame, config: dict) -> DataFrame:
    """arm, split and METRICS of the ABLATIONS of a chosen setting."""
    out = None
    for name, change in ABLATIONS.items():
        p = ScoringParams() if change is None else replace(chosen(config), **change)
        scored = matching.scores(wants, have, apsp, p, graded.select("cand")).select("jd", "cand", "total")
        x = metrics(scored, graded).select(F.lit(name).alias("arm"), "split", *METRICS)
        out = x if out is None else out.unionByName(x)
    return out


def head_to_head(wants: DataFrame, graded: DataFrame, have: DataFrame, apsp: DataFrame, p: ScoringParams, embedder=None) -> DataFrame:
    """ranker, split, METRICS, and lift_ of each over the cosine baseline: the graph, the same without bridges, and both
    baselines."""
    scored = {
        "graph": matching.scores(wants, have, apsp, p, graded.select("cand")).select("jd", "cand", "total"),
        "graph (no bridging)": matching.scores(wants, have, apsp, replace(p, enable_bridging=False), graded.select("cand")).select("jd", "cand", "total"),
        "cosine-only": arm_scores("cosine-only", wants, graded, have, embedder=embedder),
        "tfidf": arm_scores("tfidf", wants, graded, have),
    }
    out = None
    for name, x in scored.items():
        x = metrics(x, graded).select(F.lit(name).alias("ranker"), "split", *METRICS)
        out = x if out is None else out.unionByName(x)
    base = out.where("ranker = 'cosine-only'").select("split", *[F.col(c).alias(f"b_{c}") for c in METRICS])
    return out.join(base, "split").select("ranker", "split", *METRICS, *[(F.col(c) - F.col(f"b_{c}")).alias(f"lift_{c}") for c in METRICS])


def report(title: str, tables: dict[str, DataFrame]) -> str:
    """Markdown of result tables under headings."""
    return "\n\n".join([f"# {title}", *(f"## {name}\n\n{reports.markdown(df)}" for name, df in tables.items())]) + "\n"


def _graded(scored: DataFrame, graded: DataFrame, keys: list[str]) -> DataFrame:
    """Scores (…, jd, cand, total) with grades; a candidate without a row scored nothing."""
    x = graded.join(scored, ["jd", "cand"])
    return x.select(F.concat_ws("/", *keys).alias("query"), *keys, "cand", F.col("total").alias("score"), "grade", "pos")


def sweep(wants: DataFrame, graded: DataFrame, have: DataFrame, apsp: DataFrame, grid: list[dict] = GRID) -> DataFrame:
    """config, bridge_over_weak, ndcg of every setting, best first; one pass over the scored pairs for all settings."""
    spark = wants.sparkSession
    totals = matching.sweep(wants, have, apsp, grid)
    ids = spark.range(len(grid)).select(F.col("id").cast("int").alias("config"))
    up = spark.createDataFrame([(i, float(c.get("unreachable", 0.0))) for i, c in enumerate(grid)], "config int, up double")
    every = graded.select("jd", "cand").crossJoin(ids).join(F.broadcast(up), "config")
    full = every.join(totals, ["config", "jd", "cand"], "left").withColumn("total", F.coalesce("total", -F.col("up")))
    x = _graded(full, graded, ["config", "jd"]).persist()
    metric = evaluation.pairwise(x, 2, 1).join(evaluation.ndcg(x), "query")
    metric = metric.groupBy(F.split("query", "/")[0].cast("int").alias("config")).agg((F.sum("wins2") / F.sum("pairs2")).alias("bridge_over_weak"), F.avg("ndcg").alias("ndcg"))
    return metric.orderBy(F.desc("bridge_over_weak"), F.desc("ndcg"), "config")


def gap_precision(wants: DataFrame, graded: DataFrame, have: DataFrame, apsp: DataFrame, p: ScoringParams) -> DataFrame:
    """jd, calls and right: bridgeable gaps, and those whose source is a curated substitute of the missing skill."""
    groups = wants.sparkSession.createDataFrame(list(evaluation.GROUP_OF.items()), "s string, g int")
    b = matching.terms(wants, have, apsp, p).where("bridged").join(graded.select("jd", "cand"), ["jd", "cand"], "left_semi")
    b = b.join(F.broadcast(groups.withColumnsRenamed({"s": "skill", "g": "g1"})), "skill", "left").join(F.broadcast(groups.withColumnsRenamed({"s": "via", "g": "g2"})), "via", "left")
    return b.groupBy("jd").agg(F.count("*").alias("calls"), F.count_if(F.col("g1") == F.col("g2")).alias("right"))


def run_arm(edges: DataFrame, wants: DataFrame, graded: DataFrame, have: DataFrame, grid: list[dict] = GRID, iterations: int = 1000) -> dict:
    """The chosen setting, and for each split the metrics with 95 % intervals over resampled descriptions."""
    apsp = paths.apsp(edges).persist()
    train = graded.where("split = 'train'")
    best = sweep(wants, train, have, apsp, grid).first()["config"]
    c = grid[best]
    p = ScoringParams(bridge_cutoff=c["cutoff"], bridge_credit_scale=c["scale"], unreachable_penalty=c["unreachable"], max_hops=c["hops"])
    scored = matching.scores(wants, have, apsp, p, graded.select("cand")).select("jd", "cand", "total")
    out = {"config": c, "splits": {}}
    for split in ("train", "heldout"):
        g = graded.where(F.col("split") == split)
        x = _graded(scored, g, ["jd"]).persist()
        r = evaluation.ranked(x)
        each = evaluation.pairwise(x, 2, 1).join(evaluation.ndcg(x), "query").join(evaluation.precision_at(r, 5), "query").join(evaluation.mrr(r), "query")
        each = each.join(gap_precision(wants, g, have, apsp, p).withColumnRenamed("jd", "query"), "query", "left").fillna(0)
        each = each.withColumn("item", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("query")) - 1).persist()
        drawn = evaluation.draws(wants.sparkSession, each.count(), iterations)
        means = each.agg(*[F.avg(m).alias(m) for m in ("ndcg", "p_at_k", "mrr")], (F.sum("wins2") / F.sum("pairs2")).alias("bridge_over_weak"), F.try_divide(F.sum("right"), F.sum("calls")).alias("gap_precision")).first().asDict()
        ratios = {"bridge_over_weak": ("wins2", "pairs2"), "gap_precision": ("right", "calls")}
        for m in ("ndcg", "p_at_k", "mrr", *ratios):
            v, w = ratios.get(m, (m, None))
            ci = evaluation.bootstrap(each.select("item", F.col(v).alias("value"), (F.col(w) if w else F.lit(1.0)).alias("weight")), drawn, ratio=w is not None).first()
            means[m] = (means[m] or 0.0, ci["lo"], ci["hi"])
        out["splits"][split] = means
    return out
