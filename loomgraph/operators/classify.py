"""Typed pairs from a pluggable classifier, in batches with retries, and the path behind a bridge in words."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .paths import checkpointed, symmetric

TYPES = ("substitute", "complement", "prerequisite", "unrelated")
DIRECTIONS = ("a_to_b", "b_to_a", "symmetric")
BATCH, TRIES = 20, 4
SCHEMA = "a string, b string, edge_type string, direction string, confidence double, source string, rationale string"

#: A classifier takes pairs and returns (edge_type, direction, confidence, rationale) for each.
Classifier = Callable[[list[tuple[str, str]]], list[tuple[str, str, float, str]]]


def valid(row: tuple) -> bool:
    return len(row) == 4 and row[0] in TYPES and row[1] in DIRECTIONS and 0 <= float(row[2]) <= 1


def classify(pairs: DataFrame, classifier: Classifier, cache: DataFrame | None = None, wait: float = 0.0) -> DataFrame:
    """SCHEMA rows for pairs (lo, hi) that the cache (a, b) has in neither order; answers that aren't valid are dropped."""
    todo = pairs.select(F.col("lo").cast("string").alias("a"), F.col("hi").cast("string").alias("b"))
    if cache is not None:
        known = cache.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        todo = todo.join(known, ["a", "b"], "left_anti")

    def run(batches: Iterable[pd.DataFrame]):
        for pdf in batches:
            rows = list(pdf.itertuples(index=False, name=None))
            for i in range(0, len(rows), BATCH):
                group, got = rows[i : i + BATCH], []
                for n in range(TRIES):
                    try:
                        got = classifier(group)
                        break
                    except Exception:  # the classifier is foreign code: its last failure leaves the pairs unclassified
                        time.sleep(wait * 2**n)
                yield pd.DataFrame([(a, b, r[0], r[1], float(r[2]), "llm", r[3]) for (a, b), r in zip(group, got) if valid(r)], columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return todo.mapInPandas(run, SCHEMA)


def bridge_path(edges: DataFrame, nodes: DataFrame, held: list[str], target: str) -> dict:
    """Why a target is or isn't reached from held skills: status, and the path with the similarity of each edge.

    nodes: name, node_type. A round keeps the cheapest path to every node it reaches and extends those that the one
    before made cheaper, as long as they cost less than what the target costs already; so paths may have any length.
    """
    kinds = {r["name"]: r["node_type"] for r in nodes.where(F.col("name").isin([*held, target])).collect()}
    if target not in kinds:
        return {"status": "not a node", "path": []}
    if kinds[target] != "skill":
        return {"status": "not a skill", "path": []}
    ignored = [h for h in held if kinds.get(h) != "skill"]
    sym = symmetric(edges).persist()
    if sym.where(F.col("a") == target).isEmpty():
        return {"status": "orphan", "path": [], "ignored": ignored}
    step = F.array(F.struct(F.col("a").alias("from"), F.col("b").alias("to"), F.round(1 - F.col("distance"), 3).alias("sim")))
    first = sym.where(F.col("a").isin([h for h in held if h not in ignored])).select(F.col("b").alias("at"), F.col("distance").alias("dist"), step.alias("path"))
    best = checkpointed(first.groupBy("at").agg(F.min(F.struct("dist", "path")).alias("x")).select("at", "x.*", F.lit(True).alias("moved")))
    while True:
        found = best.where(F.col("at") == target).first()
        moved = best.where("moved") if found is None else best.where("moved").where(F.col("dist") < found["dist"])
        if moved.isEmpty():
            break
        longer = moved.join(sym, moved["at"] == sym["a"]).select(F.col("b").alias("at"), (F.col("dist") + F.col("distance")).alias("dist"), F.concat("path", step).alias("path"), F.lit(None).cast("double").alias("old"))
        both = best.select("at", "dist", "path", F.col("dist").alias("old")).unionByName(longer).groupBy("at").agg(F.min(F.struct("dist", "path")).alias("x"), F.min("old").alias("old"))
        best = checkpointed(both.select("at", "x.*", (F.col("old").isNull() | (F.col("x.dist") < F.col("old"))).alias("moved")))
    sym.unpersist()
    if found is None:
        return {"status": "no path", "path": [], "ignored": ignored}
    return {"status": "path", "distance": found["dist"], "path": [(p["from"], p["to"], p["sim"]) for p in found["path"]], "ignored": ignored}
