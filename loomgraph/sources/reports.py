"""Small results as files: Markdown tables, per-document JSON, logs of unresolved surfaces, cached vectors."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vectors import Embedder, embed

#: A report is for reading; more rows than this are refused.
MOST_ROWS = 2_000


def markdown(df: DataFrame, places: int = 3) -> str:
    """A small table as Markdown."""
    rows = df.limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} rows for a report")
    show = lambda x: "–" if x is None else f"{x:.{places}f}" if isinstance(x, float) else str(x)
    head = [f"| {' | '.join(df.columns)} |", f"|{'|'.join('---' for _ in df.columns)}|"]
    return "\n".join([*head, *(f"| {' | '.join(map(show, r))} |" for r in rows)])


def extraction_files(extractions: DataFrame, path: str) -> DataFrame:
    """One JSON document for each row (source_id, ...), named by its stem; stems that collide get -2, -3, ...

    Written as one partition a file name; returns source_id and name.
    """
    order = W.partitionBy("source_id").orderBy(*[c for c in extractions.columns if c != "source_id"])
    n = F.row_number().over(order)
    named = extractions.withColumn("name", F.when(n == 1, F.col("source_id")).otherwise(F.concat_ws("-", "source_id", n.cast("string"))))
    named.write.mode("overwrite").partitionBy("name").json(path)
    return named.select("source_id", "name")


def log_unresolved(linked: DataFrame, path: str) -> bool:
    """Append unresolved surfaces (surface, score) with a time stamp; nothing is written if all are resolved."""
    lost = linked.where("node IS NULL").select("surface", "score", F.current_timestamp().alias("at"))
    if lost.isEmpty():
        return False
    lost.write.mode("append").json(path)
    return True


def cached_vectors(texts: DataFrame, path: str, model: str, embedder: Embedder | None = None) -> DataFrame:
    """texts (name, text) with embedding, from a Parquet cache by model and text; only new texts are embedded.

    A cache that can't be read, or has other columns, is ignored.
    """
    spark = texts.sparkSession
    keyed = texts.withColumn("key", F.sha2(F.concat_ws("\0", F.lit(model), "text"), 256))
    try:
        cache = spark.read.parquet(path)
        if dict(cache.dtypes) != {"key": "string", "embedding": "array<double>"}:
            raise ValueError
    except Exception:
        cache = spark.createDataFrame([], "key string, embedding array<double>")
    fresh = embed(keyed.join(cache, "key", "left_anti").select("key", "text").distinct(), "text", embedder=embedder).select("key", "embedding").persist()
    if not fresh.isEmpty():
        fresh.write.mode("append").parquet(path)
    out = keyed.join(cache.unionByName(fresh).dropDuplicates(["key"]), "key", "left").drop("key")
    return out


def manifest(jds: list[dict], digest: str) -> str:
    """What identifies a generated dataset, as JSON."""
    splits = {s: sum(j["split"] == s for j in jds) for s in ("train", "heldout")}
    return json.dumps({"n_jds": len(jds), "n_pairs": sum(len(j["candidates"]) for j in jds), "splits": splits, "content_sha256": digest}, indent=2)
