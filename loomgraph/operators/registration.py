"""Growing an ontology by many names at once, with the result of registering them one after the other.

Registered in order, a name is its own node if it has that name already, a near duplicate if a node there or made before
it is near enough, else a new node. Whether a name becomes a node depends only on earlier names near to it: it does if
none of them did. So names are decided in rounds: all whose earlier neighbours are all decided, at once. The neighbours
come from the vector index's exact range search (or all pairs in blocks), the rest is joins; nothing comes to the driver but
whether names are left. A chain of n names, each near the next only, takes n rounds; unrelated ones one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import BigramEmbedder, Embedder, embed
from .graph import nearest
from .vectorindex import VectorIndex
from .workspace import checkpointed, new_folder, ship

THRESHOLD = 0.82


def register_all(names: DataFrame, nodes: DataFrame, threshold: float = THRESHOLD, embedder: Embedder | None = None, index: VectorIndex | None = None) -> DataFrame:
    """surface, node, status (exact, near_duplicate, created) and score of names (seq, surface), for nodes (name).

    The first row of a surface decides; its later ones are exact, or near duplicates like it. Of equally near nodes a
    stored one goes before a new one, then the smaller name, then the earlier.
    """
    embedder = embedder or BigramEmbedder()
    ship(names.sparkSession)
    first = names.where("surface IS NOT NULL").groupBy("surface").agg(F.min("seq").alias("seq"))
    stored = nodes.where("name IS NOT NULL").select(F.col("name").alias("id")).distinct()
    exact = first.join(stored.withColumnRenamed("id", "surface"), "surface", "left_semi").select("surface", F.col("surface").alias("node"), F.lit("exact").alias("status"), F.lit(1.0).alias("score"))
    left = checkpointed(embed(first.join(stored.withColumnRenamed("id", "surface"), "surface", "left_anti"), "surface", embedder=embedder))
    asked = left.select(F.col("surface").alias("id"), "embedding")
    if index is None:
        index = VectorIndex.build(embed(stored, "id", embedder=embedder), new_folder(names.sparkSession, "names"))
    old = index.near(asked, 1, exact=True, same=True).select(F.col("src").alias("surface"), F.col("dst").alias("old"), F.col("sim").alias("old_sim"))
    near = nearest(asked, None, threshold)
    seq = left.select("surface", "seq")
    before = near.select(F.col("src").alias("surface"), F.col("dst").alias("earlier"), F.round("sim", 9).alias("sim")).where(F.col("sim") >= threshold)
    before = before.join(seq, "surface").join(seq.select(F.col("surface").alias("earlier"), F.col("seq").alias("at")), "earlier")
    before = checkpointed(before.where("at < seq").select("surface", "earlier", "sim", "at"))
    # a stored node that is near enough settles a name whatever the others become
    state = left.select("surface", "seq").join(old, "surface", "left")
    state = checkpointed(state.withColumn("made", F.when(F.col("old_sim") >= threshold, F.lit(False))))
    while not state.where("made IS NULL").isEmpty():
        open_ = before.join(state.where("made IS NULL").select("surface"), "surface", "left_semi").join(state.select(F.col("surface").alias("earlier"), F.col("made").alias("was")), "earlier")
        told = open_.groupBy("surface").agg(F.max(F.coalesce("was", F.lit(False))).alias("taken"), F.max(F.col("was").isNull()).alias("waits"))
        x = state.join(told, "surface", "left")
        taken, waits = F.coalesce("taken", F.lit(False)), F.coalesce("waits", F.lit(False))
        state = checkpointed(x.withColumn("made", F.when(F.col("made").isNotNull(), F.col("made")).when(taken, F.lit(False)).when(~waits, F.lit(True))).drop("taken", "waits"))
    new = before.join(state.where("made").select(F.col("surface").alias("earlier")), "earlier", "left_semi")
    new = new.groupBy("surface").agg(F.max(F.struct("sim", (-F.col("at")).alias("at"), F.col("earlier").alias("node"))).alias("x"))
    x = state.join(new, "surface", "left")
    later = F.col("x.sim").isNotNull() & (F.col("old_sim").isNull() | (F.col("x.sim") > F.col("old_sim")))
    node = F.when(F.col("made"), F.col("surface")).when(later, F.col("x.node")).otherwise(F.col("old"))
    score = F.when(F.col("made"), F.lit(1.0)).when(later, F.col("x.sim")).otherwise(F.col("old_sim"))
    decided = exact.unionByName(x.select("surface", node.alias("node"), F.when(F.col("made"), "created").otherwise("near_duplicate").alias("status"), score.alias("score")))
    out = names.where("surface IS NOT NULL").join(decided, "surface").join(first.select("surface", F.col("seq").alias("__first")), "surface")
    again = (F.col("status") == "created") & (F.col("seq") > F.col("__first"))
    return out.select("seq", "surface", "node", F.when(again, "exact").otherwise(F.col("status")).alias("status"), "score")
