"""From a taxonomy to a stored graph in one call: nodes, roles, requirements, vectors and similarity edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import Embedder, embed
from ..operators import graph
from ..operators.vectorindex import PROBES, VectorIndex
from ..operators.workspace import checkpointed, new_folder, ship
from ..sources.store import Store

#: Nodes up to this number are compared all with all; more of them go through a vector index.
EXACT_NODES = 50_000


def artifact(occupations: DataFrame, skills: DataFrame, embedder: Embedder | None = None, k: int = 5, min_sim: float = 0.30, strong_sim: float | None = None, max_density: float | None = 0.15, seeds: Sequence[tuple[str, str, float]] = graph.SEED_EDGES, custom: bool = True, by_embed_category: bool = True, index: str | None = None, probes: int = PROBES, exact: bool = True) -> dict[str, DataFrame]:
    """The tables skills, roles, requires and similar of a taxonomy (soc, title) and (soc, skill, element, hot, demand).

    A node's vector is that of its name and category (by_embed_category: the category it is embedded under, where it has
    one). Edges are each node's k nearest of min_sim or more, all pairs of strong_sim or more, and seeds where both ends
    are there and have no edge yet. Above max_density it raises, and nothing is made. index: a folder for a vector index,
    which more than EXACT_NODES nodes get in any case; exact=False lets it probe `probes` cells a node only.
    A taxonomy without rows gives empty tables; with less than two nodes there are no edges.
    """
    spark = occupations.sparkSession
    ship(spark)
    nodes, roles, requires = graph.skill_graph(occupations.where("title IS NOT NULL"), skills.where("skill IS NOT NULL"), custom)
    text = graph.embed_text() if by_embed_category else graph.embed_text(embed_category="category")
    # the vectors are cut off here, as the edges and the table of nodes both read them
    nodes = checkpointed(embed(nodes.withColumn("text", text), "text", embedder=embedder).drop("text"))
    vectors = nodes.select(F.col("name").alias("id"), "embedding")
    if index is None and nodes.count() > EXACT_NODES:
        index = new_folder(spark, "nodes")
    edges = graph.semantic_edges(vectors, k, min_sim, strong_sim, max_density=max_density, index=VectorIndex.build(vectors, index) if index else None, probes=probes, exact=exact)
    edges = checkpointed(edges)
    if seeds:
        edges = graph.with_seeds(edges, spark.createDataFrame(list(seeds), "a string, b string, weight double"), nodes)
    return {"skills": nodes, "roles": roles, "requires": requires, "similar": edges}


def build(store: Store, occupations: DataFrame, skills: DataFrame, embedder: Embedder | None = None, dry_run: bool = False, ceilings: tuple[int, int] | None = None, **settings) -> DataFrame:
    """artifact() written to a store in one commit; kind, rows, good, errors, as Store.migrate() reports them. The pool
    stays; a store with a skill that the artifact hasn't is refused, as its candidates would lose it. ceilings: nodes and
    edges above which nothing is written; the Parquet store itself has none."""
    made = artifact(occupations, skills, embedder, **settings)
    return store.migrate(made, dry_run, guard=True, ceilings=ceilings)
