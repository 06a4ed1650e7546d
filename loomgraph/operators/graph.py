"""Building and auditing the skill graph. nodes: name, category, ... edges: lo, hi, weight, edge_source; one row a pair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scoring import similarity_of_cost, typed_cost
from . import nearby
from .vectorindex import PROBES, VectorIndex

#: Tasks that a category's pairs are dealt to.
PARTS = 16
# Names that never become skills, skills added by hand, and substitutes that no measurement found.
STOP_SKILLS = ("Microsoft Office software", "Microsoft PowerPoint", "Microsoft Word", "Microsoft Outlook", "Microsoft Visio", "Microsoft Project")
GENERIC_SKILLS = (
    "Relational database management system software", "Web application software", "Web application framework software",
    "Web server software", "JavaScript framework software", "Statistical software", "Software development tools",
    "Vector database software", "Version control software", "Content management systems CMS", "Firewall software",
    "Chatbot software", "Operational Data Store ODS software", "Geographic information system GIS software",
    "Geographic information system GIS systems",
)
CUSTOM_SKILLS = (
    ("PyTorch", "Deep Learning Framework"), ("TensorFlow", "Deep Learning Framework"), ("Keras", "Deep Learning Framework"),
    ("XGBoost", "Gradient Boosting Library"), ("CatBoost", "Gradient Boosting Library"), ("LightGBM", "Gradient Boosting Library"),
    ("Optuna", "Hyperparameter Optimization"), ("LangChain", "LLM Orchestration"), ("Llama", "Large Language Model"),
    ("Mistral", "Large Language Model"), ("BERT", "Transformer Model"), ("DistilBERT", "Transformer Model"),
    ("Hugging Face", "AI Ecosystem"), ("FastAPI", "Web Framework"), ("React Native", "Mobile Development"),
)
SEED_EDGES = (
    ("XGBoost", "LightGBM", 0.90), ("XGBoost", "CatBoost", 0.88), ("LightGBM", "CatBoost", 0.88), ("BERT", "DistilBERT", 0.93),
    ("Llama", "Mistral", 0.85), ("BERT", "Hugging Face", 0.70), ("Hugging Face", "PyTorch", 0.70), ("LangChain", "Hugging Face", 0.68),
    ("FastAPI", "Flask", 0.80), ("FastAPI", "Django", 0.72), ("React Native", "React", 0.85),
)
EDGE_SCHEMA = "lo string, hi string, weight double, edge_source string"


class DensityError(ValueError):
    """The similarity graph is denser than allowed."""


def in_scope(occupations: DataFrame, skills: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Computer occupations (soc, title), and their hot or demanded skills (soc, skill, element, ...) but for excluded names."""
    flagged = (F.col("hot") == "Y") | (F.col("demand") == "Y")
    excluded = [*STOP_SKILLS, *GENERIC_SKILLS]
    return occupations.where(F.col("soc").startswith("15-")), skills.where(F.col("soc").startswith("15-") & flagged & ~F.col("skill").isin(excluded))


def pick_category(mentions: DataFrame, key: str = "skill", element: str = "element") -> DataFrame:
    """key, category (most frequent element, the first in order of equals), category_all, category_n."""
    n = mentions.groupBy(key, element).agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col(element).alias("e")))["e"].alias("category")
    return n.groupBy(key).agg(best, F.sort_array(F.collect_set(element)).alias("category_all")).withColumn("category_n", F.size("category_all").cast("long"))


def skill_graph(occupations: DataFrame, skills: DataFrame, custom: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes, roles and requires from taxonomy tables (soc, title) and (soc, skill, element, hot, demand)."""
    occupations, skills = in_scope(occupations, skills)
    roles = occupations.select(F.col("title").alias("name"), "soc").dropDuplicates(["name"])
    nodes = pick_category(skills).select(F.col("skill").alias("name"), "category", "category_all", "category_n", F.lit(None).cast("string").alias("embed_category"), F.lit("onet").alias("source"))
    requires = skills.join(occupations, "soc").select(F.col("title").alias("role"), "skill").distinct()
    if custom:
        own = nodes.sparkSession.createDataFrame(list(CUSTOM_SKILLS), "name string, c string")
        fresh = own.join(nodes, "name", "left_anti").select("name", F.col("c").alias("category"), F.array("c").alias("category_all"), F.lit(1).cast("long").alias("category_n"), F.col("c").alias("embed_category"), F.lit("custom").alias("source"))
        named = nodes.join(own, "name", "left").withColumn("embed_category", F.coalesce("c", "embed_category")).drop("c")
        nodes = named.unionByName(fresh)
    return nodes, roles, requires


def embed_text(name: str = "name", category: str = "category", embed_category: str = "embed_category"):
    """What a node's vector is made from: name (category)."""
    c = F.coalesce(F.nullif(F.col(embed_category), F.lit("")), F.col(category), F.lit(""))
    return F.concat(F.col(name), F.lit(" ("), c, F.lit(")"))


def nearest(nodes: DataFrame, k: int | None, min_sim: float, block: int = nearby.SLAB) -> DataFrame:
    """src, dst, sim: of every node (id, embedding) the k most similar others (all, for None) with min_sim or more.

    Exact: every node is compared with slabs of all others (nearby), which gives at most k rows a node and slab; the work
    grows with the square of the nodes. Ties go to the smaller id.
    """
    near = nearby.nearest(nodes, nodes, k, min_sim, block)
    if k is None:
        return near
    place = F.row_number().over(W.partitionBy("src").orderBy(F.desc("sim"), "dst"))
    return near.withColumn("rn", place).where(F.col("rn") <= k).drop("rn")


def offer(near: DataFrame) -> DataFrame:
    """Pairs lo, hi at their highest similarity."""
    return near.groupBy(F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi")).agg(F.max("sim").alias("weight"))


def semantic_edges(nodes: DataFrame, k: int = 5, min_sim: float = 0.30, strong_sim: float | None = None, existing: DataFrame | None = None, max_density: float | None = 0.15, index: VectorIndex | None = None, probes: int = PROBES, exact: bool = False) -> DataFrame:
    """Similarity edges: nearest neighbours, all pairs of strong_sim or more, none where existing has the pair.

    index: over the nodes' vectors; neighbours are then sought in `probes` of its cells each, or with exact=True in all
    that may hold one. Without an index all pairs of nodes are compared.
    """
    near = nearest(nodes, k, min_sim) if index is None else index.near(nodes, k, min_sim, probes, exact)
    if strong_sim is not None:
        near = near.union(nearest(nodes, None, strong_sim) if index is None else index.near(nodes, None, strong_sim))
    pairs = offer(near)
    if max_density is not None:
        check_density(nodes.count(), pairs.count(), max_density)
    if existing is not None:
        pairs = pairs.join(existing.select("lo", "hi"), ["lo", "hi"], "left_anti")
    return pairs.select("lo", "hi", F.round("weight", 3).alias("weight"), F.lit("embedding").alias("edge_source"))


def check_density(n: int, pairs: int, limit: float) -> float:
    d = pairs / (n * (n - 1) / 2) if n > 1 else 0.0
    if d > limit:
        raise DensityError(f"density {d:.3f} is above {limit}: {pairs} pairs over {n} nodes")
    return d


def seed_overlay(edges: DataFrame, seeds: DataFrame, nodes: DataFrame) -> DataFrame:
    """seeds (a, b, weight) with status: added, already (the pair has an edge, which stays) or absent (an end is missing)."""
    s = seeds.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), F.col("weight").alias("seed"))
    have = nodes.select(F.col("name").alias("lo"), F.lit(True).alias("l"))
    there = nodes.select(F.col("name").alias("hi"), F.lit(True).alias("h"))
    x = s.join(have, "lo", "left").join(there, "hi", "left").join(edges.select("lo", "hi", F.col("weight").alias("old")), ["lo", "hi"], "left")
    status = F.when(F.col("l").isNull() | F.col("h").isNull(), "absent").when(F.col("old").isNotNull(), "already").otherwise("added")
    return x.select("lo", "hi", F.col("seed").alias("weight"), status.alias("status"))


def with_seeds(edges: DataFrame, seeds: DataFrame, nodes: DataFrame) -> DataFrame:
    add = seed_overlay(edges, seeds, nodes).where("status = 'added'").select("lo", "hi", "weight", F.lit("seed").alias("edge_source"))
    return edges.unionByName(add)


def category_edges(nodes: DataFrame, weight: float = 0.5, max_size: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Pairs of the same category at one weight, and the categories skipped for their size (category, n).

    nodes: name, category; a node may be in several. Without max_size a category of n nodes gives n(n-1)/2 edges,
    which is what a categorical graph is; skipped categories are reported.
    """
    sizes = nodes.groupBy("category").agg(F.countDistinct("name").alias("n"))
    skipped = sizes.where(F.col("n") > max_size) if max_size is not None else sizes.where("false")
    own = nodes.join(skipped, "category", "left_anti").select("name", "category").distinct()
    # only two nodes of several categories each can meet twice; all other pairs are made once, and needn't be compared
    several = own.groupBy("name").agg((F.count("*") > 1).alias("several"))
    own = own.join(several, "name")
    # a category's pairs are dealt to PARTS tasks: its nodes in parts against all of them
    part = F.pmod(F.xxhash64("name"), F.lit(PARTS)).cast("int")
    left = own.select(F.col("name").alias("lo"), "category", "several", part.alias("part"))
    right = own.select(F.col("name").alias("hi"), "category", F.col("several").alias("too"), F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    key = ["category", "part"]  # few rows, but many pairs: the number of tasks is given, so that they aren't put together
    pairs = left.repartition(4 * PARTS, *key).join(right.repartition(4 * PARTS, *key), key).where("lo < hi")
    once = pairs.where("NOT (several AND too)").select("lo", "hi")
    pairs = once.unionByName(pairs.where("several AND too").select("lo", "hi").distinct())
    return pairs.select("lo", "hi", F.lit(float(weight)).alias("weight"), F.lit("category").alias("edge_source")), skipped


def typed_candidates(nodes: DataFrame, k: int = 8, min_sim: float = 0.30) -> DataFrame:
    """Pairs to classify: the same category, or among each other's k nearest across categories (k first, then the filter)."""
    same = category_edges(nodes.select(F.col("id").alias("name"), "category"))[0].select("lo", "hi")
    cat = nodes.select("id", "category")
    ends = lambda df, a, b: df.join(cat.select(F.col("id").alias(a), F.col("category").alias("c1")), a).join(cat.select(F.col("id").alias(b), F.col("category").alias("c2")), b)
    near = ends(nearest(nodes, k, min_sim), "src", "dst").where(~F.col("c1").eqNullSafe(F.col("c2")))
    cross = near.select(F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi")).distinct()
    # the pairs of one category are many, and none of them comes twice; what is near is compared with their categories
    shared = ends(cross, "lo", "hi").where("c1 = c2").select("lo", "hi").distinct()
    return same.unionByName(cross.join(shared, ["lo", "hi"], "left_anti"))


def without_curated(pairs: DataFrame, curated: DataFrame) -> DataFrame:
    """pairs (lo, hi) that are not among curated pairs (a, b), in either order."""
    return pairs.join(curated.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct(), ["lo", "hi"], "left_anti")


def typed_edges(classified: DataFrame, nodes: DataFrame | None = None, traversable: tuple[str, ...] = ("substitute", "prerequisite")) -> DataFrame:
    """Scoring edges from classified pairs (a, b, edge_type, confidence, seq): traversable types, the last row of a pair wins."""
    x = classified.where(F.col("edge_type").isin(list(traversable)))
    if nodes is not None:
        for c in ("a", "b"):
            x = x.join(nodes.select(F.col("name").alias(c)), c, "left_semi")
    cost = typed_cost(F.col("edge_type"), F.col("confidence"))
    x = x.where(cost.isNotNull()).select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), F.struct("seq", similarity_of_cost(cost).alias("weight"), "edge_type").alias("x"))
    return x.groupBy("lo", "hi").agg(F.max("x").alias("x")).select("lo", "hi", "x.weight", F.col("x.edge_type").alias("edge_source"))


def type_shares(classified: DataFrame, alarm: float = 70.0) -> DataFrame:
    """edge_type, n, share in % and whether it looks like a rubber stamp."""
    n = classified.groupBy("edge_type").agg(F.count("*").alias("n"))
    share = F.round(F.col("n") * 100.0 / F.sum("n").over(W.partitionBy(F.lit(0))), 3)
    return n.withColumn("share", share).withColumn("alarm", F.col("share") > alarm)


def type_conflicts(classified: DataFrame) -> DataFrame:
    """Pairs that are a directed prerequisite more than once."""
    x = classified.where("edge_type = 'prerequisite' AND direction <> 'symmetric'")
    return x.groupBy(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.count("*").alias("n")).where("n > 1")


def probe_report(classified: DataFrame, probes: DataFrame) -> DataFrame:
    """probes (a, b, expected) with the type found in either order, and whether it is the expected one."""
    c = classified.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), "edge_type").dropDuplicates(["lo", "hi"])
    p = probes.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), "expected")
    return p.join(c, ["lo", "hi"], "left").withColumn("ok", F.coalesce(F.col("edge_type") == F.col("expected"), F.lit(False)))


def neighbors(edges: DataFrame, name, min_weight: float = 0.3) -> DataFrame:
    """name, weight of every neighbour of a node, by weight, then name."""
    both = edges.select("lo", "hi", "weight").union(edges.select("hi", "lo", "weight"))
    out = both.where((F.col("lo") == name) & (F.col("weight") >= min_weight)).groupBy(F.col("hi").alias("name")).agg(F.max("weight").alias("weight"))
    return out.orderBy(F.desc("weight"), "name")


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes (name) without a similarity edge."""
    ends = edges.select(F.col("lo").alias("name")).union(edges.select("hi"))
    return nodes.select("name").join(ends, "name", "left_anti")


def skill_view(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The skill-only part of a mixed graph: nodes (name, node_type) of type skill, isolated ones too, and the edges
    (lo, hi, weight, relation) of relation similar between them."""
    skills = nodes.where("node_type = 'skill'")
    end = lambda c: skills.select(F.col("name").alias(c)).distinct()
    return skills, edges.where("relation = 'similar'").join(end("lo"), "lo", "left_semi").join(end("hi"), "hi", "left_semi")


def audit(nodes: DataFrame, edges: DataFrame, bridge_cutoff: float = 0.6) -> DataFrame:
    """One row: skills, similar, orphans, density, and untraversable: edges longer than the cutoff, which never bridge."""
    a = nodes.agg(F.count("*").alias("skills"))
    b = edges.agg(F.count("*").alias("similar"), F.count_if(F.lit(1.0) - F.col("weight") > bridge_cutoff).alias("untraversable"))
    c = orphans(nodes, edges).agg(F.count("*").alias("orphans"))
    possible = F.col("skills") * (F.col("skills") - 1) / 2.0
    out = a.crossJoin(b).crossJoin(c).withColumn("density", F.round(F.when(possible > 0, F.col("similar") / possible).otherwise(0.0), 6))
    return out.withColumn("min_traversable_similarity", F.round(F.lit(1.0 - bridge_cutoff), 3))
