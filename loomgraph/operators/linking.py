"""Entity linking: surface forms to canonical nodes by alias, surface index, nearest neighbour, or not at all."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vectors import BigramEmbedder, Embedder, QueryMode, embed, queries_of
from .vectorindex import PROBES, VectorIndex
from .workspace import ship

MIN_SCORE = 0.80
#: Nodes up to this number are compared with every left-over surface as one broadcast matrix.
BROADCAST_NODES = 50_000
# Surface forms and the nodes they stand for.
ALIASES = {
    "aws": "Amazon Web Services AWS software", "amazon web services": "Amazon Web Services AWS software",
    "sql": "Structured query language SQL", "css": "Cascading style sheets CSS", "html": "Hypertext markup language HTML",
    "json": "JavaScript Object Notation JSON", "k8s": "Kubernetes", "kubernetes": "Kubernetes", "js": "JavaScript",
    "node": "Node.js", "nodejs": "Node.js", "postgres": "PostgreSQL", "gcp": "Google Workspace software", "tf": "IBM Terraform",
    "terraform": "IBM Terraform", "cpp": "C++", "c sharp": "C#", "csharp": "C#", "golang": "Go", "sklearn": "Scikit-learn",
    "scikit learn": "Scikit-learn", "angularjs": "Google Angular", "angular js": "Google Angular", "docker compose": "Docker",
    "docker-compose": "Docker", "huggingface": "Hugging Face", "hugging face transformers": "Hugging Face", "llama 2": "Llama",
    "llama 3": "Llama", "django rest framework": "Django", "c": "C", "r": "R", "sas": "SAS", "unix": "UNIX",
}
PINNED = {
    "aws": "Amazon Web Services AWS software", "sql": "Structured query language SQL", "css": "Cascading style sheets CSS",
    "html": "Hypertext markup language HTML", "json": "JavaScript Object Notation JSON", "k8s": "Kubernetes",
}


def alias_table(spark, aliases: dict[str, str] | None = None) -> DataFrame:
    rows = list((ALIASES if aliases is None else aliases).items())
    return spark.createDataFrame(rows, "surface string, node string").withColumn("surface", T.normalize(F.col("surface")))


def active_aliases(aliases: DataFrame, nodes: DataFrame) -> DataFrame:
    return aliases.join(nodes.select(F.col("name").alias("node")), "node", "left_semi").select("surface", "node")


def dead_aliases(aliases: DataFrame, nodes: DataFrame) -> DataFrame:
    """Aliases whose node doesn't exist."""
    return aliases.join(nodes.select(F.col("name").alias("node")), "node", "left_anti").select("surface", "node")


def surfaces(nodes: DataFrame) -> DataFrame:
    """node, surface: every form that a node (name) may be called by, but for stop cores and single characters."""
    name = F.col("name")
    forms = F.array_union(F.array(T.normalize(name), T.core_form(name)), T.embedded_acronyms(name))
    x = nodes.select(name.alias("node"), F.explode(forms).alias("surface"))
    return x.where((F.length("surface") >= 2) & ~F.col("surface").isin(list(T.STOP_CORES))).distinct()


def surface_index(nodes: DataFrame) -> DataFrame:
    """surface, node: forms that mean one node only."""
    return surfaces(nodes).groupBy("surface").agg(F.min("node").alias("node"), F.max("node").alias("other")).where("node = other").select("surface", "node")


def nearest_node(left: DataFrame, nodes: DataFrame, embedder: Embedder | None = None, text_of: str = "text") -> DataFrame:
    """surface, node, sim: the most similar node (name, text) of each surface; the first name of equals.

    The node matrix is sent to every task, up to BROADCAST_NODES nodes.
    """
    embedder = embedder or BigramEmbedder()
    ship(left.sparkSession)
    sent = left.sparkSession.sparkContext.broadcast(node_matrix(nodes, embedder, text_of))

    def run(batches):
        for pdf in batches:
            names, m = sent.value
            if not names or not len(pdf):
                continue
            sim = np.round(queries_of(embedder, pdf["surface"].tolist()) @ m.T, 9)  # so that equal texts tie in any order of sums
            at = sim.argmax(1)
            yield pd.DataFrame({"surface": pdf["surface"], "node": [names[i] for i in at], "sim": sim[np.arange(len(at)), at]})

    return left.select("surface").distinct().mapInPandas(run, "surface string, node string, sim double")


def node_index(nodes: DataFrame, path: str, embedder: Embedder | None = None, text_of: str = "text", cells: int | None = None) -> VectorIndex:
    """An index over the vectors of nodes (name, text), any number of them, for link()."""
    ship(nodes.sparkSession)
    return VectorIndex.build(embed(nodes.select(F.col("name").alias("id"), text_of), text_of, embedder=embedder).select("id", "embedding"), path, cells)


def indexed_node(left: DataFrame, vectors: VectorIndex, embedder: Embedder | None = None, probes: int = PROBES, exact: bool = False) -> DataFrame:
    """nearest_node() through an index of the nodes' vectors, made with the same embedder."""
    ship(left.sparkSession)
    asked = embed(left.select(F.col("surface").alias("id")).distinct(), "id", embedder=QueryMode(embedder or BigramEmbedder()))
    return vectors.near(asked, 1, probes=probes, exact=exact, same=True).select(F.col("src").alias("surface"), F.col("dst").alias("node"), "sim")


def node_matrix(nodes: DataFrame, embedder: Embedder, text_of: str = "text") -> tuple[list[str], np.ndarray]:
    """Names in order and their vectors, of BROADCAST_NODES nodes at most."""
    rows = nodes.select("name", text_of).orderBy("name").limit(BROADCAST_NODES + 1).collect()
    if len(rows) > BROADCAST_NODES:
        raise ValueError(f"more than {BROADCAST_NODES} nodes: give link() their node_index()")
    return [r[0] for r in rows], embedder.encode([r[1] for r in rows])


class Linker:
    """link() over one set of nodes, whose index and vectors are made on first use, or by warm(), and kept.

    Without an embedder that works, surfaces that only it could resolve stay unresolved.
    """

    def __init__(self, nodes: DataFrame, embedder: Embedder | None = None, min_score: float = MIN_SCORE):
        self.nodes, self.embedder, self.min_score = nodes, embedder or BigramEmbedder(), min_score
        self._available: bool | None = None
        self._index: DataFrame | None = None

    def available(self) -> bool:
        """Whether the embedder gives one vector for a text; tried once."""
        if self._available is None:
            try:
                self._available = len(self.embedder.encode(["probe"])) == 1
            except Exception:  # the embedder is foreign code
                self._available = False
        return self._available

    def warm(self) -> Linker:
        """Make what the first link would make."""
        if self._index is None:
            self.nodes = self.nodes.persist()
            self._index = surface_index(self.nodes).persist()
            self._index.count()
        self.available()
        return self

    def link(self, phrases: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
        self.warm()
        return link(phrases, self.nodes, aliases, self.embedder, self.min_score, self.available(), self._index)

    def names(self, phrases: DataFrame) -> DataFrame:
        """node: the distinct names that phrases (surface) resolve to, in order; what older callers ask for."""
        return names_only(self.link(phrases.withColumn("weight", F.lit(1.0))))


def names_only(linked: DataFrame) -> DataFrame:
    return linked.where("node IS NOT NULL").select("node").distinct().orderBy("node")


def calibration_report(cases: DataFrame, linker: Linker, thresholds: list[float]) -> DataFrame:
    """calibrate() over cases (surface, expected node or null), each linked by similarity alone, whatever its score."""
    near = nearest_node(cases.select("surface"), linker.nodes, linker.embedder)
    scored = cases.join(near, "surface", "left").select("expected", F.col("node").alias("found"), F.coalesce("sim", F.lit(0.0)).alias("score"))
    return calibrate(scored, thresholds)


def link(phrases: DataFrame, nodes: DataFrame, aliases: DataFrame | None = None, embedder: Embedder | None = None, min_score: float = MIN_SCORE, use_embedding: bool = True, index: DataFrame | None = None, vectors: VectorIndex | None = None, exact: bool = False) -> DataFrame:
    """phrases (surface, weight, ...) with node, score and method.

    method: alias, surface, embedding or unresolved. A blank surface is unresolved with score 0; one below min_score
    keeps its score, but no node. nodes: name, and text if the embedding is used. Only what the first two steps leave
    reaches the embedder. index: the nodes' surface_index(), if it is there already. vectors: their node_index(), which
    any number of nodes may have; it probes some of its cells, or with exact=True all that may hold the nearest node.
    Without it all nodes are compared, up to BROADCAST_NODES of them.
    """
    aliases = alias_table(phrases.sparkSession) if aliases is None else aliases
    first = active_aliases(aliases, nodes).select(F.col("surface").alias("key"), F.col("node").alias("by_alias")).dropDuplicates(["key"])
    second = (surface_index(nodes) if index is None else index).select(F.col("surface").alias("key"), F.col("node").alias("by_surface"))
    x = phrases.withColumn("key", T.normalize(F.col("surface"))).join(first, "key", "left").join(second, "key", "left")
    known = F.coalesce("by_alias", "by_surface")
    if use_embedding:
        rest = x.where(known.isNull() & (F.col("key") != "")).select("surface")
        near = nearest_node(rest, nodes, embedder) if vectors is None else indexed_node(rest, vectors, embedder, exact=exact)
        x = x.join(near.select("surface", F.col("node").alias("near"), "sim"), "surface", "left")
    else:
        x = x.withColumns({"near": F.lit(None).cast("string"), "sim": F.lit(None).cast("double")})
    good = F.col("sim") >= min_score
    return x.select(
        *phrases.columns,
        F.coalesce(known, F.when(good, F.col("near"))).alias("node"),
        F.when(known.isNotNull(), 1.0).otherwise(F.coalesce("sim", F.lit(0.0))).alias("score"),
        F.when(F.col("by_alias").isNotNull(), "alias").when(F.col("by_surface").isNotNull(), "surface").when(good, "embedding").otherwise("unresolved").alias("method"),
    )


def collapse(linked: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, node, weight, context, method, score: each node once, from its heaviest mention (the first of equals, by seq)."""
    best = F.max_by(F.struct("weight", "context", "method", "score"), F.struct("weight", -F.col("seq"))).alias("x")
    return linked.where("node IS NOT NULL").groupBy(doc, "node").agg(best).select(doc, "node", "x.*")


def resolution_rate(linked: DataFrame, doc: str = "doc_id") -> DataFrame:
    return linked.groupBy(doc).agg(F.round(F.countDistinct("node") / F.count("*"), 6).alias("rate"))


def merge_mentions(mentions: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Mentions (doc, skill, weight, context, seq) once for each case-folded skill: the heaviest, the first of equals."""
    place = F.row_number().over(W.partitionBy(doc, T.casefold(F.col("skill"))).orderBy(F.desc("weight"), "seq"))
    return mentions.withColumn("rn", place).where("rn = 1").drop("rn")


def gazetteer(nodes: DataFrame) -> DataFrame:
    """node, alias: lower-cased names, cores of three characters or more, and pinned aliases."""
    name = F.lower("name")
    core = F.regexp_replace(F.trim(name), "^(?:" + "|".join(T.VENDOR_PREFIXES) + ")", "")
    for s in T.DROP_SUFFIXES:
        core = F.regexp_replace(core, s + "$", "")
    core = F.trim(core)
    own = nodes.select(F.col("name").alias("node"), F.explode(F.array(name, F.when((F.length(core) >= 3) & ~core.isin(list(T.STOP_CORES)), core))).alias("alias")).where("alias IS NOT NULL AND alias <> ''")
    pinned = nodes.sparkSession.createDataFrame([(n, a) for a, n in PINNED.items()], "node string, alias string")
    return own.union(pinned.join(nodes.select(F.col("name").alias("node")), "node", "left_semi").select("node", "alias")).distinct()


def gazetteer_matches(docs: DataFrame, aliases: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, node: distinct nodes with an alias (node, alias) that the text has as a whole word.

    Aliases meet ids of texts on their first run of letters and digits, or else on their first character, and each text
    then meets only the aliases that it may have; no text is compared with every alias, or shuffled more than once.
    """
    low = docs.select(F.col(doc).alias("__id"), F.lower(text).alias("__t")).where("__t IS NOT NULL")
    start = F.regexp_extract("alias", r"(?U)\w+", 0)
    keyed = aliases.where("alias <> ''").select("node", "alias", F.when(start != "", start).otherwise(F.substring("alias", 1, 1)).alias("__key"))
    signs = F.split(F.regexp_replace("__t", r"(?U)[\w\s]+", ""), "")
    keys = F.array_distinct(F.concat(F.regexp_extract_all("__t", F.lit(r"(?U)\w+"), 0), signs))
    tokens = low.select("__id", F.explode(keys).alias("__key"))
    may = tokens.join(keyed, "__key").groupBy("__id").agg(F.collect_set(F.struct("node", "alias")).alias("__may"))
    hit = low.join(may, "__id").select("__id", "__t", F.explode("__may").alias("__m")).where(T.mentions(F.col("__t"), F.col("__m.alias")))
    return hit.select(F.col("__id").alias(doc), "__m.node").distinct()


def register(surface_rows: list[str], nodes: DataFrame, threshold: float = 0.82, embedder: Embedder | None = None) -> list[dict]:
    """Ontology growth, in order: an exact name, a near duplicate of threshold or more, else a new node that later
    surfaces can find. The list is bounded by the caller; all existing nodes are searched, in Arrow batches, and only
    the nearest one to each surface of the list comes to the driver."""
    embedder = embedder or BigramEmbedder()
    spark = nodes.sparkSession
    wanted = list(dict.fromkeys(surface_rows))
    names = nodes.select("name").where("name IS NOT NULL")
    same = names.join(F.broadcast(spark.createDataFrame([(s,) for s in wanted], "name string")), "name", "left_semi")
    exact = {r[0] for r in same.distinct().collect()}
    left = [s for s in wanted if s not in exact]
    vectors = dict(zip(left, embedder.encode(left))) if left else {}
    best = nearest_of_all(left, np.array([vectors[s] for s in left]), names, embedder) if left else {}
    made: list[str] = []
    out = []
    for s in surface_rows:
        if s in exact or s in made:
            out.append({"surface": s, "node": s, "status": "exact", "score": 1.0})
            continue
        score, node = best.get(s, (-np.inf, None))
        if made:
            sim = np.array([vectors[m] for m in made]) @ vectors[s]
            if sim.max() > score:
                score, node = float(sim.max()), made[int(sim.argmax())]
        if node is not None and score >= threshold:
            out.append({"surface": s, "node": node, "status": "near_duplicate", "score": float(score)})
            continue
        made.append(s)
        out.append({"surface": s, "node": s, "status": "created", "score": 1.0})
    return out


def nearest_of_all(surface_rows: list[str], vectors: np.ndarray, names: DataFrame, embedder: Embedder) -> dict[str, tuple[float, str]]:
    """Score and name of the node nearest to each surface, the first in order of equals, over all of names (name)."""

    def run(batches):
        for b in batches:
            own = sorted(b["name"])
            if own:
                sim = embedder.encode(own) @ vectors.T
                at = sim.argmax(0)
                yield pd.DataFrame({"i": np.arange(len(at)), "score": sim.max(0).astype(float), "node": [own[k] for k in at]})

    near = names.mapInPandas(run, "i int, score double, node string")
    near = near.groupBy("i").agg(F.min(F.struct((-F.col("score")).alias("less"), "node")).alias("x"))
    return {surface_rows[r["i"]]: (-r["x"]["less"], r["x"]["node"]) for r in near.collect()}


def calibrate(scored: DataFrame, thresholds: list[float]) -> DataFrame:
    """threshold, correct, missed, wrong over scored cases (expected node or null, found node, score)."""
    t = scored.sparkSession.createDataFrame([(float(x),) for x in thresholds], "threshold double")
    hit = F.col("score") >= F.col("threshold")
    right = hit & (F.col("found") == F.col("expected"))
    return scored.crossJoin(F.broadcast(t)).groupBy("threshold").agg(
        F.count_if(F.coalesce(right, F.lit(False))).alias("correct"),
        F.count_if(F.col("expected").isNotNull() & ~hit).alias("missed"),
        F.count_if(hit & ~F.coalesce(F.col("found") == F.col("expected"), F.lit(False))).alias("wrong"),
    ).orderBy("threshold")
