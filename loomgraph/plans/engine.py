"""The engine façade: ranking, gaps, explanations, pool and ontology over a store's tables."""

from __future__ import annotations

from dataclasses import asdict, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as T
from ..functions.scoring import TUNED_PARAMS, ScoringParams
from ..operators import documents, dynamic, evaluation, graph, linking, matching, paths, topk
from ..operators.hublabels import HubLabels
from ..operators.vectorindex import VectorIndex
from ..sources import readers
from ..sources.store import Store
from ..streaming import ingest as ingestion


#: Candidates of a response that names no top_k, at most.
MOST_NESTED = 1000


class MatchEngine:
    """Graph, paths and pools are built on first use and kept until a write makes them stale.

    Distances come from hub labels; with path_table=True from a table of all pairs, which edit_edges() keeps up to date.
    aliases: surface -> node, in place of the built-in ones. vectors: linking.node_index() of the nodes, for stores with
    more of them than one matrix holds.
    """

    def __init__(self, store: Store, params: ScoringParams = TUNED_PARAMS, embedder=None, extractor=ingestion.gazetteer_extractor, use_embedding: bool = True, aliases: dict[str, str] | None = None, vectors: VectorIndex | None = None, path_table: bool = False):
        self.store, self.params, self.embedder, self.extractor, self.use_embedding = store, params, embedder, extractor, use_embedding
        self.spark, self.vectors, self.path_table = store.spark, vectors, path_table
        self.aliases = None if aliases is None else linking.alias_table(store.spark, aliases)
        self._paths: DataFrame | HubLabels | None = None
        self._pools: dict[str | None, DataFrame] = {}

    # cached tables

    def nodes(self) -> DataFrame:
        return self.store.read("skills").withColumn("text", F.concat("name", F.lit(" ("), F.coalesce("category", F.lit("")), F.lit(")")))

    def paths(self) -> DataFrame | HubLabels:
        """Labels, or the table of paths, made once."""
        if self._paths is None:
            self._paths = (paths.apsp if self.path_table else HubLabels)(self.store.read("similar"), self.params.search_cutoff)
        return self._paths

    def edit_edges(self, put: DataFrame | None = None, gone: DataFrame | None = None) -> None:
        """Similarity edges (lo, hi, weight, edge_source) that come or change, and pairs (lo, hi) that go, in one commit."""
        before = self.store.read("similar")
        put = before.limit(0) if put is None else put
        gone = before.limit(0) if gone is None else gone
        after = dynamic.edited(before, put, gone)
        named = before.select("lo", "hi", F.col("edge_source").alias("old")), put.groupBy(F.least("lo", "hi").alias("lo"), F.greatest("lo", "hi").alias("hi")).agg(F.max("edge_source").alias("new"))
        sourced = after.join(named[0], ["lo", "hi"], "left").join(named[1], ["lo", "hi"], "left").select("lo", "hi", "weight", F.coalesce("new", "old").alias("edge_source"))
        self.store.commit({"similar": sourced})
        if self.path_table and self._paths is not None:
            self._paths = dynamic.updated(self._paths, before, self.store.read("similar"), self.params.search_cutoff)
        else:
            self.invalidate_graph()

    def pool(self, batch: str | None = None) -> DataFrame:
        key = batch or None
        if key not in self._pools:
            self._pools[key] = self.store.pool(key).persist()
        return self._pools[key]

    def invalidate_graph(self) -> None:
        self._paths = None

    def invalidate_pool(self, batch: str | None = None) -> None:
        """A write to a batch makes that batch and the whole pool stale; without a batch, everything."""
        for key in [batch, None] if batch else list(self._pools):
            if (df := self._pools.pop(key, None)) is not None:
                df.unpersist()

    # inputs

    def weights(self, skills) -> DataFrame:
        """surface, weight from {skill: weight} or a list (weight 1)."""
        rows = list(skills.items()) if isinstance(skills, dict) else [(s, 1.0) for s in skills]
        for s, w in rows:
            if not str(s).strip() or not 0 <= float(w) <= 10:
                raise ValueError(f"a skill needs a name and a weight from 0 to 10: {s!r}, {w!r}")
        return self.spark.createDataFrame([(str(s), float(w)) for s, w in rows], "surface string, weight double")

    def link(self, phrases: DataFrame) -> DataFrame:
        return linking.link(phrases, self.nodes(), self.aliases, self.embedder, use_embedding=self.use_embedding, vectors=self.vectors)

    def resolve(self, skills, link: bool = True) -> DataFrame:
        """surface, weight, node, score, method."""
        w = self.weights(skills)
        if link:
            return self.link(w)
        named = self.nodes().select(F.col("name").alias("surface"), F.col("name").alias("node"))
        x = w.join(named, "surface", "left")
        return x.withColumns({"score": F.when(F.col("node").isNotNull(), 1.0).otherwise(0.0), "method": F.when(F.col("node").isNotNull(), "surface").otherwise("unresolved")})

    def wants(self, skills, link: bool = True, jd: str = "jd") -> DataFrame:
        x = self.resolve(skills, link).where("node IS NOT NULL").groupBy(F.col("node").alias("skill")).agg(F.max("weight").alias("demand"))
        return x.select(F.lit(jd).alias("jd"), "skill", "demand")

    def params_for(self, **given) -> ScoringParams:
        """The engine's parameters with those that are given and not None."""
        return replace(self.params, **{k: v for k, v in given.items() if v is not None})

    def link_trace(self, skills, link: bool = True) -> DataFrame:
        """One row, links: what each given skill was resolved to, and how, as structs in the order of the names."""
        x = self.resolve(skills, link).select(F.struct("surface", "node", "weight", F.round("score", 4).alias("score"), "method").alias("l"))
        return x.agg(F.array_sort(F.collect_list("l")).alias("links"))

    def echo(self, p: ScoringParams) -> Column:
        """The parameters that a result was made with, as a struct."""
        return F.struct(*[F.lit(v).alias(k) for k, v in asdict(p).items()])

    # results

    def _candidates(self, candidates, batch: str | None, link: bool) -> tuple[DataFrame, DataFrame]:
        """have and cands (cand, name). None: the pool, by id; an empty dict: nobody; profiles of the pool are used as stored."""
        if candidates is None:
            p = self.pool(batch)
            return p.where("skill IS NOT NULL").select("cand", "skill", "weight"), p.select("cand", "name").distinct()
        if batch:
            raise ValueError("candidates and a batch exclude each other")
        have = self.spark.createDataFrame([], "cand string, skill string, weight double")
        for name, skills in candidates.items():
            if skills:
                have = have.unionByName(self.wants(skills, link, name).select(F.col("jd").alias("cand"), "skill", F.col("demand").alias("weight")))
        names = self.spark.createDataFrame([(n, n) for n in candidates], "cand string, name string")
        return have, names

    def rank_candidates(self, jd, candidates=None, batch: str | None = None, top_k: int | None = None, link: bool = True, **params) -> DataFrame:
        p = self.params_for(**params)
        have, cands = self._candidates(candidates, batch, link)
        return self._ranked(self.wants(jd, link), have, cands, p, top_k).drop("jd").orderBy("rank")

    def _ranked(self, wants: DataFrame, have: DataFrame, cands: DataFrame, p: ScoringParams, top_k: int | None) -> DataFrame:
        """scores() with rank, candidate_id and name, by total, then name, then id; with top_k, few others are scored."""
        who = F.struct("name", "candidate_id").alias("cand")
        named = cands.withColumnRenamed("cand", "candidate_id").dropDuplicates(["candidate_id"])
        have = have.withColumnRenamed("cand", "candidate_id").join(named, "candidate_id").select(who, "skill", "weight")
        cands = named.select(who)
        if top_k is None or top_k < 1:
            out = matching.rank(matching.scores(wants, have, self.paths(), p, cands), top_k)
        else:
            out = topk.rank_top(wants, have, self.paths(), self.store.read("similar"), p, top_k, cands)[0]
        return out.select("*", "cand.candidate_id", "cand.name").drop("cand")

    def ranking_response(self, jd, candidates=None, batch: str | None = None, top_k: int | None = None, link: bool = True, **params) -> DataFrame:
        """One row: candidates (structs with nested gaps, by rank), jd_links, params and n_candidates."""
        p = self.params_for(**params)
        have, cands = self._candidates(candidates, batch, link)
        wants = self.wants(jd, link)
        if top_k is None and (n := cands.select("cand").distinct().count()) > MOST_NESTED:
            raise ValueError(f"{n} candidates; name a top_k, or use rank_candidates()")
        best = paths.checkpointed(self._ranked(wants, have, cands, p, top_k).select("rank", F.col("candidate_id").alias("cand"), "name"))
        few = have.join(best.select("cand"), "cand", "left_semi")
        ranked = matching.results(wants, few, self.paths(), p, best.select("cand")).join(best, "cand").withColumnRenamed("cand", "candidate_id")
        none = lambda c: F.coalesce(c, F.array()).alias(c)
        one = F.struct("rank", "candidate_id", "name", "total", "direct", "bridge", "penalty", "total_demand", *[none(c) for c in ("matched_skills", "bridged_skills", "missing_skills", "floored_skills")])
        out = ranked.agg(F.array_sort(F.collect_list(one)).alias("candidates"), F.count("*").cast("int").alias("n_candidates"))
        return out.crossJoin(self.link_trace(jd, link).withColumnRenamed("links", "jd_links")).withColumn("params", self.echo(p))

    def gap_response(self, jd, skills, max_hops: int | None = None, link: bool = True) -> DataFrame:
        """One row: bridgeable and missing (structs, in order), both link traces and params."""
        p = self.params_for(max_hops=max_hops)
        gaps = matching.ordered_gaps(self.get_bridgeable_gaps(jd, skills, max_hops, link).withColumns({"jd": F.lit(0), "cand": F.lit(0)}))
        gap = F.struct("place", "skill", "via", S.wire_distance(F.col("distance")).alias("distance"), "hops", "demand", "reason")
        some = lambda cond: F.array_sort(F.collect_list(F.when(cond, gap)))
        out = gaps.agg(some(F.col("bridgeable")).alias("bridgeable"), some(~F.col("bridgeable")).alias("missing"))
        return self._traced(out, jd, skills, link).withColumn("params", self.echo(p))

    def explain_response(self, jd, skills, link: bool = True) -> DataFrame:
        """One row: explain_score() with both link traces."""
        return self._traced(self.explain_score(jd, skills, link), jd, skills, link)

    def _traced(self, df: DataFrame, jd, skills, link: bool) -> DataFrame:
        df = df.crossJoin(self.link_trace(jd, link).withColumnRenamed("links", "jd_links"))
        return df.crossJoin(self.link_trace(skills, link).withColumnRenamed("links", "candidate_links"))

    def upload(self, name: str, content: bytes, batch: str | None = None) -> DataFrame:
        """One row on an uploaded file: thread_id, candidate_id, name, content_hash, status, reused, in_pool, error,
        failed_chunks, skill_count and unresolved."""
        doc = readers.read_bytes(self.spark, [(name, content)])
        out = self.ingest(doc, batch).join(doc.select("path", "content_hash"), "path")
        c = self.store.read("candidates").select("candidate_id", "name", "unresolved", "failed_chunks")
        n = self.store.read("has_skill").groupBy("candidate_id").agg(F.count("*").alias("skill_count"))
        out = out.join(c, "candidate_id", "left").join(n, "candidate_id", "left")
        return out.select(T.upload_thread_id(F.col("content_hash")).alias("thread_id"), "candidate_id", "name", "content_hash", "status", (F.col("status") == "reused").alias("reused"), "in_pool", "error", F.coalesce("failed_chunks", F.array().cast("array<int>")).alias("failed_chunks"), F.coalesce("skill_count", F.lit(0)).alias("skill_count"), F.coalesce("unresolved", F.array()).alias("unresolved"))

    def get_bridgeable_gaps(self, jd, skills, max_hops: int | None = None, link: bool = True) -> DataFrame:
        have = self.wants(skills, link, "candidate").select(F.col("jd").alias("cand"), "skill", F.col("demand").alias("weight"))
        cands = self.spark.createDataFrame([("candidate",)], "cand string")
        wants = self.wants(jd, link)
        return matching.gaps(wants, have, self.paths(), self.params_for(max_hops=max_hops), cands).drop("jd", "cand").orderBy("distance", "skill")

    def explain_score(self, jd, skills, link: bool = True) -> DataFrame:
        have = self.wants(skills, link, "candidate").select(F.col("jd").alias("cand"), "skill", F.col("demand").alias("weight"))
        wants = self.wants(jd, link)
        return matching.explain(matching.results(wants, have, self.paths(), self.params))

    def list_candidates(self, batch: str | None = None) -> DataFrame:
        return documents.pool_summary(documents.in_batch(self.store.read("candidates"), batch), self.store.read("has_skill"))

    def graph_stats(self) -> DataFrame:
        return graph.audit(self.store.read("skills"), self.store.read("similar"))

    def ingest(self, docs: DataFrame, batch: str | None = None) -> DataFrame:
        out = ingestion.ingest(docs, self.store, batch, extractor=self.extractor).persist()
        out.count()
        self.invalidate_pool(batch)
        return out

    def extract_jd_skills(self, text: str) -> DataFrame:
        """skill, weight of a description's text, by weight, then name."""
        doc = self.spark.createDataFrame([("jd", 0, text)], "source_id string, index int, text string")
        found = linking.merge_mentions(self.extractor(doc, self.store.read("skills")).withColumn("seq", F.col("index")), "source_id")
        linked = self.link(found.withColumnRenamed("skill", "surface"))
        return linked.where("node IS NOT NULL").groupBy(F.col("node").alias("skill")).agg(F.max("weight").alias("weight")).orderBy(F.desc("weight"), "skill")

    def register_skills(self, names: list[str], threshold: float = 0.82) -> DataFrame:
        rows = linking.register(names, self.store.read("skills"), threshold, self.embedder)
        made = [(r["surface"], "dynamic") for r in rows if r["status"] == "created"]
        if made:
            self.store.upsert_skills(self.spark.createDataFrame(made, "name string, source string"))  # no edges, so no paths change
        return self.spark.createDataFrame([(r["surface"], r["node"], r["status"], r["score"]) for r in rows], "surface string, node string, status string, score double")

    def list_eval_jds(self, jds: list[dict], split: str | None = None) -> DataFrame:
        """jd_id, domain, split, n_skills, n_candidates of an evaluation snapshot."""
        rows = [(j["jd_id"], j["domain"], j["split"], len(j["jd_skills"]), len(j["candidates"])) for j in jds if split is None or j["split"] == split]
        return self.spark.createDataFrame(rows, "jd_id string, domain string, split string, n_skills int, n_candidates int")

    def rank_eval_jd(self, jds: list[dict], jd_id: str) -> DataFrame:
        """rank_candidates of an evaluation description with tier, grade and exact_overlap."""
        wants, graded, have = evaluation.dataset(self.spark, [j for j in jds if j["jd_id"] == jd_id])
        scored = matching.scores(wants, have, self.paths(), self.params, graded.select("cand"))
        labels = graded.select("cand", "tier", "grade", "exact_overlap")
        return matching.rank(scored).join(labels, "cand", "left").fillna({"tier": "", "grade": 0, "exact_overlap": 0}).orderBy("rank")


_ENGINE: MatchEngine | None = None


def set_engine(engine: MatchEngine | None) -> None:
    """The engine that tools and the server of this process use."""
    global _ENGINE
    _ENGINE = engine


def get_engine() -> MatchEngine:
    if _ENGINE is None:
        raise RuntimeError("no engine: call set_engine() first")
    return _ENGINE
