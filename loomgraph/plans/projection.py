"""The matching domain over the driver's tables, in Spark and as the common part of the oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scoring import ScoringParams
from ..operators import graph, matching, paths
from ..operators.workspace import spread

#: Largest distance that the queries search for.
CUTOFF = 1.2
PARAMS = ScoringParams(bridge_cutoff=CUTOFF, bridge_credit_scale=2.0, max_bridge_credit=0.9, bridgeable_penalty=0.05, unreachable_penalty=0.1, max_hops=2, search_cutoff=CUTOFF)


class Tables:
    """Lazily read tables of one directory and what is projected from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self._edges: DataFrame | None = None
        self._paths: DataFrame | None = None
        self._have: DataFrame | None = None
        self._n: int | None = None

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def n_skills(self) -> int:
        """Nodes of the graph; parts stand for the node of their key modulo this."""
        if self._n is None:
            self._n = max(1, self.embeddings.count())
        return self._n

    def skill(self) -> DataFrame:
        return self.embeddings.select(F.col("vec_id").alias("name"), F.col("label").cast("long").alias("category"), "embedding")

    def edges(self) -> DataFrame:
        if self._edges is None:
            self._edges = graph.semantic_edges(self.skill().withColumnRenamed("name", "id"), max_density=None).select("lo", "hi", "weight").persist()
        return self._edges

    def have(self) -> DataFrame:
        """Derived once, as terms, paths and candidates all need it."""
        if self._have is None:
            n = self.lineitem.count()  # tasks are as many as the rows ask for, so none grows with the tables
            x = spread(self.orders, n, "o_orderkey").join(spread(self.lineitem, n, "l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"))
            x = spread(x, n, "o_custkey")
            w = 0.5 + 0.5 * (F.col("l_quantity").cast("int") % 3)
            self._have = x.groupBy(F.col("o_custkey").alias("cand"), (F.col("l_partkey") % self.n_skills()).alias("skill")).agg(F.max(w).alias("weight")).persist()
        return self._have

    def wants(self) -> DataFrame:
        d = F.when(F.col("p_size") > 35, 1.5).when(F.col("p_size") > 15, 1.0).otherwise(0.5)
        return self.part.groupBy(F.col("p_brand").alias("jd"), (F.col("p_partkey") % self.n_skills()).alias("skill")).agg(F.max(d).alias("demand"))

    def paths(self) -> DataFrame:
        if self._paths is None:
            self._paths = paths.apsp(self.edges(), CUTOFF, hops_within=PARAMS.max_hops)
        return self._paths

    def judged(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """wants, graded pairs (jd, split, cand, tier, grade, exact_overlap, pos) and have (every weight 1): a pair is graded
        by how many of the wanted skills the candidate has."""
        wants, have = self.wants(), self.have().withColumn("weight", F.lit(1.0))
        n = matching.overlaps(wants, have)
        grade = F.least(F.floor(F.col("exact_overlap") / 4), F.lit(3)).cast("long")
        split = F.when(F.substring("jd", -1, 1).isin("1", "3", "5"), "train").otherwise("heldout")
        graded = n.select("jd", split.alias("split"), "cand", F.concat(F.lit("tier "), grade.cast("string")).alias("tier"), grade.alias("grade"), "exact_overlap", F.col("cand").alias("pos"))
        return wants, graded, have

    def graded(self) -> DataFrame:
        x = self.documents.join(self.labels, "doc_id")
        grade = (2 * F.col("quality") + 1 - F.col("toxic")).cast("long")
        return x.select(F.col("source").alias("query"), F.col("doc_id").alias("cand"), (F.col("n_chars") % 97).cast("double").alias("score"), grade.alias("grade"), F.col("doc_id").alias("pos"))

    def mentions(self) -> DataFrame:
        """Words of conversations as weighted mentions."""
        word = F.explode(F.split(F.regexp_replace(F.lower("text"), "[^a-z ]", " "), " +"))
        x = self.conversations.select("conv_id", "turn", F.col("text"), word.alias("skill")).where(F.length("skill") >= 4)
        x = x.groupBy("conv_id", "turn", "skill").agg(F.count("*").alias("n"))
        return x.select(F.col("conv_id").alias("doc_id"), "skill", F.least(0.5 + 0.5 * (F.col("n") - 1), F.lit(1.5)).alias("weight"), F.concat(F.lit("turn "), F.col("turn").cast("string")).alias("context"), F.col("turn").alias("seq"))


SKILLS = "(SELECT greatest(count(*), 1) FROM embeddings)"
SKILL = "skill AS (SELECT vec_id AS name, label::BIGINT AS category, embedding::DOUBLE[] AS v FROM embeddings)"
SIM = f"{SKILL}, sim AS (SELECT a.name AS src, b.name AS dst, a.category AS c1, b.category AS c2, list_cosine_similarity(a.v, b.v) AS sim FROM skill a JOIN skill b ON a.name <> b.name)"
NEAR = f"{SIM}, near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS rn FROM sim WHERE sim >= 0.3) WHERE rn <= 5)"
EDGES = f"{NEAR}, edges AS (SELECT least(src, dst) AS lo, greatest(src, dst) AS hi, round(max(sim), 3) AS weight FROM near GROUP BY 1, 2)"
SYM = f"{EDGES}, sym AS (SELECT lo AS a, hi AS b, 1.0::DOUBLE - weight AS d FROM edges UNION ALL SELECT hi, lo, 1.0::DOUBLE - weight FROM edges)"
#: Every walk within the cutoff, for distances, and every one of two edges at most, for hops.
PATHS = f"""RECURSIVE {SYM},
walks(src, dst, d) AS (
  SELECT a, b, d FROM sym WHERE d <= {CUTOFF}
  UNION ALL SELECT w.src, s.b, w.d + s.d FROM walks w JOIN sym s ON w.dst = s.a WHERE w.src <> s.b AND w.d + s.d <= {CUTOFF}),
near2 AS (SELECT a AS src, b AS dst, 1 AS h FROM sym UNION ALL SELECT x.a, y.b, 2 FROM sym x JOIN sym y ON x.b = y.a WHERE x.a <> y.b),
paths AS (SELECT src, dst, min(d) AS dist, min(h)::BIGINT AS hops FROM (SELECT src, dst, d, NULL AS h FROM walks UNION ALL SELECT src, dst, NULL, h FROM near2) GROUP BY 1, 2)"""
HAVE = f"have AS (SELECT o_custkey AS cand, l_partkey % {SKILLS} AS skill, max(0.5 + 0.5 * (l_quantity::INT % 3))::DOUBLE AS weight FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2)"
WANTS = f"wants AS (SELECT p_brand AS jd, p_partkey % {SKILLS} AS skill, max(CASE WHEN p_size > 35 THEN 1.5 WHEN p_size > 15 THEN 1.0 ELSE 0.5 END)::DOUBLE AS demand FROM part GROUP BY 1, 2)"
JUDGED = f"""{HAVE}, {WANTS}, w AS (SELECT jd, skill, demand FROM wants), h AS (SELECT cand, skill FROM have),
g AS (
  SELECT jd, CASE WHEN right(jd, 1) IN ('1', '3', '5') THEN 'train' ELSE 'heldout' END AS split, cand, 'tier ' || least(n // 4, 3) AS tier, least(n // 4, 3)::BIGINT AS grade, n AS exact_overlap, cand AS pos
  FROM (SELECT jd, cand, count(*) AS n FROM w JOIN h USING (skill) GROUP BY 1, 2))"""
REACH = f"""{PATHS}, {HAVE}, {WANTS},
best AS (
  SELECT cand, dst AS skill, min(dist) AS dist, min(hops) AS hops, min_by(src, struct_pack(d := dist, s := src)) FILTER (dist IS NOT NULL) AS via
  FROM have JOIN paths ON have.skill = src WHERE dst IN (SELECT skill FROM wants) GROUP BY 1, 2)"""


def rounded(x: str, places: int) -> str:
    """x to so many places, by way of 9 decimal places."""
    return f"round(({x})::DECIMAL(28, 9), {places})::DOUBLE"


def terms(p: ScoringParams = PARAMS) -> str:
    """CTEs up to terms: jd, cand, skill, demand, matched, credit, floored, bridged for parameters p."""
    on = "TRUE" if p.enable_bridging else "FALSE"
    cut = "TRUE" if p.bridge_cutoff is None else f"dist <= {p.bridge_cutoff}"
    hop = "TRUE" if p.max_hops is None else f"coalesce(hops <= {p.max_hops}, FALSE)"
    cap = f"least({float(p.max_bridge_credit)}::DOUBLE, c)" if p.max_bridge_credit is not None else "c"
    demand = "max(demand)" if p.use_weights else "1.0::DOUBLE"
    own = f"greatest({float(p.min_proficiency_credit)}::DOUBLE, least(weight / {float(p.proficiency_reference)}::DOUBLE, 1.0::DOUBLE))" if p.use_weights else "1.0::DOUBLE"
    return f"""{REACH},
want AS (SELECT jd, skill, {demand} AS demand FROM wants GROUP BY 1, 2),
rated AS (
  SELECT *, {cap} AS bc FROM (
    SELECT jd, coalesce(h.cand, b.cand) AS cand, w.skill, demand, weight, dist, hops, via, weight IS NOT NULL AS matched,
      coalesce({on} AND dist IS NOT NULL AND {cut} AND {hop}, FALSE) AS ok, {own} AS own,
      greatest(0.0::DOUBLE, 1.0::DOUBLE - dist) * {float(p.bridge_credit_scale)}::DOUBLE AS c
    FROM have h FULL JOIN best b ON h.cand = b.cand AND h.skill = b.skill JOIN want w ON w.skill = coalesce(h.skill, b.skill))),
terms AS (
  SELECT jd, cand, skill, demand, matched, dist, hops, via, coalesce(matched AND own < 1 AND ok AND least(bc, 1.0::DOUBLE) > own, FALSE) AS floored, NOT matched AND ok AS bridged,
    CASE WHEN matched AND own < 1 AND ok AND least(bc, 1.0::DOUBLE) > own THEN least(bc, 1.0::DOUBLE) WHEN matched THEN own WHEN ok THEN bc ELSE 0.0 END AS credit FROM rated)"""


def scores(p: ScoringParams = PARAMS) -> str:
    return f"""{terms(p)},
totals AS (SELECT jd, sum(demand) AS total_demand, count(*) AS n_skills FROM want GROUP BY 1),
added AS (
  SELECT jd, cand, coalesce(sum(demand * credit) FILTER (matched), 0) AS direct, coalesce(sum(demand * credit) FILTER (bridged), 0) AS bridge,
    coalesce(sum(demand) FILTER (matched), 0) AS held, coalesce(sum(demand) FILTER (bridged), 0) AS bd,
    count(*) FILTER (matched) AS n_matched, count(*) FILTER (bridged) AS n_bridged, count(*) FILTER (floored) AS n_floored
  FROM terms GROUP BY 1, 2),
scored AS (
  SELECT jd, cand, coalesce(direct, 0) AS direct, coalesce(bridge, 0) AS bridge, total_demand,
    coalesce(bd, 0) * {float(p.bridgeable_penalty)}::DOUBLE + greatest(total_demand - coalesce(held, 0) - coalesce(bd, 0), 0) * {float(p.unreachable_penalty)}::DOUBLE AS penalty,
    coalesce(n_matched, 0) AS n_matched, coalesce(n_bridged, 0) AS n_bridged, coalesce(n_floored, 0) AS n_floored,
    n_skills - coalesce(n_matched, 0) - coalesce(n_bridged, 0) AS n_missing
  FROM (SELECT DISTINCT cand FROM have) CROSS JOIN totals LEFT JOIN added USING (jd, cand)),
final AS (SELECT *, {rounded('(direct + bridge - penalty) / total_demand', 3)} AS total FROM scored)"""
