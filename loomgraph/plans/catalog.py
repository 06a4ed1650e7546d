"""The registered queries over the driver's tables, each with its SQL where SQL can state it."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as T
from ..operators import documents, evaluation, graph, linking, matching, paths
from ..operators.workspace import new_folder, spread
from . import projection as P
from .projection import Tables

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
#: The same queries over Tables, so that several may share what they derive.
PLANS: dict = {}


def query(sql: str | None = None):
    """Register a function of Tables under its name."""

    def add(fn):
        PLANS[fn.__name__] = fn
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def r(c, n: int = 6):
    """Rounded by way of 9 places, so that the order of a sum doesn't decide a tie."""
    return S.rounded(F.col(c) if isinstance(c, str) else c, n)


# Taxonomy: customers stand for occupations (soc), their orders' parts for skills with categories.


def _taxonomy(t: Tables) -> tuple[DataFrame, DataFrame]:
    soc = F.concat(F.when(F.col("c_nationkey") < 12, "15-").otherwise("17-"), F.col("c_custkey").cast("string"))
    occupations = t.customer.select(soc.alias("soc"), F.col("c_name").alias("title"), F.col("c_custkey"))
    n = t.lineitem.count()  # tasks are as many as the rows ask for, so none grows with the tables
    x = spread(t.orders, n, "o_orderkey").join(spread(t.lineitem, n, "l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    x = spread(spread(x, n, "l_partkey").join(spread(t.part, n, "p_partkey"), F.col("l_partkey") == F.col("p_partkey")), n, "o_custkey")
    skills = x.join(occupations, F.col("o_custkey") == F.col("c_custkey")).select(
        "soc", F.col("p_name").alias("skill"), F.col("p_type").alias("element"),
        F.when(F.col("l_returnflag") == "R", "Y").otherwise("N").alias("hot"), F.when(F.col("l_linestatus") == "O", "Y").otherwise("N").alias("demand"),
    )
    return occupations.select("soc", "title"), skills


TAXONOMY = """
occ AS (SELECT (CASE WHEN c_nationkey < 12 THEN '15-' ELSE '17-' END) || c_custkey::VARCHAR AS soc, c_name AS title, c_custkey FROM customer),
raw AS (
  SELECT soc, p_name AS skill, p_type AS element, l_returnflag = 'R' AS hot, l_linestatus = 'O' AS demand
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey JOIN occ ON o_custkey = c_custkey),
tax AS (SELECT * FROM raw WHERE starts_with(soc, '15-') AND (hot OR demand))"""


@query(f"WITH {TAXONOMY} SELECT soc, count(*) AS n, count(DISTINCT skill) AS skills FROM tax GROUP BY soc")
def scan_filter_roles(t: Tables) -> DataFrame:
    return graph.in_scope(*_taxonomy(t))[1].groupBy("soc").agg(F.count("*").alias("n"), F.countDistinct("skill").alias("skills"))


@query(f"""WITH {TAXONOMY}, n AS (SELECT skill, element, count(*) AS n FROM tax GROUP BY 1, 2)
SELECT skill, min_by(element, struct_pack(n := -n, e := element)) AS category, count(*) AS category_n, array_to_string(list_sort(list(element)), '|') AS category_all FROM n GROUP BY 1""")
def pick_category(t: Tables) -> DataFrame:
    return graph.pick_category(graph.in_scope(*_taxonomy(t))[1]).withColumn("category_all", F.array_join("category_all", "|"))


@query(f"WITH {TAXONOMY} SELECT DISTINCT title AS role, skill FROM tax JOIN occ USING (soc)")
def requires_edges(t: Tables) -> DataFrame:
    return graph.skill_graph(*_taxonomy(t), custom=False)[2]


@query(f"SELECT p_brand AS role, count(DISTINCT p_partkey % {P.SKILLS}) AS skills FROM part GROUP BY 1")
def role_requirements(t: Tables) -> DataFrame:
    return t.part.groupBy(F.col("p_brand").alias("role")).agg(F.countDistinct(F.col("p_partkey") % t.n_skills()).alias("skills"))


# Similarity graph


@query(f"WITH {P.EDGES} SELECT * FROM edges")
def knn_edges(t: Tables) -> DataFrame:
    return t.edges()


@query(f"WITH {P.SIM} SELECT src AS lo, dst AS hi, round(sim, 3) AS weight FROM sim WHERE src < dst AND sim >= 0.4")
def threshold_edges(t: Tables) -> DataFrame:
    return graph.nearest(t.skill().withColumnRenamed("name", "id"), None, 0.4).where("src < dst").select(F.col("src").alias("lo"), F.col("dst").alias("hi"), F.round("sim", 3).alias("weight"))


@query(f"WITH {P.EDGES}, n AS (SELECT count(*) AS n FROM skill), e AS (SELECT count(*) AS e FROM edges) SELECT n AS skills, e AS similar, round(e / (n * (n - 1) / 2.0), 6) AS density FROM n, e")
def graph_density(t: Tables) -> DataFrame:
    return graph.audit(t.skill(), t.edges()).select("skills", "similar", "density")


@query(f"""WITH {P.EDGES}, o AS (SELECT count(*) AS o FROM skill WHERE name NOT IN (SELECT lo FROM edges UNION SELECT hi FROM edges))
SELECT (SELECT count(*) FROM skill) AS skills, (SELECT count(*) FROM edges) AS similar, o AS orphans, (SELECT count(*) FROM edges WHERE 1 - weight > 0.6::DOUBLE) AS untraversable, 0.4::DOUBLE AS min_traversable_similarity FROM o""")
def graph_audit(t: Tables) -> DataFrame:
    return graph.audit(t.skill(), t.edges()).select("skills", "similar", "orphans", "untraversable", "min_traversable_similarity")


@query(f"WITH {P.EDGES} SELECT name FROM skill WHERE name NOT IN (SELECT lo FROM edges UNION SELECT hi FROM edges)")
def orphans(t: Tables) -> DataFrame:
    return graph.orphans(t.skill(), t.edges())


@query(f"""WITH {P.EDGES}, s AS (SELECT p_partkey AS a, p_size * 11 AS b, 0.5 + p_size / 200.0 AS w FROM part WHERE p_partkey <> p_size * 11),
seeds AS (SELECT least(a, b) AS lo, greatest(a, b) AS hi, max(w)::DOUBLE AS weight FROM s GROUP BY 1, 2)
SELECT s.lo, s.hi, round(s.weight, 6) AS weight, CASE WHEN s.lo NOT IN (SELECT name FROM skill) OR s.hi NOT IN (SELECT name FROM skill) THEN 'absent' WHEN e.lo IS NOT NULL THEN 'already' ELSE 'added' END AS status
FROM seeds s LEFT JOIN edges e ON s.lo = e.lo AND s.hi = e.hi""")
def seed_overlay(t: Tables) -> DataFrame:
    s = t.part.where("p_partkey <> p_size * 11").select(F.col("p_partkey").alias("a"), (F.col("p_size") * 11).cast("long").alias("b"), (0.5 + F.col("p_size") / 200.0).alias("weight"))
    s = s.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("weight").alias("weight"))
    return graph.seed_overlay(t.edges(), s, t.skill()).withColumn("weight", r("weight"))


@query(f"WITH {P.SKILL} SELECT a.name AS lo, b.name AS hi FROM skill a JOIN skill b ON a.category = b.category AND a.name < b.name")
def category_cliques(t: Tables) -> DataFrame:
    return graph.category_edges(t.skill())[0].select("lo", "hi")


@query(f"""WITH {P.SIM}, k AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS rn FROM sim WHERE sim >= 0.3)
SELECT lo, hi FROM (SELECT least(src, dst) AS lo, greatest(src, dst) AS hi FROM k WHERE rn <= 8 AND c1 <> c2 UNION SELECT src, dst FROM sim WHERE c1 = c2 AND src < dst)""")
def cross_category_candidates(t: Tables) -> DataFrame:
    return graph.typed_candidates(t.skill().withColumnRenamed("name", "id"))


@query(f"WITH {P.EDGES} SELECT lo, hi, weight FROM edges WHERE NOT (lo % 7 = 0 AND hi % 3 = 0)")
def contamination_filter(t: Tables) -> DataFrame:
    curated = t.edges().where("lo % 7 = 0 AND hi % 3 = 0").select(F.col("hi").alias("a"), F.col("lo").alias("b"))
    return graph.without_curated(t.edges(), curated)


@query(f"WITH {P.SYM} SELECT b AS name, round(max(1 - d), 3) AS weight FROM sym WHERE a = 42 AND round(1 - d, 3) >= 0.3 GROUP BY 1")
def neighbors(t: Tables) -> DataFrame:
    return graph.neighbors(t.edges(), 42).withColumn("weight", F.round("weight", 3))


@query(f"WITH {P.EDGES} SELECT lo, hi, max(weight) AS weight FROM edges GROUP BY 1, 2")
def similar_pairs(t: Tables) -> DataFrame:
    both = t.edges().union(t.edges().select("hi", "lo", "weight"))
    return both.groupBy(F.least("lo", "hi").alias("lo"), F.greatest("lo", "hi").alias("hi")).agg(F.max("weight").alias("weight"))


@query(f"WITH {P.EDGES} SELECT 'similar' AS kind, count(*) AS n FROM edges UNION ALL SELECT 'skill', count(*) FROM skill UNION ALL SELECT 'requires', count(*) FROM (SELECT DISTINCT p_brand, p_partkey % {P.SKILLS} FROM part)")
def edge_counts(t: Tables) -> DataFrame:
    one = lambda df, kind: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    pairs = t.part.select("p_brand", F.col("p_partkey") % t.n_skills()).distinct()
    return one(t.edges(), "similar").union(one(t.skill(), "skill")).union(one(pairs, "requires"))


@query(f"""WITH {P.SYM}, w AS (
  SELECT a AS src, b AS dst, d, 1 AS h FROM sym
  UNION ALL SELECT x.a, y.b, x.d + y.d, 2 FROM sym x JOIN sym y ON x.b = y.a)
SELECT src, dst, round(min(d), 6) AS dist, min_by(h, struct_pack(d := d, h := h))::BIGINT AS hops FROM w GROUP BY 1, 2""")
def bounded_path(t: Tables) -> DataFrame:
    src = t.skill().select(F.col("name").alias("src"))
    return paths.within(t.edges(), src, 2).select("src", "dst", r("dist").alias("dist"), F.col("hops").cast("long").alias("hops"))


@query(f"WITH {P.PATHS} SELECT src, dst, round(dist, 6) AS dist, hops FROM paths")
def reach_bounded(t: Tables) -> DataFrame:
    return t.paths().select("src", "dst", r("dist").alias("dist"), F.col("hops").cast("long").alias("hops"))


# Scoring


def _scores(t: Tables, p: S.ScoringParams = P.PARAMS) -> DataFrame:
    return matching.scores(t.wants(), t.have(), t.paths(), p)


@query(f"""WITH {P.scores()} SELECT jd, cand, total, round(direct, 6) AS direct, round(bridge, 6) AS bridge, round(penalty, 6) AS penalty, total_demand, n_matched, n_bridged, n_missing, n_floored FROM final""")
def match_components(t: Tables) -> DataFrame:
    return _scores(t).select("jd", "cand", "total", r("direct").alias("direct"), r("bridge").alias("bridge"), r("penalty").alias("penalty"), "total_demand", "n_matched", "n_bridged", "n_missing", "n_floored")


def _top(sql: str, k: int = 10) -> str:
    return f"WITH {sql} SELECT jd, cand, total, rank FROM (SELECT jd, cand, total, row_number() OVER (PARTITION BY jd ORDER BY total DESC, cand) AS rank FROM final) WHERE rank <= {k}"


def _ranked(t: Tables, p: S.ScoringParams) -> DataFrame:
    return matching.rank(_scores(t, p), 10).select("jd", "cand", "total", F.col("rank").cast("long").alias("rank"))


@query(_top(P.scores()))
def rank_topk(t: Tables) -> DataFrame:
    return _ranked(t, P.PARAMS)


UNIFORM, PLAIN = replace(P.PARAMS, use_weights=False), replace(P.PARAMS, enable_bridging=False)


@query(_top(P.scores(UNIFORM)))
def rank_uniform_weights(t: Tables) -> DataFrame:
    return _ranked(t, UNIFORM)


@query(_top(P.scores(PLAIN)))
def rank_no_bridging(t: Tables) -> DataFrame:
    return _ranked(t, PLAIN)


@query(f"""WITH {P.HAVE}, {P.WANTS}, t AS (SELECT jd, count(*) AS td FROM wants GROUP BY 1),
a AS (SELECT jd, cand, sum(demand * least(weight, 1.0::DOUBLE)) AS direct, count(*) AS held FROM have JOIN wants USING (skill) GROUP BY 1, 2),
final AS (SELECT jd, cand, round(coalesce(direct, 0) + 1.5238::DOUBLE * (td - coalesce(held, 0)), 6) AS total FROM (SELECT DISTINCT cand FROM have) CROSS JOIN t LEFT JOIN a USING (jd, cand))
SELECT jd, cand, total, rank FROM (SELECT jd, cand, total, row_number() OVER (PARTITION BY jd ORDER BY total DESC, cand) AS rank FROM final) WHERE rank <= 10""")
def rank_count_only(t: Tables) -> DataFrame:
    return matching.rank(matching.count_only(t.wants(), t.have(), 1.5238), 10).select("jd", "cand", "total", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {P.REACH} SELECT jd, reason, count(*) AS n, round(sum(demand), 6) AS demand FROM (
  SELECT w.jd, w.demand, CASE WHEN dist IS NULL THEN 'no_path' WHEN NOT dist <= 0.7 THEN 'beyond_distance' WHEN NOT coalesce(hops <= 1, FALSE) THEN 'beyond_hops' ELSE 'bridgeable' END AS reason
  FROM (SELECT DISTINCT cand FROM have) c CROSS JOIN wants w LEFT JOIN have h ON h.cand = c.cand AND h.skill = w.skill LEFT JOIN best b ON b.cand = c.cand AND b.skill = w.skill WHERE h.cand IS NULL) GROUP BY 1, 2""")
def gap_classify(t: Tables) -> DataFrame:
    p = replace(P.PARAMS, bridge_cutoff=0.7, max_hops=1)
    return matching.gap_counts(t.wants(), t.have(), t.paths(), p).withColumn("demand", r("demand"))


@query(f"WITH {P.terms()} SELECT jd, cand, skill, round(credit, 6) AS credit, via, round(dist, 6) AS dist FROM terms WHERE floored")
def held_floor(t: Tables) -> DataFrame:
    x = matching.picked(t.wants(), t.have(), t.paths(), P.PARAMS, "floored")
    return x.select("jd", "cand", "skill", r("credit").alias("credit"), "via", r("dist").alias("dist"))


GRID = [{"cutoff": c, "hops": h, "scale": s, "cap": cap, "unreachable": u} for c in (0.7, 1.2) for h in (1, 2) for s, cap, u in ((1.0, None, 0.0), (2.0, 0.9, 0.1))]
_grid = ", ".join(f"({i}, {c['cutoff']}::DOUBLE, {c['hops']}, {c['scale']}::DOUBLE, {c['cap'] or 'NULL'}::DOUBLE, {c['unreachable']}::DOUBLE)" for i, c in enumerate(GRID))


@query(f"""WITH {P.REACH}, grid(config, cutoff, mh, scale, cap, up) AS (VALUES {_grid}),
x AS (
  SELECT config, up, jd, coalesce(h.cand, b.cand) AS cand, demand, weight IS NOT NULL AS matched, least(weight, 1.0::DOUBLE) AS own,
    coalesce(dist IS NOT NULL AND dist <= cutoff AND hops <= mh, FALSE) AS ok, least(greatest(0.0::DOUBLE, 1.0::DOUBLE - dist) * scale, coalesce(cap, 1e9)) AS bc
  FROM have h FULL JOIN best b ON h.cand = b.cand AND h.skill = b.skill JOIN wants w ON w.skill = coalesce(h.skill, b.skill) CROSS JOIN grid),
y AS (SELECT config, up, jd, cand, coalesce(sum(CASE WHEN matched THEN demand * (CASE WHEN ok AND own < 1 THEN greatest(own, least(bc, 1.0::DOUBLE)) ELSE own END) WHEN ok THEN demand * bc END), 0) AS gain, coalesce(sum(demand) FILTER (matched OR ok), 0) AS met FROM x GROUP BY 1, 2, 3, 4),
t AS (SELECT jd, sum(demand) AS td FROM wants GROUP BY 1)
SELECT config::BIGINT AS config, jd, count(*) AS n, {P.rounded(f"avg({P.rounded('(gain - up * (td - met)) / td', 3)})", 6)} AS mean_total, max({P.rounded('(gain - up * (td - met)) / td', 3)}) AS best FROM y JOIN t USING (jd) GROUP BY 1, 2""")
def param_sweep(t: Tables) -> DataFrame:
    x = matching.sweep(t.wants(), t.have(), t.paths(), GRID)
    return x.groupBy(F.col("config").cast("long").alias("config"), "jd").agg(F.count("*").alias("n"), r(F.avg("total")).alias("mean_total"), F.max("total").alias("best"))


# Text

_NORM = r"trim(regexp_replace(array_to_string([trim(regexp_replace(x, '[ \t\r\f\v]+', ' ', 'g'), ' ') for x in string_split(text, chr(10))], chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10))"
_WORDS = r"[x for x in regexp_split_to_array(trim(text, ' ' || chr(10) || chr(9) || chr(13)), '[ \t\r\n]+') if x <> '']"


@query(f"SELECT doc_id, md5({_NORM}) AS norm_md5, length({_NORM})::BIGINT AS n FROM documents")
def normalize_lines(t: Tables) -> DataFrame:
    x = t.documents.select("doc_id", T.normalize_document(F.col("text")).alias("x"))
    return x.select("doc_id", F.md5(F.col("x").cast("binary")).alias("norm_md5"), F.length("x").cast("long").alias("n"))


def _chunk_sql(size: int, overlap: int) -> str:
    return f"""w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
c AS (SELECT doc_id, w, unnest(range(0, CASE WHEN len(w) = 0 THEN 0 ELSE 1 + ceil(greatest(len(w) - {size}, 0) / {float(size - overlap)})::BIGINT END)) AS i FROM w),
chunk AS (SELECT doc_id, i AS index, array_to_string(w[i * {size - overlap} + 1 : i * {size - overlap} + {size}], ' ') AS text FROM c)"""


@query(f"WITH {_chunk_sql(375, 40)} SELECT doc_id, index, md5(text) AS text_md5 FROM chunk")
def chunk_windows(t: Tables) -> DataFrame:
    return documents.chunked(t.documents).select("doc_id", F.col("index").cast("long").alias("index"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(f"""WITH {_chunk_sql(100, 10)}, g AS (SELECT doc_id, index // 3 AS g, index, text, count(*) OVER (PARTITION BY doc_id, index // 3) AS n, row_number() OVER (PARTITION BY doc_id, index // 3 ORDER BY index) AS rn FROM chunk)
SELECT doc_id, g AS "group", any_value(n) AS n, md5(CASE WHEN any_value(n) = 1 THEN any_value(text) ELSE string_agg('--- SECTION ' || rn || ' of ' || n || ' ---' || chr(10) || text, chr(10) || chr(10) ORDER BY rn) END) AS text_md5 FROM g GROUP BY 1, 2""")
def chunk_groups(t: Tables) -> DataFrame:
    x = documents.chunk_groups(documents.chunked(t.documents, 100, 10), 3)
    return x.select("doc_id", F.col("group").cast("long").alias("group"), "n", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(f"WITH h AS (SELECT doc_id, sha256({_NORM}) AS content_hash FROM documents) SELECT doc_id, content_hash, min(doc_id) OVER (PARTITION BY content_hash) AS original FROM h")
def content_dedupe(t: Tables) -> DataFrame:
    return documents.first_of_each(documents.hashed(t.documents)).select("doc_id", "content_hash", "original")


_PRODUCT = "SELECT DISTINCT (CASE p_size % 4 WHEN 0 THEN 'Microsoft ' WHEN 1 THEN 'Red Hat ' WHEN 2 THEN '' ELSE 'IBM ' END) || p_name || (CASE p_size % 3 WHEN 0 THEN ' software' WHEN 1 THEN ' SQL' ELSE '' END) AS name FROM part"


def _products(t: Tables) -> DataFrame:
    s = F.col("p_size")
    head = F.when(s % 4 == 0, "Microsoft ").when(s % 4 == 1, "Red Hat ").when(s % 4 == 2, "").otherwise("IBM ")
    tail = F.when(s % 3 == 0, " software").when(s % 3 == 1, " SQL").otherwise("")
    return t.part.select(F.concat(head, "p_name", tail).alias("name")).distinct()


_N = r"lower(trim(regexp_replace(regexp_replace(name, '[^\w+#.\- ]+', ' ', 'g'), '\s+', ' ', 'g')))"
_PREFIX = "^(" + "|".join(T.VENDOR_PREFIXES) + ")"
_CORE = f"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_N}, '{_PREFIX}', ''), ' software$', ''), ' ci$', ''), ' ide$', ''))"
_STOP = ", ".join(f"'{x}'" for x in T.STOP_CORES)
_ACRO = r"[x for x in list_distinct([lower(y) for y in regexp_extract_all(name, '\b[A-Z][A-Z0-9]{1,5}\b')]) if x NOT IN (" + _STOP + ")]"


@query(f"WITH p AS ({_PRODUCT}) SELECT name, {_N} AS norm, {_CORE} AS core FROM p")
def core_form(t: Tables) -> DataFrame:
    return _products(t).select("name", T.normalize(F.col("name")).alias("norm"), T.core_form(F.col("name")).alias("core"))


@query(f"WITH p AS ({_PRODUCT}) SELECT name, array_to_string(list_sort({_ACRO}), ' ') AS acronyms FROM p")
def acronyms(t: Tables) -> DataFrame:
    return _products(t).select("name", F.array_join(T.embedded_acronyms(F.col("name")), " ").alias("acronyms"))


_INDEX = f"""p AS ({_PRODUCT}), f AS (SELECT DISTINCT name AS node, unnest(list_concat([{_N}, {_CORE}], {_ACRO})) AS surface FROM p),
idx AS (SELECT surface, min(node) AS node FROM f WHERE length(surface) >= 2 AND surface NOT IN ({_STOP}) GROUP BY 1 HAVING count(DISTINCT node) = 1)"""


@query(f"WITH {_INDEX} SELECT surface, node FROM idx")
def surface_index(t: Tables) -> DataFrame:
    return linking.surface_index(_products(t))


@query(f"""WITH {_INDEX}, s AS (SELECT p_partkey AS doc_id, p_name AS surface, CASE p_size % 2 WHEN 0 THEN 0.5 ELSE 1.5 END::DOUBLE AS weight FROM part UNION ALL SELECT p_partkey, 'sku ' || p_brand, 1.0 FROM part),
j AS (SELECT doc_id, s.surface, weight, idx.node AS node FROM s LEFT JOIN idx ON idx.surface = lower(trim(regexp_replace(regexp_replace(s.surface, '[^\\w+#.\\- ]+', ' ', 'g'), '\\s+', ' ', 'g'))))
SELECT doc_id, surface, weight, node, CASE WHEN node IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS score, CASE WHEN node IS NULL THEN 'unresolved' ELSE 'surface' END AS method FROM j""")
def link_cascade(t: Tables) -> DataFrame:
    s = t.part.select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("surface"), F.when(F.col("p_size") % 2 == 0, 0.5).otherwise(1.5).alias("weight"))
    s = s.union(t.part.select("p_partkey", F.concat(F.lit("sku "), "p_brand"), F.lit(1.0)))
    return linking.link(s, _products(t), linking.alias_table(t.spark, {}), use_embedding=False)


@query(r"""WITH w AS (SELECT DISTINCT conv_id AS doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS w FROM conversations),
a AS (SELECT DISTINCT word AS node FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS word FROM benchmark) WHERE length(word) >= 5)
SELECT DISTINCT doc_id, node FROM w JOIN a ON w = node""")
def gazetteer(t: Tables) -> DataFrame:
    names = t.benchmark.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\w+"), 0)).alias("alias")).where("length(alias) >= 5").distinct()
    return linking.gazetteer_matches(t.conversations.select(F.col("conv_id").alias("doc_id"), "text"), names.withColumn("node", F.col("alias")))


MENTIONS = """m AS (SELECT conv_id AS doc_id, turn AS seq, skill, least(0.5 + 0.5 * (count(*) - 1), 1.5)::DOUBLE AS weight, 'turn ' || turn AS context
  FROM (SELECT conv_id, turn, unnest(string_split_regex(regexp_replace(lower(text), '[^a-z ]', ' ', 'g'), ' +')) AS skill FROM conversations) WHERE length(skill) >= 4 GROUP BY 1, 2, 3)"""


@query(f"WITH {MENTIONS} SELECT doc_id, skill, weight, context FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(skill) ORDER BY weight DESC, seq) AS rn FROM m) WHERE rn = 1")
def merge_mentions(t: Tables) -> DataFrame:
    return linking.merge_mentions(t.mentions()).select("doc_id", "skill", "weight", "context")


@query(f"WITH {MENTIONS}, n AS (SELECT *, substr(skill, 1, 4) AS node FROM m) SELECT doc_id, node, max(weight) AS weight, min_by(context, struct_pack(w := -weight, s := seq, k := skill)) AS context FROM n GROUP BY 1, 2")
def link_max_weight(t: Tables) -> DataFrame:
    x = t.mentions().withColumn("node", F.substring("skill", 1, 4)).withColumns({"method": F.lit("prefix"), "score": F.lit(1.0)})
    first = x.withColumn("seq", F.dense_rank().over(W.partitionBy("doc_id", "node").orderBy("seq", "skill")))
    return linking.collapse(first).select("doc_id", "node", "weight", "context")


# Pool


def _candidates(t: Tables) -> DataFrame:
    batches = F.array_sort(F.collect_set(F.concat(F.lit("b"), (F.col("o_orderkey") % 5).cast("string"))))
    unresolved = F.array_sort(F.collect_set(F.when(F.col("o_orderpriority").startswith("1"), F.col("o_orderstatus"))))
    return t.orders.groupBy(F.col("o_custkey").alias("candidate_id")).agg(batches.alias("batch_ids"), unresolved.alias("unresolved")).withColumn("name", F.concat(F.lit("cand "), F.col("candidate_id").cast("string")))


POOL = """pool AS (SELECT o_custkey AS candidate_id, 'cand ' || o_custkey AS name, list_sort(list_distinct(list('b' || (o_orderkey % 5)))) AS batch_ids,
  coalesce(list_distinct(list(o_orderstatus) FILTER (starts_with(o_orderpriority, '1'))), []) AS unresolved FROM orders GROUP BY 1)"""


@query(f"WITH {POOL}, {P.HAVE}, n AS (SELECT cand, count(*) AS n FROM have GROUP BY 1) SELECT candidate_id, name, coalesce(n, 0) AS skill_count, len(unresolved)::BIGINT AS unresolved_count FROM pool LEFT JOIN n ON cand = candidate_id")
def pool_summary(t: Tables) -> DataFrame:
    return documents.pool_summary(_candidates(t), t.have().withColumnRenamed("cand", "candidate_id"))


@query(f"WITH {POOL} SELECT candidate_id, name FROM pool WHERE list_contains(batch_ids, 'b2')")
def batch_scope(t: Tables) -> DataFrame:
    return documents.in_batch(_candidates(t), "b2").select("candidate_id", "name")


@query(f"""WITH {POOL}, o AS (SELECT * FROM pool WHERE candidate_id % 3 <> 0), n AS (SELECT candidate_id, 'new ' || candidate_id AS name, ['b9'] AS batch_ids FROM pool WHERE candidate_id % 2 = 0)
SELECT coalesce(o.candidate_id, n.candidate_id) AS candidate_id, coalesce(n.name, o.name) AS name, array_to_string(list_concat(coalesce(o.batch_ids, []), coalesce(n.batch_ids, [])), ',') AS batches FROM o FULL JOIN n ON o.candidate_id = n.candidate_id""")
def upsert_candidates(t: Tables) -> DataFrame:
    c = _candidates(t).drop("unresolved")
    new = c.where("candidate_id % 2 = 0").select("candidate_id", F.concat(F.lit("new "), F.col("candidate_id").cast("string")).alias("name"), F.array(F.lit("b9")).alias("batch_ids"))
    out = documents.upsert(c.where("candidate_id % 3 <> 0"), new, "candidate_id", append=("batch_ids",))
    return out.select("candidate_id", "name", F.array_join("batch_ids", ",").alias("batches"))


@query(f"WITH {P.HAVE} SELECT cand, skill, weight FROM have WHERE cand % 4 <> 0 UNION ALL SELECT cand, skill, 1.5::DOUBLE FROM have WHERE cand % 4 = 0 AND skill < 100")
def upsert_replace_edges(t: Tables) -> DataFrame:
    h = t.have()
    new = h.where("cand % 4 = 0 AND skill < 100").withColumn("weight", F.lit(1.5))
    return documents.replace_children(h, new, h.where("cand % 4 = 0"), "cand")


@query("SELECT user_id, count(*) AS n, count(*) FILTER (k > 3) AS over FROM (SELECT user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW) AS k FROM events) GROUP BY 1")
def rate_window(t: Tables) -> DataFrame:
    return documents.calls_in_window(t.events, 3600, 3).groupBy("user_id").agg(F.count("*").alias("n"), F.count_if("over").alias("over"))


# Evaluation

GRADED = "g AS (SELECT source AS query, doc_id AS cand, (n_chars % 97)::DOUBLE AS score, (2 * quality + 1 - toxic)::BIGINT AS grade FROM documents JOIN labels USING (doc_id))"
RANKED = f"{GRADED}, r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, cand) AS rank FROM g)"


@query(f"WITH {RANKED} SELECT query, round(avg((grade >= 2)::INT), 6) AS p_at_k FROM r WHERE rank <= 5 GROUP BY 1")
def precision_at_k(t: Tables) -> DataFrame:
    return evaluation.precision_at(evaluation.ranked(t.graded()), 5).withColumn("p_at_k", r("p_at_k"))


@query(f"WITH {RANKED} SELECT query, round(coalesce(1.0::DOUBLE / min(rank) FILTER (grade >= 2), 0), 6) AS mrr FROM r GROUP BY 1")
def mrr(t: Tables) -> DataFrame:
    return evaluation.mrr_of(t.graded()).withColumn("mrr", r("mrr"))


@query(f"""WITH {RANKED}, a AS (SELECT *, avg(grade) OVER (PARTITION BY query, score) AS mean, row_number() OVER (PARTITION BY query ORDER BY grade DESC) AS ideal FROM r)
SELECT query, round(CASE WHEN sum(grade / log2(ideal + 1)) FILTER (ideal <= 10) > 0 THEN sum(mean / log2(rank + 1)) FILTER (rank <= 10) / sum(grade / log2(ideal + 1)) FILTER (ideal <= 10) ELSE 0 END, 6) AS ndcg FROM a GROUP BY 1""")
def ndcg_ties(t: Tables) -> DataFrame:
    return evaluation.ndcg(t.graded()).withColumn("ndcg", r("ndcg"))


@query(f"WITH {GRADED} SELECT a.query, sum(CASE WHEN a.score > b.score THEN 2 WHEN a.score = b.score THEN 1 ELSE 0 END)::BIGINT AS wins2, (2 * count(*))::BIGINT AS pairs2 FROM g a JOIN g b ON a.query = b.query AND a.grade = 3 AND b.grade = 1 GROUP BY 1")
def pairwise_accuracy(t: Tables) -> DataFrame:
    return evaluation.pairwise(t.graded(), 3, 1).where("pairs2 > 0")


@query(f"""WITH {P.terms()}, b AS (SELECT skill % 10 AS g1, via % 10 AS g2 FROM terms WHERE bridged)
SELECT count(*) AS calls, round(coalesce(avg((g1 = g2)::INT), 0), 6) AS precision FROM b""")
def bridge_precision(t: Tables) -> DataFrame:
    b = matching.bridges(t.wants(), t.have(), t.paths(), P.PARAMS)
    same = F.sum(F.when(F.col("skill") % 10 == F.col("via") % 10, F.col("n")).otherwise(0))
    return b.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("calls"), r(F.coalesce(same / F.sum("n"), F.lit(0.0))).alias("precision"))


@query(f"""WITH {P.HAVE}, {P.WANTS}, c AS (SELECT DISTINCT cand FROM have),
t AS (SELECT jd, cand::VARCHAR AS cand, skill FROM c JOIN have USING (cand) CROSS JOIN (SELECT DISTINCT jd FROM wants) UNION ALL SELECT jd, NULL, skill FROM wants),
i AS (SELECT jd, skill, ln((1.0::DOUBLE + (SELECT count(*) + 1 FROM c)) / (1.0::DOUBLE + count(*))) + 1 AS idf FROM t GROUP BY 1, 2),
x AS (SELECT t.jd, t.cand, t.skill, idf FROM t JOIN i ON t.jd = i.jd AND t.skill = i.skill), n AS (SELECT jd, cand, sqrt(sum(idf * idf)) AS norm FROM x GROUP BY 1, 2),
d AS (SELECT a.jd, a.cand, sum(a.idf * b.idf) AS dot FROM x a JOIN x b ON a.jd = b.jd AND a.skill = b.skill AND b.cand IS NULL WHERE a.cand IS NOT NULL GROUP BY 1, 2)
SELECT n.jd AS query, n.cand, {P.rounded('coalesce(dot / (n.norm * q.norm), 0)', 6)} AS score FROM n JOIN n q ON q.jd = n.jd AND q.cand IS NULL LEFT JOIN d ON d.jd = n.jd AND d.cand = n.cand WHERE n.cand IS NOT NULL""")
def tfidf_rank(t: Tables) -> DataFrame:
    have = t.have()
    wants = t.wants().select(F.col("jd").alias("query"), "skill")
    return evaluation.tfidf_of_all(wants, have).withColumn("score", r("score"))


@query("""WITH q AS (SELECT label, list(embedding::DOUBLE[]) AS l FROM embeddings GROUP BY 1), e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)
SELECT a.label::BIGINT AS query, a.vec_id, rank FROM (SELECT s.label, s.vec_id, row_number() OVER (PARTITION BY s.label ORDER BY list_cosine_similarity(s.v, t.v) DESC, s.vec_id) AS rank
FROM e s JOIN (SELECT label, min_by(v, vec_id) AS v FROM e GROUP BY 1) t ON s.label = t.label) a WHERE rank <= 10""")
def cosine_rank(t: Tables) -> DataFrame:
    from ..functions.vectors import cosine

    e = t.embeddings.select("vec_id", F.col("label").cast("long").alias("query"), "embedding")
    q = e.groupBy("query").agg(F.min_by("embedding", "vec_id").alias("q"))
    place = F.row_number().over(W.partitionBy("query").orderBy(F.desc("sim"), "vec_id"))
    x = e.join(q, "query").withColumn("sim", cosine(F.col("embedding"), F.col("q"))).withColumn("rank", place.cast("long"))
    return x.where("rank <= 10").select("query", "vec_id", "rank")


@query(f"""WITH {RANKED}, v AS (SELECT query, avg((grade >= 2)::INT)::DOUBLE AS value, row_number() OVER (ORDER BY query) - 1 AS item FROM r WHERE rank <= 5 GROUP BY 1),
slots AS (SELECT i AS iter, s AS slot, (SELECT count(*) FROM v) AS n FROM range(1000) a(i), range((SELECT count(*) FROM v)) b(s)),
drawn AS (SELECT iter, ('0x' || substr(md5('draw:' || iter || ':' || slot), 1, 12))::BIGINT % n AS item FROM slots),
m AS (SELECT iter, avg(value) AS m FROM drawn JOIN v USING (item) GROUP BY 1), l AS (SELECT list_sort(list(m)) AS a FROM m)
SELECT round(a[floor(len(a) * 0.025)::INT + 1], 6) AS lo, round(a[floor(len(a) * 0.975)::INT + 1], 6) AS hi FROM l""")
def bootstrap_ci(t: Tables) -> DataFrame:
    p = evaluation.precision_at(evaluation.ranked(t.graded()), 5)
    v = p.select((F.row_number().over(W.partitionBy(F.lit(0)).orderBy("query")) - 1).alias("item"), F.col("p_at_k").alias("value"), F.lit(1.0).alias("weight"))
    out = evaluation.bootstrap(v, evaluation.hashed_draws(v))
    return out.select(r("lo").alias("lo"), r("hi").alias("hi"))


# Typed edges: parts classify pairs of skills

_TYPED = """typed AS (SELECT p_partkey % (SELECT greatest(1, count(*)) FROM embeddings) AS a, (p_partkey * 7) % (SELECT greatest(1, count(*)) FROM embeddings) AS b, CASE p_size % 4 WHEN 0 THEN 'substitute' WHEN 1 THEN 'prerequisite' WHEN 2 THEN 'complement' ELSE 'unrelated' END AS edge_type,
  CASE WHEN p_size % 8 < 4 THEN 'a_to_b' ELSE 'symmetric' END AS direction, (p_size % 10) / 10.0::DOUBLE AS confidence, p_partkey AS seq FROM part WHERE p_partkey % (SELECT greatest(1, count(*)) FROM embeddings) <> (p_partkey * 7) % (SELECT greatest(1, count(*)) FROM embeddings))"""


def _typed(t: Tables) -> DataFrame:
    s = F.col("p_size")
    a, b = F.col("p_partkey") % t.n_skills(), F.col("p_partkey") * 7 % t.n_skills()
    kind = F.when(s % 4 == 0, "substitute").when(s % 4 == 1, "prerequisite").when(s % 4 == 2, "complement").otherwise("unrelated")
    return t.part.where(a != b).select(a.alias("a"), b.alias("b"), kind.alias("edge_type"), F.when(s % 8 < 4, "a_to_b").otherwise("symmetric").alias("direction"), ((s % 10) / 10.0).alias("confidence"), F.col("p_partkey").alias("seq"))


@query(f"""WITH {_TYPED}, c AS (SELECT least(a, b) AS lo, greatest(a, b) AS hi, edge_type, seq, (CASE edge_type WHEN 'substitute' THEN 0.2 ELSE 0.6 END)::DOUBLE * (2 - confidence) AS cost FROM typed WHERE edge_type IN ('substitute', 'prerequisite'))
SELECT lo, hi, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - max_by(cost, seq))), 3) AS weight, max_by(edge_type, seq) AS edge_source FROM c GROUP BY 1, 2""")
def typed_edges_cost(t: Tables) -> DataFrame:
    return graph.typed_edges(_typed(t))


@query(f"WITH {_TYPED} SELECT least(a, b) AS lo, greatest(a, b) AS hi, count(*) AS n FROM typed WHERE edge_type = 'prerequisite' AND direction <> 'symmetric' GROUP BY 1, 2 HAVING count(*) > 1")
def typed_conflicts(t: Tables) -> DataFrame:
    return graph.type_conflicts(_typed(t))


@query(f"WITH {_TYPED} SELECT edge_type, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 3) AS share FROM typed GROUP BY 1")
def type_shares(t: Tables) -> DataFrame:
    return graph.type_shares(_typed(t)).drop("alarm")


@query("""WITH s AS (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_partkey % 9 END AS expected, (p_partkey * 3) % 9 AS found, (p_partkey % 100) / 100.0::DOUBLE AS score FROM part),
t(threshold) AS (VALUES (0.6::DOUBLE), (0.75::DOUBLE), (0.8::DOUBLE), (0.86::DOUBLE))
SELECT threshold, count(*) FILTER (score >= threshold AND found = expected) AS correct, count(*) FILTER (expected IS NOT NULL AND score < threshold) AS missed, count(*) FILTER (score >= threshold AND NOT coalesce(found = expected, FALSE)) AS wrong FROM s CROSS JOIN t GROUP BY 1""")
def calibration_table(t: Tables) -> DataFrame:
    s = t.part.select(F.when(F.col("p_size") % 5 != 0, F.col("p_partkey") % 9).alias("expected"), (F.col("p_partkey") * 3 % 9).alias("found"), ((F.col("p_partkey") % 100) / 100.0).alias("score"))
    return linking.calibrate(s, [0.6, 0.75, 0.8, 0.86])


# Streams: files of a table as a source, results in the shared checkpoint folder


def _streamed(t: Tables, table: str, plan) -> DataFrame:
    """plan over a stream of a table's files, run to its end with a checkpoint, and its Parquet output."""

    folder = new_folder(t.spark, "stream")
    batch = getattr(t, table)
    source = t.spark.readStream.schema(batch.schema).parquet(f"{t.dir}/{table}.parquet*")
    out = plan(source)
    out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema(out.schema).parquet(f"{folder}/out")


@query(f"SELECT DISTINCT sha256({_NORM}) AS content_hash FROM documents")
def stream_ingest(t: Tables) -> DataFrame:
    """Content-hash deduplication of a stream of documents."""
    return _streamed(t, "documents", lambda df: documents.hashed(df).select("content_hash").dropDuplicates(["content_hash"]))


@query("""WITH w AS (SELECT time_bucket(INTERVAL 10 MINUTES, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2), m AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM events)
SELECT epoch(start)::BIGINT AS start, event_type, n, value FROM w, m WHERE start + INTERVAL 10 MINUTES <= mark""")
def stream_event_windows(t: Tables) -> DataFrame:
    """Windows of ten minutes that an hour's watermark has closed."""

    def plan(df):
        x = df.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "1 hour")
        x = x.groupBy(F.window("at", "10 minutes").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))
        return x.select(F.unix_timestamp("w.start").alias("start"), "event_type", "n", "value")

    return _streamed(t, "events", plan)


# Evaluation of the arms that need no graph


@query()
def eval_arms(t: Tables) -> DataFrame:
    """arm, split and metrics of the no-bridging, tf-idf and count-only arms over all judged pairs."""
    wants, graded, have = t.judged()
    kind = dict(have.dtypes)["skill"]
    none = t.spark.createDataFrame([], f"src {kind}, dst {kind}, dist double, hops int")
    name = lambda df: df.select(F.col("jd").alias("query"), "cand", F.col("total").alias("score"))
    arms = {
        "no_bridging": name(matching.scores(wants, have, none, S.ScoringParams(enable_bridging=False))),
        "tfidf": evaluation.tfidf(wants.select(F.col("jd").alias("query"), "skill"), have, graded.select(F.col("jd").alias("query"), "cand")).withColumn("score", F.round("score", 9)),
        **{f"count_only_{k}": name(matching.count_only(wants, have, k)) for k in (0.9, 1.0, 1.5238)},
    }
    scored = None
    for arm, df in arms.items():
        df = df.select(F.lit(arm).alias("arm"), F.col("query").alias("jd"), "cand", "score")
        scored = df if scored is None else scored.unionByName(df)
    x = graded.join(scored, ["jd", "cand"]).select(F.concat_ws("/", "arm", "split", "jd").alias("query"), "cand", "score", "grade", "pos").persist()
    ranks = evaluation.ranked(x)
    m = evaluation.precision_at(ranks, 5).join(evaluation.mrr(ranks), "query").join(evaluation.ndcg(x), "query").join(evaluation.pairwise(x, 2, 1), "query")
    part = lambda i: F.split("query", "/")[i]
    return m.groupBy(part(0).alias("arm"), part(1).alias("split")).agg(
        r(F.try_divide(F.sum("wins2"), F.sum("pairs2"))).alias("bridge_over_weak"), r(F.avg("ndcg")).alias("ndcg_10"), r(F.avg("p_at_k")).alias("p_5"), r(F.avg("mrr")).alias("mrr")
    ).where("bridge_over_weak IS NOT NULL")  # an arm and split without a pair to compare has no row


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["rank_topk"](spark, sf_dir)
