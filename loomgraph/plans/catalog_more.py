"""Further registered queries: stores, files, linking with aliases and vectors, payloads, and the seeded evaluation."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as T
from ..operators import documents, dynamic, embedding, evaluation, graph, linking, matching, paths, topk
from ..operators.hublabels import HubLabels
from ..operators.vectorindex import VectorIndex
from ..operators.workspace import new_folder, spread
from ..sources import datasource, readers
from ..sources.store import Store, summarise
from ..streaming import lanes
from . import catalog as C
from . import build as B
from . import projection as P
from .catalog import query, r
from .projection import Tables


def _folder(t: Tables, name: str) -> str:
    return new_folder(t.spark, name)


# Files


@query(f"WITH {C.TAXONOMY} SELECT soc, skill, count(*) AS n, count(*) FILTER (hot) AS hot FROM raw GROUP BY 1, 2")
def taxonomy_files(t: Tables) -> DataFrame:
    """The taxonomy written as tab-separated files and read back."""
    occupations, skills = C._taxonomy(t)
    folder = _folder(t, "taxonomy")
    out = lambda df, name: df.write.csv(f"{folder}/{name}", sep="\t", header=True)
    out(occupations.select(F.col("soc").alias("O*NET-SOC Code"), F.col("title").alias("Title")), "Occupation Data.txt")
    named = {"soc": "O*NET-SOC Code", "skill": "Workplace Example", "element": "Element Name", "hot": "Hot Technology", "demand": "In Demand"}
    out(skills.withColumnsRenamed(named), "Software Skills.txt")
    found = readers.read_taxonomy(t.spark, folder)
    x = spread(found[1].join(found[0].select("soc").distinct(), "soc"), t.lineitem.count(), "soc", "skill")
    return x.groupBy("soc", "skill").agg(F.count("*").alias("n"), F.count_if(F.col("hot") == "Y").alias("hot"))


@query("SELECT coalesce(lang, 'und') AS lang, sum(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\x0B]+')))::BIGINT AS n_words FROM documents WHERE text IS NOT NULL GROUP BY 1")
def document_files(t: Tables) -> DataFrame:
    """Texts written as text files, a folder for each language, and read back by the data source for documents."""
    folder = _folder(t, "files")
    texts = t.documents.where("text IS NOT NULL").select(F.concat(F.lit("in-"), F.coalesce("lang", F.lit("und"))).alias("of"), "text")
    texts.write.partitionBy("of").option("maxRecordsPerFile", 500).text(folder)
    found = datasource.read(t.spark, folder, recursiveFileLookup="true")
    words = F.size(F.regexp_extract_all("text", F.lit(r"[^ \t\n\r\f\x0B]+"), F.lit(0)))
    return found.groupBy(F.regexp_extract("path", "of=in-([^/]*)/", 1).alias("lang")).agg(F.sum(F.when(F.col("error").isNull(), words)).alias("n_words"))


@query(f"""WITH {C.TAXONOMY}, kept AS (SELECT * FROM raw WHERE soc LIKE '15-%' AND (hot OR demand))
SELECT 'requires' AS kind, count(DISTINCT (title, skill))::BIGINT AS n FROM kept JOIN occ USING (soc)
UNION ALL SELECT 'roles', count(DISTINCT title)::BIGINT FROM occ WHERE soc LIKE '15-%'
UNION ALL SELECT 'skills', count(DISTINCT skill)::BIGINT FROM kept""")
def built_graph(t: Tables) -> DataFrame:
    """The graph built from the taxonomy in one call: vectors of all nodes, edges, and one commit; its edges are tested against
    numpy."""
    store = Store(t.spark, _folder(t, "built"))
    B.build(store, *C._taxonomy(t), custom=False, max_density=None)
    return store.counts().where("kind IN ('skills', 'roles', 'requires')")


@query("""WITH c AS (SELECT doc_id, lang, sha256(text) AS content_hash FROM documents WHERE text IS NOT NULL),
k AS (SELECT min(content_hash) AS content_hash FROM c GROUP BY lang)
SELECT content_hash, min(doc_id) AS first_doc, count(*) AS n FROM c WHERE content_hash IN (SELECT content_hash FROM k) GROUP BY 1""")
def hash_lookups(t: Tables) -> DataFrame:
    """Documents looked up by content hash in a stored table whose files have Bloom filters: each language's first hash."""
    store = Store(t.spark, _folder(t, "lookups"))
    rows = t.documents.where("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("candidate_id"), F.col("lang").alias("doc_type"), F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"))
    have = set(rows.columns)
    store.commit({"candidates": rows.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in store.read("candidates").schema if f.name not in have])})
    stored = store.read("candidates")
    wanted = stored.groupBy("doc_type").agg(F.min("content_hash").alias("content_hash")).select("content_hash").distinct()
    return stored.join(wanted, "content_hash").groupBy("content_hash").agg(F.min(F.col("candidate_id").cast("long")).alias("first_doc"), F.count("*").alias("n"))


@query(f"""WITH {C._TYPED}, l AS (SELECT least(a, b)::VARCHAR AS lo, greatest(a, b)::VARCHAR AS hi, edge_type, seq, row_number() OVER (PARTITION BY least(a, b), greatest(a, b) ORDER BY seq DESC) AS rn FROM typed)
SELECT lo, hi, edge_type, seq FROM l WHERE rn = 1""")
def typed_cache(t: Tables) -> DataFrame:
    """Classified pairs appended to a JSON-lines cache in two writes; the last of a pair counts."""
    folder = _folder(t, "typed")
    x = C._typed(t).withColumns({"a": F.col("a").cast("string"), "b": F.col("b").cast("string"), "source": F.lit("llm"), "rationale": F.lit("")})
    for part in (0, 1):
        readers.append_typed_cache(x.where(F.col("seq") % 2 == part), folder)
    c = readers.read_typed_cache(t.spark, folder)
    # pairs are ordered as numbers here, as the SQL does
    lo = F.least(F.col("a").cast("long"), F.col("b").cast("long")).cast("string")
    hi = F.greatest(F.col("a").cast("long"), F.col("b").cast("long")).cast("string")
    return c.select(lo.alias("lo"), hi.alias("hi"), "edge_type", "seq")


# The store


@query("""WITH req AS (SELECT DISTINCT n_name AS role, c_mktsegment AS skill FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment <> 'BUILDING')
SELECT n_name AS role, '15-' || (n_regionkey + 10) AS soc, (SELECT count(*) FROM req WHERE role = n_name) AS requires FROM nation""")
def store_roles(t: Tables) -> DataFrame:
    """Roles put in twice, and requirements, of which those of unknown skills are skipped; roles without any stay."""
    s = Store(t.spark, _folder(t, "store"))
    seg = t.customer.select(F.col("c_mktsegment").alias("name")).distinct()
    s.upsert_skills(seg.where("name <> 'BUILDING'").withColumn("source", F.lit("seg")))
    role = lambda add: t.nation.select(F.col("n_name").alias("name"), F.concat(F.lit("15-"), (F.col("n_regionkey") + add).cast("string")).alias("soc"))
    s.upsert_roles(role(0))
    s.upsert_roles(role(10))
    x = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("role"), F.col("c_mktsegment").alias("skill")).distinct()
    s.upsert_requires(x)
    n = s.read("requires").groupBy("role").agg(F.count("*").alias("n"))
    return s.read("roles").select(F.col("name").alias("role"), "soc").join(n, "role", "left").select("role", "soc", F.coalesce("n", F.lit(0)).alias("requires"))


@query("""WITH a AS (SELECT least(x, y) AS lo, greatest(x, y) AS hi, max(w) AS w FROM (SELECT 's' || (p_partkey % 97) AS x, 's' || p_size AS y, p_size / 50.0::DOUBLE AS w FROM part WHERE p_partkey % 97 <> p_size) GROUP BY 1, 2),
b AS (SELECT lo, hi, 0.5::DOUBLE AS w FROM a WHERE w > 0.9::DOUBLE) SELECT a.lo, a.hi, round(coalesce(b.w, a.w), 6) AS weight FROM a LEFT JOIN b USING (lo, hi)""")
def store_similar(t: Tables) -> DataFrame:
    """Similarity edges put in, in either order, and then some of them anew."""
    s = Store(t.spark, _folder(t, "store"))
    x = t.part.where("p_partkey % 97 <> p_size").select(F.concat(F.lit("s"), (F.col("p_partkey") % 97).cast("string")).alias("lo"), F.concat(F.lit("s"), F.col("p_size").cast("string")).alias("hi"), (F.col("p_size") / 50.0).alias("weight"), F.lit("e").alias("edge_source"))
    s.upsert_similar(x)
    again = s.read("similar").where("weight > 0.9").select(F.col("hi").alias("lo"), F.col("lo").alias("hi"), F.lit(0.5).alias("weight"), "edge_source")
    s.upsert_similar(again)
    return s.read("similar").select("lo", "hi", r("weight").alias("weight"))


@query("""SELECT 'c' || o_custkey AS candidate_id, array_to_string(list_sort(list_distinct(list_concat(['b1'], CASE WHEN o_custkey % 3 = 0 THEN ['b2'] ELSE [] END, CASE WHEN o_custkey = (SELECT min(o_custkey) FROM orders) THEN ['b3'] ELSE [] END))), ',') AS batches,
  count(DISTINCT CASE WHEN o_custkey % 3 = 0 THEN 'P' || o_orderpriority ELSE o_orderstatus END) FILTER (CASE WHEN o_custkey % 3 = 0 THEN o_orderpriority <> '1-URGENT' ELSE TRUE END) AS skills
FROM orders WHERE o_custkey <> (SELECT max(o_custkey) FROM orders) GROUP BY o_custkey""")
def store_pool(t: Tables) -> DataFrame:
    """Candidates put in, put in again with other skills, attached to a batch, and removed; unknown nodes are skipped."""
    s = Store(t.spark, _folder(t, "store"))
    status, priority = t.orders.select(F.col("o_orderstatus").alias("name")).distinct(), t.orders.where("o_orderpriority <> '1-URGENT'").select(F.concat(F.lit("P"), "o_orderpriority").alias("name")).distinct()
    s.upsert_skills(status.union(priority).withColumn("source", F.lit("o")))
    name = F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("candidate_id")

    def put(orders: DataFrame, node, batch: str) -> None:
        c = orders.select(name).distinct()
        for column, kind in (("name", "string"), ("doc_type", "string"), ("content_hash", "string"), ("failed_chunks", "array<int>"), ("unresolved", "array<string>"), ("extracted_at", "timestamp")):
            c = c.withColumn(column, F.lit(None).cast(kind))
        skills = orders.select(name, node.alias("node")).distinct().withColumns({"weight": F.lit(1.0), "context": F.lit(""), "method": F.lit("m"), "link_score": F.lit(1.0)})
        s.upsert_candidates(c.withColumn("batch_ids", F.array(F.lit(batch))), skills)

    put(t.orders, F.col("o_orderstatus"), "b1")
    put(t.orders.where("o_custkey % 3 = 0"), F.concat(F.lit("P"), "o_orderpriority"), "b2")
    low, high = t.orders.agg(F.min("o_custkey"), F.max("o_custkey")).first()
    s.add_to_batch(f"c{low}", "b3")
    s.add_to_batch(f"c{low}", "b3")
    s.delete_candidate(f"c{high}")
    n = s.read("has_skill").groupBy("candidate_id").agg(F.count("*").alias("skills"))
    c = s.read("candidates").select("candidate_id", F.array_join(F.array_sort("batch_ids"), ",").alias("batches"))
    return c.join(n, "candidate_id", "left").select("candidate_id", "batches", F.coalesce("skills", F.lit(0)).alias("skills"))


_ARTIFACT = """sk AS (SELECT name FROM (SELECT CASE WHEN p_size % 11 = 0 THEN ' ' ELSE p_type END AS name FROM part)),
rl AS (SELECT p_brand AS name FROM part WHERE p_size > 10), rq AS (SELECT p_brand AS role, p_type AS skill FROM part),
sm AS (SELECT a.p_type AS lo, b.p_type AS hi, a.p_size / 40.0::DOUBLE AS w FROM part a JOIN part b ON a.p_partkey + 1 = b.p_partkey),
gsk AS (SELECT DISTINCT name FROM sk WHERE trim(name) <> ''), grl AS (SELECT DISTINCT name FROM rl),
grq AS (SELECT DISTINCT role, skill FROM rq WHERE role IN (SELECT name FROM grl) AND skill IN (SELECT name FROM gsk)),
gsm AS (SELECT DISTINCT least(lo, hi) AS lo, greatest(lo, hi) AS hi FROM sm WHERE lo <> hi AND w BETWEEN 0 AND 1 AND lo IN (SELECT name FROM gsk) AND hi IN (SELECT name FROM gsk)),
n AS (SELECT 'skills' AS kind, (SELECT count(*) FROM sk) AS rows, (SELECT count(*) FROM gsk) AS good UNION ALL SELECT 'roles', (SELECT count(*) FROM rl), (SELECT count(*) FROM grl)
  UNION ALL SELECT 'requires', (SELECT count(*) FROM rq), (SELECT count(*) FROM grq) UNION ALL SELECT 'similar', (SELECT count(*) FROM sm), (SELECT count(*) FROM gsm))"""


def _artifact(t: Tables) -> dict[str, DataFrame]:
    part = t.part
    next_ = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_type").alias("hi"))
    return {
        "skills": part.select(F.when(F.col("p_size") % 11 == 0, " ").otherwise(F.col("p_type")).alias("name")),
        "roles": part.where("p_size > 10").select(F.col("p_brand").alias("name"), F.lit("15-1").alias("soc")),
        "requires": part.select(F.col("p_brand").alias("role"), F.col("p_type").alias("skill")),
        "similar": part.join(next_, "p_partkey").select(F.col("p_type").alias("lo"), "hi", (F.col("p_size") / 40.0).alias("weight")),
    }


@query(f"WITH {_ARTIFACT} SELECT kind, rows, good, rows - good AS errors FROM n")
def store_migration(t: Tables) -> DataFrame:
    """An artifact with faulty rows written to a new store."""
    return Store(t.spark, _folder(t, "store")).migrate(_artifact(t))


@query(f"""WITH {_ARTIFACT}, g AS (SELECT kind, good AS n FROM n) SELECT kind, n FROM g
UNION ALL SELECT 'node_total', sum(n)::BIGINT FROM g WHERE kind IN ('skills', 'roles') UNION ALL SELECT 'relationship_total', sum(CASE kind WHEN 'similar' THEN 2 * n ELSE n END)::BIGINT FROM g WHERE kind IN ('requires', 'similar')""")
def artifact_summary(t: Tables) -> DataFrame:
    """What a migrated store holds, by kind."""
    s = Store(t.spark, _folder(t, "store"))
    s.migrate(_artifact(t))
    return summarise(s.read("skills"), s.read("roles"), s.read("requires"), s.read("similar")).withColumn("n", F.col("n").cast("long"))


@query("""WITH s AS (SELECT DISTINCT p_type AS name FROM part WHERE p_size < 40), a AS (SELECT p_type AS name FROM part UNION SELECT p_name FROM part)
SELECT a.name, s.name IS NOT NULL AS found FROM a LEFT JOIN s ON a.name = s.name""")
def point_lookup(t: Tables) -> DataFrame:
    """Which of all names of parts and their types are stored skills."""
    s = Store(t.spark, _folder(t, "store"))
    s.upsert_skills(t.part.where("p_size < 40").select(F.col("p_type").alias("name")).distinct().withColumn("source", F.lit("p")))
    return s.lookup(t.part.select(F.col("p_type").alias("name")).union(t.part.select("p_name")))


@query("""WITH a AS (SELECT DISTINCT p_type AS k FROM part WHERE p_size < 25), b AS (SELECT DISTINCT p_type AS k FROM part WHERE p_size >= 20)
SELECT coalesce(a.k, b.k) AS key, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'kept' END AS change FROM a FULL JOIN b ON a.k = b.k""")
def set_drift(t: Tables) -> DataFrame:
    """What a new set of names adds, keeps and lacks."""
    part = lambda cond: t.part.where(cond).select(F.col("p_type").alias("key"))
    return documents.drift(part("p_size < 25"), part("p_size >= 20"), "key")


# Graph views and orders


@query("""WITH n AS (SELECT vec_id AS name, CASE WHEN label < 8 THEN 'skill' ELSE 'role' END AS kind FROM embeddings),
e AS (SELECT least(a, b) AS lo, greatest(a, b) AS hi, rel FROM (SELECT p_partkey % (SELECT greatest(1, count(*)) FROM embeddings) AS a, (p_partkey * 3 + 1) % (SELECT greatest(1, count(*)) FROM embeddings) AS b, CASE WHEN p_size % 5 = 0 THEN 'requires' ELSE 'similar' END AS rel FROM part) WHERE a <> b),
v AS (SELECT lo, hi FROM e WHERE rel = 'similar' AND lo IN (SELECT name FROM n WHERE kind = 'skill') AND hi IN (SELECT name FROM n WHERE kind = 'skill')),
d AS (SELECT name, count(*) AS k FROM (SELECT lo AS name FROM v UNION ALL SELECT hi FROM v) GROUP BY 1)
SELECT n.name, coalesce(k, 0) AS degree FROM n LEFT JOIN d ON d.name = n.name WHERE kind = 'skill'""")
def skill_view(t: Tables) -> DataFrame:
    """The skills of a mixed graph, isolated ones too, with their similarity edges."""
    nodes = t.embeddings.select(F.col("vec_id").alias("name"), F.when(F.col("label") < 8, "skill").otherwise("role").alias("node_type"))
    a, b = F.col("p_partkey") % t.n_skills(), (F.col("p_partkey") * 3 + 1) % t.n_skills()
    edges = t.part.where(a != b).select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"), F.lit(1.0).alias("weight"), F.when(F.col("p_size") % 5 == 0, "requires").otherwise("similar").alias("relation"))
    skills, similar = graph.skill_view(nodes, edges)
    n = similar.select(F.col("lo").alias("name")).union(similar.select("hi")).groupBy("name").agg(F.count("*").alias("k"))
    return skills.join(n, "name", "left").select("name", F.coalesce("k", F.lit(0)).alias("degree"))


@query(f"""WITH {P.terms()}, g AS (SELECT jd, cand, skill, dist, row_number() OVER (PARTITION BY jd, cand ORDER BY dist, skill) AS place FROM terms WHERE bridged)
SELECT jd, cand, skill, round(dist, 6) AS distance, place FROM g WHERE place <= 3""")
def gap_places(t: Tables) -> DataFrame:
    """The three nearest bridgeable gaps of every pair."""
    x = matching.picked(t.wants(), t.have(), t.paths(), P.PARAMS, "bridged", 3)
    return x.select("jd", "cand", "skill", r("dist").alias("distance"), "place")


@query(f"WITH {P.WANTS} SELECT jd, skill, demand, row_number() OVER (PARTITION BY jd ORDER BY demand DESC, skill) AS place FROM wants")
def wanted_order(t: Tables) -> DataFrame:
    """The skills of a description by demand, then name."""
    return t.wants().withColumn("place", F.row_number().over(W.partitionBy("jd").orderBy(F.desc("demand"), "skill")).cast("long"))


@query(f"WITH {P.PATHS} SELECT src, dst, coalesce(round(dist, 4), -1) AS distance FROM paths UNION ALL SELECT -1, -1, -1")
def wire_distances(t: Tables) -> DataFrame:
    """Distances as they are sent: rounded, and -1 for none or an infinite one."""
    far = t.spark.createDataFrame([(-1, -1, float("inf"))], "src long, dst long, dist double")
    return t.paths().select("src", "dst", "dist").union(far).select("src", "dst", S.wire_distance(F.col("dist")).alias("distance"))


@query(f"WITH {C._TYPED} SELECT edge_type, direction, count(*) AS n, edge_type IN ('substitute', 'prerequisite') AS traversable, edge_type = 'prerequisite' AND direction <> 'symmetric' AS directed FROM typed GROUP BY 1, 2")
def typed_predicates(t: Tables) -> DataFrame:
    x = C._typed(t).groupBy("edge_type", "direction").agg(F.count("*").alias("n"))
    return x.withColumns({"traversable": S.is_traversable(F.col("edge_type")), "directed": S.is_directed(F.col("edge_type"), F.col("direction"))})


@query(f"WITH {P.HAVE} SELECT cand, string_agg(skill || '=' || weight, ',' ORDER BY skill) AS profile FROM have GROUP BY 1")
def pool_profiles(t: Tables) -> DataFrame:
    """The pool as a map of skills to weights for each candidate."""
    x = documents.profiles(t.have())
    entries = F.array_sort(F.map_entries("profile"))
    return x.select("cand", F.array_join(F.transform(entries, lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"].cast("string"))), ",").alias("profile"))


# Linking


_NORM = r"lower(trim(regexp_replace(regexp_replace(surface, '[^\w+#.\- ]+', ' ', 'g'), '\s+', ' ', 'g')))"


@query(rf"""WITH {C._INDEX}, al AS (SELECT lower('sku ' || p_brand) AS surface, min(p_name) AS node FROM part GROUP BY 1), live AS (SELECT * FROM al WHERE node IN (SELECT name FROM p)),
s AS (SELECT p_partkey AS doc_id, p_name AS surface FROM part UNION ALL SELECT p_partkey, 'SKU ' || p_brand FROM part),
k AS (SELECT doc_id, surface, {_NORM} AS key FROM s),
j AS (SELECT doc_id, k.surface, live.node AS a, idx.node AS b FROM k LEFT JOIN live ON live.surface = k.key LEFT JOIN idx ON idx.surface = k.key)
SELECT doc_id, surface, coalesce(a, b) AS node, CASE WHEN a IS NOT NULL THEN 'alias' WHEN b IS NOT NULL THEN 'surface' ELSE 'unresolved' END AS method FROM j""")
def alias_link(t: Tables) -> DataFrame:
    """Surfaces resolved by aliases, of which those of nodes that aren't there are dead, then by the surface index."""
    aliases = t.part.groupBy(F.lower(F.concat(F.lit("sku "), "p_brand")).alias("surface")).agg(F.min("p_name").alias("node"))
    s = t.part.select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("surface")).union(t.part.select("p_partkey", F.concat(F.lit("SKU "), "p_brand"))).withColumn("weight", F.lit(1.0))
    return linking.link(s, C._products(t), aliases, use_embedding=False).select("doc_id", "surface", "node", "method")


_VECTOR = """SELECT {key}, list(n ORDER BY b) AS v FROM (SELECT {key}, b, coalesce(n, 0)::DOUBLE AS n FROM {of} CROSS JOIN range(64) q(b) LEFT JOIN (
  SELECT {key}, (ord(substr(lower({text}), i, 1)) * 31 + ord(substr(lower({text}), i + 1, 1))) % 64 AS b, count(*) AS n FROM (SELECT {key}, {text}, unnest(range(1, length({text}))) AS i FROM {of}) GROUP BY 1, 2) USING ({key}, b)) GROUP BY 1"""


@query(f"""WITH {C._INDEX}, s AS (SELECT DISTINCT 'the ' || p_type AS surface FROM part), nodes AS (SELECT name FROM p),
sv AS ({_VECTOR.format(key='surface', text='surface', of='s')}), nv AS ({_VECTOR.format(key='name', text='name', of='nodes')}),
k AS (SELECT surface, name, round(list_cosine_similarity(sv.v, nv.v), 9) AS sim FROM sv, nv), best AS (SELECT surface, min_by(name, struct_pack(s := -sim, n := name)) AS node, max(sim) AS score FROM k GROUP BY 1)
SELECT surface, CASE WHEN score >= 0.55::DOUBLE THEN node END AS node, round(score, 6) AS score, CASE WHEN score >= 0.55::DOUBLE THEN 'embedding' ELSE 'unresolved' END AS method FROM best""")
def embedding_link(t: Tables) -> DataFrame:
    """Surfaces that only the nearest vector can resolve."""
    s = t.part.select(F.concat(F.lit("the "), "p_type").alias("surface")).distinct().withColumn("weight", F.lit(1.0))
    nodes = C._products(t).withColumn("text", F.col("name"))
    out = linking.link(s, nodes, linking.alias_table(t.spark, {}), min_score=0.55)
    return out.select("surface", "node", r("score").alias("score"), "method")


@query(f"WITH {C.MENTIONS}, n AS (SELECT doc_id, CASE WHEN length(skill) > 5 THEN substr(skill, 1, 4) END AS node FROM m) SELECT doc_id, {P.rounded('count(DISTINCT node) / count(*)::DOUBLE', 6)} AS rate FROM n GROUP BY 1")
def resolution_rates(t: Tables) -> DataFrame:
    x = t.mentions().withColumn("node", F.when(F.length("skill") > 5, F.substring("skill", 1, 4)))
    return linking.resolution_rate(x)


@query(f"""WITH p AS ({C._PRODUCT}), c AS (SELECT name, {C._CORE.replace(C._N, 'lower(name)')} AS core FROM p)
SELECT name AS node, lower(name) AS alias FROM c UNION SELECT name, core FROM c WHERE length(core) >= 3 AND core NOT IN ({C._STOP})""")
def gazetteer_aliases(t: Tables) -> DataFrame:
    return linking.gazetteer(C._products(t))


@query("""SELECT p_partkey AS doc_id, 'part' || p_size || '-' || substr(sha1(p_name), 1, 8) AS thread_id, 'upload-' || substr(sha256(p_name), 1, 16) AS upload_id, 'part' || p_size || '-' || substr(sha256(p_name), 1, 8) AS candidate_id FROM part""")
def document_ids(t: Tables) -> DataFrame:
    stem, digest = F.concat(F.lit("part"), F.col("p_size").cast("string")), T.content_hash(F.col("p_name"))
    return t.part.select(F.col("p_partkey").alias("doc_id"), T.thread_id(stem, F.col("p_name")).alias("thread_id"), T.upload_thread_id(digest).alias("upload_id"), T.document_id(stem, digest).alias("candidate_id"))


# Model output and retries


@query("""SELECT p_partkey AS id, p_size / 20.0 NOT BETWEEN 0.5 AND 1.5 OR p_partkey % 13 = 0 AS bad, CASE WHEN p_size / 20.0 BETWEEN 0.5 AND 1.5 AND p_partkey % 13 <> 0 THEN p_name END AS skill FROM part""")
def payloads(t: Tables) -> DataFrame:
    """Model output, fenced or not, as a list or under a key, with weights out of bounds and blank names."""
    item = F.to_json(F.struct(F.when(F.col("p_partkey") % 13 == 0, " ").otherwise(F.concat(F.lit(" "), F.col("p_name"), F.lit("  "))).alias("skill"), (F.col("p_size") / 20.0).alias("weight"), F.lit("seen  here").alias("context")))
    whole = F.concat(F.lit("["), item, F.lit("]"))
    shape = F.col("p_partkey") % 3
    text = F.when(shape == 0, whole).when(shape == 1, F.concat(F.lit('{"skills": '), whole, F.lit("}"))).otherwise(F.concat(F.lit("```json\n"), F.lit('{"items": '), whole, F.lit("}\n```")))
    x = readers.from_payload(t.part.select(F.col("p_partkey").alias("id"), text.alias("payload")))
    return x.select("id", F.col("error").isNotNull().alias("bad"), F.col("skills")[0]["skill"].alias("skill"))


@query(f"WITH {C._chunk_sql(375, 40)} SELECT doc_id::VARCHAR AS doc_id, index, 1::BIGINT AS attempt, md5(text) AS payload FROM chunk")
def extract_lanes(t: Tables) -> DataFrame:
    """Every chunk of a stream of documents, called once in its document's lane; the call gives the chunk's digest."""
    folder = _folder(t, "lanes")
    documents.chunked(t.documents).select(F.col("doc_id").cast("string").alias("content_hash"), F.col("index").alias("first_index"), F.lit(1).alias("n"), "text").write.parquet(f"{folder}/chunks")
    groups = t.spark.readStream.schema("content_hash string, first_index int, n int, text string").parquet(f"{folder}/chunks")
    out = lanes.extracted(groups, lambda text: hashlib.md5(text.encode()).hexdigest(), lanes=8, heartbeat=False)
    out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    x = t.spark.read.schema(lanes.OUT).parquet(f"{folder}/out")
    return x.select(F.col("content_hash").alias("doc_id"), F.col("first_index").cast("long").alias("index"), F.col("attempt").cast("long").alias("attempt"), "payload")


_SAID = r"[\p{L}\p{N}_+#.]*[\p{L}\p{N}_+#]"


@query(rf"""WITH t AS (SELECT row_number() OVER () AS d, regexp_extract_all(lower(text), '{_SAID}') AS w FROM conversations WHERE text IS NOT NULL),
x AS (SELECT d, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM t), v AS (SELECT w, count(*) AS n FROM x GROUP BY 1 HAVING count(*) >= {embedding.LEAST}),
one AS (SELECT a.w AS a, b.w AS b FROM x a JOIN x b ON a.d = b.d AND b.i BETWEEN a.i + 1 AND a.i + {embedding.SPAN}),
p AS (SELECT a, b, count(*) AS n FROM (SELECT a, b FROM one UNION ALL SELECT b, a FROM one) WHERE a IN (SELECT w FROM v) AND b IN (SELECT w FROM v) GROUP BY 1, 2),
m AS (SELECT a, sum(n) AS m FROM p GROUP BY 1)
SELECT p.a, p.b, p.n, round(ln(p.n::DOUBLE * (SELECT sum(n) FROM p)::DOUBLE / (x.m::DOUBLE * y.m::DOUBLE)), 6) AS ppmi FROM p JOIN m x ON x.a = p.a JOIN m y ON y.a = p.b WHERE ln(p.n::DOUBLE * (SELECT sum(n) FROM p)::DOUBLE / (x.m::DOUBLE * y.m::DOUBLE)) > 1e-9""")
def word_ppmi(t: Tables) -> DataFrame:
    """What a learnt embedder factors: mutual information of the words of all conversations."""
    words, pairs = embedding.counted(t.conversations)
    name = lambda c, i: words.select(F.col("i").alias(i), F.col("word").alias(c))
    x = embedding.ppmi(pairs).where("x > 1e-9").join(pairs, ["i", "j"]).join(name("a", "i"), "i").join(name("b", "j"), "j")
    return x.select("a", "b", "n", F.round("x", 6).alias("ppmi"))


# Evaluation


@query(f"WITH {C.GRADED} SELECT 'grade ' || grade AS tier, count(*) AS n, round(avg(score), 6) AS mean_overlap FROM g GROUP BY 1")
def overlap_by_tier(t: Tables) -> DataFrame:
    x = t.graded().select(F.concat(F.lit("grade "), F.col("grade").cast("string")).alias("tier"), F.col("score").alias("exact_overlap"))
    return evaluation.overlap_by_tier(x).withColumn("mean_overlap", r("mean_overlap"))


@query(f"""WITH {P.HAVE}, {P.WANTS}, q AS (SELECT jd, string_agg(skill::VARCHAR, ', ' ORDER BY skill::VARCHAR) AS text FROM wants GROUP BY 1), c AS (SELECT cand, string_agg(skill::VARCHAR, ', ' ORDER BY skill::VARCHAR) AS text FROM have GROUP BY 1),
qv AS ({_VECTOR.format(key='jd', text='text', of='q')}), cv AS ({_VECTOR.format(key='cand', text='text', of='c')}),
s AS (SELECT jd AS query, cand, round(list_cosine_similarity(qv.v, cv.v), 9) AS score FROM qv, cv)
SELECT query, cand, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, cand) AS rank FROM s) WHERE rank <= 10""")
def cosine_text_rank(t: Tables) -> DataFrame:
    """Candidates by the similarity of their joined skill text to the description's."""
    wants, have = t.wants().select(F.col("jd").alias("query"), "skill"), t.have()
    graded = have.select("cand").distinct().crossJoin(F.broadcast(wants.select("query").distinct()))
    x = evaluation.cosine_text(wants, have, graded).withColumn("score", F.round("score", 9))
    out = evaluation.ranked(x, by_name=True).where("rank <= 10")
    return out.select("query", "cand", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


_EVAL = P.JUDGED
_KS = (0.9, 1.0, 1.5238)
C.ORACLE_SQL["eval_arms"] = f"""WITH {_EVAL}, tot AS (SELECT jd, sum(demand) AS td, count(*) AS n FROM w GROUP BY 1),
m AS (SELECT g.jd, g.cand, coalesce(sum(demand), 0) AS direct, count(demand) AS held FROM g LEFT JOIN (h JOIN w USING (skill)) x ON x.cand = g.cand AND x.jd = g.jd GROUP BY 1, 2),
terms AS (SELECT jd, NULL AS cand, skill FROM w UNION ALL SELECT g.jd, g.cand, h.skill FROM g JOIN h ON h.cand = g.cand),
docs AS (SELECT jd, count(*) + 1 AS n FROM g GROUP BY 1), idf AS (SELECT jd, skill, ln((1.0::DOUBLE + docs.n) / (1.0::DOUBLE + count(*))) + 1 AS idf FROM terms JOIN docs USING (jd) GROUP BY jd, skill, docs.n),
x AS (SELECT jd, cand, skill, idf FROM terms JOIN idf USING (jd, skill)), norms AS (SELECT jd, cand, sqrt(sum(idf * idf)) AS norm FROM x GROUP BY 1, 2),
dots AS (SELECT a.jd, a.cand, sum(a.idf * b.idf) AS dot FROM x a JOIN x b ON a.jd = b.jd AND a.skill = b.skill AND b.cand IS NULL WHERE a.cand IS NOT NULL GROUP BY 1, 2),
scores AS (
  SELECT 'no_bridging' AS arm, jd, cand, {P.rounded('direct / td', 3)} AS score FROM m JOIN tot USING (jd)
  UNION ALL SELECT 'tfidf', g.jd, g.cand, round(coalesce(dot / (a.norm * q.norm), 0), 9) FROM g JOIN norms a ON a.jd = g.jd AND a.cand = g.cand JOIN norms q ON q.jd = g.jd AND q.cand IS NULL LEFT JOIN dots ON dots.jd = g.jd AND dots.cand = g.cand
  {" ".join(f"UNION ALL SELECT 'count_only_{k}', jd, cand, round(direct + {k}::DOUBLE * (n - held), 6) FROM m JOIN tot USING (jd)" for k in _KS)}),
s AS (SELECT arm, split, g.jd, g.cand, score, grade, row_number() OVER (PARTITION BY arm, g.jd ORDER BY score DESC, pos) AS rank, avg(grade) OVER (PARTITION BY arm, g.jd, score) AS mean, row_number() OVER (PARTITION BY arm, g.jd ORDER BY grade DESC) AS ideal FROM g JOIN scores USING (jd, cand)),
each AS (SELECT arm, split, jd, avg((grade >= 2)::INT) FILTER (rank <= 5) AS p5, coalesce(1.0::DOUBLE / min(rank) FILTER (grade >= 2), 0) AS mrr, sum(mean / log2(rank + 1)) FILTER (rank <= 10) / sum(grade / log2(ideal + 1)) FILTER (ideal <= 10) AS ndcg FROM s GROUP BY 1, 2, 3),
pw AS (SELECT a.arm, a.split, sum(CASE WHEN a.score > b.score THEN 2 WHEN a.score = b.score THEN 1 ELSE 0 END) / (2.0::DOUBLE * count(*)) AS acc FROM s a JOIN s b ON a.arm = b.arm AND a.jd = b.jd AND a.grade = 2 AND b.grade = 1 GROUP BY 1, 2)
SELECT arm, split, round(any_value(acc), 6) AS bridge_over_weak, round(avg(ndcg), 6) AS ndcg_10, round(avg(p5), 6) AS p_5, round(avg(mrr), 6) AS mrr FROM each JOIN pw USING (arm, split) GROUP BY 1, 2"""


@query(f"WITH {_EVAL} SELECT tier, count(*) AS n, round(avg(exact_overlap), 6) AS mean_overlap, round(avg((SELECT count(*) FROM h WHERE h.cand = g.cand)), 6) AS mean_skills FROM g GROUP BY 1")
def eval_tiers(t: Tables) -> DataFrame:
    """The tiers of the judged pairs: exact overlap with the description, and size."""
    _, graded, have = t.judged()
    size = have.groupBy("cand").agg(F.count("*").alias("k"))
    sizes = graded.join(size, "cand", "left").groupBy("tier").agg(r(F.avg(F.coalesce("k", F.lit(0)))).alias("mean_skills"))
    return evaluation.overlap_by_tier(graded).withColumn("mean_overlap", r("mean_overlap")).join(sizes, "tier")


# Indexes: cells of vectors, labels of hubs, paths kept up to date, the threshold algorithm


@query(f"WITH {P.NEAR} SELECT src, dst, {P.rounded('sim', 6)} AS sim FROM near")
def index_neighbors(t: Tables) -> DataFrame:
    """The nearest neighbours of all vectors through an inverted file, with every cell that may hold one."""
    vectors = t.embeddings.select(F.col("vec_id").alias("id"), "embedding")
    index = VectorIndex.build(vectors, _folder(t, "vectors"))
    return index.near(vectors, 5, 0.3, probes=4, exact=True).select("src", "dst", r("sim").alias("sim"))


#: Every sum rounded to the places of hub labels, so that equal lengths are equal in either order of sums.
_EXACT = P.REACH.replace("1.0::DOUBLE - weight", "round(1.0::DOUBLE - weight, 9)").replace("w.d + s.d", "round(w.d + s.d, 9)")


@query(f"WITH {_EXACT} SELECT cand, skill, round(dist, 6) AS dist, hops, via FROM best")
def hub_reach(t: Tables) -> DataFrame:
    """What every candidate reaches of what is wanted, from hub labels instead of a table of pairs."""
    labels = HubLabels(t.edges(), P.CUTOFF, P.PARAMS.max_hops)
    return paths.reach(t.have(), labels, t.wants()).select("cand", "skill", r("dist").alias("dist"), F.col("hops").cast("long").alias("hops"), "via")


_EDITED = P.PATHS.replace("edges AS (", "edges0 AS (", 1).replace("sym AS (", """edges AS (
  SELECT lo, hi, CASE WHEN (lo + hi) % 11 = 0 THEN 0.95 ELSE weight END::DOUBLE AS weight FROM edges0 WHERE lo % 7 <> 0
  UNION ALL SELECT a, b, 0.9::DOUBLE FROM (SELECT DISTINCT least(vec_id, vec_id * 3 % n) AS a, greatest(vec_id, vec_id * 3 % n) AS b FROM embeddings, (SELECT count(*) AS n FROM embeddings) WHERE vec_id % 13 = 0)
  WHERE a <> b AND NOT EXISTS (SELECT 1 FROM edges0 e WHERE e.lo = a AND e.hi = b AND e.lo % 7 <> 0)), sym AS (""", 1)


@query(f"WITH {_EDITED} SELECT src, dst, round(dist, 6) AS dist, hops FROM paths")
def paths_updated(t: Tables) -> DataFrame:
    """All paths after edges went, came and changed, from those before."""
    before = t.edges()
    gone = before.where("lo % 7 = 0").select("lo", "hi")
    changed = before.where("lo % 7 <> 0 AND (lo + hi) % 11 = 0").select("lo", "hi", F.lit(0.95).alias("weight"))
    a, b = F.col("vec_id"), F.col("vec_id") * 3 % t.n_skills()
    came = t.embeddings.where((F.col("vec_id") % 13 == 0) & (a != b)).select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"), F.lit(0.9).alias("weight")).distinct()
    came = came.join(before.where("lo % 7 <> 0").select("lo", "hi"), ["lo", "hi"], "left_anti")
    after = paths.checkpointed(dynamic.edited(before, changed.unionByName(came), gone))
    return dynamic.updated(t.paths(), before, after, P.CUTOFF, P.PARAMS.max_hops).select("src", "dst", r("dist").alias("dist"), F.col("hops").cast("long").alias("hops"))


@query(C.ORACLE_SQL["rank_topk"])
def rank_threshold(t: Tables) -> DataFrame:
    """The ten best of every description, of whom few are scored."""
    top, _ = topk.rank_top(t.wants(), t.have(), t.paths(), t.edges(), P.PARAMS, 10)
    return top.select("jd", "cand", "total", F.col("rank").cast("long").alias("rank"))
