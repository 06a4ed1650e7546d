"""A store of graph and candidate tables as versioned Parquet, with atomic commits.

A version is a manifest (JSON: table -> folder). Committing writes the changed tables to new folders and the manifest to
a file of its own, which is then renamed to the next version; a second writer that got there first makes that fail, and
readers see whole manifests only. A table's files are sorted by its key, with Parquet's Bloom filters on the columns of
LOOKUPS, so a lookup reads the row groups that may hold it and no others. The rename is atomic on HDFS and local disks; on an object store without one, let one
writer commit at a time. vacuum() removes what the latest versions no longer name.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import documents

TABLES = {
    "skills": "name string, category string, category_all array<string>, category_n long, embed_category string, source string, embedding array<double>",
    "roles": "name string, soc string",
    "requires": "role string, skill string",
    "similar": "lo string, hi string, weight double, edge_source string",
    "candidates": "candidate_id string, name string, doc_type string, content_hash string, batch_ids array<string>, failed_chunks array<int>, unresolved array<string>, extracted_at timestamp",
    "has_skill": "candidate_id string, node string, weight double, context string, method string, link_score double",
    # tries of chunk groups of documents that haven't reached the pool yet
    "extractions": "content_hash string, first_index int, n int, attempt int, error string, done boolean, skills array<struct<skill:string,weight:double,context:string>>",
    # what became of the documents of each stream's latest batch
    "outcomes": "query string, batch long, path string, thread_id string, candidate_id string, action string, status string, in_pool boolean, error string",
}
KEYS = {"skills": ["name"], "roles": ["name"], "requires": ["role", "skill"], "similar": ["lo", "hi"], "candidates": ["candidate_id"], "has_skill": ["candidate_id", "node"], "extractions": ["content_hash", "first_index"], "outcomes": ["query", "batch", "path"]}
# columns that rows are looked up by
LOOKUPS = {"skills": ["name"], "roles": ["name"], "requires": ["role", "skill"], "similar": ["lo", "hi"], "candidates": ["candidate_id", "content_hash"], "has_skill": ["candidate_id", "node"], "extractions": ["content_hash"]}
MAX_NODES, MAX_EDGES = 200_000, 400_000


class ConflictError(RuntimeError):
    """Another writer has committed meanwhile."""


class ParityError(ValueError):
    """A stored graph is not the expected one."""


class Store:
    def __init__(self, spark: SparkSession, path: str, row_group_bytes: int = 32 << 20):
        """row_group_bytes: what a lookup reads at least; smaller ones cost more footers."""
        self.spark, self.path, self.row_group_bytes = spark, path.rstrip("/"), row_group_bytes

    # manifests

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The latest version; 0 for a new store."""
        p, fs = self._fs(f"{self.path}/_versions")
        if not fs.exists(p):
            return 0
        return max((int(s.getPath().getName()) for s in fs.listStatus(p) if s.getPath().getName().isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict[str, str]:
        v = self.version() if version is None else version
        return json.loads(self.spark.read.text(f"{self.path}/_versions/{v:08d}", wholetext=True).first()[0]) if v else {}

    def ping(self) -> bool:
        """Whether the store can be reached; never raises."""
        try:
            self.version()
            return True
        except Exception:
            return False

    def read(self, table: str) -> DataFrame:
        folder = self.manifest().get(table)
        return self.spark.read.schema(TABLES[table]).parquet(folder) if folder else self.spark.createDataFrame([], TABLES[table])

    def commit(self, tables: dict[str, DataFrame], check: bool = True) -> int:
        """Write tables as the next version; with check, keys must be unique."""
        before = self.version()
        entries = self.manifest(before)
        for name, df in tables.items():
            folder = f"{self.path}/{name}/{uuid.uuid4().hex}"
            self._write(df.select(*[c.name for c in self.spark.createDataFrame([], TABLES[name]).schema]), name, folder)
            if check and not (twice := self.spark.read.parquet(folder).groupBy(*KEYS[name]).count().where("count > 1").limit(1)).isEmpty():
                raise ValueError(f"{name} has a key twice: {twice.first()}")
            entries[name] = folder
        self._put(json.dumps(entries), f"{self.path}/_versions/{before + 1:08d}")
        return before + 1

    def _write(self, df: DataFrame, table: str, folder: str) -> None:
        """Dealt by the whole key and sorted by it. Ranges would prune files too, but finding them runs the input twice, and
        an extraction's input is calls of a model; the Bloom filters prune files instead."""
        keys = KEYS[table]
        out = df.repartition(*keys).sortWithinPartitions(*keys).write.option("parquet.block.size", self.row_group_bytes)
        for c in LOOKUPS.get(table, ()):
            out = out.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.adaptive.enabled#{c}", "true")
        out.parquet(folder)

    def _put(self, text: str, path: str) -> None:
        """A file that is there whole or not at all, and never replaces one."""
        jvm = self.spark._jvm
        p, fs = self._fs(path)
        draft = jvm.org.apache.hadoop.fs.Path(f"{self.path}/_drafts/{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        fs.mkdirs(p.getParent())
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri() if p.toUri().getScheme() else fs.getUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark._sc._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            files.rename(draft, p, none)
        except Exception as e:
            fs.delete(draft, False)
            raise ConflictError(f"{path} exists") from e

    def vacuum(self, keep: int = 2) -> int:
        """Remove the folders that none of the latest `keep` versions names, and older manifests; their number."""
        latest = self.version()
        named = {f for v in range(max(1, latest - keep + 1), latest + 1) for f in self.manifest(v).values()}
        gone = 0
        for table in TABLES:
            p, fs = self._fs(f"{self.path}/{table}")
            for x in fs.listStatus(p) if fs.exists(p) else ():
                if f"{self.path}/{table}/{x.getPath().getName()}" not in named:
                    gone += fs.delete(x.getPath(), True)
        for v in range(1, max(1, latest - keep + 1)):
            p, fs = self._fs(f"{self.path}/_versions/{v:08d}")
            fs.delete(p, False)
        return gone

    def __enter__(self) -> Store:
        if not self.ping():
            raise ConnectionError(f"{self.path} can't be reached")
        return self

    def __exit__(self, *_) -> None:
        """Nothing is held open between calls."""

    # graph

    def upsert_skills(self, new: DataFrame) -> int:
        """New values win, but a null embedding keeps the stored one."""
        return self.commit({"skills": documents.upsert(self.read("skills"), new, "name", keep_if_null=("embedding",))})

    def upsert_roles(self, new: DataFrame) -> int:
        return self.commit({"roles": documents.upsert(self.read("roles"), new, "name")})

    def upsert_requires(self, new: DataFrame) -> int:
        """Rows whose role or skill is missing are skipped."""
        ok = new.join(self.read("roles").select(F.col("name").alias("role")), "role", "left_semi").join(self.read("skills").select(F.col("name").alias("skill")), "skill", "left_semi")
        return self.commit({"requires": self.read("requires").unionByName(ok.select("role", "skill")).distinct()})

    def upsert_similar(self, new: DataFrame) -> int:
        """Unordered pairs; new weights replace stored ones, the largest of equal pairs counts."""
        n = new.groupBy(F.least("lo", "hi").alias("lo"), F.greatest("lo", "hi").alias("hi")).agg(F.max(F.struct("weight", "edge_source")).alias("x")).select("lo", "hi", "x.*")
        return self.commit({"similar": self.read("similar").join(n, ["lo", "hi"], "left_anti").unionByName(n)})

    def replace_similar(self, edges: DataFrame, skills: DataFrame) -> int:
        """All similarity edges anew, the pool untouched; stored skills must all be in the artifact."""
        self._none_lost(skills)
        check_ceilings(skills.count(), edges.count())
        return self.commit({"similar": edges})

    def _none_lost(self, skills: DataFrame) -> None:
        if lost := self.read("skills").join(skills, "name", "left_anti").select("name").limit(5).collect():
            raise ParityError(f"stored skills are not in the artifact: {[r['name'] for r in lost]}")

    def load_graph(self, expected_skills: int | None = None, expected_pairs: int | None = None) -> tuple[DataFrame, DataFrame]:
        skills, similar = self.read("skills"), self.read("similar")
        for what, df, want in (("skills", skills, expected_skills), ("similar pairs", similar, expected_pairs)):
            if want is not None and (n := df.count()) != want:
                raise ParityError(f"{n} {what}, expected {want}")
        return skills, similar

    def find_skill(self, name: str) -> DataFrame:
        return self.read("skills").where(F.col("name") == name)

    def skill_exists(self, name: str) -> bool:
        return not self.find_skill(name).limit(1).isEmpty()

    def lookup(self, names: DataFrame) -> DataFrame:
        """name, found of every name asked for, in one join."""
        there = self.read("skills").select("name", F.lit(True).alias("found"))
        return names.select("name").distinct().join(there, "name", "left").withColumn("found", F.coalesce("found", F.lit(False)))

    def register_views(self, prefix: str = "") -> list[str]:
        """A temporary SQL view of every table."""
        for t in TABLES:
            self.read(t).createOrReplaceTempView(prefix + t)
        return [prefix + t for t in TABLES]

    def migrate(self, artifact: dict[str, DataFrame], dry_run: bool = False, guard: bool = False, ceilings: tuple[int, int] | None = (MAX_NODES, MAX_EDGES)) -> DataFrame:
        """Write an artifact's tables (skills, roles, requires, similar) to the store, in one commit.

        kind, rows, good, errors of each. A row with a null key, an end that isn't there, a weight outside 0 to 1, or two
        equal ends is counted as an error and left out; of rows with the same key one is good. With dry_run nothing is
        written. The sizes are checked first (nodes and edges of a hosted graph's tariff; ceilings=None for a store of any
        size); with guard, stored skills must all be in the artifact.
        """
        blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
        skills, roles = ({"skills": "name", "roles": "name"}[k] for k in ("skills", "roles"))
        good = {"skills": artifact["skills"].where(~blank(skills)).dropDuplicates([skills]), "roles": artifact["roles"].where(~blank(roles)).dropDuplicates([roles])}
        end = lambda table, c: good[table].select(F.col("name").alias(c))
        good["requires"] = artifact["requires"].join(end("roles", "role"), "role", "left_semi").join(end("skills", "skill"), "skill", "left_semi").dropDuplicates(["role", "skill"])
        pairs = canonical(artifact["similar"]).where("lo <> hi AND weight BETWEEN 0 AND 1")
        good["similar"] = pairs.join(end("skills", "lo"), "lo", "left_semi").join(end("skills", "hi"), "hi", "left_semi").dropDuplicates(["lo", "hi"])
        full = {}
        for name, df in good.items():
            have = set(df.columns)
            full[name] = df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.spark.createDataFrame([], TABLES[name]).schema])
        counts = {k: (artifact[k].count(), full[k].count()) for k in full}
        if ceilings is not None:
            check_ceilings(counts["skills"][1] + counts["roles"][1], counts["requires"][1] + counts["similar"][1], *ceilings)
        if guard:
            self._none_lost(full["skills"])
        if not dry_run:
            self.commit(full)
        return self.spark.createDataFrame([(k, n, m, n - m) for k, (n, m) in counts.items()], "kind string, rows long, good long, errors long")

    def verify(self, expected: dict[str, int]) -> DataFrame:
        """kind, n, expected, ok for a written graph."""
        want = self.spark.createDataFrame(list(expected.items()), "kind string, expected long")
        return self.counts().join(want, "kind").withColumn("ok", F.col("n") == F.col("expected")).orderBy("kind")

    def counts(self) -> DataFrame:
        """kind, n of every table."""
        rows = [(t, self.read(t).count()) for t in TABLES]
        return self.spark.createDataFrame(rows, "kind string, n long")

    # pool

    def upsert_candidates(self, candidates: DataFrame, skills: DataFrame, outcomes: DataFrame | None = None) -> int:
        """In one commit: candidates win by id with batch_ids united; their skill sets are replaced; unknown nodes are
        skipped. outcomes: of one batch of a stream, in place of those of its earlier batches."""
        known = skills.join(self.read("skills").select(F.col("name").alias("node")), "node", "left_semi")
        more = {}
        if outcomes is not None:
            more["outcomes"] = self.read("outcomes").join(outcomes.select("query").distinct(), "query", "left_anti").unionByName(outcomes)
        return self.commit({
            **more,
            "candidates": documents.upsert(self.read("candidates"), candidates, "candidate_id", append=("batch_ids",)),
            "has_skill": documents.replace_children(self.read("has_skill"), known.select(*self.read("has_skill").columns), candidates, "candidate_id"),
        })

    def outcomes(self, query: str, batch: int) -> DataFrame:
        """What became of a batch that reached the pool; no rows for one that didn't."""
        return self.read("outcomes").where((F.col("query") == query) & (F.col("batch") == batch)).drop("query", "batch")

    def add_to_batch(self, candidate_id: str, batch: str) -> bool:
        """Idempotent; False if there is no such candidate."""
        if not batch or not batch.strip():
            raise ValueError("a batch needs a name")
        c = self.read("candidates")
        if c.where(F.col("candidate_id") == candidate_id).isEmpty():
            return False
        here = F.col("candidate_id") == candidate_id
        self.commit({"candidates": c.withColumn("batch_ids", F.when(here, F.array_union(F.coalesce("batch_ids", F.array()), F.array(F.lit(batch)))).otherwise(F.col("batch_ids")))})
        return True

    def delete_candidate(self, candidate_id: str) -> bool:
        c = self.read("candidates")
        if c.where(F.col("candidate_id") == candidate_id).isEmpty():
            return False
        self.commit({"candidates": c.where(F.col("candidate_id") != candidate_id), "has_skill": self.read("has_skill").where(F.col("candidate_id") != candidate_id)})
        return True

    def find_by_hash(self, digest: str) -> DataFrame:
        return self.read("candidates").where((F.col("content_hash") == digest) & F.lit(bool(digest))).limit(1)

    def pool(self, batch: str | None = None) -> DataFrame:
        """cand, name, skill, weight; skill null for a candidate without any."""
        c = documents.in_batch(self.read("candidates"), batch)
        return c.join(self.read("has_skill"), "candidate_id", "left").select(F.col("candidate_id").alias("cand"), "name", F.col("node").alias("skill"), "weight")


def canonical(similar: DataFrame) -> DataFrame:
    """Pairs (lo, hi, ...) in one order, the smaller name first."""
    rest = [c for c in similar.columns if c not in ("lo", "hi")]
    return similar.select(F.least("lo", "hi").alias("lo"), F.greatest("lo", "hi").alias("hi"), *rest)


def summarise(skills: DataFrame, roles: DataFrame, requires: DataFrame, similar: DataFrame) -> DataFrame:
    """kind, n of an artifact: nodes and edges by kind, pairs counted once, and both totals; a pair stands for two
    relationships in the second."""
    one = lambda df, kind: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    pairs = one(canonical(similar).select("lo", "hi").distinct(), "similar")
    parts = one(skills, "skills").union(one(roles, "roles")).union(one(requires, "requires")).union(pairs)
    times = F.when(F.col("kind") == "similar", 2).otherwise(1) * F.col("n")
    nodes = F.col("kind").isin("skills", "roles")
    total = parts.agg(F.sum(F.when(nodes, F.col("n"))).alias("node_total"), F.sum(F.when(~nodes, times)).alias("relationship_total"))
    return parts.union(total.select(F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("n")) for k in ("node_total", "relationship_total")]))))


def vectors_of(skills: DataFrame) -> DataFrame:
    """name, embedding of the nodes that have a vector."""
    return skills.where("embedding IS NOT NULL AND size(embedding) > 0").select("name", "embedding")


def check_ceilings(nodes: int, edges: int, most_nodes: int = MAX_NODES, most_edges: int = MAX_EDGES) -> None:
    if nodes > most_nodes or edges > most_edges:
        raise ValueError(f"{nodes} nodes and {edges} edges; at most {most_nodes} and {most_edges} are allowed")
