"""Ingestion: documents to candidates in the store, as a batch or as a checkpointed stream of files.

A document goes through read, extract, link, persist and finalize. Chunks are extracted in groups; a try of all groups
that are open is one pass over the cluster, and what it gives is committed to the store before the next (the cursor of
every document). Groups that failed are tried again after a delay, up to `attempts` times; then, or at an error that
another try doesn't mend, all chunks of the group count as failed and the document goes on without them. Writing to the
pool is tried again under the same policy. So a run that was interrupted, or couldn't write, goes on with the groups
that are open, whatever size groups have then, and extracts nothing again.

Content hashes make ingestion idempotent on every path: a document whose hash the pool has is attached to the batch and
not extracted again, unless its stored profile has failed chunks. A broken file is a row with an error.

Status of a document: complete, partial (with failed chunks), reused, failed (not read), link_failed or persist_failed.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T
from ..operators import documents, linking
from ..sources import readers
from ..sources.store import ConflictError, Store
from . import retry

FILES = "path string, modificationTime timestamp, length long, content binary"


@dataclass(frozen=True)
class IngestConfig:
    chunk_words: int = 375
    overlap_words: int = 40
    doc_type: str = "resume"
    max_files: int = 100
    chunks_per_call: int = 1
    attempts: int = retry.MOST
    #: Seconds before a try, by the number of tries before it.
    wait: Callable[[int], float] = retry.delay


def gazetteer_extractor(chunks: DataFrame, nodes: DataFrame) -> DataFrame:
    """The default extractor: source_id, index, skill, weight, context for nodes that a chunk names."""
    x = chunks.withColumn("chunk", F.concat_ws("\0", "source_id", F.col("index").cast("string")))
    hits = linking.gazetteer_matches(x.select("chunk", "text"), linking.gazetteer(nodes), "chunk")
    return x.select("chunk", "source_id", "index").join(hits, "chunk").select("source_id", "index", F.col("node").alias("skill"), F.lit(1.0).alias("weight"), F.lit("mentioned").alias("context"))


def plan(docs: DataFrame, stored: DataFrame) -> DataFrame:
    """docs with candidate_id, action: error, reused, again (stored with failed chunks), copy (of a document here) or new, and
    lead: the action of the document whose candidate it is, its own but for copies."""
    known = stored.where("content_hash <> ''").groupBy("content_hash").agg(F.min(F.struct("candidate_id", "failed_chunks")).alias("s"))
    x = docs.join(known, "content_hash", "left")
    x = documents.first_of_each(x, "path")
    fresh = T.document_id(F.col("source_id"), F.col("content_hash"))
    failed = F.size(F.coalesce("s.failed_chunks", F.array().cast("array<int>"))) > 0
    action = F.when(F.col("error").isNotNull(), "error").when(F.col("original") != F.col("path"), "copy").when(F.col("s").isNull(), "new").when(failed, "again").otherwise("reused")
    x = x.withColumn("action", action).withColumn("candidate_id", F.coalesce("s.candidate_id", fresh))
    # a copy is its original's candidate, under the id made from the original's name
    first = x.where("action IN ('new', 'again', 'reused') AND original = path").select("content_hash", F.col("candidate_id").alias("its"), F.col("action").alias("led"))
    x = x.join(first, "content_hash", "left")
    copy = F.col("action") == "copy"
    return x.withColumns({"candidate_id": F.when(copy, F.col("its")).otherwise(F.col("candidate_id")), "lead": F.when(copy, F.col("led")).otherwise(F.col("action"))}).drop("s", "original", "its", "led")


# Parts of messages of errors of the store that another try doesn't mend.
PERSIST_FATAL = ("unauthorized", "authentication", "forbidden", "constraint", "syntaxerror", "invalid input")


def open_groups(todo: DataFrame, tries: DataFrame, config: IngestConfig) -> DataFrame:
    """source_id (the content hash), index, n, text and attempt of the chunk groups that no try has finished.

    Chunks that a finished try covers are left out one by one, so tries made with another group size stay good.
    """
    pieces = documents.chunked(todo.select("content_hash", "text"), config.chunk_words, config.overlap_words, "content_hash")
    done = tries.where("done").select("content_hash", F.explode(F.sequence("first_index", F.col("first_index") + F.col("n") - 1)).alias("index"))
    left = pieces.join(done, ["content_hash", "index"], "left_anti")
    groups = documents.chunk_groups(left, config.chunks_per_call, "content_hash").select("content_hash", F.col("first_index").alias("index"), F.col("n").cast("int").alias("n"), "text")
    before = tries.where("NOT done").select("content_hash", F.col("first_index").alias("index"), "attempt")
    return groups.join(before, ["content_hash", "index"], "left").select(F.col("content_hash").alias("source_id"), "index", "n", "text", F.coalesce("attempt", F.lit(0)).alias("attempt"))


def one_pass(groups: DataFrame, nodes: DataFrame, extractor, attempts: int) -> DataFrame:
    """A try of every group: rows of the table of extractions. done: it worked, can't work, or was the last try."""
    found = extractor(groups.select("source_id", "index", "text"), nodes)
    found = found if "error" in found.columns else found.withColumn("error", F.lit(None).cast("string"))
    skill = F.struct("skill", F.col("weight").cast("double").alias("weight"), "context")
    got = found.groupBy("source_id", "index").agg(F.max("error").alias("error"), F.array_sort(F.collect_list(F.when(F.col("error").isNull() & F.col("skill").isNotNull(), skill))).alias("skills"))
    x = groups.join(got, ["source_id", "index"], "left").withColumn("attempt", F.col("attempt") + 1)
    over = F.col("error").isNull() | ~T.retryable(F.col("error")) | (F.col("attempt") >= attempts)
    none = F.array().cast("array<struct<skill:string,weight:double,context:string>>")
    return x.select(F.col("source_id").alias("content_hash"), F.col("index").alias("first_index"), "n", "attempt", "error", over.alias("done"), F.when(F.col("error").isNull(), F.coalesce("skills", none)).otherwise(none).alias("skills"))


def extract(todo: DataFrame, store: Store, extractor, config: IngestConfig) -> DataFrame:
    """Passes over the open groups until none is; the finished tries of todo (content_hash, text) from the store."""
    nodes, hashes = store.read("skills"), todo.select("content_hash").distinct()
    # a pool profile with failed chunks is extracted again: its failed tries are forgotten, the others stay
    again = todo.where("action = 'again'").select("content_hash").distinct()
    old = store.read("extractions")
    lost = old.where("done AND error IS NOT NULL").join(again, "content_hash", "left_semi").select("content_hash", "first_index")
    if not lost.isEmpty():
        store.commit({"extractions": old.join(lost, ["content_hash", "first_index"], "left_anti")})
    passes = 0
    while True:
        tries = store.read("extractions").join(hashes, "content_hash", "left_semi")
        groups = open_groups(todo, tries, config).persist()
        if groups.isEmpty():
            return tries
        if passes:
            time.sleep(config.wait(passes))
        new = one_pass(groups, nodes, extractor, config.attempts).persist()
        stale = groups.select(F.col("source_id").alias("content_hash"), F.col("index").alias("first_index"))
        kept = store.read("extractions").join(stale, ["content_hash", "first_index"], "left_anti")
        store.commit({"extractions": kept.unionByName(new)})
        passes += 1
        new.unpersist()
        groups.unpersist()


def persist(store: Store, candidates: DataFrame, skills: DataFrame, config: IngestConfig, outcomes: DataFrame | None = None) -> str | None:
    """Write to the pool, again after errors that may pass; the last error, or None."""
    for attempt in range(1, max(1, config.attempts) + 1):
        try:
            store.upsert_candidates(candidates, skills, outcomes)
            return None
        except Exception as e:  # whatever the file system raises; what it says decides on another try
            error = f"{type(e).__name__}: {e}"
            if attempt >= config.attempts or (not isinstance(e, ConflictError) and any(k in error.lower() for k in PERSIST_FATAL)):
                return error
            time.sleep(config.wait(attempt))
    return None


def ingest(docs: DataFrame, store: Store, batch: str | None = None, config: IngestConfig = IngestConfig(), extractor=gazetteer_extractor, linker=None, mark: tuple[str, int] | None = None) -> DataFrame:
    """Put documents (readers.documents) into the pool; path, thread_id, candidate_id, action, status, in_pool, error of each.

    extractor: (chunks: source_id, index, text; nodes) -> source_id, index, skill, weight, context, optionally error.
    linker: (phrases: source_id, surface, weight, context, seq; nodes) -> the same with node, score and method.
    mark: a stream's name and the number of its batch, committed together with what the batch puts into the pool. A batch
    that is known there has been written: nothing is done again, and its outcomes are given again.
    """
    if mark and not (known := store.outcomes(*mark)).isEmpty():
        return known
    nodes = store.read("skills")
    planned = plan(docs, store.read("candidates")).persist()
    todo = planned.where("action IN ('new', 'again')").persist()
    tries = extract(todo, store, extractor, config)
    ids = todo.select("content_hash", "candidate_id", "source_id", "path")
    named = tries.where("done").join(ids, "content_hash")
    spans = F.sequence("first_index", F.col("first_index") + F.col("n") - 1)
    failed = named.where("error IS NOT NULL").select("candidate_id", F.explode(spans).alias("i")).groupBy("candidate_id").agg(F.array_sort(F.collect_set("i")).alias("failed_chunks"))
    mentions = named.select("candidate_id", F.col("first_index").alias("seq"), F.explode("skills").alias("s")).select(F.col("candidate_id").alias("source_id"), "seq", "s.*")
    merged = linking.merge_mentions(mentions, "source_id").withColumnRenamed("skill", "surface")
    link_error = None
    try:
        linked = (linker or gazetteer_linker)(merged, nodes).persist()
        linked.count()
    except Exception as e:  # the embedder is foreign code; its failure ends the documents, but what was extracted stays
        link_error = f"{type(e).__name__}: {e}"
        linked = merged.withColumns({"node": F.lit(None).cast("string"), "score": F.lit(0.0), "method": F.lit("unresolved")}).limit(0)
    skills = linking.collapse(linked, "source_id").select(F.col("source_id").alias("candidate_id"), "node", "weight", "context", "method", F.round("score", 4).alias("link_score"))
    lost = linked.where("node IS NULL").groupBy(F.col("source_id").alias("candidate_id")).agg(F.array_sort(F.collect_set("surface")).alias("unresolved"))
    batches = F.array(F.lit(batch)) if batch else F.array().cast("array<string>")
    rows = todo.select("candidate_id", F.col("source_id").alias("name"), F.lit(config.doc_type).alias("doc_type"), "content_hash", batches.alias("batch_ids"), F.current_timestamp().alias("extracted_at")).join(lost, "candidate_id", "left")
    rows = rows.join(failed, "candidate_id", "left").withColumn("failed_chunks", F.coalesce("failed_chunks", F.array().cast("array<int>")))
    old = store.read("candidates").join(planned.where("action = 'reused'").select("candidate_id").distinct(), "candidate_id", "left_semi")
    kept = store.read("has_skill").join(old, "candidate_id", "left_semi")
    attach = old.withColumn("batch_ids", F.array_union(F.coalesce("batch_ids", F.array()), batches))
    new = rows if link_error is None else rows.limit(0)
    put = new.unionByName(attach).dropDuplicates(["candidate_id"])
    partial = failed.select("candidate_id", F.lit(True).alias("partial"))

    def outcome(persist_error: str | None) -> DataFrame:
        working = F.col("lead").isin("new", "again")  # a copy shares its original's outcome
        status = F.when(F.col("action") == "error", "failed").when(working & F.lit(link_error is not None), "link_failed")
        status = status.when(F.lit(persist_error is not None), "persist_failed").when(working & F.coalesce("partial", F.lit(False)), "partial")
        status = status.when(F.col("action").isin("new", "again"), "complete").otherwise("reused")
        error = F.coalesce("error", F.when(status == "link_failed", F.lit(link_error)).when(status == "persist_failed", F.lit(persist_error)))
        return planned.join(partial, "candidate_id", "left").select(
            "path", T.thread_id(F.col("source_id"), F.col("path")).alias("thread_id"), "candidate_id", "action", status.alias("status"), status.isin("complete", "partial", "reused").alias("in_pool"), error.alias("error")
        )

    marked = None
    if mark and link_error is None:
        marked = outcome(None).dropDuplicates(["path"]).withColumns({"query": F.lit(mark[0]), "batch": F.lit(mark[1]).cast("long")})
    persist_error = persist(store, put, skills.unionByName(kept), config, marked)
    if persist_error is None and link_error is None:
        # what has reached the pool needs no cursor any more; failed tries are the pool's failed_chunks
        store.commit({"extractions": store.read("extractions").join(todo.select("content_hash"), "content_hash", "left_anti")})
    return outcome(persist_error)


def gazetteer_linker(phrases: DataFrame, nodes: DataFrame) -> DataFrame:
    """The default linker: aliases and surfaces, without an embedder."""
    return linking.link(phrases, nodes.withColumn("text", F.col("name")), use_embedding=False)


def stream(spark: SparkSession, folder: str, store: Store, checkpoint: str, batch: str | None = None, config: IngestConfig = IngestConfig(), extractor=gazetteer_extractor, once: bool = True) -> StreamingQuery:
    """Ingest files as they arrive. A restart with the same checkpoint goes on where it stopped. A batch is written once: its
    number is committed with the pool, so one that was interrupted after its commit isn't written again, and one that was
    interrupted before goes on with the tries that the store has."""
    glob = "*.{" + ",".join(readers.SUFFIXES) + "}"
    files = spark.readStream.schema(FILES).format("binaryFile").option("pathGlobFilter", glob).option("maxFilesPerTrigger", config.max_files).load(folder)

    def put(df: DataFrame, epoch: int) -> None:
        ingest(readers.documents(df), store, batch, config, extractor, mark=(checkpoint, epoch)).collect()

    writer = files.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
