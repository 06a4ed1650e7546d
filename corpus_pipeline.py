"""A corpus pipeline of training-data operators over documents.

Stages, in order; each one works on all that its predecessor kept, written as Parquet and read again:
language   documents without a language (`und`: no text or no letter) go
toxicity   documents that the toxicity model marks (score >= 0.7) go
near_dups  the document with the smallest id of each near-duplicate group (similarity 0.8 or more) stays
mixing     sources are mixed to target weights: a document is there once for each complete epoch, once more if the
           fractional selection takes it whole, and cut at the budget if it lies on its border
tokens     doc_id, source, n_tokens, ids_sha256, decoded_sha256 and token_ids of each remaining row

Every stage takes nulls in any column, empty and very long texts, repeated rows, further columns of any name, and an
empty table; what it makes of them its function says, or the operator that it calls. All but the last return the columns
of documents. Models learn from the labels of the data directory and from the
documents a stage is given, by the same rule of held-out ids as the single queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import bpe, langid, mixing, neardup, toxicity
from loomgraph.llm.common import cut, folder, prepare, read, remainder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Similarity of five-word shingles from which the stage takes documents for near duplicates, in hundredths.
STAGE_SIMILAR = 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known, as the model finds it; a model of no label finds none and keeps nothing."""
    model = langid.train(docs.where(~langid.held_out()))
    out = langid.identify(docs, model, list(COLUMNS))
    return out.where(F.col("lang_pred") != langid.UNKNOWN).select(*COLUMNS)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model doesn't mark; nulls, empty and repeated ones are scored like any other."""
    model = toxicity.train(docs, read(spark, sf_dir, "labels"), remainder("doc_id", 3) != 1)
    return toxicity.score(docs, model, list(COLUMNS)).where("predicted = 0").select(*COLUMNS)


def near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str, similar: int = neardup.SIMILAR) -> DataFrame:
    """Rows that share an id and a text are one document, those that share an id only are several; of a group the first in
    the order of ids stays. Rows without an id stay."""
    prepare(spark)
    named = docs.where("doc_id IS NOT NULL")
    if named.groupBy("doc_id").count().where("count > 1").isEmpty():
        gone = cut(neardup.groups(named, similar=similar).where("NOT kept").select("doc_id"))
        return neardup.without(docs, gone).select(*COLUMNS)
    digest = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    one = named.groupBy("doc_id", digest.alias("__h")).agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("x")).select("doc_id", "__h", "x.*")
    placed = mixing.numbered(one, "doc_id", "__h")
    kept = neardup.groups(placed, "__place", similar=similar).where("kept").select(F.col("doc_id").alias("__place"))
    return placed.join(kept, "__place", "left_semi").select(*COLUMNS).unionByName(docs.where("doc_id IS NULL").select(*COLUMNS))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document of size s with t words taken gives t // s whole rows and, for a rest, its first t % s words.

    The mix is made over keys and sizes; texts are shuffled once, to meet it. Equal rows are there once for what they
    take together.
    """
    prepare(spark)
    text = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    keyed = docs.select(*COLUMNS).withColumn("__k", F.md5(F.concat_ws("|", text, F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce("source", F.lit("\0"))).cast("binary")))
    taken = mixing.mix(keyed, keep=("__k",)).groupBy("__k").agg(F.sum("taken").alias("taken"), F.first("size").alias("size"), F.count("*").alias("rows"))
    taken = cut(taken.where("taken > 0"))
    got = keyed.join(taken, "__k")
    if not (several := taken.where("rows > 1")).isEmpty():
        few = keyed.join(several, "__k").groupBy("__k", "taken", "size", "rows").agg(F.min(F.struct(*COLUMNS)).alias("x"))
        got = got.where("rows = 1").unionByName(few.select("__k", "taken", "size", "rows", "x.*"))
    whole, rest = F.expr("taken div size"), F.col("taken") % F.col("size")
    got = got.withColumns({"__whole": whole, "__rest": rest})
    got = got.withColumn("__i", F.explode(F.sequence(F.lit(1), (F.col("__whole") + (F.col("__rest") > 0).cast("int")).cast("int"))))
    pieces = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++"), 0)
    head = F.array_join(F.slice(pieces, F.lit(1), F.col("__rest").cast("int")), "")
    part = F.col("__i") > F.col("__whole")
    got = got.withColumn("text", F.when(part, head).otherwise(F.col("text")))
    return got.withColumn("n_chars", F.when(part, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's tokens; a null text has none."""
    return bpe.tokenize(docs, *bpe.vocabulary(), ["doc_id", "source"])


def near_dups_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dups(spark, docs, sf_dir, STAGE_SIMILAR)


STAGES = [("language", language), ("toxicity", toxic), ("near_dups", near_dups_stage), ("mixing", mixed), ("tokens", tokens)]
#: Language models, signatures and BPE can't be stated in SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over documents, with a table in the shared folder between stages."""
    docs = read(spark, sf_dir, "documents")
    where = folder(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = f"{where}/{i}-{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
