"""Documents: hashes, duplicates, chunks, chunk groups, rate windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T


def hashed(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with norm_text and content_hash of the normalized text."""
    x = docs.withColumn("norm_text", T.normalize_document(F.col(text)))
    return x.withColumn("content_hash", T.content_hash(F.col("norm_text")))


def first_of_each(docs: DataFrame, id_col: str = "doc_id", hash_col: str = "content_hash") -> DataFrame:
    """docs with original: the smallest id with the same content; an empty hash is nobody's duplicate.

    One aggregate and one join, so that a group of copies of any size needs no task of its own.
    """
    least = docs.where(F.col(hash_col) != "").groupBy(hash_col).agg(F.min(id_col).alias("original"))
    return docs.join(least, hash_col, "left").withColumn("original", F.coalesce("original", F.col(id_col)))


def chunked(docs: DataFrame, chunk_words: int = 375, overlap: int = 40, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, index, text of overlapping word windows. A text is split once, so time is in proportion to its length."""
    split = docs.select(F.col(id_col).alias("__id"), T.words(F.col(text)).alias("__w"))
    return split.select("__id", F.explode(T.windows(F.col("__w"), chunk_words, overlap)).alias("__c")).select(F.col("__id").alias(id_col), "__c.index", "__c.text")


def chunk_groups(chunks: DataFrame, size: int, id_col: str = "doc_id") -> DataFrame:
    """id, group, n, first_index, text: `size` consecutive chunks (1 at least) joined under section headers."""
    size = max(1, size)
    x = chunks.withColumn("group", F.floor(F.col("index") / size).cast("int"))
    x = x.groupBy(id_col, "group").agg(F.sort_array(F.collect_list(F.struct("index", "text"))).alias("c"))
    n = F.size("c")
    headed = F.transform("c", lambda c, i: F.concat(F.lit("--- SECTION "), (i + 1).cast("string"), F.lit(" of "), n.cast("string"), F.lit(" ---\n"), c["text"]))
    return x.select(id_col, "group", n.cast("long").alias("n"), F.col("c")[0]["index"].alias("first_index"), F.when(n == 1, F.col("c")[0]["text"]).otherwise(F.array_join(headed, "\n\n")).alias("text"))


def calls_in_window(calls: DataFrame, seconds: int = 60, rpm: int = 15, key: str = "user_id", ts: str = "ts") -> DataFrame:
    """calls with n (calls of the key in the last `seconds`, itself included) and over (more than rpm; never for rpm <= 0)."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    w = W.partitionBy(key).orderBy(at).rangeBetween(-seconds * 1_000_000, 0)
    n = F.count("*").over(w)
    return calls.withColumn("n", n).withColumn("over", (F.col("n") > rpm) & F.lit(rpm > 0))


def upsert(old: DataFrame, new: DataFrame, key: str, keep_if_null: tuple[str, ...] = (), append: tuple[str, ...] = ()) -> DataFrame:
    """old with new's rows put in by key: new values win, but for keep_if_null columns that are null in new, and append
    columns (arrays), which are united."""
    o, n = old.select(F.struct(*old.columns).alias("o"), key), new.select(F.struct(*new.columns).alias("n"), key)
    cols = []
    for c in old.columns:
        if c == key:
            cols.append(F.col(key))
        elif c not in new.columns:
            cols.append(F.col(f"o.{c}").alias(c))
        elif c in append:
            cols.append(F.when(F.col("n").isNull(), F.col(f"o.{c}")).otherwise(F.array_union(F.coalesce(f"o.{c}", F.array()), F.coalesce(f"n.{c}", F.array()))).alias(c))
        elif c in keep_if_null:
            cols.append(F.coalesce(f"n.{c}", f"o.{c}").alias(c))
        else:
            cols.append(F.when(F.col("n").isNull(), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c))
    return o.join(n, key, "full_outer").select(*cols)


def replace_children(old: DataFrame, new: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Child rows after a parent's set was replaced: old rows of other parents, and new ones."""
    return old.join(parents.select(key).distinct(), key, "left_anti").unionByName(new)


def drift(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """key and change of every key in either table: added, removed or kept."""
    o, n = old.select(key).distinct().withColumn("__o", F.lit(True)), new.select(key).distinct().withColumn("__n", F.lit(True))
    change = F.when(F.col("__o").isNull(), "added").when(F.col("__n").isNull(), "removed").otherwise("kept")
    return o.join(n, key, "full_outer").select(key, change.alias("change"))


def profiles(have: DataFrame) -> DataFrame:
    """cand and profile, a map of its skills to weights; a skill that is there twice counts at its largest weight."""
    one = have.groupBy("cand", "skill").agg(F.max("weight").alias("weight"))
    return one.groupBy("cand").agg(F.map_from_entries(F.collect_list(F.struct("skill", "weight"))).alias("profile"))


def in_batch(candidates: DataFrame, batch: str | None) -> DataFrame:
    """Candidates of a batch; all for None or an empty name, none for an unknown one."""
    return candidates.where(F.array_contains("batch_ids", batch)) if batch else candidates


def pool_summary(candidates: DataFrame, has_skill: DataFrame) -> DataFrame:
    """candidate_id, name, skill_count, unresolved_count, by name."""
    n = has_skill.groupBy("candidate_id").agg(F.count("*").alias("skill_count"))
    x = candidates.join(n, "candidate_id", "left")
    return x.select("candidate_id", "name", F.coalesce("skill_count", F.lit(0)).alias("skill_count"), F.size(F.coalesce("unresolved", F.array())).cast("long").alias("unresolved_count")).orderBy("name")
