"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Words of the contracts: runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows and bytes of an Arrow batch handed to a Python worker, and bytes of text handed to a function at once (one text
#: may be longer).
BATCH_ROWS = 256
BATCH_BYTES = 4 << 20
PIECE_BYTES = 4 << 20

_OWN: list[tuple] = []  # paths of intermediate tables, with the context that wrote them


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package, take small Arrow batches, and see that there is a checkpoint folder.

    The two batch settings of the session are lowered, never raised. On a cluster the package is normally shipped with
    ``--py-files``; the added path does no harm there. Intermediate tables go to the folder that spark.checkpoint.dir
    names; only a local master, whose executors are on the same machine, gets a folder of its own without it.
    """
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key)
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))
    if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="loomgraph-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(folder)


@atexit.register
def _remove_own() -> None:
    for sc, path in _OWN:
        try:
            path = sc._jvm.org.apache.hadoop.fs.Path(path)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the JVM may have gone, and an unclean folder must not fail a finished job
            return


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint folder; it is removed when the driver's process ends."""
    prepare(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"
    _OWN.append((spark.sparkContext, path))
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and read it from there from now on."""
    prepare(df.sparkSession)
    out = df.checkpoint()
    file = out._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if file.isDefined():
        _OWN.append((df.sparkSession.sparkContext, file.get()))
    return out


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def remainder(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def unit(doc_id: Column, salt: str) -> Column:
    """A number in [0, 1) that depends on the id and the salt only."""
    h = F.xxhash64(F.lit(salt), doc_id)
    return F.pmod(h, F.lit(1 << 48)) / F.lit(float(1 << 48))


def clash(keep, own, what: str = "keep") -> None:
    """Refuse columns to keep that would be in the result twice; names count as Spark resolves them, whatever their case."""
    low = [c.lower() for c in (*keep, *own)]
    if twice := sorted({c for c in low if low.count(c) > 1}):
        raise ValueError(f"{what} names columns that the result has already: {', '.join(twice)}; rename them first")


def pieces(sizes: np.ndarray, most: int = PIECE_BYTES) -> list[tuple[int, int]]:
    """Ranges of consecutive rows with at most so many bytes, or of one row."""
    out, first, total = [], 0, 0
    for i, n in enumerate(sizes.tolist()):
        if total + n > most and i > first:
            out.append((first, i))
            first, total = i, 0
        total += n
    return [*out, (first, len(sizes))]


def map_texts(df: DataFrame, keep: list[str], schema: str, fn, text: str = "text") -> DataFrame:
    """Rows of fn over pieces of Arrow batches: fn(list of texts or None) -> dict of columns, in the order of the texts.

    keep: columns passed through unchanged (the text goes to Python once, kept or not). schema: the DDL of fn's columns.
    """
    prepare(df.sparkSession)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    out_schema = StructType.fromDDL(schema)
    clash(keep, out_schema.names)
    out_schema = StructType.fromDDL(", ".join([*(f"`{c}` {types[c]}" for c in keep), schema]))
    n = len(keep)
    at = keep.index(text) if text in keep and types[text] == "string" else n
    sent = [F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(keep)]
    if at == n:
        sent.append(F.col(f"`{text}`").cast("string").alias("__text"))

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out_schema)
        for whole in batches:
            sizes = pc.fill_null(pc.binary_length(whole.column(at)), 0).to_numpy(zero_copy_only=False)
            for a, b in pieces(sizes) if whole.num_rows else ():
                part = whole.slice(a, b - a)
                got = fn(part.column(at).to_pylist())
                cols = [part.column(i).cast(arrow.field(i).type) for i in range(n)]
                cols += [pa.array(got[arrow.field(i).name], type=arrow.field(i).type) for i in range(n, len(arrow))]
                yield pa.RecordBatch.from_arrays(cols, schema=arrow)
        pa.default_memory_pool().release_unused()  # the worker stays for other stages

    return df.select(*sent).mapInArrow(run, out_schema)


def splitmix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over unsigned 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, learn: Column, salt: str) -> DataFrame:
    """doc_id, text and label of about `rows` labelled documents at most, chosen by a hash of the id.

    learn: which documents may be learnt from. Both sides are filtered before they meet, so the join is as small as
    the sample. Ids that labels holds more than once, or with null, count once or not at all.
    """
    labels = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("label"))
    share = min(1.0, rows / max(1, labels.count()))
    chosen = unit(F.col("doc_id"), salt) < share if share < 1 else F.lit(True)
    few = labels.where(chosen).groupBy("doc_id").agg(F.max("label").alias("label"))
    return docs.where(learn & chosen & F.col("doc_id").isNotNull()).select("doc_id", "text").join(few, "doc_id")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's method; the last weight is the intercept."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    penalty = ridge * len(x) * np.r_[np.ones(x.shape[1] - 1), 1e-6]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, x.T @ (p - y) + penalty * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w
