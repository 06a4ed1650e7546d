"""What jobs of the engine share: the package on the executors, tables in the shared folder, and numbered rows."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_OWN: list[tuple] = []  # paths of intermediate tables, with the context that wrote them


@atexit.register
def _remove_own() -> None:
    for sc, path in _OWN:
        try:
            path = sc._jvm.org.apache.hadoop.fs.Path(path)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the JVM may have gone, and an unclean folder must not fail a finished job
            return


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from wherever the driver found it; on a cluster that has it with
    ``--py-files`` the added path does no harm."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a local master, whose executors are on the same machine, gets a folder
    of its own without it."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not (folder := spark.conf.get("spark.checkpoint.dir", None)):
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="loomgraph-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint folder, removed when the driver's process ends."""
    path = f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _OWN.append((spark.sparkContext, path))
    return path


def checkpointed(df: DataFrame) -> DataFrame:
    """df, cut from its lineage in the shared checkpoint folder; its files go when the driver's process ends."""
    checkpoint_folder(df.sparkSession)
    ship(df.sparkSession)
    out = df.checkpoint()
    file = out._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if file.isDefined():
        _OWN.append((df.sparkSession.sparkContext, file.get()))
    return out


def dropped(df: DataFrame) -> None:
    """Remove the files of checkpointed(df), which nothing will read again, and let Spark remove the shuffles that no plan
    refers to any more; on disk both would stay until the driver's process ends."""
    sc, rdd = df.sparkSession.sparkContext, df._jdf.queryExecution().logical().rdd()
    file = rdd.getCheckpointFile()
    if file.isDefined():
        path = sc._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
        _OWN.remove((sc, file.get()))
    sc._jvm.System.gc()


def placed(rows: DataFrame, *order, name: str = "place") -> DataFrame:
    """rows with 0, 1, 2, ... in that order, from the counts of range partitions: no task orders all rows."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = checkpointed(rows.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))
    ahead = W.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)  # a row for each partition
    starts = rows.groupBy("__part").agg(F.count("*").alias("n")).select("__part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("__start"))
    own = F.row_number().over(W.partitionBy("__part").orderBy(*order))
    out = rows.withColumn("__own", own).join(F.broadcast(starts), "__part")
    return out.withColumn(name, F.col("__start") + F.col("__own") - 1).drop("__part", "__start", "__own")


#: Rows that a task of spread() holds, on average.
SPREAD = 1_000_000


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df dealt by keys to tasks of about SPREAD rows, where `rows` are more than the session's partitions hold at that size."""
    parts = -(-rows // SPREAD)
    return df if parts <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df.repartition(parts, *keys)
