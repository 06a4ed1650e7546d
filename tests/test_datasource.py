"""Files of documents as a data source, against the binary-file reader."""

import os

import pytest
from pyspark.sql import functions as F

from loomgraph.sources import datasource, readers


def write(folder, name, data, at=None):
    p = folder / name
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_bytes(data)
    if at is not None:
        os.utime(p, ns=(at, at))


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "in"
    for i in range(6):
        write(d, f"d{i}.txt", b"Docker and Kubernetes %d\r\n" % i, (i + 1) * 10**18 // 10)
    write(d, "bad.pdf", b"no pdf")
    write(d, "blank.md", b"  \n")
    write(d, "raw.txt", b"x \xff y")
    write(d, "other.xlsx", b"left out")
    write(d, "_hidden.txt", b"left out")
    write(d, "sub/deep.txt", b"deep")
    return d


def test_same_rows_as_the_reader(spark, folder):
    want = readers.read_directory(spark, str(folder))
    cols = want.columns
    got = datasource.read(spark, str(folder))
    assert sorted(map(str, got.select(cols).collect())) == sorted(map(str, want.collect()))
    assert {r["source_id"] for r in got.where("error IS NOT NULL").collect()} == {"bad", "blank"}
    assert datasource.read(spark, f"file://{folder}").count() == 9
    assert datasource.read(spark, str(folder), recursiveFileLookup="true").where("source_id = 'deep'").count() == 1
    assert datasource.read(spark, str(folder), permissive="true").where("source_id = 'other' AND text = 'left out'").count() == 1
    assert datasource.read(spark, str(folder / "d1.txt")).first()["text"] == "Docker and Kubernetes 1"


def test_listing_columns_open_no_file(spark, folder):
    datasource.register(spark)
    (folder / "d0.txt").chmod(0)
    x = spark.read.format(datasource.NAME).schema("length long, path string").load(str(folder))
    assert x.columns == ["length", "path"] and x.agg(F.sum("length")).first()[0] == sum(p.stat().st_size for p in folder.glob("[!_]*.[tmp]*"))
    with pytest.raises(Exception, match="no column"):
        spark.read.format(datasource.NAME).schema("length int").load(str(folder)).collect()
    with pytest.raises(Exception, match="doesn't exist"):
        spark.read.format(datasource.NAME).load(str(folder / "none")).collect()


def test_partitions_by_size(spark, folder):
    f = datasource.Folder({"path": str(folder), "maxpartitionbytes": "60"})
    parts = f.packed(f.listing())
    assert [x for p in parts for x in p.value] == f.listing()
    assert all(len(p.value) == 1 or sum(n for _, _, n in p.value) <= 60 for p in parts) and len(parts) > 3
    datasource.register(spark)
    assert spark.read.format(datasource.NAME).option("maxPartitionBytes", "60").load(str(folder)).rdd.getNumPartitions() == len(parts)
    empty = folder / "empty"
    empty.mkdir()
    assert datasource.read(spark, str(empty)).count() == 0


def test_conditions_reach_the_listing(spark, folder):
    datasource.register(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        x = spark.read.format(datasource.NAME).option("pushFilters", "true").load(str(folder))
        late = x.where(F.col("path").endswith(".txt") & (F.col("modified") > F.timestamp_seconds(F.lit(350_000_000))) & (F.col("length") > 6))
        assert sorted(r["source_id"] for r in late.collect()) == ["d3", "d4", "d5"]
        assert late.rdd.getNumPartitions() == 1
        assert x.where("text LIKE '%Docker%' AND source_id = 'd2'").count() == 1
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_stream_goes_on_at_its_offset(spark, folder, tmp_path):
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")

    def run():
        q = datasource.read_stream(spark, str(folder)).writeStream.format("parquet").option("checkpointLocation", mark).trigger(availableNow=True).start(out)
        q.awaitTermination()
        return sorted(r["source_id"] for r in spark.read.parquet(out).collect())

    first = run()
    assert first == sorted(["bad", "blank", "raw", *(f"d{i}" for i in range(6))])
    assert run() == first
    write(folder, "new.txt", b"late one")
    write(folder, "tie_a.txt", b"late one", 4 * 10**18)
    assert run() == sorted([*first, "new", "tie_a"])
    write(folder, "tie_b.txt", b"late one", 4 * 10**18)
    (folder / "tie_a.txt").unlink()
    assert run() == sorted([*first, "new", "tie_a", "tie_b"])


def test_offsets_settle_and_never_go_back(folder):
    x = datasource.StreamReader(datasource.Folder({"path": str(folder), "settleseconds": "3600"}), None)
    assert x.latestOffset()["path"].endswith("d5.txt")
    (folder / "d5.txt").unlink()
    assert x.latestOffset()["path"].endswith("d5.txt")
    got = x.partitions({"time": 10**17, "path": str(folder / "d0.txt")}, x.latestOffset())
    assert [f[1].rsplit("/", 1)[-1] for p in got for f in p.value] == ["d1.txt", "d2.txt", "d3.txt", "d4.txt"]
