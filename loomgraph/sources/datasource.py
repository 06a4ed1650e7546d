"""Files of documents as a Spark data source, for batches and streams.

    register(spark)
    spark.read.format("loomgraph_documents").load(folder)
    spark.readStream.format("loomgraph_documents").load(folder)

Rows: source_id, path, length, modified, text, error, as of readers.parsed(). A schema of fewer of these columns may be
given; without text and error no file is opened.

Options: pushFilters (conditions on path, length and modified are applied to the listing; Spark asks for
spark.sql.python.filterPushdown.enabled with it, and refuses it without), permissive (other suffixes are read, as text), recursiveFileLookup, maxPartitionBytes (128 MB: files are packed
into partitions up to it, a larger file has one to itself), settleSeconds (streams, 0: files count once they are that old).

A stream's offset is the time and path of the newest file seen, so a batch is the files after its start up to its end, and
a replay lists the same. A file that arrives with an earlier time than one already read isn't seen: write files in place,
or rename them within settleSeconds. A file that is gone when it is read is an error row; any other failure of the file
system fails the task, which Spark then tries again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql.types import StructType

from ..operators.workspace import ship
from . import readers

NAME = "loomgraph_documents"
TYPES = {"source_id": "string", "path": "string", "length": "bigint", "modified": "timestamp", "text": "string", "error": "string"}
PARTITION_BYTES = 128 << 20
#: What opening a file costs, in bytes, so that many small files don't share a partition.
OPEN_BYTES = 1 << 20
_NS = 1_000_000_000


class Folder:
    """The files under a path, on any file system that Arrow knows by its address."""

    def __init__(self, options: dict):
        if not (path := options.get("path")):
            raise ValueError("load() needs a path")
        self.address = path.rstrip("/") or "/"
        self.permissive = options.get("permissive", "false").lower() == "true"
        self.push = options.get("pushfilters", "false").lower() == "true"
        self.recursive = options.get("recursivefilelookup", "false").lower() == "true"
        self.partition_bytes = int(options.get("maxpartitionbytes", PARTITION_BYTES))
        self.settle = float(options.get("settleseconds", 0))
        if self.partition_bytes < 1:
            raise ValueError("maxPartitionBytes must be positive")

    def _open(self) -> tuple[pafs.FileSystem, str, str]:
        """The file system, the path in it, and what stands before such paths in an address."""
        files, base = pafs.FileSystem.from_uri(self.address) if ":" in self.address else (pafs.LocalFileSystem(), self.address)
        if isinstance(files, pafs.LocalFileSystem):
            return files, base, "file:"
        return files, base, self.address[: len(self.address) - len(base.rstrip("/"))]

    def listing(self) -> list[tuple[int, str, int]]:
        """Time in nanoseconds, path and length of the files, in order."""
        files, base, _ = self._open()
        info = files.get_file_info(base)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(f"{self.address} doesn't exist")
        found = [info] if info.type == pafs.FileType.File else files.get_file_info(pafs.FileSelector(base, recursive=self.recursive))
        start = 0 if info.type == pafs.FileType.File else len(base.rstrip("/")) + 1
        kept = (f for f in found if f.type == pafs.FileType.File and not any(p[:1] in "._" for p in f.path[start:].split("/") if start))
        return sorted((f.mtime_ns or 0, f.path, f.size) for f in kept if self.permissive or f.extension.lower() in readers.SUFFIXES)

    def packed(self, listing: list[tuple[int, str, int]]) -> list[Files]:
        """Partitions of files, in the order of the listing; one without files for an empty listing."""
        out, held = [Files([])], 0
        for at, path, length in listing:
            cost = length + min(OPEN_BYTES, self.partition_bytes // 64)
            if out[-1].value and held + cost > self.partition_bytes:
                out.append(Files([]))
                held = 0
            out[-1].value.append((at, path, length))
            held += cost
        return out

    def rows(self, files: Files, schema: StructType) -> Iterator[pa.RecordBatch]:
        """A batch for each file, so that one file's text is held at a time; only the columns of schema."""
        source, _, before = self._open()
        columns = schema.fieldNames()
        opened = bool({"text", "error"} & set(columns))
        for at, path, length in files.value:
            name = path.rsplit("/", 1)[-1]
            stem, _, suffix = name.rpartition(".")
            row = {"source_id": stem or name, "path": before + path, "length": length, "modified": time_of(at), "text": None, "error": None}
            if opened:
                try:
                    with source.open_input_stream(path) as f:
                        row["text"] = readers.parse(f.read(), suffix.lower() if stem else "", self.permissive)
                except (ValueError, ImportError, FileNotFoundError) as e:
                    row["error"] = f"{type(e).__name__}: {e}"
            yield pa.RecordBatch.from_arrays([pa.array([row[c]], ARROW[c]) for c in columns], columns)


ARROW = {"source_id": pa.string(), "path": pa.string(), "length": pa.int64(), "modified": pa.timestamp("us", "UTC"), "text": pa.string(), "error": pa.string()}


def time_of(ns: int) -> datetime:
    """To the microsecond, without a rounding by floats."""
    return datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=ns // 1000)


class Files(D.InputPartition):
    """value: the files (time, path, length) of one partition."""


_COMPARE: dict[type, Callable] = {
    D.EqualTo: lambda x, y: x == y, D.EqualNullSafe: lambda x, y: x == y, D.In: lambda x, y: x in y,
    D.GreaterThan: lambda x, y: x > y, D.GreaterThanOrEqual: lambda x, y: x >= y,
    D.LessThan: lambda x, y: x < y, D.LessThanOrEqual: lambda x, y: x <= y,
    D.StringStartsWith: lambda x, y: x.startswith(y), D.StringEndsWith: lambda x, y: x.endswith(y), D.StringContains: lambda x, y: y in x,
}


class Reader(D.DataSourceReader):
    def __init__(self, folder: Folder, schema: StructType):
        self.folder, self.schema = folder, schema
        self.tests: list[tuple[str, Callable, object]] = []

    def partitions(self) -> list[Files]:
        before = self.folder._open()[2]
        of = {"path": lambda f: before + f[1], "length": lambda f: f[2], "modified": lambda f: time_of(f[0])}
        return self.folder.packed([f for f in self.folder.listing() if all(test(of[c](f), value) for c, test, value in self.tests)])

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return self.folder.rows(partition, self.schema)


class FilteredReader(Reader):
    """A reader that takes conditions; Spark refuses one where the pushdown is off."""

    def pushFilters(self, filters: list[D.Filter]) -> Iterator[D.Filter]:
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if isinstance(f, D.IsNotNull) and column in ("path", "length", "modified", "source_id"):
                continue  # they never are
            if type(f) in _COMPARE and column in ("path", "length", "modified") and f.value is not None:
                self.tests.append((column, _COMPARE[type(f)], f.value))
            else:
                yield f


class StreamReader(D.DataSourceStreamReader):
    def __init__(self, folder: Folder, schema: StructType):
        self.folder, self.schema = folder, schema
        self.last = self.initialOffset()

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        limit = int((datetime.now(timezone.utc).timestamp() - self.folder.settle) * _NS) if self.folder.settle else None
        for at, path, _ in reversed(self.folder.listing()):
            if limit is None or at <= limit:
                if (at, path) > (self.last["time"], self.last["path"]):  # never back, even if the newest file has gone
                    self.last = {"time": at, "path": path}
                break
        return self.last

    def partitions(self, start: dict, end: dict) -> list[Files]:
        low, high = (start["time"], start["path"]), (end["time"], end["path"])
        self.last = max(self.last, end, key=lambda x: (x["time"], x["path"]))
        return self.folder.packed([f for f in self.folder.listing() if low < f[:2] <= high])

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return self.folder.rows(partition, self.schema)


class Documents(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return ", ".join(f"{c} {t}" for c, t in TYPES.items())

    def _folder(self, schema: StructType) -> Folder:
        for f in schema.fields:
            if TYPES.get(f.name) != f.dataType.simpleString():
                raise ValueError(f"no column {f.simpleString()}; there are {self.schema()}")
        return Folder({k.lower(): v for k, v in self.options.items()})

    def reader(self, schema: StructType) -> Reader:
        folder = self._folder(schema)
        return (FilteredReader if folder.push else Reader)(folder, schema)

    def streamReader(self, schema: StructType) -> StreamReader:
        return StreamReader(self._folder(schema), schema)


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    ship(spark)
    spark.dataSource.register(Documents)


def read(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """readers.documents() of the files under a path, with length and modified."""
    register(spark)
    return readers.finished(spark.read.format(NAME).options(**options).load(path))


def read_stream(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """read() of files as they arrive."""
    register(spark)
    return readers.finished(spark.readStream.format(NAME).options(**options).load(path))
