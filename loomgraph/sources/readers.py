"""Reading documents, taxonomies, caches and evaluation snapshots. Parser failures become an error column."""

from __future__ import annotations

import io
import json
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from .pdf import Pdf

SUFFIXES = ("txt", "md", "docx", "pdf")
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(data: bytes) -> str:
    """Paragraphs, and table rows with cells joined by ' | ', in document order."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_WORD}body")
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
        raise ValueError(f"not a DOCX file: {e}") from e
    said = lambda x: "".join(t.text or "" for t in x.iter(f"{_WORD}t"))
    lines = []
    for part in body if body is not None else ():
        if part.tag == f"{_WORD}p":
            lines.append(said(part))
        elif part.tag == f"{_WORD}tbl":
            lines += [" | ".join("\n".join(map(said, c.iter(f"{_WORD}p"))) for c in row.iter(f"{_WORD}tc")) for row in part.iter(f"{_WORD}tr")]
    return "\n".join(lines)


def pdf_text(data: bytes) -> str:
    """Text of the pages, one after the other; a page of images has none. By pypdf where it is installed."""
    if not data.startswith(b"%PDF"):
        raise ValueError("not a PDF file")
    try:
        from pypdf import PdfReader
    except ImportError:
        PdfReader = None
    try:
        return "\n".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(data)).pages) if PdfReader else Pdf(data).text()
    except Exception as e:
        raise ValueError(f"broken PDF file: {e}") from e


def parse(data: bytes, suffix: str, permissive: bool = False) -> str:
    """permissive: an unknown suffix is read as text."""
    if suffix == "docx":
        return docx_text(data)
    if suffix == "pdf":
        return pdf_text(data)
    if suffix in ("txt", "md") or permissive:
        return data.decode("utf-8", "replace")
    raise ValueError(f"unsupported file type .{suffix}")


def parsed(files: DataFrame, permissive: bool = False) -> DataFrame:
    """source_id (stem), path, text, error of binary files (path, content)."""

    def run(batches):
        for pdf in batches:
            rows = []
            for path, content in pdf[["path", "content"]].itertuples(index=False):
                name = path.rsplit("/", 1)[-1]
                stem, _, suffix = name.rpartition(".")
                try:
                    rows.append((stem or name, path, parse(bytes(content), suffix.lower() if stem else "", permissive), None))
                except (ValueError, ImportError) as e:
                    rows.append((stem or name, path, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["source_id", "path", "text", "error"])

    return files.select("path", "content").mapInPandas(run, "source_id string, path string, text string, error string")


def documents(files: DataFrame, permissive: bool = False) -> DataFrame:
    """parsed() with normalized text and its content_hash; a blank document is an error."""
    return finished(parsed(files, permissive))


def finished(parsed: DataFrame) -> DataFrame:
    """What documents() makes of parsed texts."""
    x = parsed.withColumn("text", T.normalize_document(F.col("text")))
    x = x.withColumn("error", F.when(F.col("error").isNull() & (F.col("text") == ""), "ValueError: no text").otherwise(F.col("error")))
    return x.withColumn("content_hash", T.content_hash(F.col("text")))


def read_directory(spark: SparkSession, path: str) -> DataFrame:
    """Files of the supported types, by path."""
    glob = "*.{" + ",".join(SUFFIXES) + "}"
    return documents(spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)).orderBy("path")


def read_bytes(spark: SparkSession, named: list[tuple[str, bytes]], permissive: bool = True) -> DataFrame:
    """Uploaded (name, bytes) pairs."""
    return documents(spark.createDataFrame(named, "path string, content binary"), permissive)


def read_taxonomy(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Occupations (soc, title) and skills (soc, skill, element, hot, demand) from the tab-separated taxonomy files."""
    tsv = lambda name: spark.read.csv(f"{folder}/{name}", sep="\t", header=True, quote="")
    soc = F.col("`O*NET-SOC Code`").alias("soc")
    occupations = tsv("Occupation Data.txt").select(soc, F.col("Title").alias("title"))
    skills = tsv("Software Skills.txt").select(soc, F.col("Workplace Example").alias("skill"), F.col("Element Name").alias("element"), F.col("Hot Technology").alias("hot"), F.col("In Demand").alias("demand"))
    return occupations, skills


CACHE_SCHEMA = "a string, b string, edge_type string, direction string, confidence double, source string, rationale string, seq long"


def read_typed_cache(spark: SparkSession, path: str) -> DataFrame:
    """Classified pairs from JSON lines; of a pair in either order, the row with the largest seq counts."""
    x = spark.read.schema(CACHE_SCHEMA).json(path).where("a IS NOT NULL AND b IS NOT NULL")
    last = F.row_number().over(W.partitionBy(F.least("a", "b"), F.greatest("a", "b")).orderBy(F.desc("seq")))
    return x.withColumn("rn", last).where("rn = 1").drop("rn")


def append_typed_cache(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def load_dataset(text: str, split: str | None = None) -> dict:
    """An evaluation snapshot, restricted to a split with its counts made anew."""
    data = json.loads(text)
    jds = [j for j in data["jds"] if split is None or j["split"] == split]
    return data | {"jds": jds, "n_jds": len(jds), "n_pairs": sum(len(j["candidates"]) for j in jds)}


EXTRACTED = "array<struct<skill:string,weight:double,context:string>>"


def from_payload(df: DataFrame, payload: str = "payload") -> DataFrame:
    """df with skills and error from a model's JSON: a list, or {"skills": [...]} or {"items": [...]}, fenced or not.

    A payload with one malformed entry is rejected as a whole.
    """
    x = T.strip_fences(F.col(payload))
    body = F.coalesce(F.get_json_object(x, "$.skills"), F.get_json_object(x, "$.items"), x)
    raw = F.from_json(body, EXTRACTED)
    tidy = F.transform(raw, lambda s: F.struct(T.collapse(s["skill"]).alias("skill"), F.coalesce(s["weight"], F.lit(1.0)).alias("weight"), T.collapse(s["context"]).alias("context")))
    bad = lambda s: (
        F.coalesce(s["skill"], F.lit("")).eqNullSafe("") | (F.length(s["skill"]) > 120) | ~s["weight"].between(0.5, 1.5)
        | F.coalesce(s["context"], F.lit("")).eqNullSafe("") | (F.length(s["context"]) > 400)
    )
    broken = tidy.isNull() | F.exists(tidy, bad)
    return df.withColumn("error", F.when(broken, "malformed payload")).withColumn("skills", F.when(~broken, tidy))
