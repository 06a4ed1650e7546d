"""Column expressions over text, with Python's notion of white space and word characters ((?U) patterns)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Vendor prefixes and suffixes of taxonomy names, and cores that are common words.
VENDOR_PREFIXES = (
    "microsoft ", "apache ", "oracle ", "ibm ", "google ", "amazon ", "adobe ", "atlassian ", "red hat ", "sap ", "esri ",
    "trimble ", "salesforce ", "cisco ", "the mathworks ", "splunk ", "teradata ", "grafana labs ",
)
DROP_SUFFIXES = (" software", " ci", " ide")
STOP_CORES = (
    "software", "database", "systems", "system", "server", "platform", "access", "development", "cloud", "framework",
    "enterprise", "studio", "data", "word", "analytics", "services", "web", "office", "management", "project", "teams",
    "statistical", "version control", "content", "reporting", "design",
)
#: Line boundaries of str.splitlines.
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\u0085  ]"


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def words(x: Column) -> Column:
    """White-space separated words; an empty array for blank text."""
    s = strip(x)
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, r"(?U)\s+"))


def normalize(x: Column) -> Column:
    """Lower case; all but word characters, + # . and - become single spaces."""
    return F.lower(strip(F.regexp_replace(F.regexp_replace(x, r"(?U)[^\w+#.\- ]+", " "), r"(?U)\s+", " ")))


def core_form(x: Column) -> Column:
    """normalize() without the first vendor prefix that fits and without each suffix, in order."""
    out = F.regexp_replace(normalize(x), "^(?:" + "|".join(VENDOR_PREFIXES) + ")", "")
    for s in DROP_SUFFIXES:
        out = F.regexp_replace(out, s + "$", "")
    return strip(out)


def embedded_acronyms(x: Column) -> Column:
    """Distinct lower-cased words of 2 to 6 capitals and digits that start with a capital, but for stop cores, sorted."""
    found = F.transform(F.regexp_extract_all(x, F.lit(r"(?U)\b[A-Z][A-Z0-9]{1,5}\b"), 0), F.lower)
    return F.sort_array(F.array_except(F.array_distinct(found), F.array(*map(F.lit, STOP_CORES))))


def normalize_document(x: Column) -> Column:
    """Lines with single spaces and no outer white space; at most one empty line in a row."""
    lines = F.split(x, LINE_BREAK)
    lines = F.transform(lines, lambda line: strip(F.regexp_replace(line, r"[ \t\r\f\x0B]+", " ")))
    return strip(F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n"))


def collapse(x: Column) -> Column:
    return strip(F.regexp_replace(x, r"(?U)\s+", " "))


def content_hash(x: Column) -> Column:
    """SHA-256 of normalized text; null for null."""
    return F.sha2(x.cast("binary"), 256)


def windows(w: Column, chunk_words: int = 375, overlap: int = 40) -> Column:
    """Overlapping windows of an array of words as array<struct<index:int,text:string>>; none of no words.

    Windows start every chunk_words - overlap words, and the first one that reaches the end is the last. w should be a
    column, not an expression: it is read once for each window.
    """
    if chunk_words <= 0 or not 0 <= overlap < chunk_words:
        raise ValueError("chunk_words > overlap >= 0 is needed")
    stride = chunk_words - overlap
    n = F.when(F.size(w) == 0, 0).otherwise(1 + F.ceil(F.greatest(F.size(w) - chunk_words, F.lit(0)) / stride)).cast("int")
    index = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: i < n)
    return F.transform(index, lambda i: F.struct(i.alias("index"), F.array_join(F.slice(w, i * stride + 1, F.lit(chunk_words)), " ").alias("text")))


def mentions(text: Column, alias: Column) -> Column:
    """Whether lower-cased text has alias (a column of lower-cased literals) as a whole word; + # . count as letters."""
    quoted = F.concat(F.lit(r"(?U)(?<![\w+#.])\Q"), alias, F.lit(r"\E(?![\w+#])"))
    return F.contains(text, alias) & F.regexp_like(text, quoted)


def strip_fences(x: Column) -> Column:
    """Model output without a Markdown code fence around it."""
    return strip(F.regexp_replace(F.regexp_replace(strip(x), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", ""))


# Parts of messages of errors that another try doesn't mend.
FATAL = ("api_key", "apikey", "authentication", "unauthorized", "401", "403", "quota", "billing", "permission denied", "invalid argument")


def retryable(message: Column) -> Column:
    """Whether another try may help: of every error but the fatal ones, known or not."""
    low = F.lower(F.coalesce(message, F.lit("")))
    return ~F.rlike(low, F.lit("|".join(FATAL)))


def thread_id(stem: Column, path: Column) -> Column:
    """<stem>-<first 8 of the path's SHA-1>: what a document's run is resumed by."""
    return F.concat(stem, F.lit("-"), F.substring(F.sha1(path.cast("binary")), 1, 8))


def upload_thread_id(digest: Column) -> Column:
    """upload-<first 16 of the content hash>: an upload has no path that stays."""
    return F.concat(F.lit("upload-"), F.substring(digest, 1, 16))


def casefold(x: Column) -> Column:
    """Full case folding by way of upper case (so that sharp s becomes ss); final sigma becomes sigma. Of letters whose
    upper case is that of another letter only the dotless i folds to more than it should."""
    upper = F.concat(F.upper(x), F.lit(""))  # the optimizer takes upper() out of lower(upper(x))
    return F.translate(F.lower(upper), "\u03c2", "\u03c3")


def document_id(stem: Column, digest: Column) -> Column:
    """<stem>-<first 8 of the hash>."""
    return F.concat(stem, F.lit("-"), F.substring(digest, 1, 8))
