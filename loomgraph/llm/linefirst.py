"""Quality rules, line first: rules judge lines, failing lines go, and a document that loses too much text goes.

A line with words fails if
- punctuation: it doesn't end like a sentence, or at least PUNCTUATION_LEAST of its bytes are ASCII punctuation and
  they are more than PUNCTUATION_SHARE % of its bytes that are not white space;
- navigation: at least two of its words are bare separators and they are NAVIGATION_SHARE % of its words or more;
- boilerplate: it contains, in lower case, one of BOILERPLATE.
A document is kept if its base rules hold and the words of its remaining lines are KEEP_SHARE % of its words or more.

One pass over whole texts, row by row, in Arrow batches: no shuffle, no state; a piece of a batch (PIECE_BYTES of text,
or one text) is in memory.

Defined cases: null and empty texts have no words, fail the base rules and have null or empty cleaned text;
very long texts take time and memory in proportion to their length; of equal lines the first isn't a duplicate, and
shares that equal a limit pass it; repeated rows are judged each for themselves; an empty table gives no rows; columns
that are not named in the arguments are ignored, whatever their names; a name in keep that the result has already is
refused.
"""

from __future__ import annotations

import string
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, read

# Ends of a sentence, bare separators, and phrases of web boilerplate in English, German, French and Spanish.
ENDS = tuple(".!?…:;\"')]”’»。！？")
SEPARATORS = frozenset(x.encode() for x in ("|", ">", "»", "›", "·", "•", "/", "::", "-", "–"))
BOILERPLATE = (
    "accept cookies", "all rights reserved", "back to top", "click here", "cookie policy", "enable javascript",
    "lorem ipsum", "privacy policy", "read more", "share this", "sign up for", "skip to content", "subscribe to",
    "terms of service", "terms of use",
    "alle rechte vorbehalten", "cookies akzeptieren", "datenschutzerklärung", "javascript aktivieren", "newsletter abonnieren",
    "nutzungsbedingungen", "weiterlesen", "zum seitenanfang",
    "abonnez-vous", "accepter les cookies", "activer javascript", "conditions d'utilisation", "haut de page", "lire la suite",
    "politique de confidentialité", "tous droits réservés",
    "aceptar cookies", "activar javascript", "leer más", "política de privacidad", "suscríbete a", "términos de uso",
    "todos los derechos reservados", "volver arriba",
)
PUNCTUATION = string.punctuation.encode()
PUNCTUATION_LEAST = 6
PUNCTUATION_SHARE = 15
NAVIGATION_SHARE = 20
KEEP_SHARE = 50
#: Base rules of the contract.
LEAST_WORDS = 50
REPEAT_SHARE = 50
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\r\x0b\x0c"


def repeated_words(words: list[bytes]) -> int:
    """Words within 3-word windows that occur twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    count = Counter(windows)
    n, end = 0, 0  # end: first word not counted yet
    for i, w in enumerate(windows):
        if count[w] > 1:
            n += i + 3 - max(i, end)
            end = i + 3
    return n


def line_fails(line: str, raw: bytes, words: list[bytes], boilerplate: bool) -> bool:
    """boilerplate: whether the line has to be searched for phrases."""
    if not line.rstrip().endswith(ENDS):
        return True
    solid = sum(map(len, words))
    marks = len(raw) - len(raw.translate(None, PUNCTUATION))
    if marks >= PUNCTUATION_LEAST and 100 * marks > PUNCTUATION_SHARE * solid:
        return True
    bare = sum(w in SEPARATORS for w in words) if any(len(w) < 4 for w in words) else 0
    if bare >= 2 and 100 * bare >= NAVIGATION_SHARE * len(words):
        return True
    return boilerplate and any(p in line.lower() for p in BOILERPLATE)


def judge(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, kept_words, cleaned text."""
    if not text:
        return 0, 0, 0, 0, 0, True, False, 0, text
    words = text.encode().split()
    n = len(words)
    low = text.lower()
    phrases = any(p in low for p in BOILERPLATE)
    seen: set[str] = set()
    dups = left = 0
    out = []
    for line in text.split("\n"):
        raw = line.encode()
        own = raw.split()
        if own:
            if line in seen:
                dups += 1
            else:
                seen.add(line)
            if line_fails(line, raw, own, phrases):
                continue
            left += len(own)
        out.append(line)
    repeats = repeated_words(words)
    failed = n < LEAST_WORDS or 100 * repeats > REPEAT_SHARE * n
    kept = not failed and 100 * left >= KEEP_SHARE * n
    chars = len(text) - sum(map(text.count, SPACES))
    return n, chars, sum(map(text.count, SYMBOLS)), dups, repeats, failed, kept, left, "\n".join(out)


def clean(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """keep, the counts of the contract, base_failed, kept, kept_words, and cleaned_text for every row of docs."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "kept_words", "cleaned_text")

    def run(texts):
        return dict(zip(names, map(list, zip(*map(judge, texts)))))

    counts = ", ".join(f"{c} long" for c in names[:5])
    return map_texts(docs, keep, f"{counts}, base_failed boolean, kept boolean, kept_words long, cleaned_text string", run, text_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: the verdict on every document of the table; cleaned_md5 stands for the cleaned text."""
    out = clean(read(spark, sf_dir, "documents"), ["doc_id"])
    return out.withColumn("cleaned_md5", F.md5(F.col("cleaned_text").cast("binary"))).drop("cleaned_text")


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


ORACLE = rf"""
WITH d AS (SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
triples AS (SELECT doc_id, i, array_to_string(w[i : i + 2], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)),
often AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS k FROM triples) WHERE k > 1),
repeats AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM often) GROUP BY 1),
raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos FROM d WHERE text <> ''),
lines AS (SELECT doc_id, line, pos, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w, strlen(line) - strlen(regexp_replace(line, '[!-/:-@\[-`{{-~]', '', 'g')) AS marks FROM raw),
parted AS (SELECT *, len([x for x in w if list_contains([{", ".join(sorted(_text(s.decode()) for s in SEPARATORS))}], x)]) AS bare FROM lines),
told AS (
  SELECT *, len(w) > 0 AND (
    NOT ({" OR ".join(f"suffix(rtrim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)), {_text(e)})" for e in ENDS)})
    OR marks >= {PUNCTUATION_LEAST} AND 100 * marks > {PUNCTUATION_SHARE} * strlen(array_to_string(w, ''))
    OR bare >= 2
      AND 100 * bare >= {NAVIGATION_SHARE} * len(w)
    OR {" OR ".join(f"contains(lower(line), {_text(p)})" for p in BOILERPLATE)}) AS failed
  FROM parted),
judged AS (
  SELECT doc_id, count(*) FILTER (len(w) > 0) - count(DISTINCT line) FILTER (len(w) > 0) AS n_dup_lines, coalesce(sum(len(w)) FILTER (NOT failed), 0) AS kept_words,
    coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT failed), '') AS cleaned
  FROM told GROUP BY 1),
x AS (
  SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(coalesce(text, '')) - length(translate(coalesce(text, ''), '{SYMBOLS}', '')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(kept_words, 0) AS kept_words, md5(coalesce(cleaned, text)) AS cleaned_md5
  FROM d LEFT JOIN repeats ON repeats.doc_id = d.doc_id LEFT JOIN judged ON judged.doc_id = d.doc_id)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEAT_SHARE} * n_words AS base_failed,
  NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEAT_SHARE} * n_words) AND 100 * kept_words >= {KEEP_SHARE} * n_words AS kept, kept_words::BIGINT AS kept_words, cleaned_md5
FROM x
"""
