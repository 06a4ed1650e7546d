"""The queries that SQL can state, against DuckDB on the smallest table."""

import os

import duckdb
import pytest

from loomgraph.llm import queries

DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DIR), reason="test tables are not here")
@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, DIR)
    tidy = lambda x: float(f"{x:.9g}") if isinstance(x, float) else x
    got = sorted(repr([tidy(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DIR}/documents.parquet'")
    rel = con.sql(queries.ORACLE_SQL[name])
    at = [rel.columns.index(c) for c in sorted(df.columns)]
    assert sorted(rel.columns) == sorted(df.columns)
    assert got == sorted(repr([tidy(r[i]) for i in at]) for r in rel.fetchall())


@pytest.mark.skipif(not os.path.isdir(DIR), reason="test tables are not here")
def test_pages_of_awkward_rows_in_sql(spark):
    """Line rules on lines that end, repeat and separate in odd ways."""
    from loomgraph.llm import linefirst

    texts = [None, "", "\n\n", "a | b | c.\nplain text\nplain text\n", "x" * 10 + ".\n" * 3, "!!!!!! a.\nOne, two.", " - - a b.\n", "read more here.\nok.", "tail  \t\nfine. \t", "é ü.\né ü."]
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    want = {r[0]: r[1:] for r in con.sql(f"SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, kept_words, cleaned_md5 FROM ({linefirst.ORACLE})").fetchall()}
    import hashlib

    for i, t in enumerate(texts):
        *got, cleaned = linefirst.judge(t)
        assert (*got, None if cleaned is None else hashlib.md5(cleaned.encode()).hexdigest()) == want[i], t
