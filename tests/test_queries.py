"""Every query with SQL against DuckDB on the smallest tables; every other query runs."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


from docsieve.plans import catalogue  # noqa: E402


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name not in catalogue.ORACLE:
        return
    rel = duck.sql(catalogue.ORACLE[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)


def test_long_documents_are_chunked_as_the_sql(spark, tmp_path):
    """A document of 50,000 characters or more has the chunk size of the others."""
    text = " ".join(f"Sentence {i} has {'some ' * (i % 17)}words." for i in range(1500))
    assert len(text) > 50000
    con = duckdb.connect()
    rows = "SELECT 1::BIGINT AS doc_id, ? AS text, 'en' AS lang, 's' AS source, length(text)::BIGINT AS n_chars"
    con.execute(f"CREATE TABLE documents AS {rows}", [text])
    con.execute(f"COPY documents TO '{tmp_path}/documents.parquet' (FORMAT parquet)")
    got = [tuple(r) for r in catalogue.QUERIES["chunk_sentences"](spark, str(tmp_path)).orderBy("chunk_index").collect()]
    assert got == con.execute(catalogue.ORACLE["chunk_sentences"] + " ORDER BY chunk_index").fetchall()


def test_entry(spark):
    assert entry.entry(spark).columns == ["id", "document_id", "similarity", "combined_score"]
    assert set(catalogue.ORACLE) <= set(entry.queries())
