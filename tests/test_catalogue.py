"""Every catalogue query against its SQL in DuckDB, over whole tables."""

import duckdb
import pytest

from tidemark.plans import catalogue

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def rows_of(rows, columns, order):
    picked = [tuple(dict(zip(columns, r))[c] for c in order) for r in rows]
    return sorted(picked, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DIR)
    order = sorted(df.columns)
    found = duck.execute(catalogue.ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == order
    assert rows_of([tuple(r) for r in df.collect()], df.columns, order) == rows_of(found.fetchall(), columns, order)


def test_packed_chunks_hold_all_words(spark):
    """The one query without SQL; how chunks fall is tested beside the packer."""
    from tidemark.plans import views
    from tidemark.sources import files

    found = catalogue.QUERIES["packed_chunks"](spark, DIR)
    assert found.columns == ["source_uri", "ordinal", "text_hash"] and set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL) == {"packed_chunks"}
    docs = views.read(spark, DIR, "documents").selectExpr("concat('md/', doc_id) AS source_uri", "'markdown' AS source_type", "cast(null AS date) AS as_of", "text AS raw_text")
    packed = {}
    for r in files.pack(files.segments(docs)).orderBy("source_uri", "ordinal").collect():
        packed[r["source_uri"]] = packed.get(r["source_uri"], []) + r["text"].split()
    assert packed == {r["source_uri"]: r["raw_text"].split() for r in docs.collect() if r["raw_text"].split()}


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
