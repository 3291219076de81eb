"""Every registered query of the library's own operators against its SQL in DuckDB."""

import math

import duckdb
import pytest

from siltstone import catalog
from siltstone.queries import load

from .conftest import SF

load()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    return round(value, 6) if isinstance(value, float) else str(value)


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted([tuple(plain(r[i]) for i in order) for r in data], key=repr)


def test_whole_tables_are_asked(spark):
    """Every query vector and every document, not one vector or the fixed benchmark."""
    embeddings, documents = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("embeddings", "documents"))
    asked = {r.vec_id for r in embeddings.where("vec_id % 100 = 0").collect()}
    for name in ("r05_dense_all", "hybrid_search_all"):
        assert {r.query_id for r in catalog.QUERIES[name](spark, SF).select("query_id").distinct().collect()} == asked and len(asked) > 1
    for name in ("x14_bigram_overlap_documents", "x33_trigram_similarity_documents"):
        assert catalog.QUERIES[name](spark, SF).count() == documents.count()


def test_every_conversation_is_pooled(spark):
    """Not one conversation of ten."""
    found = {r.conv_id for r in catalog.QUERIES["r13_pooled"](spark, SF).select("conv_id").distinct().collect()}
    assert found == {r.conv_id for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id").distinct().collect()}


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    cursor = duck.execute(catalog.SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, cursor.fetchall())
