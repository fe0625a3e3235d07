"""Every registered graph query against its SQL."""

import os

import pytest
from pyspark.sql import functions as F

from graphloom import queries
from oracle import FOLDER, assert_same, connection


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, name):
    if name in queries.ORACLE:
        assert_same(spark, queries.QUERIES[name], queries.ORACLE[name], con)
    else:
        assert queries.QUERIES[name](spark, FOLDER).count() >= 0


def test_flagship(spark):
    assert 0 < queries.flagship(spark, FOLDER).count() <= 20


def test_entry_has_an_oracle_only_for_its_queries():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


#: what searches a path
SEARCHES = ("bfs_distance", "bfs_upstream", "hop_histogram", "distance_matrix", "shortest_path_nodes", "pathway_edges", "pathway_layers", "filter_pathways", "sort_distance")


@pytest.fixture(scope="module")
def chain(tmp_path_factory):
    """The small tables with a graph that is a ring of 40 parts, so that distances pass every bound of the SQL."""
    at = tmp_path_factory.mktemp("chain")
    for f in os.listdir(FOLDER):
        if f not in ("lineitem.parquet", "part.parquet"):
            os.symlink(f"{FOLDER}/{f}", at / f)
    con = connection()
    con.execute(f"COPY (SELECT * FROM part WHERE p_partkey < 40) TO '{at}/part.parquet'")
    lines = "SELECT * REPLACE (CAST(i AS INTEGER) AS l_linenumber, i % 40 AS l_partkey, 50.0::DOUBLE AS l_quantity) FROM (SELECT * FROM lineitem LIMIT 1), range(41) t(i)"
    con.execute(f"COPY ({lines}) TO '{at}/lineitem.parquet'")
    return str(at)


@pytest.mark.parametrize("name", SEARCHES)
def test_searches_end_where_their_sql_does(spark, chain, name):
    query, sql = queries.QUERIES[name], queries.ORACLE[name]
    if name == "sort_distance":
        # pandas has whole numbers beside nulls as doubles
        query, sql = lambda *at: queries.QUERIES[name](*at).withColumn("sort_value", F.col("sort_value").cast("double")), f"SELECT root_id, CAST(sort_value AS DOUBLE) AS sort_value, rank FROM ({sql})"
    assert_same(spark, query, sql, connection(chain), chain)
