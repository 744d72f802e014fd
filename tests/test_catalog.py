"""Each registered query against its DuckDB SQL on the smallest tables."""

import os

import duckdb
import pytest

from weftline.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(repr(round(r[i], 9) + 0.0 if isinstance(r[i], float) else r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, tables, name):
    df = catalog.QUERIES[name](spark, SF)
    got = plain([tuple(r) for r in df.collect()], df.columns)
    found = tables.execute(catalog.ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == plain(found.fetchall(), columns)


def test_k_means_queries(spark):
    centres = catalog.QUERIES["H4_class_centroids"](spark, SF)
    assert centres.groupBy("cls").agg({"k": "max"}).count() == centres.select("cls").distinct().count()
    nearest = catalog.QUERIES["H7_nearest_centroid"](spark, SF)
    assert nearest.where("predicted is null or distance < 0").isEmpty() and nearest.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
