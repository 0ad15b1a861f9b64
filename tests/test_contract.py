import os

import pytest

import __spark_entry__ as contract

FOLDER = "/root/testdata/sf0.001"


def test_names_match():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.skipif(not os.path.exists(FOLDER), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", ["p2_found", "p2_target_profile", "band_stats", "best_mate_sketch", "curve_summary", "nonredundant_ids", "minimizers", "model_points_clean", "gamma_cdf"])
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for file in os.listdir(FOLDER):
        connection.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{FOLDER}/{file}'")
    found = contract.queries()[name](spark, FOLDER)
    cursor = connection.execute(contract.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(found.columns) == sorted(columns)
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in found.collect()))) == sorted(map(repr, cursor.fetchall()))


@pytest.mark.skipif(not os.path.exists(FOLDER), reason="the driver's tables are not here")
def test_entry(spark):
    assert contract.entry(spark).count() > 0
