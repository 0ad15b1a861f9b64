import pytest
from pyspark.sql import functions as F

from strandmill.operators.skew import entry_counts, heavy_keys, key_profile, lookup_join
from strandmill.workspace import shared_folder

SCHEMA = "hash long, target long, pos int, rev boolean, extra string"
ROWS = [
    (1, 10, 5, True, "a"), (1, 10, 5, True, "b"), (1, 10, 5, False, None), (1, 11, 5, True, ""),
    (2, 10, 7, True, "a"), (None, 10, 7, True, "a"), (2, None, 7, True, "a"), (2, 10, None, True, "a"), (2, 10, 7, None, "a"),
]
ENTRY = ["hash", "target", "pos", "rev"]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_profile_counts_distinct_entries_without_nulls(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert rows(key_profile(df, "hash", "target", ENTRY)) == [(1, 3, 2), (2, 1, 1)]
    assert rows(key_profile(df, "target", "hash", ENTRY)) == [(10, 3, 2), (11, 1, 1)]
    assert rows(entry_counts(df, "hash", ENTRY)) == [(1, 3), (2, 1)]


def test_profile_of_empty_table(spark):
    assert rows(key_profile(spark.createDataFrame([], SCHEMA), "hash", "target", ENTRY)) == []


def test_lookup_join_with_heavy_key_equals_plain_join(spark):
    many = spark.range(3000).select(F.col("id").alias("row"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).cast("long").alias("k"))
    one = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    heavy = heavy_keys(many, "k", rows=100)
    assert heavy == [7]
    assert rows(lookup_join(many, one, "k", ["row"], heavy)) == rows(many.join(one, "k"))


def test_lookup_join_keeps_null_keys_on_left(spark):
    many = spark.createDataFrame([(1, None), (2, 5), (3, 6)], "row long, k long")
    one = spark.createDataFrame([(5, "x")], "k long, v string")
    found = {r["row"]: r["v"] for r in lookup_join(many, one, "k", ["row"], [5], "left").collect()}
    assert found == {1: None, 2: "x", 3: None}


def test_a_key_below_any_share_of_the_rows_is_heavy_by_its_size(spark):
    rows_of = spark.range(60_000).select(F.col("id").alias("row"), F.when(F.col("id") < 150, 7).otherwise(F.col("id")).cast("long").alias("k"))
    one = spark.range(60_000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    heavy = heavy_keys(rows_of, "k", rows=100)  # 150 rows are less than 1/256 of 60,000
    assert heavy == [7] and heavy.slices == {2: [7]}
    joined = lookup_join(rows_of, one, "k", ["row"], heavy)
    assert joined.count() == rows_of.join(one, "k").count() and joined.where("k = 7").count() == 150


def test_slices_grow_with_the_key(spark):
    heavy = heavy_keys(spark.range(5000).selectExpr("id % 2 AS k"), "k", rows=10)
    assert sorted(heavy) == [0, 1] and list(heavy.slices) == [256]
    assert heavy_keys(spark.range(0).selectExpr("id AS k"), "k") == []


def test_intermediate_tables_need_a_shared_folder_on_a_cluster():
    class Conf:
        def get(self, name, default):
            return None

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="checkpoint"):
        shared_folder(Session())
