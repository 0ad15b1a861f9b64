import pytest
from pyspark.sql import functions as F

from strandmill.llm.stable_sample import DOMAIN, round_keys, stable_sample, threshold, with_place


def plain(n, seed=0):
    left, right = n >> 31, n & (2**31 - 1)
    for factor, offset in round_keys(seed):
        left, right = right, left ^ (((right * right + right * factor + offset) >> 13) & (2**31 - 1))
    return (left << 31) | right


def unpermuted(place, seed=0):
    left, right = place >> 31, place & (2**31 - 1)
    for factor, offset in reversed(round_keys(seed)):
        left, right = right ^ (((left * left + left * factor + offset) >> 13) & (2**31 - 1)), left
    return (left << 31) | right


def test_is_a_permutation(spark):
    numbers = [0, 1, 2, 2**31 - 1, 2**31, DOMAIN - 1, 123456789012345]
    df = spark.createDataFrame([(n,) for n in numbers], "n long")
    for row in with_place(df, "n", 5).collect():
        assert row["place"] == plain(row["n"], 5)
        assert 0 <= row["place"] < DOMAIN and unpermuted(row["place"], 5) == row["n"]


@pytest.mark.parametrize("rate", [0.01, 0.1, 0.5])
def test_sizes_and_nesting(spark, rate):
    ids = spark.range(40000).withColumn("place", F.lit(1))
    small = {r["id"] for r in stable_sample(ids, "id", rate).collect()}
    large = {r["id"] for r in stable_sample(ids.repartition(5, "id"), "id", rate * 1.5).collect()}
    assert small <= large
    assert abs(len(small) - 40000 * rate) < 5 * (40000 * rate * (1 - rate)) ** 0.5


def test_stable_under_growth_and_layout(spark):
    before = {r["id"] for r in stable_sample(spark.range(5000), "id", 0.2, 3).collect()}
    after = {r["id"] for r in stable_sample(spark.range(20000).repartition(7), "id", 0.2, 3).collect()}
    assert before == {i for i in after if i < 5000}


def test_unusable_identifiers_and_rates(spark):
    df = spark.createDataFrame([(None,), (-1,), (DOMAIN,), (5,), (5,)], "n long")
    assert [r["n"] for r in stable_sample(df, "n", 1.0).collect()] == [5, 5]
    assert stable_sample(df, "n", 0.0).count() == 0
    assert stable_sample(df.limit(0), "n", 1.0).count() == 0
    rates = spark.createDataFrame([(None,), (float("nan"),), (-1.0,), (2.0,), (0.5,)], "p double")
    assert [r[0] for r in rates.select(threshold(F.col("p"))).collect()] == [0, 0, 0, DOMAIN, DOMAIN // 2]
