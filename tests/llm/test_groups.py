import random

import pytest

from strandmill.llm.groups import linked_groups


def brute(pairs):
    parent = {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is None or b is None or a == b:
            continue
        parent.setdefault(a, a)
        parent.setdefault(b, b)
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {v: find(v) for v in parent}


def groups(spark, pairs, **options):
    df = spark.createDataFrame([(a, b, "x") for a, b in pairs], "a long, b long, vertex string")
    rows = linked_groups(df, "a", "b", **options).collect()
    assert len({r["vertex"] for r in rows}) == len(rows)
    return {r["vertex"]: r["group"] for r in rows}


def test_long_chain(spark):
    order = list(range(400))
    random.Random(3).shuffle(order)
    pairs = list(zip(order, order[1:]))
    assert groups(spark, pairs) == {v: 0 for v in order}


def test_star_with_heavy_centre_and_random_links(spark):
    rng = random.Random(5)
    pairs = [(5000, x) for x in range(1, 300)] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(230)]
    assert groups(spark, pairs, heavy_rows=50) == brute(pairs)


@pytest.mark.parametrize("pairs", [[], [(1, 1), (None, 2), (3, None)], [(2, 1), (1, 2), (2, 1), (-5, 2), (9, 9)]])
def test_nulls_self_links_and_repeats(spark, pairs):
    assert groups(spark, pairs) == brute(pairs)
