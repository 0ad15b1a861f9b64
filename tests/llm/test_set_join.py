import random

import pytest

from strandmill.llm.pairs import cross_pairs, expanded_pairs
from strandmill.llm.set_join import similar_set_pairs, similar_sets, similar_sets_between


def brute(rows, similarity=0.5, least=8):
    sets = {}
    for record, value in rows:
        if record is not None and value is not None:
            sets.setdefault(record, set()).add(value)
    keys = sorted(k for k, s in sets.items() if len(s) >= least)
    return {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])}


def pairs(spark, rows, **options):
    df = spark.createDataFrame([(r, v, 1, "x") for r, v in rows], "rec long, val long, size int, record string")
    found = [(r["a"], r["b"]) for r in similar_set_pairs(df, "rec", "val", **options).collect()]
    assert len(set(found)) == len(found)
    return set(found)


def random_rows(seed, records=160, hot=6):
    rng = random.Random(seed)
    rows, previous = [], []
    for record in range(records):
        if previous and rng.random() < 0.6:
            base = set(rng.choice(previous))
            for _ in range(rng.randrange(0, len(base) // 2 + 2)):
                if rng.random() < 0.5 and len(base) > 1:
                    base.discard(rng.choice(sorted(base)))
                else:
                    base.add(rng.getrandbits(62))
        else:
            base = {rng.getrandbits(62) for _ in range(rng.randrange(1, 60))}
        base |= {h for h in range(hot) if rng.random() < 0.4}
        previous.append(base)
        rows += [(record, v) for v in base] + [(record, next(iter(base)))]
    return rows


@pytest.mark.parametrize("seed,similarity,frequent", [(1, 0.5, 200), (2, 0.5, 20), (3, 0.8, 200)])
def test_equals_brute_force(spark, seed, similarity, frequent):
    rows = random_rows(seed)
    expected = brute(rows, similarity)
    assert len(expected) > 20
    assert pairs(spark, rows, similarity=similarity, frequent_from=frequent) == expected


def test_sets_of_frequent_values_only(spark):
    rng = random.Random(9)
    rows = [(r, v) for r in range(40) for v in rng.sample(range(20), rng.randrange(8, 14))]
    assert pairs(spark, rows, frequent_from=5) == brute(rows)


def test_nulls_small_sets_copies_and_empty_table(spark):
    rows = [(r, v) for r in (1, 2, 3) for v in range(8)] + [(4, v) for v in range(7)] + [(None, 1), (5, None), (1, None)]
    assert pairs(spark, rows) == {(1, 2), (1, 3), (2, 3)}
    assert pairs(spark, []) == set()
    df = spark.createDataFrame(rows, "rec long, val long")
    links, classes = similar_sets(df, "rec", "val")
    assert links.count() == 0
    assert {tuple(r) for r in classes.collect()} == {(1, 1), (2, 1), (3, 1)}


@pytest.mark.parametrize("seed,frequent", [(4, 200), (5, 20)])
def test_two_tables_equal_brute_force(spark, seed, frequent):
    rows = random_rows(seed, 140)
    left, right = [r for r in rows if r[0] % 3], [(r[0] % 50, r[1]) for r in rows if r[0] % 3 == 0]
    sets = [{}, {}]
    for side, of in zip(sets, (left, right)):
        for record, value in of:
            side.setdefault(record, set()).add(value)
    expected = {(a, b) for a, s in sets[0].items() for b, t in sets[1].items() if min(len(s), len(t)) >= 8 and len(s & t) >= 0.5 * len(s | t)}
    assert len(expected) > 10
    tables = [spark.createDataFrame([(r, v, "x") for r, v in of], "rec long, val long, side string") for of in (left, right)]
    found = [(r["a"], r["b"]) for r in similar_sets_between(*tables, "rec", "val", frequent_from=frequent).collect()]
    assert len(found) == len(set(found)) and set(found) == expected
    assert similar_sets_between(tables[0], tables[1].limit(0), "rec", "val").count() == 0


def test_large_classes_are_sliced(spark):
    classes = spark.createDataFrame([(r, r % 3) for r in range(60)] + [(100, 100)], "record long, copy_of long")
    links = spark.createDataFrame([(0, 1), (2, 100)], "a long, b long")
    of = {r: r % 3 for r in range(60)} | {100: 100}
    linked = {(0, 1), (2, 100)}
    expected = {(x, y) for x in of for y in of if x < y and (of[x] == of[y] or tuple(sorted((of[x], of[y]))) in linked)}
    for rows in (None, 5):
        found = [tuple(r) for r in expanded_pairs(links, classes, "record", rows).collect()]
        assert len(found) == len(set(found)) and set(found) == expected
    members = classes.selectExpr("copy_of", "record AS number", "1 + CAST(record % 2 AS INT) AS side")
    cross = {(x, y) for x in of for y in of if x % 2 == 0 and y % 2 == 1 and (of[x] == of[y] or tuple(sorted((of[x], of[y]))) in linked)}
    assert {tuple(r) for r in cross_pairs(links, members, 5).collect()} == cross
