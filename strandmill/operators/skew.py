"""Joins and per-key results that a few heavy keys cannot hold up."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is heavy from so many rows on: as many as one task should get of a single key.
HEAVY_ROWS = 50_000
#: Fewest heavy keys that are told apart; beyond it as many as there are shuffle partitions.
FEWEST_KEYS = 256
#: Slices of a heavy key whose size is not known.
SLICES = 64

SLICE = "__slice"


class HeavyKeys(list):
    """Heavy keys, the largest first, and into how many slices (a power of two) each is cut."""

    def __init__(self, sizes: Sequence[tuple], rows: int, most: int):
        super().__init__(key for key, _ in sizes)
        self.slices: dict[int, list] = {}
        for key, size in sizes:
            number = 1 << max(1, min(math.ceil(math.log2(size / rows)), math.ceil(math.log2(2 * most))))
            self.slices.setdefault(number, []).append(key)


def most_heavy(spark: SparkSession) -> int:
    """How many heavy keys are told apart: a key beyond them is smaller than the mean shuffle partition."""
    return max(FEWEST_KEYS, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def heavy_counts(counts: DataFrame, key: str, count: str, rows: int = HEAVY_ROWS) -> HeavyKeys:
    """Heavy keys of a table that has the number of rows of each key; see :func:`heavy_keys`."""
    most = most_heavy(counts.sparkSession)
    large = counts.where((F.col(count) >= rows) & F.col(key).isNotNull()).orderBy(F.desc(count)).limit(most).select(key, count).collect()
    return HeavyKeys([tuple(r) for r in large], rows, most)


def heavy_keys(df: DataFrame, key: str, rows: int = HEAVY_ROWS) -> HeavyKeys:
    """Values of ``key`` that own ``rows`` rows or more, whatever their share of the table.

    The counts are partial aggregates, so only one row a key and partition
    moves. Of the heavy keys the largest come to the driver, as many as there
    are shuffle partitions (256 at least): any other owns less than a
    partition's fair share. Nulls are never heavy; an empty table has no heavy key.
    """
    return heavy_counts(df.groupBy(key).agg(F.count(F.lit(1)).alias("__n")), key, "__n", rows)


def slices_of(heavy: Sequence, otherwise: int = SLICES) -> dict[int, list]:
    """The heavy keys by their number of slices."""
    if isinstance(heavy, HeavyKeys):
        return heavy.slices
    return {otherwise: list(heavy)} if heavy else {}


def by_slices(key: str, heavy: Sequence, then: Callable[[int], Column], otherwise: Column) -> Column:
    column = otherwise
    for number, keys in slices_of(heavy).items():
        column = F.when(F.col(key).isin(keys), then(number)).otherwise(column)
    return column


def sliced(df: DataFrame, key: str, heavy: Sequence, by: Sequence[str]) -> DataFrame:
    """Give the rows of heavy keys a slice number from the values of ``by``; all others get slice 0."""
    place = F.xxhash64(*by)
    return df.withColumn(SLICE, by_slices(key, heavy, lambda n: F.pmod(place, F.lit(n)).cast("int"), F.lit(0)))


def spread(df: DataFrame, key: str, heavy: Sequence) -> DataFrame:
    """The counterpart of :func:`sliced`: a row of a heavy key is repeated once for each slice."""
    numbers = by_slices(key, heavy, lambda n: F.sequence(F.lit(0), F.lit(n - 1)), F.array(F.lit(0)))
    return df.withColumn(SLICE, F.explode(numbers))


def lookup_join(many: DataFrame, one: DataFrame, key: str, by: Sequence[str], heavy: Sequence | None = None, how: str = "inner") -> DataFrame:
    """Join ``many`` to ``one``, which has one row a key, without a straggler for heavy keys.

    ``by`` names columns of ``many`` that spread the rows of one key. Rows with
    a null key find no partner (``how="left"`` keeps them). Both sides must
    share no column but ``key``.
    """
    if heavy is None:
        heavy = heavy_keys(many, key)
    if not heavy:
        return many.join(one, key, how)
    joined = sliced(many, key, heavy, by).join(spread(one, key, heavy), [key, SLICE], how)
    return joined.drop(SLICE)


def distinct_entries(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct rows over ``columns`` that have no null in any of them.

    Each partition first folds its own repeats in a bounded hash table (which
    spills to sorted runs); the exchange is by all columns, so no key gathers
    in one task.
    """
    return df.select(*columns).na.drop("any").distinct()


def entry_counts(df: DataFrame, key: str, entry: Sequence[str]) -> DataFrame:
    """``key, entries``: the number of distinct ``entry`` rows of every key.

    Rows with a null in the key or in the entry count for nothing, repeats
    count once, an empty table gives no row. After :func:`distinct_entries`
    the counts are partial sums; only one row a key and partition moves.
    """
    rest = [c for c in entry if c != key]
    return distinct_entries(df, [key, *rest]).groupBy(key).agg(F.count(F.lit(1)).alias("entries"))


def key_profile(df: DataFrame, key: str, partner: str, entry: Sequence[str]) -> DataFrame:
    """``key, entries, partners``: distinct entries and distinct partners of every key.

    Three algebraic steps, each with map-side combining: distinct entries
    (exchanged by all their columns), their number for each (key, partner),
    then the sums for each key. A key that owns a third of the rows arrives in
    the last step as one row for each partition. Nulls and repeats as in
    :func:`entry_counts`.
    """
    rest = [c for c in entry if c not in (key, partner)]
    pairs = distinct_entries(df, [key, partner, *rest]).groupBy(key, partner).agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy(key).agg(F.sum("n").alias("entries"), F.count(F.lit(1)).alias("partners"))
