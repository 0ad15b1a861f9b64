"""A reproducible sample that only grows when records are added.

A Feistel network permutes the fixed domain of identifiers [0, 2**62). A record
is chosen if its permuted identifier lies under rate * 2**62. The choice
depends on nothing but the identifier, the rate and the seed: not on other
records, on the order or on partitions. The permutation is one to one, so two
identifiers never share a place, and samples of smaller rates lie within those
of larger ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HALF_BITS = 31
DOMAIN = 2 ** (2 * HALF_BITS)
_MASK = 2**HALF_BITS - 1
ROUNDS = 6


def round_keys(seed: int, rounds: int = ROUNDS) -> list[tuple[int, int]]:
    """An odd factor under 2**30 and an offset under 2**31 for each round."""
    keys, state = [], (seed * 2 + 1) % 2**64
    for _ in range(rounds):
        state = (state * 6364136223846793005 + 1442695040888963407) % 2**64
        factor = (state >> 34) | 1
        state = (state * 6364136223846793005 + 1442695040888963407) % 2**64
        keys.append((factor, state >> 33))
    return keys


def with_place(records: DataFrame, identifier: str, seed: int = 0, rounds: int = ROUNDS, name: str = "place") -> DataFrame:
    """``records`` with the place of a bigint identifier in the permuted domain.

    The place is null outside [0, 2**62) and for null. The round function
    squares and scales 31-bit halves, so nothing exceeds a bigint. The rounds
    are folded over an array of constants: written out, the expression would
    triple with every round.
    """
    number = F.col(identifier)
    keys = F.array(*[F.struct(F.lit(factor).cast("long").alias("factor"), F.lit(offset).cast("long").alias("offset")) for factor, offset in round_keys(seed, rounds)])
    halves = F.struct(F.shiftright(number, HALF_BITS).alias("left"), number.bitwiseAND(F.lit(_MASK)).alias("right"))

    def one_round(at: Column, key: Column) -> Column:
        right = at["right"]
        scrambled = F.shiftright(right * right + right * key["factor"] + key["offset"], 13).bitwiseAND(F.lit(_MASK))
        return F.struct(right.alias("left"), at["left"].bitwiseXOR(scrambled).alias("right"))

    place = F.aggregate(keys, halves, one_round, lambda at: F.shiftleft(at["left"], HALF_BITS).bitwiseOR(at["right"]))
    return records.withColumn(name, F.when(number.between(0, DOMAIN - 1), place))


def threshold(rate: Column) -> Column:
    """Places under this are chosen at ``rate``: 0 and less choose none, 1 and more all, null and NaN none."""
    usable = F.when(F.isnan(rate), F.lit(0.0)).otherwise(F.least(F.greatest(F.coalesce(rate, F.lit(0.0)), F.lit(0.0)), F.lit(1.0)))
    return F.floor(usable * F.lit(float(DOMAIN))).cast("long")


def stable_sample(records: DataFrame, identifier: str, rate: float, seed: int = 0) -> DataFrame:
    """The rows of ``records`` whose identifier is chosen at ``rate``.

    ``identifier`` is a bigint column of numbers in [0, 2**62); rows with a null
    identifier or one outside are never chosen. Repeats of an identifier are
    chosen together. An empty table gives an empty sample.
    """
    placed = with_place(records, identifier, seed, name="__place")
    return placed.where(F.col("__place") < threshold(F.lit(float(rate)))).drop("__place")


def sql_place(identifier: str, table: str, seed: int = 0, rounds: int = ROUNDS) -> str:
    """The same permutation as a SQL query with columns ``identifier, place``."""
    query = f"SELECT DISTINCT {identifier} AS n, {identifier} >> {HALF_BITS} AS l, {identifier} & {_MASK} AS r FROM {table} WHERE {identifier} BETWEEN 0 AND {DOMAIN - 1}"
    for factor, offset in round_keys(seed, rounds):
        query = f"SELECT n, r AS l, xor(l, ((r * r + r * {factor} + {offset}) >> 13) & {_MASK}) AS r FROM ({query})"
    return f"SELECT n AS {identifier}, (l << {HALF_BITS}) | r AS place FROM ({query})"
