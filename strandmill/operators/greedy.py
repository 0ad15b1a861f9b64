"""The non-redundant subset: reads are kept in order unless their mate was kept before them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.workspace import Workspace

#: A chain of mates of length n is resolved after log2(n) rounds.
MAX_ROUNDS = 64


def kept_reads(mates: DataFrame) -> DataFrame:
    """``read_idx, keep`` for reads with at most one mate each (read_idx, mate).

    A read whose mate is missing or comes later is kept; any other is kept
    exactly if its mate is not. So along the chain of earlier mates every second
    read is kept, and the parity of the chain is found by doubling: each round
    every read jumps as far as its target has jumped. A mate that is no read of
    the table counts as missing.
    """
    work = Workspace(mates.sparkSession, "kept")
    known = mates.select(F.col("read_idx").alias("mate"), F.lit(True).alias("known"))
    start = mates.select("read_idx", F.when(F.col("mate") < F.col("read_idx"), F.col("mate")).alias("mate")).join(known, "mate", "left")
    state = start.select("read_idx", F.when(F.col("known"), F.col("mate")).alias("jump"), F.when(F.col("known"), 1).otherwise(0).alias("odd"))
    state = work.keep(state, "round0")
    for number in range(1, MAX_ROUNDS):
        moving = state.where("jump IS NOT NULL")
        if moving.isEmpty():
            break
        ahead = state.select(F.col("read_idx").alias("jump"), F.col("jump").alias("next"), F.col("odd").alias("more"))
        moved = moving.join(ahead, "jump").select("read_idx", F.col("next").alias("jump"), (F.col("odd") + F.col("more")).bitwiseAND(F.lit(1)).alias("odd"))
        state = work.keep(state.where("jump IS NULL").unionByName(moved), f"round{number}")
        if number > 1:
            work.forget(f"round{number - 2}")
    return state.select("read_idx", (F.col("odd") == 0).alias("keep"))
