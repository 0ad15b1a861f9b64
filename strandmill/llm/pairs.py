"""Pairs between representatives of exact copies, and their expansion to all records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.operators.skew import SLICE, heavy_keys, lookup_join, sliced, spread


def copy_classes(records: DataFrame, record: str, *content: str) -> DataFrame:
    """``record, copy_of``: the smallest record with the same ``content``.

    Contents are compared by two independent 64-bit fingerprints.
    """
    prints = records.select(record, F.concat_ws(":", F.xxhash64(F.lit(1), *content).cast("string"), F.xxhash64(F.lit(2), *content).cast("string")).alias("print"))
    return copy_classes_of(prints, record, "print")


def copy_classes_of(prints: DataFrame, record: str, mark: str) -> DataFrame:
    """``record, copy_of``: the smallest record with the same fingerprint ``mark``.

    A class that holds a third of all rows is folded by partial minima and read
    back by a join that slices heavy classes.
    """
    classes = prints.groupBy(mark).agg(F.min(record).alias("copy_of"))
    return lookup_join(prints.select(record, mark), classes, mark, [record]).select(record, "copy_of")


def expanded_pairs(links: DataFrame, classes: DataFrame, record: str, heavy_rows: int | None = None) -> DataFrame:
    """``a, b`` (a < b): every pair of records that ``links`` between representatives stand for.

    ``links`` has columns ``a, b``; records of one class are pairs as well. The
    members of a large class are cut into slices on one side of each join, and
    the other side is repeated for them, so the pairs of a class come from
    many tasks.
    """
    members = classes.where(f"{record} <> copy_of")
    if members.isEmpty():
        return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    repeated = members.select("copy_of").distinct()
    several = classes.join(repeated, "copy_of", "left_semi")
    heavy = heavy_keys(several, "copy_of", *([] if heavy_rows is None else [heavy_rows]))
    pieces = sliced(several.select(F.col("copy_of").alias("a"), F.col(record).alias("x")), "a", heavy, ["x"])
    across = links.select(F.col("a"), F.col("b"))
    for side, other, name in (("a", "b", "x"), ("b", "x", "y")):
        own = pieces.select(F.col("a").alias(side), F.col("x").alias(name), SLICE)
        # a representative without copies stands for itself
        joined = spread(across, side, heavy).join(own, [side, SLICE], "left")
        across = joined.select(F.coalesce(name, side).alias(name), other)
    whole = spread(several.select(F.col("copy_of").alias("a"), F.col(record).alias("y")), "a", heavy)
    within = pieces.join(whole, ["a", SLICE]).where("x < y").select("x", "y")
    return across.unionByName(within).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def cross_pairs(links: DataFrame, members: DataFrame, heavy_rows: int | None = None) -> DataFrame:
    """``a, b``: every record of side 1 and of side 2 whose classes are one or linked.

    ``links`` has classes ``a, b``; ``members`` has ``copy_of, number, side``.
    Large classes are cut into slices as in :func:`expanded_pairs`.
    """
    limits = [] if heavy_rows is None else [heavy_rows]
    same = members.select(F.col("copy_of").alias("a"), F.col("copy_of").alias("b")).distinct()
    across = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(same)
    for side, other, name, number in (("a", "b", "x", 1), ("b", "x", "y", 2)):
        own = members.where(F.col("side") == number).select(F.col("copy_of").alias(side), F.col("number").alias(name))
        heavy = heavy_keys(own, side, *limits)
        across = spread(across, side, heavy).join(sliced(own, side, heavy, [name]), [side, SLICE]).select(name, other)
    return across.select(F.col("x").alias("a"), F.col("y").alias("b"))
