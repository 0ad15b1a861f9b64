"""All pairs of similar sets by pigeonhole partitioning of the value universe.

The universe is cut into segments by a hash; how many depends on the set's
length. Two sets of Jaccard similarity t or more differ in at most
``H = floor((1-t)/(1+t) * (|r|+|s|))`` values. Take the larger set r. A segment
in which r holds one value can only be spoilt by removing it (1 difference),
one in which r holds more only by 2 differences, if equal segments and
segments that are equal after one deletion count as a match. So whenever
``sum(min(|r_i|, 2)) > H`` over r's segments, one of them matches s, and it is
enough to look r up by segments that together cost H + 1.

Frequent values carry no information and would gather many sets under one
signature; they are left out of the universe, which lowers no bound. A set that
no longer reaches H + 1 without them is looked up by its H + 1 rarest values
instead: a set that misses all of them differs too much.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.llm.pairs import copy_classes, cross_pairs, expanded_pairs
from strandmill.operators.skew import HEAVY_ROWS, SLICE, heavy_counts, sliced, spread
from strandmill.workspace import Workspace

#: Mean number of values in a segment of the longest sets of a length class.
LOAD = 1.5
#: Number of sets from which on a value counts as frequent, and most values treated so; both only steer the work.
FREQUENT, MOST_FREQUENT = 200, 10_000

SIGNATURE_SCHEMA = "signature long, record long, size int, probe boolean, deleted boolean"


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Bounds:
    """Lengths, thresholds and segment numbers for a similarity."""

    def __init__(self, similarity: float, least: int, load: float = LOAD):
        self.similarity, self.least, self.load = similarity, least, load

    def most_differences(self, size):
        """Largest difference of a set of ``size`` and a smaller similar one."""
        return np.floor(2 * (1 - self.similarity) / (1 + self.similarity) * size + 1e-9).astype(np.int64)

    def length_class(self, size):
        """Sets that may be similar are of one class or of neighbouring ones."""
        return np.floor(np.log(size / self.least) / -math.log(self.similarity) + 1e-9).astype(np.int64)

    def segments(self, length_class):
        """Number of segments for the longest sets of a class."""
        return np.ceil(self.least * (1 / self.similarity) ** (length_class + 1.0) / self.load).astype(np.uint64)


def flat_lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and concatenated values of a list column without nulls."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return lengths, column.flatten().to_numpy(zero_copy_only=False)


def in_sorted(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return table[at] == values


class Segmented:
    """The segments of many sets under the segmentation of ``length_class + ahead``."""

    def __init__(self, owner: np.ndarray, values: np.ndarray, sizes: np.ndarray, bounds: Bounds, ahead: int):
        classes = bounds.length_class(sizes) + ahead
        x = values.view(np.uint64)
        segment = ((mixed(x) >> np.uint64(32)) * bounds.segments(classes)[owner]) >> np.uint64(32)
        order = np.lexsort((segment, owner))
        self.owner, segment = owner[order], segment[order]
        self.weight = mixed(x[order] + np.uint64(0x632BE59BD9B4E019))
        new = np.ones(len(order), bool)
        new[1:] = (self.owner[1:] != self.owner[:-1]) | (segment[1:] != segment[:-1])
        self.start = np.flatnonzero(new)
        self.group = np.cumsum(new) - 1
        self.count = np.diff(np.append(self.start, len(order)))
        self.group_owner = self.owner[self.start]
        self.place = mixed((classes[self.group_owner].astype(np.uint64) << np.uint64(40)) + segment[self.start])
        self.total = np.add.reduceat(self.weight, self.start) if len(order) else self.weight
        self.cost = np.minimum(self.count, 2)

    def spent_before(self, sets: int) -> tuple[np.ndarray, np.ndarray]:
        """For each segment the cost of its set's earlier ones; for each set the whole cost."""
        whole = np.bincount(self.group_owner, self.cost, sets).astype(np.int64)
        running = np.cumsum(self.cost) - self.cost
        base = np.concatenate(([0], np.cumsum(whole)[:-1]))
        return running - base[self.group_owner], whole


def signature_batches(batches: Iterator[pa.RecordBatch], frequent: np.ndarray, bounds: Bounds) -> Iterator[pa.RecordBatch]:
    """Signatures of (record, members) rows: own class as probe and index, next class as index."""
    for batch in batches:
        record = batch.column("record").to_numpy(zero_copy_only=False)
        sizes, values = flat_lists(batch.column("members"))
        owner = np.repeat(np.arange(len(sizes)), sizes)
        plain = ~in_sorted(values, frequent)
        owner, values = owner[plain], values[plain]
        if not len(values):
            continue
        for ahead in (0, 1):
            cut = Segmented(owner, values, sizes, bounds, ahead)
            probe = np.zeros(len(cut.start), bool)
            if not ahead:
                before, whole = cut.spent_before(len(sizes))
                most = bounds.most_differences(sizes)
                probe = (before <= most[cut.group_owner]) & (whole > most)[cut.group_owner]
            several = cut.count[cut.group] >= 2
            group = cut.group[several]
            whole_segments = mixed(cut.total ^ cut.place)
            less_one = mixed((cut.total[group] - cut.weight[several]) ^ cut.place[group])
            who = np.concatenate((cut.group_owner, cut.owner[several]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate((whole_segments, less_one)).view(np.int64)),
                    pa.array(record[who]),
                    pa.array(sizes[who].astype(np.int32)),
                    pa.array(np.concatenate((probe, probe[group]))),
                    pa.array(np.concatenate((np.zeros(len(cut.start), bool), np.ones(len(group), bool)))),
                ],
                names=["signature", "record", "size", "probe", "deleted"],
            )


def uncovered_batches(batches: Iterator[pa.RecordBatch], frequent: np.ndarray, counts: np.ndarray, bounds: Bounds) -> Iterator[pa.RecordBatch]:
    """The H + 1 rarest values of each set whose plain segments do not reach H + 1."""
    for batch in batches:
        record = batch.column("record").to_numpy(zero_copy_only=False)
        sizes, values = flat_lists(batch.column("members"))
        owner = np.repeat(np.arange(len(sizes)), sizes)
        known = in_sorted(values, frequent)
        cut = Segmented(owner[~known], values[~known], sizes, bounds, 0)
        _, whole = cut.spent_before(len(sizes))
        most = bounds.most_differences(sizes)
        lost = (whole <= most)[owner]
        owner, values, known = owner[lost], values[lost], known[lost]
        often = np.zeros(len(values), np.int64)
        if len(frequent):
            often[known] = counts[np.searchsorted(frequent, values[known])]
        order = np.lexsort((values, often, owner))
        owner, values = owner[order], values[order]
        first = np.searchsorted(owner, owner, "left")
        taken = np.arange(len(owner)) - first <= most[owner]
        owner, values = owner[taken], values[taken]
        yield pa.RecordBatch.from_arrays(
            [pa.array(values), pa.array(record[owner]), pa.array(sizes[owner].astype(np.int32))], names=["value", "record", "size"]
        )


def record_sets(rows: DataFrame, record: str, value: str, least: int) -> DataFrame:
    """``record, members, size``: the distinct values of each record that has ``least`` of them or more."""
    sets = rows.select(F.col(record).cast("long").alias("record"), F.col(value).cast("long").alias("value")).na.drop("any")
    sets = sets.groupBy("record").agg(F.sort_array(F.collect_set("value")).alias("members"))
    return sets.withColumn("size", F.size("members")).where(F.col("size") >= least)


def similar_representatives(sets: DataFrame, similarity: float, least: int, work: Workspace, frequent_from: int = FREQUENT, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """``a, b``: all pairs of the given distinct sets (record, members, size) with the similarity or more.

    With a column ``sides`` (bit 1: a set of the left table, bit 2: of the
    right) only pairs of a left and a right set are wanted.
    """
    bounds = Bounds(similarity, least)
    counted = work.keep(sets.select(F.explode("members").alias("value")).groupBy("value").count().where(F.col("count") >= frequent_from), "frequent")
    often = counted.orderBy(F.desc("count"), "value").limit(MOST_FREQUENT).collect()
    by_value = sorted((r["value"], r["count"]) for r in often)
    frequent = np.array([v for v, _ in by_value], np.int64)
    counts = np.array([n for _, n in by_value], np.int64)
    narrow = sets.select("record", "members")
    signatures = work.keep(narrow.mapInArrow(lambda batches: signature_batches(batches, frequent, bounds), SIGNATURE_SCHEMA), "signatures")
    p, q = signatures.where("probe").alias("p"), signatures.alias("q")
    smaller = "(q.size < p.size or (q.size = p.size and q.record < p.record))"
    near = f"{smaller} and q.size >= {similarity!r}D * p.size - 1e-9D"
    candidates = p.join(q, F.expr(f"p.signature = q.signature and not (p.deleted and q.deleted) and {near}")).select(
        F.col("p.record").alias("a"), F.col("q.record").alias("b")
    )
    lost = work.keep(narrow.mapInArrow(lambda batches: uncovered_batches(batches, frequent, counts, bounds), "value long, record long, size int"), "uncovered")
    if not lost.isEmpty():
        # the rarest values of a set may be in very many sets: the lists of those are cut into slices
        heavy = heavy_counts(counted, "value", "count", heavy_rows)
        values = sliced(sets.select(F.explode("members").alias("value"), "record", "size"), "value", heavy, ["record"])
        rare = spread(lost, "value", heavy).alias("p").join(values.alias("q"), F.expr(f"p.value = q.value and p.{SLICE} = q.{SLICE} and {near}"))
        candidates = candidates.unionByName(rare.select(F.col("p.record").alias("a"), F.col("q.record").alias("b")))
    candidates = candidates.distinct()
    sided = ["sides"] if "sides" in sets.columns else []
    left = sets.select(F.col("record").alias("a"), F.col("members").alias("of_a"), *[F.col(c).alias("side_a") for c in sided])
    right = sets.select(F.col("record").alias("b"), F.col("members").alias("of_b"), *[F.col(c).alias("side_b") for c in sided])
    both = candidates.join(left, "a").join(right, "b")
    if sided:
        both = both.where("(side_a & 1 > 0 AND side_b & 2 > 0) OR (side_a & 2 > 0 AND side_b & 1 > 0)")
    both = both.select("a", "b", F.size("of_a").alias("m"), F.size("of_b").alias("n"), F.size(F.array_intersect("of_a", "of_b")).alias("common"))
    return both.where(f"common * {1 + similarity!r}D >= {similarity!r}D * (m + n) - 1e-9D").select("a", "b")


def similar_sets(rows: DataFrame, record: str, value: str, similarity: float = 0.5, least: int = 8, frequent_from: int = FREQUENT) -> tuple[DataFrame, DataFrame]:
    """Links between distinct sets and the class of every set: ``(a, b)`` and ``(record, copy_of)``.

    A record's set is its distinct values; rows with a null record or value
    count for nothing, sets of fewer than ``least`` values are left out, equal
    sets form one class. Other columns of ``rows`` are ignored; an empty table
    gives two empty results.
    """
    work = Workspace(rows.sparkSession, "sets")
    sets = work.keep(record_sets(rows, record, value, least), "sets")
    classes = work.keep(copy_classes(sets, "record", "members"), "classes")
    distinct = sets.join(classes.where("record = copy_of").select("record"), "record", "left_semi")
    return work.keep(similar_representatives(distinct, similarity, least, work, frequent_from), "links"), classes


def similar_set_pairs(rows: DataFrame, record: str, value: str, similarity: float = 0.5, least: int = 8, frequent_from: int = FREQUENT) -> DataFrame:
    """``a, b`` (a < b): every pair of records whose sets are similar, equal sets included."""
    links, classes = similar_sets(rows, record, value, similarity, least, frequent_from)
    return expanded_pairs(links, classes, "record")


def similar_sets_between(left: DataFrame, right: DataFrame, record: str, value: str, similarity: float = 0.5, least: int = 8, frequent_from: int = FREQUENT) -> DataFrame:
    """``a, b``: every pair of a record ``a`` of ``left`` and a record ``b`` of ``right`` whose sets are similar, equal sets included.

    Both tables have the columns ``record`` and ``value``; a number that both
    tables use means two records. Nulls, repeats, small sets, other columns and
    empty tables as in :func:`similar_sets`.
    """
    work = Workspace(left.sparkSession, "sets")
    sides = [record_sets(rows, record, value, least).withColumn("side", F.lit(side)) for side, rows in ((1, left), (2, right))]
    both = sides[0].unionByName(sides[1]).withColumnRenamed("record", "number")
    sets = work.keep(both.withColumn("record", F.monotonically_increasing_id()), "sets")
    classes = work.keep(copy_classes(sets, "record", "members").join(sets.select("record", "number", "side"), "record"), "classes")
    present = classes.groupBy(F.col("copy_of").alias("record")).agg(F.bit_or("side").alias("sides"))
    distinct = sets.select("record", "members", "size").join(present, "record")
    links = work.keep(similar_representatives(distinct, similarity, least, work, frequent_from), "links")
    return cross_pairs(links, classes.select("copy_of", "number", "side"))
