"""Consolidating pairwise matches into groups by low-diameter decomposition.

On every level each vertex draws a head start from an exponential
distribution. Clusters grow one hop a round from their centres, which start
the earlier the larger their head start; a vertex joins the cluster that
reaches it first. Growth goes on until no vertex changes. Clusters then become the vertices of the next level, the
links between different clusters its links. When no link is left the levels'
assignments are composed from the last to the first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.operators.skew import SLICE, heavy_keys, lookup_join, sliced, spread
from strandmill.workspace import Workspace

#: Rate of the exponential head starts: their mean, in hops, is 1 / RATE, and no cluster's radius is above ln(vertices) / RATE but by rare chance.
RATE = 0.25
#: Hops between two looks at whether the clusters still grow.
STEP = 4
#: Each level leaves a fraction of the clusters; this many levels suffice for any graph that fits a cluster.
MAX_LEVELS = 200


def head_start(vertex: str, level: int, seed: int, rate: float):
    """Exponential variate of a vertex on a level, the same on every run and layout."""
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(level), vertex), 11) + F.lit(0.5)) / F.lit(float(2**53))
    return -F.log(uniform) / F.lit(rate)


def one_hop(hops: DataFrame, state: DataFrame, heavy: list) -> DataFrame:
    """``src, best, own``: the earliest arrival at each vertex over its hops, and the one it had.

    ``hops`` leads from each vertex to its neighbours and, without a delay, to
    itself, so the state is read once and the plan grows by one join and one
    aggregate a round. Minima are partial aggregates: a vertex with many links
    gathers one row a partition.
    """
    met = hops.join(spread(state, "src", heavy), ["src", SLICE]) if heavy else hops.join(state, "src")
    arrival = F.struct((F.col("best.time") + F.col("delay")).alias("time"), F.col("best.centre").alias("centre"))
    sent = met.select(F.col("dst").alias("src"), "delay", arrival.alias("best"))
    return sent.groupBy("src").agg(F.min("best").alias("best"), F.min(F.when(F.col("delay") == 0, F.col("best"))).alias("own"))


def with_stays(links: DataFrame) -> DataFrame:
    """``src, dst, delay``: the links (src, dst), which hold both directions, and from each vertex to itself without a delay."""
    stays = links.select("src").distinct().select("src", F.col("src").alias("dst"), F.lit(0.0).alias("delay"))
    return links.select("src", "dst", F.lit(1.0).alias("delay")).unionByName(stays)


def grown_clusters(hops: DataFrame, heavy: list, level: int, work: Workspace, rate: float, step: int, seed: int) -> DataFrame:
    """``src, centre`` of every vertex of ``hops`` (see :func:`with_stays`).

    The state of a vertex is the earliest arrival so far and its centre. It is
    sent over the links, one hop later, until a round changes no vertex.
    """
    state = hops.where("delay = 0").select("src", F.struct((-head_start("src", level, seed, rate)).alias("time"), F.col("src").alias("centre")).alias("best"))
    hops = sliced(hops, "src", heavy, ["dst"]) if heavy else hops
    grown, number = True, 0
    while grown:
        for _ in range(step):
            state = one_hop(hops, state.select("src", "best"), heavy)
        state = work.keep(state, f"state{level}-{number}")
        if number:
            work.forget(f"state{level}-{number - 1}")
        grown = not state.where("best < own").isEmpty()
        number += 1
    return state.select("src", F.col("best.centre").alias("centre"))


def linked_groups(links: DataFrame, a: str, b: str, rate: float = RATE, step: int = STEP, seed: int = 7, heavy_rows: int | None = None) -> DataFrame:
    """``vertex, group``: the smallest vertex that each linked vertex reaches, itself included.

    ``links`` holds pairs of bigint vertices in columns ``a`` and ``b``; other
    columns are ignored. A pair with a null on either side and a pair of a
    vertex with itself link nothing; repeated and reversed pairs count once.
    A vertex without any link gives no row, an empty table an empty result.
    """
    work = Workspace(links.sparkSession, "groups")
    limits = {} if heavy_rows is None else {"rows": heavy_rows}
    pairs = links.select(F.col(a).cast("long").alias("src"), F.col(b).cast("long").alias("dst")).where("src <> dst")
    both = pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    current = work.keep(with_stays(work.keep(both, "links0")), "hops0")
    work.forget("links0")
    smallest = None  # of the members of each vertex of the level; on the first level the vertex itself
    levels = []
    for level in range(MAX_LEVELS):
        heavy = heavy_keys(current, "src", **limits)
        clusters = grown_clusters(current, heavy, level, work, rate, step, seed)
        members = clusters.withColumn("least", F.col("src")) if smallest is None else clusters.join(smallest.select(F.col("centre").alias("src"), "least"), "src")
        smallest = work.keep(members.groupBy("centre").agg(F.min("least").alias("least")), f"smallest{level}")
        levels.append((clusters, smallest))
        links = current.where("delay > 0").select("src", "dst")
        from_cluster = lookup_join(links, clusters, "src", ["dst"], heavy).select(F.col("centre").alias("from"), "dst")
        to_cluster = lookup_join(from_cluster, clusters.select(F.col("src").alias("dst"), "centre"), "dst", ["from"], heavy)
        between = to_cluster.select(F.col("from").alias("src"), F.col("centre").alias("dst")).where("src <> dst").distinct()
        following = work.keep(between, f"links{level + 1}")
        work.forget(f"hops{level}")
        if following.isEmpty():
            break
        current = work.keep(with_stays(following), f"hops{level + 1}")
        work.forget(f"links{level + 1}")
    else:
        raise RuntimeError(f"links between clusters are left after {MAX_LEVELS} levels")

    label = None  # src -> group on the level below the one in hand
    for number, (clusters, smallest) in reversed(list(enumerate(levels))):
        of_centre = smallest.select("centre", F.col("least").alias("group"))
        if label is not None:
            of_centre = smallest.join(label.select(F.col("src").alias("centre"), F.col("group").alias("deeper")), "centre", "left").select(
                "centre", F.coalesce("deeper", "least").alias("group")
            )
        label = lookup_join(clusters, of_centre, "centre", ["src"], heavy_keys(clusters, "centre", **limits)).select("src", "group")
        if number % 4 == 3:  # else the plan would grow with the levels
            label = work.keep(label, f"label{number}")
    return label.select(F.col("src").alias("vertex"), "group")
