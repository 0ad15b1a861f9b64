"""From seeds to the best mate of every read: shared seeds, diagonal bands, overlap windows, sketches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandmill.config import Settings
from strandmill.functions.sequences import identity_of_similarity
from strandmill.operators.skew import distinct_entries, entry_counts

ENTRY = ["hash", "target", "pos", "rev"]
#: Positions of a target whose seeds are kept in one row.
SEED_BLOCK = 8192


def reads_with_length(records: DataFrame) -> DataFrame:
    """``read_idx, id, sample_label, len``: one row for each read with at least one base; repeats are folded, nulls ignored."""
    rows = records.select("read_idx", "id", "sample_label", F.length("seq").cast("long").alias("len")).where("read_idx IS NOT NULL")
    folded = rows.groupBy("read_idx").agg(F.min("id").alias("id"), F.max("sample_label").alias("sample_label"), F.max("len").alias("len"))
    return folded.where("len > 0")


def query_seeds(seeds: DataFrame) -> DataFrame:
    """``query, hash, q_pos``: every seed hash of a read once, at its lowest position; rows with a null count for nothing."""
    return seeds.na.drop("any", subset=["read_idx", "hash", "pos"]).groupBy(F.col("read_idx").alias("query"), "hash").agg(F.min("pos").alias("q_pos"))


def usable_entries(index_hits: DataFrame, most: int) -> DataFrame:
    """Distinct index entries of the hashes that have at most ``most`` of them.

    The hashes above are far fewer than the entries (one for ``most`` rows at
    most), so the entries are filtered by an anti join, in which a heavy hash
    may be split, instead of being gathered by hash.
    """
    heavy = entry_counts(index_hits, "hash", ENTRY).where(F.col("entries") > most).select("hash")
    return distinct_entries(index_hits, ENTRY).join(heavy, "hash", "left_anti")


def bands(seeds: DataFrame, entries: DataFrame, diagonal_bin: int, least: int | str) -> DataFrame:
    """Shared seeds of two reads counted by strand and diagonal bin.

    ``query, target, rev, bin, hits, center, min_diag, max_diag``: ``hits``
    counts distinct query positions (``least`` or more; the name of a column of
    ``seeds`` where samples differ), ``center`` averages
    over all shared seeds and is cut toward zero, bins are floored. A read never
    meets itself. Every hash has a bounded number of entries, so no key of the
    join is heavy.
    """
    shared = seeds.join(entries, "hash").where("query <> target")
    diagonal = (F.col("pos") - F.col("q_pos")).cast("long")
    enough = F.col(least) if isinstance(least, str) else F.lit(least)
    placed = shared.select("query", "target", "rev", "q_pos", enough.alias("enough"), diagonal.alias("diag"), F.floor(diagonal / F.lit(float(diagonal_bin))).alias("bin"))
    grouped = placed.groupBy("query", "target", "rev", "bin").agg(
        F.countDistinct("q_pos").alias("hits"), F.sum("diag").alias("total"), F.count(F.lit(1)).alias("n"), F.min("diag").alias("min_diag"), F.max("diag").alias("max_diag"), F.max("enough").alias("enough")
    )
    return grouped.where("hits >= enough").select("query", "target", "rev", "bin", "hits", F.expr("total div n").alias("center"), "min_diag", "max_diag")


def best_bands(found: DataFrame) -> DataFrame:
    """One band for each (query, target, strand): most hits, then the narrower, then the lower bin."""
    best = F.min_by(F.struct("bin", "hits", "center", "min_diag", "max_diag"), F.struct(-F.col("hits"), F.col("max_diag") - F.col("min_diag"), "bin"))
    return found.groupBy("query", "target", "rev").agg(best.alias("band")).select("query", "target", "rev", "band.*")


def top_targets(candidates: DataFrame, most: int) -> DataFrame:
    """The ``most`` candidates of each query with the most hits; ties by target, forward strand first."""
    order = W.partitionBy("query").orderBy(F.desc("hits"), "target", "rev")
    return candidates.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= most)


def offsets(candidates: DataFrame, radius: int, step: int) -> DataFrame:
    """Every offset at which a candidate is looked at: its own three diagonals and a grid around them."""
    first = F.least("min_diag", F.col("center") - radius)
    last = F.greatest("max_diag", F.col("center") + radius)
    grid = F.array_distinct(F.concat(F.array("center", "min_diag", "max_diag"), F.sequence(first, last, F.lit(step).cast("long"))))
    return candidates.withColumn("offset", F.explode(grid))


def overlaps(placed: DataFrame, reads: DataFrame, least_ratio: float, least_coverage: float) -> DataFrame:
    """Where the reads overlap at each offset, if the overlap is long enough.

    Adds ``q_start, t_start, overlap, ratio, coverage``: the overlap's share of
    the shorter read and of the query.
    """
    lengths = reads.select("read_idx", "len")
    both = placed.join(lengths.toDF("query", "q_len"), "query").join(lengths.toDF("target", "t_len"), "target")
    both = both.withColumns({"q_start": F.greatest(F.lit(0).cast("long"), -F.col("offset")), "t_start": F.greatest(F.lit(0).cast("long"), F.col("offset"))})
    both = both.withColumn("overlap", F.least(F.col("q_len") - F.col("q_start"), F.col("t_len") - F.col("t_start"))).where("overlap > 0")
    both = both.withColumns({"ratio": F.col("overlap") / F.least("q_len", "t_len"), "coverage": F.col("overlap") / F.col("q_len")})
    return both.where((F.col("ratio") >= least_ratio) & (F.col("coverage") >= least_coverage))


def in_window(seeds: str, start: str) -> Column:
    """Distinct hashes of the (hash, pos) array that begin within the overlap."""
    inside = F.filter(seeds, lambda s: (s["pos"] >= F.col(start)) & (s["pos"] < F.col(start) + F.col("overlap")))
    return F.array_distinct(F.transform(inside, lambda s: s["hash"]))


def window_scores(windows: DataFrame, seeds: DataFrame, index_hits: DataFrame, sketch_size: int, k: int) -> DataFrame:
    """Bottom-k similarity of the seeds of both reads within each window.

    Adds ``shared, denominator, identity``: of the ``sketch_size`` smallest
    hashes of the union how many both have. Without a seed on one side nothing
    is shared.

    Seeds travel once a candidate, not once a window: a candidate has few
    windows (the grid's length is bounded), which are unfolded after the joins.
    A target's seeds are kept in blocks of positions, of which a candidate
    fetches those its windows reach; so a very long target is never held or sent
    whole, however many reads meet it.
    """
    pair = ["query", "target", "rev"]
    fields = [c for c in windows.columns if c not in pair]
    ends = F.max(F.col("t_start") + F.col("overlap"))
    candidates = windows.groupBy(*pair).agg(F.collect_list(F.struct(*fields)).alias("windows"), F.min("t_start").alias("low"), ends.alias("high"))
    own = distinct_entries(seeds, ["read_idx", "hash", "pos"]).groupBy(F.col("read_idx").alias("query")).agg(F.collect_list(F.struct("hash", "pos")).alias("q_seeds"))
    blocks = distinct_entries(index_hits, ENTRY).withColumn("block", F.expr(f"CAST(pos AS BIGINT) div {SEED_BLOCK}"))
    blocks = blocks.groupBy("target", "rev", "block").agg(F.collect_list(F.struct("hash", "pos")).alias("seeds"))
    reach = F.sequence(F.expr(f"low div {SEED_BLOCK}"), F.expr(f"(high - 1) div {SEED_BLOCK}"))
    reached = candidates.select(*pair, "low", "high", F.explode(reach).alias("block")).join(blocks, ["target", "rev", "block"])
    part = F.filter("seeds", lambda s: (s["pos"] >= F.col("low")) & (s["pos"] < F.col("high")))
    other = reached.groupBy(*pair).agg(F.flatten(F.collect_list(part)).alias("t_seeds"))
    both = candidates.join(other, pair, "left").join(own, "query").withColumn("window", F.explode("windows"))
    both = both.select(*pair, "window.*", "q_seeds", F.coalesce("t_seeds", F.array().cast("array<struct<hash:bigint,pos:int>>")).alias("t_seeds"))
    both = both.withColumns({"x": in_window("q_seeds", "q_start"), "y": in_window("t_seeds", "t_start")}).drop("q_seeds", "t_seeds")
    both = both.withColumn("u", F.slice(F.array_sort(F.array_union("x", "y")), 1, sketch_size))
    common = F.size(F.array_intersect(F.array_intersect("u", "x"), "y"))
    scored = both.withColumns({"shared": common.cast("long"), "denominator": F.size("u").cast("long")}).drop("x", "y", "u")
    return scored.withColumn("identity", identity_of_similarity(F.try_divide(F.col("shared").cast("double"), F.col("denominator").cast("double")), k))


def best_windows(scored: DataFrame) -> DataFrame:
    """One window for each (query, target, strand): identity, ratio, overlap, then the smaller and the lower offset; ``evaluated`` counts all."""
    fields = ["hits", "place", "offset", "q_start", "t_start", "overlap", "q_len", "t_len", "ratio", "coverage", "shared", "denominator", "identity"]
    order = F.struct("identity", "ratio", "overlap", (-F.abs("offset")).alias("a"), (-F.col("offset")).alias("b"))
    best = scored.groupBy("query", "target", "rev").agg(F.max_by(F.struct(*fields), order).alias("window"), F.count(F.lit(1)).alias("evaluated"))
    return best.select("query", "target", "rev", "window.*", "evaluated")


def sketch_order() -> list[Column]:
    """Candidates from the best on: identity, coverage, ratio, overlap, hits, target, forward strand first."""
    return [F.desc("identity"), F.desc("coverage"), F.desc("ratio"), F.desc("overlap"), F.desc("hits"), F.asc("target"), F.asc("rev")]


def sketch_mates(reads: DataFrame, best: DataFrame, settings: Settings) -> DataFrame:
    """For every read its best candidate by sketch, whether it passes, and how much was looked at.

    The best is chosen first and the thresholds are tested on it afterwards. A
    read without a candidate keeps its row, with nulls.
    """
    passing = (F.col("identity") >= settings.identity) & (F.col("ratio") >= settings.least_ratio) & (F.col("coverage") >= settings.least_coverage)
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(*sketch_order())))
    first = ranked.where("rank = 1").select("query", F.col("target").alias("mate"), "rev", "identity", "ratio", "coverage", "hits", "shared", "denominator", passing.alias("passes"))
    counted = best.groupBy("query").agg(F.count(F.lit(1)).alias("candidates"), F.sum("evaluated").alias("windows"))
    joined = reads.select(F.col("read_idx").alias("query"), "len").join(first, "query", "left").join(counted, "query", "left")
    score = F.floor(F.lit(1e6) * F.col("identity") + 0.5) + F.least("hits", F.lit(10000))
    return joined.withColumns(
        {"passes": F.coalesce("passes", F.lit(False)), "score": score, "candidates": F.coalesce("candidates", F.lit(0)), "windows": F.coalesce("windows", F.lit(0))}
    )


def run_counters(mates: DataFrame) -> DataFrame:
    """One row: reads, bases, candidates, windows, passing mates and the redundant share of the bases."""
    return mates.agg(
        F.count(F.lit(1)).alias("reads"), F.sum("len").alias("bases"), F.sum("candidates").alias("candidates"), F.sum("windows").alias("windows"),
        F.sum(F.col("passes").cast("long")).alias("passing"), F.sum(F.when(F.col("passes"), F.col("len")).otherwise(0)).alias("redundant_bases"),
    )
