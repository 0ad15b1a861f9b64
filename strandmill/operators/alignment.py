"""Alignment of the best sketch candidates and the choice of one mate."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandmill.config import Settings
from strandmill.functions.kernels import banded_alignments, codes
from strandmill.functions.sequences import reverse_complement
from strandmill.operators.mates import sketch_order

PAIR = "query long, target long, rev boolean, hits long, place long, ratio double, coverage double, overlap long, score long, matches long, columns long"


def alignment_batches(batches: Iterator[pa.RecordBatch], band: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [(codes(q), codes(t)) for q, t in zip(batch.column("q_part").to_pylist(), batch.column("t_part").to_pylist())]
        figures = banded_alignments(parts, band)
        columns = [batch.column(name) for name in ("query", "target", "rev", "hits", "place", "ratio", "coverage", "overlap")]
        yield pa.RecordBatch.from_arrays(
            [*columns, *(pa.array([f[i] for f in figures], pa.int64()) for i in range(3))],
            names=["query", "target", "rev", "hits", "place", "ratio", "coverage", "overlap", "score", "matches", "columns"],
        )


def aligned_mates(records: DataFrame, best: DataFrame, settings: Settings) -> DataFrame:
    """The best aligned candidate of every query that has one: identity, coverage, ratio, matches and score decide, then a fixed hash.

    Of the candidates that pass by sketch the first ``alignment_targets`` of a
    query are aligned over their windows. Only then the sequences are joined, one
    row a read, and only the overlapping parts travel to the kernel.
    """
    passing = (F.col("identity") >= settings.identity) & (F.col("ratio") >= settings.least_ratio) & (F.col("coverage") >= settings.least_coverage)
    limit = min(settings.alignment_targets, settings.prefilter_targets)
    ranked = best.where(passing).withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(*sketch_order()))).where(F.col("rank") <= limit)
    sequences = records.where("read_idx IS NOT NULL AND seq IS NOT NULL").groupBy("read_idx").agg(F.max("seq").alias("seq"))
    pairs = ranked.join(sequences.toDF("query", "q_seq"), "query").join(sequences.toDF("target", "t_seq"), "target")
    strand = F.when(F.col("rev"), reverse_complement(F.col("t_seq"))).otherwise(F.col("t_seq"))
    parts = pairs.select(
        "query", "target", "rev", "hits", F.col("place").cast("long").alias("place"), "ratio", "coverage", F.col("overlap").cast("long").alias("overlap"),
        F.substring("q_seq", F.col("q_start") + 1, F.col("overlap")).alias("q_part"), F.substring(strand, F.col("t_start") + 1, F.col("overlap")).alias("t_part"),
    )
    aligned = parts.repartition(records.sparkSession.sparkContext.defaultParallelism * 2).mapInArrow(lambda b: alignment_batches(b, settings.band), PAIR)
    aligned = aligned.withColumns({"identity": F.col("matches") / F.col("columns"), "score": F.col("score") + F.least("hits", F.lit(10000)), "tie": F.xxhash64(F.lit(settings.seed), "query", "target")})
    order = W.partitionBy("query").orderBy(F.desc("identity"), F.desc("coverage"), F.desc("ratio"), F.desc("matches"), F.desc("score"), F.desc("tie"), "rev")
    first = aligned.withColumns({"rank": F.row_number().over(order), "aligned": F.count(F.lit(1)).over(W.partitionBy("query"))}).where("rank = 1")
    # both parts are aligned over their whole length, so gap letters follow from the number of columns
    gaps = F.col("columns") - F.col("overlap")
    mismatches = F.col("overlap") - gaps - F.col("matches")
    return first.select(
        "query", F.col("target").alias("mate"), "rev", "identity", "ratio", "coverage", "score", "matches", (F.col("columns") - F.col("matches")).alias("edits"), mismatches.alias("mismatches"), gaps.alias("insertions"), gaps.alias("deletions"),
        passing.alias("passes"), "aligned",
    )
