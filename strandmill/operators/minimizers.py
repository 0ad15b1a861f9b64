"""Minimizers of reads and their index over both strands."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.functions import kernels


def minimizer_batches(batches: Iterator[pa.RecordBatch], k: int, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [kernels.minimizers(s, k, w, seed) for s, w in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        owner = np.repeat(np.arange(len(found)), [len(t) for t, _ in found])
        tokens = np.concatenate([t for t, _ in found] or [np.zeros(0, np.uint64)]).astype(np.int64)
        places = np.concatenate([p for _, p in found] or [np.zeros(0, np.int64)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array(tokens), pa.array(places)], names=["read_idx", "hash", "pos"])


def minimizers(reads: DataFrame, k: int, window: int | str, seed: int = 0) -> DataFrame:
    """``read_idx, hash, pos``: forward-strand minimizers of every read (read_idx, seq).

    ``window`` is a number of k-mers or a column that holds it for each read
    (samples differ). Reads that are null or shorter than k + window - 1 in
    every run of known bases have none. Each ``seed`` gives another order of
    the k-mers. Narrow: no shuffle.
    """
    width = F.col(window) if isinstance(window, str) else F.lit(window)
    rows = reads.select(F.col("read_idx").cast("long").alias("read_idx"), "seq", width.cast("int").alias("window")).where("seq IS NOT NULL AND window > 0")
    return rows.mapInArrow(lambda batches: minimizer_batches(batches, k, seed), "read_idx long, hash long, pos int")


def strand_index(seeds: DataFrame, reads: DataFrame, k: int) -> DataFrame:
    """``hash, target, pos, rev``: every seed once on each strand.

    The hash is neutral to the strand, so the reverse strand's seeds are the
    forward ones at the mirrored position: a projection, not a second sketch.
    """
    placed = seeds.join(reads.select("read_idx", "len"), "read_idx")
    mirrored = (F.col("len") - k - F.col("pos")).cast("int")
    both = F.explode(F.array(F.struct(F.col("pos").alias("pos"), F.lit(False).alias("rev")), F.struct(mirrored.alias("pos"), F.lit(True).alias("rev"))))
    return placed.select("hash", F.col("read_idx").alias("target"), both.alias("at")).select("hash", "target", "at.pos", "at.rev")
