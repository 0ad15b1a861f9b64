"""Column expressions over nucleotide strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reverse_complement(sequence: Column) -> Column:
    """Reversed, A with T and C with G exchanged, U read as T; anything else becomes N. Null stays null, empty stays empty."""
    return F.regexp_replace(F.translate(F.reverse(F.upper(sequence)), "ACGTU", "TGCAA"), "[^ACGT]", "N")


def clean_bases(sequence: Column) -> Column:
    """Upper case, U as T, anything but ACGT as N."""
    return F.regexp_replace(F.translate(F.upper(sequence), "U", "T"), "[^ACGT]", "N")


def known_runs(reads: DataFrame, read: str, sequence: str) -> DataFrame:
    """``read, start, bases``: the maximal runs of known bases of every read, in either case, U among them.

    Null and empty sequences and those without a known base have no run.
    """
    pieces = F.split(clean_bases(F.col(sequence)), "(?<=N)(?!N)|(?<!N)(?=N)")
    placed = reads.select(read, F.posexplode(pieces).alias("n", "piece"), pieces.alias("pieces"))
    start = F.aggregate(F.slice("pieces", 1, F.col("n")), F.lit(0), lambda total, piece: total + F.length(piece))
    return placed.where("piece <> '' AND NOT startswith(piece, 'N')").select(read, start.cast("long").alias("start"), F.col("piece").alias("bases"))


def similarity_of_identity(identity: Column, k: int) -> Column:
    """Expected Jaccard similarity of the k-mers at an identity: s / (2 - s) with s = exp(-k * (1 - identity))."""
    survival = F.exp(-F.lit(float(k)) * (F.lit(1.0) - identity))
    return survival / (F.lit(2.0) - survival)


def identity_of_similarity(similarity: Column, k: int) -> Column:
    """The identity at which this similarity is expected: 0 for a similarity of 0 (or none), 1 from 1 on, within [0, 1] between."""
    distance = -F.ln(2 * similarity / (1 + similarity)) / F.lit(float(k))
    inner = F.lit(1.0) - F.greatest(F.least(distance, F.lit(1.0)), F.lit(0.0))
    return F.when(F.coalesce(similarity, F.lit(0.0)) <= 0, 0.0).when(similarity >= 1, 1.0).otherwise(inner)


def nearest_rank(values: Column, share: float) -> Column:
    """The value of rank round((n - 1) * share), counted from 0, of an array; null for an empty one."""
    ordered = F.array_sort(values)
    return F.when(F.size(values) > 0, F.element_at(ordered, F.floor((F.size(values) - 1) * F.lit(share) + 0.5).cast("int") + 1))


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on nothing but the parts: 60 bits of the digest of their text."""
    digest = F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 15)
    return F.conv(digest, 16, 10).cast("long") / F.lit(float(2**60))
