"""Queries over keys of which a few hold most records (problem 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.operators.skew import entry_counts, key_profile
from strandmill.sources.tables import table

#: Distinct entries up to which a hash is usable as a seed.
MAX_OCCURRENCE = 128
ENTRY = ["hash", "target", "pos", "rev"]


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every hash with more than 128 distinct index entries."""
    counts = entry_counts(table(spark, folder, "index_hits", *ENTRY), "hash", ENTRY)
    return counts.where(F.col("entries") > MAX_OCCURRENCE).select("hash")


def p2_hash_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Entries and distinct targets of every hash."""
    profile = key_profile(table(spark, folder, "index_hits", *ENTRY), "hash", "target", ENTRY)
    return profile.withColumnRenamed("partners", "targets")


def p2_target_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Entries and distinct hashes of every target."""
    profile = key_profile(table(spark, folder, "index_hits", *ENTRY), "target", "hash", ENTRY)
    return profile.withColumnRenamed("partners", "hashes")


QUERIES = {"p2_found": p2_found, "p2_hash_profile": p2_hash_profile, "p2_target_profile": p2_target_profile}

_ENTRIES = """SELECT DISTINCT hash, target, pos, rev FROM index_hits
 WHERE hash IS NOT NULL AND target IS NOT NULL AND pos IS NOT NULL AND rev IS NOT NULL"""

SQL = {
    "p2_found": f"SELECT hash FROM ({_ENTRIES}) GROUP BY hash HAVING count(*) > 128",
    "p2_hash_profile": f"SELECT hash, count(*) AS entries, count(DISTINCT target) AS targets FROM ({_ENTRIES}) GROUP BY hash",
    "p2_target_profile": f"SELECT target, count(*) AS entries, count(DISTINCT hash) AS hashes FROM ({_ENTRIES}) GROUP BY target",
}
