"""Queries of the training-data operators and their SQL counterparts."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.llm.groups import linked_groups
from strandmill.llm.leakage import leaked_items
from strandmill.llm.near_copies import near_copy_pairs
from strandmill.llm.sentences import sentence_units
from strandmill.llm.set_join import similar_set_pairs
from strandmill.llm.stable_sample import DOMAIN, sql_place, threshold, with_place
from strandmill.llm.tokens import encoded
from strandmill.operators.skew import SLICE, heavy_keys, sliced, spread
from strandmill.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of reads of at least 120 bases with an identity of at least 0.9."""
    reads = table(spark, folder, "read_records", "read_idx", "seq", "loaded_at")
    pairs = near_copy_pairs(reads, "read_idx", "seq", "loaded_at", identity=0.9, least=120)
    return pairs.select(F.col("a").alias("read_a"), F.col("b").alias("read_b"))


def mate_links(spark: SparkSession, folder: str) -> DataFrame:
    """``query, target`` for every element of ``passing_targets``; rows with a null query link nothing."""
    mates = table(spark, folder, "mate_results", "query", "passing_targets").where("query IS NOT NULL")
    return mates.select("query", F.explode("passing_targets").alias("target"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """The group of every read that is linked to another one."""
    groups = linked_groups(mate_links(spark, folder), "query", "target")
    return groups.select(F.col("vertex").alias("read_idx"), F.col("group").alias("group_idx"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of reads with at least 8 seed values each of which at least half are common."""
    pairs = similar_set_pairs(table(spark, folder, "seeds", "read_idx", "hash"), "read_idx", "hash", 0.5, 8)
    return pairs.select(F.col("a").alias("read_a"), F.col("b").alias("read_b"))


def p5_sample(spark: SparkSession, folder: str) -> DataFrame:
    """For every sample and portion of its curve the reads chosen at that portion.

    Portions are rounded to 10 digits, so that noise makes no further ones. A
    read that was delivered again is one read; without a label it is in no sample.
    """
    reads = table(spark, folder, "read_records", "read_idx", "id", "sample_label")
    reads = reads.groupBy("read_idx").agg(F.min("id").alias("id"), F.max("sample_label").alias("sample_label"))
    placed = with_place(reads.where("sample_label IS NOT NULL"), "read_idx")
    points = table(spark, folder, "model_points", "sample_label", "portion").na.drop("any")
    points = points.select("sample_label", (F.floor(F.col("portion") * 1e10 + 0.5) / F.lit(1e10)).alias("portion")).distinct()
    heavy = heavy_keys(reads, "sample_label")
    chosen = sliced(placed, "sample_label", heavy, ["read_idx"]).join(spread(points, "sample_label", heavy), ["sample_label", SLICE])
    return chosen.where(F.col("place") < threshold(F.col("portion"))).select("sample_label", "portion", "read_idx", "id")


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file lies: in the folder named by STRANDMILL_TOKENIZERS or the installed one."""
    folder = os.environ.get("STRANDMILL_TOKENIZERS", "/opt/tokenizers")
    return os.path.join(folder, name)


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document."""
    return encoded(table(spark, folder, "documents", "doc_id", "text"), "doc_id", "text", vocabulary("byte_bpe_50k.tiktoken"))


def leaks(spark: SparkSession, folder: str, edits: int) -> DataFrame:
    items = table(spark, folder, "eval_items", "item_id", "text", "lang")
    found = leaked_items(table(spark, folder, "documents", "doc_id", "text"), "doc_id", "text", items, "item_id", "text", "lang", edits)
    return found.select(F.col("key").alias("doc_id"), F.col("item").alias("item_id"), "edits")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a passage of an evaluation item word for word."""
    return leaks(spark, folder, 0).select("doc_id", "item_id")


def p7_edited(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a passage of an evaluation item with at most two edited letters."""
    return leaks(spark, folder, 2)


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Sentence units of every document."""
    return sentence_units(table(spark, folder, "documents", "doc_id", "text", "lang"), "doc_id", "text", "lang")


QUERIES = {"p1_found": p1_found, "p3_found": p3_found, "p4_found": p4_found, "p5_sample": p5_sample, "p6_ids": p6_ids, "p7_found": p7_found, "p7_edited": p7_edited, "p8_found": p8_found}

SQL = {
    "p3_found": """
WITH RECURSIVE pairs AS (SELECT query AS a, unnest(passing_targets) AS b FROM mate_results WHERE query IS NOT NULL),
links AS (SELECT a, b FROM pairs WHERE a <> b UNION SELECT b, a FROM pairs WHERE a <> b),
reach(vertex, other) AS (SELECT a, a FROM links UNION SELECT r.vertex, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT vertex AS read_idx, min(other) AS group_idx FROM reach GROUP BY vertex""",
    "p4_found": """
WITH s AS (SELECT DISTINCT read_idx, hash FROM seeds WHERE read_idx IS NOT NULL AND hash IS NOT NULL),
z AS (SELECT read_idx, hash, count(*) OVER (PARTITION BY read_idx) AS n FROM s QUALIFY n >= 8),
c AS (SELECT a.read_idx AS read_a, b.read_idx AS read_b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS common
      FROM z a JOIN z b ON a.hash = b.hash AND a.read_idx < b.read_idx AND b.n <= 2 * a.n AND a.n <= 2 * b.n GROUP BY ALL)
SELECT read_a, read_b FROM c WHERE 3 * common >= na + nb""",
    "p5_sample": f"""
WITH reads AS (SELECT read_idx, min(id) AS id, max(sample_label) AS sample_label FROM read_records GROUP BY read_idx),
placed AS ({sql_place("read_idx", "reads")}),
points AS (SELECT DISTINCT sample_label, floor(portion * 1e10 + 0.5) / 1e10 AS portion FROM model_points WHERE portion IS NOT NULL)
SELECT sample_label, portion, read_idx, id FROM reads JOIN placed USING (read_idx) JOIN points USING (sample_label)
WHERE place < CAST(floor(least(greatest(portion, 0), 1) * {float(DOMAIN)!r}) AS BIGINT)""",
}
