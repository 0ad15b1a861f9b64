"""Queries of the redundancy curve and the non-redundant subset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.config import Settings
from strandmill.operators import curve as C
from strandmill.operators.greedy import kept_reads
from strandmill.operators.mates import reads_with_length
from strandmill.sources.tables import table

SETTINGS = Settings()


def _reads(spark: SparkSession, folder: str) -> DataFrame:
    return reads_with_length(table(spark, folder, "read_records"))


def _mates(spark: SparkSession, folder: str) -> DataFrame:
    return C.latest_mates(table(spark, folder, "mate_results"))


def latest_mates(spark: SparkSession, folder: str) -> DataFrame:
    return _mates(spark, folder)


def sampling_points(spark: SparkSession, folder: str) -> DataFrame:
    return C.sampling_points(C.totals(_reads(spark, folder)), SETTINGS.divide)


def _curve(spark: SparkSession, folder: str) -> DataFrame:
    return C.curve(_reads(spark, folder), _mates(spark, folder), SETTINGS.replicates, SETTINGS.divide, SETTINGS.seed)


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.floor(F.col(c) * 1e6 + 0.5) / F.lit(1e6) for c in columns})


def curve_all(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(_curve(spark, folder).drop("reads"), "value")


def curve_summary(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(C.curve_summary(_curve(spark, folder)), "mean", "sd", "q1", "median", "q3")


def nonredundant_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Identifiers of the reads that the greedy pass keeps."""
    reads = _reads(spark, folder)
    kept = kept_reads(reads.select("read_idx").join(_mates(spark, folder), "read_idx", "left"))
    return kept.where("keep").join(reads, "read_idx").select("read_idx", "id")


def mates_table(spark: SparkSession, folder: str) -> DataFrame:
    """Every read with its best target, the alignment's figures and whether it is kept; without a best target a dot and zeros."""
    reads = _reads(spark, folder)
    results = table(spark, folder, "mate_results").where("query IS NOT NULL")
    order = F.struct("scored_at", F.coalesce("best.target", F.lit(-1)))
    latest = results.groupBy(F.col("query").alias("read_idx")).agg(F.max_by(F.struct("mate_count", "candidates", "aligned", "best"), order).alias("r"))
    kept = kept_reads(reads.select("read_idx").join(_mates(spark, folder), "read_idx", "left"))
    target = reads.select(F.col("read_idx").alias("target"), F.col("id").alias("target_id"))
    joined = reads.join(latest, "read_idx").join(kept, "read_idx").withColumn("target", F.col("r.best.target")).join(target, "target", "left")
    zero = lambda name: F.coalesce(F.col(f"r.best.{name}"), F.lit(0))
    return joined.select(
        F.col("id").alias("query_id"), F.col("len").alias("query_len"), F.col("r.mate_count").alias("mate_count"), F.col("r.candidates").alias("candidate_count"), F.col("r.aligned").alias("aligned_count"),
        F.coalesce("target_id", F.lit(".")).alias("best_target"), F.nanvl(zero("identity"), F.lit(0.0)).alias("best_identity"), zero("alignment_ratio").cast("double").alias("best_alignment_ratio"),
        zero("query_coverage").cast("double").alias("best_query_coverage"), zero("score").alias("best_score"), zero("matches").cast("long").alias("best_matches"), zero("mismatches").cast("long").alias("best_mismatches"),
        F.col("keep").alias("nonredundant"),
    )


QUERIES = {f.__name__: f for f in (latest_mates, sampling_points, curve_all, curve_summary, nonredundant_ids, mates_table)}

_N = SETTINGS.replicates
_STEPS = f"""reads AS (SELECT read_idx, min(id) AS id, max(sample_label) AS sample_label, max(length(seq)) AS len FROM read_records WHERE read_idx IS NOT NULL GROUP BY read_idx HAVING max(length(seq)) > 0),
mates AS (SELECT query AS read_idx, mate FROM (SELECT query, scored_at, CASE WHEN best.passes AND best.target <> query THEN best.target END AS mate FROM mate_results WHERE query IS NOT NULL)
 QUALIFY row_number() OVER (PARTITION BY query ORDER BY scored_at DESC NULLS LAST, coalesce(mate, -1) DESC) = 1),
totals AS (SELECT sample_label, count(*) AS reads, CAST(sum(len) AS BIGINT) AS bases FROM reads WHERE sample_label IS NOT NULL GROUP BY sample_label),
points AS (SELECT sample_label, reads, bases, 0 AS point, CASE WHEN reads <= 1 THEN 1.0 ELSE 0.0 END AS portion FROM totals
 UNION ALL SELECT sample_label, reads, bases, top - i + 1, floor(pow(0.7::DOUBLE, i) * 1e12 + 0.5) / 1e12 FROM
 (SELECT *, unnest(range(0, top + 1)) AS i FROM (SELECT *, CAST(ceil((ln(2.0) - ln(reads::DOUBLE)) / ln(0.7::DOUBLE)) AS BIGINT) AS top FROM totals WHERE reads > 1)))"""
_CURVE = f"""{_STEPS},
drawn AS (SELECT r.read_idx, r.sample_label, r.len, m.mate, rep, ('0x' || substr(md5('1|' || rep || '|' || r.read_idx), 1, 15))::BIGINT / 1152921504606846976.0::DOUBLE AS u,
 ('0x' || substr(md5('1|' || rep || '|' || t.read_idx), 1, 15))::BIGINT / 1152921504606846976.0::DOUBLE AS v
 FROM reads r LEFT JOIN mates m USING (read_idx) LEFT JOIN reads t ON t.read_idx = m.mate AND t.sample_label = r.sample_label CROSS JOIN range(0, {_N}) x(rep) WHERE r.sample_label IS NOT NULL),
sums AS (SELECT p.sample_label, point, portion, reads, bases, rep, sum(CASE WHEN u < portion THEN len ELSE 0 END) AS sampled, sum(CASE WHEN u < portion AND v < portion THEN len ELSE 0 END) AS found
 FROM points p JOIN drawn d ON d.sample_label = p.sample_label GROUP BY ALL),
vals AS (SELECT sample_label, point, portion, CAST(floor(portion * bases + 0.5) AS BIGINT) AS bases, CAST(rep AS INT) AS replicate, reads, CASE WHEN reads > 1 AND sampled > 0 THEN found::BIGINT / sampled::BIGINT ELSE 0.0 END AS value FROM sums)"""
_R6 = "floor({0} * 1e6 + 0.5) / 1e6"
_KEPT = """chain(read_idx, spot, depth) AS (SELECT read_idx, read_idx, 0 FROM reads UNION ALL
 SELECT c.read_idx, m.mate, c.depth + 1 FROM chain c JOIN mates m ON m.read_idx = c.spot JOIN reads t ON t.read_idx = m.mate WHERE m.mate < c.spot),
kept AS (SELECT read_idx, max(depth) % 2 = 0 AS keep FROM chain GROUP BY read_idx)"""

SQL = {
    "latest_mates": f"WITH {_STEPS} SELECT read_idx, mate FROM mates",
    "sampling_points": f"WITH {_STEPS} SELECT sample_label, CAST(point AS BIGINT) AS point, portion FROM points",
    "curve_all": f"WITH {_CURVE} SELECT sample_label, CAST(point AS BIGINT) AS point, portion, bases, replicate, {_R6.format('value')} AS value FROM vals",
    "curve_summary": f"""WITH {_CURVE}, ordered AS (SELECT sample_label, point, portion, bases, max(reads) AS total, avg(value) AS mean, stddev_pop(value) AS sd, list_sort(list(value)) AS v FROM vals GROUP BY ALL)
 SELECT sample_label, CAST(point AS BIGINT) AS point, CAST(floor(portion * total + 0.5) AS BIGINT) AS reads, bases, portion, {_R6.format('mean')} AS mean, {_R6.format('sd')} AS sd,
 {_R6.format(f'v[{round((_N - 1) * 0.25) + 1}]')} AS q1, {_R6.format(f'v[{int((_N - 1) * 0.5 + 0.5) + 1}]')} AS median, {_R6.format(f'v[{round((_N - 1) * 0.75) + 1}]')} AS q3 FROM ordered""",
    "nonredundant_ids": f"WITH RECURSIVE {_STEPS}, {_KEPT} SELECT read_idx, id FROM kept JOIN reads USING (read_idx) WHERE keep",
    "mates_table": f"""WITH RECURSIVE {_STEPS}, {_KEPT}, latest AS (SELECT * FROM mate_results WHERE query IS NOT NULL QUALIFY row_number() OVER (PARTITION BY query ORDER BY scored_at DESC, coalesce(best.target, -1) DESC) = 1)
 SELECT r.id AS query_id, r.len AS query_len, l.mate_count, l.candidates AS candidate_count, l.aligned AS aligned_count, coalesce(t.id, '.') AS best_target,
 CASE WHEN isnan(coalesce(l.best.identity, 0)) THEN 0 ELSE coalesce(l.best.identity, 0) END AS best_identity, coalesce(l.best.alignment_ratio, 0) AS best_alignment_ratio, coalesce(l.best.query_coverage, 0) AS best_query_coverage,
 coalesce(l.best.score, 0) AS best_score, coalesce(l.best.matches, 0) AS best_matches, coalesce(l.best.mismatches, 0) AS best_mismatches, k.keep AS nonredundant
 FROM reads r JOIN latest l ON l.query = r.read_idx JOIN kept k ON k.read_idx = r.read_idx LEFT JOIN reads t ON t.read_idx = l.best.target""",
}
