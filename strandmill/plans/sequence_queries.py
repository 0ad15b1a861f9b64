"""Queries over the sequences of reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.functions import sequences as S
from strandmill.functions.sketch_size import filter_parameters, fragment_length
from strandmill.operators.mates import reads_with_length
from strandmill.operators.minimizers import minimizers as forward_minimizers
from strandmill.operators.minimizers import strand_index as both_strands
from strandmill.sources.tables import table

K, WINDOW = 16, 40


def _sequences(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each read with at least one base."""
    rows = table(spark, folder, "read_records", "read_idx", "seq").where("read_idx IS NOT NULL AND seq <> ''")
    return rows.groupBy("read_idx").agg(F.max("seq").alias("seq"))


def read_length_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Reads, bases and lengths of every sample."""
    reads = reads_with_length(table(spark, folder, "read_records"))
    return reads.groupBy("sample_label").agg(
        F.count(F.lit(1)).alias("reads"), F.sum("len").alias("bases"), F.min("len").alias("shortest"), F.max("len").alias("longest"),
        F.floor(F.sum("len") / F.count(F.lit(1)) + 0.5).alias("mean_length"),
    )


def reverse_complement(spark: SparkSession, folder: str) -> DataFrame:
    return _sequences(spark, folder).select("read_idx", S.reverse_complement(F.col("seq")).alias("seq"))


def acgt_runs(spark: SparkSession, folder: str) -> DataFrame:
    runs = S.known_runs(_sequences(spark, folder), "read_idx", "seq")
    return runs.select("read_idx", "start", F.length("bases").cast("long").alias("length"))


def minimizers(spark: SparkSession, folder: str) -> DataFrame:
    return forward_minimizers(_sequences(spark, folder), K, WINDOW)


def strand_index(spark: SparkSession, folder: str) -> DataFrame:
    reads = _sequences(spark, folder).select("read_idx", F.length("seq").alias("len"))
    return both_strands(minimizers(spark, folder), reads, K)


def _parameter_batches(batches):
    for frame in batches:
        found = [filter_parameters(fragment_length(int(r), int(b), K), K) for r, b in zip(frame["reads"], frame["bases"])]
        yield frame.assign(window=[f.window for f in found], sketch_size=[f.sketch_size for f in found], minimum_hits=[f.minimum_hits for f in found], p_value=[f.p_value for f in found])


def filter_parameters_of_samples(spark: SparkSession, folder: str) -> DataFrame:
    """Window, sketch size and minimum hits that each sample's mean read length asks for."""
    stats = read_length_stats(spark, folder).select("sample_label", "reads", "bases")
    return stats.mapInPandas(_parameter_batches, "sample_label string, reads long, bases long, window long, sketch_size long, minimum_hits long, p_value double")


QUERIES = {f.__name__: f for f in (read_length_stats, reverse_complement, acgt_runs, minimizers, strand_index, filter_parameters_of_samples)}

_READS = "SELECT read_idx, max(seq) AS seq FROM read_records WHERE read_idx IS NOT NULL AND seq <> '' GROUP BY read_idx"
_CLEAN = "regexp_replace(translate(upper(seq), 'U', 'T'), '[^ACGT]', 'N', 'g')"
_MINIMIZERS = f"""reads AS ({_READS}), clean AS (SELECT read_idx, {_CLEAN} AS s FROM reads),
kmers AS (SELECT read_idx, pos, substr(s, pos + 1, {K}) AS kmer FROM (SELECT read_idx, s, unnest(range(0, greatest(length(s) - {K - 1}, 0))) AS pos FROM clean)),
known AS (SELECT read_idx, pos, least(kmer, reverse(translate(kmer, 'ACGT', 'TGCA'))) AS c FROM kmers WHERE NOT contains(kmer, 'N')),
coded AS (SELECT read_idx, pos, CAST({" + ".join(f"(instr('ACGT', substr(c, {i + 1}, 1)) - 1)::UBIGINT * {4 ** (K - 1 - i)}" for i in range(K))} AS UBIGINT) AS x FROM known),
t1 AS (SELECT read_idx, pos, (x * 2654435761::UBIGINT) % 4294967296::UBIGINT AS x FROM coded),
t2 AS (SELECT read_idx, pos, (xor(x, x >> 15) * 2246822519::UBIGINT) % 4294967296::UBIGINT AS x FROM t1),
t3 AS (SELECT read_idx, pos, CAST(xor(x, x >> 13) AS BIGINT) AS hash, pos - row_number() OVER (PARTITION BY read_idx ORDER BY pos) AS run FROM t2),
least_of AS (SELECT read_idx, pos, hash, run, CASE WHEN count(*) OVER w = {WINDOW} THEN min(hash) OVER w END AS m FROM t3
 WINDOW w AS (PARTITION BY read_idx, run ORDER BY pos ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING)),
chosen AS (SELECT read_idx, pos, hash FROM least_of QUALIFY hash = max(m) OVER (PARTITION BY read_idx, run ORDER BY pos ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW))"""

SQL = {
    "read_length_stats": """SELECT sample_label, count(*) AS reads, CAST(sum(len) AS BIGINT) AS bases, min(len) AS shortest, max(len) AS longest, CAST(floor(sum(len) / count(*) + 0.5) AS BIGINT) AS mean_length FROM
 (SELECT read_idx, max(sample_label) AS sample_label, max(length(seq)) AS len FROM read_records WHERE read_idx IS NOT NULL GROUP BY read_idx HAVING max(length(seq)) > 0) GROUP BY sample_label""",
    "reverse_complement": f"SELECT read_idx, reverse(translate({_CLEAN}, 'ACGT', 'TGCA')) AS seq FROM ({_READS})",
    "acgt_runs": f"""WITH clean AS (SELECT read_idx, {_CLEAN} AS s FROM ({_READS})),
 bases AS (SELECT read_idx, pos FROM (SELECT read_idx, unnest(range(0, length(s))) AS pos, s FROM clean) WHERE substr(s, pos + 1, 1) <> 'N'),
 runs AS (SELECT read_idx, pos, pos - row_number() OVER (PARTITION BY read_idx ORDER BY pos) AS run FROM bases)
 SELECT read_idx, min(pos) AS start, count(*) AS length FROM runs GROUP BY read_idx, run""",
    "minimizers": f"WITH {_MINIMIZERS} SELECT read_idx, hash, CAST(pos AS INT) AS pos FROM chosen",
    "strand_index": f"""WITH {_MINIMIZERS}, lengths AS (SELECT read_idx, length(seq) AS len FROM reads)
 SELECT hash, read_idx AS target, CAST(pos AS INT) AS pos, false AS rev FROM chosen
 UNION ALL SELECT hash, read_idx, CAST(len - {K} - pos AS INT), true FROM chosen JOIN lengths USING (read_idx)""",
}
