"""Queries of the mate search over reads, seeds and index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.config import Settings
from strandmill.operators import mates as M
from strandmill.operators.alignment import aligned_mates
from strandmill.sources.tables import table
from strandmill.workspace import Workspace

SETTINGS = Settings(window=40, minimum_hits=3)


def _reads(spark: SparkSession, folder: str) -> DataFrame:
    return M.reads_with_length(table(spark, folder, "read_records"))


def query_seeds(spark: SparkSession, folder: str) -> DataFrame:
    return M.query_seeds(table(spark, folder, "seeds"))


def usable_entries(spark: SparkSession, folder: str) -> DataFrame:
    return M.usable_entries(table(spark, folder, "index_hits"), SETTINGS.most_occurrences)


def band_stats(spark: SparkSession, folder: str) -> DataFrame:
    return M.bands(query_seeds(spark, folder), usable_entries(spark, folder), SETTINGS.diagonal_bin, SETTINGS.minimum_hits)


def best_band(spark: SparkSession, folder: str) -> DataFrame:
    return M.best_bands(band_stats(spark, folder))


def prefilter_topk(spark: SparkSession, folder: str) -> DataFrame:
    return M.top_targets(best_band(spark, folder), SETTINGS.prefilter_targets)


def _offsets(spark: SparkSession, folder: str) -> DataFrame:
    return M.offsets(prefilter_topk(spark, folder), SETTINGS.radius, SETTINGS.step)


def candidate_offsets(spark: SparkSession, folder: str) -> DataFrame:
    return _offsets(spark, folder).select("query", "target", "rev", "offset")


def _windows(spark: SparkSession, folder: str) -> DataFrame:
    return M.overlaps(_offsets(spark, folder), _reads(spark, folder), SETTINGS.least_ratio, SETTINGS.least_coverage)


def overlap_windows(spark: SparkSession, folder: str) -> DataFrame:
    return _windows(spark, folder).select("query", "target", "rev", "offset", "q_start", "t_start", "overlap", "ratio", "coverage")


def _scores(spark: SparkSession, folder: str) -> DataFrame:
    return M.window_scores(_windows(spark, folder), table(spark, folder, "seeds"), table(spark, folder, "index_hits"), SETTINGS.sketch_size, SETTINGS.k)


def bottomk_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return _scores(spark, folder).select("query", "target", "rev", "offset", "shared", "denominator")


def best_window(spark: SparkSession, folder: str) -> DataFrame:
    return M.best_windows(_scores(spark, folder)).select("query", "target", "rev", "offset", "overlap", "shared", "denominator", "evaluated")


def _mates(spark: SparkSession, folder: str) -> DataFrame:
    return M.sketch_mates(_reads(spark, folder), M.best_windows(_scores(spark, folder)), SETTINGS)


def best_mate_sketch(spark: SparkSession, folder: str) -> DataFrame:
    return _mates(spark, folder).select("query", "mate", "rev", "shared", "denominator", "hits", "passes", "candidates", "windows")


def run_stats(spark: SparkSession, folder: str) -> DataFrame:
    return M.run_counters(_mates(spark, folder))


def redundancy_kappa(spark: SparkSession, folder: str) -> DataFrame:
    """Redundant share of the bases of every sample."""
    found = _mates(spark, folder).select(F.col("query").alias("read_idx"), "passes", "len")
    labels = _reads(spark, folder).select("read_idx", "sample_label")
    grouped = found.join(labels, "read_idx").groupBy("sample_label").agg(F.sum("len").alias("bases"), F.sum(F.when(F.col("passes"), F.col("len")).otherwise(0)).alias("redundant_bases"))
    return grouped.withColumn("kappa", F.col("redundant_bases") / F.col("bases"))


def best_mate_dp(spark: SparkSession, folder: str) -> DataFrame:
    """The best mate of every read by banded alignment of its top sketch candidates."""
    work = Workspace(spark, "mates")
    best = work.keep(M.best_windows(_scores(spark, folder)), "windows")
    return aligned_mates(table(spark, folder, "read_records"), best, SETTINGS)


QUERIES = {
    f.__name__: f
    for f in (query_seeds, usable_entries, band_stats, best_band, prefilter_topk, candidate_offsets, overlap_windows, bottomk_jaccard, best_window, best_mate_sketch, run_stats, redundancy_kappa, best_mate_dp)
}

_STEPS = {
    "reads": "SELECT read_idx, min(id) AS id, max(sample_label) AS sample_label, max(length(seq)) AS len FROM read_records WHERE read_idx IS NOT NULL GROUP BY read_idx HAVING max(length(seq)) > 0",
    "qseeds": "SELECT read_idx AS query, hash, min(pos) AS q_pos FROM seeds WHERE read_idx IS NOT NULL AND hash IS NOT NULL AND pos IS NOT NULL GROUP BY ALL",
    "entries": "SELECT DISTINCT hash, target, pos, rev FROM index_hits WHERE hash IS NOT NULL AND target IS NOT NULL AND pos IS NOT NULL AND rev IS NOT NULL",
    "usable": "SELECT hash, target, pos, rev FROM entries QUALIFY count(*) OVER (PARTITION BY hash) <= 128",
    "hits": "SELECT query, target, rev, q_pos, CAST(pos - q_pos AS BIGINT) AS diag FROM qseeds JOIN usable USING (hash) WHERE query <> target",
    "bands": """SELECT query, target, rev, CAST(floor(diag / 1000.0) AS BIGINT) AS bin, count(DISTINCT q_pos) AS hits, CAST(sum(diag) AS BIGINT) // count(*) AS center,
 min(diag) AS min_diag, max(diag) AS max_diag FROM hits GROUP BY query, target, rev, CAST(floor(diag / 1000.0) AS BIGINT) HAVING count(DISTINCT q_pos) >= 3""",
    "best": "SELECT * FROM bands QUALIFY row_number() OVER (PARTITION BY query, target, rev ORDER BY hits DESC, max_diag - min_diag, bin) = 1",
    "top": "SELECT *, row_number() OVER (PARTITION BY query ORDER BY hits DESC, target, rev) AS place FROM best QUALIFY row_number() OVER (PARTITION BY query ORDER BY hits DESC, target, rev) <= 16",
    "placed": """SELECT DISTINCT top.*, o.offset FROM top, LATERAL (SELECT unnest(list_concat([center, min_diag, max_diag],
 generate_series(least(min_diag, center - 3000), greatest(max_diag, center + 3000), 500))) AS "offset") o""",
    "lapped": """SELECT p.*, q.len AS q_len, t.len AS t_len, greatest(0, -p.offset) AS q_start, greatest(0, p.offset) AS t_start,
 least(q.len - greatest(0, -p.offset), t.len - greatest(0, p.offset)) AS overlap FROM placed p JOIN reads q ON q.read_idx = p.query JOIN reads t ON t.read_idx = p.target""",
    "windows": "SELECT *, overlap / least(q_len, t_len) AS ratio, overlap / q_len AS coverage FROM lapped WHERE overlap > 0 AND overlap / least(q_len, t_len) >= 0.5 AND overlap / q_len >= 0.75",
    "inside": """SELECT w.query, w.target, w.rev, w.offset, s.hash, 1 AS q, 0 AS t FROM windows w JOIN seeds s ON s.read_idx = w.query AND s.pos >= w.q_start AND s.pos < w.q_start + w.overlap WHERE s.hash IS NOT NULL
 UNION ALL SELECT w.query, w.target, w.rev, w.offset, e.hash, 0, 1 FROM windows w JOIN entries e ON e.target = w.target AND e.rev = w.rev AND e.pos >= w.t_start AND e.pos < w.t_start + w.overlap""",
    "merged": 'SELECT query, target, rev, "offset", hash, max(q) + max(t) AS sides FROM inside GROUP BY ALL',
    "smallest": 'SELECT * FROM merged QUALIFY row_number() OVER (PARTITION BY query, target, rev, "offset" ORDER BY hash) <= 128',
    "counted": 'SELECT query, target, rev, "offset", CAST(sum(CASE WHEN sides = 2 THEN 1 ELSE 0 END) AS BIGINT) AS shared, count(*) AS denominator FROM smallest GROUP BY ALL',
    "scored": """SELECT w.*, coalesce(c.shared, 0) AS shared, coalesce(c.denominator, 0) AS denominator, CASE WHEN coalesce(c.shared, 0) = 0 THEN 0.0 WHEN c.shared = c.denominator THEN 1.0
 ELSE 1 - greatest(least(-ln(2 * (c.shared / c.denominator) / (1 + c.shared / c.denominator)) / 16.0, 1.0), 0.0) END AS identity
 FROM windows w LEFT JOIN counted c ON c.query = w.query AND c.target = w.target AND c.rev = w.rev AND c.offset = w.offset""",
    "chosen": """SELECT *, count(*) OVER (PARTITION BY query, target, rev) AS evaluated FROM scored
 QUALIFY row_number() OVER (PARTITION BY query, target, rev ORDER BY identity DESC, ratio DESC, overlap DESC, abs("offset"), "offset") = 1""",
    "mates": """SELECT r.read_idx AS query, r.len, m.target AS mate, m.rev, m.shared, m.denominator, m.hits,
 coalesce(m.identity >= 0.95 AND m.ratio >= 0.5 AND m.coverage >= 0.75, false) AS passes, coalesce(n.candidates, 0) AS candidates, CAST(coalesce(n.windows, 0) AS BIGINT) AS windows
 FROM reads r LEFT JOIN (SELECT * FROM chosen QUALIFY row_number() OVER (PARTITION BY query ORDER BY identity DESC, coverage DESC, ratio DESC, overlap DESC, hits DESC, target, rev) = 1) m ON m.query = r.read_idx
 LEFT JOIN (SELECT query, count(*) AS candidates, sum(evaluated) AS windows FROM chosen GROUP BY query) n ON n.query = r.read_idx""",
}


def _sql(select: str) -> str:
    return "WITH " + ",\n".join(f"{name} AS ({body})" for name, body in _STEPS.items()) + "\n" + select


SQL = {
    "query_seeds": _sql("SELECT query, hash, q_pos FROM qseeds"),
    "usable_entries": _sql("SELECT hash, target, pos, rev FROM usable"),
    "band_stats": _sql("SELECT query, target, rev, bin, hits, center, min_diag, max_diag FROM bands"),
    "best_band": _sql("SELECT query, target, rev, bin, hits, center, min_diag, max_diag FROM best"),
    "prefilter_topk": _sql("SELECT query, target, rev, bin, hits, center, min_diag, max_diag, place FROM top"),
    "candidate_offsets": _sql('SELECT query, target, rev, "offset" FROM placed'),
    "overlap_windows": _sql('SELECT query, target, rev, "offset", q_start, t_start, overlap, ratio, coverage FROM windows'),
    "bottomk_jaccard": _sql('SELECT query, target, rev, "offset", shared, denominator FROM scored'),
    "best_window": _sql('SELECT query, target, rev, "offset", overlap, shared, denominator, evaluated FROM chosen'),
    "best_mate_sketch": _sql("SELECT query, mate, rev, shared, denominator, hits, passes, candidates, windows FROM mates"),
    "run_stats": _sql("""SELECT count(*) AS reads, CAST(sum(len) AS BIGINT) AS bases, CAST(sum(candidates) AS BIGINT) AS candidates, CAST(sum(windows) AS BIGINT) AS windows,
 CAST(sum(passes::INT) AS BIGINT) AS passing, CAST(sum(CASE WHEN passes THEN len ELSE 0 END) AS BIGINT) AS redundant_bases FROM mates"""),
    "redundancy_kappa": _sql("""SELECT sample_label, CAST(sum(m.len) AS BIGINT) AS bases, CAST(sum(CASE WHEN passes THEN m.len ELSE 0 END) AS BIGINT) AS redundant_bases,
 CAST(sum(CASE WHEN passes THEN m.len ELSE 0 END) AS BIGINT) / CAST(sum(m.len) AS BIGINT) AS kappa FROM mates m JOIN reads r ON r.read_idx = m.query GROUP BY sample_label"""),
}
