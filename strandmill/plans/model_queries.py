"""Queries of the coverage models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.functions.families import gamma_p
from strandmill.operators import models as M
from strandmill.sources.tables import table


def model_points_clean(spark: SparkSession, folder: str) -> DataFrame:
    return M.clean_points(table(spark, folder, "model_points"))


def _rounded(column: str):
    return F.floor(F.col(column) * 1e6 + 0.5) / F.lit(1e6)


def fit_input(spark: SparkSession, folder: str) -> DataFrame:
    return M.fit_input(model_points_clean(spark, folder)).withColumn("x", _rounded("x"))


def fit_transition(spark: SparkSession, folder: str) -> DataFrame:
    """Where each sample's curve first crosses a coverage of one tenth, between neighbouring points."""
    from pyspark.sql import Window as W

    order = W.partitionBy("sample_label").orderBy("x")
    steps = M.fit_input(model_points_clean(spark, folder)).withColumns({"before_x": F.lag("x").over(order), "before_y": F.lag("y").over(order)})
    crossing = steps.where("(before_y - 0.1D) * (y - 0.1D) <= 0 AND y <> before_y")
    spot = F.col("before_x") + (F.lit(0.1) - F.col("before_y")) * (F.col("x") - F.col("before_x")) / (F.col("y") - F.col("before_y"))
    return crossing.groupBy("sample_label").agg(F.min_by(spot, "x").alias("crossing")).withColumn("crossing", _rounded("crossing"))


def half_transition(spark: SparkSession, folder: str) -> DataFrame:
    """Where each sample's curve first crosses a coverage of one half, else its last point."""
    found = M.transition(M.fit_input(model_points_clean(spark, folder)))
    return found.select("sample_label", _rounded("transition").alias("transition"))


def burr_cdf(spark: SparkSession, folder: str) -> DataFrame:
    """The Burr XII family with fixed parameters at the effort of every model point."""
    points = model_points_clean(spark, folder).where("effort > 0")
    return points.select("sample_label", "portion", M.burr_coverage(F.log1p("effort"), 20.0, 3.0, 2.0).alias("coverage")).withColumn("coverage", _rounded("coverage"))


def gamma_cdf(spark: SparkSession, folder: str) -> DataFrame:
    """The gamma family with fixed parameters at the effort of every model point."""

    def evaluate(batches):
        for frame in batches:
            yield frame.assign(coverage=gamma_p(20.0, 1.5 * np.log1p(frame["effort"].to_numpy())))[["sample_label", "portion", "coverage"]]

    points = model_points_clean(spark, folder).where("effort > 0").select("sample_label", "portion", "effort")
    return points.mapInPandas(evaluate, "sample_label string, portion double, coverage double").withColumn("coverage", _rounded("coverage"))


def family_fits(spark: SparkSession, folder: str) -> DataFrame:
    return M.family_fits(model_points_clean(spark, folder)).drop("values")


def selected_models(spark: SparkSession, folder: str) -> DataFrame:
    points = model_points_clean(spark, folder)
    return M.selected_models(points, M.family_fits(points)).drop("values")


def family_curves(spark: SparkSession, folder: str) -> DataFrame:
    points = model_points_clean(spark, folder)
    return M.family_curves(points, M.family_fits(points))


def plot_guides(spark: SparkSession, folder: str) -> DataFrame:
    return M.guides(model_points_clean(spark, folder))


def plot_points(spark: SparkSession, folder: str) -> DataFrame:
    """The dots of the coverage plot: efforts from a million bases on."""
    return model_points_clean(spark, folder).where("effort >= 1e6").select("sample_label", "effort", "coverage")


def plot_bars(spark: SparkSession, folder: str) -> DataFrame:
    """The bars of the diversity plot: samples that have a model."""
    points = model_points_clean(spark, folder)
    return M.selected_models(points, M.family_fits(points)).where("diversity IS NOT NULL").select("sample_label", "diversity", "diversity_q99")


QUERIES = {f.__name__: f for f in (model_points_clean, fit_input, fit_transition, half_transition, burr_cdf, gamma_cdf, family_fits, selected_models, family_curves, plot_guides, plot_points, plot_bars)}


def _one(column: str) -> str:
    return f"least(greatest(CASE WHEN isnan({column}) THEN 0 ELSE coalesce({column}, 0) END, 0), 1)"


_POINTS = f"""points AS (SELECT sample_label, floor(portion * 1e10 + 0.5) / 1e10 AS portion, max(n_reads) AS reads, max(n_bases) AS bases, max({_one('redundancy')}) AS redundancy, max({_one('coverage')}) AS coverage,
 max(adjusted_effort) AS effort, max(fitted_coverage) AS fitted_coverage FROM model_points WHERE sample_label IS NOT NULL AND portion IS NOT NULL GROUP BY sample_label, floor(portion * 1e10 + 0.5) / 1e10),
fits AS (SELECT sample_label, portion, ln(1 + effort) AS x, coverage AS y FROM points WHERE coverage > 0 AND coverage < 0.9 AND effort > 0)"""
_R = "floor(({0}) * 1e6 + 0.5) / 1e6"

SQL = {
    "model_points_clean": f"WITH {_POINTS} SELECT * FROM points",
    "fit_input": f"WITH {_POINTS} SELECT sample_label, portion, {_R.format('x')} AS x, y FROM fits",
    "fit_transition": f"""WITH {_POINTS}, steps AS (SELECT *, lag(x) OVER w AS bx, lag(y) OVER w AS b FROM fits WINDOW w AS (PARTITION BY sample_label ORDER BY x))
 SELECT sample_label, {_R.format('min_by(bx + (0.1 - b) * (x - bx) / (y - b), x)')} AS crossing FROM steps WHERE (b - 0.1) * (y - 0.1) <= 0 AND y <> b GROUP BY sample_label""",
    "half_transition": f"""WITH {_POINTS}, steps AS (SELECT *, lag(x) OVER w AS bx, lag(y) OVER w AS b FROM fits WINDOW w AS (PARTITION BY sample_label ORDER BY x)),
 places AS (SELECT *, CASE WHEN (b - 0.5) * (y - 0.5) <= 0 THEN bx + (CASE WHEN abs(y - b) < 1e-12 THEN 0.5 ELSE greatest(0, least(1, (0.5 - b) / (y - b))) END) * (x - bx) END AS place FROM steps)
 SELECT sample_label, {_R.format('coalesce(min_by(place, x) FILTER (place IS NOT NULL), max(x))')} AS transition FROM places GROUP BY sample_label""",
    "burr_cdf": f"WITH {_POINTS} SELECT sample_label, portion, {_R.format('1 - pow(1 + pow(ln(1 + effort) / 20, 3), -2)')} AS coverage FROM points WHERE effort > 0",
    "gamma_cdf": f"""WITH {_POINTS}, z AS (SELECT sample_label, portion, 1.5::DOUBLE * ln(1 + effort) AS z FROM points WHERE effort > 0),
 terms AS (SELECT sample_label, portion, exp(20 * ln(z) - z + n * ln(z) - lgamma(21.0::DOUBLE + n)) AS t FROM z CROSS JOIN range(0, 400) r(n))
 SELECT sample_label, portion, {_R.format('sum(t)')} AS coverage FROM terms GROUP BY sample_label, portion""",
    "plot_guides": f"""WITH {_POINTS}, last AS (SELECT * FROM points WHERE effort > 0 QUALIFY row_number() OVER (PARTITION BY sample_label ORDER BY effort DESC, portion DESC) = 1)
 SELECT sample_label, greatest(least(effort, 1e13), 1e6)::DOUBLE AS current_effort, {_one('coverage')} AS observed_coverage, {_one('coalesce(fitted_coverage, coverage)')} AS matched_coverage FROM last""",
    "plot_points": f"WITH {_POINTS} SELECT sample_label, effort, coverage FROM points WHERE effort >= 1e6",
}
