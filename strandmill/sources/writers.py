"""Result tables as tab-separated files, model files and a vector plot."""

from __future__ import annotations

import colorsys
import math
import textwrap
from collections.abc import Sequence
from html import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.sources.readers import MODEL_COLUMNS

#: Steps between the hues of following samples, in twelfths of the colour circle, and the share of black from round to round.
HUE_STEP, DARKER = 5, 0.2
#: Width of a bar's label.
LABEL_WIDTH = 16
WIDTH, HEIGHT, MARGIN, CURVES = 1040, 450, 50, 0.60


def fixed(value: Column, digits: int = 8) -> Column:
    """A number with so many digits after the point, NA for null, NaN and infinity."""
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))
    return F.when(finite, F.format_string(f"%.{digits}f", value)).otherwise("NA")


def escaped(value: Column) -> Column:
    """Tabs and line breaks, which a header line may hold, as blanks."""
    return F.regexp_replace(value, r"[\t\r\n]", " ")


def write_table(df: DataFrame, path: str, order: Sequence[str] = ()) -> None:
    """Tab-separated files with a header; rows range-partitioned and sorted by ``order``, so that the files follow each other."""
    (df.orderBy(*order) if order else df).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def write_ids(kept: DataFrame, path: str) -> None:
    """Identifiers of the kept reads (read_idx, id), in input order."""
    kept.orderBy("read_idx").select(escaped(F.col("id"))).write.mode("overwrite").text(path)


def write_fastq(reads: DataFrame, path: str) -> None:
    """Reads (read_idx, id, seq) as FASTQ with the quality I throughout."""
    record = F.concat(F.lit("@"), escaped(F.col("id")), F.lit("\n"), F.col("seq"), F.lit("\n+\n"), F.repeat(F.lit("I"), F.length("seq")))
    reads.orderBy("read_idx").select(record).write.mode("overwrite").text(path)


def model_lines(models: DataFrame, points: DataFrame, curves: DataFrame) -> DataFrame:
    """``sample_label, section, place, line`` of a model file for each sample: header, observed rows, curve rows."""
    # Keys of a model file by the column that holds each; a column that the models lack gives no line
    names = {
        "family": "model_family", "parameters": "model_params", "reads": "reads", "bases": "bases", "average_read_length": "average_read_length", "coverage_factor": "coverage_factor", "kappa": "kappa",
        "observed_coverage": "C", "effort": "LR", "effort_at_target": "LRstar", "diversity": "diversity", "diversity_definition": "diversity_definition", "diversity_q99": "diversity_q99",
        "remaining_diversity": "remaining_diversity_at_observed_effort", "model_r": "modelR", "target_coverage": "target_coverage", "note": "note",
    }
    kinds = dict(models.dtypes)
    keys = [key for key in names if key in kinds]

    def text(key: str) -> Column:
        return fixed(F.col(key)) if kinds[key] == "double" else F.coalesce(F.col(key).cast("string"), F.lit("NA"))

    def known(column: str) -> Column:
        return fixed(F.col(column)) if column in points.columns else F.lit("NA")

    headers = models.select("sample_label", F.posexplode(F.array(*[F.concat(F.lit(f"# @{names[k]}: "), text(k)) for k in keys])).alias("place", "line")).withColumn("section", F.lit(0))
    titles = models.select("sample_label", F.lit(0).alias("place"), F.lit("\t".join(MODEL_COLUMNS)).alias("line"), F.lit(1).alias("section"))
    spread = [known(c) for c in ("sd", "q1", "median", "q3", "coverage", "q1_coverage", "median_coverage", "q3_coverage", "fitted_coverage")]
    observed = points.select(
        "sample_label", F.row_number().over(_by_portion()).alias("place"),
        F.concat_ws("\t", F.lit("observed"), "reads", "bases", fixed(F.col("portion")), fixed(F.col("effort")), fixed(F.col("redundancy")), *spread).alias("line"),
        F.lit(2).alias("section"),
    )
    model = curves.select(
        "sample_label", F.row_number().over(_by_effort()).alias("place"),
        F.concat_ws("\t", F.lit("model"), F.lit("."), F.lit("."), F.lit("."), fixed(F.col("effort")), *[F.lit(".")] * 5, fixed(F.col("coverage")), *[F.lit(".")] * 3, fixed(F.col("coverage"))).alias("line"),
        F.lit(3).alias("section"),
    )
    return headers.unionByName(titles).unionByName(observed).unionByName(model)


def _by_portion():
    from pyspark.sql import Window

    return Window.partitionBy("sample_label").orderBy("portion")


def _by_effort():
    from pyspark.sql import Window

    return Window.partitionBy("sample_label").orderBy("effort")


def with_model_facts(models: DataFrame, points: DataFrame, target: float = 0.95) -> DataFrame:
    """The models with what a model file says about its sample besides: read length, last effort and coverage, target."""
    last = points.groupBy("sample_label").agg(F.max_by("coverage", "portion").alias("observed_coverage"), F.max("effort").alias("effort"))
    facts = {
        "average_read_length": F.try_divide(F.col("bases").cast("double"), F.col("reads")), "coverage_factor": F.lit(1.0), "target_coverage": F.lit(target),
        "diversity_definition": F.lit("area_under_log_effort_survival_curve"),
    }
    return models.join(last, "sample_label", "left").withColumns(facts)


def summary_lines(summary: DataFrame, facts: DataFrame) -> DataFrame:
    """``sample_label, section, place, line`` of a summary file for each sample: its facts (sample_label, key, value, place), title and rows."""
    headers = facts.select("sample_label", F.lit(0).alias("section"), "place", F.concat(F.lit("# @"), "key", F.lit(": "), "value").alias("line"))
    columns = ["reads", "bases", "portion", "mean", "sd", "q1", "median", "q3"]
    titles = summary.select("sample_label").distinct().select("sample_label", F.lit(1).alias("section"), F.lit(0).alias("place"), F.lit("\t".join(columns)).alias("line"))
    values = [F.col(c).cast("string") if c in ("reads", "bases") else fixed(F.col(c)) for c in columns]
    rows = summary.select("sample_label", F.lit(2).alias("section"), F.col("point").cast("int").alias("place"), F.concat_ws("\t", *values).alias("line"))
    return headers.unionByName(titles).unionByName(rows)


def write_models(lines: DataFrame, path: str) -> None:
    """One folder a sample with its model or summary file; a sample has a few hundred lines."""
    ordered = lines.repartition("sample_label").sortWithinPartitions("sample_label", "section", "place")
    ordered.select("sample_label", "line").write.mode("overwrite").partitionBy("sample_label").text(path)


def colour(number: int) -> str:
    """Colour of the sample with this number: twelve hues, darker with each round."""
    level = 0.85 * (1 - DARKER) ** (number // 12 % 4)
    return "#" + "".join(f"{round(255 * part):02x}" for part in colorsys.hsv_to_rgb(number * HUE_STEP % 12 / 12, 0.75, level))


def short_label(label: str) -> str:
    """As many whole words of a label as fit below its bar."""
    return textwrap.shorten(label, LABEL_WIDTH, placeholder="...")


def svg_plot(curves: dict[str, list[tuple[float, float]]], dots: dict[str, list[tuple[float, float]]], bars: dict[str, float]) -> str:
    """Coverage curves and diversity bars of the samples, from series that are a few hundred points each."""
    labels = sorted(set(curves) | set(dots) | set(bars))
    efforts = [e for series in (*curves.values(), *dots.values()) for e, _ in series if e >= 1e6]
    low, high = 6.0, max([math.log10(e) for e in efforts] + [7.0])
    panel = WIDTH * CURVES

    def spot(effort: float, coverage: float) -> tuple[float, float]:
        x = MARGIN + (math.log10(max(effort, 1e6)) - low) / (high - low) * (panel - 2 * MARGIN)
        return round(x, 1), round(HEIGHT - MARGIN - min(max(coverage, 0), 1) * (HEIGHT - 2 * MARGIN), 1)

    parts = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{WIDTH}" height="{HEIGHT}"><rect width="100%" height="100%" fill="white"/>']
    tallest = max([*bars.values(), 1e-9])
    step = (WIDTH - panel - MARGIN) / max(1, len(labels))
    for n, label in enumerate(labels):
        line = " ".join("{},{}".format(*spot(e, c)) for e, c in curves.get(label, []) if e >= 1e6)
        parts.append(f'<polyline fill="none" stroke="{colour(n)}" stroke-opacity="0.6" stroke-dasharray="5 4" points="{line}"/>')
        parts += ['<circle cx="{}" cy="{}" r="2.5" fill="{}"/>'.format(*spot(e, c), colour(n)) for e, c in dots.get(label, []) if e >= 1e6]
        tall = bars.get(label, 0) / tallest * (HEIGHT - 2 * MARGIN)
        parts.append(f'<rect x="{panel + n * step:.1f}" y="{HEIGHT - MARGIN - tall:.1f}" width="{step * 0.8:.1f}" height="{tall:.1f}" fill="{colour(n)}"/>')
        parts.append(f'<text x="{panel + n * step:.1f}" y="{HEIGHT - MARGIN + 14}" font-size="9">{escape(short_label(label))}</text>')
    return "\n".join([*parts, "</svg>"])
