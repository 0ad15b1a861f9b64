"""Command line: ``python -m strandmill coverage | plot | models``."""

from __future__ import annotations

import argparse
import dataclasses

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.config import Settings
from strandmill.operators import models as O
from strandmill.plans import redundancy
from strandmill.sources import readers as R
from strandmill.sources import writers as S


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strandmill", description="Redundancy and coverage of samples of long sequences.")
    commands = top.add_subparsers(dest="command", required=True)
    coverage = commands.add_parser("coverage", help="reads to mates, subset, sampling curve and models")
    source = coverage.add_mutually_exclusive_group(required=True)
    source.add_argument("--input", help="one FASTA or FASTQ file, gzipped or not")
    source.add_argument("--list", help="a file with a path and, optionally, a label a line")
    coverage.add_argument("--prefix", required=True, help="start of the names of all results")
    for field in dataclasses.fields(Settings):
        kind = type(field.default) if field.default is not None else int
        coverage.add_argument("--" + field.name.replace("_", "-"), type=kind, default=field.default)
    plot = commands.add_parser("plot", help="one plot of several model files")
    compare = commands.add_parser("models", help="fits of all families to the points of a model file")
    for command in (plot, compare):
        command.add_argument("--model", action="append", default=[], help="a model file; may be repeated")
        command.add_argument("--prefix", required=True)
    plot.add_argument("--label", action="append", default=[], help="a label for each model file, in their order")
    plot.add_argument("--list", help="a file with a model file and, optionally, a label a line")
    compare.add_argument("--target-coverage", type=float, default=0.95)
    compare.add_argument("--quantile", type=float, default=0.99)
    return top


def named_models(spark: SparkSession, files: list[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """Headers (sample_label, header) and rows of model files given as (path, label)."""
    if not files:
        raise ValueError("no model file is given")
    known = [(R.plain_uri(file), label) for path, label in files for file in R.files_of(spark, path)]
    labels = F.broadcast(spark.createDataFrame(known, "path string, sample_label string"))
    headers, rows = R.read_models(spark, *[R.readable(file) for file, _ in known])
    named = R.model_headers(headers).withColumn("path", R.plain_path(F.col("path"))).join(labels, "path").select("sample_label", "header")
    return named, rows.withColumn("path", R.plain_path(F.col("path"))).join(labels, "path").drop("path")


def model_files(spark: SparkSession, arguments: argparse.Namespace) -> list[tuple[str, str]]:
    """Paths and labels of the model files that the command line names; labels given there go with the files in their order."""
    files = []
    if arguments.model:
        given = spark.createDataFrame(list(enumerate(arguments.model)), "number int, path string").select("number", "path", R.model_label(F.col("path")).alias("label"))
        files = [(r["path"], r["label"]) for r in given.orderBy("number").collect()]
    if getattr(arguments, "list", None):
        files += [(r["path"], r["label"]) for r in R.read_model_list(spark, arguments.list).collect()]
    labels = getattr(arguments, "label", [])
    if labels and len(labels) != len(files):
        raise ValueError(f"{len(labels)} labels are given for {len(files)} model files")
    return [(path, label) for (path, _), label in zip(files, labels)] if labels else files


def run_coverage(spark: SparkSession, arguments: argparse.Namespace) -> None:
    settings = Settings(**{f.name: getattr(arguments, f.name) for f in dataclasses.fields(Settings)})
    if arguments.list:
        samples = [(r["path"], r["label"]) for r in R.read_sample_list(spark, arguments.list).collect()]
    else:
        path = spark.createDataFrame([(arguments.input,)], "path string")
        samples = [(r["path"], r["label"]) for r in path.select("path", R.inferred_label(F.col("path")).alias("label")).collect()]
    redundancy.write_run(redundancy.analyse(redundancy.load_samples(spark, samples), settings), arguments.prefix)


def run_plot(spark: SparkSession, arguments: argparse.Namespace) -> None:
    headers, rows = named_models(spark, model_files(spark, arguments))
    series = rows.select("sample_label", "kind", F.col("adjusted_effort_bp").alias("effort"), F.coalesce("coverage", F.lit(0.0)).alias("coverage")).where("effort > 0")
    bars = headers.select("sample_label", R.optional(F.col("header")["diversity"], "double").alias("diversity"))
    redundancy.write_text(spark, redundancy.plot_of(series.where("kind = 'observed'"), series.where("kind = 'model'"), bars), f"{arguments.prefix}.svg")


def run_models(spark: SparkSession, arguments: argparse.Namespace) -> None:
    _, rows = named_models(spark, model_files(spark, arguments))
    points = rows.where("kind = 'observed'").select("sample_label", "portion", "reads", "bases", F.col("redundant_fraction").alias("redundancy"), O.within_one(F.col("coverage")).alias("coverage"), F.col("adjusted_effort_bp").alias("effort"))
    fits = O.family_fits(points, arguments.target_coverage, arguments.quantile)
    shown = [S.fixed(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in fits.dtypes if c != "values"]
    S.write_table(fits.select(*shown), f"{arguments.prefix}.families.tsv", ["sample_label", F.col("bic").cast("double")])
    S.write_table(O.family_curves(points, fits), f"{arguments.prefix}.curves.tsv", ["sample_label", "family", "effort"])


def main(words: list[str] | None = None, spark: SparkSession | None = None) -> None:
    arguments = parser().parse_args(words)
    spark = spark or SparkSession.builder.appName("strandmill").getOrCreate()
    {"coverage": run_coverage, "plot": run_plot, "models": run_models}[arguments.command](spark, arguments)


if __name__ == "__main__":
    main()
