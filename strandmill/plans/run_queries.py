"""Whole runs over the sequences of the reads table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.config import Settings
from strandmill.plans import redundancy
from strandmill.sources.tables import table


def _run(spark: SparkSession, folder: str) -> redundancy.Run:
    records = table(spark, folder, "read_records", "read_idx", "id", "seq", "sample_label").where("read_idx IS NOT NULL AND seq <> ''")
    reads = records.groupBy("read_idx").agg(F.min("id").alias("id"), F.max("seq").alias("seq"), F.max("sample_label").alias("sample_label"))
    return redundancy.analyse(reads, Settings())


def full_run_mates(spark: SparkSession, folder: str) -> DataFrame:
    """The mates table of a run from the sequences on, parameters derived for each sample."""
    return redundancy.mates_report(_run(spark, folder).mates)


def full_run_models(spark: SparkSession, folder: str) -> DataFrame:
    """The selected coverage model of every sample of a run from the sequences on."""
    return _run(spark, folder).models.drop("values")


QUERIES = {f.__name__: f for f in (full_run_mates, full_run_models)}
#: Minimizers, steps of the search and curve have their own SQL; a whole run is tested on planted copies.
SQL: dict[str, str] = {}
