"""Sequence files, sample lists and model files as DataFrames."""

from __future__ import annotations

import os
import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: File endings that are no part of a sample's name, longest first.
READ_ENDINGS = (".fastq.gz", ".fasta.gz", ".fq.gz", ".fa.gz", ".fastq", ".fasta", ".fq", ".fa")
MODEL_ENDING = ".model.tsv"
#: Columns of a model file and what stands for a missing value.
MODEL_COLUMNS = (
    "kind", "reads", "bases", "portion", "adjusted_effort_bp", "redundant_fraction", "sd", "q1", "median", "q3",
    "coverage", "q1_coverage", "median_coverage", "q3_coverage", "fitted_coverage",
)
MISSING = ("NA", ".", "none", "")
#: What a model file means where a key is absent.
MODEL_DEFAULTS = {"model_family": "gamma", "coverage_factor": "1", "target_coverage": ".95"}


def numbered(lines: DataFrame, name: str = "number") -> DataFrame:
    """Number the rows of text files (columns path, block, value) from 0, file by file, in their order.

    Rows are counted for each block of a file; the blocks' offsets are summed in
    a window over the few blocks of a file, and only within a block rows are
    numbered one by one.
    """
    placed = lines.withColumn("__at", F.monotonically_increasing_id())
    inner = W.partitionBy("path", "block").orderBy("__at")
    counts = placed.groupBy("path", "block").agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("path", "block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return placed.withColumn("__in", F.row_number().over(inner) - 1).join(offsets, ["path", "block"]).withColumn(name, F.col("__in") + F.col("__before")).drop("__at", "__in", "__before")


def files_of(spark: SparkSession, path: str) -> list[str]:
    """The files of a path, a pattern or a folder, by name; none is an error."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for status in system.globStatus(place) or []:
        inner = system.listStatus(status.getPath()) if status.isDirectory() else [status]
        found += [s.getPath().toUri().toString() for s in inner if s.isFile() and not s.getPath().getName().startswith(("_", "."))]
    if not found:
        raise FileNotFoundError(path)
    return sorted(found)


def plain_uri(uri: str) -> str:
    """A file's address with one slash after the scheme of a local file."""
    return re.sub("^file:/+", "file:/", uri)


def plain_path(path: Column) -> Column:
    """:func:`plain_uri` of a column."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def readable(uri: str) -> str:
    """The address as a path for a reader."""
    return unquote(uri)


def text_rows(spark: SparkSession, path: str | list[str], separator: str = "\n") -> DataFrame:
    """``path, block, value`` of text files, gzipped ones included (those are one block each)."""
    rows = spark.read.option("lineSep", separator).text(path)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.regexp_replace("value", "\r", "").alias("value"))


def normalized(sequence: Column) -> Column:
    """Upper case without blanks; anything but A, C, G, T and N becomes N, U becomes T."""
    return F.regexp_replace(F.translate(F.upper(F.regexp_replace(sequence, r"\s", "")), "U", "T"), "[^ACGTN]", "N")


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``path, read_idx, id, seq`` of FASTA files. The whole header line is the id; reads without bases are left out but keep their number."""
    records = text_rows(spark, path, "\n>").withColumn("value", F.regexp_replace("value", r"^>", "")).where("value <> ''")
    parts = F.split("value", "\n", 2)
    named = numbered(records, "read_idx").select("path", "read_idx", F.get(parts, F.lit(0)).alias("id"), normalized(F.coalesce(F.get(parts, F.lit(1)), F.lit(""))).alias("seq"))
    return named.where("seq <> ''")


def read_fastq(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``path, read_idx, id, seq`` of FASTQ files of four lines a record; qualities are dropped, reads without bases left out."""
    lines = numbered(text_rows(spark, path), "line").where("value <> '' OR line % 4 <> 0").withColumn("read_idx", F.expr("line div 4"))
    kept = lines.where("line % 4 < 2").groupBy("path", "read_idx").agg(F.max(F.when(F.col("line") % 4 == 0, F.col("value"))).alias("id"), F.max(F.when(F.col("line") % 4 == 1, F.col("value"))).alias("seq"))
    named = kept.select("path", "read_idx", F.regexp_replace("id", "^@", "").alias("id"), normalized(F.coalesce("seq", F.lit(""))).alias("seq"))
    return named.where("id IS NOT NULL AND seq <> ''")


def sanitized(label: Column) -> Column:
    """Anything but letters, digits, underscore and hyphen becomes an underscore; none at the ends."""
    return F.regexp_replace(F.regexp_replace(label, "[^A-Za-z0-9_-]", "_"), "^_+|_+$", "")


def inferred_label(path: Column) -> Column:
    """The file's name without its ending, sanitized."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    endings = "|".join(e.replace(".", r"\.") for e in READ_ENDINGS)
    return sanitized(F.regexp_replace(name, f"(?:{endings})$", ""))


def listed(spark: SparkSession, path: str, blanks_in_label: bool) -> DataFrame:
    rows = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#.*)?$")).select(F.trim("value").alias("value"))
    fields = F.split("value", r"\s+", 2 if blanks_in_label else -1)
    return rows.select(F.get(fields, F.lit(0)).alias("path"), F.get(fields, F.lit(1)).alias("label"))


def read_sample_list(spark: SparkSession, path: str) -> DataFrame:
    """``path, label`` of a sample list: blank and # lines are skipped, a label is sanitized, else inferred from the path.

    Empty and repeated labels are errors: two samples would overwrite each other.
    """
    samples = listed(spark, path, False).select("path", F.when(F.col("label").isNotNull(), sanitized(F.col("label"))).otherwise(inferred_label(F.col("path"))).alias("label"))
    wrong = samples.groupBy("label").count().where("label = '' OR count > 1").limit(5).collect()
    if wrong:
        raise ValueError(f"labels must be unique and not empty: {[r['label'] for r in wrong]}")
    return samples


def read_model_list(spark: SparkSession, path: str) -> DataFrame:
    """``path, label`` of a model list: labels may hold blanks; relative paths start at the list's folder."""
    folder = os.path.dirname(os.path.abspath(path.removeprefix("file://")))
    rows = listed(spark, path, True)
    placed = F.when(F.col("path").rlike("^(/|[a-z0-9]+:)"), F.col("path")).otherwise(F.concat(F.lit(folder + "/"), F.col("path")))
    return rows.select(placed.alias("path"), F.coalesce("label", model_label(F.col("path"))).alias("label"))


def model_label(path: Column) -> Column:
    """A model file's name without its ending."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(\.model)?\.tsv$", "")


def optional(value: Column, kind: str) -> Column:
    return F.when(value.isin(*MISSING), None).otherwise(value).cast(kind)


def read_models(spark: SparkSession, *paths: str) -> tuple[DataFrame, DataFrame]:
    """Headers and rows of model files: ``path, key, value`` and ``path, n, kind, reads ...`` with null for a missing value.

    A row with another number of columns, and a file without an observed row,
    are errors when the result is computed.
    """
    lines = numbered(text_rows(spark, list(paths)), "n").where("value <> ''")
    headers = lines.where("startswith(value, '#')").select("path", F.regexp_extract("value", r"^#\s*@(\w+):\s*(.*)$", 1).alias("key"), F.trim(F.regexp_extract("value", r"^#\s*@(\w+):\s*(.*)$", 2)).alias("value")).where("key <> ''")
    body = lines.where("NOT startswith(value, '#') AND NOT startswith(value, 'kind\t')").withColumn("fields", F.split("value", "\t"))
    checked = F.when(F.size("fields") == len(MODEL_COLUMNS), F.col("fields")).otherwise(F.raise_error(F.concat(F.lit("a model row has not 15 columns: "), "value")))
    kinds = {"kind": "string", "reads": "bigint", "bases": "bigint"}
    rows = body.withColumn("f", checked).select("path", "n", *[optional(F.element_at("f", i + 1), kinds.get(c, "double")).alias(c) for i, c in enumerate(MODEL_COLUMNS)])
    return headers, rows


def model_headers(headers: DataFrame) -> DataFrame:
    """One row a file with a map of its header keys, defaults filled in."""
    given = headers.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("given"))
    defaults = F.create_map(*[F.lit(x) for pair in MODEL_DEFAULTS.items() for x in pair])
    return given.select("path", F.map_concat(F.map_filter(defaults, lambda k, v: ~F.map_contains_key("given", k)), "given").alias("header"))
