"""A whole run: from the reads of all samples to mates, subset, sampling curve and coverage models."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.config import Settings, odd_span_window
from strandmill.functions.sketch_size import filter_parameters, fragment_length
from strandmill.operators import curve as C
from strandmill.operators import mates as M
from strandmill.operators import models as O
from strandmill.operators.alignment import aligned_mates
from strandmill.operators.greedy import kept_reads
from strandmill.operators.minimizers import minimizers, strand_index
from strandmill.operators.skew import lookup_join
from strandmill.sources import readers as R
from strandmill.sources import writers as S
from strandmill.workspace import Workspace

PARAMETERS = "sample_label string, reads long, bases long, window int, sketch_size int, minimum_hits int, p_value double, fragment_length int, recommended_window int, recommended_hits int"
#: Bits of a read number that count the reads of one file; the higher ones count the files.
READ_BITS = 40


@dataclass(frozen=True)
class Run:
    """The tables of a run; each has a ``sample_label``."""

    reads: DataFrame
    parameters: DataFrame
    mates: DataFrame
    curve: DataFrame
    summary: DataFrame
    models: DataFrame
    points: DataFrame
    curves: DataFrame
    settings: Settings


def load_samples(spark: SparkSession, samples: Sequence[tuple[str, str]]) -> DataFrame:
    """``sample_label, read_idx, id, seq`` of sequence files given as (path, label).

    Numbers keep the order of the files and of the reads within each. A file is
    FASTA if its ending says so, else FASTQ.
    """
    if not samples:
        raise ValueError("no sample is given")
    files = [(R.plain_uri(file), label) for path, label in samples for file in R.files_of(spark, path)]
    known = spark.createDataFrame([(file, label, number << READ_BITS) for number, (file, label) in enumerate(files)], "path string, sample_label string, first long")
    tables = []
    for fasta, read in ((True, R.read_fasta), (False, R.read_fastq)):
        paths = [file for file, _ in files if file.removesuffix(".gz").endswith((".fa", ".fasta")) == fasta]
        if paths:
            # one scan for all files of a kind; the list of files is given by the caller
            reads = read(spark, [R.readable(path) for path in paths]).withColumn("path", R.plain_path(F.col("path")))
            tables.append(reads.join(F.broadcast(known), "path").select("sample_label", (F.col("first") + F.col("read_idx")).alias("read_idx"), "id", "seq"))
    return tables[0] if len(tables) == 1 else tables[0].unionByName(tables[1])


def sample_parameters(samples: DataFrame, settings: Settings) -> DataFrame:
    """Window and minimum hits of every sample (sample_label, reads, bases), as set or as its mean read length asks for."""

    def derive(batches):
        for frame in batches:
            found = [filter_parameters(fragment_length(int(r), int(b), settings.k), settings.k, settings.identity, settings.p_value, settings.reference_size) for r, b in zip(frame["reads"], frame["bases"])]
            yield frame.assign(
                window=[odd_span_window(settings.k, settings.window or f.window) for f in found], sketch_size=[f.sketch_size for f in found],
                minimum_hits=[max(f.minimum_hits, 1) if settings.minimum_hits is None else settings.minimum_hits for f in found], p_value=[f.p_value for f in found], fragment_length=[fragment_length(int(r), int(b), settings.k) for r, b in zip(frame["reads"], frame["bases"])],
                recommended_window=[f.window for f in found], recommended_hits=[f.minimum_hits for f in found],
            )

    return samples.select("sample_label", "reads", "bases").mapInPandas(derive, PARAMETERS)


def find_mates(reads: DataFrame, settings: Settings, work: Workspace) -> DataFrame:
    """One row a read (sample_label, read_idx, seq, len, window, minimum_hits) with its best mate within its sample.

    One index serves all samples: the sample's name is mixed into the hash, so
    reads of different samples share no seed and occurrences are counted by
    sample. ``query, mate, rev, identity, ratio, coverage, score, matches,
    mismatches, passes, candidates, windows, aligned``; nulls where no mate was found.
    """
    found = minimizers(reads, settings.k, "window", settings.hash_seed)
    facts = reads.select("read_idx", "sample_label", "len", "minimum_hits")
    mixed = found.join(facts, "read_idx").withColumn("hash", F.xxhash64("sample_label", "hash")).drop("sample_label")
    seeds = work.keep(mixed, "seeds")
    index = strand_index(seeds.select("read_idx", "hash", "pos"), facts, settings.k)
    own = seeds.groupBy(F.col("read_idx").alias("query"), "hash").agg(F.min("pos").alias("q_pos"), F.max("minimum_hits").alias("least"))
    banded = M.bands(own, M.usable_entries(index, settings.most_occurrences), settings.diagonal_bin, "least")
    top = M.top_targets(M.best_bands(banded), settings.prefilter_targets)
    windows = M.overlaps(M.offsets(top, settings.radius, settings.step), facts, settings.least_ratio, settings.least_coverage)
    best = work.keep(M.best_windows(M.window_scores(windows, seeds, index, settings.sketch_size, settings.k)), "windows")
    by_sketch = M.sketch_mates(facts, best, settings)
    if settings.alignment_targets == 0:
        return by_sketch.select(
            "query", "mate", "rev", "identity", "ratio", "coverage", "score", F.col("shared").alias("matches"), (F.col("denominator") - F.col("shared")).alias("mismatches"), "passes", "candidates", "windows", F.col("windows").alias("aligned")
        )
    columns = ["query", "mate", "rev", "identity", "ratio", "coverage", "score", "matches", "mismatches", "passes", "aligned"]
    joined = by_sketch.select("query", "candidates", "windows").join(aligned_mates(reads, best, settings).select(*columns), "query", "left")
    return joined.select(*columns[:-2], F.coalesce("passes", F.lit(False)).alias("passes"), "candidates", "windows", F.coalesce("aligned", F.lit(0)).alias("aligned"))


def analyse(reads: DataFrame, settings: Settings | None = None) -> Run:
    """All results for reads (sample_label, read_idx, id, seq) of any number of samples.

    ``read_idx`` is unique over all samples and gives the input order; reads
    without a base are left out, reads without a label form the sample
    ``unlabelled``. The mates are written once to the shared folder; subset,
    curve and models read them from there.
    """
    settings = settings or Settings()
    work = Workspace(reads.sparkSession, "run")
    rows = reads.select(F.coalesce("sample_label", F.lit("unlabelled")).alias("sample_label"), F.col("read_idx").cast("long").alias("read_idx"), "id", "seq").where("read_idx IS NOT NULL AND seq <> ''")
    rows = work.keep(rows.withColumn("len", F.length("seq").cast("long")), "reads")
    parameters = work.keep(sample_parameters(C.totals(rows), settings), "parameters")
    sized = lookup_join(rows, parameters.select("sample_label", "window", "minimum_hits"), "sample_label", ["read_idx"])
    found = work.keep(find_mates(sized, settings, work), "mates")
    passing = found.select(F.col("query").alias("read_idx"), F.when(F.col("passes"), F.col("mate")).alias("mate"))
    kept = kept_reads(passing)
    names = rows.select(F.col("read_idx").alias("mate"), F.col("id").alias("mate_id"))
    mates = rows.drop("seq").join(found.withColumnRenamed("query", "read_idx"), "read_idx").join(kept, "read_idx").join(names, "mate", "left")
    values = work.keep(C.curve(rows.drop("seq"), passing, settings.replicates, settings.divide, settings.seed), "curve")
    summary = C.curve_summary(values)
    points = O.points_of_summary(summary)
    fits = work.keep(O.family_fits(points), "fits")
    models = O.selected_models(points, fits)
    chosen = O.family_curves(points, fits).join(models.select("sample_label", "family"), ["sample_label", "family"], "left_semi")
    return Run(rows, parameters, mates, values, summary, models, O.fitted_points(points, models), chosen, settings)


def mates_report(mates: DataFrame) -> DataFrame:
    """The mates table of a run; a dot and zeros where a read has no best mate."""
    zero = {"best_identity": "identity", "best_alignment_ratio": "ratio", "best_query_coverage": "coverage"}
    whole = {"best_score": "score", "best_matches": "matches", "best_mismatches": "mismatches"}
    return mates.select(
        "sample_label", "read_idx", S.escaped(F.col("id")).alias("query_id"), F.col("len").alias("query_len"), F.col("passes").cast("int").alias("mate_count"), F.col("candidates").alias("candidate_count"), F.col("aligned").alias("aligned_count"),
        F.coalesce(S.escaped(F.col("mate_id")), F.lit(".")).alias("best_target"), *[S.fixed(F.coalesce(F.col(c), F.lit(0.0)), 6).alias(n) for n, c in zero.items()],
        *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(n) for n, c in whole.items()], F.col("keep").alias("nonredundant"),
    )


def run_facts(run: Run) -> DataFrame:
    """``sample_label, place, key, value``: what each sample's results were made with, enough to make them again."""
    settings, p = run.settings, F.col
    counted = run.mates.groupBy("sample_label").agg(
        F.sum("candidates").alias("candidates"), F.sum("windows").alias("windows"), F.sum("aligned").alias("aligned"), F.sum(F.col("passes").cast("long")).alias("passing")
    )
    aligned = settings.alignment_targets > 0
    # Keys of a summary file
    facts = {
        "sample": p("sample_label"), "reads": p("reads"), "bases": p("bases"), "candidate_source": "shared_minimizers_in_diagonal_bins", "overlap_source": "best_offset_of_a_grid",
        "prefilter_identity_source": "bottom_k_of_minimizers_in_the_window", "identity_source": "banded_affine_alignment" if aligned else "bottom_k_of_minimizers_in_the_window",
        "final_alignment_source": "banded_affine_alignment" if aligned else "disabled", "alignment_ratio_definition": "overlap_len/min(query_len,target_len)", "query_coverage_definition": "overlap_len/query_len",
        "kmer": settings.k, "p_value": settings.p_value, "filter_fragment_len": p("fragment_length"), "filter_fragment_len_source": "mean_read_len", "reference_size": settings.reference_size,
        "filter_calibration_source": "filter_fragment_len_and_reference_size", "pvalue_recommended_minimizer_window": p("recommended_window"), "pvalue_recommended_sketch_size": p("sketch_size"),
        "pvalue_recommended_min_shared_minimizers": p("recommended_hits"), "pvalue_at_recommended_sketch_size": p("p_value"), "requested_minimizer_window": settings.window or "auto",
        "actual_minimizer_window": p("window"), "sketch_size": settings.sketch_size, "identity_threshold": settings.identity, "min_alignment_ratio": settings.least_ratio,
        "min_query_coverage": settings.least_coverage, "requested_min_shared_minimizers": "auto" if settings.minimum_hits is None else settings.minimum_hits, "actual_min_shared_minimizers": p("minimum_hits"),
        "prefilter_targets": settings.prefilter_targets, "alignment_targets": settings.alignment_targets, "alignment_targets_cap": 16, "final_bandwidth": settings.band, "max_hash_occ": settings.most_occurrences,
        "diag_bin": settings.diagonal_bin, "slide_radius": settings.radius, "slide_step": settings.step, "tab_hash_seed": settings.hash_seed, "candidate_edges": p("candidates"), "evaluated_windows": p("windows"),
        "final_alignments": p("aligned") if aligned else 0, "best_mate_only": "true", "mate_count_definition": "passing_best_mates", "resampling_effort_unit": "bases",
        "resampling_scheme": "bernoulli_reads_by_base_fraction", "redundancy_weighting": "query_bases", "passing_best_alignments": p("passing"), "replicates": settings.replicates, "divide": settings.divide, "seed": settings.seed,
    }
    entries = [F.struct(F.lit(key).alias("key"), (value if isinstance(value, Column) else F.lit(str(value))).cast("string").alias("value")) for key, value in facts.items()]
    rows = run.parameters.join(counted, "sample_label", "left").select("sample_label", F.posexplode(F.array(*entries)).alias("place", "fact"))
    return rows.select("sample_label", "place", "fact.key", F.coalesce("fact.value", F.lit("NA")).alias("value"))


def plot_of(points: DataFrame, curves: DataFrame, diversity: DataFrame) -> str:
    """The plot of points and curves (sample_label, effort, coverage) and bars (sample_label, diversity); a few hundred rows a sample."""

    def series(df: DataFrame) -> dict[str, list[tuple[float, float]]]:
        found: dict[str, list[tuple[float, float]]] = {}
        for row in df.select("sample_label", "effort", "coverage").orderBy("sample_label", "effort").collect():
            found.setdefault(row[0], []).append((row[1], row[2]))
        return found

    bars = {r[0]: r[1] for r in diversity.where("diversity IS NOT NULL").select("sample_label", "diversity").collect()}
    return S.svg_plot(series(curves), series(points), bars)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """One small text as a folder with one file."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_run(run: Run, prefix: str) -> None:
    """All tables of a run under ``prefix``, each a folder; rows in input order."""
    spark = run.reads.sparkSession
    S.write_table(run.parameters, f"{prefix}.parameters.tsv", ["sample_label"])
    shares = [S.fixed(F.col(c)).alias(c) for c in ("portion", "mean", "sd", "q1", "median", "q3")]
    S.write_table(run.summary.select("sample_label", "point", "reads", "bases", *shares), f"{prefix}.summary.tsv", ["sample_label", "point"])
    value = S.fixed(F.col("value")).alias("redundant_base_fraction")
    S.write_table(run.curve.select("sample_label", "point", S.fixed(F.col("portion")).alias("portion"), "bases", "replicate", value), f"{prefix}.all.tsv", ["sample_label", "point", "replicate"])
    S.write_table(mates_report(run.mates), f"{prefix}.mates.tsv", ["read_idx"])
    kept = run.mates.where("keep").select("read_idx")
    S.write_ids(run.reads.drop("seq").join(kept, "read_idx"), f"{prefix}.nonredundant.ids")
    S.write_fastq(run.reads.join(kept, "read_idx"), f"{prefix}.nonredundant.fastq")
    S.write_models(S.summary_lines(run.summary, run_facts(run)), f"{prefix}.summary")
    S.write_models(S.model_lines(S.with_model_facts(run.models, run.points), run.points, run.curves), f"{prefix}.model")
    write_text(spark, plot_of(run.points, run.curves, run.models), f"{prefix}.svg")
