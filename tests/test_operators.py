import datetime
import random

from pyspark.sql import functions as F

from strandmill.functions import sequences as S
from strandmill.operators import curve as C
from strandmill.operators import mates as M
from strandmill.operators import models
from strandmill.operators.alignment import aligned_mates
from strandmill.operators.greedy import kept_reads
from strandmill.operators.minimizers import minimizers, strand_index
from strandmill.config import Settings


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_sequence_functions(spark):
    df = spark.createDataFrame([(1, "ACGUn-t"), (2, ""), (3, None), (4, "NNACNNgg")], "read_idx long, seq string")
    assert {r[0]: r[1] for r in df.select("read_idx", S.reverse_complement(F.col("seq"))).collect()} == {1: "ANNACGT", 2: "", 3: None, 4: "CCNNGTNN"}
    assert rows(S.known_runs(df, "read_idx", "seq")) == [(1, 0, "ACGT"), (1, 6, "T"), (4, 2, "AC"), (4, 6, "GG")]
    values = spark.createDataFrame([([4.0, 1.0, 3.0, 2.0],), ([],)], "v array<double>")
    assert [r[0] for r in values.select(S.nearest_rank(F.col("v"), 0.25)).collect()] == [2.0, None]
    similar = spark.createDataFrame([(0.0,), (1.0,), (None,), (0.5,)], "j double").select(S.identity_of_similarity(F.col("j"), 16))
    assert [round(r[0], 4) for r in similar.collect()] == [0.0, 1.0, 0.0, round(1 + __import__("math").log(2 / 3) / 16, 4)]


def test_bands_floor_bins_and_cut_center(spark):
    seeds = spark.createDataFrame([(1, 10, 5), (1, 11, 8), (1, 12, 2000), (2, 99, 0)], "query long, hash long, q_pos int")
    entries = spark.createDataFrame([(10, 7, 0, False), (11, 7, 2, False), (12, 7, 1999, True), (10, 1, 5, True)], "hash long, target long, pos int, rev boolean")
    assert rows(M.bands(seeds, entries, 1000, 1)) == [(1, 7, False, -1, 2, -5, -6, -5), (1, 7, True, -1, 1, -1, -1, -1)]
    assert rows(M.bands(seeds, entries, 1000, 3)) == []


def test_heavy_hash_is_cut_at_its_bound(spark):
    hits = [(h, t, 0, rev) for h, n in ((1, 64), (2, 65)) for t in range(n) for rev in (False, True)]
    df = spark.createDataFrame(hits + hits[:5] + [(1, None, 0, True)], "hash long, target long, pos int, rev boolean")
    kept = M.usable_entries(df, 128)
    assert kept.select("hash").distinct().collect()[0][0] == 1 and kept.count() == 128


def test_top_targets_hold_both_strands(spark):
    df = spark.createDataFrame([(1, 5, False, 0, 9, 0, 0, 0), (1, 5, True, 0, 9, 0, 0, 0), (1, 4, False, 0, 9, 0, 0, 0), (1, 6, False, 0, 10, 0, 0, 0)], "query long, target long, rev boolean, bin long, hits long, center long, min_diag long, max_diag long")
    assert [(r["target"], r["rev"]) for r in M.top_targets(df, 3).orderBy("place").collect()] == [(6, False), (4, False), (5, False)]


def test_overlaps(spark):
    reads = spark.createDataFrame([(1, 100), (2, 80)], "read_idx long, len long")
    placed = spark.createDataFrame([(1, 2, 50), (1, 2, -40), (1, 2, 80), (1, 2, -100)], "query long, target long, offset long")
    found = M.overlaps(placed, reads, 0.0, 0.0).select("offset", "q_start", "t_start", "overlap")
    assert rows(found) == [(-40, 40, 0, 60), (50, 0, 50, 30)]


def test_failing_best_hides_passing_second(spark):
    best = [(1, 2, False, 9, 1, 0, 0, 0, 70, 100, 100, 0.7, 0.70, 5, 5, 0.99, 3), (1, 3, False, 9, 2, 0, 0, 0, 90, 100, 100, 0.9, 0.90, 5, 6, 0.96, 2)]
    names = "query long, target long, rev boolean, hits long, place long, offset long, q_start long, t_start long, overlap long, q_len long, t_len long, ratio double, coverage double, shared long, denominator long, identity double, evaluated long"
    reads = spark.createDataFrame([(1, "a", "s", 100), (9, "b", "s", 50)], "read_idx long, id string, sample_label string, len long")
    found = {r["query"]: r for r in M.sketch_mates(reads, spark.createDataFrame(best, names), Settings()).collect()}
    assert (found[1]["mate"], found[1]["passes"], found[1]["candidates"], found[1]["windows"]) == (2, False, 2, 5)
    assert (found[9]["mate"], found[9]["passes"], found[9]["candidates"]) == (None, False, 0)
    assert M.run_counters(M.sketch_mates(reads, spark.createDataFrame(best, names), Settings())).collect()[0]["passing"] == 0


def test_whole_search_finds_copies_on_both_strands(spark):
    rng = random.Random(2)
    base = ["".join(rng.choice("ACGT") for _ in range(600)) for _ in range(12)]
    turned = base[0].translate(str.maketrans("ACGT", "TGCA"))[::-1]
    noisy = base[1][:300] + "N" * 4 + base[1][304:]
    reads = [(i, f"r{i}", "s", q) for i, q in enumerate([*base, turned, noisy])]
    records = spark.createDataFrame(reads, "read_idx long, id string, sample_label string, seq string")
    seeds = minimizers(records, 16, 20)
    sized = M.reads_with_length(records)
    index = strand_index(seeds, sized, 16)
    bands = M.bands(M.query_seeds(seeds), M.usable_entries(index, 128), 1000, 3)
    top = M.top_targets(M.best_bands(bands), 16)
    windows = M.overlaps(M.offsets(top, 3000, 500), sized, 0.5, 0.75)
    settings = Settings(identity=0.9)
    best = M.best_windows(M.window_scores(windows, seeds, index, 128, 16))
    found = {r["query"]: r["mate"] for r in M.sketch_mates(sized, best, settings).where("passes").collect()}
    assert found == {0: 12, 12: 0, 1: 13, 13: 1}
    aligned = {r["query"]: (r["mate"], r["rev"], r["edits"], r["passes"]) for r in aligned_mates(records, best, settings).collect()}
    assert aligned == {0: (12, True, 0, True), 12: (0, True, 0, True), 1: (13, False, 4, True), 13: (1, False, 4, True)}


def test_search_of_empty_tables(spark):
    records = spark.createDataFrame([], "read_idx long, id string, sample_label string, seq string")
    seeds = minimizers(records, 16, 20)
    sized = M.reads_with_length(records)
    bands = M.bands(M.query_seeds(seeds), M.usable_entries(strand_index(seeds, sized, 16), 128), 1000, 3)
    assert M.offsets(M.top_targets(M.best_bands(bands), 16), 3000, 500).count() == 0


def greedy(mates):
    kept = set()
    for read in sorted(mates):
        if mates[read] not in kept:
            kept.add(read)
    return kept


def test_greedy_equals_loop(spark):
    rng = random.Random(6)
    mates = {i: i - 1 for i in range(1, 300)} | {0: None} | {i: rng.choice([None, rng.randrange(0, 500), 9999]) for i in range(300, 500)}
    mates = {k: (None if v == k else v) for k, v in mates.items()}
    found = kept_reads(spark.createDataFrame(list(mates.items()), "read_idx long, mate long"))
    assert {r["read_idx"] for r in found.where("keep").collect()} == greedy(mates)
    assert found.count() == len(mates)
    assert kept_reads(spark.createDataFrame([], "read_idx long, mate long")).count() == 0


READS = "read_idx long, id string, sample_label string, len long"


def test_curve_ends_at_the_redundant_share(spark):
    reads = spark.createDataFrame([(0, "a", "s", 10), (1, "b", "s", 30), (2, "c", None, 99), (5, "d", "one", 7)], READS)
    mates = spark.createDataFrame([(0, 1), (1, None), (5, 5)], "read_idx long, mate long")
    values = C.curve(reads, mates, 4, 0.7, 11)
    summary = {(r["sample_label"], r["portion"]): r for r in C.curve_summary(values).collect()}
    assert summary["s", 1.0]["mean"] == 0.25 and summary["s", 1.0]["sd"] == 0 and summary["s", 0.0]["mean"] == 0
    assert summary["one", 1.0]["mean"] == 0 and {k[0] for k in summary} == {"s", "one"}
    assert rows(values) == rows(C.curve(reads.repartition(3), mates.repartition(5), 4, 0.7, 11))
    points = [r["portion"] for r in C.sampling_points(spark.createDataFrame([("x", 1000)], "sample_label string, reads long"), 0.7).orderBy("point").collect()]
    assert points[0] == 0 and points[-1] == 1 and len(points) == 20


def test_latest_mates(spark):
    best = "struct<target: long, passes: boolean>"
    day = [datetime.datetime(2024, 1, d) for d in range(1, 4)]
    data = [(1, (2, True), day[0]), (1, (3, False), day[1]), (2, (2, True), day[0]), (3, None, day[0]), (None, (1, True), day[0]), (4, (1, True), None), (4, (9, True), day[2]), (5, (1, True), day[0]), (5, (1, True), day[0])]
    found = C.latest_mates(spark.createDataFrame(data, f"query long, best {best}, scored_at timestamp_ntz"))
    assert rows(found) == [(1, None), (2, None), (3, None), (4, 9), (5, 1)]


def test_models_of_samples(spark):
    import numpy as np

    from strandmill.functions.families import GAMMA

    effort = np.exp(np.linspace(9, 20, 15))
    points = [("s", i / 14, i, int(e), float(c), float(c), float(e), None) for i, (e, c) in enumerate(zip(effort, GAMMA.cdf((60.0, 3.2), np.log1p(effort))))]
    points += [points[3], ("few", 1.0, 5, 100, 0.1, 0.1, 100.0, 0.2), ("s", None, 1, 1, 0.5, 0.5, 1.0, None), (None, 0.5, 1, 1, 0.5, 0.5, 1.0, None)]
    df = spark.createDataFrame(points, "sample_label string, portion double, n_reads long, n_bases long, redundancy double, coverage double, adjusted_effort double, fitted_coverage double")
    clean = models.clean_points(df)
    assert clean.count() == 16
    fits = models.family_fits(clean)
    assert {r["family"] for r in fits.collect()} == {"gamma", "generalized_gamma", "burr_xii", "gamma_mixture2"}
    chosen = {r["sample_label"]: r for r in models.selected_models(clean, fits).collect()}
    assert chosen["s"]["family"] == "gamma_mixture2" and abs(chosen["s"]["diversity"] - 18.75) < 0.5
    assert chosen["few"]["family"] is None and "fewer than" in chosen["few"]["note"]
    assert models.family_curves(clean, fits).count() == 4 * 512
    guide = {r["sample_label"]: r for r in models.guides(clean).collect()}
    assert guide["few"]["matched_coverage"] == 0.2 and guide["few"]["current_effort"] == 1e6
