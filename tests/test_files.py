import datetime
import gzip

import pytest
from pyspark.sql import functions as F

from strandmill.config import Settings
from strandmill.operators.models import transition
from strandmill.plans.redundancy import analyse, load_samples, run_facts
from strandmill.sources import readers as R
from strandmill.sources import writers as W
from strandmill.streaming.reads import first_deliveries, running_totals


def test_fasta_and_fastq(spark, tmp_path):
    (tmp_path / "a.fa").write_bytes(b">one first read\nACGU\nacg\n\n>two\n\n>three\r\nAC-GT\r\n")
    found = R.read_fasta(spark, str(tmp_path / "a.fa")).orderBy("read_idx").collect()
    assert [(r["read_idx"], r["id"], r["seq"]) for r in found] == [(0, "one first read", "ACGTACG"), (2, "three", "ACNGT")]
    with gzip.open(tmp_path / "b.fastq.gz", "wb") as file:
        file.write(b"@x 1\nACGT\n+\n@III\n@y\n\n+\n\n@z\nNNA\n+\nIII\n")
    found = R.read_fastq(spark, str(tmp_path / "b.fastq.gz")).orderBy("read_idx").collect()
    assert [(r["read_idx"], r["id"], r["seq"]) for r in found] == [(0, "x 1", "ACGT"), (2, "z", "NNA")]


def test_numbers_run_over_many_blocks(spark, tmp_path):
    (tmp_path / "many.fa").write_text("".join(f">r{i}\n{'ACGT' * 30}\n" for i in range(3000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        found = R.read_fasta(spark, str(tmp_path / "many.fa"))
        assert found.where("id <> concat('r', read_idx)").count() == 0 and found.count() == 3000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_lists_and_labels(spark, tmp_path):
    (tmp_path / "s.txt").write_text("# comment\n\n/x/marine 1.fastq.gz\n".replace("marine 1", "marine.1") + "b.fa  stool/A \n")
    assert {tuple(r) for r in R.read_sample_list(spark, str(tmp_path / "s.txt")).collect()} == {("/x/marine.1.fastq.gz", "marine_1"), ("b.fa", "stool_A")}
    (tmp_path / "t.txt").write_text("a.fa x\nb.fa x\n")
    with pytest.raises(ValueError):
        R.read_sample_list(spark, str(tmp_path / "t.txt"))
    (tmp_path / "m.txt").write_text("/d/marine.model.tsv\nsub/stool.tsv  gut sample\n")
    assert {tuple(r) for r in R.read_model_list(spark, str(tmp_path / "m.txt")).collect()} == {("/d/marine.model.tsv", "marine"), (f"{tmp_path}/sub/stool.tsv", "gut sample")}


def test_model_files_round_trip(spark, tmp_path):
    models = spark.createDataFrame([("s", "gamma", "shape=1", 5, 100, 0.5, None, 12.5, 12.3, 0.8, 0.9, "a note")], "sample_label string, family string, parameters string, reads long, bases long, kappa double, effort_at_target double, diversity double, diversity_q99 double, remaining_diversity double, model_r double, note string")
    points = spark.createDataFrame([("s", 1.0, 5, 100, 0.5, 0.5, 100.0, 0.51), ("s", 0.5, 2, 50, 0.2, 0.2, 50.0, None)], "sample_label string, portion double, reads long, bases long, redundancy double, coverage double, effort double, fitted_coverage double")
    curves = spark.createDataFrame([("s", "gamma", 1e6, 0.7)], "sample_label string, family string, effort double, coverage double")
    W.write_models(W.model_lines(models, points, curves), str(tmp_path / "out"))
    headers, rows = R.read_models(spark, str(tmp_path / "out/sample_label=s"))
    header = R.model_headers(headers).collect()[0]["header"]
    assert header["model_family"] == "gamma" and header["LRstar"] == "NA" and header["note"] == "a note" and header["target_coverage"] == ".95"
    found = [(r["kind"], r["reads"], r["portion"], r["coverage"], r["fitted_coverage"]) for r in rows.orderBy("n").collect()]
    assert found == [("observed", 2, 0.5, 0.2, None), ("observed", 5, 1.0, 0.5, 0.51), ("model", None, None, 0.7, 0.7)]
    (tmp_path / "bad.tsv").write_text("kind\treads\nobserved\t5\n")
    with pytest.raises(Exception, match="15 columns"):
        R.read_models(spark, str(tmp_path / "bad.tsv"))[1].collect()


def test_tables_and_plot(spark, tmp_path):
    reads = spark.createDataFrame([(1, "b\tx", "AC"), (0, "a", "G")], "read_idx long, id string, seq string")
    W.write_ids(reads, str(tmp_path / "ids"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "ids")).collect()] == ["a", "b x"]
    W.write_fastq(reads, str(tmp_path / "fq"))
    assert {(r["id"], r["seq"]) for r in R.read_fastq(spark, str(tmp_path / "fq")).collect()} == {("a", "G"), ("b x", "AC")}
    W.write_table(reads.select("read_idx", W.fixed(F.lit(0.5)).alias("v")), str(tmp_path / "t"), ["read_idx"])
    assert [tuple(r) for r in spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "t")).orderBy("read_idx").collect()] == [("0", "0.50000000"), ("1", "0.50000000")]
    svg = W.svg_plot({"a": [(1e6, 0.1), (1e9, 0.9)]}, {"a": [(2e6, 0.2)]}, {"a": 18.0, "a very long label <x>": 2.0})
    assert svg.startswith("<svg") and "a very long..." in svg and W.colour(0) != W.colour(1)


def test_stream_of_reads(spark, tmp_path):
    schema = "read_idx long, seq string, sample_label string, loaded_at timestamp"
    at = datetime.datetime(2024, 3, 1)
    spark.createDataFrame([(1, "ACG", "s", at), (2, None, "s", at), (None, "A", "s", at)], schema).write.parquet(str(tmp_path / "in"))
    spark.createDataFrame([(1, "ACG", "s", at + datetime.timedelta(days=20)), (3, "AC", None, at)], schema).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for name, df, mode in (("firsts", first_deliveries(stream), "append"), ("sums", running_totals(stream), "complete")):
        query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"state-{name}")).trigger(availableNow=True).start()
        query.awaitTermination(120)
    assert sorted(r["read_idx"] for r in spark.table("firsts").collect()) == [1, 2, 3]
    assert sum(r["deliveries"] for r in spark.table("sums").collect()) == 5


def test_model_files_keep_every_figure(spark, tmp_path):
    models = spark.createDataFrame([("s", "gamma", 4, 100)], "sample_label string, family string, reads long, bases long")
    given = (1.0, 4, 100, 0.5, 0.01, 0.3, 0.4, 0.5, 0.5, 0.3, 0.4, 0.5, 100.0, None)
    columns = "portion double, reads long, bases long, redundancy double, sd double, q1 double, median double, q3 double, coverage double, q1_coverage double, median_coverage double, q3_coverage double, effort double, fitted_coverage double"
    points = spark.createDataFrame([("s", *given)], f"sample_label string, {columns}")
    curves = spark.createDataFrame([], "sample_label string, family string, effort double, coverage double")
    W.write_models(W.model_lines(W.with_model_facts(models, points), points, curves), str(tmp_path / "out"))
    headers, rows = R.read_models(spark, str(tmp_path / "out/sample_label=s"))
    found = rows.collect()[0]
    names = {"redundancy": "redundant_fraction", "effort": "adjusted_effort_bp"}
    assert [found[names.get(c.split()[0], c.split()[0])] for c in columns.split(", ")] == list(given)
    header = R.model_headers(headers).collect()[0]["header"]
    assert float(header["average_read_length"]) == 25 and float(header["C"]) == 0.5 and float(header["LR"]) == 100 and float(header["target_coverage"]) == 0.95


def test_samples_of_many_files_are_read_at_once(spark, tmp_path):
    (tmp_path / "a b.fa").write_text(">x\nACGT\n>y\nAC\n")
    (tmp_path / "c.fasta").write_text(">z\nGG\n")
    (tmp_path / "d.fq").write_text("@q\nTT\n+\nII\n")
    samples = [(str(tmp_path / "c.fasta"), "two"), (str(tmp_path / "a b.fa"), "one"), (str(tmp_path / "d.fq"), "two")]
    found = [(r["sample_label"], r["id"], r["seq"]) for r in load_samples(spark, samples).orderBy("read_idx").collect()]
    assert found == [("two", "z", "GG"), ("one", "x", "ACGT"), ("one", "y", "AC"), ("two", "q", "TT")]
    with pytest.raises(FileNotFoundError):
        load_samples(spark, [(str(tmp_path / "none.fa"), "x")])


def test_transition(spark):
    points = [("a", 1.0, 0.1), ("a", 2.0, 0.3), ("a", 3.0, 0.7), ("b", 1.0, 0.1), ("b", 4.0, 0.2), ("c", 1.0, 0.5), ("c", 2.0, 0.5)]
    found = transition(spark.createDataFrame(points, "sample_label string, x double, y double")).collect()
    assert {r["sample_label"]: round(r["transition"], 6) for r in found} == {"a": 2.5, "b": 4.0, "c": 1.5}


def test_summary_files_say_how_they_were_made(spark, tmp_path):
    rows = [("s", n, f"r{n}", "ACGTTGCAAC" * 30) for n in range(3)]
    run = analyse(spark.createDataFrame(rows, "sample_label string, read_idx long, id string, seq string"), Settings(replicates=2))
    W.write_models(W.summary_lines(run.summary, run_facts(run)), str(tmp_path / "out"))
    lines = [r[0] for r in spark.read.text(str(tmp_path / "out/sample_label=s")).collect()]
    facts = dict(line[3:].split(": ", 1) for line in lines if line.startswith("# @"))
    assert facts["reads"] == "3" and facts["bases"] == "900" and facts["kmer"] == "16" and facts["seed"] == "1" and facts["requested_minimizer_window"] == "auto"
    assert len(facts) > 45 and "NA" not in facts.values() and "reads\tbases\tportion\tmean\tsd\tq1\tmedian\tq3" in lines
