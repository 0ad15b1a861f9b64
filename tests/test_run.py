import random

import pytest
from pyspark.sql import functions as F

from strandmill.__main__ import main, parser
from strandmill.config import Settings
from strandmill.plans import redundancy as P

COMPLEMENT = str.maketrans("ACGT", "TGCA")


def sample(seed, number):
    """Reads of which every second one is a slightly changed copy of the one before, some on the other strand."""
    chance = random.Random(seed)
    reads = []
    for n in range(number):
        if n % 2:
            copy = [chance.choice("ACGT") if chance.random() < 0.01 else c for c in reads[-1]]
            read = "".join(copy)
            reads.append(read[::-1].translate(COMPLEMENT) if n % 4 == 3 else read)
        else:
            reads.append("".join(chance.choices("ACGT", k=2000)))
    return reads


@pytest.fixture(scope="module")
def reads(spark):
    first, second = sample(1, 24), sample(2, 12)
    rows = [("a", n, f"a{n}", s) for n, s in enumerate(first)] + [(None, 100 + n, f"b{n}", s) for n, s in enumerate(second)]
    rows += [("c", 200 + n, f"c{n}", s) for n, s in enumerate(first[::2])] + [("c", 300, "short", "ACGT"), ("c", 301, "none", None), (None, None, "x", "ACGT")]
    return spark.createDataFrame(rows, "sample_label string, read_idx long, id string, seq string")


@pytest.mark.parametrize("targets", [0, 3])
def test_planted_copies_are_mates_within_their_sample(spark, reads, targets):
    run = P.analyse(reads, Settings(alignment_targets=targets, replicates=4))
    found = {r["read_idx"]: r for r in run.mates.collect()}
    assert set(found) == set(range(24)) | set(range(100, 112)) | set(range(200, 212)) | {300}
    for n, row in found.items():
        if n < 200:
            assert row["passes"] and row["mate"] == n ^ 1
            # hashes are neutral to the strand, so only an alignment tells it
            assert targets == 0 or row["rev"] == (n % 4 >= 2)
            assert row["keep"] == (n % 2 == 0)
        else:
            assert not row["passes"] and row["keep"]
    last = {r["sample_label"]: r["mean"] for r in run.summary.where("portion = 1").collect()}
    assert last == {"a": 1.0, "unlabelled": 1.0, "c": 0.0}
    assert {r["sample_label"] for r in run.models.collect()} == {"a", "unlabelled", "c"}


def test_no_reads(spark, reads):
    run = P.analyse(reads.where("false"), Settings(replicates=2))
    assert run.mates.count() == run.summary.count() == run.points.count() == run.curves.count() == 0


def test_command_line(spark, tmp_path):
    (tmp_path / "one.fa").write_text("".join(f">r{n}\n{s}\n" for n, s in enumerate(sample(3, 40))))
    (tmp_path / "two.fastq").write_text("".join(f"@q{n}\n{s}\n+\n{'I' * len(s)}\n" for n, s in enumerate(sample(4, 8))))
    (tmp_path / "list.txt").write_text(f"{tmp_path}/one.fa\n{tmp_path}/two.fastq second\n")
    main(["coverage", "--list", str(tmp_path / "list.txt"), "--prefix", str(tmp_path / "out"), "--replicates", "8"], spark)
    mates = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "out.mates.tsv"))
    assert mates.count() == 48 and mates.where("mate_count = 1").count() == 48
    assert {r["value"] for r in spark.read.text(str(tmp_path / "out.nonredundant.ids")).collect()} == {f"r{n}" for n in range(0, 40, 2)} | {f"q{n}" for n in range(0, 8, 2)}
    models = [str(tmp_path / "out.model" / f"sample_label={label}") for label in ("one", "second")]
    (tmp_path / "models.txt").write_text(f"{models[0]} first sample\n{models[1]} second\n")
    main(["plot", "--list", str(tmp_path / "models.txt"), "--prefix", str(tmp_path / "merged")], spark)
    assert "first sample" in "\n".join(r["value"] for r in spark.read.text(str(tmp_path / "merged.svg")).collect())
    main(["models", "--model", models[0], "--prefix", str(tmp_path / "compared")], spark)
    fits = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "compared.families.tsv"))
    assert "bic" in fits.columns
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "compared.curves.tsv")).count() == 512 * fits.count()
    with pytest.raises(SystemExit):
        parser().parse_args(["coverage", "--input", "a", "--list", "b", "--prefix", "p"])
