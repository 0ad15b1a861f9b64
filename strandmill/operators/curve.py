"""The redundancy curve of samples by repeated subsampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandmill.functions.sequences import nearest_rank, uniform
from strandmill.operators.skew import lookup_join


def latest_mates(mate_results: DataFrame) -> DataFrame:
    """``read_idx, mate``: the passing best target of each query by its latest result, null if it has none.

    Rows with a null query count for nothing. A best target that did not pass,
    is null or is the query itself is no mate.
    """
    target = F.when(F.col("best.passes") & (F.col("best.target") != F.col("query")), F.col("best.target"))
    rows = mate_results.where("query IS NOT NULL").select("query", "scored_at", target.alias("mate"))
    order = F.struct(F.coalesce(F.col("scored_at"), F.lit("0001-01-01").cast("timestamp_ntz")), F.coalesce("mate", F.lit(-1)))
    return rows.groupBy(F.col("query").alias("read_idx")).agg(F.max_by("mate", order).alias("mate"))


def totals(reads: DataFrame) -> DataFrame:
    """``sample_label, reads, bases`` of every sample; reads without a label belong to none."""
    return reads.where("sample_label IS NOT NULL").groupBy("sample_label").agg(F.count(F.lit(1)).alias("reads"), F.sum("len").alias("bases"))


def portions(reads: Column, divide: float) -> Column:
    """The portions of a sample of so many reads: 0, then powers of ``divide`` from about 2 reads up to 1."""
    ratio = divide if 0 < divide < 1 else 0.7
    highest = F.ceil((F.ln(F.lit(2.0)) - F.ln(reads.cast("double"))) / F.ln(F.lit(ratio)))
    powers = F.transform(F.sequence(highest.cast("int"), F.lit(0), F.lit(-1)), lambda i: F.floor(F.pow(F.lit(ratio), i) * 1e12 + 0.5) / F.lit(1e12))
    return F.when(reads <= 1, F.array(F.lit(1.0))).otherwise(F.concat(F.array(F.lit(0.0)), powers))


def sampling_points(samples: DataFrame, divide: float) -> DataFrame:
    """``sample_label, point, portion`` of every sample (sample_label, reads)."""
    return samples.select("sample_label", F.posexplode(portions(F.col("reads"), divide)).alias("point", "portion")).withColumn("point", F.col("point").cast("long"))


def curve(reads: DataFrame, mates: DataFrame, replicates: int, divide: float, seed: int) -> DataFrame:
    """``sample_label, point, portion, bases, replicate, value``: redundant share of the sampled bases.

    A read is in the subsample of a portion if its number for the replicate lies
    under the portion; it is redundant there if its mate, a read of the same
    sample, is in as well. The number depends on seed, replicate and read alone,
    so one row a read and replicate is enough: it enters at the first point whose
    portion exceeds its number, as a redundant one at the later of its own and
    its mate's. What entered before is added up over the few points of a
    sample. Subsamples of one replicate are therefore nested. ``bases`` is
    nominal; an empty subsample, and a sample of one read, gives 0.
    """
    samples = totals(reads).withColumn("portions", portions(F.col("reads"), divide))
    own = reads.where("sample_label IS NOT NULL").select("read_idx", "sample_label", "len").join(mates, "read_idx", "left")
    of_mate = reads.select(F.col("read_idx").alias("mate"), F.col("sample_label").alias("mate_label"))
    paired = own.join(of_mate, "mate", "left").withColumn("mate", F.when(F.col("mate_label") == F.col("sample_label"), F.col("mate")))
    placed = lookup_join(paired.drop("mate_label"), samples.select("sample_label", "portions"), "sample_label", ["read_idx"])
    drawn = placed.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))

    def entry(number: Column) -> Column:
        return F.size(F.filter("portions", lambda p: p <= number))

    # bound to a lambda's variable, so that a number is drawn once and not for each portion it is compared with
    numbers = F.array(F.struct(*(uniform(F.lit(seed), F.col("replicate"), F.col(c)).alias(name) for c, name in (("read_idx", "own"), ("mate", "other")))))
    at = F.transform(numbers, lambda n: F.struct(entry(n["own"]).alias("own"), entry(n["other"]).alias("other")))[0]
    entered = drawn.select("sample_label", "replicate", "len", F.col("mate").isNotNull().alias("paired"), at.alias("entry"))
    entered = entered.select("sample_label", "replicate", "len", F.col("entry.own").alias("at"), F.when(F.col("paired"), F.greatest("entry.own", "entry.other")).alias("found_at"))
    steps = F.explode(F.array(F.struct(F.col("at").alias("at"), F.col("len").alias("sampled"), F.lit(0).cast("long").alias("found")), F.struct(F.col("found_at").alias("at"), F.lit(0).cast("long").alias("sampled"), F.col("len").alias("found"))))
    gained = entered.select("sample_label", "replicate", steps.alias("step")).where("step.at IS NOT NULL").groupBy("sample_label", "replicate", F.col("step.at").alias("at"))
    gained = gained.agg(F.sum("step.sampled").alias("sampled"), F.sum("step.found").alias("found"))
    grid = samples.select("sample_label", "reads", "bases", F.posexplode("portions").alias("point", "portion")).withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    filled = grid.join(gained.withColumnRenamed("at", "point"), ["sample_label", "replicate", "point"], "left")
    running = W.partitionBy("sample_label", "replicate").orderBy("point").rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = filled.withColumns({"all_sampled": F.sum(F.coalesce("sampled", F.lit(0))).over(running), "all_found": F.sum(F.coalesce("found", F.lit(0))).over(running)})
    value = F.when((F.col("reads") > 1) & (F.col("all_sampled") > 0), F.col("all_found") / F.col("all_sampled")).otherwise(0.0)
    return summed.select("sample_label", F.col("point").cast("long").alias("point"), "portion", F.floor(F.col("portion") * F.col("bases") + 0.5).alias("bases"), "replicate", value.alias("value"), "reads")


def curve_summary(values: DataFrame) -> DataFrame:
    """Mean, population deviation and nearest-rank quartiles of the replicates of every point, and nominal reads."""
    grouped = values.groupBy("sample_label", "point", "portion", "bases").agg(F.max("reads").alias("total"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), F.collect_list("value").alias("values"))
    quartiles = {name: nearest_rank(F.col("values"), share) for name, share in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))}
    return grouped.withColumns(quartiles).select("sample_label", "point", F.floor(F.col("portion") * F.col("total") + 0.5).alias("reads"), "bases", "portion", "mean", "sd", "q1", "median", "q3")
