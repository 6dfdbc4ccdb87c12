"""Names, sums and replicate averages of a matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counts(m: DataFrame) -> DataFrame:
    return m.agg(F.countDistinct("sample").alias("n_samples"), F.countDistinct("peptide").alias("n_peptides"))


def sample_names(m: DataFrame) -> DataFrame:
    return m.select("sample").distinct()


def peptide_names(m: DataFrame) -> DataFrame:
    return m.select("peptide").distinct()


def replicate_averages(m: DataFrame, sets: DataFrame) -> DataFrame:
    """``(peptide, sample, score)`` by base name ``set_id``: the sum of the replicates over how many are listed."""
    listed = sets.groupBy("set_id").agg(F.count("*").alias("listed"))
    by = m.join(sets, "sample").groupBy("set_id", "peptide").agg(F.sum("score").alias("total"))
    return by.join(listed, "set_id").select("peptide", F.col("set_id").alias("sample"), (F.col("total") / F.col("listed")).alias("score"))


def invalid_replicates(m: DataFrame, sets: DataFrame) -> DataFrame:
    """Listed replicates that are no samples, or are listed more than once."""
    times = sets.groupBy("sample").agg(F.count("*").alias("times"))
    known = m.select("sample").distinct().withColumn("known", F.lit(True))
    return times.join(known, "sample", "left").where("known is null or times > 1").select("sample", "times", F.coalesce("known", F.lit(False)).alias("known"))
