"""Enriched peptides across replicates and matrices, and why sets of replicates fail."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def thresholds_met(low: Column, high: Column, thresholds: list[float]) -> Column:
    """Largest value against the largest threshold and smallest against the smallest."""
    return (high >= max(thresholds)) & (low >= min(thresholds))


def pair_threshold_met(a: Column, b: Column, thresholds: list[float]) -> Column:
    """Two replicates: both reach the smaller threshold and one reaches the larger."""
    return thresholds_met(F.least(a, b), F.greatest(a, b), thresholds)


def own_sets(m: DataFrame) -> DataFrame:
    """``(set_id, sample)``: each sample is its own set."""
    return m.select(F.col("sample").alias("set_id"), "sample").distinct()


def replicate_sets(m: DataFrame) -> DataFrame:
    """``(set_id, sample)`` by the sample name up to its last underscore."""
    return m.select(F.regexp_replace("sample", "_[^_]*$", "").alias("set_id"), "sample").distinct()


def calls(matrix: DataFrame, sets: DataFrame, thresholds: list[float]) -> DataFrame:
    """``(set_id, peptide, ok)``: a set with a NaN never passes."""
    by = matrix.join(sets, "sample").groupBy("set_id", "peptide")
    agg = by.agg(F.min("score").alias("low"), F.max("score").alias("high"), F.max(F.isnan("score")).alias("nan"))
    return agg.select("set_id", "peptide", (~F.col("nan") & thresholds_met(F.col("low"), F.col("high"), thresholds)).alias("ok"))


def raw_sums(raw: DataFrame, sets: DataFrame) -> DataFrame:
    return raw.join(sets, "sample").groupBy("set_id", "sample").agg(F.sum("score").alias("col_sum"))


def sets_with_reads(raw: DataFrame, sets: DataFrame, constraint: list[float]) -> DataFrame:
    """Sets whose raw column sums meet the constraint."""
    by = raw_sums(raw, sets).groupBy("set_id").agg(F.min("col_sum").alias("low"), F.max("col_sum").alias("high"))
    return by.where(thresholds_met(F.col("low"), F.col("high"), constraint)).select("set_id")


def without_low_replicates(raw: DataFrame, sets: DataFrame, constraint: list[float]) -> tuple[DataFrame, DataFrame]:
    """(sets without the replicates whose raw sum is below the smallest constraint, those replicates)."""
    sums = raw_sums(raw, sets)
    return sums.where(F.col("col_sum") >= min(constraint)).select("set_id", "sample"), sums.where(F.col("col_sum") < min(constraint))


def removed_replicates(raw: DataFrame, sets: DataFrame, constraint: list[float]) -> DataFrame:
    """``(set_id, removed)``: the names of each set's replicates whose raw sum is below the smallest constraint, joined; sets that lose none have no row."""
    low = without_low_replicates(raw, sets, constraint)[1]
    return low.groupBy("set_id").agg(F.array_join(F.sort_array(F.collect_set("sample")), ", ").alias("removed"))


def enriched(matrices: list[tuple[DataFrame, list[float]]], sets: DataFrame, raw: DataFrame | None = None, constraint: list[float] | None = None) -> DataFrame:
    """``(set_id, peptide)`` that pass in every matrix, of sets that have enough raw reads."""
    if raw is not None and constraint:
        sets = sets.join(sets_with_reads(raw, sets, constraint), "set_id", "left_semi")
    every = reduce(lambda a, b: a.unionByName(b), (calls(m, sets, t) for m, t in matrices))
    passed = every.groupBy("set_id", "peptide").agg(F.bool_and("ok").alias("ok"), F.count("*").alias("n"))
    return passed.where(F.col("ok") & (F.col("n") == len(matrices))).select("set_id", "peptide")


def failures(matrices: list[tuple[DataFrame, list[float]]], sets: DataFrame, raw: DataFrame | None = None, constraint: list[float] | None = None) -> DataFrame:
    """``(set_id, replicates, reason)`` of sets without enriched peptides."""
    names = sets.groupBy("set_id").agg(F.array_join(F.sort_array(F.collect_set("sample")), ", ").alias("replicates"))
    left = names
    out = []
    if raw is not None and constraint:
        good = sets_with_reads(raw, sets, constraint)
        out.append(names.join(good, "set_id", "left_anti").withColumn("reason", F.lit("Raw read count threshold")))
        left = names.join(good, "set_id", "left_semi")
    found = enriched(matrices, sets, raw, constraint).select("set_id").distinct()
    out.append(left.join(found, "set_id", "left_anti").withColumn("reason", F.lit("No enriched peptides")))
    return reduce(lambda a, b: a.unionByName(b), out)


def set_label(names: Column, join_on: str = "~", most: int = 3) -> Column:
    """The names of a set joined; those beyond ``most`` are counted, as in ``A~B~C~2more``."""
    short = F.concat(F.array_join(F.slice(names, 1, most), join_on), F.lit(join_on), (F.size(names) - most).cast("string"), F.lit("more"))
    return F.when(F.size(names) > most, short).otherwise(F.array_join(names, join_on))


def listed_samples_exist(sets: DataFrame, m: DataFrame) -> DataFrame:
    """Listed samples that the matrix lacks."""
    return sets.select("sample").distinct().join(m.select("sample").distinct(), "sample", "left_anti")
