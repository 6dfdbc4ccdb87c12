"""Normalisation: column sums, size factors, differences and ratios against negative controls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayflow.functions.semantics import ieee_div, nan_if_null

PER = 1e6


def column_sums(m: DataFrame) -> DataFrame:
    return m.groupBy("sample").agg(F.sum("score").alias("col_sum"))


def by_column_sum(m: DataFrame) -> DataFrame:
    """Scores by million of their sample's sum. Sums are partial aggregates: a row for each sample is shuffled."""
    return m.join(column_sums(m), "sample").select("peptide", "sample", ieee_div(F.col("score"), F.col("col_sum") / PER).alias("score"))


def size_factors(m: DataFrame) -> DataFrame:
    """``(sample, factor)``: the upper median of score / geometric mean of its peptide. ``m`` is dense."""
    logs = m.groupBy("peptide").agg(F.avg(F.when(F.col("score") != 0, F.ln(F.when(F.col("score") != 0, F.col("score"))))).alias("__log"))
    ratio = m.join(logs, "peptide").select("sample", "peptide", ieee_div(F.col("score"), F.coalesce(F.exp("__log"), F.lit(0.0))).alias("ratio"))
    w = Window.partitionBy("sample")
    ranked = ratio.withColumns({"rn": F.row_number().over(w.orderBy("ratio", "peptide")), "n": F.count("*").over(w)})
    return ranked.where("rn = floor(n / 2) + 1").select("sample", F.col("ratio").alias("factor"))


def by_size_factors(m: DataFrame) -> DataFrame:
    return m.join(size_factors(m), "sample").select("peptide", "sample", ieee_div(F.col("score"), F.col("factor")).alias("score"))


def is_control(name: Column, names: list[str] | None = None, start: str | None = None) -> Column:
    """Whether a sample is a negative control: listed names first, else ``start`` at a position up to its length."""
    if names:
        return name.isin(names)
    if start is None:
        raise ValueError("negative controls need names or a start")
    return F.instr(name, start).between(1, len(start) + 1)


def control_means(m: DataFrame, names: list[str] | None = None, start: str | None = None) -> DataFrame:
    """``(peptide, mu)``: mean over the controls; NaN if there are none."""
    return m.groupBy("peptide").agg(nan_if_null(F.avg(F.when(is_control(F.col("sample"), names, start), F.col("score")))).alias("mu"))


def against_controls(m: DataFrame, approach: str, names: list[str] | None = None, start: str | None = None, controls: DataFrame | None = None) -> DataFrame:
    """``diff``, ``ratio`` or ``diff_ratio`` to the control mean; peptides that the controls lack stay as they are."""
    mu = control_means(m if controls is None else controls, names, start)
    x, y = F.col("score"), F.col("mu")
    value = {"diff": x - y, "ratio": ieee_div(x, y), "diff_ratio": ieee_div(x - y, y)}[approach]
    return m.join(mu, "peptide", "left").select("peptide", "sample", F.when(y.isNull(), x).otherwise(value).alias("score"))
