"""The whole analysis: counts, normalisation, bins, z-scores, enriched peptides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assayflow.operators import binning, enrich, matrix, normalize
from assayflow.plans import surrogates
from assayflow.sources.scratch import stored


def analyse(raw: DataFrame, controls: str, bin_size: int = 300, digits: int = 0, z_least: float = 6.0, norm_least: float = 20.0, hdi: float = 0.75, raw_least: float = 0.0) -> dict[str, DataFrame]:
    """All tables of the standard analysis of a raw count matrix, by name.

    The dense matrix and its normalised form, which most steps read, are stored in the shared folder once; the rest is lazy.
    """
    full = stored(matrix.densify(raw), "dense")
    col_sum = stored(normalize.by_column_sum(full), "col-sum")
    diff = normalize.against_controls(col_sum, "diff", start=controls)
    ratio = normalize.against_controls(col_sum, "diff_ratio", start=controls)
    bins = binning.greedy_bins(col_sum.where(normalize.is_control(col_sum["sample"], start=controls)), bin_size, digits)
    z = binning.zscores(diff, bins, hdi=hdi)
    sets = enrich.replicate_sets(full)
    called = enrich.enriched([(z.select("peptide", "sample", "score"), [z_least]), (col_sum, [norm_least])], sets, full, [raw_least] if raw_least else None)
    return {"col_sum": col_sum, "diff": diff, "diff_ratio": ratio, "bins": bins, "zscores": z, "enriched": called}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enriched peptides of the score matrix made from lineitem."""
    return analyse(surrogates.scores(spark, sf_dir), "N", bin_size=30, digits=-2, z_least=0.1, norm_least=100.0)["enriched"]
