"""Bins of peptides of similar abundance, and statistics by sample and bin."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayflow.functions.semantics import NAN, round_up_half

#: Distinct rounded scores that the sequential fold takes; rounding more coarsely gives fewer.
MOST_KEYS = 5_000_000


def peptide_sums(m: DataFrame) -> DataFrame:
    return m.groupBy("peptide").agg(F.sum("score").alias("total"))


def ranks(m: DataFrame, digits: int = 0) -> DataFrame:
    """``(peptide, rank)``: each peptide's rounded sum."""
    return peptide_sums(m).select("peptide", round_up_half(F.col("total"), digits).alias("rank"))


def fold(keys: list[tuple[float, int]], size: int) -> list[int]:
    """Bin of each (rank, count), ranks descending: a bin is full once it holds ``size`` peptides."""
    out, bin_id, held = [], 1, 0
    for i, (_, n) in enumerate(keys):
        out.append(bin_id)
        held += n
        if held >= size and i < len(keys) - 1:
            bin_id, held = bin_id + 1, 0
    return out


def fold_until_even(keys: list[tuple[float, int]], size: int) -> list[int]:
    """Folds again with one peptide more until the smallest bin has ``size``, or a single bin is left."""
    for least in range(size, sum(n for _, n in keys) + size + 2):
        bins = fold(keys, least)
        held = [0] * (max(bins, default=1) + 1)
        for b, (_, n) in zip(bins, keys):
            held[b] += n
        if max(bins, default=1) == 1 or min(held[1:]) >= size:
            return bins
    return bins


def greedy_bins(m: DataFrame, size: int = 300, digits: int = 0) -> DataFrame:
    """``(bin_id, peptide)``. Only the distinct ranks and their counts are folded on the driver."""
    spark: SparkSession = m.sparkSession
    ranked = ranks(m, digits)
    counted = ranked.groupBy("rank").count().orderBy(F.desc("rank")).limit(MOST_KEYS + 1).collect()
    if len(counted) > MOST_KEYS:
        raise ValueError(f"more than {MOST_KEYS} distinct rounded scores: round more coarsely")
    keys = [(float(r["rank"]), int(r["count"])) for r in counted]
    folded = spark.createDataFrame([(k, b) for (k, _), b in zip(keys, fold_until_even(keys, size))], "rank double, bin_id int")
    return ranked.join(folded, "rank").select("bin_id", "peptide")


def bins_match(m: DataFrame, bins: DataFrame) -> DataFrame:
    """Peptides that aren't in exactly one bin, or in bins only; none if bins and matrix agree."""
    binned = bins.groupBy("peptide").agg(F.count("*").alias("n"))
    scored = m.select("peptide").distinct().withColumn("scored", F.lit(True))
    return scored.join(binned, "peptide", "full_outer").where("scored is null or n is null or n <> 1").select("peptide", F.coalesce("n", F.lit(0)).alias("n_bins"))


def _ordered(m: DataFrame, bins: DataFrame) -> DataFrame:
    w = Window.partitionBy("sample", "bin_id")
    return m.join(bins, "peptide").withColumns({"rn": F.row_number().over(w.orderBy("score", "peptide")), "n": F.count("*").over(w)})


def chosen(m: DataFrame, bins: DataFrame, trim: float = 2.5, hdi: float = 0.0, inclusive: bool = False) -> DataFrame:
    """The scores of each sample and bin that its mean and deviation come from: column ``chosen``.

    ``trim`` percent are left out on both sides; or, with ``hdi``, the narrowest run of round(hdi * n) scores is used:
    of the runs that start before n - k - 1, without its last score, or, if ``inclusive``, of all runs with it.
    """
    o = _ordered(m, bins)
    if not hdi:
        cut = F.floor(F.col("n") * trim * 0.01)
        return o.withColumn("chosen", (F.col("rn") > cut) & (F.col("rn") <= F.col("n") - cut))
    o = o.withColumn("k", F.round(F.col("n") * hdi).cast("int"))
    starts = o.select("sample", "bin_id", F.col("rn").alias("first"), F.col("score").alias("low"), "k", "n")
    ends = o.select("sample", "bin_id", F.col("rn").alias("last"), F.col("score").alias("high"))
    last = F.col("first") + F.greatest(F.col("k"), F.lit(1)) - 1
    runs = starts.withColumn("last", last).join(ends, ["sample", "bin_id", "last"])
    runs = runs.where("first <= n - k + 1" if inclusive else "first <= n - k - 1")
    best = runs.groupBy("sample", "bin_id").agg(F.min(F.struct((F.col("high") - F.col("low")).alias("width"), F.col("first"))).alias("best"))
    o = o.join(best, ["sample", "bin_id"], "left").withColumn("first", F.coalesce("best.first", F.lit(1)))
    end = F.col("first") + F.col("k") - (0 if inclusive else 1)
    return o.withColumn("chosen", (F.col("rn") >= F.col("first")) & (F.col("rn") < end))


def bin_stats(m: DataFrame, bins: DataFrame, **how) -> DataFrame:
    """``(sample, bin_id, mean, sd, n_used)`` of the chosen scores."""
    value = F.when(F.col("chosen"), F.col("score"))
    return chosen(m, bins, **how).groupBy("sample", "bin_id").agg(
        F.coalesce(F.avg(value), F.lit(NAN)).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(NAN)).alias("sd"), F.count(value).alias("n_used")
    )


def zscores(m: DataFrame, bins: DataFrame, **how) -> DataFrame:
    """``(peptide, sample, bin_id, score)``: NaN where the mean is 0, 0 where the deviation is."""
    stats = bin_stats(m, bins, **how)
    z = F.when((F.col("mean") == 0) | F.isnan("mean"), F.lit(NAN)).when(F.col("sd") == 0, F.lit(0.0)).otherwise((F.col("score") - F.col("mean")) / F.when(F.col("sd") != 0, F.col("sd")))
    return m.join(bins, "peptide").join(stats, ["sample", "bin_id"]).select("peptide", "sample", "bin_id", z.alias("score"))


def nan_report(z: DataFrame) -> DataFrame:
    return z.where(F.isnan("score")).select("peptide", "sample", "bin_id")


def signal_to_noise(m: DataFrame, bins: DataFrame, upper: float = 0.9, lower: float = 0.1) -> DataFrame:
    """By sample and bin, the mean of scores from the upper percentile on, less that up to the lower one."""
    joined = m.join(bins, "peptide")
    edges = joined.groupBy("sample", "bin_id").agg(F.percentile("score", upper).alias("hi"), F.percentile("score", lower).alias("lo"))
    x = F.col("score")
    return joined.join(edges, ["sample", "bin_id"]).groupBy("sample", "bin_id").agg(
        (F.avg(F.when(x >= F.col("hi"), x)) - F.avg(F.when(x <= F.col("lo"), x))).alias("signal2noise")
    )


def expected_unique(total: float, library: int) -> float:
    """Distinct peptides to expect of so many draws from a library of equally frequent ones."""
    return library * (1 - math.exp(-total / library)) if library else 0.0
