"""Summaries of clusters, annotations on alignments, windows over positions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayflow.functions.semantics import round_up_half
from assayflow.operators.extras import aligned_positions


def taxon_summary(members: DataFrame, taxa: DataFrame) -> DataFrame:
    """``(cluster, n_sequences, n_taxa, taxa, shares)``: the taxa of each cluster's distinct sequences, the commonest first (ties by name).

    ``members (cluster, sequence)``, ``taxa (sequence, taxon)``. Shares have three digits. Counts by cluster and taxon are shuffled, not members.
    """
    by = members.distinct().join(taxa, "sequence").groupBy("cluster", "taxon").agg(F.count("*").alias("n"))
    ranked = by.groupBy("cluster").agg(F.sum("n").alias("n_sequences"), F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "taxon"))).alias("x"))
    share = lambda c: F.format_string("%.3f", round_up_half(-c["m"] / F.col("n_sequences"), 3))
    return ranked.select("cluster", "n_sequences", F.size("x").cast("long").alias("n_taxa"), F.array_join(F.transform("x", lambda c: c["taxon"]), ",").alias("taxa"), F.array_join(F.transform("x", share), ",").alias("shares"))


def protein_shares(members: DataFrame) -> DataFrame:
    """``(n_proteins, n_clusters, share)``: how many clusters have sequences of so many proteins. ``members (cluster, protein)``."""
    by = members.distinct().groupBy("cluster").agg(F.count("*").alias("n_proteins")).groupBy("n_proteins").agg(F.count("*").alias("n_clusters"))
    return by.crossJoin(by.agg(F.sum("n_clusters").alias("all"))).select("n_proteins", "n_clusters", (F.col("n_clusters") / F.col("all")).alias("share"))


def on_alignment(annotations: DataFrame, aligned: DataFrame) -> DataFrame:
    """Annotations ``(name, start, stop, label)`` of sequences (from 1) in columns (from 1) of the alignment ``(name, seq)``; those outside a sequence go."""
    place = aligned_positions(aligned).select("name", (F.col("position") + 1).alias("at"), (F.col("column") + 1).alias("to"))
    first, last = place.select("name", F.col("at").alias("start"), F.col("to").alias("first")), place.select("name", F.col("at").alias("stop"), F.col("to").alias("last"))
    return annotations.join(first, ["name", "start"]).join(last, ["name", "stop"]).select("name", F.col("first").alias("start"), F.col("last").alias("stop"), "label")


def taxon_windows(places: DataFrame, scores: DataFrame, width: int, step: int, overlap: float) -> DataFrame:
    """``(start, taxon, score)``: the largest score of a taxon's probes that cover enough of a window.

    ``places (probe, position)``: alignment positions at which a probe has a letter; ``scores (probe, taxon, score)``. Windows start at the least
    position and each ``step`` further, as far as they fit; a probe counts where it has at least ``overlap`` of the window's positions. A
    position is dealt to the windows that hold it, so no window is compared with all probes.
    """
    ends = places.agg(F.min("position").alias("low"), F.max("position").alias("high"))
    at = F.col("position") - F.col("low")
    last = F.floor((F.col("high") - F.col("low") - width + 1) / step)
    own = F.sequence(F.greatest(F.lit(0), F.ceil((at - width + 1) / step)), F.least(F.floor(at / step), last))
    held = places.distinct().crossJoin(F.broadcast(ends)).where((last >= 0) & (F.greatest(F.lit(0), F.ceil((at - width + 1) / step)) <= F.least(F.floor(at / step), last)))
    held = held.select("probe", "low", F.explode(own).alias("i")).groupBy("probe", (F.col("low") + F.col("i") * step).alias("start")).agg(F.count("*").alias("n"))
    return held.where(F.col("n") >= overlap * width).join(scores, "probe").groupBy("start", "taxon").agg(F.greatest(F.max("score"), F.lit(0.0)).alias("score"))
