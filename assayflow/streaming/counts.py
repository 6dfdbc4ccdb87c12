"""Counting reads as files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from assayflow.functions.semantics import slice_at
from assayflow.operators.demux import Slice


def streamed_reads(spark: SparkSession, folder: str, schema: str = "read_id long, seq string, seq2 string") -> DataFrame:
    """Reads from Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def streamed_counts(reads: DataFrame, barcodes: DataFrame, index: Slice, tag: Slice) -> DataFrame:
    """``(peptide, sample, score)`` so far, by exact barcode and tag slice; state is a row for each cell."""
    own = reads.select(slice_at(F.col(index.column), index.start, index.length).alias("key"), slice_at(F.col(tag.column), tag.start, tag.length).alias("peptide"))
    known = barcodes.select("key", "sample")
    return own.where("peptide is not null").join(known, "key").groupBy("peptide", "sample").agg(F.count("*").alias("score"))


def run_to_table(counts: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Takes in all files that are there, and keeps the complete counts in a memory table."""
    return counts.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
