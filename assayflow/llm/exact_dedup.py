"""Exact deduplication by two-pass Bloom filtering (DataFrame only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayflow.llm.common import bits_for, stored, top_bits

#: Rows of a Bloom filter (a block number and 64 bits each) that are broadcast at most: about 64 MB.
MOST_BROADCAST_ROWS = 1_000_000
#: A group is hot when it holds more than one row in so many: there are fewer such groups than this.
HOT_SHARE = 1000
#: Rows for each 64-bit block of the filter, and bits set for each row.
ROWS_A_BLOCK, BITS_A_ROW = 4, 4


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def _mask(key: Column) -> Column:
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(key, 6 * i).bitwiseAND(63).cast("int")) for i in range(BITS_A_ROW)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def repeated_filter(hashes: DataFrame) -> DataFrame:
    """Pass 1. ``(block, mask)`` rows to ``(block, twice)``: the bits that two rows or more have set.

    Equal rows are counted before they are dealt out, so a hot hash is one row by task; after that
    a block has a few distinct masks. A block's masks fold into (set once, set twice).
    """
    masks = hashes.groupBy("__block", "__mask").agg(F.count("*").alias("n"))
    zero = F.struct(F.lit(0).cast("long").alias("once"), F.lit(0).cast("long").alias("twice"))

    def step(a, x):
        again = F.when(x["n"] > 1, x["__mask"]).otherwise(F.lit(0).cast("long"))
        return F.struct(
            a["once"].bitwiseOR(x["__mask"]).alias("once"), a["twice"].bitwiseOR(a["once"].bitwiseAND(x["__mask"])).bitwiseOR(again).alias("twice")
        )

    folded = masks.groupBy("__block").agg(F.aggregate(F.collect_list(F.struct("__mask", "n")), zero, step)["twice"].alias("__twice"))
    return folded.where("__twice != 0")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_broadcast: int = MOST_BROADCAST_ROWS) -> DataFrame:
    """One row per document: ``(id, keep_id, group_size, kept, text_sha256)``.

    Texts are equal when their normalised texts are. The row with the most code points stays, then
    the one with the smallest id (null ids last), then any one of the equal rows. Pass 1 builds a
    blocked Bloom filter of the bits that two rows set; pass 2 sends only rows whose bits are all in
    it to the exact grouping by SHA-256, and the others pass straight through. The filter is
    broadcast up to ``most_broadcast`` rows and joined by shuffling (id, hash) rows beyond. Groups with more
    than 1/1000 of the rows (so fewer than 1000 groups) get their verdict by a broadcast join.
    Null texts count as empty; empty tables give empty results; other columns are not read.
    """
    sha = F.unhex(F.sha2(normalised(F.col(text_col)), 256))
    rows = stored(
        docs.select(F.col(id_col).alias("__id"), sha.alias("__sha"), F.coalesce(F.length(text_col), F.lit(0)).alias("__len")).withColumn(
            "__row", F.monotonically_increasing_id()
        ),
        "hashes",
    )
    n = rows.count()
    key = F.xxhash64("__sha")
    rows = rows.withColumns({"__block": top_bits(key, bits_for(n, ROWS_A_BLOCK, 31)).cast("int"), "__mask": _mask(key)})
    bloom = stored(repeated_filter(rows.select("__block", "__mask")), "bloom")
    bloom = F.broadcast(bloom) if bloom.count() <= most_broadcast else bloom
    probed = rows.join(bloom, "__block", "left").withColumn("__maybe", F.coalesce(F.col("__twice").bitwiseAND(F.col("__mask")) == F.col("__mask"), F.lit(False)))
    maybe = stored(probed.where("__maybe").select("__id", "__sha", "__len", "__row"), "maybe")
    alone = probed.where("not __maybe").select("__id", "__sha", F.col("__id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))

    first = F.struct((-F.col("__len")).alias("len"), F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), F.col("__row").alias("row"))
    groups = stored(maybe.groupBy("__sha").agg(F.count("*").alias("group_size"), F.min(first).alias("__first")), "groups")
    hot = groups.where(F.col("group_size") * HOT_SHARE > n)
    cold = groups.where(F.col("group_size") * HOT_SHARE <= n)
    verdict = ["__id", "__sha", F.col("__first.id").alias("keep_id"), "group_size", (F.col("__first.row") == F.col("__row")).alias("kept")]
    in_hot = maybe.join(F.broadcast(hot), "__sha").select(verdict)
    in_cold = maybe.join(F.broadcast(hot.select("__sha")), "__sha", "left_anti").join(cold, "__sha").select(verdict)
    return alone.unionByName(in_hot).unionByName(in_cold).select(
        F.col("__id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("__sha")).alias("text_sha256")
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(length(text), 0) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS h FROM documents
), r AS (
  SELECT doc_id, h, count(*) OVER (PARTITION BY h) AS group_size,
         first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id NULLS LAST) AS keep_id,
         row_number() OVER (PARTITION BY h ORDER BY n DESC, doc_id NULLS LAST) AS i
  FROM d
)
SELECT doc_id, keep_id, group_size, i = 1 AS kept, h AS text_sha256 FROM r
"""
