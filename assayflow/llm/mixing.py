"""Mixing sources to target weights: hash order, distributed prefix sums, a cut at each budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayflow.llm.common import RUN_ROWS, bits_for, running_sum, stored, word_count

#: Weights of the sources in order, repeating; the most epochs of a source.
WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3


def targets(sources: DataFrame, weights=WEIGHTS, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """``(source, source_size)`` with ``target``: shares by weight, at most ``most_epochs`` sizes.

    Sources are ordered by code point, null last. Sharing the excess of full sources again by weight
    until none is above its ceiling ends where every open source has the same ``target / weight``;
    that level is found by running sums over the sources in order of ceiling / weight. A row for each
    source: this is the one table that is ordered in one task.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("__i") - 1) % len(weights) + 1).cast("int"))
    rated = (
        sources.withColumn("__i", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
        .withColumn("weight", w)
        .withColumn("__ceiling", F.col("source_size") * most_epochs)
        .withColumn("__rate", F.col("__ceiling") / F.col("weight"))
    )
    order = Window.orderBy("__rate", "__i").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    levels = (
        rated.withColumn("__left", F.sum("source_size").over(whole) - F.coalesce(F.sum("__ceiling").over(order), F.lit(0)))
        .withColumn("__weight_left", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(order), F.lit(0.0)))
        .withColumn("__level", F.col("__left") / F.col("__weight_left"))
    )
    # the first source in this order that its level doesn't fill
    level = F.min(F.when(F.col("__level") <= F.col("__rate"), F.struct("__rate", "__i", "__level"))).over(whole)["__level"]
    return levels.withColumn("target", F.least(F.coalesce(F.col("weight") * level, F.col("__ceiling").cast("double")), F.col("__ceiling").cast("double"))).select(
        "source", "source_size", "target"
    )


def mix(docs: DataFrame, id_col: str = "doc_id", weights=WEIGHTS, most_epochs: int = MOST_EPOCHS, seed: int = 17, run_rows: int = RUN_ROWS) -> DataFrame:
    """How often each document is taken: ``(id, source, size, source_size, target, repeats, taken)``.

    ``docs`` has ``id_col``, ``source`` and ``size`` (words, long). Documents of a source come in order of
    the md5 of seed and id (ties by id, then size). A source's budget is its target: whole epochs
    first, then the documents whose middle lies before the rest of the budget, so the words taken
    are within half a document of the target. Null ids hash as the empty string; equal ids of one
    source are told apart by size and may swap; null sources are one source; documents without words
    are in the mix as often as their source's epochs, with 0 words.
    """
    rows = docs.count()
    digits = (bits_for(rows, run_rows) + 3) // 4
    keyed = docs.select(
        F.col(id_col).alias("__id"), "source", F.col("size").cast("long"),
        F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("__source"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("__key"),
    ).withColumn("__run", F.substring("__key", 1, digits) if digits else F.lit(""))
    kept = stored(keyed, "mix")
    sources = targets(kept.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most_epochs)
    sources = sources.select(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("__source"), "source_size", "target")
    placed = running_sum(kept, "__source", "__run", ["__key", F.col("__id").asc_nulls_first(), "size"], "size", "__before")
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    epochs = F.floor(share)
    rest = F.col("target") - epochs * F.col("source_size")
    return (
        placed.join(sources, "__source")
        .withColumn("repeats", (epochs + F.when((F.col("__before") + F.col("size") / 2 < rest), 1).otherwise(0)).cast("int"))
        .select(F.col("__id").alias(id_col), "source", "size", "source_size", "target", "repeats", (F.col("repeats") * F.col("size")).cast("long").alias("taken"))
    )


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The mix itself: each row of ``docs``, with all its columns, as often as it is taken.

    Rows equal in id, source and number of words are taken equally often.
    """
    sized = docs.withColumn("__size", word_count(F.col(text_col)))
    taken = mix(sized.select(id_col, "source", F.col("__size").alias("size")), id_col).groupBy(
        F.col(id_col).alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__words")
    )
    taken = taken.agg(F.max("repeats").alias("__repeats")).where("__repeats > 0")
    same = F.col(id_col).eqNullSafe(F.col("__id")) & F.col("source").eqNullSafe(F.col("__source")) & (F.col("__size") == F.col("__words"))
    return sized.join(taken, same).withColumn("__epoch", F.explode(F.sequence(F.lit(1), "__repeats"))).select(*docs.columns)


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return mix(docs).select("doc_id", "source", "size", "source_size", "target", "taken")


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) AS i FROM d GROUP BY source
), r AS (
  SELECT *, CASE (i - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
         source_size * 3 AS ceiling, (source_size * 3) / CASE (i - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS rate
  FROM s
), l AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - CAST(coalesce(sum(ceiling) OVER o, 0) AS DOUBLE)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS lv
  FROM r WINDOW o AS (ORDER BY rate, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, least(coalesce(w * (SELECT lv FROM l WHERE lv <= rate ORDER BY rate, i LIMIT 1), CAST(ceiling AS DOUBLE)), CAST(ceiling AS DOUBLE)) AS target FROM l
), p AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d
)
SELECT p.doc_id, p.source, p.size, t.source_size, t.target,
       CAST((CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)
                  + CASE WHEN CAST(p.before AS DOUBLE) + p.size / 2 < t.target - floor(t.target / t.source_size) * t.source_size THEN 1 ELSE 0 END
             ELSE 0 END) * p.size AS BIGINT) AS taken
FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source
"""
