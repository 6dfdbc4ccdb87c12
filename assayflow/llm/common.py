"""What the corpus operators share: stored tables, hash keys, distributed running sums."""

from __future__ import annotations

import functools
import math
import unicodedata

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayflow.functions.sizes import few  # noqa: F401
from assayflow.sources.scratch import scratch_path

#: A word, everywhere: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that one task sorts at a time where an operator orders rows by hash.
RUN_ROWS = 8192


def stored(df: DataFrame, name: str, hashes: bool = False) -> DataFrame:
    """``df`` written as Parquet in the shared checkpoint folder and read again: lineage ends there.

    The table outlives lost executors, and later readers see only its columns. ``hashes``: most columns hold hashes, of which no dictionary is tried.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("parquet.enable.dictionary", str(not hashes).lower()).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of :func:`stored` that nothing reads any more; what was made of them must be stored itself."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def doc_key(id_col: str, text_col: str) -> Column:
    """Rows equal in id and text are one document: two 64-bit hashes."""
    text = F.coalesce(text_col, F.lit(""))
    return F.struct(F.xxhash64(F.col(id_col), text).alias("a"), F.xxhash64(F.lit("doc"), F.col(id_col), text).alias("b"))


def bits_for(rows: int, per_bucket: int = RUN_ROWS, most: int = 24) -> int:
    """Bits of a hash prefix that leave about ``per_bucket`` rows in each bucket."""
    return min(most, max(0, math.ceil(math.log2(max(1, rows) / per_bucket))))


def top_bits(key: Column, bits: int) -> Column:
    """The leading ``bits`` of a 64-bit hash as an int."""
    return F.shiftrightunsigned(key, 64 - bits).cast("int") if bits else F.lit(0)


def unit(key: Column) -> Column:
    """A 64-bit hash as a double in [0, 1)."""
    return F.shiftrightunsigned(key, 11).cast("double") * F.lit(2.0**-53)


def running_sum(df: DataFrame, group: str, bucket: str, order: list, weight: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``weight`` over the rows of the same ``group`` that come before.

    ``bucket`` is a prefix of the order, so a group is never in one task: sums by bucket, their
    running sum (a row for each group and bucket), then a running sum inside each bucket.
    ``group`` and ``bucket`` hold no nulls. ``df`` is read twice, so it should be stored.
    """
    before = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        df.groupBy(group, bucket)
        .agg(F.sum(weight).alias("__sum"))
        .select(group, bucket, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__start"))
    )
    inside = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.join(starts, [group, bucket])
        .withColumn(out, F.col("__start") + F.coalesce(F.sum(weight).over(inside), F.lit(0)))
        .drop("__start")
    )


def id_text(id_col: str) -> Column:
    """An id on its way through Python, where long integers beside nulls would become doubles."""
    return F.col(id_col).cast("string").alias("id")


def id_back(df: DataFrame, docs: DataFrame, id_col: str) -> DataFrame:
    """The column ``id`` under its name and type in ``docs`` again, first."""
    rest = [c for c in df.columns if c != "id"]
    return df.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), *rest)


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


@functools.cache
def first_classes(kinds: tuple[str, ...]) -> np.ndarray:
    """For each code point, which of ``kinds`` its Unicode category begins with first; ``len(kinds)`` if none."""
    found = {c: next((i for i, k in enumerate(kinds) if c.startswith(k)), len(kinds)) for c in {unicodedata.category(chr(p)) for p in range(0x110000)}}
    return np.fromiter((found[unicodedata.category(chr(p))] for p in range(0x110000)), np.uint8, 0x110000)


def code_points_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
