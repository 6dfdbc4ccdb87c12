"""Labelled matrices in long form ``(peptide, sample, score)``: filters, renaming, joins, dense fill, wide form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELL = ["peptide", "sample"]


def filter_rows(m: DataFrame, names: DataFrame) -> DataFrame:
    """Rows of the peptides in ``names (peptide)``."""
    return m.join(names.select("peptide").distinct(), "peptide", "left_semi")


def filter_cols(m: DataFrame, names: DataFrame) -> DataFrame:
    return m.join(names.select("sample").distinct(), "sample", "left_semi")


def exclude(m: DataFrame, names: DataFrame, axis: str = "sample") -> DataFrame:
    """Everything but the listed names of an axis."""
    return m.join(names.select(axis).distinct(), axis, "left_anti")


def regex_filter(m: DataFrame, pattern: str, axis: str = "sample") -> DataFrame:
    return m.where(F.col(axis).rlike(pattern))


def rename(m: DataFrame, names: DataFrame, axis: str = "sample") -> DataFrame:
    """``names (name, new_name)``: listed labels get their new name; others stay."""
    to = names.select(F.col("name").alias("__name"), "new_name")
    return m.join(to, m[axis] == F.col("__name"), "left").withColumn(axis, F.coalesce("new_name", axis)).drop("__name", "new_name")


def select_renamed(m: DataFrame, names: DataFrame, axis: str = "sample") -> DataFrame:
    """Only the listed labels, with their new names where given."""
    to = names.select(F.col("name").alias("__name"), "new_name")
    return m.join(to, m[axis] == F.col("__name")).withColumn(axis, F.coalesce("new_name", axis)).drop("__name", "new_name")


def densify(m: DataFrame) -> DataFrame:
    """All peptides by all samples; absent cells are 0."""
    cells = m.select("peptide").distinct().crossJoin(m.select("sample").distinct())
    return cells.join(m, CELL, "left").select(*CELL, F.coalesce("score", F.lit(0.0)).alias("score"))


def outer_join(left: DataFrame, right: DataFrame, resolve: str = "include", left_name: str = "left", right_name: str = "right") -> DataFrame:
    """Union of labels of two matrices, filled with 0.

    ``resolve`` says what happens to cells of both: ``ignore`` takes the right one, ``combine`` adds them, ``include``
    renames peptides of both to ``peptide_file``, on either side.
    """
    if resolve == "combine":
        return densify(left.unionByName(right).groupBy(*CELL).agg(F.sum("score").alias("score")))
    if resolve == "include":
        both = left.select("peptide").intersect(right.select("peptide")).withColumn("__both", F.lit(True))
        named = [
            x.join(both, "peptide", "left").withColumn("peptide", F.when(F.col("__both"), F.concat_ws("_", "peptide", F.lit(name))).otherwise(F.col("peptide"))).drop("__both")
            for x, name in ((left, left_name), (right, right_name))
        ]
        return densify(named[0].unionByName(named[1]))
    if resolve != "ignore":
        raise ValueError(f"unknown way to resolve duplicates: {resolve}")
    joined = left.withColumnRenamed("score", "__l").join(right.withColumnRenamed("score", "__r"), CELL, "full_outer")
    return densify(joined.select(*CELL, F.coalesce("__r", "__l").alias("score")))


def join_all(matrices: list[tuple[str, DataFrame]], resolve: str = "include") -> DataFrame:
    """A left fold of :func:`outer_join` over named matrices, in order."""
    return reduce(lambda a, b: (a[0], outer_join(a[1], b[1], resolve, a[0], b[0])), matrices)[1]


def different(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cells that are in one matrix and not the other; none if the matrices are equal. Cells are counted once, for both ways: more in the first, or fewer."""
    both = a.select(*CELL, "score", F.lit(1).alias("side")).unionByName(b.select(*CELL, "score", F.lit(-1).alias("side")))
    left = both.groupBy(*CELL, "score").agg(F.sum("side").alias("more")).where("more <> 0")
    only = F.when(F.col("more") > 0, "first").otherwise("second")
    return left.select(*CELL, "score", F.explode(F.array_repeat(only, F.abs("more").cast("int"))).alias("only_in"))


def wide(m: DataFrame, samples: list[str]) -> DataFrame:
    """A row for each peptide, a column for each of the samples, in order."""
    return m.groupBy(F.col("peptide").alias("Sequence name")).pivot("sample", samples).agg(F.first("score"))


def long(w: DataFrame) -> DataFrame:
    """Long form of a wide matrix whose first column has the row labels."""
    first, *rest = w.columns
    return w.unpivot([first], rest, "sample", "score").select(F.col(first).alias("peptide"), "sample", F.col("score").cast("double").alias("score"))


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b).distinct()
