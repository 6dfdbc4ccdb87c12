"""Readers and writers of the assay's text files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayflow.operators import matrix


def read_matrix(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Long form of a tab-separated score matrix; cells that are no numbers or missing are 0 (or, if ``strict``, an error)."""
    w = spark.read.csv(path, sep="\t", header=True, ignoreTrailingWhiteSpace=True)
    first, *rest = w.columns
    cell = F.lower(F.trim("value"))
    number = F.when(cell.isin("nan", "-nan"), F.lit(float("nan"))).when(cell.isin("inf", "+inf"), F.lit(float("inf"))).when(cell == "-inf", F.lit(float("-inf"))).otherwise(F.try_to_number("value", F.lit("S999999999999D999999")).cast("double"))
    number = F.coalesce(F.expr("try_cast(value AS double)"), number)
    other = F.raise_error(F.concat(F.lit("not a number: "), F.coalesce("value", F.lit("missing")))).cast("double") if strict else F.lit(0.0)
    return w.unpivot([first], rest, "sample", "value").select(F.col(first).alias("peptide"), "sample", F.coalesce(number, other).alias("score"))


def write_matrix(m: DataFrame, path: str, samples: list[str], digits: int | None = None) -> None:
    """One tab-separated file, samples in order, peptides sorted. A report's size: it is written by one task."""
    shown = m if digits is None else m.withColumn("score", F.format_string(f"%.{digits}f", "score"))
    matrix.wide(shown, samples).orderBy("Sequence name").coalesce(1).write.csv(path, sep="\t", header=True, mode="overwrite")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """``(ord, name, seq)``: records from ``>`` on, sequence lines joined. Splits by record, so files are read in parallel."""
    raw = spark.read.text(path, lineSep=">").where("trim(value) <> ''").withColumn("ord", F.monotonically_increasing_id())
    lines = F.split("value", "\r?\n")
    seq = F.array_join(F.transform(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(1))), lambda x: F.trim(x)), "")
    return raw.select("ord", F.rtrim(lines[0]).alias("name"), seq.alias("seq"))


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """``(read_id, name, seq, qual)`` of four-line records, plain or gzip, in a file or in files that are taken in the order of their names.

    ``read_id`` is the record's place, so that two inputs pair by it. Line numbers come from the sizes of the pieces that files are read in:
    their counts are the only data that the driver sees. Spark deals pieces to partitions by size, so they are put in order by file and
    offset. Records are put together where they are read; only the lines of records that two pieces share are shuffled.
    """
    raw = spark.read.text(path).withColumn("id", F.monotonically_increasing_id())
    part, at = F.shiftright("id", 33).cast("int"), F.col("id").bitwiseAND((1 << 33) - 1)
    by = raw.select(part.alias("part"), at.alias("at"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("offset"))
    sizes = by.groupBy("part", "file", "offset").agg(F.min("at").alias("first"), F.count("*").alias("n")).orderBy("file", "offset").collect()
    spans, total = [], 0
    for r in sizes:
        spans.append((r["part"], r["first"], r["first"] + r["n"], total, total + r["n"]))
        total += r["n"]
    if total % 4:
        raise ValueError(f"{total} lines are not whole records of four")
    begin = spark.createDataFrame(spans, "of int, first long, last long, start long, stop long")
    lines = raw.select(part.alias("part"), at.alias("at"), F.rtrim("value").alias("value"))
    lines = lines.join(F.broadcast(begin), (F.col("part") == F.col("of")) & (F.col("at") >= F.col("first")) & (F.col("at") < F.col("last")))
    lines = lines.select("value", (F.col("start") + F.col("at") - F.col("first")).alias("line"), "start", "stop").withColumn("read_id", F.floor(F.col("line") / 4))
    whole = (F.col("read_id") * 4 >= F.col("start")) & (F.col("read_id") * 4 + 3 < F.col("stop"))

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[str] = []
        ids: list[int] = []
        for batch in batches:
            kept += batch["value"].tolist()
            ids += batch["read_id"].tolist()
            n = len(kept) // 4 * 4
            if n:
                yield pd.DataFrame({"read_id": ids[0:n:4], "name": kept[0:n:4], "seq": kept[1:n:4], "qual": kept[3:n:4]})
                kept, ids = kept[n:], ids[n:]

    of = lambda i: F.max(F.when(F.col("line") % 4 == i, F.col("value")))
    edges = lines.where(~whole).groupBy("read_id").agg(of(0).alias("name"), of(1).alias("seq"), of(3).alias("qual"))
    inner = lines.where(whole).select("read_id", "value").mapInPandas(records, "read_id long, name string, seq string, qual string")
    return inner.unionByName(edges)


def pair_reads(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both reads of each record: ``seq2`` and ``qual2`` are the second's."""
    return first.join(second.select("read_id", F.col("seq").alias("seq2"), F.col("qual").alias("qual2")), "read_id")


def write_fastq(reads: DataFrame, path: str, gzip: bool = False, mode: str = "error") -> None:
    """A folder for each sample; reads without a ``sample`` column go to one folder."""
    record = F.concat_ws("\n", "name", "seq", F.lit("+"), "qual").alias("value")
    by = [c for c in ("sample",) if c in reads.columns]
    reads.select(*by, record).write.mode(mode).partitionBy(*by).option("compression", "gzip" if gzip else "none").text(path)


def read_sample_sheet(spark: SparkSession, path: str, name: str = "SampleName", indexes: tuple[str, ...] = ("Index1", "Index2")) -> DataFrame:
    """``(ord, sample, ids)``; missing columns and samples with equal indexes are errors."""
    sheet = spark.read.csv(path, sep="\t", header=True)
    if missing := {name, *indexes} - set(sheet.columns):
        raise ValueError(f"sample sheet lacks {sorted(missing)}")
    out = sheet.select(F.monotonically_increasing_id().alias("ord"), F.trim(name).alias("sample"), F.array(*[F.trim(i) for i in indexes]).alias("ids"))
    if twice := out.groupBy("ids").count().where("count > 1").head(1):
        raise ValueError(f"several samples have the indexes {twice[0]['ids']}")
    return out


def read_index_file(spark: SparkSession, path: str) -> list[tuple[str, str, int, int, int]]:
    """(index, read, start, length, mismatches) lines; the read is r1 or r2."""
    out = []
    for i, line in enumerate(r["value"] for r in spark.read.text(path).collect()):
        cells = line.rstrip().split("\t")
        if cells == [""]:
            continue
        if len(cells) < 5:
            raise ValueError(f"line {i + 1} of the index file has {len(cells)} columns")
        out.append((cells[0], cells[1][:1].lower() + cells[1][1:], *map(int, cells[2:5])))
    return out


def read_links(spark: SparkSession, path: str) -> DataFrame:
    """``(peptide, species, weight)`` of a linkage map; an id without a score is an error, peptides without links have no rows."""
    raw = spark.read.csv(path, sep="\t", header=True, schema="peptide string, links string")
    each = raw.where("links is not null").select("peptide", F.explode(F.split("links", ",")).alias("x")).where("trim(x) <> ''")
    parts = F.split("x", ":")
    weight = F.when(F.size(parts) == 2, parts[1].cast("double")).otherwise(F.raise_error(F.concat(F.lit("link without a score: "), "x")).cast("double"))
    return each.select("peptide", F.trim(parts[0]).alias("species"), weight.alias("weight"))


def write_links(lines: DataFrame, path: str) -> None:
    lines.write.csv(path, sep="\t", header=True, mode="overwrite")


def read_list(spark: SparkSession, path: str, column: str = "peptide") -> DataFrame:
    """Distinct names, one a line."""
    return spark.read.text(path).select(F.rtrim("value").alias(column)).where(F.col(column) != "").distinct()


def read_enriched_folder(spark: SparkSession, folder: str, ending: str = "_enriched.txt") -> DataFrame:
    """``(sample, peptide)`` of every file (or folder of part files) of that ending; the sample is its name without it."""
    raw = spark.read.option("recursiveFileLookup", "true").text(folder)
    name = F.element_at(F.filter(F.split(F.url_decode(F.col("_metadata.file_path")), "/"), lambda x: x.endswith(ending)), -1)
    of = raw.select(F.when(F.col("_metadata.file_path").contains(ending), F.substring_index(name, ending, 1)).alias("sample"), F.rtrim("value").alias("peptide"))
    return of.where("sample is not null and peptide <> ''").distinct()


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """``(name, new_name)``; the second column is optional."""
    parts = F.split(F.rtrim("value"), "\t")
    return spark.read.text(path).where("trim(value) <> ''").select(parts[0].alias("name"), F.try_element_at(parts, F.lit(2)).alias("new_name"))


def read_sets(spark: SparkSession, path: str) -> DataFrame:
    """``(set_id, sample)``: a set for each line, named by its samples."""
    parts = F.filter(F.split(F.rtrim("value"), "\t"), lambda x: x != "")
    return spark.read.text(path).where("trim(value) <> ''").select(F.array_join(parts, "~").alias("set_id"), F.explode(parts).alias("sample"))


def read_replicates(spark: SparkSession, path: str) -> DataFrame:
    """``(set_id, sample)``: a base name and its replicates in each line."""
    parts = F.split(F.rtrim("value"), "\t")
    return spark.read.text(path).where("trim(value) <> ''").select(parts[0].alias("set_id"), F.explode(F.slice(parts, 2, 1_000_000)).alias("sample"))


def read_bins(spark: SparkSession, path: str) -> DataFrame:
    """``(bin_id, peptide)``: a bin for each line that isn't blank, from 1; a file whose second line has numbers is no bin file."""
    lines = [r["value"].strip() for r in spark.read.text(path).collect()]
    kept = [x.split("\t") for x in lines if x]

    def number(x: str) -> bool:
        try:
            float(x)
        except ValueError:
            return False
        return True

    if len(kept) > 1 and any(map(number, kept[1])):
        raise ValueError("the second line has numbers: this looks like a score matrix")
    return spark.createDataFrame([(i + 1, p) for i, b in enumerate(kept) for p in b], "bin_id int, peptide string")


def write_bins(bins: DataFrame, path: str) -> None:
    by = bins.groupBy("bin_id").agg(F.array_join(F.sort_array(F.collect_list("peptide")), "\t").alias("value"))
    by.orderBy("bin_id").select("value").coalesce(1).write.mode("overwrite").text(path)


def read_thresholds(spark: SparkSession, path_or_number: str) -> dict[str, float]:
    """Thresholds by species; a plain number holds for all (key ``""``), others have 0."""
    if path_or_number.strip().lstrip("-").isdigit():
        return {"": float(path_or_number)}
    rows = spark.read.csv(path_or_number, sep="\t", header=True)
    if len(rows.columns) != 2:
        raise ValueError("a threshold file has two columns")
    return {r[0]: float(r[1]) for r in rows.collect()}


def read_ranked_lineage(spark: SparkSession, path: str) -> DataFrame:
    """``(species, name)`` of lines parted by bars; the first name of an id counts, the first line doesn't."""
    parts = F.split("value", r"\s*\|\s*")
    raw = spark.read.text(path).withColumn("ord", F.monotonically_increasing_id())
    named = raw.where("ord > 0").select("ord", F.trim(parts[0]).alias("species"), parts[1].alias("name"))
    return named.groupBy("species").agg(F.min_by("name", "ord").alias("name"))


def read_id_names(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    """``(species, name)`` from two columns of a table with a header."""
    return spark.read.csv(path, sep="\t", header=True).select(F.col(key).alias("species"), F.col(value).alias("name"))


def read_metadata(spark: SparkSession, path: str, name: str, taxon: str) -> DataFrame:
    """``(name, species)`` of proteins; both columns must be there."""
    table = spark.read.csv(path, sep="\t", header=True)
    if missing := {name, taxon} - set(table.columns):
        raise ValueError(f"metadata lacks {sorted(missing)}")
    return table.select(F.col(name).alias("name"), F.col(taxon).alias("species"))


def read_manifest(spark: SparkSession, path: str) -> list[list[str]]:
    """The cells of each line: matrices with name lists, or with thresholds."""
    return [r["value"].rstrip().split("\t") for r in spark.read.text(path).collect() if r["value"].strip()]


def write_report(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.csv(path, sep="\t", header=True, mode="overwrite")


def write_enriched(enriched: DataFrame, path: str) -> None:
    """A folder for each set."""
    enriched.select("set_id", F.col("peptide").alias("value")).write.partitionBy("set_id").mode("overwrite").text(path)


def write_named(names: DataFrame, path: str) -> None:
    """One name a line in a folder of that name, which readers take as a file; ``read_enriched_folder`` finds it by its ending."""
    names.coalesce(1).write.mode("overwrite").text(path)
