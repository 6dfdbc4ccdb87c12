"""Round trips of the assay's files: each query writes a table in its format to the shared folder and reads it again."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayflow.operators import enrich, link, matrix
from assayflow.plans import surrogates as s
from assayflow.plans.surrogates import BINS, DENSE, READS, SEQS, SETS, L, M
from assayflow.sources import tables
from assayflow.sources.scratch import scratch_path

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _lines(df, path, header=""):
    """Text lines ``(ord, value)`` in order, in one file."""
    if header:
        df = df.union(df.sparkSession.createDataFrame([(-1, header)], "ord long, value string"))
    df.orderBy("ord").select("value").coalesce(1).write.text(path)


@query(f"WITH {DENSE} SELECT peptide, sample, score FROM d")
def source_matrix(spark, d):
    m, path = s.scores(spark, d), scratch_path(spark, "matrix")
    tables.write_matrix(m, path, sorted(r[0] for r in m.select("sample").distinct().collect()))
    return tables.read_matrix(spark, path)


@query(f"WITH {DENSE} SELECT peptide, sample, CAST(round(score / 7, 2) AS DOUBLE) AS score FROM d")
def sink_matrix_digits(spark, d):
    m, path = matrix.densify(s.scores(spark, d)), scratch_path(spark, "matrix")
    tables.write_matrix(m.withColumn("score", F.round(F.col("score") / 7, 2)), path, sorted(r[0] for r in m.select("sample").distinct().collect()), digits=2)
    return tables.read_matrix(spark, path, strict=True)


@query(f"WITH {SEQS} SELECT name, seq FROM prot")
def source_fasta(spark, d):
    proteins, path = s.sequences(spark, d)[1], scratch_path(spark, "fasta")
    text = F.concat(F.lit(">"), "name", F.lit("\n"), F.regexp_replace("seq", "(.{40})", "$1\n"))
    proteins.select(text).write.text(path)
    return tables.read_fasta(spark, path).select("name", "seq")


def _fastq(spark, d, gzip):
    own, path = s.reads(spark, d).orderBy("read_id"), scratch_path(spark, "fastq")  # a file for each range of reads, named in their order
    tables.write_fastq(own.select(F.concat(F.lit("@r"), F.col("read_id").cast("string")).alias("name"), "seq", "qual"), f"{path}/1", gzip)
    tables.write_fastq(own.select(F.concat(F.lit("@r"), F.col("read_id").cast("string")).alias("name"), F.col("seq2").alias("seq"), F.substring("qual", 1, 10).alias("qual")), f"{path}/2", gzip)
    return tables.read_fastq(spark, f"{path}/1"), tables.read_fastq(spark, f"{path}/2")


_FASTQ = f"WITH {READS}, o AS (SELECT *, row_number() OVER (ORDER BY read_id) - 1 AS i FROM r)"


@query(f"{_FASTQ} SELECT i AS read_id, '@r' || CAST(read_id AS VARCHAR) AS name, seq, qual FROM o")
def source_fastq(spark, d):
    return _fastq(spark, d, False)[0]


@query(f"{_FASTQ} SELECT i AS read_id, '@r' || CAST(read_id AS VARCHAR) AS name, seq, qual, seq2, substr(qual, 1, 10) AS qual2 FROM o")
def source_fastq_pairs_gzip(spark, d):
    return tables.pair_reads(*_fastq(spark, d, True))


@query(f"WITH {READS} SELECT 'S' || CAST(read_id % 7 AS VARCHAR) AS sample, '@r' || CAST(read_id AS VARCHAR) AS name, seq, qual FROM r")
def sink_fastq_by_sample(spark, d):
    path = scratch_path(spark, "samples")
    own = s.reads(spark, d).select(F.concat(F.lit("S"), (F.col("read_id") % 7).cast("string")).alias("sample"), F.concat(F.lit("@r"), F.col("read_id").cast("string")).alias("name"), "seq", "qual")
    tables.write_fastq(own, path)
    parts = [tables.read_fastq(spark, f"{path}/sample=S{i}").select(F.lit(f"S{i}").alias("sample"), "name", "seq", "qual") for i in range(7)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(f"WITH {READS} SELECT ord, sample, id FROM smp")
def source_sample_sheet(spark, d):
    path = scratch_path(spark, "sheet")
    own = s.samples(spark, d).select("ord", F.concat_ws("\t", "sample", F.col("ids")[0], F.lit("none")).alias("value"))
    _lines(own, path, "SampleName\tIndex1\tIndex2")
    return tables.read_sample_sheet(spark, path, indexes=("Index1",)).select("ord", "sample", F.col("ids")[0].alias("id"))


@query(f"WITH {L} SELECT peptide, species, weight FROM l")
def source_links(spark, d):
    path = scratch_path(spark, "links")
    links = s.links(spark, d)
    tables.write_links(link.linkage_lines(links.select("peptide").distinct(), links), path)
    return tables.read_links(spark, path)


@query(f"WITH {M} SELECT DISTINCT peptide FROM m")
def source_name_list(spark, d):
    path = scratch_path(spark, "list")
    s.scores(spark, d).select("peptide").write.text(path)
    return tables.read_list(spark, path)


@query(f"WITH {M} SELECT DISTINCT sample AS name, CASE WHEN sample LIKE 'N%' THEN 'new' || sample END AS new_name FROM m")
def source_new_names(spark, d):
    path = scratch_path(spark, "names")
    own = s.scores(spark, d).select("sample").distinct()
    own.select(F.when(F.col("sample").like("N%"), F.concat("sample", F.lit("\tnew"), "sample")).otherwise(F.col("sample"))).write.text(path)
    return tables.read_names(spark, path)


@query(f"WITH {M}, {SETS}, n AS (SELECT set_id, string_agg(sample, '~' ORDER BY sample) AS label FROM sets GROUP BY 1) SELECT label AS set_id, sample FROM sets JOIN n USING (set_id)")
def source_replicate_sets(spark, d):
    path = scratch_path(spark, "sets")
    sets = enrich.replicate_sets(s.scores(spark, d)).groupBy("set_id").agg(F.sort_array(F.collect_set("sample")).alias("x"))
    sets.select(F.array_join("x", "\t")).write.text(path)
    return tables.read_sets(spark, path)


@query(f"WITH {M}, {SETS} SELECT set_id, sample FROM sets")
def source_replicate_names(spark, d):
    path = scratch_path(spark, "replicates")
    sets = enrich.replicate_sets(s.scores(spark, d)).groupBy("set_id").agg(F.sort_array(F.collect_set("sample")).alias("x"))
    sets.select(F.concat_ws("\t", "set_id", F.array_join("x", "\t"))).write.text(path)
    return tables.read_replicates(spark, path)


@query(f"WITH {M}, {BINS} SELECT bin_id, 'p' || peptide AS peptide FROM bins")
def source_bins(spark, d):
    path = scratch_path(spark, "bins")
    bins = s.bins_of(s.scores(spark, d)).withColumn("peptide", F.concat(F.lit("p"), "peptide"))
    tables.write_bins(bins, path)
    return tables.read_bins(spark, path)


@query(f"WITH {M} SELECT DISTINCT regexp_replace(sample, '_[^_]*$', '') AS sample, peptide FROM m WHERE score >= 60")
def source_enriched_folder(spark, d):
    path, found = scratch_path(spark, "enriched"), s.scores(spark, d).where("score >= 60")
    for name in sorted(r[0] for r in found.select(F.regexp_replace("sample", "_[^_]*$", "")).distinct().collect()):
        own = found.where(F.regexp_replace("sample", "_[^_]*$", "") == name).select("peptide").distinct()
        tables.write_named(own, f"{path}/{name}_enriched.txt")
    return tables.read_enriched_folder(spark, path)


@query(f"WITH {M}, {SETS}, e AS (SELECT DISTINCT set_id, peptide FROM m JOIN sets USING (sample) WHERE score >= 60) SELECT set_id, peptide FROM e")
def sink_enriched_by_set(spark, d):
    path, m = scratch_path(spark, "sets"), s.scores(spark, d)
    tables.write_enriched(m.where("score >= 60").join(enrich.replicate_sets(m), "sample").select("set_id", "peptide").distinct(), path)
    return spark.read.text(path).select("set_id", F.col("value").alias("peptide"))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS species, n_name AS name FROM nation WHERE n_nationkey > 0")
def source_ranked_lineage(spark, d):
    path, n = scratch_path(spark, "lineage"), s.table(spark, d, "nation")
    _lines(n.select(F.col("n_nationkey").cast("long").alias("ord"), F.concat(F.col("n_nationkey").cast("string"), F.lit("\t|\t"), "n_name", F.lit("\t|\t\t|")).alias("value")), path)
    return tables.read_ranked_lineage(spark, path)


@query("SELECT n_name AS species, CAST(n_regionkey + 0.5 AS DOUBLE) AS threshold FROM nation")
def source_thresholds(spark, d):
    path, n = scratch_path(spark, "thresholds"), s.table(spark, d, "nation")
    tables.write_report(n.select(F.col("n_name").alias("TaxID"), (F.col("n_regionkey") + 0.5).alias("Threshold")), path)
    return spark.createDataFrame(sorted(tables.read_thresholds(spark, path).items()), "species string, threshold double")


@query("SELECT n_name AS name, CAST(n_nationkey AS VARCHAR) AS species FROM nation")
def source_metadata(spark, d):
    path, n = scratch_path(spark, "metadata"), s.table(spark, d, "nation")
    tables.write_report(n.select(F.col("n_regionkey").alias("Other"), F.col("n_name").alias("Name"), F.col("n_nationkey").alias("Species")), path)
    return tables.read_metadata(spark, path, "Name", "Species")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS species, n_name AS name FROM nation")
def source_custom_ids(spark, d):
    path, n = scratch_path(spark, "ids"), s.table(spark, d, "nation")
    tables.write_report(n.select(F.col("n_nationkey").alias("Id"), F.col("n_name").alias("Label")), path)
    return tables.read_id_names(spark, path, "Id", "Label")


@query("SELECT 'Index' || CAST(r_regionkey AS VARCHAR) AS name, 'r' || CAST(r_regionkey % 2 + 1 AS VARCHAR) AS read, CAST(r_regionkey * 3 AS INTEGER) AS start, 12 AS length, CAST(r_regionkey % 3 AS INTEGER) AS mismatches FROM region")
def source_index_file(spark, d):
    path, r = scratch_path(spark, "index"), s.table(spark, d, "region")
    k = F.col("r_regionkey")
    text = F.concat_ws("\t", F.concat(F.lit("Index"), k.cast("string")), F.concat(F.lit("R"), (k % 2 + 1).cast("string")), (k * 3).cast("string"), F.lit("12"), (k % 3).cast("string"))
    _lines(r.select(k.cast("long").alias("ord"), text.alias("value")), path)
    return spark.createDataFrame(tables.read_index_file(spark, path), "name string, read string, start int, length int, mismatches int")


@query("SELECT n_name AS matrix, CAST(n_regionkey AS VARCHAR) AS threshold FROM nation")
def source_manifest(spark, d):
    path, n = scratch_path(spark, "manifest"), s.table(spark, d, "nation")
    n.select(F.concat_ws("\t", "n_name", F.col("n_regionkey").cast("string"))).write.text(path)
    return spark.createDataFrame(tables.read_manifest(spark, path), "matrix string, threshold string")
