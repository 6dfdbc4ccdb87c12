"""Assay inputs made from the general tables, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayflow.operators.demux import Slice

HEX, BASES = "0123456789abcdef", "ACGTACGTACGTACGT"
INDEX, TAG = Slice("seq", 2, 6, 1, "Index1"), Slice("seq", 8, 10, 2, "tag")
INDEX2 = Slice("seq2", 1, 4, 0, "Index2")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scores(spark: SparkSession, d: str) -> DataFrame:
    """Score matrix: parts as peptides, flag, status and line number as samples (seven replicates of a base name)."""
    x = table(spark, d, "lineitem")
    sample = F.concat("l_returnflag", "l_linestatus", F.lit("_"), F.col("l_linenumber").cast("string"))
    return x.groupBy(F.col("l_partkey").cast("string").alias("peptide"), sample.alias("sample")).agg(F.sum("l_quantity").alias("score"))


M = """m AS (SELECT CAST(l_partkey AS VARCHAR) AS peptide, l_returnflag || l_linestatus || '_' || CAST(l_linenumber AS VARCHAR) AS sample,
  sum(l_quantity) AS score FROM lineitem GROUP BY 1, 2)"""
DENSE = M + """, d AS (SELECT p.peptide, s.sample, coalesce(m.score, 0.0) AS score FROM (SELECT DISTINCT peptide FROM m) p
  CROSS JOIN (SELECT DISTINCT sample FROM m) s LEFT JOIN m ON m.peptide = p.peptide AND m.sample = s.sample)"""
SETS = """sets AS (SELECT DISTINCT regexp_replace(sample, '_[^_]*$', '') AS set_id, sample FROM m)"""
BINS = """bins AS (SELECT DISTINCT CAST(CAST(peptide AS BIGINT) % 7 + 1 AS INTEGER) AS bin_id, peptide FROM m)"""


def bins_of(m: DataFrame) -> DataFrame:
    return m.select((F.col("peptide").cast("long") % 7 + 1).cast("int").alias("bin_id"), "peptide").distinct()


def links(spark: SparkSession, d: str) -> DataFrame:
    """Linkage map: parts as peptides, suppliers as taxa, quantities as weights."""
    x = table(spark, d, "lineitem").where("l_quantity >= 30")
    return x.groupBy(F.col("l_partkey").cast("string").alias("peptide"), F.concat(F.lit("T"), (F.col("l_suppkey") % 25).cast("string")).alias("species")).agg(F.sum("l_quantity").alias("weight"))


L = """l AS (SELECT CAST(l_partkey AS VARCHAR) AS peptide, 'T' || CAST(l_suppkey % 25 AS VARCHAR) AS species, sum(l_quantity) AS weight
  FROM lineitem WHERE l_quantity >= 30 GROUP BY 1, 2)"""


def nucleotides(prefix: str, key: Column) -> Column:
    return F.translate(F.md5(F.concat(F.lit(prefix), key.cast("string"))), HEX, BASES)


def _nt(prefix: str, key: str) -> str:
    return f"translate(md5('{prefix}' || CAST({key} AS VARCHAR)), '{HEX}', '{BASES}')"


def barcodes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    return table(spark, d, "nation").select(F.concat(F.lit("F"), k.cast("string")).alias("id"), F.substring(nucleotides("b", k), 1, 6).alias("key"), k.alias("ord"))


def second_barcodes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("r_regionkey")
    return table(spark, d, "region").select(F.concat(F.lit("R"), k.cast("string")).alias("id"), F.substring(nucleotides("c", k), 1, 4).alias("key"), k.alias("ord"))


def library(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "supplier")
    return p.select(F.concat(F.lit("pep"), F.floor(F.col("s_suppkey") / 2).cast("string"), F.lit("-"), (F.col("s_suppkey") % 2).cast("string")).alias("name"), F.substring(nucleotides("p", F.col("s_suppkey")), 1, 10).alias("key"), F.col("s_suppkey").alias("ord"))


def samples(spark: SparkSession, d: str) -> DataFrame:
    """A sample for each barcode."""
    return barcodes(spark, d).select("ord", F.concat(F.lit("S"), (F.col("ord") % 5).cast("string"), F.lit("_"), F.col("ord").cast("string")).alias("sample"), F.array("id").alias("ids"))


def paired_samples(spark: SparkSession, d: str) -> DataFrame:
    one, two = barcodes(spark, d), second_barcodes(spark, d).select(F.col("id").alias("id2"), F.col("ord").alias("ord2"))
    both = one.join(two, one["ord"] % 5 == F.col("ord2"))
    return both.select("ord", F.concat(F.lit("S"), F.col("ord").cast("string")).alias("sample"), F.array("id", "id2").alias("ids"))


def reads(spark: SparkSession, d: str) -> DataFrame:
    """A read for each order: two bases, barcode, tag, tail; by order key it is whole, shifted by one either way, or has substitutions."""
    k = F.col("o_orderkey")
    code, tag, tail = F.substring(nucleotides("b", k % 25), 1, 6), F.substring(nucleotides("p", k * 7 % 200), 1, 10), F.substring(nucleotides("r", k), 1, 12)
    changed = F.concat(F.translate(F.substring(code, 1, 1), "ACGT", "CGTA"), F.substring(code, 2, 5), F.substring(tag, 1, 3), F.translate(F.substring(tag, 4, 1), "ACGT", "GTAC"), F.substring(tag, 5, 6))
    whole = F.concat(code, tag)
    seq = F.when(k % 5 == 2, F.concat(F.lit("G"), whole, tail)).when(k % 5 == 3, F.concat(F.lit("GAT"), whole, tail)).when(k % 5 == 4, F.concat(F.lit("GA"), changed, tail)).otherwise(F.concat(F.lit("GA"), whole, tail))
    second = F.concat(F.lit("T"), F.substring(nucleotides("c", k % 25 % 5), 1, 4), F.substring(nucleotides("q", k), 1, 5))
    qual = F.translate(F.md5(F.concat(F.lit("u"), k.cast("string"))), HEX, "!#%')+-/13579;=?")
    return table(spark, d, "orders").select(k.alias("read_id"), seq.alias("seq"), second.alias("seq2"), qual.alias("qual"))


READS = f"""bc AS (SELECT 'F' || CAST(n_nationkey AS VARCHAR) AS id, substr({_nt("b", "n_nationkey")}, 1, 6) AS key, n_nationkey AS ord FROM nation),
bc2 AS (SELECT 'R' || CAST(r_regionkey AS VARCHAR) AS id, substr({_nt("c", "r_regionkey")}, 1, 4) AS key, r_regionkey AS ord FROM region),
lib AS (SELECT 'pep' || CAST(s_suppkey // 2 AS VARCHAR) || '-' || CAST(s_suppkey % 2 AS VARCHAR) AS name, substr({_nt("p", "s_suppkey")}, 1, 10) AS key, s_suppkey AS ord FROM supplier),
smp AS (SELECT ord, 'S' || CAST(ord % 5 AS VARCHAR) || '_' || CAST(ord AS VARCHAR) AS sample, id FROM bc),
r0 AS (SELECT o_orderkey AS k, substr({_nt("b", "o_orderkey % 25")}, 1, 6) AS code, substr({_nt("p", "o_orderkey * 7 % 200")}, 1, 10) AS tag, substr({_nt("r", "o_orderkey")}, 1, 12) AS tail FROM orders),
r AS (SELECT k AS read_id, CASE k % 5 WHEN 2 THEN 'G' || code || tag || tail WHEN 3 THEN 'GAT' || code || tag || tail
    WHEN 4 THEN 'GA' || translate(substr(code, 1, 1), 'ACGT', 'CGTA') || substr(code, 2, 5) || substr(tag, 1, 3) || translate(substr(tag, 4, 1), 'ACGT', 'GTAC') || substr(tag, 5, 6) || tail
    ELSE 'GA' || code || tag || tail END AS seq,
  'T' || substr({_nt("c", "k % 25 % 5")}, 1, 4) || substr({_nt("q", "k")}, 1, 5) AS seq2,
  translate(md5('u' || CAST(k AS VARCHAR)), '{HEX}', '!#%'')+-/13579;=?') AS qual FROM r0)"""


def shift_sql(name: str, at: Slice, keys: str) -> str:
    """A table expression ``name (read_id, key)`` of exact and shifted matches."""
    s = at.start
    tried = ", ".join(f"({i}, {p})" for i, p in enumerate((s, s - 1, s - 2, s + 1)))
    return f"""{name}_x AS (SELECT read_id, key, row_number() OVER (PARTITION BY read_id ORDER BY rank) AS i FROM (
  SELECT r.read_id, v.rank, substr(r.{at.column}, v.p + 1, {at.length}) AS key FROM r, (VALUES {tried}) v(rank, p) WHERE v.p >= 0 AND length(r.{at.column}) >= v.p + {at.length})
  WHERE key IN (SELECT key FROM {keys})), {name} AS (SELECT read_id, key FROM {name}_x WHERE i = 1)"""


def tolerant_sql(name: str, at: Slice, keys: str, ambiguous: str) -> str:
    """As :func:`shift_sql`, with substitutions for the reads left over."""
    rule = "n = 1" if ambiguous == "discard" else "i = 1"
    return f"""{shift_sql(name + "_e", at, keys)}, {name}_h AS (
  SELECT r.read_id, b.key, hamming(substr(r.{at.column}, {at.start + 1}, {at.length}), b.key) AS distance, b.ord FROM r, (SELECT key, min(ord) AS ord FROM {keys} GROUP BY key) b
  WHERE length(r.{at.column}) >= {at.start + at.length} AND r.read_id NOT IN (SELECT read_id FROM {name}_e)
    AND hamming(substr(r.{at.column}, {at.start + 1}, {at.length}), b.key) <= {at.mismatches}),
{name}_n AS (SELECT *, count(*) OVER (PARTITION BY read_id, distance) AS n, min(distance) OVER (PARTITION BY read_id) AS md,
  row_number() OVER (PARTITION BY read_id ORDER BY distance, ord, key) AS i FROM {name}_h),
{name} AS (SELECT * FROM {name}_e UNION ALL SELECT read_id, key FROM {name}_n WHERE distance = md AND {rule})"""


def sequences(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(peptides, proteins): 30 letters of md5 text for each part; proteins are joined from peptides, by supplier."""
    letters = "ACDEFGHIKLMNPXQR"
    p = table(spark, d, "part").select("p_partkey", F.translate(F.md5(F.concat(F.lit("s"), (F.col("p_partkey") % 300).cast("string"))), HEX, letters).alias("seq"))
    peptides = p.select(F.col("p_partkey").cast("string").alias("peptide"), F.substring("seq", 1, 20).alias("seq"))
    s = table(spark, d, "supplier").select("s_suppkey")
    seq = F.concat(*[F.translate(F.md5(F.concat(F.lit("s"), ((F.col("s_suppkey") * m) % 300).cast("string"))), HEX, letters) for m in (1, 3, 7)])
    proteins = s.select(F.concat(F.lit("P"), F.col("s_suppkey").cast("string"), F.lit(" OXX=1,"), (F.col("s_suppkey") % 10).cast("string"), F.lit(",3,4")).alias("name"), seq.alias("seq"))
    return peptides, proteins


_S = "translate(md5('s' || CAST({} AS VARCHAR)), '0123456789abcdef', 'ACDEFGHIKLMNPXQR')"
SEQS = f"""pep AS (SELECT CAST(p_partkey AS VARCHAR) AS peptide, substr({_S.format("p_partkey % 300")}, 1, 20) AS seq FROM part),
prot AS (SELECT 'P' || CAST(s_suppkey AS VARCHAR) || ' OXX=1,' || CAST(s_suppkey % 10 AS VARCHAR) || ',3,4' AS name, CAST(s_suppkey % 10 AS VARCHAR) AS species, {" || ".join(_S.format(f"(s_suppkey * {m}) % 300") for m in (1, 3, 7))} AS seq FROM supplier)"""


def kmer_sql(source: str, keep: str, k: int, name: str) -> str:
    return f"""{name} AS (SELECT {keep}, substr(seq, CAST(i AS BIGINT), {k}) AS kmer FROM {source}, range(1, 200) t(i) WHERE i <= length(seq) - {k} + 1 AND NOT contains(substr(seq, CAST(i AS BIGINT), {k}), 'X'))"""
