"""A query for each operator over the general tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayflow.functions import semantics as sem
from assayflow.operators import binning, clusters, deconv, demux, enrich, extras, info, link, matrix, normalize
from assayflow.plans import files
from assayflow.plans import surrogates as s
from assayflow.plans.surrogates import BINS, DENSE, INDEX, INDEX2, READS, SEQS, SETS, TAG, L, M
from assayflow.plans.workflow import flagship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        name = f.__name__.rstrip("_")
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return register


def r6(x: str):
    """A computed double, rounded so that the order of sums doesn't show: as in SQL, the nearest whole number of millionths, where ``round`` goes by its decimal digits."""
    return sem.round_binary(F.col(x), 6).alias(x)


def dense(spark: SparkSession, d: str) -> DataFrame:
    return matrix.densify(s.scores(spark, d))


# ---- matrices ----
@query(f"WITH {M} SELECT * FROM m WHERE peptide IN (SELECT CAST(p_partkey AS VARCHAR) FROM part WHERE p_size < 10)")
def matrix_filter_rows(spark, d):
    names = s.table(spark, d, "part").where("p_size < 10").select(F.col("p_partkey").cast("string").alias("peptide"))
    return matrix.filter_rows(s.scores(spark, d), names)


@query(f"WITH {M} SELECT * FROM m WHERE sample IN (SELECT DISTINCT sample FROM m WHERE sample LIKE '%_3')")
def matrix_filter_cols(spark, d):
    m = s.scores(spark, d)
    return matrix.filter_cols(m, m.where("sample like '%\\_3'").select("sample"))


@query(f"WITH {M} SELECT * FROM m WHERE sample NOT LIKE 'N%'")
def matrix_exclude(spark, d):
    m = s.scores(spark, d)
    return matrix.exclude(m, m.where("sample like 'N%'").select("sample"))


@query(f"WITH {M} SELECT * FROM m WHERE regexp_matches(sample, '^[AR].*[1-3]$')")
def matrix_regex_filter(spark, d):
    return matrix.regex_filter(s.scores(spark, d), "^[AR].*[1-3]$")


@query(f"WITH {M} SELECT peptide, CASE WHEN sample = 'NO_1' THEN 'first' WHEN sample = 'RF_2' THEN 'second' ELSE sample END AS sample, score FROM m")
def matrix_rename(spark, d):
    names = spark.createDataFrame([("NO_1", "first"), ("RF_2", "second")], "name string, new_name string")
    return matrix.rename(s.scores(spark, d), names)


@query(f"WITH {M} SELECT peptide, coalesce(nn, sample) AS sample, score FROM m JOIN (VALUES ('NO_1', 'first'), ('RF_2', NULL)) v(n, nn) ON sample = n")
def matrix_select_renamed(spark, d):
    names = spark.createDataFrame([("NO_1", "first"), ("RF_2", None)], "name string, new_name string")
    return matrix.select_renamed(s.scores(spark, d), names)


@query(f"WITH {DENSE} SELECT * FROM d")
def matrix_densify(spark, d):
    return dense(spark, d)


def _halves(spark, d):
    m = s.scores(spark, d)
    return m.where("sample like '%\\_1' or sample like '%\\_2'"), m.where("sample like '%\\_2' or sample like '%\\_3'").withColumn("score", F.col("score") + 1)


_HALVES = M + """, a AS (SELECT * FROM m WHERE sample LIKE '%\\_1' ESCAPE '\\' OR sample LIKE '%\\_2' ESCAPE '\\'),
b AS (SELECT peptide, sample, score + 1 AS score FROM m WHERE sample LIKE '%\\_2' ESCAPE '\\' OR sample LIKE '%\\_3' ESCAPE '\\')"""
_FILL = """, p AS (SELECT DISTINCT peptide FROM j), q AS (SELECT DISTINCT sample FROM j)
SELECT p.peptide, q.sample, coalesce(j.score, 0.0) AS score FROM p CROSS JOIN q LEFT JOIN j ON j.peptide = p.peptide AND j.sample = q.sample"""


@query(f"WITH {_HALVES}, j AS (SELECT coalesce(a.peptide, b.peptide) AS peptide, coalesce(a.sample, b.sample) AS sample, coalesce(b.score, a.score) AS score FROM a FULL JOIN b ON a.peptide = b.peptide AND a.sample = b.sample){_FILL}")
def matrix_outer_ignore(spark, d):
    return matrix.outer_join(*_halves(spark, d), "ignore")


@query(f"WITH {_HALVES}, j AS (SELECT peptide, sample, sum(score) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1, 2){_FILL}")
def matrix_outer_combine(spark, d):
    return matrix.outer_join(*_halves(spark, d), "combine")


@query(f"""WITH {_HALVES}, c AS (SELECT peptide FROM a INTERSECT SELECT peptide FROM b), j AS (
  SELECT CASE WHEN peptide IN (SELECT peptide FROM c) THEN peptide || '_left' ELSE peptide END AS peptide, sample, score FROM a UNION ALL
  SELECT CASE WHEN peptide IN (SELECT peptide FROM c) THEN peptide || '_right' ELSE peptide END, sample, score FROM b){_FILL}""")
def matrix_outer_include(spark, d):
    return matrix.outer_join(*_halves(spark, d), "include")


@query(f"WITH {_HALVES} (SELECT *, 'first' AS only_in FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) UNION ALL (SELECT *, 'second' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a))")
def matrix_different(spark, d):
    return matrix.different(*_halves(spark, d))


@query(f"WITH {M} SELECT peptide AS \"Sequence name\", max(CASE WHEN sample = 'NO_1' THEN score END) AS \"NO_1\", max(CASE WHEN sample = 'RF_2' THEN score END) AS \"RF_2\" FROM m GROUP BY 1")
def matrix_wide(spark, d):
    return matrix.wide(s.scores(spark, d), ["NO_1", "RF_2"])


@query(f"WITH {M}, w AS (SELECT peptide, max(CASE WHEN sample = 'NO_1' THEN score END) AS x, max(CASE WHEN sample = 'RF_2' THEN score END) AS y FROM m GROUP BY 1) SELECT peptide, 'NO_1' AS sample, x AS score FROM w UNION ALL SELECT peptide, 'RF_2', y FROM w")
def matrix_long(spark, d):
    return matrix.long(matrix.wide(s.scores(spark, d), ["NO_1", "RF_2"]))


def _names(spark, d):
    m = s.scores(spark, d)
    return m.where("sample = 'NO_1'").select("peptide"), m.where("sample = 'RF_2'").select("peptide")


_NAMES = M + ", a AS (SELECT peptide FROM m WHERE sample = 'NO_1'), b AS (SELECT peptide FROM m WHERE sample = 'RF_2')"


@query(f"WITH {_NAMES} SELECT peptide FROM a INTERSECT SELECT peptide FROM b")
def set_intersection(spark, d):
    return matrix.intersection(*_names(spark, d))


@query(f"WITH {_NAMES} SELECT peptide FROM a UNION SELECT peptide FROM b")
def set_union(spark, d):
    return matrix.union(*_names(spark, d))


@query(f"WITH {_NAMES} SELECT peptide FROM a EXCEPT SELECT peptide FROM b")
def set_difference(spark, d):
    return matrix.difference(*_names(spark, d))


# ---- info ----
@query(f"WITH {M} SELECT count(DISTINCT sample) AS n_samples, count(DISTINCT peptide) AS n_peptides FROM m")
def info_counts(spark, d):
    return info.counts(s.scores(spark, d))


@query(f"WITH {M} SELECT sample, sum(score) AS col_sum FROM m GROUP BY 1")
def info_col_sums(spark, d):
    return normalize.column_sums(s.scores(spark, d))


@query(f"WITH {M}, {SETS}, n AS (SELECT set_id, count(*) AS n FROM sets GROUP BY 1) SELECT peptide, set_id AS sample, round(sum(score) / any_value(n), 6) AS score FROM m JOIN sets USING (sample) JOIN n USING (set_id) GROUP BY 1, 2")
def info_rep_avgs(spark, d):
    m = s.scores(spark, d)
    return info.replicate_averages(m, enrich.replicate_sets(m)).select("peptide", "sample", r6("score"))


@query(f"WITH {M}, {SETS}, l AS (SELECT set_id, CASE WHEN sample LIKE 'N%' THEN 'no' || sample ELSE sample END AS sample FROM sets UNION ALL SELECT set_id, sample FROM sets WHERE sample = 'RF_1') SELECT sample, count(*) AS times, sample IN (SELECT sample FROM m) AS known FROM l GROUP BY 1 HAVING NOT known OR times > 1")
def info_invalid_replicates(spark, d):
    m = s.scores(spark, d)
    sets = enrich.replicate_sets(m)
    listed = sets.withColumn("sample", F.when(F.col("sample").like("N%"), F.concat(F.lit("no"), "sample")).otherwise(F.col("sample"))).union(sets.where("sample = 'RF_1'"))
    return info.invalid_replicates(m, listed)


# ---- normalisation ----
_SUM = "c AS (SELECT sample, sum(score) AS col_sum FROM m GROUP BY 1)"


@query(f"WITH {M}, {_SUM} SELECT peptide, sample, round(score / (col_sum / 1e6), 6) AS score FROM m JOIN c USING (sample)")
def norm_col_sum(spark, d):
    return normalize.by_column_sum(s.scores(spark, d)).select("peptide", "sample", r6("score"))


_FACTORS = """g AS (SELECT peptide, exp(avg(CASE WHEN score <> 0 THEN ln(CASE WHEN score <> 0 THEN score END) END)) AS g FROM d GROUP BY 1),
q AS (SELECT sample, peptide, score / g AS ratio FROM d JOIN g USING (peptide)),
w AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY ratio) AS rn, count(*) OVER (PARTITION BY sample) AS n FROM q),
f AS (SELECT sample, ratio AS factor FROM w WHERE rn = n // 2 + 1)"""


@query(f"WITH {DENSE}, {_FACTORS} SELECT sample, round(factor, 6) AS factor FROM f")
def norm_factors(spark, d):
    return normalize.size_factors(dense(spark, d)).select("sample", r6("factor"))


@query(f"WITH {DENSE}, {_FACTORS} SELECT peptide, sample, CASE WHEN factor = 0 THEN CASE WHEN score = 0 THEN 'NaN'::DOUBLE ELSE 'Infinity'::DOUBLE END ELSE round(score / factor, 6) END AS score FROM d JOIN f USING (sample)")
def norm_size_factors(spark, d):
    return normalize.by_size_factors(dense(spark, d)).select("peptide", "sample", r6("score"))


_MU = "mu AS (SELECT peptide, avg(CASE WHEN instr(sample, 'N') BETWEEN 1 AND 2 THEN score END) AS mu FROM d GROUP BY 1)"
_IEEE = "CASE WHEN mu = 0 THEN CASE WHEN {x} = 0 THEN 'NaN'::DOUBLE WHEN {x} > 0 THEN 'Infinity'::DOUBLE ELSE '-Infinity'::DOUBLE END ELSE round({x} / mu, 6) END"


@query(f"WITH {DENSE}, {_MU} SELECT peptide, round(mu, 6) AS mu FROM mu")
def neg_control_select(spark, d):
    return normalize.control_means(dense(spark, d), start="N").select("peptide", r6("mu"))


@query(f"WITH {DENSE}, {_MU} SELECT peptide, sample, round(score - mu, 6) AS score FROM d JOIN mu USING (peptide)")
def norm_diff(spark, d):
    return normalize.against_controls(dense(spark, d), "diff", start="N").select("peptide", "sample", r6("score"))


@query(f"WITH {DENSE}, {_MU} SELECT peptide, sample, {_IEEE.format(x='score')} AS score FROM d JOIN mu USING (peptide)")
def norm_ratio(spark, d):
    return normalize.against_controls(dense(spark, d), "ratio", start="N").select("peptide", "sample", r6("score"))


@query(f"WITH {DENSE}, {_MU} SELECT peptide, sample, {_IEEE.format(x='(score - mu)')} AS score FROM d JOIN mu USING (peptide)")
def norm_diff_ratio(spark, d):
    return normalize.against_controls(dense(spark, d), "diff_ratio", start="N").select("peptide", "sample", r6("score"))


@query(f"WITH {DENSE}, mu AS (SELECT peptide, avg(score) AS mu FROM d WHERE sample IN ('NO_1', 'RF_2') GROUP BY 1) SELECT peptide, sample, round(score - mu, 6) AS score FROM d JOIN mu USING (peptide)")
def norm_diff_names(spark, d):
    m = dense(spark, d)
    return normalize.against_controls(m, "diff", names=["NO_1", "RF_2"], controls=m.where("sample like '%O\\_%' or sample like '%F\\_%'")).select("peptide", "sample", r6("score"))


# ---- bins and z-scores ----
@query(f"WITH {M} SELECT peptide, floor(sum(score) / 10 + 0.5) * 10 AS rank FROM m GROUP BY 1")
def bin_round_rank(spark, d):
    return binning.ranks(s.scores(spark, d), -1)


@query(f"""WITH RECURSIVE {M}, t AS (SELECT peptide, floor(sum(score) / 10 + 0.5) * 10 AS rank FROM m GROUP BY 1),
k AS (SELECT rank, count(*) AS n, row_number() OVER (ORDER BY rank DESC) AS i, count(*) OVER () AS last FROM t GROUP BY 1),
f AS (SELECT z AS size, 1::BIGINT AS i, 1 AS bin, n AS held, n::BIGINT AS n FROM k, range(30, 430) r(z) WHERE k.i = 1
  UNION ALL SELECT f.size, k.i, CASE WHEN f.held >= f.size THEN f.bin + 1 ELSE f.bin END, CASE WHEN f.held >= f.size THEN k.n ELSE f.held + k.n END, k.n FROM f JOIN k ON k.i = f.i + 1),
b AS (SELECT size, bin, sum(n) AS held FROM f GROUP BY 1, 2), ok AS (SELECT size FROM b GROUP BY 1 HAVING min(held) >= 30 OR max(bin) = 1 ORDER BY size LIMIT 1)
SELECT CAST(f.bin AS INTEGER) AS bin_id, t.peptide FROM f JOIN ok USING (size) JOIN k ON k.i = f.i JOIN t ON t.rank = k.rank""")
def bin_greedy(spark, d):
    return binning.greedy_bins(s.scores(spark, d), 30, -1)


@query(f"WITH {M}, {BINS}, x AS (SELECT peptide FROM m GROUP BY 1), b AS (SELECT peptide, count(*) AS n FROM (SELECT * FROM bins WHERE bin_id > 1 UNION ALL SELECT * FROM bins WHERE bin_id = 3) GROUP BY 1) SELECT coalesce(x.peptide, b.peptide) AS peptide, coalesce(n, 0) AS n_bins FROM x FULL JOIN b ON x.peptide = b.peptide WHERE x.peptide IS NULL OR n IS NULL OR n <> 1")
def bins_check(spark, d):
    m = s.scores(spark, d)
    bins = s.bins_of(m)
    return binning.bins_match(m, bins.where("bin_id > 1").union(bins.where("bin_id = 3")))


_Z = """o AS (SELECT m.*, bin_id, row_number() OVER (PARTITION BY sample, bin_id ORDER BY score, peptide) AS rn, count(*) OVER (PARTITION BY sample, bin_id) AS n FROM m JOIN bins USING (peptide))"""
_ZEND = """st AS (SELECT sample, bin_id, avg(score) FILTER (chosen) AS mean, stddev_samp(score) FILTER (chosen) AS sd FROM ch GROUP BY 1, 2)
SELECT o.peptide, o.sample, o.bin_id, CASE WHEN mean IS NULL OR mean = 0 THEN 'NaN'::DOUBLE WHEN sd = 0 THEN 0.0 WHEN sd IS NULL THEN 'NaN'::DOUBLE ELSE round((o.score - mean) / sd, 6) END AS score FROM o JOIN st USING (sample, bin_id)"""


def _hdi_sql(inclusive: bool) -> str:
    limit, end = ("n - k + 1", "") if inclusive else ("n - k - 1", " - 1")
    return f"""k AS (SELECT *, CAST(round(n * 0.75) AS INTEGER) AS k FROM o),
r AS (SELECT a.sample, a.bin_id, a.rn, b.score - a.score AS width FROM k a JOIN k b ON a.sample = b.sample AND a.bin_id = b.bin_id AND b.rn = a.rn + greatest(a.k, 1) - 1 WHERE a.rn <= a.{limit.replace("- k", "- a.k")}),
f AS (SELECT sample, bin_id, rn AS first FROM (SELECT *, row_number() OVER (PARTITION BY sample, bin_id ORDER BY width, rn) AS i FROM r) WHERE i = 1),
ch AS (SELECT k.*, rn >= coalesce(first, 1) AND rn < coalesce(first, 1) + k{end} AS chosen FROM k LEFT JOIN f USING (sample, bin_id))"""


@query(f"WITH {M}, {BINS}, {_Z}, ch AS (SELECT *, rn > floor(n * 0.025) AND rn <= n - floor(n * 0.025) AS chosen FROM o), {_ZEND}")
def zscore_trim(spark, d):
    m = s.scores(spark, d)
    return binning.zscores(m, s.bins_of(m), trim=2.5).select("peptide", "sample", "bin_id", r6("score"))


@query(f"WITH {M}, {BINS}, {_Z}, {_hdi_sql(False)}, {_ZEND}")
def zscore_hdi(spark, d):
    m = s.scores(spark, d)
    return binning.zscores(m, s.bins_of(m), hdi=0.75).select("peptide", "sample", "bin_id", r6("score"))


@query(f"WITH {M}, {BINS}, {_Z}, {_hdi_sql(True)}, {_ZEND}")
def zscore_hdi_inclusive(spark, d):
    m = s.scores(spark, d)
    return binning.zscores(m, s.bins_of(m), hdi=0.75, inclusive=True).select("peptide", "sample", "bin_id", r6("score"))


@query(f"WITH {M}, {BINS}, {_Z}, {_hdi_sql(True)} SELECT sample, bin_id, round(avg(score) FILTER (chosen), 6) AS mean, round(stddev_samp(score) FILTER (chosen), 6) AS sd, count(*) FILTER (chosen) AS n_used FROM ch GROUP BY 1, 2")
def bin_stats(spark, d):
    m = s.scores(spark, d)
    return binning.bin_stats(m, s.bins_of(m), hdi=0.75, inclusive=True).select("sample", "bin_id", r6("mean"), r6("sd"), "n_used")


@query(f"WITH {DENSE}, {BINS}, x AS (SELECT peptide, sample, bin_id, CASE WHEN bin_id <> 1 AND sample LIKE 'N%' THEN 0.0 ELSE score + 1 END AS score FROM d JOIN bins USING (peptide)), o AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY sample, bin_id) AS n FROM x WINDOW w AS (PARTITION BY sample, bin_id ORDER BY score, peptide)), st AS (SELECT sample, bin_id, avg(score) FILTER (rn > floor(n * 0.025) AND rn <= n - floor(n * 0.025)) AS mean FROM o GROUP BY 1, 2) SELECT peptide, sample, bin_id FROM x JOIN st USING (sample, bin_id) WHERE coalesce(mean, 0) = 0")
def nan_report(spark, d):
    m = dense(spark, d)
    bins = s.bins_of(m)
    zero = m.join(bins, "peptide").withColumn("score", F.when((F.col("bin_id") != 1) & F.col("sample").like("N%"), 0.0).otherwise(F.col("score") + 1)).select("peptide", "sample", "score")
    return binning.nan_report(binning.zscores(zero, bins))


@query(f"WITH {M}, {BINS}, j AS (SELECT * FROM m JOIN bins USING (peptide)), e AS (SELECT sample, bin_id, quantile_cont(score, 0.9) AS hi, quantile_cont(score, 0.1) AS lo FROM j GROUP BY 1, 2) SELECT sample, bin_id, round(avg(score) FILTER (score >= hi) - avg(score) FILTER (score <= lo), 6) AS signal2noise FROM j JOIN e USING (sample, bin_id) GROUP BY 1, 2")
def signal2noise(spark, d):
    m = s.scores(spark, d)
    return binning.signal_to_noise(m, s.bins_of(m)).select("sample", "bin_id", r6("signal2noise"))


# ---- enrichment ----
_CALLS = f"{DENSE}, {SETS}, t AS (SELECT set_id, peptide, min(score) >= 10 AND max(score) >= 40 AS a, min(score) >= 5 AND max(score) >= 5 AS b FROM d JOIN sets USING (sample) WHERE sample LIKE '%\\_1' ESCAPE '\\' OR sample LIKE '%\\_2' ESCAPE '\\' GROUP BY 1, 2), u AS (SELECT set_id, min(x) >= 100 AND max(x) >= 2000 AS ok FROM (SELECT set_id, sample, sum(score) AS x FROM d JOIN sets USING (sample) WHERE sample LIKE '%\\_1' ESCAPE '\\' OR sample LIKE '%\\_2' ESCAPE '\\' GROUP BY 1, 2) GROUP BY 1)"


def _two(spark, d):
    m = dense(spark, d)
    return m, enrich.replicate_sets(m).where("sample like '%\\_1' or sample like '%\\_2'")


@query(f"WITH {_CALLS} SELECT t.set_id, peptide FROM t JOIN u USING (set_id) WHERE a AND b AND ok")
def enrich_calls(spark, d):
    m, sets = _two(spark, d)
    return enrich.enriched([(m, [40, 10]), (m, [5])], sets, m, [2000, 100])


_FEW = f"{DENSE}, {SETS}, two AS (SELECT * FROM sets WHERE sample LIKE '%\\_1' ESCAPE '\\' OR sample LIKE '%\\_2' ESCAPE '\\'), t AS (SELECT set_id, peptide, min(score) >= 80 AND max(score) >= 110 AS a FROM d JOIN two USING (sample) GROUP BY 1, 2), x AS (SELECT set_id, sample, sum(score) AS x FROM d JOIN two USING (sample) GROUP BY 1, 2), u AS (SELECT set_id, min(x) >= (SELECT 0.94 * max(x) FROM x) AS ok FROM x GROUP BY 1), n AS (SELECT set_id, string_agg(sample, ', ' ORDER BY sample) AS replicates FROM two GROUP BY 1)"


@query(f"WITH {_FEW} SELECT set_id, replicates, CASE WHEN NOT ok THEN 'Raw read count threshold' ELSE 'No enriched peptides' END AS reason FROM n JOIN u USING (set_id) WHERE NOT ok OR set_id NOT IN (SELECT set_id FROM t WHERE a)")
def enrich_failures(spark, d):
    m, sets = _two(spark, d)
    cut = 0.94 * enrich.raw_sums(m, sets).agg(F.max("col_sum")).first()[0]
    return enrich.failures([(m, [110, 80])], sets, m, [cut])


@query(f"WITH {DENSE}, {SETS}, x AS (SELECT set_id, sample, sum(score) AS col_sum FROM d JOIN sets USING (sample) GROUP BY 1, 2) SELECT * FROM x WHERE col_sum < 0.995 * (SELECT max(col_sum) FROM x WHERE sample LIKE 'AF%')")
def enrich_low_reads(spark, d):
    m = dense(spark, d)
    sets = enrich.replicate_sets(m)
    cut = enrich.raw_sums(m, sets).where("sample like 'AF%'").agg(F.max("col_sum")).first()[0]
    return enrich.without_low_replicates(m, sets, [0.995 * cut])[1]


@query(f"WITH {M}, {SETS} SELECT set_id, CASE WHEN count(*) > 3 THEN list_aggregate((list(sample ORDER BY sample))[1:3], 'string_agg', '~') || '~' || CAST(count(*) - 3 AS VARCHAR) || 'more' ELSE string_agg(sample, '~' ORDER BY sample) END AS label FROM sets GROUP BY 1")
def enrich_set_label(spark, d):
    sets = enrich.replicate_sets(s.scores(spark, d)).groupBy("set_id").agg(F.sort_array(F.collect_set("sample")).alias("x"))
    return sets.select("set_id", enrich.set_label(F.col("x")).alias("label"))


@query(f"WITH {DENSE} SELECT a.peptide, (a.score >= 20 OR b.score >= 20) AND a.score >= 5 AND b.score >= 5 AS met FROM (SELECT * FROM d WHERE sample = 'NO_1') a JOIN (SELECT * FROM d WHERE sample = 'NO_2') b ON a.peptide = b.peptide")
def enrich_pair_threshold(spark, d):
    m = dense(spark, d)
    a, b = (m.where(F.col("sample") == x).select("peptide", F.col("score").alias(n)) for x, n in (("NO_1", "a"), ("NO_2", "b")))
    return a.join(b, "peptide").select("peptide", enrich.pair_threshold_met(F.col("a"), F.col("b"), [5, 20]).alias("met"))


@query(f"WITH {M} SELECT sample, sum(score) AS total, round(exp(avg(ln(score))), 6) AS geo, median(score) AS med, round(stddev_samp(score), 6) AS sd, round(avg(score), 6) AS mean FROM m GROUP BY 1")
def stats_summary(spark, d):
    x = F.col("score")
    by = s.scores(spark, d).groupBy("sample")
    return by.agg(F.sum(x).alias("total"), F.round(sem.geometric_mean(x), 6).alias("geo"), F.median(x).alias("med"), F.round(sem.sample_sd(x), 6).alias("sd"), F.round(F.avg(x), 6).alias("mean"))


@query(f"WITH {DENSE} SELECT a.peptide, round(CASE WHEN greatest(abs(a.score), abs(b.score)) = 0 THEN 0 ELSE abs(a.score - b.score) / greatest(abs(a.score), abs(b.score)) END, 6) AS diff, CASE WHEN greatest(abs(a.score), abs(b.score)) = 0 THEN 0 ELSE abs(a.score - b.score) / greatest(abs(a.score), abs(b.score)) END <= 0.25 AS close FROM (SELECT * FROM d WHERE sample = 'NO_1') a JOIN (SELECT * FROM d WHERE sample = 'NO_2') b ON a.peptide = b.peptide")
def stats_relative_difference(spark, d):
    m = dense(spark, d)
    a, b = (m.where(F.col("sample") == x).select("peptide", F.col("score").alias(n)) for x, n in (("NO_1", "a"), ("NO_2", "b")))
    return a.join(b, "peptide").select("peptide", F.round(sem.relative_difference(F.col("a"), F.col("b")), 6).alias("diff"), sem.is_close(F.col("a"), F.col("b"), 0.25).alias("close"))


# ---- demultiplexing ----
@query(f"WITH {READS} SELECT read_id, key FROM (SELECT read_id, substr(seq, 3, 6) AS key FROM r WHERE length(seq) >= 8) WHERE key IN (SELECT key FROM bc)")
def demux_exact(spark, d):
    own = s.reads(spark, d).select("read_id", sem.slice_at(F.col("seq"), 2, 6).alias("key"))
    return own.join(s.barcodes(spark, d).select("key").distinct(), "key", "left_semi").select("read_id", "key")


@query(f"WITH {READS}, {s.shift_sql('x', INDEX, 'bc')} SELECT read_id, key FROM x")
def demux_shift(spark, d):
    return demux.shifted_match(s.reads(spark, d), s.barcodes(spark, d), INDEX)


@query(f"WITH {READS} SELECT read_id, key, CAST(hamming(substr(seq, 9, 10), key) AS INTEGER) AS distance FROM r, (SELECT DISTINCT key FROM lib) WHERE length(seq) >= 18 AND hamming(substr(seq, 9, 10), key) <= 2")
def demux_hamming(spark, d):
    own = s.reads(spark, d).select("read_id", sem.slice_at(F.col("seq"), 8, 10).alias("s"))
    return demux.hamming_join(own, s.library(spark, d), 10, 2)


@query(f"WITH {READS}, {s.tolerant_sql('x', INDEX, 'bc', 'discard')} SELECT read_id, key FROM x")
def demux_barcode(spark, d):
    return demux.tolerant_match(s.reads(spark, d), s.barcodes(spark, d), INDEX)


@query(f"WITH {READS}, {s.tolerant_sql('x', TAG, 'lib', 'first')} SELECT read_id, key FROM x")
def demux_tag(spark, d):
    return demux.tolerant_match(s.reads(spark, d), s.library(spark, d), TAG, ambiguous="first")


_PAIR = f"""{READS}, {s.tolerant_sql('x', INDEX, 'bc', 'discard')}, {s.shift_sql('y', INDEX2, 'bc2')},
ps AS (SELECT bc.ord, 'S' || CAST(bc.ord AS VARCHAR) AS sample, bc.id AS a, bc2.id AS b FROM bc JOIN bc2 ON bc.ord % 5 = bc2.ord),
ids AS (SELECT x.read_id, bc.id AS a, bc2.id AS b FROM x JOIN bc ON x.key = bc.key JOIN y ON x.read_id = y.read_id JOIN bc2 ON y.key = bc2.key)"""


@query(f"WITH {_PAIR} SELECT read_id, sample FROM ids JOIN ps USING (a, b)")
def demux_multi_index(spark, d):
    out = demux.assign_samples(s.reads(spark, d), s.barcodes(spark, d).union(s.second_barcodes(spark, d)), s.paired_samples(spark, d), [INDEX, INDEX2])
    return out.select("read_id", "sample")


_ONE = f"{READS}, {s.tolerant_sql('x', INDEX, 'bc', 'discard')}, asg AS (SELECT read_id, sample FROM x JOIN bc USING (key) JOIN smp USING (id)), {s.tolerant_sql('t', TAG, 'lib', 'first')}, single AS (SELECT key, min(name) AS peptide FROM lib GROUP BY 1 HAVING count(*) = 1)"


def _assigned(spark, d):
    return demux.with_sample(s.reads(spark, d), s.barcodes(spark, d), s.samples(spark, d), [INDEX])


def _tags(spark, d):
    return demux.tolerant_match(s.reads(spark, d), s.library(spark, d), TAG, ambiguous="first")


def _counted(spark, d):
    return demux.count_reads(s.reads(spark, d), s.barcodes(spark, d), s.samples(spark, d), [INDEX], s.library(spark, d), TAG)


_CELLS = f"{_ONE}, cnt AS (SELECT peptide, sample, count(*) AS n FROM t JOIN asg USING (read_id) JOIN single USING (key) GROUP BY 1, 2), cells AS (SELECT peptide, sample, coalesce(n, 0) AS score FROM single CROSS JOIN (SELECT DISTINCT sample FROM smp) LEFT JOIN cnt USING (peptide, sample))"


@query(f"WITH {_CELLS} SELECT peptide, sample, score FROM cells")
def demux_counts(spark, d):
    return _counted(spark, d)


@query(f"WITH {_ONE} SELECT substr(seq, 9, 10) AS peptide, sample, count(*) AS score FROM r JOIN asg USING (read_id) WHERE length(seq) >= 18 GROUP BY 1, 2")
def demux_ref_independent(spark, d):
    return demux.reference_free_counts(_assigned(spark, d), TAG)


@query(f"WITH {_PAIR}, {s.tolerant_sql('t', TAG, 'lib', 'first')}, l1 AS (SELECT bc.id AS a, count(*) AS n FROM x JOIN bc USING (key) GROUP BY 1), l2 AS (SELECT a, b, count(*) AS n, count(t.read_id) AS g FROM ids LEFT JOIN t ON ids.read_id = t.read_id GROUP BY 1, 2) SELECT sample, coalesce(l1.n, 0) AS level1, coalesce(l2.n, 0) AS level2, coalesce(l2.g, 0) AS tags FROM ps LEFT JOIN l1 USING (a) LEFT JOIN l2 USING (a, b)")
def demux_diagnostics(spark, d):
    codes = s.barcodes(spark, d).union(s.second_barcodes(spark, d))
    return demux.diagnostics(s.reads(spark, d), codes, s.paired_samples(spark, d), [INDEX, INDEX2], s.library(spark, d), TAG)


@query(f"WITH {READS}, {s.shift_sql('t', TAG, 'lib')} SELECT read_id, seq FROM r WHERE read_id NOT IN (SELECT read_id FROM t)")
def demux_unmapped(spark, d):
    return demux.unmapped(s.reads(spark, d), demux.shifted_match(s.reads(spark, d), s.library(spark, d), TAG)).select("read_id", "seq")


@query(f"WITH {_CELLS} SELECT split_part(peptide, '-', 1) AS peptide, sample, CAST(sum(score) AS BIGINT) AS score FROM cells GROUP BY 1, 2")
def demux_aa_by_name(spark, d):
    return demux.by_encoding(_counted(spark, d))


_CODE = "(VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in sem.CODONS.items()) + ") cd(k, v)"


@query(f"WITH {_ONE}, c AS (SELECT substr(seq, 9, 9) AS nt, sample, count(*) AS n FROM r JOIN asg USING (read_id) WHERE length(seq) >= 17 GROUP BY 1, 2), cd AS (SELECT * FROM {_CODE}), a AS (SELECT c1.v || c2.v || c3.v AS peptide, sample, n FROM c JOIN cd c1 ON c1.k = substr(nt, 1, 3) JOIN cd c2 ON c2.k = substr(nt, 4, 3) JOIN cd c3 ON c3.k = substr(nt, 7, 3)) SELECT peptide, sample, CAST(sum(n) AS BIGINT) AS score FROM a GROUP BY 1, 2")
def demux_translate(spark, d):
    return demux.by_translation(demux.reference_free_counts(_assigned(spark, d), demux.Slice("seq", 8, 9)))


@query(f"WITH {READS} SELECT substr(key, 1, 3) AS key, count(*) AS n, string_agg(name, ',' ORDER BY name) AS names FROM lib GROUP BY 1")
def demux_trunc_report(spark, d):
    return demux.truncation(s.library(spark, d), 3)


@query(f"WITH {READS} SELECT regexp_replace(sample, '_[^_]*$', '') AS base, count(*) AS replicates, regexp_replace(sample, '_[^_]*$', '') LIKE 'Sblk\\_%' ESCAPE '\\' AS blank FROM smp GROUP BY 1, 3")
def demux_replicate_info(spark, d):
    return demux.replicate_summary(s.samples(spark, d))


@query(f"WITH {READS} SELECT replicates, count(*) AS bases FROM (SELECT count(*) AS replicates FROM smp GROUP BY regexp_replace(sample, '_[^_]*$', '')) GROUP BY 1")
def demux_replicate_histogram(spark, d):
    return demux.replicate_histogram(s.samples(spark, d))


@query(f"WITH {_ONE} SELECT count(*) AS n_reads, round(100 * count(asg.read_id) / count(*), 6) AS pct_index, round(100 * count(CASE WHEN asg.read_id IS NOT NULL AND t.read_id IS NOT NULL THEN 1 END) / count(*), 6) AS pct_index_tag FROM r LEFT JOIN asg USING (read_id) LEFT JOIN t ON t.read_id = r.read_id")
def demux_match_rates(spark, d):
    return demux.match_rates(s.reads(spark, d), s.barcodes(spark, d), s.samples(spark, d), [INDEX], s.library(spark, d), TAG).select("n_reads", r6("pct_index"), r6("pct_index_tag"))


@query(f"WITH {READS}, q AS (SELECT read_id, sum(ascii(substr(qual, CAST(i AS BIGINT), 1)) - 33) AS total FROM r, range(9, 19) t(i) GROUP BY 1) SELECT read_id FROM q WHERE total / 10.0 >= 15")
def phred_filter(spark, d):
    return demux.good_quality(s.reads(spark, d), TAG, 15).select("read_id")


@query(f"WITH {_ONE} SELECT count(*) AS n FROM r WHERE contains(seq, 'ACGT') AND read_id NOT IN (SELECT read_id FROM t)")
def concatemer_count(spark, d):
    return demux.concatemers(s.reads(spark, d), _tags(spark, d), "ACGT").agg(F.count("*").alias("n"))


# ---- k-mers and links ----
@query(f"WITH {SEQS}, {s.kmer_sql('pep', 'peptide', 6, 'k')} SELECT peptide, kmer FROM k")
def kmer_explode(spark, d):
    return link.exploded(s.sequences(spark, d)[0], 6, ["peptide"])


@query(f"WITH {SEQS}, {s.kmer_sql('pep', 'peptide', 6, 'k')} SELECT kmer, count(*) AS freq FROM k GROUP BY 1")
def kmer_frequency(spark, d):
    return link.frequencies(s.sequences(spark, d)[0], 6)


def _tagged(spark, d):
    peptides, proteins = s.sequences(spark, d)
    return peptides, proteins.withColumn("species", link.oxx_id(F.col("name")))


_LINK = f"{SEQS}, {s.kmer_sql('pep', 'peptide', 6, 'k')}, {s.kmer_sql('prot', 'species', 6, 'q0')}, q AS (SELECT DISTINCT * FROM q0), f AS (SELECT kmer, count(*) AS freq FROM k GROUP BY 1)"


@query(f"WITH {_LINK} SELECT peptide, species, CAST(count(*) AS DOUBLE) AS weight FROM k JOIN q USING (kmer) GROUP BY 1, 2")
def link_scores(spark, d):
    return link.linkage(*_tagged(spark, d), 6)


@query(f"WITH {_LINK} SELECT peptide, species, round(sum(1.0::DOUBLE / freq), 6) AS weight FROM k JOIN q USING (kmer) JOIN f USING (kmer) GROUP BY 1, 2")
def link_penalized(spark, d):
    return link.linkage(*_tagged(spark, d), 6, penalized=True).select("peptide", "species", r6("weight"))


@query(f"WITH {SEQS}, w AS (SELECT peptide, substr(seq, CAST(i AS BIGINT), 1) || substr(seq, CAST(i AS BIGINT) + 2, 2) || substr(seq, CAST(i AS BIGINT) + 4, 1) AS g FROM pep, range(1, 200) t(i) WHERE i <= length(seq) - 4), v AS (SELECT DISTINCT species, substr(seq, CAST(i AS BIGINT), 1) || substr(seq, CAST(i AS BIGINT) + 2, 2) || substr(seq, CAST(i AS BIGINT) + 4, 1) AS g FROM prot, range(1, 200) t(i) WHERE i <= length(seq) - 4) SELECT peptide, species, count(*) AS weight FROM (SELECT DISTINCT * FROM w) JOIN v USING (g) GROUP BY 1, 2")
def link_patterned(spark, d):
    return link.patterned_linkage(*_tagged(spark, d), ["X-XXX"])


@query(f"WITH {SEQS}, {s.kmer_sql('pep', 'peptide', 6, 'k0')}, k AS (SELECT DISTINCT * FROM k0), {s.kmer_sql('prot', 'name, length(seq) AS len', 6, 'q0')}, q AS (SELECT DISTINCT * FROM q0), n AS (SELECT peptide, count(*) AS total FROM k GROUP BY 1), c AS (SELECT peptide, name, len, count(*) AS shared FROM k JOIN q USING (kmer) GROUP BY 1, 2, 3), b AS (SELECT *, row_number() OVER (PARTITION BY peptide ORDER BY shared DESC, len, name) AS i FROM c) SELECT peptide AS query, name AS ref, shared, round(shared / total, 6) AS share FROM b JOIN n USING (peptide) WHERE i = 1")
def check_taxonomy(spark, d):
    peptides, proteins = s.sequences(spark, d)
    out = link.best_match(peptides.withColumnRenamed("peptide", "query"), proteins.withColumnRenamed("name", "ref"), 6)
    return out.select("query", "ref", "shared", r6("share"))


# ---- deconvolution ----
@query(f"WITH {L} SELECT species, CAST(count(*) AS DOUBLE) AS score, count(*) AS count FROM l GROUP BY 1")
def deconv_score_integer(spark, d):
    return deconv.scores(s.links(spark, d), "integer")


@query(f"WITH {L}, n AS (SELECT peptide, count(*) AS n FROM l GROUP BY 1) SELECT species, round(sum(1.0::DOUBLE / n), 6) AS score, count(*) AS count FROM l JOIN n USING (peptide) GROUP BY 1")
def deconv_score_fraction(spark, d):
    return deconv.scores(s.links(spark, d), "fraction").select("species", r6("score"), "count")


@query(f"WITH {L} SELECT species, sum(weight) AS score, count(*) AS count FROM l GROUP BY 1")
def deconv_score_summation(spark, d):
    return deconv.scores(s.links(spark, d), "summation")


_OVER = f"{L}, o AS (SELECT x.species AS a, y.species AS b, count(*) AS n, sum(x.weight) AS wa, sum(y.weight) AS wb FROM l x JOIN l y USING (peptide) WHERE x.species < y.species GROUP BY 1, 2), t AS (SELECT species, count(*) AS n, sum(weight) AS w FROM l GROUP BY 1)"


@query(f"WITH {_OVER} SELECT a, b, CAST(n AS DOUBLE) AS a_to_b, CAST(n AS DOUBLE) AS b_to_a FROM o")
def deconv_overlap_integer(spark, d):
    return deconv.overlaps(s.links(spark, d), "integer")


@query(f"WITH {_OVER} SELECT a, b, round(o.n / x.n, 6) AS a_to_b, round(o.n / y.n, 6) AS b_to_a FROM o JOIN t x ON x.species = a JOIN t y ON y.species = b")
def deconv_overlap_percent(spark, d):
    return deconv.overlaps(s.links(spark, d), "percent").select("a", "b", r6("a_to_b"), r6("b_to_a"))


@query(f"WITH {_OVER} SELECT a, b, round(wa / x.w, 6) AS a_to_b, round(wb / y.w, 6) AS b_to_a FROM o JOIN t x ON x.species = a JOIN t y ON y.species = b")
def deconv_overlap_summation(spark, d):
    return deconv.overlaps(s.links(spark, d), "summation").select("a", "b", r6("a_to_b"), r6("b_to_a"))


@query(f"WITH {L}, c AS (SELECT species, sum(weight) AS score FROM l GROUP BY 1) SELECT species, score FROM c WHERE score >= 10 AND score / (SELECT max(score) FROM c) >= 0.9")
def deconv_tie_candidates(spark, d):
    return deconv.tie_candidates(deconv.scores(s.links(spark, d)), 10, 0.9)


def _by_sample(spark, d):
    m = s.scores(spark, d).where("score >= 60")
    return m.select("sample", "peptide").join(s.links(spark, d), "peptide")


@query()
def deconv_report(spark, d):
    return deconv.deconvolve(_by_sample(spark, d), 2.0, "summation", 0.9, 0.5)


@query()
def deconv_assignment_map(spark, d):
    return deconv.assignments(_by_sample(spark, d), 2.0, "integer", 0.0, 1.0)


@query()
def deconv_report_lines(spark, d):
    return deconv.report_lines(deconv.deconvolve(_by_sample(spark, d), 2.0, "fraction", 0.9, 0.5))


# ---- further analyses ----
@query(f"WITH {DENSE}, g AS (SELECT DISTINCT peptide FROM m WHERE CAST(peptide AS BIGINT) % 10 = 0), t AS (SELECT sample, sum(score) AS total FROM d WHERE peptide IN (SELECT peptide FROM g) GROUP BY 1) SELECT peptide, sample, round(CASE WHEN total = 0 THEN CASE WHEN score = 0 THEN 'NaN'::DOUBLE ELSE 'Infinity'::DOUBLE END ELSE score / total END * (1e6 / (SELECT count(DISTINCT peptide) FROM d) * (SELECT count(*) FROM g)), 6) AS score FROM d JOIN t USING (sample)")
def target_norm(spark, d):
    m = dense(spark, d)
    return extras.target_norm(m, m.where(F.col("peptide").cast("long") % 10 == 0).select("peptide")).select("peptide", "sample", r6("score"))


@query(f"WITH {M}, p AS (SELECT CAST(i AS VARCHAR) AS peptide FROM range(1, 50) t(i)) SELECT p.peptide, q.sample, coalesce(m.score, 0.0) AS score FROM p CROSS JOIN (SELECT DISTINCT sample FROM m) q LEFT JOIN m ON m.peptide = p.peptide AND m.sample = q.sample")
def add_peptides(spark, d):
    return extras.add_peptides(s.scores(spark, d), spark.range(1, 50).select(F.col("id").cast("string").alias("peptide")))


@query(f"WITH {_HALVES} SELECT count(*) AS cells, max(abs(a.score - b.score)) AS max_diff, min(abs(a.score - b.score)) AS min_diff, round(avg(abs(a.score - b.score)), 6) AS avg_diff, 0::BIGINT AS nan_cells FROM a JOIN b USING (peptide, sample)")
def comp_matrices(spark, d):
    return extras.compare(*_halves(spark, d)).select("cells", "max_diff", "min_diff", r6("avg_diff"), "nan_cells")


@query(f"WITH {DENSE} SELECT x.sample AS a, y.sample AS b, round(corr(x.score, y.score), 6) AS r FROM d x JOIN d y USING (peptide) WHERE x.sample < y.sample GROUP BY 1, 2")
def sample_correlations(spark, d):
    return extras.sample_correlations(dense(spark, d)).select("a", "b", r6("r"))


_PEPS = "p AS (SELECT peptide, sample, {} AS score FROM d WHERE peptide IN (SELECT peptide FROM d GROUP BY 1 HAVING max(score) >= 40)), c AS (SELECT x.peptide AS a, y.peptide AS b, corr(x.score, y.score) AS r FROM p x JOIN p y USING (sample) WHERE x.peptide < y.peptide GROUP BY 1, 2) SELECT a, b, round(r, 6) AS r FROM c WHERE abs(r) >= 0.8"


@query(f"WITH {DENSE}, " + _PEPS.format("score"))
def pep_correlations(spark, d):
    return extras.peptide_correlations(dense(spark, d), 0.8, 40).select("a", "b", r6("r"))


@query(f"WITH {DENSE}, " + _PEPS.format("(rank() OVER w + rank() OVER w + count(*) OVER t - 1) / 2.0").replace(" FROM d WHERE peptide IN", " FROM d WHERE peptide IN").replace("HAVING max(score) >= 40)), c", "HAVING max(score) >= 40) WINDOW w AS (PARTITION BY peptide ORDER BY score), t AS (PARTITION BY peptide, score)), c"))
def pep_correlations_spearman(spark, d):
    return extras.peptide_correlations(dense(spark, d), 0.8, 40, "spearman").select("a", "b", r6("r"))


@query()
def pep_correlations_kendall(spark, d):
    return extras.peptide_correlations(dense(spark, d), 0.3, 40, "kendall").select("a", "b", r6("r"))


@query(f"WITH {DENSE}, k AS (SELECT peptide, sample, (2 * rank() OVER w + count(*) OVER t - 1) / 2.0 AS score FROM d WINDOW w AS (PARTITION BY sample ORDER BY score), t AS (PARTITION BY sample, score)) SELECT x.sample AS a, y.sample AS b, round(corr(x.score, y.score), 6) AS r FROM k x JOIN k y USING (peptide) WHERE x.sample < y.sample GROUP BY 1, 2")
def sample_correlations_spearman(spark, d):
    return extras.sample_correlations(extras.ranked_in_sample(dense(spark, d))).select("a", "b", r6("r"))


@query(f"WITH {DENSE}, g AS (SELECT peptide, avg(score) FILTER (sample LIKE 'A%') AS mx, var_samp(score) FILTER (sample LIKE 'A%') AS vx, count(*) FILTER (sample LIKE 'A%') AS nx, avg(score) FILTER (sample LIKE 'R%') AS my, var_samp(score) FILTER (sample LIKE 'R%') AS vy, count(*) FILTER (sample LIKE 'R%') AS ny FROM d GROUP BY 1) SELECT peptide, round((mx - my) / sqrt(vx / nx + vy / ny), 6) AS t, round(power(vx / nx + vy / ny, 2) / (power(vx / nx, 2) / (nx - 1) + power(vy / ny, 2) / (ny - 1)), 6) AS df FROM g WHERE nx > 1 AND ny > 1 AND vx / nx + vy / ny > 0")
def ttest(spark, d):
    return extras.welch_t(dense(spark, d), F.col("sample").like("A%"), F.col("sample").like("R%")).select("peptide", r6("t"), r6("df"))


@query()
def ttest_p(spark, d):
    return extras.welch_test(dense(spark, d), F.col("sample").like("A%"), F.col("sample").like("R%"))


def _found(spark, d):
    return s.scores(spark, d).where("score >= 60").select("sample", "peptide")


_FOUND = f"{M}, {L}, e AS (SELECT sample, peptide FROM m WHERE score >= 60)"


@query()
def poisson_taxa(spark, d):
    return extras.taxon_poisson(_found(spark, d), s.links(spark, d))


@query(f"WITH {M}, g AS (SELECT sample, sum(score) AS total, count(*) FILTER (score > 0) AS observed FROM m GROUP BY 1) SELECT sample, observed, round(1000 * (1 - exp(-total / 1000)), 6) AS expected, round(1000 * (1 - exp(-total / 1000)) - observed, 6) AS missing FROM g")
def pep_count_deviation(spark, d):
    return extras.unique_deviation(s.scores(spark, d), 1000).select("sample", "observed", r6("expected"), r6("missing"))


@query()
def downsample_reads(spark, d):
    return extras.downsampled(s.scores(spark, d), 500)


@query(f"WITH {_FOUND} SELECT sample, species, count(DISTINCT peptide) AS n FROM e JOIN l USING (peptide) GROUP BY 1, 2")
def peps2tax(spark, d):
    return extras.taxa_by_file(_found(spark, d), s.links(spark, d))


@query(f"WITH {L} SELECT species, string_agg(DISTINCT peptide, chr(9) ORDER BY peptide) AS peptides FROM l WHERE weight >= 40 GROUP BY 1")
def gmt(spark, d):
    return extras.gene_sets(s.links(spark, d), 40)


@query(f"WITH {L} SELECT species, peptide, weight FROM l WHERE species IN ('T1', 'T2')")
def link_keep_taxa(spark, d):
    return extras.keep_taxa(s.links(spark, d), spark.createDataFrame([("T1",), ("T2",)], "species string"))


@query(f"WITH {L} SELECT species, peptide, weight FROM l WHERE species NOT IN ('T1', 'T2')")
def link_remove_taxa(spark, d):
    return extras.remove_taxa(s.links(spark, d), spark.createDataFrame([("T1",), ("T2",)], "species string"))


_EPI = f"{DENSE}, {BINS}, x AS (SELECT sample, bin_id AS epitope, max(score) AS score FROM d JOIN bins USING (peptide) GROUP BY 1, 2)"


def _epitopes(spark, d):
    m = dense(spark, d)
    return extras.epitope_scores(m, s.bins_of(m).withColumnRenamed("bin_id", "epitope"))


@query(f"WITH {_EPI} SELECT * FROM x")
def epitope_scores(spark, d):
    return _epitopes(spark, d)


@query(f"WITH {_EPI}, c AS (SELECT epitope, avg(score) FILTER (sample LIKE 'N%') + 0.5 * stddev_pop(score) FILTER (sample LIKE 'N%') AS threshold FROM x GROUP BY 1) SELECT epitope, round(threshold, 6) AS threshold, count(*) FILTER (sample NOT LIKE 'N%' AND score > threshold) AS n_above, coalesce(sum(score) FILTER (sample NOT LIKE 'N%' AND score > threshold), 0) AS sum_above FROM x JOIN c USING (epitope) GROUP BY epitope, c.threshold")
def epitope_calls(spark, d):
    return extras.epitope_calls(_epitopes(spark, d), F.col("sample").like("N%"), 0.5).select("epitope", r6("threshold"), "n_above", "sum_above")


@query(f"WITH {_FOUND} SELECT sample, species, count(DISTINCT peptide) AS n, string_agg(DISTINCT peptide, ',' ORDER BY peptide) AS peptides FROM e JOIN l USING (peptide) WHERE species IN ('T3', 'T4') GROUP BY 1, 2")
def taxon_support(spark, d):
    return extras.taxon_support(_found(spark, d), s.links(spark, d), ["T3", "T4"])


_BIAS = " + ".join(f"abs((SELECT sum(length(seq) - length(replace(seq, '{a}', ''))) / sum(length(seq)) FROM pep) - (SELECT sum(length(seq) - length(replace(seq, '{a}', ''))) / sum(length(seq)) FROM sub))" for a in extras.AMINO_ACIDS)


@query(f"WITH {SEQS}, sub AS (SELECT * FROM pep WHERE CAST(peptide AS BIGINT) % 9 = 0) SELECT round({_BIAS}, 6) AS bias")
def aa_bias(spark, d):
    p = s.sequences(spark, d)[0]
    return extras.amino_acid_bias(p, p.where(F.col("peptide").cast("long") % 9 == 0)).select(r6("bias"))


@query(f"WITH {SEQS}, x AS (SELECT peptide, (length(seq) - length(replace(seq, 'E', '')) + length(seq) - length(replace(seq, 'K', ''))) / length(seq) AS share FROM pep) SELECT peptide, round(share, 6) AS share, round(dense_rank() OVER (ORDER BY share) / (SELECT count(DISTINCT share) FROM x), 6) AS pct FROM x")
def ek_bias(spark, d):
    return extras.letter_bias(s.sequences(spark, d)[0]).select("peptide", r6("share"), r6("pct"))


@query(f"WITH {SEQS}, {s.kmer_sql('prot', 'name', 6, 'k0')}, k AS (SELECT DISTINCT * FROM k0), n AS (SELECT name, count(*) AS n FROM k GROUP BY 1), c AS (SELECT x.name AS a, y.name AS b, count(*) AS shared FROM k x JOIN k y USING (kmer) WHERE x.name < y.name GROUP BY 1, 2) SELECT a, b, shared, round(shared / least(p.n, q.n), 6) AS similarity FROM c JOIN n p ON p.name = a JOIN n q ON q.name = b WHERE shared / least(p.n, q.n) >= 0.2")
def cluster_pairs(spark, d):
    proteins = s.sequences(spark, d)[1]
    return extras.kmer_similarity(proteins, 6, 0.2).select("a", "b", "shared", r6("similarity"))


@query(f"WITH RECURSIVE {SEQS}, {s.kmer_sql('prot', 'name', 6, 'k0')}, k AS (SELECT DISTINCT * FROM k0), n AS (SELECT name, count(*) AS n FROM k GROUP BY 1), c AS (SELECT x.name AS a, y.name AS b, count(*) AS shared FROM k x JOIN k y USING (kmer) WHERE x.name <> y.name GROUP BY 1, 2), e AS (SELECT a, b FROM c JOIN n p ON p.name = a JOIN n q ON q.name = b WHERE shared / least(p.n, q.n) >= 0.2), reach AS (SELECT DISTINCT a AS name, a AS root FROM e UNION SELECT reach.name, e.b FROM reach JOIN e ON e.a = reach.root) SELECT name, min(root) AS root FROM reach GROUP BY 1")
def cluster_components(spark, d):
    return extras.similar_components(s.sequences(spark, d)[1], 6, 0.2)


@query(f"WITH {SEQS}, {s.kmer_sql('prot', 'name', 6, 'k0')}, k AS (SELECT DISTINCT * FROM k0), n AS (SELECT name, count(*) AS n FROM k GROUP BY 1), c AS (SELECT x.name AS a, y.name AS b, count(*) AS shared FROM k x JOIN k y USING (kmer) WHERE x.name < y.name GROUP BY 1, 2), v AS (SELECT a, b, shared / least(p.n, q.n) AS s FROM c JOIN n p ON p.name = a JOIN n q ON q.name = b), w AS (SELECT least(x.species, y.species) AS c, greatest(x.species, y.species) AS d, s FROM v JOIN prot x ON x.name = a JOIN prot y ON y.name = b WHERE x.species <> y.species), g AS (SELECT c, d, avg(s) AS s FROM w GROUP BY 1, 2) SELECT c, d, round(s / (SELECT max(s) FROM g), 6) AS linkage FROM g")
def cluster_linkage(spark, d):
    proteins = _tagged(spark, d)[1]
    return extras.linkage_of_clusters(proteins, proteins.select("name", F.col("species").alias("cluster")), 6).select("c", "d", r6("linkage"))


@query(f"WITH {SEQS}, x AS (SELECT CAST(i - 1 AS INTEGER) AS position, substr(seq, CAST(i AS BIGINT), 1) AS letter, count(*) AS n FROM pep, range(1, 21) t(i) GROUP BY 1, 2), y AS (SELECT *, row_number() OVER (PARTITION BY position ORDER BY n DESC, letter) AS r FROM x) SELECT position, letter, n FROM y WHERE r = 1")
def consensus(spark, d):
    return extras.consensus(s.sequences(spark, d)[0])


@query(f"WITH {SEQS}, x AS (SELECT peptide AS name, translate(seq, 'X', '-') AS seq FROM pep), y AS (SELECT name, i - 1 AS col FROM x, range(1, 21) t(i) WHERE substr(seq, CAST(i AS BIGINT), 1) <> '-') SELECT name, CAST(row_number() OVER (PARTITION BY name ORDER BY col) - 1 AS INTEGER) AS position, CAST(col AS INTEGER) AS \"column\" FROM y")
def aligned_positions(spark, d):
    p = s.sequences(spark, d)[0]
    return extras.aligned_positions(p.select(F.col("peptide").alias("name"), F.translate("seq", "X", "-").alias("seq")))


@query("WITH p AS (SELECT CAST(l_partkey AS INTEGER) AS position, sum(l_quantity) AS depth FROM lineitem GROUP BY 1) SELECT CAST(i * 5 AS INTEGER) AS start, sum(depth) AS total, max(depth) AS peak FROM p, range(0, 100000) t(i) WHERE i BETWEEN greatest(0, CAST(ceil((position - 20 + 1) / 5) AS INTEGER)) AND CAST(floor(position / 5) AS INTEGER) GROUP BY 1")
def window_peaks(spark, d):
    depth = s.table(spark, d, "lineitem").groupBy(F.col("l_partkey").cast("int").alias("position")).agg(F.sum("l_quantity").alias("depth"))
    return extras.window_peaks(depth, 20, 5)


@query(f"WITH {M}, {L} SELECT * FROM m WHERE score >= 50 AND peptide IN (SELECT peptide FROM l WHERE species = 'T5')")
def sub_probes(spark, d):
    return extras.subset_by_taxon(s.scores(spark, d), s.links(spark, d), "T5", 50)


@query(f"WITH {M} SELECT CASE WHEN CAST(peptide AS BIGINT) < 50 THEN 'code' || peptide ELSE peptide END AS peptide, sample, score FROM m")
def recode(spark, d):
    codes = spark.range(0, 50).select(F.col("id").cast("string").alias("name"), F.concat(F.lit("code"), F.col("id").cast("string")).alias("code"))
    return extras.recoded(s.scores(spark, d), codes)


@query("SELECT CAST(s_suppkey AS VARCHAR) AS sample, round(10.0 / s_acctbal, 9) AS volume FROM supplier WHERE s_acctbal > 0")
def dilution(spark, d):
    c = s.table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("sample"), F.col("s_acctbal").alias("concentration"))
    return extras.pooled_volumes(c, 10.0).select("sample", F.round("volume", 9).alias("volume"))


# ---- clusters and windows ----
@query("WITH m AS (SELECT DISTINCT l_suppkey % 25 AS cluster, l_partkey AS sequence FROM lineitem), c AS (SELECT cluster, 'T' || CAST(p_size AS VARCHAR) AS taxon, count(*) AS n FROM m JOIN part ON p_partkey = sequence GROUP BY 1, 2), t AS (SELECT cluster, CAST(sum(n) AS BIGINT) AS n_sequences FROM c GROUP BY 1) SELECT c.cluster, any_value(n_sequences) AS n_sequences, count(*) AS n_taxa, string_agg(taxon, ',' ORDER BY n DESC, taxon) AS taxa, string_agg(printf('%.3f', floor(n / n_sequences * 1000 + 0.5) / 1000), ',' ORDER BY n DESC, taxon) AS shares FROM c JOIN t USING (cluster) GROUP BY 1")
def cluster_taxon_summary(spark, d):
    members = s.table(spark, d, "lineitem").select((F.col("l_suppkey") % 25).alias("cluster"), F.col("l_partkey").alias("sequence"))
    return clusters.taxon_summary(members, s.table(spark, d, "part").select(F.col("p_partkey").alias("sequence"), F.concat(F.lit("T"), F.col("p_size").cast("string")).alias("taxon")))


@query("WITH c AS (SELECT l_partkey AS cluster, count(DISTINCT l_linenumber) AS n_proteins FROM lineitem GROUP BY 1) SELECT n_proteins, count(*) AS n_clusters, round(count(*) / (SELECT count(*) FROM c), 6) AS share FROM c GROUP BY 1")
def cluster_protein_shares(spark, d):
    members = s.table(spark, d, "lineitem").select(F.col("l_partkey").alias("cluster"), F.col("l_linenumber").alias("protein"))
    return clusters.protein_shares(members).select("n_proteins", "n_clusters", r6("share"))


@query(f"WITH {SEQS}, x AS (SELECT peptide AS name, translate(seq, 'X', '-') AS seq FROM pep), y AS (SELECT name, i AS col FROM x, range(1, 21) t(i) WHERE substr(seq, CAST(i AS BIGINT), 1) <> '-'), z AS (SELECT name, col, row_number() OVER (PARTITION BY name ORDER BY col) AS at FROM y) SELECT a.name, CAST(a.col AS INTEGER) AS start, CAST(b.col AS INTEGER) AS stop, 'site' AS label FROM z a JOIN z b USING (name) WHERE a.at = 3 AND b.at = 9")
def annotations_on_alignment(spark, d):
    p = s.sequences(spark, d)[0]
    aligned = p.select(F.col("peptide").alias("name"), F.translate("seq", "X", "-").alias("seq"))
    return clusters.on_alignment(aligned.select("name", F.lit(3).alias("start"), F.lit(9).alias("stop"), F.lit("site").alias("label")), aligned)


@query("WITH p AS (SELECT DISTINCT l_suppkey AS probe, l_linenumber * 4 + l_partkey % 4 AS position FROM lineitem), e AS (SELECT min(position) AS low, max(position) AS high FROM p), w AS (SELECT low + i * 3 AS start FROM e, range(0, 1000) t(i) WHERE low + i * 3 + 8 - 1 <= high), h AS (SELECT start, probe FROM w JOIN p ON position BETWEEN start AND start + 7 GROUP BY 1, 2 HAVING count(*) >= 0.75 * 8) SELECT start, s_nationkey AS taxon, greatest(max(s_acctbal), 0.0) AS score FROM h JOIN supplier ON s_suppkey = probe GROUP BY 1, 2")
def taxon_windows(spark, d):
    x = s.table(spark, d, "lineitem")
    places = x.select(F.col("l_suppkey").alias("probe"), (F.col("l_linenumber") * 4 + F.col("l_partkey") % 4).alias("position"))
    return clusters.taxon_windows(places, s.table(spark, d, "supplier").select(F.col("s_suppkey").alias("probe"), F.col("s_nationkey").alias("taxon"), F.col("s_acctbal").alias("score")), 8, 3, 0.75)


@query(f"WITH {DENSE}, {SETS}, x AS (SELECT set_id, sample, sum(score) AS col_sum FROM d JOIN sets USING (sample) GROUP BY 1, 2) SELECT set_id, string_agg(sample, ', ' ORDER BY sample) AS removed FROM x WHERE col_sum < 0.9 * (SELECT max(col_sum) FROM x) GROUP BY 1")
def enrich_removed_replicates(spark, d):
    m = dense(spark, d)
    sets = enrich.replicate_sets(m)
    return enrich.removed_replicates(m, sets, [0.9 * enrich.raw_sums(m, sets).agg(F.max("col_sum")).first()[0]])


@query()
def deconv_round_scores(spark, d):
    return deconv.round_scores(_by_sample(spark, d), 2.0, "summation", 0.9, 0.5)


# ---- workflow ----
@query()
def full_pipeline(spark, d):
    return flagship(spark, d)


QUERIES |= files.QUERIES
ORACLE_SQL |= files.ORACLE_SQL
