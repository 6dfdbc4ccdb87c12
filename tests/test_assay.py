"""Operators on small inputs with known results."""

import gzip
import math

import pytest
from pyspark.sql import functions as F

from assayflow.functions import semantics as sem
from assayflow.operators import binning, deconv, demux, enrich, extras, link, matrix, normalize
from assayflow.sources import tables
from assayflow.streaming import counts as stream


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def cells(df):
    return {(r["peptide"], r["sample"]): r["score"] for r in df.collect()}


def m(spark, rows):
    return spark.createDataFrame(rows, "peptide string, sample string, score double")


@pytest.mark.parametrize("a, b, want", [(1.0, 2.0, 0.5), (1.0, 0.0, math.inf), (-1.0, 0.0, -math.inf), (0.0, 0.0, math.nan)])
def test_division(spark, a, b, want):
    got = one(spark, sem.ieee_div(F.lit(a), F.lit(b)))
    assert got == want or math.isnan(got) and math.isnan(want)


def test_semantics(spark):
    assert one(spark, sem.round_up_half(F.lit(-2.5))) == -2 and one(spark, sem.round_up_half(F.lit(2.5))) == 3
    assert one(spark, sem.round_up_half(F.lit(123.45), -1)) == 120
    assert one(spark, sem.at_least(F.lit(math.nan), F.lit(1.0))) is False
    assert one(spark, sem.hamming(F.lit("ACGT"), F.lit("AGGA"))) == 2
    assert one(spark, sem.kmers(F.lit("ABXCDE"), 2)) == ["AB", "CD", "DE"] and one(spark, sem.kmers(F.lit("A"), 2)) == []
    assert one(spark, sem.translate_codons(F.lit("ATGTTTTAA"))) == "MF_" and one(spark, sem.translate_codons(F.lit("ATN"))) is None
    assert one(spark, sem.mean_phred(F.lit("!+5"))) == pytest.approx(10)
    assert one(spark, sem.slice_at(F.lit("ACGT"), 1, 2)) == "CG" and one(spark, sem.slice_at(F.lit("ACGT"), 3, 2)) is None
    assert one(spark, sem.count_char(F.lit("banana"), "a")) == 3
    assert one(spark, sem.pair_of(F.lit("3.4,5.6"))).first == 3.4
    assert one(spark, sem.implication(F.lit(True), F.lit(False))) is False
    assert len(sem.CODONS) == 64 and sem.CODONS["ATG"] == "M" and sem.CODONS["TAA"] == "_"


def test_matrix_joins(spark):
    a, b = m(spark, [("p", "s", 1.0), ("q", "s", 2.0)]), m(spark, [("p", "s", 5.0), ("r", "t", 3.0)])
    assert cells(matrix.outer_join(a, b, "ignore"))[("p", "s")] == 5 and cells(matrix.outer_join(a, b, "combine"))[("p", "s")] == 6
    got = cells(matrix.outer_join(a, b, "include", "A", "B"))
    assert got[("p_A", "s")] == 1 and got[("p_B", "s")] == 5 and got[("q", "t")] == 0
    assert matrix.join_all([("A", a), ("B", b), ("C", a)], "combine").where("peptide = 'q' and sample = 's'").first()["score"] == 4
    with pytest.raises(ValueError):
        matrix.outer_join(a, b, "other")
    assert matrix.different(a, a).count() == 0


def test_size_factors_take_the_upper_median(spark):
    rows = [(p, s, x) for p, xs in {"a": (1.0, 4.0), "b": (2.0, 2.0), "c": (0.0, 3.0), "d": (9.0, 1.0)}.items() for s, x in zip("xy", xs)]
    got = {r["sample"]: r["factor"] for r in normalize.size_factors(m(spark, rows)).collect()}
    assert got["x"] == pytest.approx(1.0) and got["y"] == pytest.approx(1.0)


def test_negative_controls(spark):
    x = m(spark, [("p", "SB_1", 2.0), ("p", "xSB", 4.0), ("p", "xxxSB", 100.0), ("p", "A", 9.0), ("q", "A", 1.0)])
    assert {r["peptide"]: r["mu"] for r in normalize.control_means(x, start="SB").collect()}["p"] == 3
    assert cells(normalize.against_controls(x, "diff", names=["A"], controls=x.where("peptide = 'p'")))[("q", "A")] == 1
    with pytest.raises(ValueError):
        normalize.control_means(x)


def test_bins():
    keys = [(9.0, 1), (8.0, 1), (7.0, 3), (6.0, 1), (5.0, 1)]
    assert binning.fold(keys, 2) == [1, 1, 2, 3, 3]
    assert binning.fold_until_even([(3.0, 2), (2.0, 2), (1.0, 1)], 2) == [1, 1, 1]
    assert binning.fold_until_even([(2.0, 1), (1.0, 1)], 300) == [1, 1]
    assert binning.fold_until_even([], 3) == []


def test_zscores_of_constant_and_zero_bins(spark):
    x = m(spark, [(p, "s", v) for p, v in (("a", 2.0), ("b", 2.0), ("c", 0.0), ("d", 0.0), ("e", 5.0))])
    bins = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (2, "d"), (3, "e")], "bin_id int, peptide string")
    z = cells(binning.zscores(x, bins))
    assert z[("a", "s")] == 0 and math.isnan(z[("c", "s")]) and math.isnan(z[("e", "s")])
    assert binning.nan_report(binning.zscores(x, bins)).count() == 3


def test_enrichment_with_nan_fails(spark):
    x = m(spark, [("p", "A_1", 10.0), ("p", "A_2", math.nan), ("q", "A_1", 10.0), ("q", "A_2", 5.0)])
    got = enrich.enriched([(x, [10, 5])], enrich.replicate_sets(x)).collect()
    assert [(r["set_id"], r["peptide"]) for r in got] == [("A", "q")]


def test_deconvolution_groups_ties_and_takes_peptides(spark):
    links = [("a", "1", 5.0), ("b", "1", 5.0), ("a", "2", 5.0), ("b", "2", 4.9), ("c", "3", 3.0), ("b", "3", 1.0)]
    df = spark.createDataFrame([("s", *x) for x in links], "sample string, peptide string, species string, weight double")
    got = [(r["round"], r["species"], r["count"], r["original_score"]) for r in deconv.deconvolve(df, 1.0, "summation", 0.9, 0.5).orderBy("round", "species").collect()]
    assert got == [(0, "1", 2, 10.0), (0, "2", 2, 9.9), (1, "3", 1, 4.0)]
    lines = deconv.report_lines(deconv.deconvolve(df, 1.0, "summation", 0.9, 0.5)).orderBy("round").collect()
    assert [r["species"] for r in lines] == ["1,2", "3"]
    taken = deconv.assignments(df, {"3": 10.0}, "summation", 0.9, 0.5).collect()
    assert sorted((r["peptide"], r["species"]) for r in taken) == [("a", "1"), ("a", "2"), ("b", "1"), ("b", "2")]


def test_demux_prefers_exact_then_shifts_then_substitutions(spark):
    reads = spark.createDataFrame([(1, "AACCGG"), (2, "ACCGGA"), (3, "TAACCGG"), (4, "AACTGG"), (5, "AATTTT")], "read_id long, seq string")
    keys = spark.createDataFrame([("CCG",), ("GGG",)], "key string")
    got = {r["read_id"]: r["key"] for r in demux.tolerant_match(reads, keys, demux.Slice("seq", 2, 3, 1)).collect()}
    assert got == {1: "CCG", 2: "CCG", 3: "CCG", 4: "CCG"}
    assert demux.concatemers(reads, spark.createDataFrame([(5,)], "read_id long"), "TAAC").count() == 1
    tie = spark.createDataFrame([("CCA", 1), ("CCT", 0)], "key string, ord int")
    at = demux.Slice("seq", 2, 3, 1)
    one_read = reads.where("read_id = 1")
    assert demux.tolerant_match(one_read, tie, at).count() == 0
    assert demux.tolerant_match(one_read, tie, at, ambiguous="first").first()["key"] == "CCT"


def test_link_ids_and_weights(spark):
    proteins = spark.createDataFrame([("P OXX=1,2,3,4", "AAAC"), ("Q OXX=1,,3,4", "AAAC"), ("R", "AAAC")], "name string, seq string").withColumn("species", link.oxx_id(F.col("name")))
    peptides = spark.createDataFrame([("p", "AAAA"), ("q", "CCC")], "peptide string, seq string")
    got = link.linkage(peptides, proteins, 3).collect()
    assert [(r["peptide"], r["species"], r["weight"]) for r in got] == [("p", "2", 2.0)] and link.excluded(proteins).count() == 2
    assert {r["peptide"]: r["links"] for r in link.linkage_lines(peptides, link.linkage(peptides, proteins, 3)).collect()} == {"p": "2:2.0", "q": ""}


def test_distributions():
    assert extras.student_p(2.0, 10) == pytest.approx(0.07338803, abs=1e-7) and extras.student_p(0.0, 5) == pytest.approx(1.0)
    assert extras.poisson_sf(2, 3.0) == pytest.approx(0.57680992, abs=1e-7) and extras.poisson_sf(20, 3.0) == pytest.approx(1.179e-11, rel=0.01)


def test_connected_and_downsampled(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y")], "a string, b string")
    assert {r["name"]: r["root"] for r in extras.connected(pairs).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
    x = m(spark, [("p", "s", 5.0), ("q", "s", 5.0), ("p", "t", 3.0)])
    assert {r["sample"]: r["n"] for r in extras.downsampled(x, 6).groupBy("sample").agg(F.sum("score").alias("n")).collect()} == {"s": 6}


def test_files(spark, tmp_path):
    at = lambda name, text: (tmp_path / name).write_text(text) and str(tmp_path / name)
    x = tables.read_matrix(spark, at("m.tsv", "Sequence name\ts\tt\np\t1.5\tnan\nq\tabc\n"))
    got = cells(x)
    assert got[("p", "s")] == 1.5 and math.isnan(got[("p", "t")]) and got[("q", "s")] == 0 and got[("q", "t")] == 0
    tables.write_matrix(matrix.densify(m(spark, [("p", "s", 1.0), ("q", "t", 2.0)])), str(tmp_path / "out"), ["s", "t"], 2)
    assert cells(tables.read_matrix(spark, str(tmp_path / "out")))[("q", "t")] == 2
    fasta = tables.read_fasta(spark, at("f.fa", ">a one\nAC\nGT\n\n>b\nTT\n")).orderBy("ord").collect()
    assert [(r["name"], r["seq"]) for r in fasta] == [("a one", "ACGT"), ("b", "TT")]
    with gzip.open(tmp_path / "r.fastq.gz", "wt") as f:
        f.write("@a\nACGT\n+\nIIII\n@b\nTTTT\n+\n!!!!\n")
    reads = tables.read_fastq(spark, str(tmp_path / "r.fastq.gz")).orderBy("read_id").collect()
    assert [(r["read_id"], r["name"], r["seq"], r["qual"]) for r in reads] == [(0, "@a", "ACGT", "IIII"), (1, "@b", "TTTT", "!!!!")]
    links = tables.read_links(spark, at("l.tsv", "Peptide\tLinks\np\t1:2.5,2:3\nq\t\n")).orderBy("species").collect()
    assert [(r["peptide"], r["species"], r["weight"]) for r in links] == [("p", "1", 2.5), ("p", "2", 3.0)]
    with pytest.raises(Exception):
        tables.read_links(spark, at("bad.tsv", "Peptide\tLinks\np\t1\n")).collect()
    with pytest.raises(ValueError):
        tables.read_sample_sheet(spark, at("s.tsv", "SampleName\tIndex1\tIndex2\na\tF1\tR1\nb\tF1\tR1\n"))
    bins = tables.read_bins(spark, at("b.tsv", "p\tq\n\nr\n")).collect()
    assert sorted((r["bin_id"], r["peptide"]) for r in bins) == [(1, "p"), (1, "q"), (2, "r")]
    with pytest.raises(ValueError):
        tables.read_bins(spark, at("nobins.tsv", "a\tb\n1.0\t2.0\n"))
    assert tables.read_index_file(spark, at("fif.tsv", "Index1\tR1\t12\t10\t1\n")) == [("Index1", "r1", 12, 10, 1)]
    assert tables.read_thresholds(spark, "4") == {"": 4.0} and tables.read_thresholds(spark, at("t.tsv", "id\tn\n7\t3\n")) == {"7": 3.0}
    names = tables.read_ranked_lineage(spark, at("n.dmp", "header\n9\t|\tNine\t|\tx\t|\n9\t|\tNeuf\t|\n"))
    assert [(r["species"], r["name"]) for r in names.collect()] == [("9", "Nine")]
    (tmp_path / "e").mkdir()
    at("e/one_enriched.txt", "p\nq\n"), at("e/other.txt", "x\n")
    assert {(r["sample"], r["peptide"]) for r in tables.read_enriched_folder(spark, str(tmp_path / "e")).collect()} == {("one", "p"), ("one", "q")}


def test_streamed_counts_equal_batch(spark, tmp_path):
    rows = [(i, "AC" + ("GG" if i % 2 else "TT"), "") for i in range(20)]
    for k in range(2):
        spark.createDataFrame(rows[k::2], "read_id long, seq string, seq2 string").write.mode("append").parquet(str(tmp_path / "in"))
    codes = spark.createDataFrame([("AC", "S")], "key string, sample string")
    counts = stream.streamed_counts(stream.streamed_reads(spark, str(tmp_path / "in")), codes, demux.Slice("seq", 0, 2), demux.Slice("seq", 2, 2))
    q = stream.run_to_table(counts, "counted", str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert {(r["peptide"], r["score"]) for r in spark.table("counted").collect()} == {("GG", 10), ("TT", 10)}
