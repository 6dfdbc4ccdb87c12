"""Steps whose cost used to grow faster than their input, and results that only differed on larger tables."""

import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from assayflow.functions import semantics as sem
from assayflow.operators import deconv, demux, extras, link, matrix
from assayflow.sources import tables


def scores(spark, rows):
    return spark.createDataFrame(rows, "peptide string, sample string, score double")


@pytest.mark.parametrize("method", ["pearson", "spearman", "kendall"])
def test_correlations_of_equal_peptides_in_few_blocks(spark, monkeypatch, method):
    monkeypatch.setattr(extras, "CORRELATED", 1)
    monkeypatch.setattr(extras, "MOST_BLOCKS", 3)
    rng = np.random.default_rng(1)
    kinds = [[float(x) for x in rng.integers(0, 6, 5)] for _ in range(12)] + [[2.0] * 5]
    v = {f"p{i}": kinds[i % len(kinds)] for i in range(40)}
    m = scores(spark, [(p, f"s{k}", x) for p, of in v.items() for k, x in enumerate(of)])
    want = {}
    unit = {p: extras.unit_vectors(np.array([x]), method)[0] for p, x in v.items()}
    for a, b in itertools.combinations(sorted(v), 2):
        r = float(unit[a] @ unit[b])
        if abs(r) >= 0.8:
            want[a, b] = round(r, 9)
    got = extras.peptide_correlations(m, 0.8, 0.0, method).collect()
    assert len(got) == len(want) and {(r["a"], r["b"]): round(r["r"], 9) for r in got} == want


def test_substitutions_are_found_with_any_number_of_parts(spark, monkeypatch):
    rng = np.random.default_rng(2)
    word = lambda n: "".join(rng.choice(list("ACG"), n))
    keys = [(word(6), i) for i in range(30)]
    reads = [(i, word(8)) for i in range(60)]
    at = demux.Slice("seq", 1, 6, 2)
    slices = spark.createDataFrame([(i, s[1:7]) for i, s in reads], "read_id long, s string")
    held = {k for k, _ in keys}
    order = {k: min(o for x, o in keys if x == k) for k in held}
    differ = lambda a, b: sum(x != y for x, y in zip(a, b))
    want, first, only = set(), {}, {}
    for i, s in reads:
        want |= {(i, k, differ(s[1:7], k)) for k in held if differ(s[1:7], k) <= 2}
        exact = [s[p : p + 6] for p in (1, 0, 2) if s[p : p + 6] in held]
        near = sorted((differ(s[1:7], k), order[k], k) for k in held if differ(s[1:7], k) <= 2)
        if exact or near:
            first[i] = exact[0] if exact else near[0][2]
        if exact or near and (len(near) == 1 or near[1][0] > near[0][0]):
            only[i] = first[i]
    df, kf = spark.createDataFrame(reads, "read_id long, seq string"), spark.createDataFrame(keys, "key string, ord int")
    for n in (1, 10**6):  # few long parts, many short ones
        kept = demux._kept_parts(6, 2, n)
        monkeypatch.setattr(demux, "_kept_parts", lambda *_, kept=kept: kept)
        assert {tuple(r) for r in demux.hamming_join(slices, kf, 6, 2).collect()} == want
        assert {tuple(r) for r in demux.tolerant_match(df, kf, at, ambiguous="first").collect()} == set(first.items())
        assert {tuple(r) for r in demux.tolerant_match(df, kf, at).collect()} == set(only.items())
        monkeypatch.undo()


def test_parts_grow_with_the_keys():
    assert len(demux._kept_parts(10, 2, 10)) == 3 and len(demux._kept_parts(10, 2, 60_000)) == 45
    assert demux._kept_parts(2, 2, 5) == [[]]


def test_translations_are_counted_before_unknown_codons_go(spark):
    rows = [("ATGTTT", "s", 2), ("ATGTTC", "s", 3), ("ATGNNN", "s", 4)]
    got = demux.by_translation(spark.createDataFrame(rows, "peptide string, sample string, score long"))
    assert [tuple(r) for r in got.select("peptide", "sample", "score").collect()] == [("MF", "s", 5)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" in plan and plan.index("Filter") < plan.index("Aggregate")  # above it: the translation isn't pushed to the reads


def test_rounding_goes_by_the_double(spark):
    x = F.lit(41.0) / F.lit(640.0)  # times a million just below 64062.5
    got = spark.range(1).select(*[sem.round_binary(c, 6) for c in (x, -x, F.lit(0.1640625), F.lit(1e300), F.lit(float("nan")), F.lit(float("-inf")))]).first()
    assert list(got[:4]) == [0.064062, -0.064062, 0.164063, 1e300] and np.isnan(got[4]) and got[5] == float("-inf")


def test_fastq_pieces_are_put_in_order(spark, tmp_path):
    def file(name, first, n):
        (tmp_path / name).write_text("".join(f"@r{i}\n{'ACGT' * (1 + i % 7)}\n+\n{'I' * (4 + 4 * (i % 7))}\n" for i in range(first, first + n)))

    file("part-0.txt", 0, 7), file("part-1.txt", 7, 90), file("part-2.txt", 97, 20)  # larger pieces are dealt first, whatever their place
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("333b", "1500b", "1m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = tables.read_fastq(spark, str(tmp_path)).orderBy("read_id").collect()
            assert [(r["read_id"], r["name"], len(r["seq"]), len(r["qual"])) for r in got] == [(i, f"@r{i}", 4 + 4 * (i % 7), 4 + 4 * (i % 7)) for i in range(117)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_equal_sequences_are_linked_once(spark):
    peptides = spark.createDataFrame([(f"p{i}", ["AAAC", "CCDA", "DDDD"][i % 3]) for i in range(30)], "peptide string, seq string")
    proteins = spark.createDataFrame([(f"P{i}", str(i % 2), ["AAACC", "CDADD"][i % 2]) for i in range(20)], "name string, species string, seq string")
    got = {(r["peptide"], r["species"]): r["weight"] for r in link.linkage(peptides, proteins, 3, penalized=True).collect()}
    assert {k: round(w, 9) for k, w in got.items()} == {(f"p{i}", s): w for i in range(30) for s, w in [[("0", 0.2)], [("1", 0.1)], []][i % 3]}
    best = link.best_match(peptides.withColumnRenamed("peptide", "query"), proteins.withColumnRenamed("name", "ref"), 3).collect()
    assert {(r["query"], r["ref"], r["shared"]) for r in best} == {(f"p{i}", "P0", 2) for i in range(0, 30, 3)} | {(f"p{i}", "P1", 1) for i in range(1, 30, 3)}
    plan = link.linkage(peptides, proteins, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan  # sequences were linked before; peptides only look up


def test_components_and_linkage_of_distinct_sequences(spark):
    rows = [(f"n{i}", ["AACDEF", "AACDGG", "KLMNPQ", "WWWWYY", "A"][i % 5]) for i in range(12)] + [("single", "RSTRST")]
    proteins = spark.createDataFrame(rows, "name string, seq string")
    pairs = extras.kmer_similarity(proteins, 3, 0.2).collect()
    grams = {n: {s[i : i + 3] for i in range(len(s) - 2)} for n, s in rows}
    want = {(a, b): len(grams[a] & grams[b]) / min(len(grams[a]), len(grams[b])) for a, b in itertools.combinations(sorted(grams), 2) if grams[a] & grams[b]}
    assert {(r["a"], r["b"]): r["similarity"] for r in pairs} == want and len(pairs) == len(want)
    kept = spark.createDataFrame(list(want), "a string, b string")
    assert sorted(extras.similar_components(proteins, 3, 0.2).collect()) == sorted(extras.connected(kept).select("name", "root").collect())
    clusters = proteins.select("name", F.substring("name", 2, 1).alias("cluster"))
    one = {(r["c"], r["d"]): round(r["linkage"], 9) for r in extras.linkage_of_clusters(proteins, clusters, 3).collect()}
    two = {(r["c"], r["d"]): round(r["linkage"], 9) for r in extras.cluster_linkage(extras.kmer_similarity(proteins, 3), clusters).collect()}
    assert one == two and one


def test_downsampling_orders_few_reads_and_draws_the_same(spark, monkeypatch):
    m = scores(spark, [(f"p{i}", s, float(1 + i % 90)) for i in range(300) for s in "xy"] + [("p0", "z", 0.5)])
    each = m.where("score >= 1").select("peptide", "sample", F.explode(F.sequence(F.lit(1), F.col("score").cast("int"))).alias("i")).withColumn("k", F.xxhash64(F.lit(3), "peptide", "sample", "i"))
    want = {}
    for s in "xy":
        for r in each.where(F.col("sample") == s).orderBy("k").limit(40).collect():
            want[r["peptide"], s] = want.get((r["peptide"], s), 0.0) + 1
    stored, sizes = extras.stored, {}
    monkeypatch.setattr(extras, "stored", lambda df, name: sizes.setdefault(name, []).append(df.count()) or stored(df, name))
    for widen in (10, -6.2):  # the second bound is too low at first
        monkeypatch.setattr(extras.math, "sqrt", lambda x, widen=widen: x**0.5 * widen / 10 - (50 / 10 if widen < 0 else 0))
        got = {(r["peptide"], r["sample"]): r["score"] for r in extras.downsampled(m, 40, 3).collect()}
        assert got == want
    assert max(sizes["low-keys"]) < each.count() / 10 and len(sizes["low-keys"]) > 2


def test_different_cells_with_repeats(spark):
    a = scores(spark, [("p", "s", 1.0)] * 3 + [("q", "s", 2.0)])
    b = scores(spark, [("p", "s", 1.0), ("q", "s", 3.0), ("q", "s", 3.0), ("r", "s", float("nan"))])
    got = matrix.different(a, b)
    assert sorted(map(str, got.collect())) == sorted(map(str, a.exceptAll(b).withColumn("only_in", F.lit("first")).union(b.exceptAll(a).withColumn("only_in", F.lit("second"))).collect()))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1  # cells are grouped once


def test_taxa_are_counted_once_for_repeated_rows(spark):
    found = spark.createDataFrame([("s", "p"), ("s", "p"), ("s", "q")], "sample string, peptide string")
    links = spark.createDataFrame([("p", "1", 1.0), ("p", "1", 2.0), ("q", "1", 1.0), ("q", "2", 1.0)], "peptide string, species string, weight double")
    assert sorted(map(tuple, extras.taxa_by_file(found, links).collect())) == [("s", "1", 2), ("s", "2", 1)]
    assert "distinct" not in extras.taxa_by_file(found, links)._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["species"], r["n"], r["expected"]) for r in extras.taxon_poisson(found, links).collect()) == [("1", 2, 2.0), ("2", 1, 1.0)]


def test_candidates_share_what_their_peptides_share():
    rng = np.random.default_rng(4)
    rows = sorted({(f"p{rng.integers(200)}", f"t{rng.integers(6)}") for _ in range(500)})
    weight = {r: float(rng.integers(1, 9)) / 4 for r in rows}
    links = pa.table({"peptide": [p for p, _ in rows], "species": [s for _, s in rows], "weight": [weight[r] for r in rows]})
    for strategy in ("summation", "integer", "fraction"):
        g = deconv.Greedy(links, {}, strategy, 0.9, 0.5, True)
        of = {s: {p for p, t in rows if t == s} for s in g.species}
        part = {"integer": lambda p, s: 1.0, "fraction": lambda p, s: 1 / sum(p in x for x in of.values()), "summation": lambda p, s: weight[p, s]}[strategy]
        assert {g.species[s]: round(x, 9) for s, x in g.score().items()} == {s: round(sum(part(p, s) for p in x), 9) for s, x in of.items()}
        got = g.shared(list(range(len(g.species))))
        for i, a in enumerate(g.species):
            for j, b in enumerate(g.species):
                both, every = of[a] & of[b], of[a]
                want = sum(weight[p, a] for p in both) / sum(weight[p, a] for p in every) if strategy == "summation" else len(both) / len(every)
                assert got[i, j] == pytest.approx(want)
