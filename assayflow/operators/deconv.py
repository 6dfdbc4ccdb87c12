"""From enriched peptides to a parsimonious list of taxa."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REPORT = "sample string, round int, species string, count long, score double, original_count long, original_score double, max_peptide_score double"


def enriched_links(links: DataFrame, enriched: DataFrame) -> DataFrame:
    """Links of enriched peptides."""
    return links.join(enriched.select("peptide").distinct(), "peptide", "left_semi")


def scores(links: DataFrame, strategy: str = "summation") -> DataFrame:
    """``(species, score, count)`` by ``integer``, ``fraction`` (1 / species of the peptide) or ``summation`` of weights."""
    if strategy == "fraction":
        n = links.groupBy("peptide").agg(F.count("*").alias("n"))
        return links.join(n, "peptide").groupBy("species").agg(F.sum(1 / F.col("n")).alias("score"), F.count("*").alias("count"))
    value = F.count("*").cast("double") if strategy == "integer" else F.sum("weight")
    return links.groupBy("species").agg(value.alias("score"), F.count("*").alias("count"))


def overlaps(links: DataFrame, strategy: str = "integer") -> DataFrame:
    """``(a, b, a_to_b, b_to_a)`` for species, a < b, that share a peptide: counts, shares or shares of weight."""
    x = links.select("peptide", F.col("species").alias("a"), F.col("weight").alias("wa"))
    y = links.select("peptide", F.col("species").alias("b"), F.col("weight").alias("wb"))
    by = x.join(y, "peptide").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"), F.sum("wa").alias("wa"), F.sum("wb").alias("wb"))
    if strategy == "integer":
        return by.select("a", "b", F.col("n").cast("double").alias("a_to_b"), F.col("n").cast("double").alias("b_to_a"))
    total = links.groupBy("species").agg(F.count("*").alias("n_all"), F.sum("weight").alias("w_all"))
    one, two = (total.select(F.col("species").alias(k), F.col("n_all").alias(f"n{k}"), F.col("w_all").alias(f"w_all_{k}")) for k in "ab")
    both = by.join(one, "a").join(two, "b")
    if strategy == "percent":
        return both.select("a", "b", (F.col("n") / F.col("na")).alias("a_to_b"), (F.col("n") / F.col("nb")).alias("b_to_a"))
    return both.select("a", "b", (F.col("wa") / F.col("w_all_a")).alias("a_to_b"), (F.col("wb") / F.col("w_all_b")).alias("b_to_a"))


def tie_candidates(scored: DataFrame, threshold: float, tie: float) -> DataFrame:
    """The top species and those that follow while within the tie distance (whole number) or ratio (fraction)."""
    top = scored.agg(F.max("score").alias("top"))
    within = (F.col("top") - F.col("score") <= tie) if tie % 1 == 0 else (F.col("score") / F.when(F.col("top") != 0, F.col("top")) >= tie)
    return scored.crossJoin(top).where((F.col("score") >= threshold) & within).select("species", "score")


def per_peptide(links: DataFrame, strategy: str) -> DataFrame:
    """``(peptide, species, part)``: what each peptide adds to a species."""
    if strategy == "fraction":
        return links.join(links.groupBy("peptide").agg((1 / F.count("*")).alias("part")), "peptide").select("peptide", "species", "part")
    return links.select("peptide", "species", F.lit(1.0).alias("part") if strategy == "integer" else F.col("weight").alias("part"))


class Greedy:
    """One sample's rounds: tie group of the top species, its peptides go, the rest is scored again.

    Links are arrays of numbers of peptides and species, so a sample takes some 30 bytes a link, and a round is a few passes over them.
    """

    def __init__(self, links: pa.Table, thresholds: dict[str, float], strategy: str, tie: float, overlap: float, score_filter: bool):
        codes, self.names, weights = [], [], links.column("weight").to_numpy().astype(float)
        for name in ("peptide", "species"):
            c = links.column(name).combine_chunks().dictionary_encode()
            c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
            words = c.dictionary.to_pylist() if name == "species" else c.dictionary
            codes.append(c.indices.to_numpy(zero_copy_only=False).astype(np.int32))
            self.names.append(words)
        p, s = codes
        order = np.lexsort((p, s))  # stable: of a link that is given twice the last counts
        p, s, weights = p[order], s[order], weights[order]
        last = np.ones(len(p), bool)
        last[:-1] = (p[1:] != p[:-1]) | (s[1:] != s[:-1])
        self.p, self.w, s = p[last], weights[last], s[last]
        self.n_peptides, self.species = len(self.names[0]), self.names[1]
        self.edges = np.searchsorted(s, np.arange(len(self.species) + 1))
        self.here = np.ones(self.n_peptides, bool)
        self.default = thresholds.get("", 0.0)
        self.thresholds, self.strategy, self.tie, self.overlap, self.score_filter = thresholds, strategy, tie, overlap, score_filter
        self.of_peptide = np.bincount(self.p, minlength=self.n_peptides)
        self.exact = bool(np.all(self.w == np.floor(self.w)) and np.abs(self.w).sum() < 2.0**53)
        self.held: dict[int, tuple[int, float]] = {}

    def threshold(self, s: int) -> float:
        return self.thresholds.get(self.species[s], self.default)

    def own(self, s: int) -> tuple[np.ndarray, np.ndarray]:
        """All peptides of a species and their weights."""
        return self.p[self.edges[s] : self.edges[s + 1]], self.w[self.edges[s] : self.edges[s + 1]]

    def left(self, s: int) -> np.ndarray:
        p = self.own(s)[0]
        return p[self.here[p]]

    def parts(self, s: int) -> np.ndarray:
        """What each peptide that is left adds to a species."""
        p, w = self.own(s)
        left = self.here[p]
        if self.strategy == "integer":
            return np.ones(int(left.sum()))
        return 1 / self.of_peptide[p[left]] if self.strategy == "fraction" else w[left]

    def total(self, s: int) -> float:
        """The sum of the parts, rounded once."""
        parts = self.parts(s)
        if self.strategy == "integer" or (self.strategy == "summation" and self.exact):
            return float(parts.sum())
        values, times = np.unique(parts, return_counts=True)
        return float(sum((Fraction(v) * int(n) for v, n in zip(values.tolist(), times)), Fraction(0))) if len(values) < 1000 else math.fsum(parts.tolist())

    def score(self) -> dict[int, float]:
        """Scores of the species that reach their threshold; those that lost no peptide since the last round keep theirs."""
        found = {}
        for s in range(len(self.species)):
            n = len(self.left(s))
            if n and self.held.get(s, (0, 0.0))[0] != n:
                self.held[s] = (n, self.total(s))
            if n and (self.held[s][1] if self.score_filter else n) >= self.threshold(s):
                found[s] = self.held[s][1]
        return found

    def shared(self, cand: list[int]) -> np.ndarray:
        """How much each candidate shares with each other: sums over slices of peptides of products of candidates' rows."""
        c, weighed = len(cand), self.strategy == "summation"
        total, step = np.zeros((c, c)), max(1, (1 << 22) // c)
        own = [self.own(s) if weighed else (self.left(s), None) for s in cand]
        for at in range(0, self.n_peptides, step):
            end = min(at + step, self.n_peptides)
            x, has = np.zeros((c, end - at)), np.zeros((c, end - at))
            for i, (p, w) in enumerate(own):
                a, b = np.searchsorted(p, (at, end))
                x[i, p[a:b] - at] = w[a:b] if weighed else 1.0
                has[i, p[a:b] - at] = w[a:b] > 0 if weighed else 1.0
            total += x @ has.T
        if weighed:
            return total / np.array([[w.sum() or 1.0] for _, w in own])
        return total / np.array([[len(p)] for p, _ in own]) if self.overlap % 1 else total

    def enough(self, o: tuple[float, float]) -> bool:
        return self.overlap == 0 or min(o) >= self.overlap

    def group(self, ranked: list[tuple[int, float]]) -> list[int]:
        top, cand = ranked[0][1], [ranked[0][0]]
        for s, x in ranked[1:]:
            near = top - x <= self.tie if self.tie % 1 == 0 else (x / top if top else 1.0) >= self.tie
            if x < self.threshold(s) or not near:
                break
            cand.append(s)
        if len(cand) == 1:
            return cand
        matrix = self.shared(cand).tolist()
        both = lambda a, b: (matrix[a][b], matrix[b][a])
        if len(cand) == 2:
            return cand if self.enough(both(0, 1)) else cand[:1]
        value = dict(ranked)
        o, i, best = 0, 0, (0.0, 0.0)
        for a in range(len(cand)):
            for b in range(a + 1, len(cand)):
                if min(both(a, b)) > 0 and value[cand[o]] > value[cand[a]] and value[cand[i]] > value[cand[b]]:
                    o, i, best = a, b, both(a, b)
        out = [cand[o]]
        if self.enough(best) and i != o:
            out.append(cand[i])
            out += [c for n, c in enumerate(cand) if n not in (o, i) and self.enough(both(n, o)) and self.enough(both(n, i))]
        return out

    def rounds(self, seen=None):
        """The rounds' rows, the last cell the numbers of the peptides; ``seen`` gets (round, species, count, score) of all that are scored in each round."""
        first = self.score()
        original = {s: (len(self.left(s)), x) for s, x in first.items()}
        number, now = 0, first
        while now:
            ranked = sorted(now.items(), key=lambda x: (-x[1], self.species[x[0]]))
            if seen is not None:
                seen.extend((number, self.species[s], self.held[s][0], x) for s, x in ranked)
            if ranked[0][1] <= self.threshold(ranked[0][0]):
                return
            group = self.group(ranked)
            taken = [self.left(s) for s in group]
            for s, p in zip(group, taken):
                n, x = original.get(s, (len(p), now[s]))
                yield number, self.species[s], len(p), now[s], n, x, float(self.parts(s).max()), p
            for p in taken:
                self.here[p] = False
            number, now = number + 1, self.score()


def _by_sample(links: DataFrame, schema: str, rows, thresholds: dict[str, float] | float, *rules) -> DataFrame:
    """``rows(Greedy)``, columns without the sample, for each sample; samples run in parallel."""
    limits = {"": float(thresholds)} if not isinstance(thresholds, dict) else thresholds
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
    kept = pa.schema([(n, kinds[x.split()[1]]) for n, x in zip(names, schema.split(", "))])

    def run(key, table):
        greedy = Greedy(table.select(["peptide", "species", "weight"]), limits, *rules)
        del table
        columns = rows(greedy)
        n = len(columns[0])
        return pa.Table.from_arrays([pa.array([key[0].as_py()] * n, pa.string()), *[pa.array(c, f.type) for c, f in zip(columns, list(kept)[1:])]], schema=kept)

    return links.select("sample", "peptide", "species", "weight").groupBy("sample").applyInArrow(run, schema)


def _columns(rows: list[tuple], n: int) -> list[list]:
    return [list(c) for c in zip(*rows)] or [[] for _ in range(n)]


def deconvolve(links: DataFrame, thresholds: dict[str, float] | float = 0.0, strategy: str = "summation", tie: float = 0.0, overlap: float = 1.0, score_filter: bool = True) -> DataFrame:
    """The report of each sample in ``links (sample, peptide, species, weight)``; samples run in parallel.

    A sample's links are those of its enriched peptides, bounded by the assay's library. Ties are ordered by species id.
    """
    return _by_sample(links, REPORT, lambda g: _columns([r[:-1] for r in g.rounds()], 7), thresholds, strategy, tie, overlap, score_filter)


def assignments(links: DataFrame, thresholds: dict[str, float] | float = 0.0, strategy: str = "summation", tie: float = 0.0, overlap: float = 1.0, score_filter: bool = True) -> DataFrame:
    """``(sample, peptide, species)``: the species whose round took the peptide."""

    def taken(g: Greedy) -> list:
        found = [(r[1], r[-1]) for r in g.rounds()]
        if not found:
            return [[], []]
        species = pa.DictionaryArray.from_arrays(np.repeat(np.arange(len(found), dtype=np.int32), [len(p) for _, p in found]), pa.array([s for s, _ in found], pa.string()))
        return [g.names[0].take(pa.array(np.concatenate([p for _, p in found]))), species.cast(pa.string())]

    return _by_sample(links, "sample string, peptide string, species string", taken, thresholds, strategy, tie, overlap, score_filter)


def round_scores(links: DataFrame, thresholds: dict[str, float] | float = 0.0, strategy: str = "summation", tie: float = 0.0, overlap: float = 1.0, score_filter: bool = True) -> DataFrame:
    """``(sample, round, species, count, score)``: all species that are scored in each round, the last one, which takes none, included."""

    def scored(g: Greedy) -> list:
        seen: list = []
        for _ in g.rounds(seen):
            pass
        return _columns(seen, 4)

    return _by_sample(links, "sample string, round int, species string, count long, score double", scored, thresholds, strategy, tie, overlap, score_filter)


def report_lines(report: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """A row for each round: tied species joined by commas, in order of their names (or ids)."""
    r = report if names is None else report.join(names, "species", "left")
    r = r.withColumn("name", F.coalesce(F.col("name") if names is not None else F.lit(None), F.col("species")))
    cols = ["species", "count", "score", "original_count", "original_score", "max_peptide_score"]
    ordered = F.sort_array(F.collect_list(F.struct("name", *cols)))
    by = r.groupBy("sample", "round").agg(ordered.alias("x"))
    return by.select("sample", "round", *[F.array_join(F.col(f"x.{c}").cast("array<string>"), ",").alias(c) for c in ["name", *cols]])
