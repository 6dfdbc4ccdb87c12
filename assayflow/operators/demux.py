"""Counting barcoded reads by peptide tag and sample, with shifts and substitutions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayflow.functions.semantics import count_char, hamming, mean_phred, slice_at, translate_codons  # noqa: F401
from assayflow.functions.sizes import MOST_BROADCAST_BYTES, few, table_bytes
from assayflow.sources.scratch import stored


@dataclass(frozen=True)
class Slice:
    """Where an index or tag stands in a read: column, 0-based start, length, allowed substitutions, name."""

    column: str
    start: int
    length: int
    mismatches: int = 0
    name: str = "Index1"


def _differ(a: Column, b: Column, length: int) -> Column:
    """Positions at which two strings of ``length`` differ; without lambdas if there are few."""
    if not 0 < length <= 32:
        return hamming(a, b)
    return reduce(lambda x, y: x + y, [(F.substring(a, i + 1, 1) != F.substring(b, i + 1, 1)).cast("int") for i in range(length)])


def _kept_parts(length: int, most: int, keys: int) -> list[list[tuple[int, int]]]:
    """The (start, length) pieces of which one list is equal in any two strings that differ in ``most`` places at most.

    A string is cut into parts, and all but ``most`` of them are kept in each way there is. More parts give more lists, but longer
    ones, that fewer keys share; the number is the one with the fewest keys (of four letters) to compare a string with.
    """
    best = (float("inf"), [[]])
    for parts in range(most + 1, length + 1):
        edges = [length * i // parts for i in range(parts + 1)]
        sizes = sorted(b - a for a, b in zip(edges, edges[1:]))
        cost = comb(parts, most) * (1 + keys / 4.0 ** sum(sizes[: parts - most]))
        if cost < best[0]:
            best = (cost, [[(edges[i], edges[i + 1] - edges[i]) for i in kept] for kept in combinations(range(parts), parts - most)])
    return best[1]


def _marks(s: Column, kept: list[list[tuple[int, int]]]) -> Column:
    return F.explode(F.array(*[F.concat(F.lit(f"{i}:"), *[F.substring(s, a + 1, n) for a, n in pieces]) for i, pieces in enumerate(kept)]))


def close_keys(slices: DataFrame, keys: DataFrame, length: int, most: int) -> DataFrame:
    """``(s, key, distance)`` of all keys within ``most`` substitutions of the distinct slices ``(s)``, stored in the shared folder.

    Slices and keys are paired by what is left of them without the parts that may differ (``_kept_parts``), then compared.
    """
    own = keys.where(F.length("key") == length).select("key").distinct()
    kept = _kept_parts(length, most, own.count())
    slices = stored(slices.where(F.length("s") == length).select("s").distinct(), "slices")
    left, right = slices.select("s", _marks(F.col("s"), kept).alias("mark")), own.select("key", _marks(F.col("key"), kept).alias("mark"))
    pairs = few(left).join(right, "mark").withColumn("distance", _differ(F.col("s"), F.col("key"), length))
    return stored(pairs.where(F.col("distance") <= most).select("s", "key", "distance").distinct(), "close-keys")


def _exact(reads: DataFrame, own: DataFrame, at: Slice, out: str, plus_one: bool) -> DataFrame:
    """The reads with a column ``out``: the key that the slice, or the first of the shifted ones, is."""
    held = F.broadcast if table_bytes(own) <= MOST_BROADCAST_BYTES else lambda t: t
    shifts, column, tried = [0, -1, -2] + ([1] if plus_one else []), F.col(at.column), []
    for i, shift in enumerate(shifts):
        tried.append(f"__{out}{i}")
        reads = reads.join(held(own.select(F.col("key").alias(tried[-1]))), slice_at(column, at.start + shift, at.length) == F.col(tried[-1]), "left")
    return reads.withColumn(out, F.coalesce(*tried)).drop(*tried)


def with_match(reads: DataFrame, keys: DataFrame, at: Slice, out: str = "key", plus_one: bool = True, ambiguous: str = "discard", fuzzy_needs_plus_one: bool = True, source: DataFrame | None = None) -> DataFrame:
    """The reads with a column ``out``: the key that the slice, or a shifted one, is exactly; else the nearest by substitutions; else null.

    Shifts come in order of preference: at the start, one and two before, one after. Keys are few beside reads, so the reads stay where they
    are: each shift is a lookup in the broadcast keys (up to a size; joins shuffle beyond). For substitutions, the distinct slices of reads that
    are left over are matched first, in a pass over ``source`` (the reads before columns were added to them; else ``reads``), and then looked up.
    Of several nearest keys none counts (``discard``) or the first by ``ord`` (``first``). Keys of another length than the slice never match.
    """
    own = keys.groupBy("key").agg(F.min("ord" if "ord" in keys.columns else "key").alias("ord"))
    found = _exact(reads, own, at, out, plus_one)
    if not at.mismatches or (fuzzy_needs_plus_one and not plus_one):
        return found
    asked = F.when(F.col(out).isNull(), slice_at(F.col(at.column), at.start, at.length))
    left = _exact((reads if source is None else source).select(at.column), own, at, out, plus_one).select(asked.alias("s"))
    close = close_keys(left, own, at.length, at.mismatches).join(few(own), "key").groupBy("s", "distance").agg(F.count("*").alias("n"), F.min(F.struct("ord", "key")).alias("first"))
    best = close.groupBy("s").agg(F.min(F.struct("distance", "n", "first")).alias("x"))
    if ambiguous != "first":
        best = best.where("x.n = 1")
    best = stored(best.select(F.col("s").alias("__of"), F.col("x.first.key").alias("__near"), F.lit(True).alias("__yes")), "nearest-keys")
    # reads that don't ask are spread by their own text, should the join shuffle
    found = found.withColumn("__s", asked).withColumn("__asks", F.col("__s").isNotNull()).withColumn("__s", F.coalesce("__s", at.column))
    found = found.join(few(best), (F.col("__s") == F.col("__of")) & (F.col("__asks") == F.col("__yes")), "left")
    return found.withColumn(out, F.coalesce(out, "__near")).drop("__s", "__asks", "__of", "__near", "__yes")


def shifted_match(reads: DataFrame, keys: DataFrame, at: Slice, plus_one: bool = True) -> DataFrame:
    """``(read_id, key)``: reads whose slice, or a shifted one, is a key exactly; the first in order of preference."""
    exact = Slice(at.column, at.start, at.length, 0, at.name)
    return with_match(reads.select("read_id", at.column), keys, exact, "key", plus_one).where("key is not null").select("read_id", "key")


def hamming_join(slices: DataFrame, keys: DataFrame, length: int, most: int) -> DataFrame:
    """``(read_id, key, distance)`` of all keys within ``most`` substitutions of a read's slice ``s``.

    Distinct slices are matched (:func:`close_keys`) and the keys handed to their reads. Keys of another length than the slice never match.
    """
    return slices.join(few(close_keys(slices, keys, length, most)), "s").select("read_id", "key", "distance")


def nearest(hits: DataFrame, ambiguous: str = "discard", order: DataFrame | None = None) -> DataFrame:
    """One key for each read: the closest; if several are, none (``discard``) or the first by ``order (key, ord)`` (``first``)."""
    if ambiguous == "first":
        ranked = hits.join(order, "key") if order is not None else hits.withColumn("ord", F.col("key"))
        return ranked.groupBy("read_id").agg(F.min(F.struct("distance", "ord", "key")).alias("b")).select("read_id", F.col("b.key").alias("key"))
    closest = F.min("distance").over(Window.partitionBy("read_id"))
    best = hits.withColumn("__min", closest).where("distance = __min").groupBy("read_id").agg(F.count("*").alias("n"), F.min("key").alias("key"))
    return best.where("n = 1").select("read_id", "key")


def tolerant_match(reads: DataFrame, keys: DataFrame, at: Slice, plus_one: bool = True, ambiguous: str = "discard", fuzzy_needs_plus_one: bool = True) -> DataFrame:
    """``(read_id, key)`` of the reads that :func:`with_match` finds a key for."""
    found = with_match(reads.select("read_id", at.column), keys, at, "key", plus_one, ambiguous, fuzzy_needs_plus_one)
    return found.where("key is not null").select("read_id", "key")


def with_sample(reads: DataFrame, barcodes: DataFrame, samples: DataFrame, indexes: list[Slice], plus_one: bool = True) -> DataFrame:
    """The reads with ``id0, id1, ...`` (null from the first index on that matches no barcode) and ``sample`` (null if no sample has these ids).

    ``barcodes (id, key)``, one id for each key; ``samples (ord, sample, ids array)``, in the order of ``indexes``; the first sample of a tuple
    wins. Substitutions look at all barcodes, used or not. No read is shuffled while barcodes and samples are small.
    """
    found, ids = reads, [f"id{i}" for i in range(len(indexes))]
    codes = barcodes.groupBy("key").agg(F.min("id").alias("__id"))
    for i, at in enumerate(indexes):
        found = with_match(found, barcodes, at, "__key", plus_one, source=reads)
        found = found.join(few(codes.withColumnRenamed("key", "__code")), F.col("__key") == F.col("__code"), "left")
        known = F.col("__id") if not i else F.when(F.col(ids[i - 1]).isNotNull(), F.col("__id"))
        found = found.withColumn(ids[i], known).drop("__key", "__code", "__id")
    first = samples.groupBy("ids").agg(F.min(F.struct("ord", "sample")).alias("x")).select(F.col("ids").alias("__ids"), F.col("x.sample").alias("sample"))
    return found.join(few(first), F.array(*ids) == F.col("__ids"), "left").drop("__ids")


def assign_samples(reads: DataFrame, barcodes: DataFrame, samples: DataFrame, indexes: list[Slice], plus_one: bool = True) -> DataFrame:
    """``(read_id, sample, ids)`` of the reads that :func:`with_sample` finds a sample for."""
    columns = list(dict.fromkeys(["read_id", *(at.column for at in indexes)]))
    found = with_sample(reads.select(*columns), barcodes, samples, indexes, plus_one)
    return found.where("sample is not null").select("read_id", "sample", F.array(*[f"id{i}" for i in range(len(indexes))]).alias("ids"))


def good_quality(reads: DataFrame, at: Slice, least: float, base: int = 33, qual: str = "qual") -> DataFrame:
    """Reads whose mean quality over the tag's slice is at least ``least``; 0 keeps all."""
    if not least:
        return reads
    return reads.where(mean_phred(slice_at(F.col(qual), at.start, at.length), base) >= least)


def _cells(counted: DataFrame, single: DataFrame, samples: DataFrame) -> DataFrame:
    """All library peptides by all samples, zeros included."""
    cells = single.select("peptide").crossJoin(samples.select("sample").distinct())
    return cells.join(counted, ["peptide", "sample"], "left").select("peptide", "sample", F.coalesce("n", F.lit(0)).cast("long").alias("score"))


def _single(library: DataFrame) -> DataFrame:
    """Library sequences that occur once: only they are counted."""
    return library.groupBy("key").agg(F.count("*").alias("n"), F.min("name").alias("peptide")).where("n = 1").select("key", "peptide")


def count_matrix(tags: DataFrame, assigned: DataFrame, library: DataFrame, samples: DataFrame) -> DataFrame:
    """``(peptide, sample, score)``: reads by library tag and sample, of tags ``(read_id, key)`` and assigned reads ``(read_id, sample)``."""
    single = _single(library)
    counted = tags.join(assigned.select("read_id", "sample"), "read_id").join(single, "key").groupBy("peptide", "sample").agg(F.count("*").alias("n"))
    return _cells(counted, single, samples)


def count_reads(reads: DataFrame, barcodes: DataFrame, samples: DataFrame, indexes: list[Slice], library: DataFrame, tag: Slice, plus_one: bool = True, ambiguous: str = "first") -> DataFrame:
    """``(peptide, sample, score)`` of the reads in one pass: sample and tag are found row by row, and only partial counts are shuffled."""
    single = _single(library)
    found = with_sample(reads, barcodes, samples, indexes, plus_one).where("sample is not null")
    found = with_match(found, library, tag, "key", plus_one, ambiguous, source=reads).where("key is not null").groupBy("key", "sample").agg(F.count("*").alias("n"))
    return _cells(found.join(few(single), "key").select("peptide", "sample", "n"), single, samples)


def reference_free_counts(assigned: DataFrame, at: Slice) -> DataFrame:
    """``(peptide, sample, score)`` of reads with their ``sample``: each tag slice is its own reference.

    Reads without a slice go after they are counted: a filter before would make each read's sequence once more.
    """
    own = assigned.where("sample is not null").select(slice_at(F.col(at.column), at.start, at.length).alias("peptide"), "sample")
    return own.groupBy("peptide", "sample").agg(F.count("peptide").alias("score")).where("score > 0")


def diagnostics(reads: DataFrame, barcodes: DataFrame, samples: DataFrame, indexes: list[Slice], library: DataFrame, tag: Slice, plus_one: bool = True) -> DataFrame:
    """By sample: reads whose first j + 1 ids are the sample's, for each j (``level1``, ...), and of the last those with a tag (``tags``).

    One pass over the reads: they are counted by all their ids, and the few counts are summed by each number of first ids.
    """
    ids = [f"id{i}" for i in range(len(indexes))]
    found = with_match(with_sample(reads, barcodes, samples, indexes, plus_one), library, tag, "__tag", plus_one, "first", source=reads)
    counted = found.where("id0 is not null").groupBy(*ids).agg(F.count("*").alias("n"), F.count("__tag").alias("tagged"))
    out = samples.select("sample", "ids")
    for j in range(len(ids)):
        some = ids[: j + 1]
        level = counted.where(F.col(ids[j]).isNotNull()).groupBy(*some).agg(F.sum("n").alias(f"level{j + 1}"), F.sum("tagged").alias("tags"))
        same = reduce(lambda a, b: a & b, [F.col("ids")[i] == F.col(c) for i, c in enumerate(some)])
        out = out.drop("tags").join(level, same, "left").drop(*some)
    return out.select("sample", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in [*(f"level{j + 1}" for j in range(len(ids))), "tags"]])


def cumulative(found: DataFrame, names: list[str]) -> DataFrame:
    """:func:`diagnostics` under the names of its file: each level is called by all indexes up to it, the last by the tag too."""
    joined = [" + ".join(names[: j + 1]) for j in range(len(names))]
    return found.select("sample", *[F.col(f"level{j + 1}").alias(x) for j, x in enumerate(joined)], F.col("tags").alias(f"{joined[-1]} + DNA tag"))


def unmapped(reads: DataFrame, mapped: DataFrame, by_sequence: bool = False) -> DataFrame:
    """Reads that aren't mapped; ``by_sequence`` also drops reads with the sequence of a mapped one."""
    if by_sequence:
        return reads.join(reads.join(mapped.select("read_id"), "read_id", "left_semi").select("seq").distinct(), "seq", "left_anti")
    return reads.join(mapped.select("read_id"), "read_id", "left_anti")


def concatemers(reads: DataFrame, tags: DataFrame, concatemer: str, seq: str = "seq") -> DataFrame:
    """Unmatched reads that have the concatemer anywhere."""
    return unmapped(reads, tags).where(F.col(seq).contains(concatemer))


def by_encoding(counts: DataFrame) -> DataFrame:
    """Counts summed by the name before the dash; a name without exactly two parts is an error."""
    parts = F.split("peptide", "-")
    checked = F.when(F.size(parts) == 2, parts[0]).otherwise(F.raise_error(F.concat(F.lit("not NAME-ENCODING: "), "peptide")))
    return counts.groupBy(checked.alias("peptide"), "sample").agg(F.sum("score").alias("score"))


def by_translation(counts: DataFrame) -> DataFrame:
    """Counts of nucleotide sequences summed by their amino acids; unknown codons fall away.

    They fall away after the sum: a filter on the translation would be moved below the counts and translate each read.
    """
    by = counts.select(translate_codons(F.col("peptide")).alias("peptide"), "sample", "score").groupBy("peptide", "sample")
    return by.agg(F.sum("score").alias("score"), F.count("peptide").alias("n")).where("n > 0").drop("n")


def truncation(library: DataFrame, length: int) -> DataFrame:
    """``(key, n, names)``: the library cut to ``length``; n over 1 means that names are no longer told apart."""
    cut = library.where(F.length("key") >= length).select("name", F.substring("key", 1, length).alias("key"))
    return cut.groupBy("key").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("name")), ",").alias("names"))


def replicate_summary(samples: DataFrame) -> DataFrame:
    """``(base, replicates, blank)``: samples by name up to the last underscore."""
    base = F.regexp_replace("sample", "_[^_]*$", "")
    return samples.groupBy(base.alias("base")).agg(F.count("*").alias("replicates")).withColumn("blank", F.col("base").startswith("Sblk_"))


def replicate_histogram(samples: DataFrame) -> DataFrame:
    return replicate_summary(samples).groupBy("replicates").agg(F.count("*").alias("bases"))


def match_rates(reads: DataFrame, barcodes: DataFrame, samples: DataFrame, indexes: list[Slice], library: DataFrame, tag: Slice, plus_one: bool = True) -> DataFrame:
    """One row: reads, percent with a sample's indexes, percent with indexes and tag."""
    found = with_match(with_sample(reads, barcodes, samples, indexes, plus_one), library, tag, "__tag", plus_one, "first", source=reads)
    n = F.count("*")
    both = F.count(F.when(F.col("sample").isNotNull() & F.col("__tag").isNotNull(), 1))
    return found.agg(n.alias("n_reads"), (100 * F.count("sample") / n).alias("pct_index"), (100 * both / n).alias("pct_index_tag"))


def duplicate_samples(samples: DataFrame) -> DataFrame:
    """Index tuples that several samples have: an error in a sample sheet."""
    return samples.groupBy("ids").agg(F.count("*").alias("n")).where("n > 1")


def missing_barcodes(samples: DataFrame, barcodes: DataFrame) -> DataFrame:
    return samples.select(F.explode("ids").alias("id")).distinct().join(barcodes.select("id"), "id", "left_anti")
