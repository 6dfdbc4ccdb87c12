"""Numeric rules that differ between engines: division, NaN, rounding, deviation, text of numbers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")
INF = float("inf")


def ieee_div(a: Column, b: Column) -> Column:
    """``a / b`` with infinities and NaN where ANSI mode would raise."""
    return (
        F.when(b != 0, a / F.when(b != 0, b))
        .when((a == 0) | F.isnan(a) | F.isnan(b), F.lit(NAN))
        .when(a > 0, F.lit(INF))
        .when(a < 0, F.lit(-INF))
    )


def at_least(x: Column, t: Column | float) -> Column:
    """``x >= t`` that is false for NaN."""
    return ~F.isnan(x) & (x >= t)


def round_up_half(x: Column, digits: int = 0) -> Column:
    """Rounds halves towards plus infinity."""
    p = F.lit(10.0**digits)
    return F.floor(x * p + 0.5) / p


def round_binary(x: Column, digits: int) -> Column:
    """``x`` times a power of ten, rounded to a whole number (halves away from zero), over that power.

    Spark's ``round`` takes the shortest decimal text of ``x`` instead: a product that lies just beside a half differs. What is too large for fractions stays.
    """
    p = F.lit(10.0**digits)
    y = F.abs(x * p)
    whole = F.floor(F.when(y < 2.0**52, y)).cast("double")
    near = F.when(y - whole >= 0.5, whole + 1).otherwise(whole) / p
    return F.when(y < 2.0**52, F.when(x < 0, -near).otherwise(near)).otherwise(x)


def sample_sd(x: Column) -> Column:
    """Sample standard deviation; NaN for a single value."""
    return F.coalesce(F.stddev_samp(x), F.lit(NAN))


def nan_if_null(x: Column) -> Column:
    return F.coalesce(x, F.lit(NAN))


def geometric_mean(x: Column) -> Column:
    """Aggregate; zeros are absent, and without other values the mean is 0."""
    return F.coalesce(F.exp(F.avg(F.when(x != 0, F.ln(F.when(x != 0, x))))), F.lit(0.0))


def relative_difference(a: Column, b: Column) -> Column:
    """``|a - b| / max(|a|, |b|)``; 0 for two zeros."""
    most = F.greatest(F.abs(a), F.abs(b))
    return F.when(most == 0, F.lit(0.0)).otherwise(F.abs(a - b) / F.when(most != 0, most))


def is_close(a: Column, b: Column, tolerance: float = 0.001) -> Column:
    return relative_difference(a, b) <= tolerance


def conjunction(*p: Column) -> Column:
    return reduce(lambda a, b: a & b, p)


def disjunction(*p: Column) -> Column:
    return reduce(lambda a, b: a | b, p)


def implication(p: Column, q: Column) -> Column:
    return ~p | q


def biconditional(p: Column, q: Column) -> Column:
    return p == q


def hamming(a: Column, b: Column) -> Column:
    """Positions at which two equally long strings differ."""
    return F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1))), F.lit(0), lambda n, i: n + F.when(F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)), 1).otherwise(0)
    )


def count_char(s: Column, c: str) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(c), F.lit("")))


def mean_phred(qual: Column, base: int = 33) -> Column:
    """Mean quality of a string of quality characters; null if empty."""
    total = F.aggregate(F.sequence(F.lit(1), F.length(qual)), F.lit(0), lambda n, i: n + F.ascii(F.substring(qual, i, F.lit(1))) - base)
    return F.when(F.length(qual) > 0, total / F.length(qual))


def slice_at(s: Column, start: int, length: int) -> Column:
    """The slice at a 0-based start; null if the string is too short or the start negative."""
    return F.when((F.lit(start) >= 0) & (F.length(s) >= start + length), F.substring(s, start + 1, length)) if start >= 0 else F.lit(None).cast("string")


def kmers(seq: Column, k: int, without: str = "X") -> Column:
    """All windows of length ``k`` that don't contain ``without``; empty for short sequences."""
    every = F.transform(F.sequence(F.lit(1), F.length(seq) - k + 1), lambda i: F.substring(seq, i, F.lit(k)))
    return F.when(F.length(seq) >= k, F.filter(every, lambda x: ~F.contains(x, F.lit(without)))).otherwise(F.array().cast("array<string>"))


#: The standard genetic code in the order T, C, A, G of each codon position; _ stops.
CODE = "FFLLSSSSYY__CC_WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODONS = {a + b + c: CODE[16 * i + 4 * j + k] for i, a in enumerate("TCAG") for j, b in enumerate("TCAG") for k, c in enumerate("TCAG")}


def translate_codons(nt: Column) -> Column:
    """Amino acids of a nucleotide sequence; null if a codon is unknown. Bases after the last codon don't count."""
    table = F.create_map(*[F.lit(x) for pair in CODONS.items() for x in pair])
    parts = F.transform(F.sequence(F.lit(0), F.floor(F.length(nt) / 3).cast("int") - 1), lambda i: F.try_element_at(table, F.substring(nt, i * 3 + 1, F.lit(3))))
    return F.when(F.length(nt) >= 3, F.when(~F.exists(parts, lambda x: x.isNull()), F.array_join(parts, ""))).otherwise(F.lit(""))


def pair_of(text: Column) -> Column:
    """The two numbers of ``"3.4,5.6"`` as a struct."""
    parts = F.split(text, ",")
    return F.struct(parts[0].cast("double").alias("first"), parts[1].cast("double").alias("second"))
