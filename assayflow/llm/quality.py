"""Quality rules: Jensen-Shannon distance of a document's histograms to language references."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayflow.llm.common import WORD, code_points_of, first_classes, id_back, id_text

#: Base rule: fewest words; most words, in percent, that stand in repeated windows of this many words.
LEAST_WORDS, MOST_REPEATED_PERCENT, WINDOW = 50, 50, 3
#: Common words in a language's reference; a document's histogram of them has one more place for all others.
COMMON_WORDS = 200
#: Verdict: largest distances, and the characters and words from which a histogram counts as evidence.
MOST_CLASS_DISTANCE, MOST_WORD_DISTANCE, LEAST_CHARS, LEAST_TOKENS = 0.3, 0.75, 200, 100
#: Least part of a language's share of common words that a text has; common words expected from which their absence counts.
LEAST_COMMON, LEAST_EXPECTED = 0.25, 20
#: Character classes by the first letters of the Unicode category; anything else is the last class.
CLASSES = ("Ll", "Lu", "L", "M", "N", "P", "S", "Z", "C")

_word, _token, _symbol = re.compile(WORD), re.compile(r"[^\W\d_]+"), re.compile(r"[#*$%&|<>]")
CHUNK = 1 << 20


def char_classes(text: str) -> np.ndarray:
    """How many characters of the text are in each class. Tabs and line ends are layout and don't count."""
    out = np.zeros(len(CLASSES), np.int64)
    for at in range(0, len(text), CHUNK):
        points = code_points_of(text[at : at + CHUNK])
        out += np.bincount(first_classes(CLASSES)[points[~np.isin(points, (9, 10, 13))]], minlength=len(out))
    return out


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of the whole text."""
    words = _word.findall(text)
    n = len(words)
    windows = list(zip(*(words[i:] for i in range(WINDOW)))) if n >= WINDOW else []
    times = Counter(windows)
    repeated, covered = 0, 0  # covered: words before this one are counted
    if len(times) < len(windows):
        for i, w in enumerate(windows):
            if times[w] > 1:
                repeated += i + WINDOW - max(covered, i)
                covered = i + WINDOW
    lines = [x for x in text.split("\n") if _word.search(x)]
    return n, sum(map(len, words)), len(_symbol.findall(text)), len(lines) - len(set(lines)), repeated


def jensen_shannon(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distance, 0 to 1, between the histogram ``p`` and each row of ``q``; all of them sum to 1."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        part = lambda x: np.where(x > 0, x * np.log2(x / m), 0).sum(axis=-1)
        return np.sqrt(np.maximum(0, (part(np.broadcast_to(p, m.shape)) + part(q)) / 2))


def references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", common: int = COMMON_WORDS) -> dict:
    """``{language: (class shares, {common word: share})}`` over all documents that have a language.

    A language's reference is the mean of its documents' histograms, so that no long document outweighs others.
    The result's size is fixed by the languages: ``common`` words and a few classes each.
    """

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        classes: dict[str, np.ndarray] = {}
        words: dict[str, dict[str, float]] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                own = char_classes(text)
                if own.sum():
                    classes[lang] = classes.get(lang, 0) + own / own.sum()
                tokens = _token.findall(text.lower())
                mine, share = words.setdefault(lang, {}), 1 / max(1, len(tokens))
                for w in tokens:
                    mine[w] = mine.get(w, 0.0) + share
                if len(mine) > 200_000:
                    yield flat(lang, "w", mine.keys(), mine.values())
                    mine.clear()
        for lang, own in classes.items():
            yield flat(lang, "c", map(str, range(len(own))), own)
        for lang, mine in words.items():
            if mine:
                yield flat(lang, "w", mine.keys(), mine.values())

    def flat(lang, kind, keys, values):
        return pd.DataFrame({"lang": lang, "kind": kind, "key": list(keys), "share": list(values)})

    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    # whole units of 2**-24: sums don't depend on the order of their parts
    unit = 2.0**24
    parts = rows.mapInPandas(sums, "lang string, kind string, key string, share double")
    found = parts.groupBy("lang", "kind", "key").agg(F.sum((F.col("share") * unit).cast("long")).alias("share"))
    # the filter on the rank keeps the best of each language in each task before rows are dealt out
    best = found.withColumn("i", F.row_number().over(Window.partitionBy("lang", "kind").orderBy(F.desc("share"), "key"))).where(F.col("i") <= common)
    out: dict = {}
    docs_by_lang: dict[str, float] = {}
    words: dict[str, dict[str, float]] = {}
    for r in best.collect():
        if r["kind"] == "c":
            out.setdefault(r["lang"], np.zeros(len(CLASSES)))[int(r["key"])] = r["share"] / unit
        else:
            words.setdefault(r["lang"], {})[r["key"]] = r["share"] / unit
    for lang, classes in out.items():
        docs_by_lang[lang] = max(classes.sum(), 1e-12)
    return {lang: (classes / docs_by_lang[lang], {w: x / docs_by_lang[lang] for w, x in sorted(words.get(lang, {}).items())}) for lang, classes in sorted(out.items())}


class Judge:
    """Distances of texts to the nearest language reference."""

    def __init__(self, refs: dict):
        self.langs = list(refs)
        self.classes = np.array([refs[x][0] for x in self.langs]).reshape(len(self.langs), len(CLASSES))
        vocabulary = sorted({w for x in self.langs for w in refs[x][1]})
        self.place = {w: i for i, w in enumerate(vocabulary)}
        self.words = np.zeros((len(self.langs), len(vocabulary) + 1))
        for i, x in enumerate(self.langs):
            for w, share in refs[x][1].items():
                self.words[i, self.place[w]] = share
        self.words[:, -1] = np.maximum(0, 1 - self.words.sum(axis=1))
        self.common = self.words[:, :-1] > 0
        self.words /= np.maximum(self.words.sum(axis=1, keepdims=True), 1e-12)

    def distances(self, text: str) -> tuple[float | None, float | None]:
        """(class distance, word distance) to the nearest reference; None where the text is too short to tell."""
        if not self.langs:
            return None, None
        own, class_d, word_d = char_classes(text), None, None
        if own.sum() >= LEAST_CHARS:
            class_d = float(jensen_shannon(own / own.sum(), self.classes).min())
        tokens = _token.findall(text.lower())
        if len(tokens) >= LEAST_TOKENS:
            seen = np.zeros(len(self.place) + 1)
            for w, c in Counter(tokens).items():
                seen[self.place.get(w, -1)] += c
            word_d = float(jensen_shannon(seen / len(tokens), self.words).min())
        return class_d, word_d

    def lacks_common_words(self, text: str) -> bool:
        """Whether the text has too few common words for each language whose character classes are near.

        The distance can't tell: the place of all other words is so large in a reference that a text of nothing else is near.
        """
        own, tokens = char_classes(text), _token.findall(text.lower())
        if not self.langs or own.sum() < LEAST_CHARS or len(tokens) < LEAST_TOKENS:
            return False
        near = jensen_shannon(own / own.sum(), self.classes) <= MOST_CLASS_DISTANCE
        seen = np.zeros(len(self.place))
        for w, c in Counter(tokens).items():
            if w in self.place:
                seen[self.place[w]] += c
        expected = len(tokens) * (1 - self.words[:, -1])
        enough = (expected < LEAST_EXPECTED) | (self.common @ seen >= LEAST_COMMON * expected)
        return bool(near.any() and not (near & enough).any())

    def verdict(self, text: str) -> tuple:
        """The base counts, whether the base rule fails, whether the document stays, both distances."""
        base = base_counts(text)
        failed = base[0] < LEAST_WORDS or 100 * base[4] > MOST_REPEATED_PERCENT * base[0]
        near, common = self.distances(text)
        return *base, failed, not failed and (near is None or near <= MOST_CLASS_DISTANCE) and (common is None or common <= MOST_WORD_DISTANCE) and not self.lacks_common_words(text), near, common


def judge(docs: DataFrame, refs: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, the base counts, ``base_failed``, ``kept``, ``class_distance`` and ``word_distance``.

    ``kept`` is false if the base rule fails, a distance to the nearest reference is too large or common words are missing. A
    distance is null, and not held against the document, below its minimum length. Null and empty
    texts have no words and fail the base rule; an empty table gives an empty result; repeated ids
    are judged each; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(refs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        to = Judge(shared.value)
        for batch in batches:
            rows = [to.verdict(text) for text in batch["text"]]
            yield pd.DataFrame(rows, columns=names, index=batch.index).astype({"class_distance": float, "word_distance": float}).assign(id=batch["id"])

    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance"]
    schema = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, class_distance double, word_distance double"
    source = docs.select(id_text(id_col), F.coalesce(text_col, F.lit("")).alias("text"))
    return id_back(source.mapInPandas(run, f"id string, {schema}"), docs, id_col)


def good_documents(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of documents that :func:`judge` keeps, with all their columns, whatever their names, and without a shuffle.

    Null and empty texts go; repeated rows stay or go together; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(references(docs, text_col, lang_col))

    @F.pandas_udf("boolean")
    def keep(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        to = Judge(shared.value)
        for texts in batches:
            yield texts.map(lambda text: to.verdict(text)[6]).astype(bool)

    return docs.where(keep(F.coalesce(text_col, F.lit(""))))


def op8_distribution_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return judge(docs, references(docs))
