"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayflow.llm.common import code_points_of, first_classes, id_back, id_text

#: n-gram lengths, hash buckets, and labelled documents that a model is fitted on at most (in expectation).
ORDERS, BUCKET_BITS, MOST_TRAINING = (1, 2, 3), 15, 20_000
#: Characters scored at a time.
CHUNK = 1 << 18


def code_points(text: str) -> tuple[np.ndarray, bool]:
    """Lower-cased code points, runs of anything but letters and marks as one space, with a space at both ends; whether there is a letter."""
    raw = code_points_of(text.lower())
    kinds = first_classes(("L", "M"))[raw]
    points = np.concatenate((np.array([32], np.uint32), np.where(kinds < 2, raw, np.uint32(32)), np.array([32], np.uint32)))
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != 32) | (points[:-1] != 32)
    return points[keep], bool((kinds == 0).any())


def features(points: np.ndarray, start: int, stop: int, bits: int = BUCKET_BITS) -> np.ndarray:
    """Hash buckets of all n-grams that begin at places from ``start`` to before ``stop``."""
    out = []
    for n in ORDERS:
        size = min(stop, len(points) - n + 1) - start
        if size > 0:
            h = np.full(size, 0x9E3779B1 + n, np.uint32)
            for i in range(n):
                h = (h ^ points[start + i : start + i + size]) * np.uint32(0x85EBCA6B)
                h ^= h >> np.uint32(15)
            out.append(h >> np.uint32(32 - bits))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def scores(texts: list, table: np.ndarray, bits: int = BUCKET_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the log probabilities of each text's n-grams by language, and which texts have letters.

    A block of texts (or of parts of a long one) of about ``CHUNK`` characters is one sparse matrix, a row for each, times the dense
    table: its column numbers are the buckets in a row, its values are ones, and rows end where the next begins.
    """
    sums, lettered = np.zeros((len(texts), table.shape[1])), np.zeros(len(texts), bool)
    columns: list[np.ndarray] = []
    rows: list[int] = []

    def multiply() -> None:
        if columns:
            starts = np.cumsum([0, *map(len, columns[:-1])])
            np.add.at(sums, rows, np.add.reduceat(table[np.concatenate(columns)], starts, axis=0, dtype=np.float64))
            columns.clear()
            rows.clear()

    size = 0
    for i, text in enumerate(texts):
        points, lettered[i] = code_points(text) if isinstance(text, str) else (np.zeros(0, np.uint32), False)
        for at in range(0, len(points) if lettered[i] else 0, CHUNK):
            columns.append(features(points, at, at + CHUNK, bits))
            rows.append(i)
            size += len(columns[-1])
            if size >= CHUNK:
                multiply()
                size = 0
    multiply()
    return sums, lettered


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", bits: int = BUCKET_BITS) -> tuple[list[str], np.ndarray]:
    """``(languages, log probabilities)`` from a bounded table of labelled rows.

    The matrix has a row for each bucket and a column for each language, priors in the last row:
    its size is fixed by the labels. Counts are summed by language and bucket before they reach the driver.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                own = sums.setdefault(lang, np.zeros((1 << bits) + 1, np.int64))
                own[-1] += 1
                points, _ = code_points(text)
                for at in range(0, len(points), CHUNK):
                    own[:-1] += np.bincount(features(points, at, at + CHUNK, bits), minlength=1 << bits)
        for lang, own in sums.items():
            at = np.flatnonzero(own)
            yield pd.DataFrame({"lang": lang, "bucket": at, "n": own[at]})

    rows = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    counts = rows.mapInPandas(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    own = counts.groupBy("lang").agg(F.collect_list("bucket").alias("bucket"), F.collect_list("n").alias("n")).collect()
    names = sorted(r["lang"] for r in own)
    table = np.zeros(((1 << bits) + 1, max(1, len(names))))
    for r in own:
        table[r["bucket"], names.index(r["lang"])] = r["n"]
    if not names:
        return [], table
    smooth = table[:-1] + 0.1
    return names, np.vstack((np.log(smooth / smooth.sum(axis=0)), np.log(table[-1:] / table[-1].sum())))


def predict(docs: DataFrame, names: list[str], log_prob: np.ndarray, id_col: str = "doc_id", text_col: str = "text", bits: int = BUCKET_BITS) -> DataFrame:
    """``(id, lang_pred, score)``: the most probable language of the whole text and its probability.

    Null texts, texts without letters (marks, digits, symbols and emoji are none) and an empty model give ``und`` and 0. The matrix is
    broadcast; batches of documents are scored by :func:`scores`. Texts are read whole, each n-gram once; ties take the
    language that comes first; repeated rows are predicted each; an empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((names, log_prob.astype(np.float32)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        langs, table = shared.value
        table, prior = np.ascontiguousarray(table[:-1]), table[-1].astype(np.float64)
        for batch in batches:
            if not langs:
                yield pd.DataFrame({"id": batch["id"], "lang_pred": "und", "score": 0.0})
                continue
            total, lettered = scores(list(batch["text"]), table, bits)
            odds = np.exp(total + prior - (total + prior).max(axis=1, keepdims=True))
            best = odds.argmax(axis=1)
            score = np.where(lettered, odds.max(axis=1) / odds.sum(axis=1), 0.0)
            yield pd.DataFrame({"id": batch["id"], "lang_pred": np.where(lettered, np.array(langs, object)[best], "und"), "score": score})

    source = docs.select(id_text(id_col), F.col(text_col).alias("text"))
    return id_back(source.mapInPandas(run, "id string, lang_pred string, score double"), docs, id_col)


def held_out(id_col: str = "doc_id"):
    """Documents that are never learned from: crc32 of the id as text, modulo 5, is 0. A null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0


def bounded(labelled: DataFrame, id_col: str = "doc_id", most: int = MOST_TRAINING, seed: int = 41) -> DataFrame:
    """About ``most`` rows, chosen by a hash of the id; all rows if there are no more."""
    n = labelled.count()
    rate = min(1.0, most / max(1, n))
    return labelled if rate == 1 else labelled.where(F.pmod(F.xxhash64(F.lit(seed), id_col), F.lit(1_000_000)) < int(rate * 1_000_000))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(bounded(docs.where(~held_out()).where("lang is not null and text is not null")))
    return predict(docs, *model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
