"""Packing documents into sequences by linear grouping, few-size configurations and best fit.

Lengths are integers up to the sequence length, so the whole packing is planned on the histogram of
lengths, whose size does not depend on the corpus: runs of equally long pieces go to runs of
sequences. The pieces then only need their rank among pieces of their length to find their place.
"""

from __future__ import annotations

import bisect
import json
import math
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayflow.llm.common import bits_for, id_back, id_text, running_sum, stored, top_bits

LENGTH, VOCABULARY, END_ID = 2048, "byte_bpe_50k", 0
#: Groups of large lengths; lengths up to this part of a sequence are small.
GROUPS, SMALL_PART = 200, 0.4

_encoders: dict = {}


def encoder(vocabulary: str = VOCABULARY):
    """The vocabulary's encoder. The ranks are those of the tokenizers file of the same name, and give the same ids."""
    if vocabulary not in _encoders:
        import base64

        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[vocabulary] = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[vocabulary]


def added_tokens(vocabulary: str = VOCABULARY) -> dict[str, int]:
    """The added tokens of the tokenizers file, which it matches in texts before anything else."""
    if (vocabulary, "added") not in _encoders:
        import public_tokenizers

        with open(public_tokenizers.path(f"{vocabulary}.json"), encoding="utf-8") as f:
            _encoders[vocabulary, "added"] = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    return _encoders[vocabulary, "added"]


def ids_of(text: str, vocabulary: str = VOCABULARY) -> list[int]:
    """The text's ids, as the tokenizers file gives them."""
    enc, added = encoder(vocabulary), added_tokens(vocabulary)
    if not any(t in text for t in added):
        return enc.encode_ordinary(text)
    parts = re.split("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")", text)
    return [i for part in parts for i in ([added[part]] if part in added else enc.encode_ordinary(part))]


def cut(length: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole ones, after a shorter first one if need be."""
    if length <= most:
        return [(0, length)]
    first = length % most
    return ([(0, first)] if first else []) + [(s, most) for s in range(first, length, most)]


def pieces_of(docs: DataFrame, id_col: str, text_col: str, most: int, vocabulary: str) -> DataFrame:
    """Pieces ``(id, piece, start, length, ids_crc32)`` of the tokenized documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                out = []
                part = batch.iloc[at : at + 256]
                for doc, text in zip(part["id"], part["text"]):
                    ids = np.array([*ids_of(text, vocabulary), END_ID], "<u4")
                    out += [(doc, i, s, n, zlib.crc32(ids[s : s + n].tobytes())) for i, (s, n) in enumerate(cut(len(ids), most))]
                yield pd.DataFrame(out, columns=["id", "piece", "start", "length", "ids_crc32"])

    source = docs.select(id_text(id_col), F.coalesce(text_col, F.lit("")).alias("text"))
    return source.mapInPandas(run, "id string, piece int, start long, length long, ids_crc32 long")


class Plan:
    """Where runs of equally long pieces go: ``rows`` of (length, first rank, count, first sequence, offset)."""

    def __init__(self, most: int):
        self.most, self.rows, self.sequences = most, [], 0
        self.open: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free tokens -> runs of sequences
        self.free: list[int] = []

    def new(self, count: int) -> int:
        self.sequences += count
        return self.sequences - count

    def put(self, length: int, rank: int, count: int, sequence: int, offset: int) -> None:
        self.rows.append((length, rank, count, sequence, offset))

    def leave(self, free: int, sequence: int, count: int) -> None:
        if free and count:
            if not self.open[free]:
                bisect.insort(self.free, free)
            self.open[free].append((sequence, count))

    def take(self, free: int, most: int) -> tuple[int, int]:
        sequence, count = self.open[free].pop()
        if count > most:
            self.open[free].append((sequence + most, count - most))
        if not self.open[free]:
            self.free.remove(free)
        return sequence, min(count, most)

    def best_fit(self, length: int, rank: int, count: int) -> None:
        """Each piece to the fullest sequence that has room, else to a new one."""
        while count:
            i = bisect.bisect_left(self.free, length)
            if i == len(self.free):
                n = max(1, count // (self.most // length))
                self.leave(self.most, self.new(n), n)
                continue
            free = self.free[i]
            sequence, n = self.take(free, count)
            self.put(length, rank, n, sequence, self.most - free)
            self.leave(free - length, sequence, n)
            rank, count = rank + n, count - n


def inverted(matrix: np.ndarray) -> np.ndarray:
    """The inverse, by elimination with the largest pivot.

    Here and below no BLAS is used: its threads don't survive the fork that starts Spark's JVM, and calls in the driver would hang.
    """
    n = len(matrix)
    both = np.concatenate((matrix, np.eye(n)), axis=1)
    for i in range(n):
        best = i + int(np.abs(both[i:, i]).argmax())
        both[[i, best]] = both[[best, i]]
        both[i] /= both[i, i]
        factor = both[:, i].copy()
        factor[i] = 0
        both -= factor[:, None] * both[i]
    return both[:, n:]


def configurations(sizes: list[int], demand: list[int], most: int, rounds: int = 4000) -> list[tuple[np.ndarray, int]]:
    """Few sizes into sequences: the linear relaxation over configurations by column generation, rounded down.

    A revised simplex on the covering program; a new configuration is the knapsack of most dual value, found
    by the number of pieces it has. Ends when no configuration prices out.
    """
    k, s, d = len(sizes), np.array(sizes), np.array(demand, float)
    basis = np.diag([float(most // x) for x in sizes])
    inverse = inverted(basis)
    deepest = most // min(sizes)
    for step in range(rounds):
        if step % 50 == 49:
            inverse = inverted(basis)
        x = (inverse * d).sum(axis=1)
        dual = np.maximum(inverse.sum(axis=0), 0)
        value, chosen = np.zeros(most + 1), []
        for _ in range(deepest):
            best, pick = value.copy(), np.full(most + 1, -1)
            for i in np.flatnonzero(dual > 1e-12):
                cand = value[: most + 1 - s[i]] + dual[i]
                better = cand > best[s[i] :] + 1e-12
                best[s[i] :][better] = cand[better]
                pick[s[i] :][better] = i
            chosen.append(pick)
            if (pick < 0).all():
                break
            value = best
        if value[most] <= 1 + 1e-7:
            break
        column, room = np.zeros(k), most
        for pick in reversed(chosen):
            if pick[room] >= 0:
                column[pick[room]] += 1
                room -= s[pick[room]]
        along = (inverse * column).sum(axis=1)
        ok = along > 1e-9
        if not ok.any():
            break
        ratio = np.where(ok, np.maximum(x, 0) / np.where(ok, along, 1), np.inf)
        out = int(ratio.argmin())
        basis[:, out] = column
        row = inverse[out] / along[out]
        inverse = inverse - along[:, None] * row
        inverse[out] = row
    x = (inverted(basis) * d).sum(axis=1)
    return [(basis[:, j].astype(int), math.floor(x[j] + 1e-6)) for j in range(k) if x[j] >= 1 - 1e-6]


def plan(histogram: dict[int, int], most: int = LENGTH, groups: int = GROUPS, small_part: float = SMALL_PART) -> Plan:
    """The packing of ``histogram[length]`` pieces of each length from 1 to ``most``."""
    p = Plan(most)
    if histogram.get(most):
        p.put(most, 0, histogram[most], p.new(histogram[most]), 0)
    large = [(n, c) for n, c in sorted(histogram.items(), reverse=True) if most * small_part < n < most]
    total = sum(c for _, c in large)
    # equal-cardinality groups of the lengths in descending order; each holds runs [length, rank, count]
    grouped: list[list[list[int]]] = []
    each, room = max(1, math.ceil(total / groups)), 0
    for n, c in large:
        rank = 0
        while rank < c:
            if not room:
                grouped.append([])
                room = each
            t = min(room, c - rank)
            grouped[-1].append([n, rank, t])
            rank, room = rank + t, room - t
    sizes = [g[0][0] for g in grouped]  # every length counts as the largest of its group
    merged: dict[int, list[list[int]]] = {}
    for size, g in zip(sizes, grouped):
        merged.setdefault(size, []).extend(g)
    sizes = list(merged)
    left = {z: sum(r[2] for r in merged[z]) for z in sizes}
    for config, count in configurations(sizes, [left[z] for z in sizes], most) if sizes else []:
        slots = [z for z, a in zip(sizes, config) for _ in range(a)]
        for z in set(slots):
            count = min(count, left[z] // slots.count(z))
        if not count:
            continue
        first, runs = p.new(count), []
        for z in slots:
            need, mine = count, []
            while need:
                run = merged[z][0]
                t = min(need, run[2])
                mine.append((run[0], run[1], t))
                run[1], run[2], need = run[1] + t, run[2] - t, need - t
                if not run[2]:
                    merged[z].pop(0)
            left[z] -= count
            runs.append(mine)
        # actual documents take the places of rounded ones: between two edges all lengths are constant
        edges = sorted({0, count} | {e for mine in runs for e in np.cumsum([t for *_, t in mine]).tolist()})
        at = [[0, 0] for _ in runs]  # of each slot: run, pieces of it already placed
        for a, b in zip(edges, edges[1:]):
            offset = 0
            for mine, now in zip(runs, at):
                n, rank, t = mine[now[0]]
                p.put(n, rank + now[1], b - a, first + a, offset)
                offset += n
                now[1] += b - a
                if now[1] == t:
                    now[0], now[1] = now[0] + 1, 0
            p.leave(most - offset, first + a, b - a)
    rest = [tuple(r) for runs in merged.values() for r in runs]
    rest += [(n, 0, c) for n, c in histogram.items() if n <= most * small_part and n < most]
    for n, rank, c in sorted(rest, key=lambda r: (-r[0], r[1])):
        p.best_fit(n, rank, c)
    return p


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = LENGTH, vocabulary: str = VOCABULARY, seed: int = 29) -> DataFrame:
    """One row per piece: ``(id, piece, start, length, ids_crc32, sequence_id, offset)``.

    A document is its ids and an end id; only documents longer than ``most`` are cut. The driver
    gets the histogram of lengths (``most`` rows) and sends back the plan, a few thousand
    runs whatever the corpus. Ranks among pieces of one length are gapless and are computed in runs by hash. Null
    texts are documents of one token; null or repeated ids are packed like others; an empty table
    gives an empty result; other columns are not read.
    """
    pieces = stored(pieces_of(docs, id_col, text_col, most, vocabulary), "pieces")
    histogram = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").count().collect()}
    made = np.array(sorted(plan(histogram, most).rows) or np.zeros((0, 5)), dtype=np.int64)
    starts = made[:, 0] << 44 | made[:, 1]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            i = np.searchsorted(starts, b["length"].to_numpy(np.int64) << 44 | b["rank"].to_numpy(np.int64), side="right") - 1
            b["sequence_id"] = made[i, 3] + b["rank"].to_numpy(np.int64) - made[i, 1]
            b["offset"] = made[i, 4]
            yield b.drop(columns="rank")

    n = sum(histogram.values())
    key = F.xxhash64(F.lit(seed), "id", "piece", "ids_crc32")
    ranked = running_sum(
        pieces.withColumns({"__run": top_bits(key, bits_for(n)), "__one": F.lit(1)}), "length", "__run", [F.col("id").asc_nulls_first(), "piece", "ids_crc32"], "__one", "rank"
    ).drop("__run", "__one")
    ranked = ranked.select("id", "piece", "start", "length", "ids_crc32", F.col("rank").cast("long"))
    schema = "id string, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return id_back(ranked.mapInPandas(place, schema), docs, id_col)


def op10_linear_grouping_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
