"""Near-duplicate documents by Order MinHash, verified by banded alignment."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayflow.llm.common import WORD, discard, doc_key, few, id_text, stored
from assayflow.llm.graph import BLOCK, linked_roots

#: Words of a shingle; least similarity; minima kept in order for each hash; hashes of a band; bands.
SHINGLE, SIMILARITY, ORDERED, ROWS, BANDS = 5, 0.8, 2, 2, 16
#: Places of a text's counts of words by hash, which rule out pairs of a crowded bucket; places of their sums, which are looked at first.
BINS, SUMS = 2048, 256
#: Pairs of a member in a crowded bucket that are compared before links are followed again; all in the last round.
ROUNDS = (8, 64, None)
#: Shingles hashed at a time.
CHUNK = 1 << 15

_word = re.compile(WORD)


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash for each word of the case-folded text."""
    seen: dict[str, int] = {}
    out = []
    for w in _word.findall(text.casefold()):
        h = seen.get(w)
        if h is None:
            h = seen[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
        out.append(h)
    return np.array(out, np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def labelled_shingles(words: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Hashes of the k-word shingles in text order, each labelled with how often it occurred before.

    A text of fewer words than k has one shingle, all its words; an empty text has none.
    """
    n = len(words) - k + 1
    if n < 1:
        words, n, k = words, min(1, len(words)), len(words)
    h = np.full(n, 0x9E3779B97F4A7C15, np.uint64)
    for i in range(k):
        h = _mix(h + words[i : i + n])
    order = np.argsort(h, kind="stable")
    ranked = h[order]
    first = np.ones(n, bool)
    first[1:] = ranked[1:] != ranked[:-1]
    starts = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    label = np.empty(n, np.uint64)
    label[order] = (np.arange(n) - starts).astype(np.uint64)
    return _mix(h + label * np.uint64(0xD6E8FEB86659FD93))


def sketch(shingles: np.ndarray, hashes: int, ordered: int = ORDERED) -> np.ndarray:
    """Order MinHash: for each hash, its ``ordered`` smallest shingles in text order, as one 64-bit value.

    Chunks of a long text are reduced one after another, so memory doesn't grow with its length. Texts with fewer
    shingles than ``ordered`` use all they have.
    """
    seeds = _mix(np.arange(1, hashes + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    best = np.zeros((hashes, 0), np.uint64)
    place = np.zeros((hashes, 0), np.int64)
    for at in range(0, len(shingles), CHUNK):
        part = shingles[at : at + CHUNK]
        value = part[None, :] * seeds[:, None]
        value ^= value >> np.uint64(29)
        lines = np.arange(hashes)
        for _ in range(min(ordered, len(part))):
            near = value.argmin(axis=1)
            best = np.concatenate((best, value[lines, near][:, None]), axis=1)
            place = np.concatenate((place, near[:, None] + at), axis=1)
            value[lines, near] = np.iinfo(np.uint64).max
        if best.shape[1] > ordered:
            near = np.argsort(best, axis=1)[:, :ordered]
            best, place = np.take_along_axis(best, near, 1), np.take_along_axis(place, near, 1)
    in_text = np.argsort(place, axis=1)
    best = np.take_along_axis(best, in_text, 1)
    out = np.zeros(hashes, np.uint64)
    for i in range(best.shape[1]):
        out = _mix(out * np.uint64(3) + best[:, i])
    return out


def band_keys(words: np.ndarray, bands: int = BANDS, rows: int = ROWS, shingle: int = SHINGLE) -> np.ndarray:
    """A 64-bit key for each band of a text; none for a text without words."""
    shingles = labelled_shingles(words, shingle)
    if not len(shingles):
        return np.zeros(0, np.int64)
    values = sketch(shingles, bands * rows).reshape(bands, rows)
    out = np.arange(bands, dtype=np.uint64)
    for i in range(rows):
        out = _mix(out * np.uint64(5) + values[:, i])
    return out.view(np.int64)


def edit_distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Word edit distance, or ``most + 1`` if it is larger: bit-parallel alignment in a band of 2 * most + 1 diagonals.

    Equal starts and ends are set aside. The column's vertical differences are two bit vectors over
    the band; the band moves down a row with each word of ``b``.
    """
    if abs(len(a) - len(b)) > most:
        return most + 1
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    start = int(differ[0]) if len(differ) else n
    a, b = a[start:], b[start:]
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[::-1][:n] != b[::-1][:n])
    end = int(differ[0]) if len(differ) else n
    a, b = a[: len(a) - end], b[: len(b) - end]
    if not len(a) or not len(b):
        return max(len(a), len(b))
    if len(a) < len(b):
        a, b = b, a
    rows, columns = len(a), len(b)
    most_here = min(most, rows)
    width = 2 * most_here + 1
    full = (1 << width) - 1
    where: dict[int, int] = {}  # bit i + most_here: word i of a
    for i, w in enumerate(a.tolist()):
        where[w] = where.get(w, 0) | 1 << (i + most_here)
    top = 1 << (width - 1)
    # in column j, bit i stands for row i - most_here + j + 1; above row 1 differences are 0
    up, down = full >> most_here << most_here, 0
    score = most_here  # of the band's lower edge, followed along its diagonal
    beyond = most_here + columns - rows  # rows of the lower edge below the last row of a, in the end
    for j, w in enumerate(b.tolist()):
        match = (where.get(w, 0) >> j) & full
        diagonal = ((((match & up) + up) ^ up) | match | down) & full
        right = down | (full & ~(diagonal | up))
        left = diagonal & up
        if not diagonal & top:
            score += 1
            if score - beyond > most:
                return most + 1
        shifted = diagonal >> 1
        up = left | (full & ~(shifted | right))
        down = shifted & right
    for i in range(beyond):
        bit = 1 << (width - 2 - i)
        score -= 1 if up & bit else -1 if down & bit else 0
    return score if score <= most else most + 1


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether 1 - edits / longer length is at least ``least``."""
    longer = max(len(a), len(b))
    most = int((1 - least) * longer + 1e-9)
    return edit_distance(a, b, most) <= most


def _words_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for at in range(0, len(batch), 256):
            part = batch.iloc[at : at + 256]
            same, bands = [], []
            for text in part["text"]:
                words = word_hashes(text)
                same.append(xxhash.xxh3_128_digest(words.tobytes()))
                bands.append(band_keys(words).tolist())
            yield part.drop(columns="text").assign(same=same, bands=bands)


def verified(pairs: DataFrame, texts: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The pairs ``(a, b)`` whose texts, in ``(node, text)``, are similar. The member's text comes first, a hub's last."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hub, hub_words, keep = None, None, np.zeros(len(batch), bool)
            for i, (a, x, y) in enumerate(zip(batch["a"], batch["x"], batch["y"])):
                if a != hub:
                    hub, hub_words = a, word_hashes(x)
                keep[i] = similar(hub_words, word_hashes(y), least)
            yield batch.loc[keep, ["a", "b"]]

    own = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
    both = own.join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a")
    return both.select("a", "b", "x", "y").mapInPandas(run, "a long, b long")


def bag(words: np.ndarray) -> bytes:
    """How many words have each hash modulo ``BINS``, in bytes (255 for more)."""
    return np.minimum(np.bincount((words % np.uint64(BINS)).astype(np.int64), minlength=BINS), 255).astype(np.uint8).tobytes()


def least_edits(bags: np.ndarray, lengths: np.ndarray, one: np.ndarray, n: int) -> np.ndarray:
    """At least so many edits lie between texts, by their bags and numbers of words, and one text.

    An edit takes a word from one text's surplus at most, and one from the other's; the larger surplus is half the sum of the
    bags' differences and the lengths' difference.
    """
    return (np.abs(bags - one).sum(axis=1, dtype=np.int64) + np.abs(lengths - n) + 1) // 2


def most_edits(lengths: np.ndarray, n: int, least: float = SIMILARITY) -> np.ndarray:
    return ((1 - least) * np.maximum(lengths, n) + 1e-9).astype(np.int64)


def may_be_similar(bags: np.ndarray, lengths: np.ndarray, one: np.ndarray, n: int, least: float = SIMILARITY) -> np.ndarray:
    """Which texts, by their bags and numbers of words, can be similar to one text; never false for a similar pair."""
    return least_edits(bags, lengths, one, n) <= most_edits(lengths, n, least)


def near_bags(crowded: DataFrame, texts: DataFrame, least: float = SIMILARITY, most: int | None = None) -> DataFrame:
    """The pairs of :func:`graph.pairs_apart` without those that the words' counts rule out; a task compares two blocks.

    ``most``: only so many pairs of a member in a bucket (one for each block at least), those of the least edits by their counts,
    and a column ``cut``: whether it has more.
    """

    def bags_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words = [word_hashes(text) for text in batch["text"]]
            yield pd.DataFrame({"node": batch["node"], "bag": [bag(w) for w in words], "words": [len(w) for w in words]})

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        first, second = (group[group["own"] == group[x].iloc[0]] for x in "ij")
        within = group["i"].iloc[0] == group["j"].iloc[0]
        each = None if most is None else max(1, most // int(group["blocks"].iloc[0]))
        ids, roots, lengths = (second[c].to_numpy(np.int64) for c in ("id", "root", "words"))
        unpacked = lambda rows: np.frombuffer(b"".join(rows), np.uint8).reshape(-1, BINS).astype(np.int16)
        summed = lambda bags: bags.reshape(-1, BINS // SUMS, SUMS).sum(axis=1, dtype=np.int16)
        bags, own = unpacked(second["bag"]), unpacked(first["bag"])
        sums, own_sums = summed(bags), summed(own)
        out, cut = [np.zeros((0, 2), np.int64)], [np.zeros(0, bool)]
        for k, (id_, root, n) in enumerate(zip(first["id"], first["root"], first["words"])):
            other = roots != root
            if within and each is None:
                other &= ids > id_
            at = np.flatnonzero(other)
            at = at[may_be_similar(sums[at], lengths[at], own_sums[k], n, least)]
            edits = least_edits(bags[at], lengths[at], own[k], n)
            may = edits <= most_edits(lengths[at], n, least)
            at, edits = at[may], edits[may]
            more = each is not None and len(at) > each
            if more:
                at = at[np.argsort(edits, kind="stable")[:each]]
            out.append(np.stack((np.minimum(ids[at], id_), np.maximum(ids[at], id_)), axis=1))
            cut.append(np.full(len(at), more))
        pairs = pd.DataFrame(np.concatenate(out), columns=["a", "b"])
        return pairs if most is None else pairs.assign(cut=np.concatenate(cut))

    def groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Runs of rows of the same key and blocks, which may go on in the next batch."""
        kept: list[pd.DataFrame] = []
        for batch in batches:
            for at, part in batch.groupby(["key", "i", "j"], sort=False):
                if kept and at != tuple(kept[-1].iloc[-1][["key", "i", "j"]]):
                    yield compare(pd.concat(kept))
                    kept.clear()
                kept.append(part)
        if kept:
            yield compare(pd.concat(kept))

    some = stored(crowded.select(F.col("id").alias("node")).distinct(), "crowded")
    bags = stored(texts.join(few(some), "node", "left_semi").mapInPandas(bags_of, "node long, bag binary, words long"), "bags")
    dealt = crowded.withColumn("blocks", F.ceil(F.col("n") / BLOCK))
    dealt = dealt.withColumns({"own": F.pmod(F.xxhash64("id"), "blocks"), "other": F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))})
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "root", "blocks")
    dealt = dealt.join(bags.withColumnRenamed("node", "id"), "id").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInPandas(groups, "a long, b long" if most is None else "a long, b long, cut boolean")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """One row per document: ``(id, key, class_id, class_size, kept)``, key as in :func:`common.doc_key`; see :func:`near_duplicates`."""
    source = docs.select(id_text(id_col), doc_key(id_col, text_col).alias("key"), F.coalesce(text_col, F.lit("")).alias("text"))
    flat = source.select("id", F.col("key.a").alias("ka"), F.col("key.b").alias("kb"), "text", F.monotonically_increasing_id().alias("row"))
    sketched = flat.mapInPandas(_words_of, "id string, ka long, kb long, row long, same binary, bands array<long>")
    sketched = stored(sketched.select(F.col("id").cast(docs.schema[id_col].dataType).alias("id"), F.struct(F.col("ka").alias("a"), F.col("kb").alias("b")).alias("key"), "row", "same", "bands"), "sketches")

    # a node for each sequence of words: its first row and how many rows it has
    best = F.struct(F.col("id").isNull().alias("none"), "id", "row", "key")
    nodes = sketched.groupBy("same").agg(F.min(best).alias("first"), F.count("*").alias("n"), F.any_value("bands").alias("bands"))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    members = nodes.select(F.explode("bands").alias("key"), F.col("node").alias("id"))
    texts: list[DataFrame] = []

    def gather(some: DataFrame) -> None:
        """Texts of the nodes that share a bucket with another, read again from the source."""
        wanted = stored(some.join(nodes, some["id"] == nodes["node"]).select("node", "first.key"), "wanted")
        got = stored(source.select("key", "text").join(few(wanted), "key").select("node", "text"), "texts")
        if got.count() > some.count():  # rows equal in id and text
            got = stored(got.dropDuplicates(["node"]), "texts")
        texts.append(got)
        discard(wanted)

    roots = linked_roots(members, lambda pairs: verified(pairs, texts[0], least), gather, lambda crowded, most: near_bags(crowded, texts[0], least, most), ROUNDS)
    rooted = stored(nodes.join(roots, nodes["node"] == roots["id"], "left").select("same", "first", "n", F.coalesce("root", "node").alias("root")), "rooted")
    groups = rooted.groupBy("root").agg(F.min("first").alias("best"), F.sum("n").alias("class_size"))
    named = stored(rooted.join(groups, "root").select("same", F.col("best.id").alias("class_id"), "class_size", F.col("best.row").alias("best_row")), "named")
    discard(nodes, roots, rooted, *texts)
    return sketched.join(named, "same").select(F.col("id").alias(id_col), "key", "class_id", "class_size", (F.col("row") == F.col("best_row")).alias("kept"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """One row per document: ``(id, class_id, class_size, kept)``.

    ``class_id`` is the smallest id of the documents that verified links connect to this one (its own if
    none); ``kept`` marks one row of each class, that of the smallest id. Documents with equal words, ignoring
    case, are one node from the start; so are documents without words. Nodes whose sketches agree in
    a band are candidates, buckets are linked by :func:`graph.linked_roots`, and a link holds if the
    word edit similarity is at least ``least``. All pairs of a bucket, however crowded, are
    compared unless links connect them already or their words' counts rule them out. Null ids come last; null texts count as empty; an
    empty table gives an empty result; other columns are not read.
    """
    return near_classes(docs, id_col, text_col, least).drop("key")


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class, with all its columns. Rows equal in id and text leave one of them."""
    found = stored(near_classes(docs, id_col, text_col), "classes")
    kept = found.where("kept").select("key")
    gone = found.where("not kept").select("key").distinct()
    lost = stored(gone.join(kept, "key", "left_anti"), "lost")  # no row of this id and text stays
    twice = stored(gone.join(kept, "key", "left_semi"), "twice")  # one of several equal rows stays
    left = docs.withColumn("__key", doc_key(id_col, text_col)).join(few(lost.withColumnRenamed("key", "__key")), "__key", "left_anti")
    if twice.isEmpty():
        return left.drop("__key")
    again = few(twice.withColumnRenamed("key", "__key"))
    return left.join(again, "__key", "left_anti").unionByName(left.join(again, "__key", "left_semi").dropDuplicates(["__key"])).drop("__key")


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
