"""Fuzzy line deduplication: SimHash, pigeonhole blocks, edit similarity, connected groups (DataFrame only).

The SimHash has ``BLOCKS`` blocks, and each word votes in one block only, by its hash. A changed word so touches two
blocks at most, the one it leaves and the one it comes to, however short the line is; the other blocks stay equal to the bit.
With votes of all words in all blocks, one changed letter would move bits in every block of a short line.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayflow.llm.common import discard, doc_key, few, let, stored
from assayflow.llm.graph import linked_roots, pairs_apart

#: Blocks of the SimHash, and bits of a block's votes in each byte (so 8 times as many in all).
BLOCKS, BYTE_BITS = 5, 2
#: Blocks that two lines share to be compared; lines of up to ``SHORT`` words share one more and have as many keys.
SHARED, SHORT = 2, 12
#: Least part of a line's words that the blocks of a key hold (or ``ENOUGH`` words), by the number of blocks.
LEAST_PART, ENOUGH = {2: 0.2, 3: 0.3}, 12
#: Least edit similarity.
SIMILARITY = 0.8
#: Up to so many characters, lines are aligned as they are; what differs between equal words at the ends is aligned word by word beyond.
SHORT_LINE, LONG_LINE = 150, 2000
#: Scripts without spaces between words: each character is a word. One range holds all of them, so most characters are ruled out by one comparison.
UNSPACED = r"([\u0E00-\x{3FFFF}&&[\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u9FFF\uF900-\uFAFF\x{20000}-\x{3FFFF}]])"
#: First bytes of the decimal digits of those scripts in UTF-8; they have no cased letters.
UNSPACED_DIGITS = (b"\xe0", b"\xe1")


def _masked(low: Column) -> Column:
    """Cased letters and decimal digits as they are, a space for each other character."""
    same = F.lit(None).cast("string")
    return F.mask(low, same, same, same, F.lit(" "))


def _words_of(low: Column, masked: Column) -> Column:
    """:func:`line_words` of a line in lower case. Masking does where it took no character of several bytes, so no letter or mark, and none is of a script without spaces."""
    size, spaced = F.octet_length(low), reduce(Column.__and__, [~F.contains(low.cast("binary"), F.lit(x)) for x in UNSPACED_DIGITS])
    other = F.split(F.regexp_replace(low, UNSPACED, " $1 "), r"[^\p{L}\p{M}\p{N}]+")
    return F.array_remove(F.when((size == F.length(low)) | ((size == F.octet_length(masked)) & spaced), F.split(masked, " ")).otherwise(other), "")


def line_words(line: Column) -> Column:
    """The runs of letters, marks and digits, in lower case: what counts of a line. Punctuation and spacing don't."""
    return _words_of(F.lower(line), _masked(F.lower(line)))


def normalised_line(line: Column) -> Column:
    return F.array_join(line_words(line), " ")


def _long(x: int) -> Column:
    return F.lit(x - (1 << 64) if x >= 1 << 63 else x).cast("long")


def _votes(hashes: Column, width: int) -> Column:
    """The bits that more than half of the words have, ``BYTE_BITS`` in each byte of a long.

    Bits are counted several at a time, in lanes of ``width`` bits of a long; a lane holds up to 2**(width - 2) - 1 words.
    The bits found don't depend on the width.
    """
    ones = sum(1 << (width * i) for i in range(64 // width))
    fill = (F.lit((1 << (width - 2)) - 1) - F.shiftright(F.size(hashes), 1)).cast("long") * _long(ones)
    out = _long(0)
    for at in (8 * byte + bit for byte in range(width // 8) for bit in range(BYTE_BITS)):
        count = F.aggregate(hashes, _long(0), lambda a, x: a + F.shiftrightunsigned(x, at).bitwiseAND(_long(ones)))  # noqa: B023
        out = out.bitwiseOR(F.shiftrightunsigned((count + fill).bitwiseAND(_long(ones << (width - 2))), width - 2 - at))
    return out


def _counted(hashes: Column, of: Callable[[Column], Column]) -> Column:
    """The sum of ``of`` each hash, less 2**63: counting starts at the least long, so no sum of up to 2**64 - 1 overflows."""
    return F.aggregate(hashes, _long(1 << 63), lambda a, x: a + of(x))


def _few_counts(hashes: Column) -> Column:
    """All bits that vote counted at once, in lanes of 4 bits: 9 times a byte's two lowest bits holds them 4 bits apart."""
    return _counted(hashes, lambda x: (x.bitwiseAND(_long(sum(3 << (8 * i) for i in range(8)))) * 9).bitwiseAND(_long(sum(1 << (4 * i) for i in range(16)))))


def _few_bits(counts: Column, n: Column) -> Column:
    """The bits of :func:`_votes` from :func:`_few_counts` of n words."""
    ones, every = sum(1 << (8 * i) for i in range(8)), sum(1 << (4 * i) for i in range(16))
    full = (counts + (F.lit(7) - F.shiftright(n, 1)).cast("long") * _long(every)).bitwiseXOR(_long(1 << 63))
    return F.shiftrightunsigned(full, 3).bitwiseAND(_long(ones)).bitwiseOR(F.shiftrightunsigned(full, 6).bitwiseAND(_long(ones << 1)))


def _few_votes(hashes: Column) -> Column:
    """:func:`_votes` of up to 15 words."""
    return _few_bits(_few_counts(hashes), F.size(hashes))


def _byte_counts(hashes: Column, bit: int) -> Column:
    """The bits at ``bit`` of each byte counted, in lanes of 8 bits."""
    return _counted(hashes, lambda x: (F.shiftrightunsigned(x, bit) if bit else x).bitwiseAND(_long(sum(1 << (8 * i) for i in range(8)))))


def _byte_bits(counts: list[Column], n: Column) -> Column:
    """The bits of :func:`_votes` from :func:`_byte_counts` of n words, up to 255."""
    ones, out = sum(1 << (8 * i) for i in range(8)), _long(0)
    fill = (F.lit(127) - F.shiftright(n, 1)).cast("long") * _long(ones)
    for bit, count in enumerate(counts):
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned((count + fill).bitwiseXOR(_long(1 << 63)), 7).bitwiseAND(_long(ones)), bit))
    return out


def word_codes(words: Column) -> Column:
    """For each word 60 bits of its hash, which hold all that vote, below the number of its block. Never null, which :func:`ordered_codes` sorts faster."""
    block = lambda h: F.coalesce(F.pmod(h, _long(BLOCKS)), _long(0))
    return F.transform(F.transform(words, lambda w: F.xxhash64(w)), lambda h: h.bitwiseAND(_long((1 << 60) - 1)).bitwiseOR(F.shiftleft(block(h), 60)))


def ordered_codes(codes: Column) -> Column:
    """Each code once, in order, so those of a block stand together, after the block's mark; a mark ends the last block."""
    return F.sort_array(F.concat(F.array_distinct(codes), F.array(*[_long(b << 60) for b in range(BLOCKS + 1)])))


def block_codes(ordered: Column) -> list[Column]:
    """The codes of each block."""
    at = [F.array_position(ordered, _long(b << 60)).cast("int") for b in range(BLOCKS)] + [F.size(ordered)]
    return [F.slice(ordered, at[b] + 1, at[b + 1] - at[b] - 1) for b in range(BLOCKS)]


def block_counts(own: Column) -> list[Column]:
    """What :func:`block_bits` reads: votes counted (of over 255 words, the bits), and those for each byte's second bit where they are counted apart."""
    n = F.size(own)
    first = F.when(n <= 15, _few_counts(own)).when(n <= 255, _byte_counts(own, 0)).when(n <= 16383, _votes(own, 16)).otherwise(_votes(own, 32))
    return [first, F.when((n > 15) & (n <= 255), _byte_counts(own, 1)).otherwise(_long(0))]


def block_bits(n: Column, counts: list[Column]) -> Column:
    """A block's bits, and in the bits that are free in its first byte the number of its words (63 at most)."""
    votes = F.when(n <= 15, _few_bits(counts[0], n)).when(n <= 255, _byte_bits(counts, n)).otherwise(counts[0])
    return votes.bitwiseOR((F.least(n, F.lit(63)) * (1 << BYTE_BITS)).cast("long"))


def simhash(words: Column) -> Column:
    """An array of ``BLOCKS`` longs: each block's :func:`block_bits`.

    A word votes once, however often the line has it: else the commonest word would decide each block of a long line.
    """
    return let(ordered_codes(word_codes(words)), lambda ordered: F.array(*[let(own, lambda x: block_bits(F.size(x), block_counts(x))) for own in block_codes(ordered)]))


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc, id, line, a, b, chars, words, s0, s1, ...)`` for each line: two hashes of the normal form, its length, its number of words, its SimHash's blocks.

    The steps of :func:`simhash` are columns here, one after another: what feeds a lambda is interpreted, what feeds a column is compiled.
    """
    # hashes of the whole text are made before the lines are: else they would be made for each line
    whole = docs.where(F.col(text_col).isNotNull()).select(doc_key(id_col, text_col).alias("doc"), F.col(id_col).alias("id"), F.split(text_col, "\n").alias("raw"))
    raw = whole.select("doc", "id", F.posexplode("raw").alias("line", "raw"))
    own = [f"s{i}" for i in range(BLOCKS)]
    found = raw.select("doc", "id", "line", F.lower("raw").alias("low"))
    found = found.select("doc", "id", "line", "low", _masked(F.col("low")).alias("masked"))
    found = found.select("doc", "id", "line", _words_of(F.col("low"), F.col("masked")).alias("all"))
    found = found.select("doc", "id", "line", F.size("all").alias("words"), F.array_join("all", " ").alias("norm"), word_codes(F.col("all")).alias("codes"))
    found = found.select("doc", "id", "line", F.xxhash64("norm").alias("a"), F.xxhash64(F.lit("line"), "norm").alias("b"), F.length("norm").alias("chars"), "words", ordered_codes(F.col("codes")).alias("codes"))
    found = found.select(*found.columns[:-1], *[c.alias(x) for c, x in zip(block_codes(F.col("codes")), own)])
    counts = [c.alias(f"{x}_{i}") for x in own for i, c in enumerate(block_counts(F.col(x)))]
    found = found.select(*found.columns[:-BLOCKS], *[F.size(x).alias(x) for x in own], *counts)
    return found.select(*found.columns[: -3 * BLOCKS], *[block_bits(F.col(x), [F.col(f"{x}_{i}") for i in range(2)]).alias(x) for x in own])


def block_keys(lines: DataFrame) -> DataFrame:
    """``(key, id)`` of lines ``(row, words, s0, s1, ...)``: a 64-bit key for each choice of blocks that hold enough words.

    A choice is a number with a bit for each block. It is a row before its key is made, so that the code for keys stays short enough to be compiled.
    """
    choices = {n: F.array(*[F.lit(sum(1 << b for b in some)) for some in combinations(range(BLOCKS), n)]) for n in (SHARED, SHARED + 1)}
    chosen = F.when(F.col("words") < SHORT, choices[SHARED + 1]).when(F.col("words") > SHORT, choices[SHARED]).otherwise(F.concat(choices[SHARED], choices[SHARED + 1]))
    each = lines.select(F.col("row").alias("id"), "words", *(f"s{b}" for b in range(BLOCKS)), F.explode(chosen).alias("some"))
    part = [F.when(F.col("some").bitwiseAND(1 << b) != 0, F.col(f"s{b}")).otherwise(_long(0)) for b in range(BLOCKS)]
    held = sum((F.shiftright(x.bitwiseAND(_long(255)), BYTE_BITS) for x in part), F.lit(0))
    least = F.when(F.bit_count("some") == SHARED, F.ceil(F.col("words") * LEAST_PART[SHARED])).otherwise(F.ceil(F.col("words") * LEAST_PART[SHARED + 1]))
    return each.where(held >= F.least(least, F.lit(ENOUGH))).select(F.xxhash64("some", *part).alias("key"), "id")


def as_characters(words: Column) -> Column:
    """One character for each word (one of 20,000, by hash)."""
    code = lambda w: F.lpad(F.hex(F.pmod(F.xxhash64(w), F.lit(20_000)) + 0x4E00), 4, "0")
    return F.decode(F.unhex(F.array_join(F.transform(words, code), "")), "UTF-16BE")


def edit_similar(x: Column, y: Column, least: float = SIMILARITY) -> Column:
    """Whether 1 - edits / longer length is at least ``least``, for two normal forms.

    Edits are counted in characters. Equal words at both ends are set aside, which changes no distance; if the words between them
    are as many on both sides and those that differ are short enough, no alignment is needed. Where what lies between is over
    ``LONG_LINE`` characters long, edits and lengths are counted in words.
    """

    def between(words, first, last):
        return F.slice(words, first, F.size(words) - last - first + 1)

    def near(a, b, most):
        return F.when(F.abs(F.length(a) - F.length(b)) > most, F.lit(False)).otherwise(F.call_function("levenshtein", a, b, most) >= 0)

    def middle(v):
        short = F.least(F.size(v["x"]), F.size(v["y"]))
        differ = lambda p, q: F.coalesce(F.array_position(F.zip_with(F.slice(p, 1, short), F.slice(q, 1, short), lambda i, j: i != j), True), F.lit(0)).cast("int")
        first = let(differ(v["x"], v["y"]), lambda at: F.when(at == 0, short + 1).otherwise(at))
        last = let(differ(F.reverse(v["x"]), F.reverse(v["y"])), lambda at: F.when(at == 0, short).otherwise(at - 1))
        return let(first, lambda f: let(last, lambda e: let(F.least(e, short - f + 1), lambda e: F.struct(between(v["x"], f, e).alias("x"), between(v["y"], f, e).alias("y")))))

    def whole(v):
        most = F.floor(F.greatest(F.length(x), F.length(y)) * (1 - least) + 1e-9).cast("int")
        most_words = F.floor(F.greatest(F.size(v["x"]), F.size(v["y"])) * (1 - least) + 1e-9).cast("int")

        def aligned(m):
            differing = F.aggregate(F.zip_with(m["x"], m["y"], lambda i, j: F.when(i == j, 0).otherwise(F.greatest(F.length(i), F.length(j)))), F.lit(0), lambda a, n: a + n)
            letters = F.struct(F.array_join(m["x"], " ").alias("x"), F.array_join(m["y"], " ").alias("y"))
            by_letters = let(letters, lambda t: F.when(F.greatest(F.length(t["x"]), F.length(t["y"])) <= LONG_LINE, near(t["x"], t["y"], most)).otherwise(near(as_characters(m["x"]), as_characters(m["y"]), most_words)))
            return F.when((F.size(m["x"]) == F.size(m["y"])) & (differing <= most), F.lit(True)).otherwise(by_letters)

        return F.when(F.abs(F.length(x) - F.length(y)) > most, F.lit(False)).otherwise(let(middle(v), aligned))

    longer = F.greatest(F.length(x), F.length(y))
    by_words = let(F.struct(F.split(x, " ").alias("x"), F.split(y, " ").alias("y")), whole)
    return F.when(longer <= SHORT_LINE, near(x, y, F.floor(longer * (1 - least) + 1e-9).cast("int"))).otherwise(by_words)


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """The lines that go: ``(doc, line, keep_id, keep_line)``; ``doc`` is :func:`doc_key`, lines count from 0."""
    found = stored(lines_of(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "lines", hashes=True)
    same = [F.max(c).alias(c) for c in ("words", "chars", *(f"s{i}" for i in range(BLOCKS)))]
    distinct = stored(found.where("words > 0").groupBy("a", "b").agg(F.min("row").alias("row"), F.count("*").alias("n"), *same), "distinct", hashes=True)
    members = block_keys(distinct)
    chars = distinct.select(F.col("row").alias("id"), "chars")

    texts: list[DataFrame] = []

    def gather(some: DataFrame) -> None:
        """Texts of the lines that share a key with another: documents by key, then their lines by number."""
        wanted = found.select("doc", "line", "row").join(few(some.withColumnRenamed("id", "row")), "row")
        by_doc = wanted.groupBy("doc").agg(F.collect_list(F.struct("row", "line")).alias("wanted"))
        by_doc = stored(by_doc, "wanted")
        here = docs.where(F.col(text_col).isNotNull()).select(doc_key(id_col, text_col).alias("doc"), F.col(text_col).alias("text")).join(few(by_doc), "doc")
        lines = here.select(F.split("text", "\n").alias("raw"), "wanted").select("raw", F.explode("wanted").alias("w")).select("w.row", normalised_line(F.element_at("raw", F.col("w.line") + 1)).alias("norm"))
        got = stored(lines, "line-texts")
        if got.count() > some.count():  # rows equal in id and text
            got = stored(got.dropDuplicates(["row"]), "line-texts")
        texts.append(got)
        discard(by_doc)

    def verify(pairs: DataFrame) -> DataFrame:
        one, two = (texts[0].select(F.col("row").alias(n), F.col("norm").alias(t)) for n, t in (("b", "y"), ("a", "x")))
        both = pairs.join(one, "b").join(two, "a")
        return both.where(edit_similar(F.col("x"), F.col("y"), least)).select("a", "b")

    def apart(crowded: DataFrame, most: int | None) -> DataFrame:
        """Pairs of still separate lines whose lengths allow them to be similar."""
        return pairs_apart(crowded.join(chars, "id"), lambda one, two: F.abs(one["chars"] - two["chars"]) <= F.floor(F.greatest(one["chars"], two["chars"]) * (1 - least) + 1e-9), ["chars"])

    roots = linked_roots(members, verify, gather, apart)
    classed = stored(distinct.join(few(roots), distinct["row"] == roots["id"], "left").select("a", "b", "n", F.coalesce("root", "row").alias("root")), "classed")
    several = stored(classed.groupBy("root").agg(F.sum("n").alias("n")).where("n > 1").select("root"), "several")
    repeated = stored(classed.join(few(several), "root", "left_semi").select("a", "b", "root"), "repeated")
    lines = stored(found.where("words > 0").select("a", "b", "doc", "id", "line").join(few(repeated), ["a", "b"]).select("root", "doc", "id", "line"), "repeated-lines")
    kept = stored(lines.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "line", "doc")).alias("keep")), "kept")
    discard(found, distinct, classed, several, repeated, roots, *texts)
    gone = lines.join(few(kept), "root").where((F.col("doc") != F.col("keep.doc")) | (F.col("line") != F.col("keep.line")))
    return gone.select("doc", "line", F.col("keep.id").alias("keep_id"), F.col("keep.line").alias("keep_line")).distinct()


def line_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``(id, n_lines, n_dropped, dropped, keep_ids)``.

    ``dropped`` are the numbers (from 0) of the lines that go and ``keep_ids`` the ids of the documents in which
    their kept occurrences stand. Lines are compared in normal form (case, punctuation and spacing don't
    count); lines without letters and digits always stay. Of each connected group of lines the first
    occurrence stays, by id (null ids last), then line number. Rows equal in id and text count as
    one document and get equal verdicts. Null texts have no lines, an empty text one; very long lines are read whole (aligned by
    words beyond ``LONG_LINE`` characters); an empty table gives an empty
    result; other columns are not read, whatever their names.
    """
    gone = repeated_lines(docs, id_col, text_col)
    gone = gone.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("line", "keep_id"))).alias("gone"))
    each = docs.select(F.col(id_col).alias("id"), doc_key(id_col, text_col).alias("doc"), F.when(F.col(text_col).isNull(), 0).otherwise(F.octet_length(text_col) - F.octet_length(F.replace(F.col(text_col), F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"))
    none = F.array().cast("array<int>")
    return each.join(gone, "doc", "left").select(
        F.col("id").alias(id_col), "n_lines", F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.coalesce(F.transform("gone", lambda x: x["line"]), none).alias("dropped"),
        F.coalesce(F.transform("gone", lambda x: x["keep_id"]), F.array().cast(f"array<{dict(docs.dtypes)[id_col]}>")).alias("keep_ids"),
    )


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns, the texts without the lines that go (see :func:`line_verdicts`). Null texts stay null."""
    gone = repeated_lines(docs, id_col, text_col)
    gone = stored(gone.groupBy("doc").agg(F.collect_list("line").alias("__gone")).withColumnRenamed("doc", "__doc"), "gone")
    left = let(F.split(text_col, "\n"), lambda lines: F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "__gone"), lambda i: lines[i]))
    text = F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(F.array_join(left, "\n"))
    return docs.withColumn("__doc", doc_key(id_col, text_col)).join(few(gone), "__doc", "left").withColumn(text_col, text).select(*docs.columns)


def op5_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_verdicts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
