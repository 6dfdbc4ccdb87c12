"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix (DataFrame only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayflow.llm.common import RUN_ROWS, bits_for, running_sum, stored, top_bits, unit

#: Most blocks a shuffle has, so that its matrix (blocks x shards counts) has a bounded size.
MOST_BLOCK_BITS = 16


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def hypergeometric(good: Column, total: Column, sample: Column, u: Column) -> Column:
    """Rows drawn from ``good`` of ``total`` by a sample of ``sample``, by inversion of the uniform ``u``.

    The weights run by their recurrence from the mode outwards as far as 12 standard deviations, so no
    factorials are needed; they are normalised by their own sum.
    """

    def scope(v):
        c, m, k = v["c"], v["m"], v["k"]
        low, high = F.greatest(F.lit(0.0), k + c - m), F.least(k, c)
        mode = F.greatest(low, F.least(high, F.floor((k + 1) * (c + 1) / (m + 2)).cast("double")))
        share = c / F.greatest(m, F.lit(1.0))
        sd = F.sqrt(F.greatest(F.lit(0.0), k * share * (1 - share) * (m - k) / F.greatest(m - 1, F.lit(1.0))))
        return F.struct(
            c.alias("c"), m.alias("m"), k.alias("k"), mode.alias("mode"), v["u"].alias("u"),
            F.least(high - mode, F.ceil(12 * sd) + 30).cast("long").alias("up"),
            F.least(mode - low, F.ceil(12 * sd) + 30).cast("long").alias("down"),
        )

    def rise(v, x):
        return (v["c"] - x) * (v["k"] - x) / ((x + 1) * (v["m"] - v["c"] - v["k"] + x + 1))

    def fall(v, x):
        return x * (v["m"] - v["c"] - v["k"] + x) / ((v["c"] - x + 1) * (v["k"] - x + 1))

    def walk(v, steps, ratio, first, r):
        """Sum of the weights, and how many running sums are at most ``r``."""
        start = F.struct(F.lit(1.0).alias("w"), F.lit(first).alias("t"), F.lit(0.0).alias("n"))
        x = (lambda i: v["mode"] + i) if first else (lambda i: v["mode"] - i)

        def step(a, i):
            w = a["w"] * ratio(v, x(i.cast("double")))
            return F.struct(w.alias("w"), (a["t"] + w).alias("t"), (a["n"] + F.when((a["t"] if first else a["t"] + w) <= r, 1.0).otherwise(0.0)).alias("n"))

        return F.aggregate(F.sequence(F.lit(0).cast("long"), steps), start, step)

    def pick(t):
        v, r = t["v"], t["r"]
        up = v["mode"] + walk(v, v["up"], rise, 1.0, r)["n"]
        down = v["mode"] - 1 - walk(v, v["down"], fall, 0.0, r - t["up"])["n"]
        return F.when(r < t["up"], F.least(up, v["mode"] + v["up"])).otherwise(F.greatest(down, v["mode"] - v["down"]))

    def totals(v):
        return F.struct(v.alias("v"), walk(v, v["up"], rise, 1.0, F.lit(-1.0))["t"].alias("up"), walk(v, v["down"], fall, 0.0, F.lit(-1.0))["t"].alias("down"))

    value = F.struct(good.cast("double").alias("c"), total.cast("double").alias("m"), sample.cast("double").alias("k"), u.alias("u"))
    return _let(
        _let(_let(value, scope), totals),
        lambda t: _let(F.struct(t["v"].alias("v"), t["up"].alias("up"), (t["v"]["u"] * (t["up"] + t["down"])).alias("r")), pick),
    ).cast("long")


def _draw(caps: Column, sample: Column, seed: Column) -> Column:
    """How ``sample`` rows fall on capacities ``caps``: a multivariate hypergeometric array."""

    def step(a, cap_i):
        x = hypergeometric(cap_i["cap"], a["m"], a["k"], unit(F.xxhash64(seed, cap_i["i"])))
        return _let(x, lambda n: F.struct((a["m"] - cap_i["cap"]).alias("m"), (a["k"] - n).alias("k"), F.concat(a["out"], F.array(n)).alias("out")))

    start = F.struct(
        F.aggregate(caps, F.lit(0).cast("long"), lambda a, x: a + x).alias("m"), sample.cast("long").alias("k"), F.array().cast("array<long>").alias("out")
    )
    return F.aggregate(F.transform(caps, lambda cap, i: F.struct(cap.alias("cap"), i.alias("i"))), start, step)["out"]


def communication_matrix(counts: DataFrame, sizes: list[int], bits: int, seed: int) -> DataFrame:
    """A row ``(block, row array<long>)`` for each of ``2**bits`` blocks: rows it sends to each shard.

    ``counts``: ``(block int, n long)``; the counts add up to the sum of ``sizes``. The draw goes down a binary tree of
    blocks: a node splits its capacities between its two halves by a multivariate hypergeometric
    draw. The tree's data are the block counts (``2**MOST_BLOCK_BITS`` at most), and nodes are dealt
    out over tasks once there are some.
    """
    spark: SparkSession = counts.sparkSession
    every = spark.range(1 << bits).select(F.col("id").cast("int").alias("block")).join(counts, "block", "left")
    nodes = every.agg(F.transform(F.array_sort(F.collect_list(F.struct("block", F.coalesce("n", F.lit(0)).alias("n")))), lambda x: x["n"]).alias("counts")).select(
        F.lit(0).alias("block"), "counts", F.array(*[F.lit(s).cast("long") for s in sizes]).alias("row")
    )
    for level in range(bits):
        half = 1 << (bits - level - 1)
        left = nodes.withColumn(
            "left",
            _draw(
                F.col("row"),
                F.aggregate(F.slice("counts", 1, half), F.lit(0).cast("long"), lambda a, x: a + x),
                F.xxhash64(F.lit(seed), F.lit(level), F.col("block")),
            ),
        )
        nodes = left.select(
            F.explode(
                F.array(
                    F.struct((2 * F.col("block")).alias("block"), F.slice("counts", 1, half).alias("counts"), F.col("left").alias("row")),
                    F.struct((2 * F.col("block") + 1).alias("block"), F.slice("counts", half + 1, half).alias("counts"), F.zip_with("row", "left", lambda a, b: a - b).alias("row")),
                )
            ).alias("x")
        ).select("x.*")
        if level == 4:
            nodes = nodes.repartition("block")
    return nodes.select("block", "row")


def shard(df: DataFrame, keys: list[str], n_shards: int = 24, seed: int = 11, run_rows: int = RUN_ROWS) -> DataFrame:
    """Adds ``shard`` (0 to n_shards - 1) and ``slot`` (gapless from 0 in each shard): a uniform shuffle.

    Shard sizes differ by one row at most; the larger ones come first. ``keys`` identify rows: they
    fix the order, so that reruns and recomputed tasks agree; rows equal in all keys are
    interchangeable. Rows go to blocks by hash; the matrix of block-to-shard counts is drawn exactly;
    each block is permuted and cut at its counts; rows then move to their shard and are permuted
    again, in runs of about ``run_rows`` rows by hash prefix. Null keys hash as nulls; an empty table
    gives an empty result; columns named shard or slot are replaced.
    """
    df = df.drop("shard", "slot")
    n = df.count()
    bits = bits_for(n, run_rows, MOST_BLOCK_BITS)
    sizes = [n // n_shards + (i < n % n_shards) for i in range(n_shards)]
    hashed = lambda use: F.xxhash64(F.lit(seed), F.lit(use), *keys)
    blocks = df.withColumn("__block", top_bits(hashed("block"), bits))
    counts = blocks.groupBy(F.col("__block").alias("block")).agg(F.count("*").alias("n"))
    matrix = communication_matrix(counts, sizes, bits, seed).select(
        F.col("block").alias("__block"),
        F.transform(F.sequence(F.lit(1), F.lit(n_shards)), lambda i: F.aggregate(F.slice("row", F.lit(1), i), F.lit(0).cast("long"), lambda a, x: a + x)).alias("__ends"),
    )
    local = Window.partitionBy("__block").orderBy("__permute", *keys)
    sent = (
        blocks.withColumn("__permute", hashed("permute"))
        .withColumn("__i", F.row_number().over(local))
        .join(F.broadcast(stored(matrix, "matrix")), "__block")  # 2**MOST_BLOCK_BITS rows at most
        .withColumn("shard", F.size(F.filter("__ends", lambda e: e < F.col("__i"))))
        .drop("__block", "__ends", "__i", "__permute")
        .withColumn("__key", hashed("again"))
        .withColumn("__run", top_bits(F.col("__key"), bits_for(n // n_shards, run_rows)))
        .withColumn("__one", F.lit(1))
    )
    return running_sum(stored(sent, "shards"), "shard", "__run", ["__key", *keys], "__one", "slot").drop("__run", "__key", "__one")


def op1_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards. Null texts count as empty: size 8, crc32 0."""
    text = F.coalesce("text", F.lit(""))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32")
    )
    placed = shard(docs, ["doc_id", "text_crc32"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"))
