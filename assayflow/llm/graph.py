"""Linking the members of buckets without all their pairs, and connected components."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayflow.llm.common import discard, few, stored

#: Members of a block when all pairs of a crowded bucket are compared.
BLOCK = 1024


def pairs_apart(crowded: DataFrame, holds: Callable[[Callable, Callable], Column] | None = None, more: Sequence[str] = ()) -> DataFrame:
    """All pairs ``(a, b)``, a < b, of members of the same bucket that have different roots.

    ``crowded``: ``(key, id, root, n)``, n members in the bucket, and the columns ``more``. Buckets are cut into blocks of about ``BLOCK``
    members, and the pairs of two blocks are made by one task. ``holds`` is a condition on the two members' columns that the join checks.
    """
    blocks = F.ceil(F.col("n") / BLOCK)
    own = crowded.withColumns({"own": F.pmod(F.xxhash64("id"), blocks), "other": F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))})
    side = lambda first, i, j: own.select("key", F.col("own").alias(i), F.col("other").alias(j), F.struct("id", "root", *more).alias(first))
    both = side("a", "i", "j").join(side("b", "j", "i"), ["key", "i", "j"]).where("a.id < b.id and a.root != b.root")
    return (both if holds is None else both.where(holds(F.col("a"), F.col("b")))).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))


def linked_roots(
    members: DataFrame, verify: Callable[[DataFrame], DataFrame], gather: Callable[[DataFrame], None] = lambda ids: None,
    apart: Callable[[DataFrame, int | None], DataFrame] = lambda crowded, most: pairs_apart(crowded), rounds: Sequence[int | None] = (None,),
) -> DataFrame:
    """``(id, root)`` of :func:`components` over the links that connect all similar members of the same bucket (stored).

    ``members``: ``(key long, id long)``, distinct. Buckets of one member fall away at once: of each key only its count, smallest and
    largest id are shuffled, after partial sums. First each member is compared with its bucket's hub, the smallest id: a bucket of
    copies takes as many candidates as it has members. Similarity isn't transitive, so then all other pairs of a bucket that the links so far
    don't connect are candidates: ``apart`` finds them among ``(key, id, root, n)``, and may leave out pairs that can't hold.
    So no link between members of different classes is lost, however crowded the bucket. ``rounds`` are numbers of pairs that ``apart`` gives
    of a member at most, None (all) in the end: links found among some of a member's pairs spare the rest, and while a member has more (``cut``) the
    next round follows. ``gather`` gets the ids that have company in a bucket before ``verify`` gets distinct pairs and returns those that hold.
    """
    buckets = members.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("hub"), F.max("id").alias("top")).where("n > 1")
    buckets = stored(buckets, "buckets")
    two = buckets.where("n = 2").select(F.col("hub").alias("a"), F.col("top").alias("b"))
    crowd = stored(members.join(few(stored(buckets.where("n > 2").select("key", "n", "hub"), "crowded-keys")), "key"), "crowds")
    first = two.union(crowd.where("id != hub").select(F.col("hub").alias("a"), F.col("id").alias("b"))).distinct()
    first = stored(first, "candidates")
    some = stored(first.select(F.col("a").alias("id")).union(first.select("b")).distinct(), "involved")
    gather(some)
    links = stored(verify(first), "links")
    roots = components(links)
    discard(buckets, some, links)
    tried, done = first, [crowd, first]
    for most in rounds:
        named = roots.withColumnsRenamed({"id": "__node", "root": "__root"})
        rooted = stored(crowd.join(few(named), F.col("id") == F.col("__node"), "left").select("key", "id", F.coalesce("__root", "id").alias("root"), "n", "hub"), "rooted")
        mixed = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
        left = apart(rooted.where("id != hub").drop("hub").join(few(stored(mixed, "mixed")), "key"), most)
        cut = False
        if most is not None:
            left = stored(left, "pairs")
            cut = not left.where("cut").isEmpty()
            done.append(left)
            left = left.select("a", "b")
        second = stored(left.distinct().join(tried, ["a", "b"], "left_anti"), "candidates")
        more = stored(verify(second), "links")
        done += [rooted, second]
        if not more.isEmpty():
            roots = followed(roots, more)
        discard(more)
        if not cut:
            break
        tried = tried.union(second)
    discard(*done)
    return roots


def followed(roots: DataFrame, more: DataFrame) -> DataFrame:
    """``roots`` after the few links of ``more``, which came later and join whole groups: only their roots are looked at."""
    root = lambda x: roots.select(F.col("id").alias(x), F.col("root").alias(f"r{x}"))
    ends = few(more).join(root("a"), "a", "left").join(root("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    joined = components(ends)
    later = few(joined.withColumnsRenamed({"id": "__old", "root": "__new"}))
    moved = roots.join(later, F.col("root") == F.col("__old"), "left").select("id", F.coalesce("__new", "root").alias("root"))
    alone = joined.join(roots.select("id"), "id", "left_anti")
    both = stored(moved.union(alone.select("id", "root")), "roots")
    discard(roots, joined)
    return both


def components(links: DataFrame) -> DataFrame:
    """``(id, root)`` for each end of a link (stored): root is the smallest id of its connected group.

    Large-star and small-star steps in turn: each makes every node point to a smaller one, until
    all links are (node, root). A node's smallest neighbour is a partial aggregate, and a hub's links
    are joined with it by a join that is split at run time, so no group is gathered. Each step is
    stored and the one before it deleted; their number grows with the logarithm of the group size.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    state = None
    while True:
        # large star: the larger neighbours of a node get its smallest one
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = stored(both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        # small star: the smaller neighbours of a node, and the node itself, get the smallest of them
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        smaller = large.join(lowest, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        step = stored(smaller.union(lowest.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(edges, large)
        edges = step
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state:
            break
        state = now
    roots = stored(edges.select(F.col("u").alias("id"), F.col("v").alias("root")).union(edges.select("v", "v").distinct()), "roots")
    discard(edges)
    return roots
