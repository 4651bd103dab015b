"""Classes of the members of buckets by a metric, without all pairs of a bucket.

In every turn each bucket has a pivot, and all that wait are compared with it: the member that meets most others in
all its buckets, as the text from which many copies were made does even if they are less like each other.  What links to
the pivot is done; the rest waits for the next turn.  Links of all buckets together give
classes, and a bucket whose members are in one class is done, be it as large as it may.

Buckets that two turns leave open are compared as pairs if they have only a ``few`` members.  Members of the others are keyed anew by a prefix filter: ``rest`` gives each its rarest features, such that two
members can only be linked if they share one; members that share a key, are in different classes and have room for a link are
compared as pairs.  ``differing`` takes a bucket's first pivot away from its members, so that copies of one text share only what they changed alike.
So every link within a bucket is found, or joins two members that are in one class already.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import cut_lineage, small_or_plain, written
from pulsegrid.llm.components import components

TURNS = 2
MAX_BROADCAST_ROWS = 1_000_000


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def rooted(rows: DataFrame, roots: DataFrame, node: str = "node", root: str = "root") -> DataFrame:
    """``rows`` with the root of each node; nodes without a row in ``roots`` are their own."""
    return rows.join(roots.select(F.col("node").alias(node), F.col("root").alias(root)), node, "left").withColumn(root, F.coalesce(root, node))


def bucket_classes(
    members: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    linked: Callable[[Column, Column, Column], Column],
    rest: Callable[[DataFrame], DataFrame],
    room: Callable[[Column, Column, Column, Column], Column],
    turns: int = TURNS,
    few: int = 0,
    fits: Callable[[Column, Column], Column] = lambda n, n2: F.lit(True),
) -> DataFrame:
    """(node, root) of the classes of members (key, node, n) that share keys; n is the member's size.  Roots have no row.

    ``verify`` takes pairs (a, b) and gives (a, b, d, na, nb), where d is the distance or some number
    beyond any link's.  ``linked(d, na, nb)`` must hold for a smaller d or larger sizes if it holds.
    ``rest`` takes the members (bucket, node, pivot, root) of buckets that are still open and gives their prefix keys (key, node, n, at), and ``room(n, at, n2, at2)``
    tells whether two that share a key at these places can be linked; see ``prefix_pairs`` for ``seeks``.  ``fits(n, n2)`` tells whether two of these sizes can, so that
    the others' contents are not fetched.
    """
    col = F.col
    is_link = linked(col("d"), col("na"), col("nb"))
    rank = F.struct(-col("meets"), "node")
    checked: list[DataFrame] = []

    def compare(pairs: DataFrame, roots: DataFrame | None) -> DataFrame:
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if checked:
            pairs = pairs.join(_union(checked).select("a", "b"), ["a", "b"], "left_anti")
        checked.append(cut_lineage(verify(pairs)))
        return with_links(roots, checked[-1].where(is_link).select(col("a").alias("u"), col("b").alias("v")))

    def pivot_turns(members: DataFrame) -> tuple[DataFrame | None, DataFrame]:
        """The classes, and (key, node, n, meets, was) of the keys whose members aren't all in one; was: a pivot (0), joined to one (1), or still waiting (2)."""
        sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("c"))
        meets = members.join(sizes, "key").groupBy("node").agg(F.sum("c").alias("meets"))
        waiting, done = cut_lineage(members.join(meets, "node").select("key", "node", "n", "meets")), None
        roots = None
        for _ in range(turns):
            pivots = waiting.groupBy("key").agg(F.min_by(F.struct("node", "n"), rank).alias("p")).select("key", col("p.node").alias("pivot"), col("p.n").alias("most"))
            met = cut_lineage(waiting.join(pivots, "key"))
            roots = compare(met.where((col("node") != col("pivot")) & fits(col("n"), col("most"))).select(col("pivot").alias("a"), col("node").alias("b")), roots)
            links = _union(checked).where(is_link)
            links = links.select(col("a").alias("pivot"), col("b").alias("node")).unionByName(links.select(col("b").alias("pivot"), col("a").alias("node"))).withColumn("joined", F.lit(True))
            was = F.when(col("node") == col("pivot"), 0).when(col("joined"), 1).otherwise(2)
            judged = met.join(links, ["pivot", "node"], "left").select("key", "node", "n", "meets", was.alias("was"))
            everything = cut_lineage(rooted(judged if done is None else done.unionByName(judged), roots))
            open_keys = everything.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
            everything = cut_lineage(everything.drop("root").join(open_keys, "key", "left_semi"))
            done, waiting = everything.where("was < 2"), everything.where("was = 2").select("key", "node", "n", "meets")
            if waiting.isEmpty():
                break
        return roots, everything.select("key", "node", "n", "meets", "was")

    members = cut_lineage(different_buckets(members))
    if members.isEmpty():
        return members.select("node", col("node").alias("root"))
    roots, left = pivot_turns(members)
    # where no pivot was joined and at most one member waits, all pairs have been compared
    unsure = left.groupBy("key").agg(F.count_if(col("was") == 1).alias("joined"), F.count_if(col("was") == 2).alias("waiting")).where("joined > 0 or waiting > 1")
    pivots = left.where("was = 0").groupBy("key").agg(F.min_by("node", rank).alias("pivot"))
    left = cut_lineage(left.join(unsure.select("key"), "key", "left_semi").join(pivots, "key").select(col("key").alias("bucket"), "node", "n", "pivot"))
    if left.isEmpty():
        return roots
    if few:
        large = cut_lineage(left.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).where(col("c") > few).select("bucket"))
        small = left.join(large, "bucket", "left_anti").select(col("bucket").alias("key"), "node", "n", F.lit(0).alias("at"))
        roots = compare(prefix_pairs(small, lambda n, at, n2, at2: fits(n, n2), roots), roots)
        left = cut_lineage(left.join(large, "bucket", "left_semi"))
        if left.isEmpty():
            return roots
    prefix = cut_lineage(rest(rooted(left.drop("n"), roots)))
    return compare(prefix_pairs(prefix, room, roots), roots)


def with_links(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """The classes (node, root) of ``links`` (u, v) and of the classes before; only links between different classes take part."""
    col = F.col
    if roots is None:
        return components(links)
    links = rooted(rooted(links, roots, "u", "ru"), roots, "v", "rv").where("ru <> rv").select(col("ru").alias("u"), col("rv").alias("v"))
    links = cut_lineage(links.distinct())
    if links.isEmpty():
        return roots
    moved = components(links)
    return cut_lineage(rooted(roots.withColumnRenamed("root", "was"), moved, "was").select("node", "root").unionByName(moved))


def different_buckets(members: DataFrame) -> DataFrame:
    """One key of those that the same members share, as copies share many; sets are compared by size and 128 bits of their hashes."""
    sets = members.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y"))
    one = sets.where("c > 1").groupBy("c", "x", "y").agg(F.min("key").alias("key")).select("key")
    return members.join(one, "key", "left_semi")


def prefix_pairs(prefix: DataFrame, room: Callable[[Column, Column, Column, Column], Column], roots: DataFrame) -> DataFrame:
    """Pairs (a, b) of members in different classes that share a prefix key (key, node, n, at) and have room for a link.

    If there is a column ``seeks``, at least one of both must seek by the key.
    """
    col = F.col
    own = cut_lineage(rooted(prefix, roots))
    more = [c for c in ("seeks",) if c in own.columns]
    other = own.select("key", *[col(c).alias(f"{c}2") for c in ["node", "root", "n", "at", *more]])
    may = (col("seeks") | col("seeks2")) if more else F.lit(True)
    met = own.join(other, (own["key"] == other["key"]) & (col("node") < col("node2")) & (col("root") != col("root2")) & may & room(col("n"), col("at"), col("n2"), col("at2")))
    return met.select(col("node").alias("a"), col("node2").alias("b")).distinct()


def prefix_links(prefix: DataFrame, verify: Callable, linked: Callable, room: Callable, roots: DataFrame) -> DataFrame:
    """Links (u, v) of prefix members, but those within classes that are known."""
    found = cut_lineage(verify(prefix_pairs(prefix, room, roots)))
    return found.where(linked(F.col("d"), F.col("na"), F.col("nb"))).select(F.col("a").alias("u"), F.col("b").alias("v"))


def rarest(features: DataFrame, most: Column, *more: str) -> DataFrame:
    """(key, node, n, at) of the prefix of each member: its features at places 0 to ``most`` when those that are rare in its bucket come first.

    ``features`` has (bucket, node, n, key), where n is the number of a node's features and they are distinct.  Those of one member alone
    come first and are left out, as nothing is met there.  The result's keys are features of a bucket.  Columns ``more`` of
    a bucket's member are handed on.
    """
    col = F.col
    own = ["bucket", "node", "n", *more]
    each = written(features.withColumn("key", F.xxhash64("bucket", "key")))
    often = cut_lineage(each.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1"))
    ranked = each.join(small_or_plain(often, often.count(), MAX_BROADCAST_ROWS), "key").groupBy(*own).agg(F.sort_array(F.collect_list(F.struct("c", "key"))).alias("shared"))
    ranked = ranked.select(*own, (col("n") - F.size("shared")).alias("gone"), F.posexplode("shared").alias("i", "x"))
    placed = ranked.select(col("x.key").alias("key"), "node", "n", (col("gone") + col("i")).alias("at"), *more)
    return placed.where(col("at") <= most)


def differing(left: DataFrame, sets: DataFrame, most: Callable[[Column], Column]) -> DataFrame:
    """Prefix keys (key, node, n, at, seeks) of members (bucket, node, pivot, root) of open buckets by what they have more, or less, than their pivot.

    ``sets`` has (node, n, set): the distinct features of each node, which number n.  Linked members have at most ``most(n)`` features each that the
    other lacks.  Taking the same pivot away from both leaves these as they are.  So of a member that has over ``most`` features that the pivot
    lacks, a linked one has one of the rarest ``most + 1``; the same holds for those that it lacks and the pivot has.
    It seeks partners by one of these two sides.  Members with neither are close to the pivot; where those of a bucket are in different
    classes all the same, as after moving words about, they are keyed by their whole sets.
    """
    col = F.col
    base = sets.select(col("node").alias("pivot"), col("set").alias("base"))
    own = left.join(sets, "node").join(base, "pivot").withColumn("most", most(col("n")))
    own = own.select("bucket", "node", "n", "root", "most", F.array_except("set", "base").alias("more"), F.array_except("base", "set").alias("less"))
    own = written(own)
    more, less = F.size("more") > col("most"), F.size("less") > col("most")
    side = lambda name, seeks: own.select("bucket", "node", "most", col("n").alias("size"), F.size(name).cast("long").alias("n"), seeks.alias("seeks"), F.xxhash64("bucket", F.lit(name)).alias("side"), F.explode(name).alias("key"))
    sought = own.where(less & ~more).select("bucket").distinct()
    parts = [side("more", more), side("less", less & ~more).join(sought, "bucket", "left_semi")]
    close = own.where(~more & ~less).select("bucket", "node", "root", "most")
    apart = close.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("bucket")
    close = cut_lineage(close.join(apart, "bucket", "left_semi").select("bucket", "node", "most"))
    if not close.isEmpty():
        whole = close.join(sets, "node").select("bucket", "node", "most", col("n").alias("size"), "n", F.lit(True).alias("seeks"), F.xxhash64("bucket", F.lit("whole")).alias("side"), F.explode("set").alias("key"))
        parts.append(whole)
    features = _union(parts).drop("bucket").withColumnRenamed("side", "bucket")
    return rarest(features, col("most"), "size", "most", "seeks").select("key", "node", col("size").alias("n"), "at", "seeks")
