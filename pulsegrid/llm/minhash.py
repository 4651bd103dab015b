"""MinHash near-dedup: order MinHash sketches, pivot links and banded alignment.

A text is the sequence of its words (A-Z lower-cased, other ASCII but letters and digits dropped);
its k-mers are runs of five words, each labelled with its occurrence number.  For each of 24 random orders
the sketch keeps the five least labelled k-mers *in text order*, and its hash is a bucket key; two
texts meet with about the fifth power of their similarity in each order.

Candidates are verified by alignment: a longest common subsequence of the two k-mer sequences, bit
parallel and banded.  With c common k-mers the similarity is c / (n_a + n_b - c), and texts are
linked from 0.8 on.  The distance d = n_a + n_b - 2 c is a metric, and the link is 9 d <= n_a + n_b.

Copies are reduced to one representative before anything is paired.  Within a bucket members are compared
with pivots; see ``buckets``.  Texts of buckets that this leaves open go through an exact prefix filter on
their k-mers, so not all pairs of a bucket are made and no link that would join two classes is lost.  Sketches of few k-mers
miss links too often, or always where all k-mers are in the sketch, so short texts go through the prefix filter too, whatever buckets they have.
Components of links are the classes.

Defined results: null counts as empty; texts without words are copies if they are equal; texts
of fewer than five words have one k-mer, so they link to copies only; repeated rows are copies; ties go to the
smaller doc_id, null last; very long texts are taken whole, their alignment within a band of 4 / 9 of the shorter one's length; extra columns are kept, whatever
their names; an empty table gives an empty result.  Words are compared by 64 bits and whole texts by 128 bits of their hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.buckets import bucket_classes, prefix_links, rarest
from pulsegrid.llm.common import cut_lineage, free_name, numbered, small_or_plain, table, text_or_empty, written
from pulsegrid.llm.components import components
from pulsegrid.llm.decontam import words_of

K = 5
LEAST = 5
ORDERS = 24
#: Links of texts with at most so many k-mers are found exactly; the other text has at most 5 / 4 as many.
SHORT = 25
LEAST_LINKED = 4
MAX_BROADCAST_ROWS = 1_000_000
SEED = 20_001
MAX_MATRIX = 400_000
MANY_PLACES = 16


def _constants(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    return r.integers(0, 2**64, n, dtype=np.uint64), r.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: xor-shifts and odd multipliers."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def kmers(words: np.ndarray, k: int = K) -> np.ndarray:
    """64-bit hashes of the runs of ``k`` words; of the whole text if it is shorter; words are 64-bit hashes."""
    w = words.astype(np.int64).view(np.uint64)
    n = max(1, len(w) - k + 1)
    out = np.full(n, len(w) if len(w) < k else k, np.uint64)
    for j in range(min(k, len(w))):
        out = mixed(out + w[j : j + n])
    return out


def labelled(x: np.ndarray) -> np.ndarray:
    """Hashes that also hold how often the same k-mer came before."""
    order = np.argsort(x, kind="stable")
    s = x[order]
    same = np.r_[False, s[1:] == s[:-1]]
    if not same.any():
        return x
    at = np.arange(len(x))
    first = np.maximum.accumulate(np.where(same, 0, at))
    out = np.empty_like(x)
    out[order] = np.where(same, mixed(s + (at - first).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)), s)
    return out


def sketch(words: np.ndarray, add: np.ndarray, mul: np.ndarray, least: int = LEAST) -> np.ndarray:
    """One bucket key for each order."""
    x = labelled(kmers(words))
    keys = np.empty(len(add), np.uint64)
    step = max(1, MAX_MATRIX // len(x))
    for a in range(0, len(add), step):
        v = (x[None, :] ^ add[a : a + step, None]) * mul[a : a + step, None]
        if v.shape[1] > least:
            at = np.sort(np.argpartition(v, least - 1, axis=1)[:, :least], axis=1)  # text order
        else:
            at = np.broadcast_to(np.arange(v.shape[1]), v.shape)
        h = np.arange(a, a + len(v), dtype=np.uint64)
        for j in range(at.shape[1]):
            h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + x[at[:, j]])
        keys[a : a + step] = h
    return keys.view(np.int64)


def common_kmers(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Longest common subsequence by alignments at most ``band`` off the diagonal; bit-parallel over the band."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    a, b, n = a[head:], b[head:], n - head
    differ = np.flatnonzero(a[::-1][:n] != b[::-1][:n])
    tail = int(differ[0]) if len(differ) else n
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(a) or not len(b):
        return head + tail
    places: dict[int, list[int]] = {}
    for i, x in enumerate(a.tolist()):
        places.setdefault(x, []).append(i)
    # a k-mer with many places is one long bit vector, of which the band is a slice
    often = {x: sum(1 << (i + band) for i in own) for x, own in places.items() if len(own) > MANY_PLACES}
    width = 2 * band + 1
    full, low, v, out = (1 << width) - 1, -band, (1 << width) - 1, 0
    for x in b.tolist():
        # bit i of v stands for row low + i of a; a zero bit is a step of the subsequence
        m = (often[x] >> (low + band)) & full if x in often else 0
        for i in places.get(x, ()) if x not in often else ():
            if low <= i < low + width:
                m |= 1 << (i - low)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
        out += not v & 1
        v = (v >> 1) | (1 << (width - 1))
        low += 1
    return head + tail + out + width - v.bit_count()


def distance(a: np.ndarray, b: np.ndarray) -> int:
    """The alignment distance of two k-mer sequences; beyond twice the limit of a link a lower bound of it."""
    total = len(a) + len(b)
    reach = 2 * (total // 9) + 1
    gap = abs(len(a) - len(b))
    if gap > reach:
        return gap
    return min(total - 2 * common_kmers(a, b, reach), reach + 1) if reach < total else total - 2 * common_kmers(a, b, reach)


def word_hashes(text: Column) -> Column:
    return F.transform(words_of(text), lambda w: F.xxhash64(w))


def sketches(docs: DataFrame, text: str, *, seed: int = SEED, orders: int = ORDERS) -> DataFrame:
    """(row, doc_id, content, n, keys) of every document, in one pass; content is equal for copies."""
    words = words_of(F.col(f"`{text}`"))
    rows = docs.select("row", "id", words.alias("w"), text_or_empty(F.col(f"`{text}`")).alias("t"))
    rows = rows.select("row", "id", F.transform("w", lambda w: F.xxhash64(w)).alias("w"), F.when(F.size("w") == 0, F.md5("t")).alias("plain"))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        add, mul = _constants(seed, orders)
        for b in it:
            w = b.column(2)
            flat, at = w.values.to_numpy(zero_copy_only=False), w.offsets.to_numpy()
            content, n, keys = [], [], []
            for i, plain in enumerate(b.column(3).to_pylist()):
                own = flat[at[i] : at[i + 1]]
                content.append(hashlib.blake2b(own.tobytes() if len(own) else plain.encode(), digest_size=16, person=b"words" if len(own) else b"plain").hexdigest())
                n.append(max(0, len(own) - K + 1) if len(own) >= K else min(1, len(own)))
                keys.append(sketch(own, add, mul) if len(own) else np.empty(0, np.int64))
            offsets = np.cumsum([0, *map(len, keys)])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(content, pa.string()), pa.array(n, pa.int64()), lists], names=["row", "id", "content", "n", "keys"])

    return rows.mapInArrow(batches, f"row long, id {docs.schema['id'].dataType.simpleString()}, content string, n long, keys array<long>")


def verify(pairs: DataFrame, contents: DataFrame) -> DataFrame:
    """(a, b, d, na, nb) of candidate pairs (a, b); ``contents`` has row and words."""
    left = contents.select(F.col("row").alias("a"), F.col("words").alias("wa"))
    right = contents.select(F.col("row").alias("b"), F.col("words").alias("wb"))
    both = pairs.select("a", "b").join(right, "b").join(left, "a")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in it:
            a, b = x.column(0), x.column(1)
            wa, wb = x.column(2), x.column(3)
            fa, oa, fb, ob = wa.values.to_numpy(zero_copy_only=False), wa.offsets.to_numpy(), wb.values.to_numpy(zero_copy_only=False), wb.offsets.to_numpy()
            d, na, nb = [], [], []
            last, ka = None, None
            for i, pivot in enumerate(a.to_pylist()):
                if pivot != last:
                    last, ka = pivot, kmers(fa[oa[i] : oa[i + 1]])
                kb = kmers(fb[ob[i] : ob[i + 1]])
                d.append(distance(ka, kb))
                na.append(len(ka))
                nb.append(len(kb))
            yield pa.RecordBatch.from_arrays([a, b, pa.array(d, pa.int64()), pa.array(na, pa.int64()), pa.array(nb, pa.int64())], names=["a", "b", "d", "na", "nb"])

    return both.select("a", "b", "wa", "wb").mapInArrow(batches, "a long, b long, d long, na long, nb long")


def linked(d: Column, na: Column, nb: Column) -> Column:
    """c / (na + nb - c) >= 0.8, where d = na + nb - 2 c."""
    return 9 * d <= na + nb


def prefixes(nodes: DataFrame, contents: DataFrame) -> DataFrame:
    """(key, node, n, at) of the prefix of each of ``nodes`` (node): its labelled k-mers that are rarest among them, whatever their buckets.

    Links have at least 4 / 9 (n_a + n_b) labelled k-mers in common.  With the rare ones first, two such
    texts share a k-mer within the first n - 0.8 n + 1 of each, at places that leave room for the rest.
    """
    rows = contents.join(nodes.select(F.col("node").alias("row")), "row").select("row", "words")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            w = b.column(1)
            flat, at = w.values.to_numpy(zero_copy_only=False), w.offsets.to_numpy()
            x = [labelled(kmers(flat[at[i] : at[i + 1]])).view(np.int64) for i in range(len(w))]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, x)]), pa.int32()), pa.array(np.concatenate(x) if x else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=["node", "kmers"])

    each = rows.mapInArrow(batches, "node long, kmers array<long>").select("node", F.size("kmers").cast("long").alias("n"), F.explode("kmers").alias("key"))
    return rarest(each.select(F.lit(0).alias("bucket"), "node", "n", "key"), F.floor(F.col("n") / 5))


def room(n: Column, at: Column, n2: Column, at2: Column) -> Column:
    return 9 * F.least(n - at, n2 - at2) >= 4 * (n + n2)


def with_short_links(reps: DataFrame, found: DataFrame, contents_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``found`` (node, root) with all links of short texts; ``reps`` has row and n.  Of fewer than ``LEAST_LINKED`` k-mers none links."""
    col = F.col
    short = reps.where((col("n") >= LEAST_LINKED) & (4 * col("n") <= 5 * SHORT)).select(col("row").alias("node"))
    short = cut_lineage(short)
    if short.isEmpty():
        return found
    contents = contents_of(short.select(col("node").alias("row")))
    keys = prefixes(short, contents).select("key", "node", "n", "at")
    links = prefix_links(keys, lambda pairs: verify(pairs, contents), linked, room, found)
    return found if links.isEmpty() else components(links.unionByName(found.select(col("node").alias("u"), col("root").alias("v"))))


def content_classes(rows: DataFrame, *, seed: int = SEED) -> DataFrame:
    """(row, id, root) of rows (row, id, text); the root is the row of a member of the class."""
    col = F.col
    seen = written(sketches(rows, "text", seed=seed))
    first = cut_lineage(seen.groupBy("content").agg(F.min("row").alias("rep"), F.count(F.lit(1)).alias("c")))
    reps = cut_lineage(seen.select("row", "n", "keys").join(first.select(col("rep").alias("row")), "row", "left_semi"))
    each = reps.select("row", "n", F.explode("keys").alias("key"))
    shared = each.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key")
    members = cut_lineage(each.join(shared, "key").select("key", "row", "n"))

    def contents_of(wanted: DataFrame) -> DataFrame:
        wanted = cut_lineage(wanted)
        found = rows.select("row", "text").join(small_or_plain(wanted, wanted.count(), MAX_BROADCAST_ROWS), "row", "left_semi")
        return written(found.select("row", word_hashes(col("text")).alias("words")))

    contents = contents_of(members.select("row").distinct())
    found = bucket_classes(members.withColumnRenamed("row", "node"), lambda pairs: verify(pairs, contents), linked, lambda left: prefixes(left.select("node").distinct(), contents), room)
    found = with_short_links(reps, found, contents_of)
    # only texts with copies or links need to learn their root; those of a large group are spread by the row of each copy
    moved = first.join(found.withColumnRenamed("node", "rep"), "rep", "left").where("c > 1 or root is not null").select("content", F.coalesce("root", "rep").alias("root"))
    moved = cut_lineage(moved)
    out = seen.select("row", "id", "content").join(small_or_plain(moved, moved.count(), MAX_BROADCAST_ROWS), "content", "left")
    return out.select("row", "id", F.coalesce("root", "row").alias("root"))


def near_duplicates(rows: DataFrame, *, seed: int = SEED) -> DataFrame:
    """(row, id, class_id, class_size, keeps) of every one of rows (row, id, text), which must be a table that gives the same numbers again.

    class_id is the least id of the class, and ``keeps`` is true for the one document that stays.
    """
    col = F.col
    classes = written(content_classes(rows, seed=seed))
    least = F.struct(col("id").isNull().alias("none"), "id", "row")
    sizes = classes.groupBy("root").agg(F.min(least).alias("best"), F.count(F.lit(1)).alias("class_size"))
    sizes = cut_lineage(sizes.where("class_size > 1"))
    out = classes.join(small_or_plain(sizes, sizes.count(), MAX_BROADCAST_ROWS), "root", "left")
    alone = col("best").isNull()
    return out.select(
        "row", "id", F.when(alone, col("id")).otherwise(col("best.id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"), (alone | (col("row") == col("best.row"))).alias("keeps")
    )


def drop_near_duplicates(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """One document of each class, with the columns of ``docs``."""
    row = free_name(docs, "row")
    own = numbered(docs, *[F.col(f"`{c}`") for c in docs.columns], row=row)
    kept = near_duplicates(own.select(F.col(row).alias("row"), F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text")), **options)
    gone = cut_lineage(kept.where("not keeps").select(F.col("row").alias(row)))
    return own.join(small_or_plain(gone, gone.count(), MAX_BROADCAST_ROWS), row, "left_anti").drop(row)


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = numbered(table(spark, sf_dir, "documents"), F.col("doc_id").alias("id"), F.col("text"))
    return near_duplicates(rows).select(F.col("id").alias("doc_id"), "class_id", "class_size", "keeps")
