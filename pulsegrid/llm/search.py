"""Ranked lexical search: inverted treaps per term, and one traversal of all treaps of a query.

The postings of a term are a treap: in search order by document, in heap order by impact, the part of the score that only
document and term decide.  A query walks the treaps of its terms together.  Its state is an interval of documents with, for each
term, the treap's node of greatest impact within it, and the weighted sum of these impacts bounds every score in the interval.  An
interval whose bound cannot enter the best k is dropped; of any other the document of the greatest summand is scored in all treaps, and the
interval is split there, each node giving way to the first below it that lies in its half.  Intervals of many queries are walked level by
level as ragged arrays, so that the greatest impacts come first and the bar rises early.

On Spark: one pass counts each document's terms of the queries (its forward list, written as Parquet); document frequencies are a grouped
sum with partial counts; a second pass cuts each task's lists into blocks of bounded size, builds their treaps, runs all queries over
block after block with the bar of the task so far, and returns k rows for each query; a window over these ranks them.  Queries
are taken in groups of bounded size, so what every task holds of them is bounded; no row of the documents goes to the driver.

Defined results: texts are read whole, null and empty ones have no terms and do not count for N; a query without terms has no rows; equal scores are ranked by
ascending document id, null last; repeated documents are ranked each by itself, and repeated queries get their rows each; weights and scores are
64-bit integers; an empty table gives an empty result; columns other than the named ones are not read, so extra columns, whatever their names, change nothing.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsegrid.llm.common import alnum_words, ascii_lower, table, written

K = 10
MAX_QUERY_TERMS = 200_000
BLOCK_POSTINGS = 500_000
CHUNK_POSTINGS = 2_000_000
NO_ID = np.iinfo(np.int64).max
#: Separators as spaces and A-Z in lower case; bytes of other characters than ASCII stand for themselves.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def impact(tf: np.ndarray, n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """What a term that occurs tf times in a document of n terms is worth, before its weight."""
    m = 25 + 75 * n * documents // terms
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def weight(df: int, documents: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


@dataclass
class Treaps:
    """The treaps of all terms in a block of documents: nodes stand by term, then by document."""

    ids: np.ndarray  # of the block's documents, ascending
    doc: np.ndarray
    impact: np.ndarray
    left: np.ndarray
    right: np.ndarray
    root: np.ndarray  # by term, -1 without postings
    size: np.ndarray  # by term


def treaps(ids: np.ndarray, doc: np.ndarray, term: np.ndarray, impacts: np.ndarray, terms: int) -> Treaps:
    """Builds the treaps of postings (doc, term, impact); equal impacts are ordered by a hash, which keeps copies from making chains."""
    order = np.lexsort((doc, term))
    doc, term, impacts = doc[order], term[order], impacts[order]
    noise = (np.arange(len(doc), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)
    heap = (impacts * (1 << 20) + noise.astype(np.int64)).tolist()
    left, right, root = [-1] * len(doc), [-1] * len(doc), np.full(terms, -1)
    size = np.bincount(term, minlength=terms)
    bounds = np.cumsum(np.r_[0, size]).tolist()
    for t in np.flatnonzero(size).tolist():
        spine: list[int] = []  # the right edge of the tree so far
        for i in range(bounds[t], bounds[t + 1]):
            below, own = -1, heap[i]
            while spine and heap[spine[-1]] < own:
                below = spine.pop()
            left[i] = below
            if spine:
                right[spine[-1]] = i
            spine.append(i)
        root[t] = spine[0]
    return Treaps(ids, doc, impacts, np.array(left, np.int64), np.array(right, np.int64), root, size)


def within(x: Treaps, node: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The node of greatest impact at or below each ``node`` whose document is from low to high, or -1."""
    node = node.copy()
    todo = np.flatnonzero(node >= 0)
    while len(todo):
        at = node[todo]
        d = x.doc[at]
        before, after = d < low[todo], d > high[todo]
        moved = before | after
        node[todo] = np.where(before, x.right[at], np.where(after, x.left[at], at))
        todo = todo[moved]
        todo = todo[node[todo] >= 0]
    return node


class Best:
    """The best k (score, id) of each query so far."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.query, self.score, self.id = (np.empty(0, np.int64) for _ in range(3))
        self.bar = np.ones(queries, np.int64)  # scores under it don't enter; those equal to it do for ids up to the last
        self.last = np.full(queries, NO_ID)

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        good = (score > self.bar[query]) | (score == self.bar[query]) & (ids <= self.last[query])
        if not good.any():
            return
        query, score, ids = np.r_[self.query, query[good]], np.r_[self.score, score[good]], np.r_[self.id, ids[good]]
        order = np.lexsort((ids, -score, query))
        query, score, ids = query[order], score[order], ids[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        keep = rank < self.k
        self.query, self.score, self.id = query[keep], score[keep], ids[keep]
        full = rank == self.k - 1
        self.bar[query[full]], self.last[query[full]] = score[full], ids[full]


def traverse(x: Treaps, best: Best, query: np.ndarray, term: np.ndarray, weights: np.ndarray) -> None:
    """Walks the treaps of queries, given by their (query, term, weight), and adds what enters their best."""
    live = x.root[term] >= 0
    query, term, weights = query[live], term[live], weights[live]
    if not len(query):
        return
    order = np.argsort(query, kind="stable")
    query, node, weights = query[order], x.root[term[order]], weights[order]
    starts = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
    owner = query[starts]  # of each interval
    of = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(query)]))
    low, high = np.zeros(len(owner), np.int64), np.full(len(owner), len(x.ids) - 1)
    while len(owner):
        # entries (of, node, weights) stand by interval, and each has at least one
        starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        part = weights * x.impact[node]
        bound = np.add.reduceat(part, starts)
        keep = (bound > best.bar[owner]) | (bound == best.bar[owner]) & (x.ids[low] <= best.last[owner])
        if not keep.all():
            entries = keep[of]
            new = np.cumsum(keep) - 1
            node, weights, part, of = node[entries], weights[entries], part[entries], new[of[entries]]
            owner, low, high = owner[keep], low[keep], high[keep]
            if not len(owner):
                return
            starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        greatest = np.maximum.reduceat(part, starts)
        first = np.flatnonzero(part == greatest[of])
        pivot = np.empty(len(owner), np.int64)
        pivot[of[first[::-1]]] = x.doc[node[first[::-1]]]
        at = pivot[of]
        d = x.doc[node]
        hit = node.copy()
        other = np.flatnonzero(d != at)
        hit[other] = within(x, np.where(d[other] < at[other], x.right[node[other]], x.left[node[other]]), at[other], at[other])
        score = np.add.reduceat(np.where(hit >= 0, weights * x.impact[hit], 0), starts)
        best.add(owner, score, x.ids[pivot])
        sides = []
        for lo, hi in ((low, pivot - 1), (pivot + 1, high)):
            wide = (lo <= hi)[of]
            own = of[wide]
            below = within(x, node[wide], lo[own], hi[own])
            there = below >= 0
            sides.append((own[there], below[there], weights[wide][there], lo, hi))
        n = len(owner)
        of = np.r_[sides[0][0], sides[1][0] + n]
        node, weights = np.r_[sides[0][1], sides[1][1]], np.r_[sides[0][2], sides[1][2]]
        used, of = np.unique(of, return_inverse=True)
        owner, low, high = np.r_[owner, owner][used], np.r_[sides[0][3], sides[1][3]][used], np.r_[sides[0][4], sides[1][4]][used]


def search_block(x: Treaps, best: Best, query: np.ndarray, term: np.ndarray, weights: np.ndarray) -> None:
    """``traverse`` for as many queries at once as have a bounded number of postings; ``query`` rises."""
    sizes = x.size[term]
    queries, at = np.unique(query, return_index=True)
    total = np.add.reduceat(sizes, at) if len(at) else sizes[:0]
    group = (np.cumsum(total) - total) // CHUNK_POSTINGS
    for g in np.unique(group):
        own = np.isin(query, queries[group == g])
        traverse(x, best, query[own], term[own], weights[own])


def forward_lists(docs: DataFrame, vocabulary: dict[bytes, int], text: str, doc_id: str) -> DataFrame:
    """(id, n, terms, tfs) of each document: its number of terms, and those of the vocabulary with their counts."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = vocabulary.get
        for b in it:
            n, offsets, terms, tfs = [], [0], [], []
            for t in b.column(1).to_pylist():
                words = t.encode("utf-8", "surrogatepass").translate(TERM_BYTES).split() if t else []
                found = Counter(map(get, words))
                found.pop(None, None)
                n.append(len(words))
                terms.extend(found)
                tfs.extend(found.values())
                offsets.append(len(terms))
            at = pa.array(offsets, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.ListArray.from_arrays(at, pa.array(terms, pa.int32())), pa.ListArray.from_arrays(at, pa.array(tfs, pa.int32()))], names=["id", "n", "terms", "tfs"]
            )

    return docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text")).mapInArrow(batches, "id long, n long, terms array<int>, tfs array<int>")


def best_of_tasks(lists: DataFrame, weights: dict[int, int], queries: list[dict[int, int]], documents: int, terms: int, k: int, block_postings: int) -> DataFrame:
    """(query, id, score): the best k of every query in each task's documents, by treaps of bounded blocks."""
    query = np.array([q for q, own in enumerate(queries) for _ in own], np.int64)
    term = np.array([t for own in queries for t in own], np.int64)
    factor = np.array([c * weights.get(t, 0) for own in queries for t, c in own.items()], np.int64)
    used = factor > 0  # a term without a document or weight adds nothing
    query, term, factor = query[used], term[used], factor[used]
    vocabulary = 1 + max((t for own in queries for t in own), default=0)

    def block(parts: list[tuple[np.ndarray, ...]]) -> Treaps:
        ids, n, sizes, found, tfs = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        of = np.repeat(np.arange(len(ids)), sizes)
        return treaps(ids[order], place[of], found, impact(tfs, n[of], documents, terms), vocabulary)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, parts, held = Best(len(queries), k), [], 0
        for b in it:
            for start in range(0, b.num_rows, 1000):
                part = b.slice(start, 1000)
                ids = part.column(0).fill_null(NO_ID).to_numpy()
                found, tfs = part.column(2), part.column(3)
                at = found.offsets.to_numpy()
                own = slice(at[0], at[-1])
                parts.append((ids, part.column(1).to_numpy(), np.diff(at), found.values.to_numpy()[own].astype(np.int64), tfs.values.to_numpy()[own].astype(np.int64)))
                held += at[-1] - at[0]
                if held >= block_postings:
                    search_block(block(parts), best, query, term, factor)
                    parts, held = [], 0
        if parts:
            search_block(block(parts), best, query, term, factor)
        ids = pa.array(best.id, pa.int64(), mask=best.id == NO_ID)
        yield pa.RecordBatch.from_arrays([pa.array(best.query), ids, pa.array(best.score)], names=["query", "id", "score"])

    return lists.select("id", "n", "terms", "tfs").mapInArrow(batches, "query long, id long, score long")


def search(
    docs: DataFrame, queries: DataFrame, *, k: int = K, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", query_terms: int = MAX_QUERY_TERMS, block_postings: int = BLOCK_POSTINGS
) -> DataFrame:
    """(item_id, rank, doc_id, score) of the best k documents for each row of ``queries``, which has item_id and text; document ids are integers.

    Queries are taken in groups of about ``query_terms`` terms, and treaps are built for blocks of about ``block_postings`` postings.
    """
    col, spark = F.col, docs.sparkSession
    items = written(queries.select(F.monotonically_increasing_id().alias("row"), col(f"`{item_id}`").alias("item_id"), F.transform(alnum_words(col("text")), ascii_lower).alias("terms")))
    total = items.agg(F.sum(F.size("terms"))).first()[0] or 0
    groups = 1 + total // query_terms
    kind = queries.schema[item_id].dataType.simpleString()
    out = None
    for g in range(groups):
        own = items.where(F.pmod(F.xxhash64("row"), F.lit(groups)) == g).orderBy("row").collect()
        own = [r for r in own if r["terms"]]
        vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w.encode() for r in own for w in r["terms"]))}
        lists = written(forward_lists(docs, vocabulary, text, doc_id))
        documents, terms = lists.agg(F.count_if(col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = lists.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        weights = {r["term"]: weight(r["df"], documents) for r in df.collect()}  # at most the vocabulary of a group
        counted = [Counter(vocabulary[w.encode()] for w in r["terms"]) for r in own]
        names = spark.createDataFrame([(q, r["item_id"]) for q, r in enumerate(own)], f"query long, item_id {kind}")
        found = best_of_tasks(lists, weights, counted, documents, max(terms, 1), k, block_postings).join(F.broadcast(names), "query")
        rank = F.row_number().over(Window.partitionBy("query").orderBy(col("score").desc(), col("id").asc_nulls_last()))
        found = found.withColumn("rank", rank).where(col("rank") <= k).select("item_id", "rank", col("id").alias("doc_id"), "score")
        out = found if out is None else out.unionByName(found)
    return out


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH terms AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents
), totals AS (
  SELECT count(*) AS nn, sum(len(ts)) AS ll FROM terms WHERE len(ts) > 0
), sought AS (
  SELECT item_id, term, count(*) AS c FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
  ) GROUP BY ALL
), post AS (
  SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(ts) AS n, unnest(ts) AS term FROM terms) WHERE term IN (SELECT term FROM sought) GROUP BY ALL
), worth AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(nn) + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM post, totals GROUP BY term
), scores AS (
  SELECT item_id, doc_id, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + CAST((75 * n * nn) // ll AS BIGINT))))) AS BIGINT) AS score
  FROM sought JOIN post USING (term) JOIN worth USING (term), totals GROUP BY item_id, doc_id
), ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
