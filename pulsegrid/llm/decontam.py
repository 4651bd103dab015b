"""Benchmark decontamination: a prefix-filtered set join of documents with item-sized windows.

Every window of 13 consecutive item words (the whole item where it is shorter) must occur in a
document entirely, so the necessary prefix of a window, with its words ordered by rarity in the
corpus, is one word: its rarest.  Document words meet the windows by that word alone; the position
of the word in the window and both lengths bound where the window may begin, and the candidate is
verified word by word.  Hits are merged per document as intervals.

Rarity is counted over all documents, but only for words that items have.  The windows are
broadcast if their counted number is within a bound.  Beyond it the places of those corpus words that are some window's
rarest meet the windows in a shuffled join, which Spark may split where a word is frequent, and the text is read by row where a window may stand.

Defined results: a null or empty text has no words and no hits and isn't contaminated; an item
without words matches nothing; a null item id counts as an item in ``n_hit`` but is not listed;
repeated items count once per item id; repeated documents are judged alike; ties in rarity go to the first place in the window, which changes no
result; very long texts are taken whole; with no items nothing is contaminated; an empty table gives an empty result; extra columns are
kept, and those named as the results (n_words, n_hit, n_items, items_sha256, contaminated) are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.common import LOWER, UPPER, cut_lineage, free_name, numbered, small_or_plain, table, text_or_empty, written

WINDOW = 13
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MAX_BROADCAST_WINDOWS = 200_000
MAX_BROADCAST_ROWS = 1_000_000


def words_of(text: Column) -> Column:
    """Runs of digits, a-z and non-ASCII characters once A-Z are lower-cased."""
    return F.array_remove(F.split(F.translate(text_or_empty(text), UPPER, LOWER), SEPARATORS), "")


def item_windows(items: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """Distinct (item, words) of the windows of all items."""
    w = items.select(F.col(f"`{item_id}`").cast("string").alias("item"), words_of(F.col(f"`{text}`")).alias("words")).where("size(words) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - window + 1, F.lit(1)))
    return w.select("item", F.explode(F.transform(starts, lambda i: F.slice("words", i, window))).alias("words")).distinct()


def signatures(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """Distinct windows with their number, their rarest word in ``docs`` (column words) and its first place in the window."""
    each = windows.select("words").distinct()
    vocabulary = each.select(F.explode("words").alias("word")).distinct()
    n = vocabulary.count()
    known = F.broadcast(vocabulary) if n <= MAX_BROADCAST_WINDOWS * WINDOW else vocabulary
    counted = docs.select(F.explode("words").alias("word")).join(known, "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    freq = vocabulary.join(counted, "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n"))
    each = written(each.select(F.monotonically_increasing_id().alias("window"), "words"))
    placed = each.select("window", "words", F.posexplode("words").alias("at", "word")).join(freq, "word")
    rarest = F.min_by(F.struct("word", "at"), F.struct("n", "at"))
    return placed.groupBy("window", "words").agg(rarest.alias("r")).select("window", "words", F.size("words").alias("size"), F.col("r.word").alias("word"), F.col("r.at").alias("at"))


def find_windows(docs: DataFrame, known: DataFrame, small: bool) -> DataFrame:
    """(row, start, size, window) of every occurrence; ``docs`` has row and words, ``known`` is from ``signatures``."""
    col = F.col
    known = known.select("window", "size", col("words").alias("wanted"), "word", "at")
    placed = docs.select("row", F.size("words").alias("length"), "words", F.posexplode("words").alias("pos", "word"))
    start = col("pos") - col("at")
    fits = (start >= 0) & (start + col("size") <= col("length"))
    same = F.slice("words", F.greatest(start + 1, F.lit(1)), col("size")) == col("wanted")
    if small:
        known = F.broadcast(known)
        return placed.join(known, (placed["word"] == known["word"]) & fits & same).select("row", start.alias("start"), "size", "window")
    # only places go through the shuffle, and only those of words that are some window's rarest; what they may hold is read where it lies
    rarest = known.select("word").distinct()
    seen = placed.select("row", "pos", "word", "length").join(rarest, "word", "left_semi")
    bounds = known.select("window", "size", "word", "at")
    maybe = seen.join(bounds, "word").where(fits).select("row", start.alias("start"), "size", "window")
    each = maybe.groupBy("row", "size", "window").agg(F.collect_set("start").alias("starts"))  # as many as the document has words
    held = docs.join(each, "row").select("row", "size", "window", F.explode("starts").alias("start"), "words")
    held = held.select("row", "start", "size", "window", F.slice("words", col("start") + 1, col("size")).alias("got"))
    return held.join(known.select("window", "wanted"), "window").where("got = wanted").select("row", "start", "size", "window")


def covered(intervals: Column) -> Column:
    """Length of the union of sorted (start, size) intervals."""
    first = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    step = lambda a, x: F.struct((a["n"] + F.greatest(x["start"] + x["size"] - F.greatest(x["start"], a["end"]), F.lit(0))).alias("n"), F.greatest(x["start"] + x["size"], a["end"]).alias("end"))
    return F.aggregate(intervals, first, step, lambda a: a["n"])


def window_hits(rows: DataFrame, items: DataFrame, *, row: str, text: str, item_id: str, item_text: str, window: int, max_broadcast: int) -> DataFrame:
    """(row, n_hit, items) of the rows with a window; ``rows`` is a table that gives the same numbers ``row`` again."""
    col = F.col
    split = rows.select(col(row).alias("row"), words_of(col(f"`{text}`")).alias("words"))
    windows = cut_lineage(item_windows(items, item_id, item_text, window))
    known = cut_lineage(signatures(split, windows))
    found = cut_lineage(find_windows(split, known, known.count() <= max_broadcast))
    of_items = windows.join(known.select("words", "window"), "words").select("item", "window")
    hits = found.groupBy("row").agg(covered(F.sort_array(F.collect_set(F.struct(col("start").cast("long").alias("start"), col("size").cast("long").alias("size"))))).alias("n_hit"))
    listed = found.select("row", "window").distinct().join(of_items, "window").groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return cut_lineage(hits.join(listed, "row", "left").select("row", "n_hit", "items"))


def is_contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (20 * n_hit >= n_words)


def contamination(docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, max_broadcast: int = MAX_BROADCAST_WINDOWS) -> DataFrame:
    """Adds n_words, n_hit, n_items, items_sha256 and contaminated to ``docs`` (columns of those names are replaced)."""
    col = F.col
    own = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    kept, row, listed_in = [c for c in docs.columns if c.lower() not in own], free_name(docs, "row"), free_name(docs, "items")
    rows = numbered(docs, *[col(f"`{c}`") for c in kept], row=row)
    judged = window_hits(rows, items, row=row, text=text, item_id=item_id, item_text=item_text, window=window, max_broadcast=max_broadcast)
    judged = judged.select(col("row").alias(row), "n_hit", col("items").alias(listed_in))
    out = rows.withColumn("n_words", F.size(words_of(col(f"`{text}`"))).cast("long")).join(small_or_plain(judged, judged.count(), MAX_BROADCAST_ROWS), row, "left")
    none = F.array().cast("array<string>")
    out = out.withColumns({"n_hit": F.coalesce("n_hit", F.lit(0)).cast("long"), listed_in: F.coalesce(listed_in, none)})
    return out.select(
        *[col(f"`{c}`") for c in kept], "n_words", "n_hit", F.size(listed_in).cast("long").alias("n_items"),
        F.sha2(F.array_join(listed_in, ","), 256).alias("items_sha256"), is_contaminated(col("n_hit"), col("n_words")).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, max_broadcast: int = MAX_BROADCAST_WINDOWS) -> DataFrame:
    """The documents that aren't contaminated, with the columns of ``docs``; these are numbered and written once."""
    row = free_name(docs, "row")
    own = numbered(docs, *[F.col(f"`{c}`") for c in docs.columns], row=row)
    hits = window_hits(own, items, row=row, text=text, item_id=item_id, item_text=item_text, window=window, max_broadcast=max_broadcast).select(F.col("row").alias(row), "n_hit")
    sizes = own.join(small_or_plain(hits, hits.count(), MAX_BROADCAST_ROWS), row).select(row, "n_hit", F.size(words_of(F.col(f"`{text}`"))).alias("n_words"))
    bad = cut_lineage(sizes.where(is_contaminated(F.col("n_hit"), F.col("n_words"))).select(row))
    return own.join(small_or_plain(bad, bad.count(), MAX_BROADCAST_ROWS), row, "left_anti").drop(row)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return contamination(docs, table(spark, sf_dir, "benchmark").select("item_id", "text")).drop("text")


OP6_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), i AS (
  SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[CAST(s AS BIGINT):CAST(s AS BIGINT) + 12], ' ') AS win
  FROM b, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS u(s) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT n FROM i),
p AS (
  SELECT row, CAST(s AS BIGINT) AS s, n, array_to_string(w[CAST(s AS BIGINT):CAST(s AS BIGINT) + n - 1], ' ') AS win
  FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS u(s) WHERE len(w) >= n
), f AS (SELECT p.row, p.s, p.n, i.item FROM p JOIN i ON p.n = i.n AND p.win = i.win),
h AS (SELECT row, count(DISTINCT x) AS n_hit FROM (SELECT row, unnest(range(s, s + n)) AS x FROM f) GROUP BY row),
l AS (SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row, item FROM f) GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (row) LEFT JOIN l USING (row)
"""
