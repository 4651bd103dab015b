"""Line dedup: a segment-partition edit join of all lines, then one line of each class stays.

A line is the sequence of its words by white space.  Two lines are linked if their edit distance in words is at most
t = min(n / 8, sqrt(n) / 2, 30), rounded down, where n is the longer one's number of words (``edits``): one word of 8, two of 16, three of 36, five
of 100.  The root is the fastest growth for which the keys stay in proportion to the text.  The 30 is the reach of
a bit vector of 64 bits; it counts for lines of 3,600 words and more.

A line of a class t is split into t + 1 segments whose length depends on the class alone, the first half counted from the line's start and the others
from its end.  A line within t edits holds one segment i unchanged with at most i edits before and at most t - i after it, so
that it stands at most r = min(i, t - i) words off.  Hence the keys of a segment are its r + 1 windows of its length less r: at a shift
of up to r two lines have one of them in common.  That is about (t + 2)^2 / 4 keys for a line, and
lines under the next class by no more than its edits have that class's keys too.  No link is missed.

Keys that only one line's copies have are dropped by a minimum and maximum per key.  Lines that share a key are verified by
banded bit-parallel edit distance once common words at both ends are stripped.  See ``buckets`` for how pairs of one key are avoided; what
that leaves open is keyed anew by the t + 1 rarest of the words that a line has more, or less, than the bucket's pivot: of more than t such words linked lines share
one.

Defined results: a null text has no lines and stays null; lines without a word are kept and never
compared; lines under 8 words are compared for equality only, as a word is more than an eighth of them; among equal or linked lines the first stays, in
the order of the files' paths and of the rows in them, or, where rows do not come from files one by one, of the scan; repeated documents keep the lines of the first; very long lines and texts are taken whole; an empty table gives an empty
result; extra columns are kept, and those named as the results (n_lines, n_exact, n_near, removed, origins) are replaced.
Two lines, or two words, are taken for one if 128, or 64, bits of their hashes are equal; of different lines with the same first 64 bits
only the one with the least others can be linked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.buckets import bucket_classes, differing
from pulsegrid.llm.common import cut_lineage, free_name, numbered_by_place, small_or_plain, table, written

EIGHTH, HALF, MOST = 8, 2, 30
SPACES = "\t\x0b\x0c\r"
MAX_BROADCAST_ROWS = 1_000_000
#: Numbers of lines below a row's number in ``pos``; a text has fewer lines, so rows may number 2^32.
LINES = 2**31
#: Open buckets of no more lines than this are compared as pairs, which costs less than keys by their words.
FEW = 8
WORD = r"[^\x20\x09-\x0D]"


def edits(words: Column) -> Column:
    """Edits within which lines are linked, by the longer one's number of words."""
    return F.least(F.floor(words / EIGHTH), F.floor(F.sqrt(words) / HALF), F.lit(MOST)).cast("int")


def least_words(t: Column) -> Column:
    """The least number of words for which ``edits`` is t."""
    return F.greatest(EIGHTH * t, (HALF * t) * (HALF * t))


def word_hashes(line: Column) -> Column:
    """64-bit hashes of the words of a line, which has no line feed."""
    odd = F.lit(False)
    for c in SPACES:
        odd = odd | F.contains(line, F.lit(c))
    plain = F.when(odd, F.translate(line, SPACES, " " * len(SPACES))).otherwise(line)
    return F.transform(F.array_remove(F.split(plain, " "), ""), lambda w: F.xxhash64(w))


def segment_keys(lines: DataFrame) -> DataFrame:
    """(node, n, key) of lines (node, words): their windows in the class of their edits and, if they are near it, in the next one."""
    col = F.col
    t = edits(col("n"))
    near = (t < MOST) & (col("n") + t + 1 >= least_words(t + 1))
    rows = lines.withColumn("n", F.size("words")).withColumn("t", F.explode(F.array(t, F.when(near, t + 1)))).where("t > 0")
    rows = rows.withColumn("size", F.floor((least_words(col("t")) - col("t")) / (col("t") + 1)).cast("int"))
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(0), col("t")))).withColumn("r", F.least(col("i"), col("t") - col("i")))
    rows = rows.withColumn("start", F.when(2 * col("i") <= col("t"), col("i") * col("size")).otherwise(col("n") - (col("t") - col("i") + 1) * col("size")))
    rows = rows.withColumn("a", F.explode(F.sequence(F.lit(0), col("r"))))
    return rows.select("node", col("n").cast("long").alias("n"), F.xxhash64("t", "i", F.slice("words", col("start") + col("a") + 1, col("size") - col("r"))).alias("key"))


def banded_edits(a: Column, b: Column, band: Column | int) -> Column:
    """Edit distance of arrays by bit vectors along the diagonal; some number over ``band``, which is 30 at most, if it is larger.

    Bit k of a column j stands for row j - band + k.  The distance is followed down the band's lower
    edge and, once that has passed the last row, along that row.
    """
    band = F.lit(band) if isinstance(band, int) else band
    na = F.size(a)
    lit = lambda x: F.lit(x).cast("long")
    shift = lambda x, k: F.call_function("shiftleft", x, k.cast("int"))
    full, top = shift(lit(1), 2 * band + 1) - 1, shift(lit(1), 2 * band)

    def step(s: Column, j: Column) -> Column:
        c = F.get(b, j - 1)
        match = F.aggregate(F.sequence(F.lit(0), 2 * band), lit(0), lambda m, k: m + F.when(F.get(a, j - band + k - 1) == c, shift(lit(1), k)).otherwise(lit(0)))
        return F.struct(s["vp"].alias("vp"), s["vn"].alias("vn"), s["d"].alias("d"), match.alias("m"), j.alias("j"))

    def column(s: Column) -> Column:
        vp, vn, m, j = s["vp"], s["vn"], s["m"], s["j"]
        d0 = ((m.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(m).bitwiseOR(vn).bitwiseAND(full)
        return F.struct(vp.alias("vp"), vn.alias("vn"), s["d"].alias("d"), d0.alias("d0"), j.alias("j"))

    def across(s: Column) -> Column:
        vp, vn, d0, j = s["vp"], s["vn"], s["d0"], s["j"]
        hp = vn.bitwiseOR(full.bitwiseXOR(d0.bitwiseOR(vp)))
        hn = d0.bitwiseAND(vp)
        return F.struct(s["d"].alias("d"), d0.alias("d0"), hp.alias("hp"), hn.alias("hn"), j.alias("j"))

    def down(s: Column) -> Column:
        d0, hp, hn, j = s["d0"], s["hp"], s["hn"], s["j"]
        shifted = F.shiftright(d0, 1)
        vp = hn.bitwiseOR(full.bitwiseXOR(shifted.bitwiseOR(hp)))
        vn = shifted.bitwiseAND(hp)
        edge = F.when(d0.bitwiseAND(top) == 0, 1).otherwise(0)
        bit = shift(lit(1), F.greatest(na - j + band, F.lit(0)))
        last = F.when(hp.bitwiseAND(bit) != 0, 1).otherwise(0) - F.when(hn.bitwiseAND(bit) != 0, 1).otherwise(0)
        return F.struct(vp.alias("vp"), vn.alias("vn"), (s["d"] + F.when(j + band <= na, edge).otherwise(last)).cast("int").alias("d"))

    # one let-binding after another, as lambdas, so that no step is written out twice
    bind = lambda s, f: F.get(F.transform(F.array(s), f), F.lit(0))
    start = F.struct((full - shift(lit(1), band) + 1).alias("vp"), lit(0).alias("vn"), F.least(band, na).cast("int").alias("d"))
    walk = F.aggregate(F.sequence(F.lit(1), F.size(b)), start, lambda s, j: bind(bind(bind(step(s, j), column), across), down), lambda s: s["d"])
    return F.when(F.abs(na - F.size(b)) > band, band + 1).when(F.size(b) == 0, na).otherwise(walk)


def missing_words(a: Column, b: Column) -> Column:
    """A lower bound of the edit distance: the different words that one line has and the other lacks need an edit each."""
    return F.greatest(F.size(F.array_except(a, b)), F.size(F.array_except(b, a)))


def word_edits(pairs: DataFrame) -> DataFrame:
    """(a, b, d, na, nb) of pairs with word hashes wa and wb; d is some number over ``edits`` if it is larger.

    The bit vectors are walked only where the bounds leave the distance open: from below the words that one lacks, and
    from above, once the ends are stripped, the places that differ, or the longer length if the lengths do.
    """
    col = F.col
    # the first place where both differ; beyond the shorter one both do
    head = lambda x, y: F.array_position(F.zip_with(x, y, lambda p, q: p.eqNullSafe(q)), False)
    both = pairs.select("a", "b", "wa", "wb", F.size("wa").cast("long").alias("na"), F.size("wb").cast("long").alias("nb"))
    both = both.withColumn("most", edits(F.greatest("na", "nb"))).withColumn("far", (F.abs(col("na") - col("nb")) > col("most")) | (missing_words(col("wa"), col("wb")) > col("most")))
    both = both.withColumn("at", F.when(~col("far"), head(col("wa"), col("wb"))).cast("int"))
    cut = lambda w: F.when(col("at") > 0, F.reverse(F.slice(w, col("at"), F.size(w)))).otherwise(F.array().cast("array<long>"))
    both = both.select("a", "b", "na", "nb", "most", "far", cut("wa").alias("wa"), cut("wb").alias("wb"))
    both = both.withColumn("at", head(col("wa"), col("wb")).cast("int"))
    cut = lambda w: F.slice(w, F.greatest("at", F.lit(1)), F.size(w))
    both = both.select("a", "b", "na", "nb", "most", "far", cut("wa").alias("wa"), cut("wb").alias("wb"))
    differ = F.size(F.filter(F.zip_with("wa", "wb", lambda p, q: p != q), lambda x: x))
    high = F.when(F.size("wa") == F.size("wb"), differ).otherwise(F.greatest(F.size("wa"), F.size("wb")))
    both = both.withColumn("low", F.when(~col("far"), missing_words(col("wa"), col("wb")))).withColumn("high", F.when(~col("far"), high))
    d = F.when(col("far") | (col("low") > col("most")), col("most") + 1).when(col("low") == col("high"), col("low")).otherwise(banded_edits(col("wa"), col("wb"), col("most")))
    return both.select("a", "b", d.cast("long").alias("d"), "na", "nb")


def lines_of(rows: DataFrame) -> DataFrame:
    """(row, number, line) of every line of rows (row, text)."""
    return rows.select("row", F.posexplode(F.split("text", "\n")).alias("number", "line"))


def hashed_lines(rows: DataFrame) -> DataFrame:
    """(row, number, pos, node, node2, has_word) of every line, written; pos rises with the row and the line's number."""
    col = F.col
    return written(lines_of(rows).select("row", "number", (col("row") * LINES + col("number")).alias("pos"), F.xxhash64("line").alias("node"), F.xxhash64(F.lit(97), "line").alias("node2"), col("line").rlike(WORD).alias("has_word")))


def linked_lines(rows: DataFrame) -> DataFrame:
    """(node, node2, root) of the classes of different lines of rows (row, text), by line hashes; the root is a node, and has a row as well."""
    col = F.col
    each = written(segment_keys(lines_of(rows).select(F.xxhash64("line").alias("node"), word_hashes(col("line")).alias("words"))))
    shared = each.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("key")
    shared = cut_lineage(shared)
    members = each.join(small_or_plain(shared, shared.count(), MAX_BROADCAST_ROWS), "key", "left_semi").groupBy("key", "node").agg(F.max("n").alias("n"))
    members = cut_lineage(members)
    nodes = cut_lineage(members.select("node").distinct())
    found = lines_of(rows).select(F.xxhash64("line").alias("node"), F.xxhash64(F.lit(97), "line").alias("node2"), "line").join(small_or_plain(nodes, nodes.count(), MAX_BROADCAST_ROWS), "node", "left_semi")
    words = written(found.groupBy("node").agg(F.min(F.struct("node2", "line")).alias("x")).select("node", "x.node2", word_hashes(col("x.line")).alias("words")))

    def verify(pairs: DataFrame) -> DataFrame:
        left, right = words.select(col("node").alias("a"), col("words").alias("wa")), words.select(col("node").alias("b"), col("words").alias("wb"))
        return word_edits(pairs.select("a", "b").join(right, "b").join(left, "a"))

    def rest(left: DataFrame) -> DataFrame:
        """Keys by words, where a word that comes again counts as another; a longer partner can be in the next class."""
        # buckets of one pivot are taken together, as a line stands in several: members of a bucket meet there too
        left = cut_lineage(left.select(col("pivot").alias("bucket"), "node", "pivot", "root").distinct())
        each = words.join(left.select("node").distinct(), "node").select("node", F.size("words").cast("long").alias("n"), F.explode("words").alias("w"))
        each = each.groupBy("node", "n", "w").agg(F.count(F.lit(1)).alias("c")).select("node", "n", "w", F.explode(F.sequence(F.lit(1).cast("long"), col("c"))).alias("i"))
        sets = written(each.groupBy("node", "n").agg(F.collect_list(F.xxhash64("w", "i")).alias("set")))
        return differing(left, sets, lambda n: edits(n + edits(n) + 1))

    def room(n: Column, at: Column, n2: Column, at2: Column) -> Column:
        most = edits(F.greatest(n, n2))
        return (F.abs(n - n2) <= most) & (F.greatest(at, at2) <= most)

    found = bucket_classes(members, verify, lambda d, na, nb: d <= edits(F.greatest(na, nb)), rest, room, few=FEW, fits=lambda n, n2: F.abs(n - n2) <= edits(F.greatest(n, n2)))
    found = found.select("node", "root").unionByName(found.select(col("root").alias("node"), "root").distinct())
    return found.join(words.select("node", "node2"), "node")


def line_classes(rows: DataFrame) -> DataFrame:
    """(row, number, pos, first, root) of every line of rows (row, text): where its text and its class stand first."""
    col = F.col
    lines, roots = hashed_lines(rows), linked_lines(rows)
    roots = cut_lineage(roots.withColumnRenamed("root", "head"))
    firsts = lines.where("has_word").groupBy("node", "node2").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("c"))
    grouped = firsts.join(small_or_plain(roots, roots.count(), MAX_BROADCAST_ROWS), ["node", "node2"], "left").where("c > 1 or head is not null")
    grouped = cut_lineage(grouped.select("node", "node2", "first", "head"))  # the lines that have an equal or linked one
    heads = grouped.where("head is not null").groupBy("head").agg(F.min("first").alias("root"))
    grouped = cut_lineage(grouped.join(heads, "head", "left").select("node", "node2", "first", F.coalesce("root", "first").alias("root")))
    out = lines.join(small_or_plain(grouped, grouped.count(), MAX_BROADCAST_ROWS), ["node", "node2"], "left")
    return out.select("row", "number", "pos", F.coalesce("first", "pos").alias("first"), F.coalesce("root", "pos").alias("root"))


def line_report(rows: DataFrame) -> DataFrame:
    """(row, n_exact, n_near, removed, origins) of every document with lines that do not stay; ``rows`` has row, id and text.

    ``removed`` has the numbers of these lines, ``origins`` the distinct ids of the documents where their classes stand first.
    """
    col = F.col
    classes = written(line_classes(rows.select("row", "text")))
    gone = classes.where("pos <> root")
    at = classes.where("pos = root").select(col("pos").alias("root"), col("row").alias("home"))
    sought = gone.select("root").distinct()
    at = at.join(small_or_plain(sought, sought.count(), MAX_BROADCAST_ROWS), "root", "left_semi")
    homes = at.join(rows.select(col("row").alias("home"), col("id").alias("origin")), "home").select("root", "origin")
    homes = cut_lineage(homes)
    origins = gone.select("row", "root").distinct().join(small_or_plain(homes, homes.count(), MAX_BROADCAST_ROWS), "root")
    origins = origins.groupBy("row").agg(F.sort_array(F.collect_set("origin")).alias("origins"))
    counts = gone.groupBy("row").agg(
        F.count_if(col("pos") != col("first")).alias("n_exact"), F.count_if(col("pos") == col("first")).alias("n_near"), F.sort_array(F.collect_list("number")).alias("removed")
    )
    return counts.join(origins, "row", "left")


def dedup_lines(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", in_files: bool = False) -> DataFrame:
    """``docs`` without the lines that do not stay, and with n_lines, n_exact, n_near, removed and origins.

    ``in_files`` says that ``docs`` is columns of a Parquet table, so that it is read again where it is needed and not written anew.
    """
    col, own = F.col, ("n_lines", "n_exact", "n_near", "removed", "origins")
    row = free_name(docs, "row")
    rows = numbered_by_place(docs, *[col(f"`{c}`") for c in docs.columns if c.lower() not in own], row=row, write=not in_files)
    report = written(line_report(rows.select(col(row).alias("row"), col(f"`{doc_id}`").alias("id"), col(f"`{text}`").alias("text"))))
    rows = rows.join(small_or_plain(report.withColumnRenamed("row", row), report.count(), MAX_BROADCAST_ROWS), row, "left").drop(row)
    lines = free_name(rows, "lines")
    rows = rows.withColumn(lines, F.split(col(f"`{text}`"), "\n"))  # a projection of its own: what a lambda holds is evaluated for each element
    stays = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), col("removed"))
    clean = F.array_join(F.transform(stays, lambda i: F.get(col(lines), i)), "\n")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("n_exact", "n_near")}
    none = {"removed": F.coalesce("removed", F.array().cast("array<int>")), "origins": F.coalesce("origins", F.array().cast(f"array<{docs.schema[doc_id].dataType.simpleString()}>"))}
    rows = rows.withColumn("n_lines", F.coalesce(F.size(lines), F.lit(0)).cast("long"))
    return rows.withColumn(text, F.when(F.size("removed") > 0, clean).otherwise(col(f"`{text}`"))).withColumns(zero | none).drop(lines)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = dedup_lines(docs, in_files=True)
    return rows.select("doc_id", "n_lines", "n_exact", "n_near", F.array_join("removed", ",").alias("removed"), "origins", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
