"""PII: bootstrapped contextual extraction on a pattern-instance graph.

Seeds are what four fixed expressions find (e-mail, IP address, card and phone numbers).  Words around a
seed induce lexical patterns: the two words before it, the word before and the word after it,
and a label before it (a word that ends with ``:``, ``=`` or ``#``).  Identifier-like words
that are no seeds are the unknown instances.  Spark scores the bipartite graph of patterns and instances in
turns: a pattern's confidence in a kind is the mean score of what fills it, smoothed; an
instance's score is the noisy-or of its patterns' confidences.  What confident patterns fill is
added to the spans, with the kind that the pattern has.

The graph is aggregated to distinct (pattern, instance) pairs before it is scored; sums are
partial before they are shuffled, so a pattern that a third of all instances fill is no hot task.

Defined results: a null or empty text has no spans and the hash of the empty string; repeated
rows give the same result; equal starts are in the order of the kinds; a discovered span that overlaps a seed
is dropped; the words of a pattern are those next to the instance, however far and long, and count by the 40 characters nearest to it; texts are read whole in time linear in their length; an empty table gives an empty result; only the columns named in
``keep`` are read and returned, so extra columns, whatever their names, change nothing.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.common import cut_lineage, small_or_plain, table

KINDS = ("email", "ip", "card", "phone")
#: The contract's expressions.  Where one could begin inside a run that it has just failed on, it begins at the run's start only.
EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Words with a digit or an at sign, without the punctuation around them.
INSTANCE = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+")
EDGES = ".,;:!?()[]{}<>\"'|"

ROUNDS = 3
MIN_SEEDS = 3
MIN_CONFIDENCE = 0.8
SMOOTHING = 1.0
MAX_BROADCAST_PATTERNS = 500_000


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches that do not overlap, found from each at sign, as a local part has none."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL_CHARS:
            start -= 1
        m = EMAIL_DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
        end = m.end() if m else at + 1
        at = text.find("@", end)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every seed, by start and kind."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if IP_HINT.search(text):
        for m in IP.finditer(text):
            if all(_octet(p) for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
    if CARD_HINT.search(text):
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(map(str.isdigit, m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


IP_HINT = re.compile(r"\.[0-9]")
CARD_HINT = re.compile(r"[0-9]")


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def spell(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def nearest(text: str, a: int, b: int, last: bool) -> str:
    """The last, or first, 40 characters of text[a:b] in lower case, where a run of digits is one 0."""
    size = 2 * NEAREST
    while True:
        own = text[max(a, b - size) : b] if last else text[a : min(b, a + size)]
        masked = MASK.sub("0", own.lower())
        if len(masked) > NEAREST or size >= b - a:
            return masked[-NEAREST:] if last else masked[:NEAREST]
        size *= 2


def patterns_of(text: str, start: int, end: int, starts: list[int], ends: list[int]) -> list[str]:
    """The lexical patterns of what stands from start to end; ``starts`` and ``ends`` are those of the text's words."""
    i, j = bisect_left(starts, start) - 1, bisect_right(ends, end)
    before = [nearest(text, starts[k], min(ends[k], start), True) for k in (i - 1, i) if k >= 0]
    after = [nearest(text, max(starts[j], end), ends[j], False)] if j < len(ends) else []
    glued = before and ends[i] >= start
    out = []
    if before and before[-1][-1] in ":=#":
        out.append(f"label {before[-1]}")
    if len(before) == 2:
        out.append(f"left {before[0]} {before[1]}{'' if glued else ' '}")
    if before and after:
        out.append(f"frame {before[-1]}{'' if glued else ' '} _ {after[0]}")
    return out


MASK = re.compile(r"[0-9]+")
WORD = re.compile(r"\S+")
NEAREST = 40


def mentions(text: str) -> list[dict]:
    """Seeds and identifier-like words of a text with their patterns and a hash of the instance."""
    if not CARD_HINT.search(text) and "@" not in text:
        return []
    base = base_spans(text)
    taken = sorted((a, b) for a, _, b in base)
    starts, reach, ends = [a for a, _ in taken], 0, []
    for _, b in taken:
        reach = max(reach, b)
        ends.append(reach)
    found = [(a, k, b) for a, k, b in base]
    for m in INSTANCE.finditer(text):
        word = m[0]
        a = m.start() + len(word) - len(word.lstrip(EDGES))
        b = m.end() - (len(word) - len(word.rstrip(EDGES)))
        cut = max(text.rfind(c, a, b) for c in "=:#") + 1  # what follows a label that is written together with it
        a = cut if a < cut < b else a
        i = bisect_right(starts, b - 1)
        if a < b and not (i and ends[i - 1] > a):
            found.append((a, -1, b))
    if not found:
        return []
    words = [m.span() for m in WORD.finditer(text)]
    word_starts, word_ends = [a for a, _ in words], [b for _, b in words]
    name = lambda a, b: hashlib.blake2b(text[a:b].lower().encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()
    return [{"start": a, "kind": k, "end": b, "instance": name(a, b), "patterns": patterns_of(text, a, b, word_starts, word_ends)} for a, k, b in sorted(found)]


MENTION = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))])
MENTIONS_SQL = "array<struct<start: long, kind: int, end: long, instance: string, patterns: array<string>>>"


def extract_mentions(docs: DataFrame, text: str, keep: tuple[str, ...]) -> DataFrame:
    """The columns ``keep`` and the mentions of each whole text."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            found = pa.array([mentions(t or "") for t in b.column(len(keep)).to_pylist()], pa.list_(MENTION))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), found], names=[*keep, "mentions"])

    rows = docs.select(*[f"`{k}`" for k in keep], f"`{text}`")
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keep)
    return rows.mapInArrow(batches, f"{kinds}, mentions {MENTIONS_SQL}")


def score_patterns(edges: DataFrame, *, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(pattern, kind, confidence) of the patterns that at least ``min_seeds`` different seeds fill.

    ``edges`` has distinct (pattern, instance, kind), where kind is -1 for unknown instances.
    """
    col = F.col
    seeds = edges.where("kind >= 0").groupBy("pattern", "kind").agg(F.count_distinct("instance").alias("seeds")).where(col("seeds") >= min_seeds)
    # a pattern stands for the kind of most of its seeds; others' fillers count against it
    kinds = seeds.groupBy("pattern").agg(F.max(F.struct("seeds", (-col("kind")).alias("low"))).alias("best")).select("pattern", (-col("best.low")).alias("kind"))
    live = cut_lineage(edges.join(kinds.withColumnRenamed("kind", "meant"), "pattern"))
    scores = None
    for _ in range(rounds):
        if scores is None:
            scored = live.withColumn("score", (col("kind") == col("meant")).cast("double"))
        else:
            known = scores.select(col("instance").alias("of"), col("meant").alias("as"), "p")
            scored = live.join(known, (col("instance") == col("of")) & (col("meant") == col("as")), "left")
            scored = scored.withColumn("score", F.when(col("kind") == col("meant"), 1.0).when(col("kind") >= 0, 0.0).otherwise(F.coalesce("p", F.lit(0.0))))
        confidence = scored.groupBy("pattern", "meant").agg((F.sum("score") / (F.count(F.lit(1)) + SMOOTHING)).alias("confidence"))
        confidence = cut_lineage(confidence)
        unknown = live.where("kind < 0").join(confidence, ["pattern", "meant"])
        miss = F.sum(F.log(1 - F.least(col("confidence"), F.lit(1 - 1e-9))))
        scores = unknown.groupBy("instance", "meant").agg((1 - F.exp(miss)).alias("p"))
    return confidence.where(col("confidence") >= min_confidence).select("pattern", col("meant").alias("kind"), "confidence")


def find_pii(docs: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), **options) -> DataFrame:
    """The columns ``keep`` of each document, ``base`` and ``added`` (arrays of start, kind, end, by start and kind)."""
    col = F.col
    rows = extract_mentions(docs, text, keep).withColumn("row", F.monotonically_increasing_id())
    rows = cut_lineage(rows)
    each = rows.where(F.size("mentions") > 0).select("row", F.inline("mentions"))
    edges = each.select(F.explode("patterns").alias("pattern"), "instance", "kind").distinct()
    good = score_patterns(edges, **options)
    good = cut_lineage(good)
    # the most confident pattern decides the kind
    asked = each.where("kind < 0").select("row", "start", "end", F.explode("patterns").alias("pattern"))
    hits = asked.join(small_or_plain(good, good.count(), MAX_BROADCAST_PATTERNS), "pattern")
    best = hits.groupBy("row", "start", "end").agg(F.max(F.struct("confidence", (-col("kind")).alias("low"))).alias("b"))
    added = best.select("row", F.struct("start", (-col("b.low")).cast("int").alias("kind"), "end").alias("s")).groupBy("row").agg(F.sort_array(F.collect_list("s")).alias("added"))
    base = F.transform(F.filter("mentions", lambda m: m["kind"] >= 0), lambda m: F.struct(m["start"].alias("start"), m["kind"].alias("kind"), m["end"].alias("end")))
    out = rows.select("row", *[f"`{k}`" for k in keep], base.alias("base"))
    out = out.join(added, "row", "left")
    return out.select(*[f"`{k}`" for k in keep], "base", F.coalesce("added", F.array().cast("array<struct<start: long, kind: int, end: long>>")).alias("added"))


def spelled(spans):
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of_kind = lambda k: F.filter("base", lambda s: s["kind"] == k)  # noqa: E731  (a second argument of the inner function would be the index)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    both = F.sort_array(F.concat("base", "added"))
    return rows.select("doc_id", *counts, F.sha2(spelled(F.col("base")), 256).alias("base_sha256"), spelled(both).alias("spans"))
