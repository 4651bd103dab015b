"""Quality rules: learned decision lists over interpretable text statistics.

``text_stats`` adds the statistics as native expressions, ``learn_decision_list`` grows and
prunes threshold conjunctions by sequential covering from labelled rows, and ``DecisionList``
turns the ordered rules into one conditional expression.  Everything is DataFrame expressions
and aggregates; the driver sees only histograms of a fixed size.

Defined results: a null text counts as empty (no words, so it fails the base rule); repeated
rows are judged alike; an empty table gives an empty result; a document whose labels are null
takes no part in learning; if there are no labelled rows, or no conjunction is precise enough,
the list is empty and keeps every document; ties between conjunctions go to the first statistic and the lower threshold; very
long texts are taken whole.  ``keep_good`` returns the columns of its input, whatever their names; ``text_stats`` and ``judge`` add their
results under ``prefix`` and replace columns of those names.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.common import cut_lineage, free_name, space_words, table, text_or_empty

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = "#*$%&|<>"

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct_words")


def text_stats(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """Adds the statistics of every whole text, as long columns named ``prefix`` + STATS.

    The steps are separate projections so that the split words and the window hashes are
    computed once per row.  Windows are compared by a chained 64-bit hash within one text.
    """
    t, w, h, s = (free_name(docs, x) for x in ("text", "words", "hashes", "sorted"))
    col = F.col
    out = docs.withColumn(t, text_or_empty(col(f"`{text}`"))).withColumn(w, space_words(col(t)))
    one = F.transform(col(w), lambda x: F.xxhash64(x))

    def doubled(a: Column, step: int) -> Column:
        return F.zip_with(a, F.slice(a, step + 1, F.greatest(F.size(a), F.lit(1))), lambda x, y: F.xxhash64(x, y))

    out = out.withColumn(h, one)
    for step in (1, 2, 4):
        out = out.withColumn(h, doubled(col(h), step))
    n = F.size(col(w))
    out = out.withColumn(h, F.slice(col(h), 1, F.greatest(n - (WINDOW - 1), F.lit(0))))
    pairs = F.sort_array(F.transform(col(h), lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    out = out.withColumn(s, F.when(F.size(F.array_distinct(col(h))) < F.size(col(h)), pairs))

    def same(x: Column, i: Column) -> Column:
        return F.coalesce(F.get(col(s), i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(col(s), i + 1)["h"] == x["h"], F.lit(False))

    out = out.withColumn(s, F.sort_array(F.transform(F.filter(col(s), same), lambda x: x["i"])))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate(
        col(s),
        start,
        lambda a, p: F.struct((a["n"] + p + WINDOW - F.greatest(p, a["end"])).alias("n"), (p + WINDOW).alias("end")),
        lambda a: a["n"],
    )
    lines = F.filter(F.split(col(t), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = out.withColumn(h, lines)
    values = {
        "n_words": n,
        "word_chars": F.length(F.array_join(col(w), "")),
        "n_symbols": F.length(col(t)) - F.length(reduce(lambda x, c: F.replace(x, F.lit(c), F.lit("")), SYMBOLS, col(t))),
        "n_dup_lines": F.size(col(h)) - F.size(F.array_distinct(col(h))),
        "n_repeat_words": F.coalesce(covered, F.lit(0)),
        "n_distinct_words": F.size(F.array_distinct(col(w))),
    }
    return out.withColumns({prefix + k: v.cast("long") for k, v in values.items()}).drop(t, w, h, s)


def base_failed(prefix: str = "") -> Column:
    """Fewer than 20 words, or over 30 % of them in repeated 8-word windows."""
    n, r = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return (n < MIN_WORDS) | (100 * r > MAX_REPEAT_PERCENT * n)


def features(prefix: str = "") -> dict[str, Column]:
    """The interpretable features that the rules may test."""
    c = lambda k: F.col(prefix + k).cast("double")
    n = F.greatest(c("n_words"), F.lit(1.0))
    return {
        "n_words": c("n_words"),
        "mean_word_chars": c("word_chars") / n,
        "symbols_per_word": c("n_symbols") / n,
        "dup_lines_per_word": c("n_dup_lines") / n,
        "repeat_share": c("n_repeat_words") / n,
        "distinct_share": c("n_distinct_words") / n,
    }


@dataclass(frozen=True)
class Condition:
    """``feature > cut`` if ``above``, else ``feature <= cut``."""

    feature: str
    above: bool
    cut: float

    def on(self, feats: dict[str, Column]) -> Column:
        return feats[self.feature] > self.cut if self.above else feats[self.feature] <= self.cut


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    rejected: int = 0
    mistaken: int = 0

    def on(self, feats: dict[str, Column]) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.on(feats)
        return out


@dataclass(frozen=True)
class DecisionList:
    rules: tuple[Rule, ...] = field(default=())

    def which(self, feats: dict[str, Column]) -> Column:
        """The number of the first rule that fires, from 0; null if none does."""
        out = F.lit(None).cast("int")
        for k, r in reversed(list(enumerate(self.rules))):
            out = F.when(r.on(feats), F.lit(k)).otherwise(out)
        return out

    def keeps(self, feats: dict[str, Column]) -> Column:
        return self.which(feats).isNull()


def _cuts(sample: DataFrame, names: Sequence[str], bins: int) -> dict[str, list[float]]:
    """Thresholds midway between neighbouring distinct quantiles, so that each has a margin on both sides."""
    found = sample.approxQuantile(list(names), [k / bins for k in range(bins + 1)], 0.001)
    values = {f: sorted(set(v)) for f, v in zip(names, found, strict=True)}
    return {f: [(a + b) / 2 for a, b in zip(v, v[1:])] for f, v in values.items()}


def _best_condition(rows: DataFrame, cuts: dict[str, list[float]], taken: set[tuple[str, bool]]) -> tuple[Condition, int, int] | None:
    """The threshold with the largest information gain on ``rows`` (columns: features, bad)."""
    binned = F.array(*[F.struct(F.lit(f).alias("f"), sum((F.col(f) > c).cast("int") for c in v).alias("b")) for f, v in cuts.items() if v])
    table = rows.select("bad", F.explode(binned).alias("x")).groupBy("x.f", "x.b").agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n"))
    counts: dict[str, dict[int, tuple[int, int]]] = {}
    for r in table.collect():  # at most features x bins rows
        counts.setdefault(r["f"], {})[r["b"]] = (r["p"], r["n"])
    best = None
    for f, by_bin in sorted(counts.items()):
        p_all, n_all = (sum(v[i] for v in by_bin.values()) for i in (0, 1))
        if not p_all:
            return None
        info = -math.log2(p_all / (p_all + n_all))
        for k, cut in enumerate(cuts[f]):
            p_low, n_low = (sum(v[i] for b, v in by_bin.items() if b <= k) for i in (0, 1))
            for above, p, n in ((False, p_low, n_low), (True, p_all - p_low, n_all - n_low)):
                if p and (f, above) not in taken:
                    gain = p * (info + math.log2(p / (p + n)))
                    if gain > 1e-9 and (best is None or gain > best[0]):
                        best = (gain, Condition(f, above, cut), p, n)
    return best and best[1:]


def learn_decision_list(
    labelled: DataFrame,
    *,
    bins: int = 32,
    max_rules: int = 6,
    max_conditions: int = 3,
    min_precision: float = 0.95,
    min_rejected: int = 5,
) -> DecisionList:
    """Sequential covering on rows with the feature columns, ``bad`` (0 or 1) and ``fold``.

    Two thirds of the rows (``fold`` > 0) grow a conjunction by information gain until it covers
    no good row; the rest prunes trailing conditions.  A rule is accepted if, on all rows that no
    earlier rule took, it rejects at least ``min_rejected`` bad rows at ``min_precision``.
    """
    names = [c for c in labelled.columns if c not in ("bad", "fold")]
    cuts = _cuts(labelled, names, bins)
    if not any(cuts.values()):  # no rows, or no feature that differs between them
        return DecisionList()
    feats = {f: F.col(f) for f in names}
    rules: list[Rule] = []
    left = labelled
    while len(rules) < max_rules:
        grow, conds = left.where("fold > 0"), []
        while len(conds) < max_conditions:
            found = _best_condition(grow, cuts, {(c.feature, c.above) for c in conds})
            if not found:
                break
            conds.append(found[0])
            grow = grow.where(found[0].on(feats))
            if not found[2]:
                break
        if not conds:
            break
        prefixes = [Rule(tuple(conds[: k + 1])) for k in range(len(conds))]
        sums = [F.coalesce(F.sum(F.when(r.on(feats) & w, v)), F.lit(0)).alias(f"{name}{k}") for k, r in enumerate(prefixes) for name, w, v in (("p", F.col("fold") == 0, F.col("bad")), ("n", F.col("fold") == 0, 1 - F.col("bad")), ("ap", F.lit(True), F.col("bad")), ("an", F.lit(True), 1 - F.col("bad")))]
        got = left.agg(*sums).first()
        worth = lambda k: ((got[f"p{k}"] + 1) / (got[f"p{k}"] + got[f"n{k}"] + 2), got[f"p{k}"], -k)
        best = max(range(len(prefixes)), key=worth)
        p, n = got[f"ap{best}"], got[f"an{best}"]
        if p < min_rejected or p < min_precision * (p + n):
            break
        rule = Rule(prefixes[best].conditions, int(p), int(n))
        rules.append(rule)
        left = left.where(~rule.on(feats))
    return DecisionList(tuple(rules))


def fit_quality(docs: DataFrame, labels: DataFrame, *, max_labelled: int = 20_000, **options) -> DecisionList:
    """Learns the list from the texts of labelled documents (``quality`` 0 is bad).

    At most ``max_labelled`` labelled ids take part, those with the smallest id hashes, so that
    the fit costs the same at every size; the rules then judge every document.
    """
    ids = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    known = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # at most max_labelled rows
    feats = features()
    rows = text_stats(known).select(
        *[v.alias(k) for k, v in feats.items()],
        (1 - F.least(F.greatest(F.col("quality"), F.lit(0)), F.lit(1))).cast("long").alias("bad"),
        F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(3)).alias("fold"),
    )
    return learn_decision_list(cut_lineage(rows), **options)


def judge(docs: DataFrame, rules: DecisionList, text: str = "text", prefix: str = "") -> DataFrame:
    """Adds the statistics, ``base_failed``, the ``rule`` that fired (null: none) and ``kept``."""
    out = text_stats(docs, text, prefix)
    out = out.withColumn(f"{prefix}base_failed", base_failed(prefix))
    out = out.withColumn(f"{prefix}rule", rules.which(features(prefix)))
    return out.withColumn(f"{prefix}kept", ~F.col(f"{prefix}base_failed") & F.col(f"{prefix}rule").isNull())


def keep_good(docs: DataFrame, labels: DataFrame, *, text: str = "text", prefix: str = "__quality_", **options) -> DataFrame:
    """The documents that pass the base rule and a list learned from ``docs``, with the columns of ``docs``."""
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    rules = fit_quality(docs.select("doc_id", F.col(f"`{text}`").alias("text")), labels, **options)
    judged = judge(docs, rules, text, prefix)
    # a filter that Spark pushes below the steps of text_stats would repeat every step in every use of it; it does not pass a row number
    judged = judged.withColumn(f"{prefix}row", F.monotonically_increasing_id())
    return judged.where(F.col(f"{prefix}kept") & (F.col(f"{prefix}row") >= 0)).select(*[F.col(f"`{c}`") for c in docs.columns])


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = fit_quality(docs, table(spark, sf_dir, "labels"))
    return judge(docs, rules).select("doc_id", *STATS[:5], "base_failed", "kept", "rule")
