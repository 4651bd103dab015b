"""URL filters: a sort-merge range join of url keys with the intervals of prefix rules.

A rule (host, path) fits its host and all subdomains where the url's path starts with the
rule's path.  With the host's labels reversed, ``com.example/`` + path is a canonical key in
which a rule is a prefix, hence an interval [key, key + 0xFF) in byte order; 0xFF never occurs
in UTF-8.  A url has one key for each host suffix that is as long as some rule's host.

All url keys and interval bounds are range-sorted together and swept once.  Intervals of one
host are nested, so the sweep's stack is encoded in the bounds: a start makes its rule the
innermost, an end makes the rule's parent innermost again.  Each sorted partition takes over
the innermost rule of the partitions before it.  Equal url keys are spread by a salt, so one
hot url or host fills no single partition.

Defined results: null urls and urls without ``://`` have an empty host and path and fit no rule;
repeated rows are judged alike; of rules with the same key the last in string order of its
verdict counts; the longest rule (code points of host and path) wins, then the longer host; with
no rules, or no rule that fits, the verdict is ``default``; a rule with an empty path fits all urls of its
host; rules with a null host or path fit nothing, a rule's host is lower-cased (A-Z) as urls' are, and one with a null verdict gives ``default``; very long urls are taken whole; an empty table gives an empty result; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsegrid.llm.common import ascii_lower, free_name, shuffle_partitions, small_or_plain, table, written

#: (host, path, verdict) as the contract of the query fixes them.
CONTRACT_RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
MAX_BROADCAST_PARTITIONS = 100_000


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return ascii_lower(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    u = F.coalesce(url, F.lit(""))
    at = F.locate("://", u)
    return F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise("")


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """A table (host, path, verdict) of a short rule list; longer lists are read as tables."""
    rows = [F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules]
    if not rows:
        return spark.createDataFrame([], "host string, path string, verdict string")
    return spark.range(1).select(F.inline(F.array(*rows)))


def _key(labels: Column, path: Column) -> Column:
    return F.encode(F.concat(F.array_join(labels, "."), F.lit("/"), path), "UTF-8")


def _labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\."))


def rule_bounds(rules: DataFrame) -> DataFrame:
    """Interval bounds (key, innermost, size, host_size, verdict): what is innermost from ``key`` on; null: nothing."""
    col = F.col
    one = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    one = one.select(_key(_labels(col("host")), col("path")).alias("key"), "host", F.struct(F.length(F.concat("host", "path")).alias("size"), F.length("host").alias("host_size"), F.concat("host", "path").alias("rule"), "verdict").alias("r"))
    ends = F.array(F.struct(col("key").alias("at"), F.lit(1).alias("step")), F.struct(F.concat("key", F.lit(bytearray(b"\xff"))).alias("at"), F.lit(-1).alias("step")))
    both = one.select("host", "r", F.inline(ends))
    depth = F.sum("step").over(Window.partitionBy("host").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    both = both.withColumn("level", F.when(col("step") > 0, depth).otherwise(depth + 1))  # of its own rule
    # the parent of a rule at a level is the rule that started last one level above
    as_parent = both.where("step > 0").select("host", "at", "level", F.lit(0).alias("asks"), col("r").alias("own"), col("r"), "step")
    as_child = both.select("host", "at", (col("level") - 1).alias("level"), F.lit(1).alias("asks"), F.lit(None).cast(one.schema["r"].dataType).alias("own"), "r", "step")
    seen = F.last("own", ignorenulls=True).over(Window.partitionBy("host", "level").orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, 0))
    out = as_parent.unionByName(as_child).withColumn("parent", seen).where("asks = 1")
    return out.select(col("at").alias("key"), F.when(col("step") > 0, col("r")).otherwise(col("parent")).alias("r"))


def longest_rules(keys: DataFrame, rules: DataFrame) -> DataFrame:
    """``keys`` (id long, key binary) with the innermost rule ``r`` of each; rows without one are left out."""
    spark, col = keys.sparkSession, F.col
    bounds = rule_bounds(rules)
    events = bounds.select("key", F.lit(0).alias("what"), F.lit(None).cast("long").alias("id"), F.struct(col("r").alias("r")).alias("now"))
    events = events.unionByName(keys.select("key", F.lit(1).alias("what"), "id", F.lit(None).cast(events.schema["now"].dataType).alias("now")))
    dealt = events.withColumn("salt", F.xxhash64("id")).repartitionByRange(shuffle_partitions(spark), "key", "what", "salt")
    dealt = written(dealt.withColumn("part", F.spark_partition_id()))
    last = dealt.where("what = 0").groupBy("part").agg(F.max_by("now", "key").alias("now"))
    parts = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n")).join(last, "part", "left")
    before = F.last("now", ignorenulls=True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    carried = parts.select("part", before.alias("carried"))  # a row for each partition
    here = F.last("now", ignorenulls=True).over(Window.partitionBy("part").orderBy("key", "what").rowsBetween(Window.unboundedPreceding, 0))
    swept = dealt.withColumn("here", here).where("what = 1").join(small_or_plain(carried, shuffle_partitions(spark), MAX_BROADCAST_PARTITIONS), "part")
    found = swept.select("id", F.coalesce(col("here"), col("carried"))["r"].alias("r"))
    return found.where("r is not null")


def filter_urls(pages: DataFrame, rules: DataFrame, *, url: str = "url", default: str = "allow") -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` and ``verdict`` to ``pages`` (columns of those names are replaced)."""
    rules = rules.where("host is not null and path is not null").withColumn("host", ascii_lower(F.col("host")))
    col, kept = F.col, [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    number, best = free_name(pages, "id"), free_name(pages, "rule")
    rows = pages.select(*[col(f"`{c}`") for c in kept], url_host(col(f"`{url}`")).alias("host"), url_path(col(f"`{url}`")).alias("path"), F.monotonically_increasing_id().alias(number))
    rows = written(rows)
    sizes = sorted(r[0] for r in rules.select(F.size(F.split("host", r"\.")).alias("n")).distinct().collect())  # as many as hosts have labels
    suffixes = [F.when(F.size("labels") >= n, F.struct(F.slice("labels", 1, n).alias("s"))) for n in sizes]
    found = rows.limit(0).select(col(number), F.lit(None).cast("struct<size:int,host_size:int,rule:string,verdict:string>").alias(best))
    if suffixes:
        keys = rows.where("host <> '' or path <> ''").select(col(number).alias("id"), "path", _labels(col("host")).alias("labels"))
        keys = keys.select("id", "path", F.inline(F.array_compact(F.array(*suffixes)))).select("id", _key(col("s"), col("path")).alias("key"))
        found = longest_rules(keys, rules).groupBy("id").agg(F.max("r").alias(best)).withColumnRenamed("id", number)
    out = rows.join(found, number, "left")
    return out.select(*[col(f"`{c}`") for c in kept], "host", "path", col(f"{best}.rule").alias("rule"), F.coalesce(f"{best}.verdict", F.lit(default)).alias("verdict"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, rule_table(spark, CONTRACT_RULES)).drop("url")


OP2_SQL = r"""
WITH p AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p
), r(rhost, rpath, verdict) AS (
  VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
), m AS (
  SELECT page_id, host, path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
  FROM h LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY page_id, host, path
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m
"""
