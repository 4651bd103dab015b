"""Text cascades: a block of ``id,name`` lines, a blank line, then ``meme;site,t,site,t,...`` lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

col = F.col


def read_cascades(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(sites (site_id, name), cascades (meme_id, position, site_id, t)); a line with an odd number of fields is an error."""
    lines = spark.read.text(path)
    is_cascade = col("value").contains(";")
    sites = lines.where(~is_cascade & (F.trim("value") != "")).select(F.split("value", ",", 2).alias("f")).select(F.trim(col("f")[0]).alias("site_id"), F.trim(col("f")[1]).alias("name"))
    parts = lines.where(is_cascade).select(F.split("value", ";", 2).alias("p")).select(F.trim(col("p")[0]).alias("meme_id"), F.split(F.trim(col("p")[1]), ",").alias("f"))
    checked = F.when(F.size("f") % 2 == 0, col("f")).otherwise(F.raise_error(F.concat(F.lit("odd number of fields in cascade "), col("meme_id"))).cast("array<string>"))
    parts = parts.select("meme_id", checked.alias("f"))
    pairs = F.transform(F.sequence(F.lit(0), (F.size("f") / 2 - 1).cast("int")), lambda i: F.struct(F.trim(F.get(col("f"), 2 * i)).alias("site_id"), F.get(col("f"), 2 * i + 1).cast("double").alias("t")))
    return sites, parts.select("meme_id", F.posexplode(pairs).alias("position", "x")).select("meme_id", "position", "x.site_id", "x.t")


def flatten_cascades(cascades: DataFrame, *, keep_first_only: bool = True, delay: float = 0.0, seed: int = 0) -> DataFrame:
    """(site_id, t) without collisions: of equal times the first, or the first of each site, delayed by cumulated half-normal steps."""
    order = ["meme_id", "position"]
    if keep_first_only:
        first = F.row_number().over(Window.partitionBy("t").orderBy(*order))
        return cascades.withColumn("r", first).where("r = 1").select("site_id", "t")
    first = F.row_number().over(Window.partitionBy("t", "site_id").orderBy(*order))
    rows = cascades.withColumn("r", first).where("r = 1")
    u = lambda k: (F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "t", "site_id"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    step = F.abs(F.sqrt(-2 * F.log(u(1))) * F.cos(2 * F.pi() * u(2))) * delay
    w = Window.partitionBy("t").orderBy(*order)
    moved = rows.withColumn("step", F.when(F.row_number().over(w) == 1, 0.0).otherwise(step))
    return moved.select("site_id", (col("t") + F.sum("step").over(w)).alias("t"))


def rescale_times(events: DataFrame, factor: float, low: float, high: float) -> DataFrame:
    """t * factor within [low, high], counted from low."""
    t = col("t") * factor
    return events.where(t.between(low, high)).withColumn("t", t - low)


def read_lookup(spark: SparkSession, path: str, names: list[str], header: bool = False) -> DataFrame:
    """A ``;``-separated table of strings."""
    rows = spark.read.csv(path, sep=";", header=header, encoding="UTF-8")
    return rows.select(*[F.trim(F.regexp_replace(col(f"`{c}`"), "^﻿", "")).alias(n) for c, n in zip(rows.columns, names)])


def ends_with(url: Column, ext: Column) -> Column:
    """Whether the url ends with the suffix and is longer."""
    return F.endswith(url, ext) & (F.length(url) > F.length(ext))


def longest_suffix(urls: DataFrame, suffixes: DataFrame, url: str = "url") -> DataFrame:
    """Adds the country of the longest of ``suffixes`` (suffix, country) that ends the url: equi-joins on its dotted suffixes."""
    labels = F.split(col(url), r"\.")
    tails = F.transform(F.sequence(F.lit(2), F.size(labels)), lambda k: F.concat(F.lit("."), F.array_join(F.slice(labels, k, F.size(labels)), ".")))
    each = urls.select(col(url), F.explode(F.when(F.size(labels) > 1, tails)).alias("suffix")).distinct()
    found = each.join(suffixes, "suffix").groupBy(url).agg(F.max(F.struct(F.length("suffix").alias("n"), "country")).alias("best"))
    return urls.join(found, url, "left").withColumn("country", col("best.country")).drop("best")
