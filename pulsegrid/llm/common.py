"""Helpers that several training-data operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.operators.storage import cut_lineage, shared_folder

#: Word separators of the white-space rule: space and the controls from tab to carriage return.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
#: Separators of the alphanumeric rule on text that is not yet lower-cased: every other ASCII character.
NON_ALNUM_CLASS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def space_words(text: Column) -> Column:
    """The words of a text by white space; a null text has none."""
    return F.array_remove(F.split(text_or_empty(text), SPACE_CLASS), "")


def alnum_words(text: Column) -> Column:
    """The runs of ASCII letters, digits and non-ASCII characters; not lower-cased, null has none."""
    return F.array_remove(F.split(text_or_empty(text), NON_ALNUM_CLASS), "")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone."""
    return F.translate(text, UPPER, LOWER)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_or_plain(df: DataFrame, rows: int, max_rows: int) -> DataFrame:
    """``df`` marked for broadcasting if its counted rows are within the bound, else as it is."""
    return F.broadcast(df) if rows <= max_rows else df


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have, whatever extra columns it brings."""
    taken, name = {c.lower() for c in df.columns}, f"__{stem}"
    while name.lower() in taken:
        name += "_"
    return name


#: Lists that take the paths of tables as they are written; see ``tables_noted``.
_noting: list[list[str]] = []


@contextmanager
def tables_noted() -> Iterator[list[str]]:
    """A list that takes the path of every table that is written in this block, so that they can be deleted once nothing reads them."""
    own: list[str] = []
    _noting.append(own)
    try:
        yield own
    finally:
        _noting[:] = [x for x in _noting if x is not own]


def written(df: DataFrame) -> DataFrame:
    """Writes ``df`` as a Parquet table in the shared folder and returns what reads it back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    for own in _noting:
        own.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_tables(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables of ``written``, wherever the shared folder is, and empties the list."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    paths.clear()


def numbered(docs: DataFrame, *columns: Column, row: str = "row") -> DataFrame:
    """``columns`` of ``docs`` after a row number, written once.

    The numbers follow the order of the scan, which depends on how the files are split; reading them back
    keeps them the same for all that comes after, whatever executors come and go.
    """
    return written(docs.select(F.monotonically_increasing_id().alias(row), *columns))


def numbered_by_place(docs: DataFrame, *columns: Column, row: str = "row", write: bool = True) -> DataFrame:
    """``columns`` of ``docs`` after a row number, which follows the files' paths and the rows' places in them and so does not depend on how files are split.

    The rows are written once, unless ``write`` is false: then they must be rows of a Parquet table one by one, which are the same at each reading.
    Where they are not, as after a union or a join, numbers follow the scan.  Numbers begin at 0 and leave out only what a filter left out.
    """
    col, part, at = F.col, free_name(docs, "part"), free_name(docs, "at")
    try:
        rows = docs.select(col("_metadata.file_path").alias(part), col("_metadata.row_index").alias(at), *columns)
    except AnalysisException:
        rows = None
    if rows is not None and write:
        rows = written(rows)
        if rows.count() != rows.select(part, at).where(col(part).isNotNull() & col(at).isNotNull()).distinct().count():
            rows = None
    if rows is None:
        number = numbered(docs, *columns, row=at)
        rows = number.select(F.shiftright(at, 33).alias(part), col(at).bitwiseAND(2**33 - 1).alias(at), *[col(f"`{c}`") for c in number.columns[1:]])
    begin, starts = 0, []
    for x in sorted(rows.groupBy(part).agg((F.max(at) + 1).alias("n")).collect()):  # a row for each file
        starts.append((x[0], begin))
        begin += x["n"]
    own, start = rows.columns[2:], free_name(docs, "start")
    kind = rows.schema[part].dataType.simpleString()
    starts = docs.sparkSession.createDataFrame(starts, f"`{part}` {kind}, `{start}` long")
    return rows.join(F.broadcast(starts), part).select((col(start) + col(at)).alias(row), *[col(f"`{c}`") for c in own])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
