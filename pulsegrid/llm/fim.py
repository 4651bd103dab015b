"""Fill-in-middle: texts cut in prefix, middle and suffix and put together anew, over run-length coded character classes.

A text is a row of units: a word of ASCII letters, or any other single character.  It is held as maximal runs of characters of one
class (letters, or other characters of the same width in UTF-8) with the cumulative numbers of units, characters and bytes before each.  A cut
after u units is found by binary search of the run that holds the unit, and its offset is arithmetic: a
word is one unit, so a cut stands at its start; in any other run each unit is one character of known width.  Runs of a whole
batch are one ragged array, so no text is walked character by character.

Two hashes of the row's id choose the cuts, a third whether the text stays plain, a fourth the order: ``psm`` writes prefix, suffix, middle, ``spm``
suffix, prefix, middle, each after its mark.

Defined results: a null or empty text is plain and empty; a text that holds a mark is plain, as its form could not be undone; equal cuts give an
empty middle; repeated rows give the same result, as it depends on id and text alone; a null id is hashed as an empty one; texts are taken whole,
whatever their length; an empty table gives an empty result; only the columns named in ``keep`` are read and returned, so extra columns, whatever
their names, change nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.common import table

MARKS = ("<P>", "<S>", "<M>")
PLAIN_PERCENT, SPM_PERCENT, SEED = 10, 20, 1
SLICE = 512
#: By first byte: 0 for letters, else the width of the character; bytes within a character have none.
CLASS_OF = np.array([0 if chr(b).isalpha() and b < 128 else 1 if b < 128 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4 for b in range(256)], np.uint8)


class Runs:
    """The runs of many texts that stand one after another in ``data`` and end at the byte offsets ``ends``."""

    def __init__(self, data: np.ndarray, ends: np.ndarray):
        rows = np.r_[0, ends]
        # the bytes where characters begin; without others than ASCII, all of them
        chars = np.flatnonzero((data & 0xC0) != 0x80) if len(data) and data.max() > 127 else np.arange(len(data))
        kind = CLASS_OF[data[chars]]
        row_chars = np.searchsorted(chars, rows)
        new = np.zeros(len(chars) + 1, bool)
        new[1:-1] = kind[1:] != kind[:-1]
        new[row_chars] = True
        new[-1] = False
        first = np.flatnonzero(new)
        self.width = np.r_[kind[first], np.uint8(0)].astype(np.int64)
        self.chars = np.r_[first, len(chars)]  # characters before each run, and at the end
        self.bytes = np.r_[chars[first], len(data)]
        units = np.where(self.width[:-1] == 0, 1, np.diff(self.chars))
        self.units = np.r_[0, np.cumsum(units)]
        at = np.searchsorted(self.chars, row_chars)
        self.base, self.base_chars = self.units[at][:-1], row_chars[:-1]
        self.n = np.diff(self.units[at])

    def cut(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(byte in ``data``, characters from the text's start) after so many units of each text."""
        sought = self.base + units
        run = np.searchsorted(self.units, sought, side="right") - 1
        inside = sought - self.units[run]
        return self.bytes[run] + self.width[run] * inside, self.chars[run] + inside - self.base_chars


def choices(doc_id: Column, seed: int = SEED) -> list[Column]:
    """Four numbers of 32 bits from the hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def joined(part: bytes, middle: bytes, suffix: bytes, spm: bool, marks: tuple[bytes, bytes, bytes]) -> bytes:
    p, s, m = marks
    return s + suffix + p + part + m + middle if spm else p + part + s + suffix + m + middle


def fill_in_middle(
    docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", keep: tuple[str, ...] = ("doc_id",), seed: int = SEED, plain_percent: int = PLAIN_PERCENT, spm_percent: int = SPM_PERCENT, marks: tuple[str, str, str] = MARKS
) -> DataFrame:
    """The columns ``keep``, n (units), form, prefix_chars, middle_chars and the transformed ``output`` of each whole text."""
    own = tuple(m.encode() for m in marks)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(keep)
        for b in it:
            for start in range(0, b.num_rows, SLICE):
                part = b.slice(start, SLICE)
                texts = [t or b"" for t in part.column(k).cast(pa.binary()).to_pylist()]
                ends = np.cumsum([len(t) for t in texts])
                runs = Runs(np.frombuffer(b"".join(texts), np.uint8), ends)
                h1, h2, h3, h4 = (part.column(k + 1 + i).to_numpy() for i in range(4))
                low, high = np.minimum(h1 % (runs.n + 1), h2 % (runs.n + 1)), np.maximum(h1 % (runs.n + 1), h2 % (runs.n + 1))
                (a, a_chars), (c, c_chars) = runs.cut(low), runs.cut(high)
                begins = ends - [len(t) for t in texts]
                plain = np.array([not t or any(m in t for m in own) for t in texts]) | (h3 % 100 >= 100 - plain_percent)
                spm = h4 % 100 < spm_percent
                out = [t if p else joined(t[:x], t[x:y], t[y:], s, own) for t, p, x, y, s in zip(texts, plain.tolist(), (a - begins).tolist(), (c - begins).tolist(), spm.tolist(), strict=True)]
                form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
                columns = [pa.array(runs.n), pa.array(form, pa.string()), pa.array(a_chars, pa.int64(), mask=plain), pa.array(c_chars - a_chars, pa.int64(), mask=plain), pa.array(out, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(k)), *columns], names=[*keep, "n", "form", "prefix_chars", "middle_chars", "output"])

    rows = docs.select(*[f"`{c}`" for c in keep], f"`{text}`", *choices(F.col(f"`{doc_id}`"), seed))
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(batches, f"{kinds}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The exact text that an output of ``fill_in_middle`` stands for."""
    parts = F.split(output, "|".join(map(re.escape, marks)))
    one, two, three = (F.get(parts, F.lit(i)) for i in (1, 2, 3))
    return F.when(form == "plain", output).when(form == "spm", F.concat(two, three, one)).otherwise(F.concat(one, three, two))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


OP11_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), e AS (
  SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u, CAST('0x' || h[1:8] AS BIGINT) AS h1,
    CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
  FROM d
), f AS (
  SELECT doc_id, t, u, CAST(len(u) AS BIGINT) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM e
), g AS (
  SELECT doc_id, t, n, form, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM f
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM g
"""
