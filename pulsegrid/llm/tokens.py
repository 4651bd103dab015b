"""Token counts: byte-level BPE by rank-synchronous merging of ragged numpy arrays.

A text is split into pre-tokens by the tokenizer's pattern.  The pre-tokens of a batch that were not
met before are held as one ragged array of symbol ids.  In each round every sequence finds
its lowest-rank pair by a segmented minimum, all its pairs of that rank are merged from left to
right at once, and sequences without a ranked pair leave the array; their surviving symbols are
their count.  A pair that holds a new symbol always ranks after the merge that made it, so the
rounds give what merging one pair at a time gives.

Counts of short pre-tokens are kept in a cache of bounded size for each worker.

Defined results: a null text counts as empty and has 0 tokens; special strings inside a text count
as one token each, the library's default; repeated rows count alike; texts are read whole,
whatever their length; pairs of equal rank are merged from the left; an empty table gives an empty result; only the columns named in ``keep`` are
read and returned, so extra columns, whatever their names, change nothing.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from pulsegrid.llm.common import table

LIMIT = 512
MAX_CACHED = 1_000_000
MAX_CACHED_CHARS = 64
NO_RANK = np.int64(1) << 40
#: The tokenizer library's white space is Unicode's property, without the separators from 1C to 1F.
PATTERN = public_tokenizers.PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
#: The same for ASCII texts, where the standard library's engine is faster.
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r 0-9A-Za-z]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}


class Merger:
    """Merge ranks of one vocabulary as sorted arrays of pair keys."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.width = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made
        self.first = np.zeros(256, np.int64)
        for char, byte in byte_symbols().items():
            self.first[byte] = vocab[char]
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.width + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK)

    def counts(self, pieces: list[bytes]) -> np.ndarray:
        """How many symbols survive in each non-empty piece."""
        out = np.fromiter(map(len, pieces), np.int64, len(pieces))
        data = self.first[np.frombuffer(b"".join(pieces), np.uint8)]
        which = np.repeat(np.arange(len(pieces)), out)
        rank = np.full(len(data), NO_RANK)  # of the pair that begins at a symbol
        if len(data) > 1:
            rank[:-1] = np.where(which[1:] == which[:-1], self.rank(data[:-1], data[1:]), NO_RANK)
        while len(data):
            starts = np.flatnonzero(np.r_[True, which[1:] != which[:-1]])
            sizes = np.diff(np.r_[starts, len(data)])
            least = np.minimum.reduceat(rank, starts)
            out[which[starts]] = sizes
            live = least < NO_RANK
            if not live.all():
                keep = np.repeat(live, sizes)
                data, which, rank, sizes, least = data[keep], which[keep], rank[keep], sizes[live], least[live]
                if not len(data):
                    break
            hit = rank == np.repeat(least, sizes)
            # of pairs that overlap, as in a run of one symbol, every other one merges
            at = np.flatnonzero(hit)
            run = np.cumsum(np.r_[True, np.diff(at) != 1])
            nth = np.arange(len(at)) - np.searchsorted(run, run)
            at = at[nth % 2 == 0]
            data[at] = self.made[rank[at]]
            gone = np.zeros(len(data), bool)
            gone[at + 1] = True
            changed = np.zeros(len(data), bool)
            changed[at] = True
            changed[at[at > 0] - 1] = True
            keep = ~gone
            data, which, rank, changed = data[keep], which[keep], rank[keep], changed[keep]
            todo = np.flatnonzero(changed)
            last = todo[todo == len(data) - 1]
            rank[last] = NO_RANK
            todo = todo[todo < len(data) - 1]
            same = which[todo] == which[todo + 1]
            rank[todo[~same]] = NO_RANK
            todo = todo[same]
            rank[todo] = self.rank(data[todo], data[todo + 1])
        return out


@lru_cache(maxsize=4)
def merger(path: str) -> Merger:
    return Merger(path)


@lru_cache(maxsize=4)
def cache_of(path: str) -> dict[str, int]:
    """Counts that a worker process has met; worth keeping from task to task, never needed."""
    return {}


def count_batch(texts: list[str | None], m: Merger, cache: dict[str, int], ascii_split, any_split, special) -> list[int]:
    """Token counts of whole texts; new pre-tokens of the batch are merged together."""
    rows, new = [], {}
    for t in texts:
        parts = special.split(t or "")
        found = [x for p in parts for x in (ascii_split if p.isascii() else any_split)(p)] if len(parts) > 1 else (ascii_split if parts[0].isascii() else any_split)(parts[0])
        counts = list(map(cache.get, found))
        missing = [p for p, n in zip(found, counts, strict=True) if n is None] if None in counts else []
        new.update(dict.fromkeys(missing))
        rows.append((sum(filter(None, counts)) + len(parts) - 1, missing))
    if new:
        new = dict(zip(new, m.counts([p.encode("utf-8", "surrogatepass") for p in new]).tolist(), strict=True))
        if len(cache) + len(new) > MAX_CACHED:
            cache.clear()
        cache.update((p, n) for p, n in new.items() if len(p) <= MAX_CACHED_CHARS)
    return [n + sum(map(new.__getitem__, missing)) for n, missing in rows]


def count_tokens(docs: DataFrame, *, tokenizer: str = "byte_bpe_50k.json", limit: int = LIMIT, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of each document, n_bytes, n_tokens and over_limit of its whole text."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(public_tokenizers.path(tokenizer))
        special = re.compile("|".join(map(re.escape, sorted(m.specials, key=len, reverse=True))) or r"(?!)")
        ascii_split, any_split = re.compile(ASCII_PATTERN).findall, regex.compile(PATTERN).findall
        cache = cache_of(public_tokenizers.path(tokenizer))
        for b in it:
            for start in range(0, b.num_rows, 256):
                part = b.slice(start, 256)
                texts = part.column(len(keep)).to_pylist()
                n = pa.array(count_batch(texts, m, cache, ascii_split, any_split, special), pa.int64())
                size = pa.array([len((t or "").encode("utf-8", "surrogatepass")) for t in texts], pa.int64())
                over = pa.array([x > limit for x in n.to_pylist()], pa.bool_())
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), size, n, over], names=[*keep, "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(*[f"`{k}`" for k in keep], f"`{text}`")
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keep)
    return rows.mapInArrow(batches, f"{kinds}, n_bytes long, n_tokens long, over_limit boolean")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))
