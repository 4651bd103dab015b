"""SentencePiece encoding and decoding by a table of each prefix's last token.

The tokenizer merges neighbouring symbols by the score of what they make, the leftmost of equal ones first.  For every
prefix of a text that gives one row of tokens, so one last token.  A piece that ends where the prefix ends is that token exactly if the
last token of what stands before it is *compatible* with it: encoded together, the two stay two.  A row of
tokens is what the merges give if and only if all its neighbours are compatible, as until a first merge
across a bound each token goes through its own merges in the same order as alone.

An Aho-Corasick automaton names the pieces that end at each place, the longest first; the table keeps the compatible one, and the ids are
recovered backwards from the end.  Compatibility is told from the two tokens' own merges: they are run side by side, the
better score first, until a merge across the bound beats both.

Texts are cut where no piece of the vocabulary can reach across: before a space after another character, and around
characters that no longer piece holds.  What the cut gives is met again and again; each worker keeps a bounded cache of it.  A text without such
places is one unit, and its time is linear in its length all the same.

Defined results: a null text counts as empty and has the begin and end ids alone; special strings in a text are ordinary text, as in the
library; characters without a piece become the ids of their bytes; texts are read whole, whatever their length; repeated rows give the same result; merges of equal score are made
from the left; an empty table gives an empty result; only the columns named in ``keep`` are read and
returned, so extra columns, whatever their names, change nothing.  Decoding: null ids give null, bytes that are no UTF-8 give U+FFFD each, and ids outside the vocabulary raise.
Models with user-defined symbols or a normaliser of their own raise ``ValueError``.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from math import inf

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.common import table

SPACE = "▁"
MAX_CACHED = 600_000
MAX_CACHED_CHARS = 64
MAX_PAIRS = 2_000_000
SLICE = 256
MODEL = "piece_bpe_32k.model"


class Pieces:
    """One vocabulary: pieces by id, their scores, their own merges and the automaton.

    Tokens are ids; a character without a piece is a token of its own, numbered from the end of the vocabulary on.
    """

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        probe = "  Ａ ﬁ  x\t "
        if sp.normalize(probe) != SPACE + probe.replace(" ", SPACE):
            raise ValueError("the model's normaliser changes more than spaces")
        self.size, self.unknown, self.begin, self.end = sp.vocab_size(), sp.unk_id(), sp.bos_id(), sp.eos_id()
        self.text = [sp.id_to_piece(i) for i in range(self.size)]
        self.byte_id, self.byte_of, self.silent = {}, {}, set()
        self.ids: dict[str, int] = {}
        for i, p in enumerate(self.text):
            if sp.is_byte(i):
                self.byte_id[int(p[3:5], 16)] = i
                self.byte_of[i] = bytes([int(p[3:5], 16)])
            elif sp.is_control(i):
                self.silent.add(i)
            elif not sp.is_unknown(i):
                self.ids[p] = i
        self.score = {p: sp.get_score(i) for p, i in self.ids.items()}
        long = [p for p in self.ids if len(p) > 1]
        joining = {c for p in long for c in p}
        letters = {c for c in joining if c.isalpha()}
        others = joining - letters - {SPACE}
        shut = lambda before, after: not any(x in before and y in after for p in long for x, y in zip(p, p[1:], strict=False))
        among = lambda chars: "".join(map(re.escape, sorted(chars)))
        self.unit = re.compile(r"(?s).+")
        if shut(joining - {SPACE}, {SPACE}) and shut(letters, others):
            self.unit = re.compile(f"{SPACE}*[{among(others)}]+[{among(letters)}]*|{SPACE}*[{among(letters)}]+|{SPACE}+|[^{among(joining)}{SPACE}]")
        self.alone = [c for c in sorted(joining) if c not in self.ids]
        for i, c in enumerate(self.alone):  # characters that only longer pieces hold
            self.text.append(c)
            self.ids[c] = self.size + i
        self.foreign = re.compile(f"([^{among({c for p in self.ids for c in p})}])")
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        self.length = [len(p) for p in self.text]
        self.merges: dict[int, tuple | None] = {}
        self.compatible: dict[int, bool] = {}

    def own_merges(self, token: int) -> tuple | None:
        """Scores of a token's merges in their order, with the first and last symbol before each and after all; None if they don't end in the token."""
        if token in self.merges:
            return self.merges[token]
        symbols, scores = list(self.text[token]), []
        ends = [(symbols[0], symbols[-1])]
        while len(symbols) > 1:
            best, at = max((self.score.get(a + b, -inf), -i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)))
            if best == -inf:
                break
            symbols[-at : 2 - at] = [symbols[-at] + symbols[1 - at]]
            scores.append(best)
            ends.append((symbols[0], symbols[-1]))
        self.merges[token] = (scores, ends) if len(symbols) == 1 else None
        return self.merges[token]

    def stays(self, a: int, b: int) -> bool:
        """Whether two neighbouring tokens stay as they are when they are encoded together."""
        left, right = self.own_merges(a), self.own_merges(b)
        if left is None or right is None:
            return False
        (sa, ea), (sb, eb), i, j = left, right, 0, 0
        while True:
            across = self.score.get(ea[i][1] + eb[j][0], -inf)
            x, y = sa[i] if i < len(sa) else -inf, sb[j] if j < len(sb) else -inf
            if across > x and across >= y and across > -inf:
                return False
            if x == y == -inf:
                return True
            if x >= y:
                i += 1
            else:
                j += 1

    def encoded(self, units: list[str]) -> list[list[int]]:
        """The tokens of each unit.  All units are read as one text, in which a line feed of its own ends each."""
        joined = "\n" + "\n".join(units)
        size, length, known = len(self.text) + 1, self.length, self.compatible
        last = [size - 1] * len(joined)  # the last token of what ends here; before a unit, a mark that no token has
        told = bytearray(len(joined))
        for end, token in self.automaton.iter(joined):
            if not told[end]:
                key = last[end - length[token]] * size + token
                ok = known.get(key)
                if ok is None:
                    if len(known) >= MAX_PAIRS:
                        known.clear()
                    before = last[end - length[token]]
                    ok = known[key] = self.own_merges(token) is not None if before == size - 1 else self.stays(before, token)
                if ok:
                    last[end], told[end] = token, 1
        out, at = [], 0
        for u in units:
            start, at = at + 1, at + 1 + len(u)
            end, found = at - 1, []
            while end >= start:
                token = last[end]
                found.append(token)
                end -= length[token]
            found.reverse()
            out.append(found)
        return out

    def spelled(self, tokens: list[int]) -> list[int]:
        """Ids of the vocabulary: characters without a piece as their bytes, or as unknown if the model has no bytes."""
        if max(tokens, default=0) < self.size:
            return tokens
        out: list[int] = []
        for t in tokens:
            out.extend([t] if t < self.size else self.fallback(self.text[t]))
        return out

    def fallback(self, char: str) -> list[int]:
        return [self.byte_id[b] for b in char.encode("utf-8", "surrogatepass")] if self.byte_id else [self.unknown]

    def unit_ids(self, units: list[str]) -> list[list[int]]:
        """The ids of each unit.  Characters that no piece holds stand alone; what is left goes through the table."""
        parts = [[x for x in self.foreign.split(u) if x] if self.foreign.search(u) else [u] for u in units]
        inner = list(dict.fromkeys(x for own in parts for x in own if not (len(x) == 1 and x not in self.ids)))
        found = dict(zip(inner, self.encoded(inner), strict=True))
        return [[i for x in own for i in (self.spelled(found[x]) if x in found else self.fallback(x))] if len(own) > 1 or own[0] not in found else self.spelled(found[own[0]]) for own in parts]

    def decoded(self, ids: Iterable[int], first: bool = True) -> str:
        """The text of ``ids``; the space that was put before a text is taken off the ``first`` piece."""
        if not first and self.byte_of.keys().isdisjoint(ids) and self.silent.isdisjoint(ids):
            return "".join([self.text[i] for i in ids]).replace(SPACE, " ")
        out: list[str] = []
        waiting = b""
        for i in ids:
            if not 0 <= i < self.size:
                raise ValueError(f"no piece has the id {i}")
            if i in self.byte_of:
                waiting += self.byte_of[i]
                continue
            if waiting:
                out.append(utf8(waiting))
                waiting = b""
            if i in self.silent:
                continue
            piece = " ⁇ " if i == self.unknown else self.text[i]
            if first and not out and piece.startswith(SPACE):
                piece = piece[1:]
                first = False
            out.append(piece.replace(SPACE, " "))
        return "".join(out) + (utf8(waiting) if waiting else "")


def utf8(data: bytes) -> str:
    """Bytes as text, each that belongs to no character as U+FFFD."""
    try:
        return data.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(data):
            for n in (1, 2, 3, 4):
                try:
                    out.append(data[at : at + n].decode())
                except UnicodeDecodeError:
                    continue
                at += n
                break
            else:
                out.append("�")
                at += 1
        return "".join(out)


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


@lru_cache(maxsize=2)
def cache_of(path: str) -> dict[str, tuple[bytes, str]]:
    """Ids and decoded text of units that a worker process has met; worth keeping from task to task, never needed."""
    return {}


def packed_ids(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def encode_batch(texts: list[str | None], p: Pieces, cache: dict[str, tuple[bytes, str]]) -> Iterator[tuple[bytes, str]]:
    """(ids as little-endian unsigned 32-bit integers, decoded text) of each whole text; new units of the batch are encoded together."""
    split, rows, new = p.unit.findall, [], {}
    for t in texts:
        units = split(f"{SPACE}{t.replace(' ', SPACE)}") if t else []
        found = list(map(cache.get, units))
        missing = [(i, units[i]) for i, x in enumerate(found) if x is None] if None in found else []
        new.update(dict.fromkeys(u for _, u in missing))
        rows.append((found, missing))
    ids = p.unit_ids(list(new))
    new.update((u, (packed_ids(x), p.decoded(x, first=False))) for u, x in zip(new, ids, strict=True))
    begin, end = packed_ids([p.begin]), packed_ids([p.end])
    for found, missing in rows:
        for i, u in missing:
            found[i] = new[u]
        yield begin + b"".join([x for x, _ in found]) + end, "".join([x for _, x in found])[1:]
    if len(cache) + len(new) > MAX_CACHED:
        cache.clear()
    cache.update((u, x) for u, x in new.items() if len(u) <= MAX_CACHED_CHARS)


def encode_pieces(docs: DataFrame, *, model: str = MODEL, text: str = "text", keep: tuple[str, ...] = ("doc_id",), packed: bool = False) -> DataFrame:
    """The columns ``keep``, the ids with begin and end of each whole text, and what they decode to.

    ``ids`` is an array of integers; ``packed``, little-endian unsigned 32-bit integers in one binary value.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = public_tokenizers.path(model)
        p, cache = pieces(path), cache_of(path)
        for b in it:
            for start in range(0, b.num_rows, SLICE):
                part = b.slice(start, SLICE)
                ids, decoded = zip(*encode_batch(part.column(len(keep)).to_pylist(), p, cache), strict=True)
                if packed:
                    column = pa.array(ids, pa.binary())
                else:
                    offsets = np.cumsum([0, *(len(x) // 4 for x in ids)])
                    column = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4")))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), column, pa.array(decoded, pa.string())], names=[*keep, "ids", "decoded"])

    rows = docs.select(*[f"`{k}`" for k in keep], f"`{text}`")
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keep)
    return rows.mapInArrow(batches, f"{kinds}, ids {'binary' if packed else 'array<int>'}, decoded string")


def decode_pieces(rows: DataFrame, *, model: str = MODEL, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and the text that each array of ids stands for."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(public_tokenizers.path(model))
        for b in it:
            found = [None if x is None else p.decoded(x) for x in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(found, pa.string())], names=[*keep, "decoded"])

    own = rows.select(*[f"`{k}`" for k in keep], f"`{ids}`")
    kinds = ", ".join(f"`{k}` {own.schema[k].dataType.simpleString()}" for k in keep)
    return own.mapInArrow(batches, f"{kinds}, decoded string")


def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = encode_pieces(table(spark, sf_dir, "documents").select("doc_id", "text"), packed=True)
    return rows.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
