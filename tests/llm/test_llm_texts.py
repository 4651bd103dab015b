"""Fill-in-middle, ranked search and piece encoding against brute force and the library, on small tables with odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import fim, pieces, search

public_tokenizers = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, n string, ids string, output int, score string, terms int, __row int"


def rows_of(spark, texts):
    return spark.createDataFrame([(None if i == 3 else i, t, "n", "ids", 1, "s", 2, 3) for i, t in enumerate(texts)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(11)
    alphabet = "abcdefgh  \n▁0123456789éüß你好🤷.,;-<>/()\t\x00Ωж"
    out = [None, "", " ", "   ", "a", "\n", "x<P>y", "<", "a<S", "M>b", "▁▁ ▁x", "a\x00b", "aaa aaa" * 9, "word " * 4000, "z" * 3000, "你好" * 500, "hello <s> </s> <unk> <0x41>"]
    out += ["".join(r.choice(alphabet) for _ in range(r.randrange(1, 80))) for _ in range(300)]
    return [*out, out[20], out[20]]


def test_fill_in_middle_equals_brute_force(spark, texts):
    docs = rows_of(spark, texts)
    got = fim.fill_in_middle(docs, keep=("doc_id", "text")).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(texts)
    forms = Counter()
    for row in got:
        t = row["text"] or ""
        units = re.findall(r"[A-Za-z]+|[^A-Za-z]", t)
        digest = hashlib.sha256(f"1:{'' if row['doc_id'] is None else row['doc_id']}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
        a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
        p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
        form = "plain" if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90 else "spm" if h4 % 100 < 20 else "psm"
        want = {"plain": t, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
        lengths = (None, None) if form == "plain" else (len(p), len(m))
        assert (row["n"], row["form"], row["prefix_chars"], row["middle_chars"], row["output"]) == (len(units), form, *lengths, want)
        assert row["back"] == t
        forms[form] += 1
    assert set(forms) == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(docs.limit(0)).count() == 0


def test_marks_and_shares_are_parameters(spark, texts):
    marks = ("[[1]]", "[[2]]", "[[3]]")
    got = fim.fill_in_middle(rows_of(spark, texts), keep=("text",), seed=5, plain_percent=0, spm_percent=100, marks=marks)
    got = got.withColumn("back", fim.restored(F.col("output"), F.col("form"), marks)).collect()
    assert {r["form"] for r in got if r["text"]} == {"spm"} and {r["form"] for r in got if not r["text"]} == {"plain"}
    assert all(r["back"] == (r["text"] or "") for r in got)


def test_pieces_equal_the_library(spark, texts):
    sentencepiece = pytest.importorskip("sentencepiece")
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))
    docs = rows_of(spark, texts)
    got = pieces.encode_pieces(docs, keep=("doc_id", "text"))
    for row in got.collect():
        ids = lib.encode(row["text"] or "", add_bos=True, add_eos=True)
        assert row["ids"] == ids and row["decoded"] == lib.decode(ids)
    packed = {r["text"]: bytes(r["ids"]) for r in pieces.encode_pieces(docs, keep=("text",), packed=True).collect()}
    assert all(packed[r["text"]] == b"".join(i.to_bytes(4, "little") for i in r["ids"]) for r in got.collect())
    assert {(r["doc_id"], r["decoded"]) for r in pieces.decode_pieces(got).collect()} == {(r["doc_id"], r["decoded"]) for r in got.collect()}
    assert pieces.encode_pieces(docs.limit(0)).count() == 0


def test_odd_ids_decode_as_in_the_library(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))
    r = random.Random(2)
    rows = [[r.choice([r.randrange(32000), r.randrange(3, 259), r.randrange(3)]) for _ in range(r.randrange(12))] for _ in range(400)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate([*rows, None])], "doc_id long, ids array<int>")
    got = {x["doc_id"]: x["decoded"] for x in pieces.decode_pieces(df).collect()}
    assert got.pop(len(rows)) is None and got == {i: lib.decode(x) for i, x in enumerate(rows)}


def test_neighbours_stay_exactly_if_they_are_encoded_so():
    p = pieces.pieces(public_tokenizers.path(pieces.MODEL))

    def plain(text):
        symbols = list(text)
        while len(symbols) > 1:
            best, at = max((p.score.get(a + b, -math.inf), -i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)))
            if best == -math.inf:
                break
            symbols[-at : 2 - at] = [symbols[-at] + symbols[1 - at]]
        return symbols

    r = random.Random(4)
    for _ in range(3000):
        a, b = (r.randrange(259, p.size) for _ in range(2))
        assert p.stays(a, b) == (plain(p.text[a] + p.text[b]) == [p.text[a], p.text[b]])
        assert (p.own_merges(a) is not None) == (plain(p.text[a]) == [p.text[a]])


def test_a_vocabulary_that_reaches_across_spaces_is_read_whole():
    """Without safe cuts a text is one unit, parted only at characters that no piece has."""
    p = pieces.Pieces(public_tokenizers.path(pieces.MODEL))
    whole = pieces.Pieces(public_tokenizers.path(pieces.MODEL))
    whole.unit = re.compile(r"(?s).+")
    r = random.Random(8)
    odd = ["".join(r.choice("ab cde\n\t▁🤷x.,") for _ in range(r.randrange(1, 60))) for _ in range(200)]
    assert list(pieces.encode_batch(odd, p, {})) == list(pieces.encode_batch(odd, whole, {}))


def ranked(docs, items, k=10):
    term = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    bags = [(i, Counter(term(t))) for i, t in docs]
    n, total = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(w for _, b in bags for w in b)
    out = []
    for item, t in items:
        scores = []
        for i, b in bags:
            m = 25 + 75 * sum(b.values()) * n // total if total else 0
            s = sum(c * math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (1_000_000_000 * b[w] // (1000 * b[w] + 8 * m)) for w, c in Counter(term(t)).items() if w in b)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, rank + 1, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("query_terms, block_postings", [(200_000, 500_000), (40, 60)])
def test_search_equals_brute_force(spark, query_terms, block_postings):
    r = random.Random(5)
    words = ["".join(r.choice("abéß1") for _ in range(r.randrange(1, 4))) for _ in range(60)]
    prose = lambda n: r.choice([" ", "-", "\n"]).join(r.choice(words) for _ in range(n))
    bodies = [None, "", "!!!", "one", *(prose(r.randrange(1, 40)) for _ in range(150)), prose(3000), "Common " * 30, *["the same text of many copies"] * 25]
    docs = [(None if k == 3 else k, t) for k, t in enumerate(bodies)]
    docs += docs[60:63]
    items = [(1, prose(8)), (2, prose(20) + " " + prose(20)), (3, None), (4, "?!"), (None, "SAME copies same"), (6, "nowhere"), (7, "common one"), (7, "common one")]
    frame = spark.createDataFrame([(i, t, "x", "y") for i, t in docs], "doc_id long, text string, rank string, query string").repartition(4)
    sought = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, terms int").coalesce(1)
    got = search.search(frame, sought, query_terms=query_terms, block_postings=block_postings).collect()
    assert sorted((tuple(x) for x in got), key=str) == ranked(docs, items)
    assert search.search(frame.limit(0), sought).count() == 0 and search.search(frame, sought.limit(0)).count() == 0


def test_bounds_prune_most_documents(spark):
    """Few documents of a block are scored where some stand out."""
    import numpy as np

    g = np.random.default_rng(3)
    doc = np.concatenate([np.sort(g.choice(20_000, 6_000, replace=False)) for _ in range(6)])
    term = np.repeat(np.arange(6), 6_000)
    x = search.treaps(np.arange(20_000), doc, term, (g.pareto(2.0, len(doc)) * 1000).astype(np.int64) + 1, 6)
    scored = []
    best = search.Best(1, 10)
    add = best.add
    best.add = lambda query, score, ids: (scored.append(len(ids)), add(query, score, ids))
    search.traverse(x, best, np.zeros(6, np.int64), np.arange(6), np.ones(6, np.int64))
    exact = np.bincount(x.doc, weights=x.impact, minlength=20_000).astype(np.int64)
    assert sorted(best.score.tolist(), reverse=True) == sorted(exact.tolist(), reverse=True)[:10]
    assert sum(scored) < 2_000
