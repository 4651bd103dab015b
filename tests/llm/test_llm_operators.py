"""The training-data operators against brute force, on small tables with odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm import decontam, licenses, line_dedup, minhash, mixing, pii, quality, sharding, tokens, url_filter
from pulsegrid.llm.common import written

SCHEMA = "doc_id long, text string, source string, words string, row long, n_words string, shard int, __id int"


@pytest.fixture(scope="module")
def docs(spark):
    """Null, empty, long, repeated and tied rows, and columns whose names the operators use themselves."""
    r = random.Random(7)
    vocabulary = ["".join(r.choice("abcdeéß") for _ in range(r.randrange(2, 7))) for _ in range(300)]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    base = prose(120)
    near = base.split()
    near[60] = "changed"
    texts = [None, "", " \n\t ", "!!!", "one", prose(30), base, base, base.upper(), " ".join(near), prose(9000), "same line that is long enough\nsame line that is long enough\n" + prose(25)]
    texts += ["spam " * 50, prose(40) + "\n" + base, "mail bob.x@mail.example.com now +1 (988) 555-2485 or 10.0.0.7 pay 4111 1111 1111 1111", "same line that is long enougH\n" + prose(22)]
    rows = [(None if i == 5 else i, t, None if i % 7 == 0 else f"s{i % 3}", "x", 1, "y", 5, 9) for i, t in enumerate(texts)]
    rows += [rows[6], rows[6]]
    return written(spark.createDataFrame(rows, SCHEMA).coalesce(2))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words13(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def test_pii_base_spans_are_those_of_the_plain_expressions(spark, docs, empty):
    def plain(t):
        out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
            digits = re.sub("[ -]", "", m[0])
            if 14 <= len(digits) <= 19 and pii.luhn(digits):
                out.append((m.start(), 2, m.end()))
        out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
        return sorted(out)

    r = random.Random(3)
    for _ in range(4000):
        t = "".join(r.choice("a@.1 +-2(0)é") for _ in range(r.randrange(60)))
        assert pii.base_spans(t) == plain(t)
    pii.base_spans("1" * 200_000 + "a@" * 50_000 + "+1" + "(" * 100_000)  # in linear time
    got = pii.find_pii(docs, keep=("doc_id", "text")).collect()
    assert len(got) == docs.count()
    assert all([tuple(s) for s in x.base] == plain(x.text or "") for x in got)
    assert pii.find_pii(empty).count() == 0


def test_pii_query_counts_the_kinds_wherever_a_span_stands(spark, tmp_path):
    """A kind is counted whatever its place among a text's spans: phones first, five of one kind, kinds in any order."""
    texts = [None, "", "+1 555 123 4567", "1.2.3.4 a@b.cc", "a@b.cc c@d.ee f@g.hh i@j.kk l@m.nn", "4111-1111-1111-1111 10.0.0.1 +1 555 123 4567 x@y.zz", "9.9.9.9 8.8.8.8"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: x for x in pii.op1_pii(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        base = pii.base_spans(t or "")
        assert [got[i][f"n_{name}"] for name in pii.KINDS] == [sum(s[1] == k for s in base) for k in range(4)]
        assert got[i].base_sha256 == hashlib.sha256(pii.spell(base).encode()).hexdigest()


def test_pii_learns_contexts_and_finds_unseen_identifiers(spark):
    r = random.Random(1)
    rows = [(i, f"noise words here contact phone: +1 (988) 555-{r.randrange(1000, 9999)} thanks") for i in range(40)]
    rows += [(100, "noise words here contact phone: 988-555-1234 thanks"), (101, "noise room 12 words")]
    got = {x.doc_id: x for x in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(s.start, pii.KINDS[s.kind], s.end) for s in got[100].added] == [(32, "phone", 44)]
    assert not got[101].added and all(len(got[i].base) == 1 and not got[i].added for i in range(40))


@pytest.mark.parametrize("gap", [1, 30, 500])
def test_pii_patterns_reach_over_any_distance(gap):
    """Words that stand far away, or are long, give the same patterns as near and short ones."""
    def at(text, word):
        return next(m["patterns"] for m in pii.mentions(text) if text[m["start"] : m["end"]] == word)

    space = " " * gap
    assert at(f"my{space}phone:{space}555-1234{space}end", "555-1234") == ["label phone:", "left my phone: ", "frame phone:  _ end"]
    long = "x" * 40
    assert at(f"contact {'y' * gap}{long} 555-1234 end", "555-1234") == [f"left contact {long} ", f"frame {long}  _ end"]
    assert at(f"id-{'7' * gap}:{'8' * 9}{' ' * gap}{long}{'z' * gap}", "8" * 9)[0] == "label id-0:"


def test_pii_takes_long_words_with_many_spans_in_linear_time():
    assert len(pii.mentions("a@b.cc," * 40_000)) == 40_000


def test_url_rules_equal_brute_force(spark):
    r = random.Random(5)
    hosts = ["com", "example.com", "a.example.com", "b.a.example.com", "xexample.com", "net", "org", ""]
    tails = ["", "/", "/e", "/en/", "/en/7", "/en/77", "/EN/7", "/é\U0010ffff", "?q=/en/7", "#/en/7"]
    rules = {(r.choice(hosts[:-1]), r.choice(["", "/", "/e", "/en/", "/en/7", "/en/77", "/é"])): r.choice(["allow", "block"]) for _ in range(12)}
    rules["xexample.com", ""] = "block"
    rows = [(i, r.choice(["http://", "https://", "x", "A://"]) + r.choice(hosts) + r.choice(tails), "clash") for i in range(400)] + [(400, None, ""), (401, "", "")]
    rows += [(500 + i, "http://a.example.com/en/7", "hot") for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string").repartition(3)
    got = {x.page_id: x for x in url_filter.filter_urls(pages, url_filter.rule_table(spark, [(h, p, v) for (h, p), v in rules.items()])).collect()}
    assert len(got) == len(rows)
    for i, url, _ in rows:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0].lower()
        path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
        fits = [(len(h + p), len(h), h + p, v) for (h, p), v in rules.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, 0, None, "allow"))
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, best[2], best[3]), url
    odd = [("NET", "/", "block"), (None, "/", "block"), ("org", None, "block"), ("com", "", None)]
    odd = url_filter.filter_urls(pages, spark.createDataFrame(odd, "host string, path string, verdict string")).collect()
    assert {(x.rule, x.verdict) for x in odd} == {("net/", "block"), ("com", "allow"), (None, "allow")}
    none = url_filter.filter_urls(pages, url_filter.rule_table(spark, []))
    assert none.where("verdict = 'allow' and rule is null").count() == len(rows)
    assert url_filter.filter_urls(pages.limit(0), url_filter.rule_table(spark, url_filter.CONTRACT_RULES)).count() == 0


def test_quality_statistics_equal_brute_force(spark, docs, empty):
    def plain(t):
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        n, hit = Counter(windows), set()
        for i, w in enumerate(windows):
            if n[w] > 1:
                hit |= set(range(i, i + 8))
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)

    got = quality.text_stats(docs, prefix="q_").collect()
    assert len(got) == docs.count()
    for x in got:
        assert (x.q_n_words, x.q_word_chars, x.q_n_symbols, x.q_n_dup_lines, x.q_n_repeat_words) == plain(x.text)
    assert quality.text_stats(empty).count() == 0


def test_quality_learns_a_rule_and_keeps_clean_documents(spark, docs, empty):
    r = random.Random(2)
    rows = [(i, " ".join((r.choice("#*$") if i % 3 == 0 and k % 2 else "") + f"w{r.randrange(500)}" for k in range(60))) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(200)] + [(1, None), (None, 0)], "doc_id long, quality int")
    d = written(spark.createDataFrame(rows, "doc_id long, text string"))
    rules = quality.fit_quality(d, labels)
    judged = {x.doc_id: x.kept for x in quality.judge(d, rules).collect()}
    assert rules.rules and all(judged[i] == (i % 3 != 0) for i in judged)
    assert {x.doc_id for x in quality.keep_good(d, labels).collect()} == {i for i in judged if judged[i]}
    assert quality.fit_quality(d, labels.limit(0)).rules == ()
    kept = quality.keep_good(docs, labels.limit(0))
    assert kept.columns == docs.columns and quality.keep_good(empty, labels).count() == 0


def test_shards_hold_every_row_once_and_differ_by_one(spark, docs, empty):
    for d, parts in ((docs, 1 << 20), (docs, 200)):
        rows = sharding.shard_rows(d, shards=5, bucket_bytes=parts).collect()
        assert len(rows) == d.count()
        assert Counter((x.doc_id, x.text) for x in rows) == Counter((x.doc_id, x.text) for x in d.collect())
        slots = defaultdict(list)
        for x in rows:
            slots[x.shard].append(x.slot)
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())
        assert len(slots) == 5 and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = sharding.shard_rows(docs, shards=5, bucket_bytes=200).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
    assert sharding.shard_rows(empty).count() == 0
    crc = docs.select("text", F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("c")).collect()
    assert all(x.c == zlib.crc32((x.text or "").encode()) for x in crc)


def test_token_counts_equal_the_library(spark, docs, empty):
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    r = random.Random(1)
    odd = ["a" * 3000, "<|endoftext|>hi<|endoftext|> ", "\x1c\x1d a b　 c\x85d", "'s don't I'll  \n\n x", "²½Ⅷ १२३ ͡a", "😀👨‍👩‍👧 é é", " " * 999 + "x"]
    odd += ["".join(r.choice("ab c'stre\n\t  1²é½😀.,!日本́_-") for _ in range(r.randrange(200))) for _ in range(400)]
    d = docs.select("doc_id", "text").unionByName(spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string"))
    got = tokens.count_tokens(d, keep=("doc_id", "text")).collect()
    assert len(got) == d.count()
    for x in got:
        assert x.n_tokens == len(t.encode(x.text or "", add_special_tokens=False).ids)
        assert x.n_bytes == len((x.text or "").encode()) and x.over_limit == (x.n_tokens > 512)
    assert tokens.count_tokens(empty).count() == 0


@pytest.mark.parametrize("bound", [10**6, 0])
def test_contamination_equals_brute_force(spark, docs, empty, bound):
    texts = [x.text for x in docs.where("length(text) > 100").collect()]
    items = [(1, " ".join(words13(texts[0])[3:25])), (2, "one"), (3, None), (4, "?!"), (None, " ".join(words13(texts[1])[5:20])), (5, " ".join(words13(texts[0])[3:25])), (6, "absent words " * 20)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = defaultdict(set)
    for i, t in items:
        w = words13(t)
        for s in range(max(1, len(w) - 12)) if w else ():
            windows[tuple(w[s : s + 13])].add(i)
    got = decontam.contamination(docs, bench, max_broadcast=bound)
    assert got.count() == docs.count()
    for x in got.collect():
        w, hit, found = words13(x.text), set(), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    hit |= set(range(s, s + n))
                    found |= windows[tuple(w[s : s + n])] - {None}
        ids = sorted(map(str, found))
        assert (x.n_words, x.n_hit, x.n_items) == (len(w), len(hit), len(ids))
        assert x.items_sha256 == hashlib.sha256(",".join(ids).encode()).hexdigest()
        assert x.contaminated == (len(hit) > 0 and 20 * len(hit) >= len(w))
    clean = decontam.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns and clean.count() == got.where("not contaminated").count()
    assert decontam.contamination(empty, bench).count() == 0
    assert decontam.contamination(docs, bench.limit(0)).where("contaminated").count() == 0


def test_license_phrases_tags_and_expressions(spark, docs, empty):
    texts = ["Under the MIT License, and cc-by; the GNU General\nPublic License. mit\u00e9 license", "x\nSPDX-License-Identifier: (MIT OR GPL-2.0-only WITH Classpath-exception-2.0) AND Apache-2.0\nmit license", None, "", "Apache License apache license"]
    got = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    a, b, c, d, e = got
    assert (a.n_words, a.n_base, a.first_word, a.last_word, a.base_labels) == (14, 3, 2, 8, "cc-by,gpl,mit")
    assert (b.base_labels, b.labels, b.permissive, b.score) == ("mit", "apache,gpl,mit", True, 1.0)
    assert (c.n_words, c.n_base, c.first_word, c.labels, c.score) == (0, 0, None, "", 0.0) and (d.n_words, d.labels) == (0, "")
    assert (e.n_base, e.first_word, e.last_word, e.labels) == (2, 0, 2, "apache")
    assert licenses.postfix(["MIT", "OR", "(", "A", "AND", "B", ")", "WITH", "E"]) == ["MIT", "A", "B", "and", "E", "with", "or"]
    assert not licenses.evaluate("GPL-3.0-or-later AND MIT").permissive and licenses.evaluate("GPL-3.0 OR MIT").permissive
    assert licenses.evaluate("( ( AND") is None and licenses.evaluate("MIT AND").labels == {"mit"}
    phrases, tags = licenses.phrase_automaton(), licenses.automaton((t, t) for t in licenses.TAGS)
    for text, labels, score, permissive in [
        ("License: see the LICENSE file", "", 0.0, None),
        ("driver license: required for all", "", 0.0, None),
        ("license: GPL-3.0 license: MIT", "gpl,mit", 0.6, False),
        ("SPDX-License-Identifier: MIT ... SPDX-License-Identifier: GPL-2.0", "gpl,mit", 1.0, False),
        ("SPDX-License-Identifier: MIT OR foo bar", "foo,mit", 1.0, False),
        ("License: EUPL-1.2 and so on", "eupl", 0.6, False),
        ("xlicense: MIT\nLicence: MIT", "mit", 0.6, True),
        # the fixed phrase "cc by" stands in these ids as well, so its label stays beside theirs
        ("SPDX-License-Identifier: CC-BY-NC-4.0", "cc-by,cc-by-nc", 1.0, False),
        ("SPDX-License-Identifier: CC-BY-NC-ND-4.0", "cc-by,cc-by-nc-nd", 1.0, False),
        ("SPDX-License-Identifier: CC-BY-SA-4.0", "cc-by,cc-by-sa", 1.0, False),
        ("SPDX-License-Identifier: BSL-1.1", "busl", 1.0, False),
        ("SPDX-License-Identifier: BSL-1.0", "bsl", 1.0, True),
        ("SPDX-License-Identifier: MIT/Apache-2.0", "apache,mit", 1.0, True),
        ("SPDX-License-Identifier: Sleepycat-1.2", "sleepycat-1.2", 1.0, False),
        ("driver license: mit was good", "mit", 0.6, True),
        ("license: iso-9001 audit", "", 0.0, None),
        ("Licence: part-2 of the book", "", 0.0, None),
        ("license-expression: Apache-2.0\r\nGPL-2.0", "apache", 1.0, True),
    ]:
        got = licenses.scan(text, phrases, tags)
        assert (got["labels"], got["score"], got["permissive"]) == (labels, score, permissive), text
    licenses.scan("license: " * 200_000, phrases, tags)  # in linear time
    assert licenses.scan_licenses(docs).count() == docs.count() and licenses.scan_licenses(empty).count() == 0


def test_license_base_columns_equal_brute_force(spark):
    """Places, first and last words and labels of the four phrases against a scan of the word list."""
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    r = random.Random(11)
    parts = ["gnu", "GNU General", "general", "public", "license", "Apache", "apache license", "cc", "by", "cc-by", "MIT", "mit", "é", "x", "\n", "--", "mité license", "cc by by"]
    texts = [" ".join(r.choice(parts) for _ in range(r.randrange(40))) for _ in range(300)] + [None, ""]
    got = {x.doc_id: x for x in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        w = words13(t)
        places = [(k, label) for p, label in phrases.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        starts = sorted(k for k, _ in places)
        want = (len(w), len(starts), starts[0] if starts else None, starts[-1] if starts else None, ",".join(sorted({x for _, x in places})))
        assert (got[i].n_words, got[i].n_base, got[i].first_word, got[i].last_word, got[i].base_labels) == want, t


def test_extra_columns_with_the_operators_names_stay(spark):
    """Columns such as row, __row and number are the user's and come out as they went in."""
    names = ["row", "__row", "__number", "number", "__id", "__rule", "items", "node", "key", "lines", "__lines", "id"]
    rows = [(i, f"some words of a text that has the number {i % 4} and more than eight words\nsecond line", "http://a.com/x", *[f"{n}{i}" for n in names]) for i in range(12)]
    d = spark.createDataFrame(rows, "doc_id long, text string, url string, " + ", ".join(f"`{n}` string" for n in names)).coalesce(2)
    bench = spark.createDataFrame([(1, "some words of a text that has the number 2 and more than")], "item_id long, text string")
    own = {x[0]: tuple(x[3:]) for x in rows}

    def same(df):
        got = df.select("doc_id", *[f"`{n}`" for n in names]).collect()
        assert got and all(tuple(x)[1:] == own[x.doc_id] for x in got)
        return len(got)

    assert same(line_dedup.dedup_lines(d)) == 12
    assert same(minhash.drop_near_duplicates(d)) == 4
    assert same(decontam.contamination(d, bench)) == 12 and same(decontam.drop_contaminated(d, bench)) == 9
    assert same(url_filter.filter_urls(d, url_filter.rule_table(spark, url_filter.CONTRACT_RULES))) == 12
    assert same(sharding.shard_rows(d, shards=3)) == 12


def test_results_do_not_depend_on_how_files_are_split(spark, docs, tmp_path):
    """The same rows whether the files are read in one piece or in many."""
    docs.unionByName(docs).repartition(3).write.parquet(f"{tmp_path}/d")
    bench = spark.createDataFrame([(1, "spam spam spam spam spam")], "item_id long, text string")
    found = []
    for size in ("128m", "4k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        d = spark.read.parquet(f"{tmp_path}/d")
        kept = Counter(x.text for x in minhash.drop_near_duplicates(d).collect())
        lines = Counter(line for x in line_dedup.dedup_lines(d).where("text is not null").collect() for line in x.text.split("\n"))
        hit = Counter((x.text, x.n_hit) for x in decontam.contamination(d, bench).collect())
        found.append((len(kept), sum(kept.values()), +lines, hit))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found[0][0] == found[1][0] and found[0][1] == found[1][1] and found[0][3] == found[1][3]
    assert sum(found[0][2].values()) == sum(found[1][2].values())


def test_lines_stay_in_the_order_of_files_and_rows(spark, tmp_path):
    """However files are split and however large they are, of equal lines that of the first file and row stays."""
    for i in range(3):
        rows = [(100 * i + k, f"line {k}\nof file {i} {'x' * 4000 * i}") for k in range(40)]
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/d/f={i}")
    for size in ("128m", "4k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        d = spark.read.parquet(f"{tmp_path}/d").select("doc_id", "text")
        for in_files in (False, True):
            got = {x.doc_id: x for x in line_dedup.dedup_lines(d, in_files=in_files).collect()}
            assert {k for k, x in got.items() if 0 not in x.removed} == set(range(40)) and len(got) == 120
            assert {k for k, x in got.items() if 1 not in x.removed} == {0, 100, 200}
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_mixing_meets_the_targets(spark, docs, empty):
    rows = [(i, f"s{i % 4}" if i % 9 else None, (i * 7919) % 50) for i in range(600)]
    d = spark.createDataFrame(rows, "doc_id long, source string, size long")
    got = mixing.curriculum(d, size="size").collect()
    total, by = sum(x.size for x in got), {}
    assert len(got) == 600
    for x in got:
        by.setdefault(x.source, []).append(x)
        assert x.taken <= 3 * x.size and len(x.positions) == x.passes and all(0 <= p <= 1 for p in x.positions)
    assert sum(v[0].target for v in by.values()) == pytest.approx(total)
    for v in by.values():
        assert abs(sum(x.taken for x in v) - v[0].target) <= 1
        assert v[0].target <= 3 * v[0].source_size and v[0].source_size == sum(x.size for x in v)
    again = mixing.curriculum(d.repartition(7), size="size").collect()
    assert {x.doc_id: x.taken for x in again} == {x.doc_id: x.taken for x in got}
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.where("length(trim(text)) = 0").count() == 0
    assert mixing.mix(empty).count() == 0 and mixing.curriculum(d.limit(0), size="size").count() == 0


def test_schedule_is_inverted(spark):
    for slope in (0.5, 0.0, -0.5, 1.0):
        t = mixing.position(F.lit(0.3), F.lit(slope))
        got = spark.range(1).select((t + F.lit(slope) * (t * t - t)).alias("x")).first().x
        assert got == pytest.approx(0.3)


def test_lines_stay_once(spark, docs, empty):
    long = "a line that is quite long enough to be compared"
    rows = [(1, f"{long}\nshort\n\nshort"), (2, f"{long[:-1]}X\nother"), (3, f"{long}\n\n{long[2:]}"), (4, None), (5, ""), (6, "short")]
    d = written(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    got = {x.doc_id: x for x in line_dedup.dedup_lines(d).collect()}
    assert (got[1].text, got[1].n_exact, got[1].n_near) == (f"{long}\nshort\n", 1, 0)
    assert (got[2].text, got[2].n_near, got[2].origins) == ("other", 1, [1])
    assert (got[3].text, got[3].n_exact, got[3].n_near) == ("", 1, 1)
    assert got[4].text is None and got[4].n_lines == 0 and got[5].text == "" and got[6].removed == [0]
    out = line_dedup.dedup_lines(docs)
    assert out.count() == docs.count() and line_dedup.dedup_lines(empty).count() == 0


def shingles(t):
    w = words13(t)
    return [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []


def test_alignment_distance_is_that_of_the_table():
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
            row = new
        return len(a) + len(b) - 2 * row[-1]

    r = np.random.default_rng(1)
    for _ in range(1500):
        k = r.integers(1, 30)
        a = r.integers(0, k, r.integers(1, 60))
        b = a.copy()
        for _ in range(r.integers(0, 6)):
            i = int(r.integers(0, len(b)))
            b = np.insert(b, i, r.integers(0, k)) if r.random() < 0.5 or len(b) < 2 else np.delete(b, i)
        want, got, reach = plain(a.tolist(), b.tolist()), minhash.distance(a, b), 2 * ((len(a) + len(b)) // 9) + 1
        assert got == want if want <= reach else reach < got <= want


def test_near_duplicates_equal_brute_force(spark, docs, empty):
    r = random.Random(4)
    rows = []
    for group in range(12):
        base = [f"w{r.randrange(4000)}" for _ in range(r.randrange(60, 200))]
        for _ in range(r.randrange(1, 9)):
            w = list(base)
            for _ in range(r.randrange(0, 3)):
                w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    d = written(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(rows):
        for j in range(i):
            x, y = shingles(a), shingles(rows[j][1])
            c = sum((Counter(x) & Counter(y)).values())
            if c >= 0.8 * (len(x) + len(y) - c):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    d = d.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").alias("id"), "text")
    d, none = written(d), d.limit(0)
    got = {x.id: x for x in minhash.near_duplicates(d).collect()}
    assert {i: x.class_id for i, x in got.items()} == {i: find(i) for i in range(len(rows))}
    assert {x.id for x in minhash.near_duplicates(d).where("keeps").collect()} == {find(i) for i in range(len(rows))}
    assert minhash.near_duplicates(none).count() == 0
    odd = minhash.drop_near_duplicates(docs)
    kept = [x.text for x in odd.collect()]
    assert odd.columns == docs.columns and len(kept) == len(set(kept)) and sum(t is None or t == "" for t in kept) == 1


def all_features(left):
    """Every member of a bucket shares one feature, so that all pairs of open buckets are compared."""
    return left.select(F.col("bucket").alias("key"), "node", F.lit(1).cast("long").alias("n"), F.lit(0).cast("long").alias("at"))


def everywhere(n, at, n2, at2):
    return F.lit(True)


def test_buckets_join_clusters_that_no_pivot_joins(spark):
    """Numbers on a line, linked within 1: with one bucket the chain must come out whole."""
    from pulsegrid.llm.buckets import bucket_classes

    at = [0, 30, 1, 2, 31, 3, 60, 4, 5, 32]
    members = spark.createDataFrame([(1, i, 1) for i in range(len(at))], "key long, node long, n long")
    place = F.udf(lambda i: at[i], T.LongType())

    def verify(pairs):
        return pairs.select("a", "b", F.abs(place("a") - place("b")).alias("d"), F.lit(1).cast("long").alias("na"), F.lit(1).cast("long").alias("nb"))

    got = {x.node: x.root for x in bucket_classes(members, verify, lambda d, na, nb: d <= 1, all_features, everywhere).collect()}
    assert [got.get(i, i) for i in range(len(at))] == [0, 1, 0, 0, 1, 0, 6, 0, 0, 1]


@pytest.mark.parametrize("turns", [1, 2, 4])
def test_buckets_compare_clusters_where_nothing_waits(spark, turns):
    """A chain of four in one bucket: two clusters of two, no member waits, and the link between them counts."""
    from pulsegrid.llm.buckets import bucket_classes

    members = spark.createDataFrame([(1, i, 1) for i in range(4)], "key long, node long, n long")

    def verify(pairs):
        return pairs.select("a", "b", F.abs(F.col("a") - F.col("b")).alias("d"), F.lit(1).cast("long").alias("na"), F.lit(1).cast("long").alias("nb"))

    got = {x.node: x.root for x in bucket_classes(members, verify, lambda d, na, nb: d <= 1, all_features, everywhere, turns).collect()}
    assert got == {1: 0, 2: 0, 3: 0}


def edit_rule(n):
    return min(n // 8, int(n**0.5 / 2), 30)


def plain_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def changed(r, words, k, vocabulary):
    w = list(words)
    for _ in range(k):
        i, kind = r.randrange(len(w)), r.random()
        w[i : i + (kind < 0.7)] = [r.choice(vocabulary)] if kind < 0.4 or kind >= 0.7 else []
    return w


def test_line_keys_meet_wherever_lines_are_linked(spark):
    """Windows and edit distance against the full table, at every class up to 12 and at the classes' bounds."""
    r = random.Random(8)
    vocabulary = [f"v{i}" for i in range(60)]
    rows = []
    for k in range(700):
        t = r.randrange(1, 13)
        n = max(8 * t, 4 * t * t) + r.choice([-1, 0, 1, 2, 5])
        a = [r.choice(vocabulary) for _ in range(n)]
        rows.append((k, a, changed(r, a, r.randrange(1, t + 2), vocabulary)))
    df = spark.createDataFrame(rows, "k long, a array<string>, b array<string>")
    hashed = lambda c: F.transform(c, lambda w: F.xxhash64(w))
    keys = defaultdict(set)
    for side in "ab":
        for x in line_dedup.segment_keys(df.select(F.col("k").alias("node"), hashed(side).alias("words"))).collect():
            keys[x.node, side].add(x.key)
    pairs = df.select(F.col("k").alias("a"), F.col("k").alias("b"), hashed("a").alias("wa"), hashed("b").alias("wb"))
    got = {x.a: x for x in line_dedup.word_edits(pairs).collect()}
    met = 0
    for k, a, b in rows:
        want, most = plain_edits(a, b), edit_rule(max(len(a), len(b)))
        assert got[k].d == want if want <= most else got[k].d > most
        if want <= most:
            met += want > 1
            assert keys[k, "a"] & keys[k, "b"], (len(a), len(b), want)
    assert met > 200


def test_edit_distances_are_exact_where_bounds_are_loose(spark):
    """Few different words, moved words, repeated rows, one-sided ends and empty lines: neither bound alone gives the distance."""
    r = random.Random(11)
    rows = [(0, [], []), (1, [], ["p"] * 9), (2, ["p"] * 16, ["p"] * 16)]
    for k in range(3, 300):
        words = [f"w{i}" for i in range(r.choice([2, 3, 40]))]
        a = [r.choice(words) for _ in range(r.randrange(8, 70))]
        b = changed(r, a, r.randrange(0, 4), words)
        if r.random() < 0.4:  # a word moves elsewhere
            b.insert(r.randrange(len(b)), b.pop(r.randrange(len(b))))
        rows.append((k, a, b))
    df = spark.createDataFrame(rows, "a long, x array<string>, y array<string>")
    hashed = lambda c: F.transform(c, lambda w: F.xxhash64(w))
    got = {x.a: x.d for x in line_dedup.word_edits(df.select("a", F.col("a").alias("b"), hashed("x").alias("wa"), hashed("y").alias("wb"))).collect()}
    linked = 0
    for k, a, b in rows:
        want, most = plain_edits(a, b), edit_rule(max(len(a), len(b)))
        assert got[k] == want if want <= most else got[k] > most, (k, a, b)
        linked += 0 < want <= most
    assert linked > 60


def test_line_classes_equal_all_pairs(spark):
    """Random lines, groups of changed copies and a segment that many lines begin with."""
    r = random.Random(12)
    vocabulary = [f"w{i}" for i in range(400)]
    lines = []
    for _ in range(14):
        base = [r.choice(vocabulary) for _ in range(r.choice([9, 17, 30, 45, 70, 110]))]
        lines += [changed(r, base, r.randrange(0, 7), vocabulary) for _ in range(r.randrange(1, 12))]
    hot = [r.choice(vocabulary) for _ in range(12)]
    lines += [hot + changed(r, [str(i) for i in range(8)], r.randrange(0, 7), vocabulary) for _ in range(60)]
    least = check_line_classes(spark, lines)
    assert 10 < len(set(least)) < len(lines) - 60


@pytest.mark.parametrize("kind", ["few words", "deletions", "moves"])
def test_classes_of_many_copies_of_one_line_equal_all_pairs(spark, kind):
    """Copies with more changes than the rule allows: some are linked through copies that share changes, others not."""
    r = random.Random(kind)
    base = [f"w{r.randrange(40)}" for _ in range(66)]

    def copy():
        if kind == "few words":
            return changed(r, base, r.randrange(0, 9), ["a", "b", "w1", "w2"])
        w = list(base)
        for _ in range(r.randrange(0, 8)):
            i = r.randrange(20, 32)
            word = w.pop(i)
            if kind == "moves":
                w.insert(r.randrange(20, 32), word)
        return w

    lines = [copy() for _ in range(70)]
    least = check_line_classes(spark, lines)
    assert 1 < len(set(least)) < len(lines)


def check_line_classes(spark, lines):
    """Holds the classes of lines (lists of words) against all pairs; the least number of each one's class."""
    words, lines = lines, [" ".join(x) for x in lines]
    parent = list(range(len(lines)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(lines)):
        for j in range(i):
            n = max(len(words[i]), len(words[j]))
            if lines[i] == lines[j] or abs(len(words[i]) - len(words[j])) <= edit_rule(n) and plain_edits(words[i], words[j]) <= edit_rule(n):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    rows = written(spark.createDataFrame(list(enumerate(lines)), "row long, text string").coalesce(1))
    got = {x.row: x for x in line_dedup.line_classes(rows).collect()}
    at = {x.pos: x.row for x in got.values()}
    least = [find(i) for i in range(len(lines))]
    assert {i: at[got[i].root] for i in got} == dict(enumerate(least))
    return least


def test_lines_with_one_changed_word_stay_once(spark):
    r = random.Random(9)
    lines = [" ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n)) for n in (11, 12, 20, 60, 300)]
    short = "eight words are the fewest that link twenty-one"
    rows = [(1, "\n".join([*lines, short]))] + [(2, "\n".join([x[:28] + "CHANGED" + x[34:] for x in lines] + [short[:-1] + "E"]))]
    d = written(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    got = {x.doc_id: x for x in line_dedup.dedup_lines(d).collect()}
    assert got[1].removed == [] and (got[2].removed, got[2].n_near, got[2].text) == ([0, 1, 2, 3, 4, 5], 6, "")


def test_short_texts_link_whatever_their_sketches(spark):
    """Texts of a few words and copies without the last ones: those of 4/5, 5/6 and 8/10 k-mers link, 3/4 do not."""
    r = random.Random(6)
    rows, cut = [], {8: 1, 9: 1, 10: 1, 14: 2, 29: 4}
    for n, gone in cut.items():
        for _ in range(40):
            w = [f"w{r.randrange(10**6)}" for _ in range(n)]
            rows += [(len(rows), " ".join(w), n), (len(rows) + 1, " ".join(w[:-gone]), n)]
    d = spark.createDataFrame(rows, "id long, text string, n int").coalesce(2)
    d = written(d.select(F.monotonically_increasing_id().alias("row"), "id", "text"))
    got = {x.id: x.class_id for x in minhash.near_duplicates(d).collect()}
    assert got == {i: i - i % 2 if n > 8 else i for i, _, n in rows}
