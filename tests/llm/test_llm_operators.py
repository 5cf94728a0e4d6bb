"""Each training-data operator against a brute-force version, and on odd rows."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import random
import re
import time
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from compare import canon, oracle_rows
from shoalgraph.llm import bagminhash, html_extract, license_scan, line_dedup, lsa_decontam, oracle, packing, quality_rules, queries, repeated_spans, sharding, token_counts

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


# 1: line deduplication


@settings(deadline=None)
@given(st.lists(st.integers(0, 6), max_size=14), st.lists(st.integers(0, 6), max_size=14))
def test_patience_is_an_alignment(a, b):
    blocks = line_dedup.patience(a, b)
    assert all(a[x : x + n] == b[y : y + n] for x, y, n in blocks)
    assert all(p[0] + p[2] <= q[0] and p[1] + p[2] <= q[1] for p, q in itertools.pairwise(blocks))


def test_patience_finds_moved_context():
    assert line_dedup.patience([1, 2, 3, 4, 5], [9, 2, 3, 8, 4, 5]) == [(1, 1, 2), (3, 4, 2)]


def test_line_dedup(spark):
    block = [f"this is the shared line number {k} of a long block" for k in range(4)]
    made = [(1, "\n".join(["first start", *block, "first end"])), (2, "\n".join(["second", "", *block, "tail"])), (3, "\n".join(["first start", *block, "first end"])), (4, "alone\nfirst end")]
    got = by_id(line_dedup.dedup_lines(spark.createDataFrame(made, "doc_id long, text string"), report=True))
    assert got[1].text == made[0][1] and got[1].n_removed == 0
    assert got[2].text == "second\n\ntail" and got[2].n_removed == 4
    assert got[3].text == "" and got[3].n_removed == 6
    assert got[4].text == "alone\nfirst end"


def test_frequent_lines_start_no_alignment(spark):
    made = [(k, f"a line that each and every document of the corpus carries\nown line of document number {k} and nobody else") for k in range(30)]
    df = spark.createDataFrame(made, "doc_id long, text string")
    assert {r.n_removed for r in line_dedup.dedup_lines(df, rare_share=0.1, rare_least=2, report=True).collect()} == {0}
    assert {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(df, rare_share=1.0, report=True).collect()} == {k: int(k > 0) for k in range(30)}


def test_blocks_of_frequent_lines_are_deleted(spark):
    block = [f"short line {k} of a block" for k in range(3)]  # 24 characters each
    made = [(k, f"alone number {k}\n{block[k]}\nand its end {k}") for k in range(3)]  # each line's first document holds nothing else of the block
    made += [(k, "\n".join([f"head of {k}", *block, f"tail of {k}"])) for k in range(3, 90)]
    made += [(k, f"own line of document number {k} and of nobody else\na line that each of these documents carries, long enough") for k in range(90, 180)]
    got = by_id(line_dedup.dedup_lines(spark.createDataFrame(made, "doc_id long, text string"), report=True))
    assert {k: r.n_removed for k, r in got.items()} == {k: 3 if 3 < k < 90 else int(k > 90) for k in range(180)}
    assert got[70].text == "head of 70\ntail of 70" and got[170].text == "own line of document number 170 and of nobody else"


def test_moved_and_repeated_blocks_overlap():
    size = np.array([30, 30, 50, 9, 30, 30, 50, 50])
    mine, theirs = np.array([1, 2, 3, 4, 5, 6, 3, 7], np.uint64), np.array([9, 5, 6, 4, 3, 8, 1, 2], np.uint64)
    assert line_dedup.overlap(mine, size, theirs, 40) == {0, 1, 2, 4, 5, 6}
    assert line_dedup.overlap(mine, size, np.array([4, 9, 1, 8, 6], np.uint64), 40) == set()


def test_line_dedup_against_all_pairs(spark, rows):
    """The query against patience diff of every text with every earlier one: no block is lost, and nothing else goes."""
    lines = {k: [s.strip(line_dedup.WHITE) for s in t.split("\n") if s.strip(line_dedup.WHITE)] for k, t in rows.items()}
    hashed = lambda x: np.array([int.from_bytes(hashlib.md5(s.encode()).digest()[:8], "big") for s in x], np.uint64)
    first = {}
    for k in sorted(rows):
        if lines[k]:
            first.setdefault(rows[k], k)
    holders = collections.defaultdict(list)
    for k in sorted(first.values()):
        for x in set(lines[k]):
            holders[x].append(k)
    want = {}
    for k, x in lines.items():
        if first.get(rows[k], k) != k:
            want[k] = set(range(len(x)))
            continue
        want[k] = set()
        for other in {o for line in x for o in holders[line] if o < k} if k in first.values() else ():
            want[k] |= line_dedup.overlap(hashed(x), np.array(list(map(len, x))), hashed(lines[other]), 40)
    got = by_id(queries.op1_line_dedup(spark, SF))
    assert {k: r.n_lines for k, r in got.items()} == {k: len(x) for k, x in lines.items()}
    assert {k: r.n_removed for k, r in got.items()} == {k: len(x) for k, x in want.items()}
    assert sum(map(len, want.values())) > 0
    kept = {k: [s.strip(line_dedup.WHITE) for s in r.text.split("\n") if s.strip(line_dedup.WHITE)] for k, r in got.items()}
    assert kept == {k: [s for i, s in enumerate(x) if i not in want[k]] for k, x in lines.items()}


# 2: main text

PAGE = """<html><head><title>t</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><a href=/>Home</a></nav><div class="cookie-notice">We use</div>
<main><article><h1>T &amp; t</h1><p>One  <b>two</b>\n three<br>four</p><script>var x="</p>";</script><aside>Side</aside><ul><li>a<li>b</ul><div id="comments"><p>nice</p></div><form>Q<input></form><p>3 < 4 &lt;p&gt;</article></main>
<div class="sidebar">s</div><footer>f</footer></body></html>"""


def test_main_text():
    assert html_extract.Page(PAGE).main_text(set()) == "T & t\n\nOne two three four\n\na\n\nb\n\n3 < 4 <p>"
    assert html_extract.Page("").main_text(set()) == "" and html_extract.Page("<p>x").main_text(set()) == "x"


#: What stays of an article, and what goes from it.
STAYS = """<p title="the hidden valley">a</p>|<p data-hidden="false">a</p>|<p>a <a href="/p?id=comment">this link</a></p>|<div data-id="share-7">a</div>|<p><b title="class=ad">a</b></p>|<div class="entry-header">a</div>|<div class="legal-history">a</div>
<div class="widget-market">a</div>|<div class="header">a</div>|<p class='lead legal'>a</p>|<p style="color:red" id=x1>a</p>|<p aria-hidden=false>a</p>|<div class="has-sidebar no-comments">a</div>""".replace("\n", "|").split("|")
GOES = """<div class="comments">a</div>|<div id="comment-42">a</div>|<div class="x ad-slot">a</div>|<div class=shareButtons>a</div>|<p hidden>a</p>|<p style="display: none">a</p>|<ul role="navigation"><li>a</ul>|<div class='related_posts'>a</div>|<p aria-hidden="true">a</p>""".split("|")


def test_attributes_are_read_whole():
    text = lambda part, around: html_extract.Page(f"<body><{around}><h1>T</h1>{part}</{around}></body>").main_text(set())
    assert all(text(x, "article").split("\n\n")[1:] in (["a"], ["a this link"]) for x in STAYS)
    assert all(text(x, around) == "T" for x in GOES for around in ("article", "div"))
    assert all(text(x, "div") != "T" for x in STAYS if 'class="header"' not in x and "lead" not in x)


def test_templates_go_only_where_they_recur(spark):
    page = lambda k, host: (k, f"http://{host}/{k}", f"<body><div><p>Follow us on our channels</p></div><div><h1>Title {k}</h1><p>{'word ' * 9}{k} {host}</p></div></body>")
    pages = spark.createDataFrame([page(k, "a.example") for k in range(12)] + [page(k + 100, "b.example") for k in range(3)] + [(200, None, None)], "page_id long, url string, html string")
    for bound in (html_extract.BROADCAST_ROWS, -1):
        got = {r.page_id: r for r in html_extract.extract_main_text(pages, broadcast_rows=bound).collect()}
        assert "Follow" not in got[3].text and got[3].text.startswith("Title 3\n\nword")
        assert got[101].text.startswith("Follow us")
        assert (got[200].text, got[200].n_chars) == ("", 0)


def test_templates_longer_than_the_pages_own_paragraphs_go(spark):
    page = lambda k, host, own: (k, f"http://{host}/{k}", f"<body><div><p>Follow us on our channels</p></div><div>{'All offers are subject to change. ' * 9}</div><div><h1>Title {own}</h1><p>Own paragraph {own}</p></div></body>")
    made = [page(k, "a.example", k) for k in range(12)] + [page(k, "b.example", 1) for k in range(100, 130)]
    for bound in (html_extract.BROADCAST_ROWS, -1):
        got = {r.page_id: r.text for r in html_extract.extract_main_text(spark.createDataFrame(made, "page_id long, url string, html string"), broadcast_rows=bound).collect()}
        assert all(got[k] == f"Title {k}\n\nOwn paragraph {k}" for k in range(12))
        assert all(got[k].startswith("Follow us") and got[k].endswith("Own paragraph 1") for k in range(100, 130))  # copies count as one


def test_pages_against_their_articles(spark):
    import html

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in queries.op2_html_extraction(spark, SF).collect():
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", article)]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


# 3: near duplicates


def shingled(text):
    w = re.findall("[^ \t\n\v\f\r]+", text)
    return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter()


def jaccard(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(3)
    keys = np.tile(np.arange(60, dtype=np.uint64) * np.uint64(7919) + np.uint64(11), 2)
    text, weight = np.repeat([0, 1], 60), rng.integers(1, 9, 120)
    sig = bagminhash.signatures(keys, text, weight, 2, 4096)
    true = np.minimum(weight[:60], weight[60:]).sum() / np.maximum(weight[:60], weight[60:]).sum()
    assert abs((sig[0] == sig[1]).mean() - true) < 4 * math.sqrt(true * (1 - true) / 4096)


def test_near_duplicates(spark, rows):
    sets = {k: shingled(t) for k, t in rows.items()}
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations([k for k in sets if sets[k]], 2):
        if jaccard(sets[a], sets[b]) >= 0.8:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = by_id(queries.op3_minhash(spark, SF))
    assert {k: r.class_id for k, r in got.items()} == {k: root(k) for k in sets}
    assert {k for k, r in got.items() if r.kept} == {k for k in sets if root(k) == k}
    assert all(got[k].n_shingles == sum(sets[k].values()) for k in sets)


def test_links_between_classes_of_a_bucket(spark):
    base = [f"w{k}" for k in range(200)]
    chain = []
    for k in range(30):  # each near the next one, far from the first
        base = base[:]
        for j in range(2):
            base[(7 * k + 3 * j) % 200] = f"n{k}_{j}"
        chain.append((k, " ".join(base)))
    got = by_id(bagminhash.near_duplicates(spark.createDataFrame(chain, "doc_id long, text string")))
    assert {r.class_id for r in got.values()} == {0}


def test_components(spark):
    links = [(a.to_bytes(2, "big"), b.to_bytes(2, "big")) for a, b in [(k, k + 1) for k in range(20)] + [(40, 41), (42, 41)]]
    got = bagminhash.components(spark.createDataFrame(links, "a binary, b binary")).collect()
    assert {int.from_bytes(r.key): int.from_bytes(r.label) for r in got} == {k: 0 for k in range(21)} | {40: 40, 41: 40, 42: 40}


# 4: sharding


def smallest_capacity(sizes, shards):
    def fits(c):
        n, at = 1, 0
        for s in sizes:
            if s > c:
                return False
            n, at = (n + 1, s) if at + s > c else (n, at + s)
        return n <= shards

    return next(c for c in range(sum(sizes) + 1) if fits(c))


@pytest.mark.parametrize("seed", range(4))
def test_minimax_partition(spark, seed):
    r = random.Random(seed)
    groups = sorted({r.getrandbits(64) - (1 << 63): r.randrange(1, 60) for _ in range(300 if seed else 5)}.items())
    lows, capacity = sharding.partition(spark.createDataFrame(groups, "h long, bytes long"), 7)
    assert capacity == smallest_capacity([s for _, s in groups], 7)
    loads = collections.Counter(sum(h >= low for low in lows) for h, _ in groups for _ in [0])
    by_shard = collections.Counter()
    for h, s in groups:
        by_shard[sum(h >= low for low in lows)] += s
    assert max(by_shard.values()) == capacity and len(loads) <= 7


def test_partition_splits_cells_of_near_hashes(spark):
    groups = [(k, 1 + k % 3) for k in range(1000)]  # all in one first cell
    _, capacity = sharding.partition(spark.createDataFrame(groups, "h long, bytes long"), 6)
    assert capacity == smallest_capacity([s for _, s in groups], 6)


def test_shards(spark, rows):
    got = queries.op4_sharding(spark, SF).collect()
    assert len(got) == len(rows)
    where, slots = collections.defaultdict(set), collections.defaultdict(list)
    for r in got:
        data = rows[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 8, zlib.crc32(data), "bytes", None)
        where[data].add(r.shard)
        slots[r.shard].append(r.slot)
    assert all(len(s) == 1 for s in where.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(24))


def test_one_huge_group_gets_its_own_shard(spark):
    df = spark.range(300).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN repeat('copy ', 50) ELSE concat(id, repeat(' text', 50)) END AS text")
    load = collections.Counter()
    for r in sharding.shard_by_bytes(df, 8).collect():
        load[r.shard] += r["size"]
    assert len(load) == 8 and max(v for k, v in load.items() if k) < 1.2 * min(v for k, v in load.items() if k)


# 5: packing


@settings(deadline=None, max_examples=60)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 40), max_size=12))
def test_plan_uses_each_piece_once(counts):
    used, bins = collections.Counter(), 0
    for times, chosen in packing.plan(counts, 32):
        assert sum(s * n for s, n in chosen) <= 32
        bins += times
        used.update({s: n * times for s, n in chosen})
    assert used == collections.Counter(counts)
    assert bins <= 2 * -(-sum(s * n for s, n in counts.items()) // 32) + 1


@settings(deadline=None)
@given(st.lists(st.integers(1, 12), max_size=9), st.integers(1, 30))
def test_fill_is_closest(sizes, capacity):
    counts = [0] * (max([capacity, 12]) + 1)
    for s in sizes:
        counts[s] += 1
    best = max(sum(c) for n in range(len(sizes) + 1) for c in itertools.combinations(sizes, n) if sum(c) <= capacity)
    chosen = packing.fill(counts, capacity)
    assert sum(s * n for s, n in chosen) == best and all(n <= counts[s] for s, n in chosen)


def test_packing(spark, rows):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = queries.op5_packing(spark, SF).collect()
    sequences, pieces = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    for s in sequences.values():
        s.sort()
        assert [o for o, _ in s] == [sum(n for _, n in s[:k]) for k in range(len(s))] and sum(n for _, n in s) <= 2048
    for k, text in rows.items():
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], "<u4")
        own = sorted(pieces[k], key=lambda r: r.start)
        assert sum(r.length for r in own) == len(ids) == own[0].doc_tokens
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in own)
    assert sum(n for s in sequences.values() for _, n in s) / (2048 * len(sequences)) > 0.97


def test_special_strings_are_tokenized_as_the_library_does():
    encoder = packing.Encoder("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in ("a<|endoftext|>b", "", "  x\n\n\ty  ", "naïve 日本 😀 12345 don't"):
        assert encoder.ids(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


# 6: licences


def base_of(text):
    words = re.findall(license_scan.WORD, "".join(c.lower() if c < "\x80" else c for c in text or ""))
    hits = [(i, label) for phrase, label in license_scan.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in hits]
    return len(words), len(hits), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in hits}))


SAID = {
    "CC BY cc-by CC.BY-SA 4.0": "cc-by,cc-by-sa-4.0", "Licensed under the GNU General Public License, version 3 or later.": "gpl,gpl-3.0-or-later", "MIT licensed": "", "a mit\nLicense here": "mit",
    "released under the MIT License and the Apache License, Version 2.0": "apache,apache-2.0,mit", "ünlicense gnu general public licenses": "", "SPDX-License-Identifier: LGPL-2.1-only": "lgpl-2.1-only",
    "This is free and unencumbered software released into the public domain": "unlicense", "All rights reserved": "proprietary",
}


def test_licences(spark, rows):
    for r in queries.op6_license_scan(spark, SF).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base_of(rows[r.doc_id])
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    made = spark.createDataFrame(list(enumerate(SAID)), "doc_id long, text string")
    got = by_id(license_scan.license_report(made))
    assert {t: got[k].labels for k, t in enumerate(SAID)} == SAID
    assert all((got[k].n_words, got[k].n_base, got[k].first_word, got[k].last_word, got[k].base_labels) == base_of(t) for k, t in enumerate(SAID))


def test_rules_are_many_and_valid():
    every = license_scan.rules()
    assert len(every) >= 200 and all(re.compile(license_scan.framed(r)) for _, r, _, _ in every)


def settled(found):
    """What stays of (start, end, priority, label), one by one."""
    outer = [d for i, d in enumerate(found) if not any(j != i and o[0] <= d[0] and d[1] <= o[1] and (o[:2] != d[:2] or (-o[2], o[3]) < (-d[2], d[3])) for j, o in enumerate(found))]
    kept = []
    for d in sorted(outer, key=lambda d: (-d[2], d[0])):
        if not any(k[0] < d[1] and d[0] < k[1] for k in kept):
            kept.append(d)
    return sorted(kept)


def test_detections_are_resolved_by_priority_and_containment(spark):
    r = random.Random(6)
    chain = [(0, 4, 10, "a"), (3, 8, 20, "b"), (7, 12, 30, "c")]  # c suppresses b, and a stays
    made = [chain, []]
    for _ in range(60):
        starts = [(s, s + r.randrange(1, 9), r.randrange(1, 5), f"l{i}") for i, s in enumerate(r.choices(range(40), k=r.randrange(12)))]
        made.append(list({d[:3]: d for d in starts}.values()))
    rows = [(i, [(s, -e, -p, label) for s, e, p, label in x]) for i, x in enumerate(made)]
    df = spark.createDataFrame(rows, "i int, x array<struct<s:int,minus_e:int,minus_p:int,label:string>>")
    got = {x.i: sorted((d.s, -d.minus_e, -d.minus_p, d.label) for d in x.y) for x in df.select("i", license_scan.resolved(F.sort_array("x")).alias("y")).collect()}
    assert got == {i: settled(x) for i, x in enumerate(made)}
    assert [d[3] for d in got[0]] == ["a", "c"]


def detections_of(text):
    """All matches of all rules in a text, without keywords or gates."""
    words = re.findall(license_scan.WORD, "".join(c.lower() if c < "\x80" else c for c in text or ""))
    framed = f" {' '.join(words)} "
    found = {}
    for label, rule, priority, _ in license_scan.rules():
        for m in re.finditer(license_scan.framed(rule), framed):
            s = framed[: m.start()].count(" ") - 1
            found.setdefault((s, s + len(m[0].split()), priority, label))
    return list(found)


def test_labels_against_all_rules_without_gates(spark, rows):
    hinted = re.compile("licen|gpl|cc|creative|public|permission|redistribution|rights|spdx|ware", re.I)
    got = by_id(queries.op6_license_scan(spark, SF))
    some = [k for k, t in rows.items() if hinted.search(t)]
    assert len(some) > 5
    for k, t in rows.items():
        found = settled(detections_of(t)) if k in some else []
        base = base_of(t)
        assert got[k].labels == ",".join(sorted({d[3] for d in found} | set(filter(None, base[4].split(",")))))
        assert got[k].score == max([d[2] for d in found] + [40 if base[1] else 0]) / 100


# 7: token counts

PARTS = ["a", "the", " ", "  ", "\n", "\t", ".", "é", "中", "😀", "▁", "\x00", "<s>", "\r\n", "   word"]


@settings(deadline=None, max_examples=200)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=10).map("".join), min_size=1, max_size=6))
def test_counts_equal_the_library(texts):
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    got = [n for b in token_counts.counted(iter([batch]), "piece_bpe_32k.model", 3) for n in b.column(2).to_pylist()]
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert got == [len(x) for x in sp.encode(texts)]


def test_token_counts(spark, rows):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in queries.op7_token_counts(spark, SF).collect():
        n = len(sp.encode(rows[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(rows[r.doc_id].encode()), n, n > 4096)


# 8: decontamination


def normal(text):
    return " " + " ".join(re.findall("[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if c < "\x80" else c for c in text or ""))) + " "


def test_leaks(spark, rows):
    items = {r.item_id: normal(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    planted = {(k, i) for k, t in rows.items() for i, x in items.items() if x in normal(t)}
    got = {(r.doc_id, r.item_id) for r in queries.op8_decontamination(spark, SF).collect()}
    assert planted and planted <= got
    assert all(lcs_share(items[i].split(), normal(rows[k]).split()) >= 0.6 for k, i in got)


def lcs_share(a, b):
    line = [0] * (len(a) + 1)
    for y in b:
        last = 0
        for i, x in enumerate(a):
            last, line[i + 1] = line[i + 1], last + 1 if x == y else max(line[i + 1], line[i])
    return line[-1] / len(a)


@settings(deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=20), st.lists(st.integers(0, 5), max_size=30))
def test_common(a, b):
    assert lsa_decontam.common(lsa_decontam.masks_of(np.array(a, np.int64)), len(a), b) == round(lcs_share(a, b) * len(a))


def test_paraphrases_are_found_and_clean_texts_stay(spark):
    r = random.Random(4)
    words = [f"term{k}" for k in range(3000)]
    item = [r.choice(words) for _ in range(40)]
    changed = [w if k % 6 else "other" for k, w in enumerate(item)]
    text = lambda *parts: " ".join(itertools.chain([r.choice(words) for _ in range(150)], *parts, [r.choice(words) for _ in range(150)]))
    made = [(0, text(item)), (1, text(changed)), (2, text()), (3, text(item[:10])), *[(k, text()) for k in range(4, 40)]]
    bench = spark.createDataFrame([(7, " ".join(item)), (8, None), (9, ""), (10, " ".join(item))], "item_id long, text string")
    df = spark.createDataFrame(made, "doc_id long, text string")
    assert {(x.doc_id, x.item_id) for x in lsa_decontam.contamination(df, bench).collect()} == {(0, 7), (1, 7), (0, 10), (1, 10)}
    assert {x.doc_id for x in lsa_decontam.drop_contaminated(df, bench).collect()} == set(range(2, 40))
    assert lsa_decontam.contamination(df, bench.limit(0)).isEmpty()


def test_recall_of_paraphrases(spark):
    """Every item of the table with 10 to 24 % of its words replaced, in texts of the table: all are found (the gate has no miss here)."""
    r = random.Random(12)
    items = [(x.item_id, x.text) for x in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()]
    texts = [x.text for x in spark.read.parquet(f"{SF}/documents.parquet").collect() if len(x.text.split()) > 60]
    made, planted = [], set()
    for share in (0.10, 0.15, 0.20, 0.24):
        for item_id, text in items:
            w = text.split()
            for k in r.sample(range(len(w)), int(share * len(w))):
                w[k] = r.choice(r.choice(texts).split())
            own = r.choice(texts).split()
            at = r.randrange(len(own))
            planted.add((len(made), item_id))
            made.append((len(made), " ".join([*own[:at], *w, *own[at:]])))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in lsa_decontam.contamination(spark.createDataFrame(made, "doc_id long, text string"), bench).collect()}
    assert len(planted & got) >= 0.99 * len(planted)


def test_an_item_that_leaks_into_a_third_of_the_rows_is_found(spark):
    r = random.Random(8)
    words = [f"term{k}" for k in range(3000)]
    item, rare, short = ([r.choice(words) for _ in range(n)] for n in (40, 40, 4))
    changed = [w if k % 6 else "other" for k, w in enumerate(item)]
    text = lambda part: " ".join([*(r.choice(words) for _ in range(r.randrange(20, 70))), *part, *(r.choice(words) for _ in range(r.randrange(20, 70)))])
    made = [(k, text([item, changed, item[:10]][k % 3] if k < 45 else [])) for k in range(90)] + [(90, text(rare)), (91, text(short))]
    bench = spark.createDataFrame([(7, " ".join(item)), (8, " ".join(rare)), (9, " ".join(short))], "item_id long, text string")
    got = lsa_decontam.contamination(spark.createDataFrame(made, "doc_id long, text string"), bench).collect()
    assert {(x.doc_id, x.item_id) for x in got} == {(k, 7) for k in range(45) if k % 3 < 2} | {(90, 8), (91, 9)}


def test_memory_of_the_search_is_bounded_where_every_word_is_a_term():
    g = np.random.default_rng(3)
    items = [g.integers(0, 3000, 40) for _ in range(50)]
    model = lsa_decontam.Model([b"%d" % k for k in range(50)], items, np.arange(3000, dtype=np.uint64), 40, 2.0, 0.75)
    model.search(np.ones(3000), 10_000)
    model.basis = g.standard_normal((3000, 192), dtype=np.float32)
    model.queries = g.standard_normal((50, 192), dtype=np.float32) / 192
    term = g.integers(0, 3000, 400_000)
    term[123_456 : 123_456 + 40] = items[7]
    found = lsa_decontam.Found(np.array([0, len(term)]), np.arange(len(term)), term)
    search = lsa_decontam.Search(model)
    tracemalloc.start()
    leaks = search.leaks(found)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert leaks.keys() == {(0, 7)} and leaks[0, 7][0] == 1
    assert peak < 200e6
    block, of, times, first = found.blocked(model)
    block, of, weight = lsa_decontam.weighted(model, block, of, times)
    lo, hi = np.searchsorted(block, [2000, 2050])
    want = np.zeros((50, 192))
    np.add.at(want, block[lo:hi] - 2000, (weight / model.idf[of])[lo:hi, None] * model.basis[of[lo:hi]])
    assert np.allclose(lsa_decontam.projected(model, block, of, weight, int(first[-1]))[2000:2050], want, atol=1e-4)


def test_sums_of_products(monkeypatch):
    g = np.random.default_rng(6)
    monkeypatch.setattr(lsa_decontam, "TILE", 8)
    for counts in ([0, 3, 8, 0, 1, 16, 19, 3, 7, 0, 5], [], [0], [40], [1] * 30):
        rows = np.repeat(np.arange(len(counts)), counts)
        column, weights = g.integers(0, 9, len(rows)), g.standard_normal(len(rows), dtype=np.float32)
        table, out = g.standard_normal((9, 5), dtype=np.float32), np.ones((len(counts), 5), np.float32)
        want = out.copy()
        np.add.at(want, rows, weights[:, None] * table[column])
        lsa_decontam.add_products(out, rows, weights, column, table)
        assert np.allclose(out, want, atol=1e-4)


def test_sketch_costs_less_than_half_of_plain_sums():
    g = np.random.default_rng(7)
    block = np.sort(g.integers(0, 18_000, 200_000))
    term, weight = g.integers(0, 3800, len(block)), g.random(len(block), dtype=np.float32) + 1
    om, out = lsa_decontam.omega(3800, 208), np.zeros((3800, 208), np.float32)
    want, w = np.zeros((3800, 208), np.float32), lsa_decontam.normed(block, weight, 18_000)
    began = time.thread_time()
    for lo in range(0, 18_000, 3000):
        a, b = np.searchsorted(block, [lo, lo + 3000])
        rows, inverse = np.unique(block[a:b], return_inverse=True)
        y = np.add.reduceat(w[a:b, None] * om[term[a:b]], np.searchsorted(block[a:b], rows), axis=0)
        order = np.argsort(term[a:b], kind="stable")
        terms, at = np.unique(term[a:b][order], return_index=True)
        want[terms] += np.add.reduceat((w[a:b, None] * y[inverse])[order], at, axis=0)
    plain, took = time.thread_time() - began, []
    for _ in range(3):
        out[:] = 0
        began = time.thread_time()
        lsa_decontam.sketch(block, term, weight, 18_000, om, out)
        took.append(time.thread_time() - began)
    assert np.allclose(out, want, atol=1e-3)
    assert min(took) < plain / 2


def test_terms_that_share_a_slot_are_told_apart(monkeypatch):
    g = np.random.default_rng(8)
    monkeypatch.setattr(lsa_decontam, "FILTER", 64)
    for n in (0, 1, 40, 500):
        h = np.unique(g.integers(0, 1 << 63, 2 * n, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
        vocab, asked = h[::2], np.concatenate([h, h[::-1], np.array([0, 1, (1 << 64) - 1], np.uint64)])
        at, k = lsa_decontam.Model([], [], vocab, 32, 0.4, 0.75).terms(asked)
        assert at.tolist() == np.flatnonzero(np.isin(asked, vocab)).tolist() and (vocab[k] == asked[at]).all()


def test_passages_without_enough_of_an_items_words_are_not_compared(monkeypatch):
    asked, common = [], lsa_decontam.common
    monkeypatch.setattr(lsa_decontam, "common", lambda *x: asked.append(x) or common(*x))
    item = np.array([*range(30), *range(10)])
    masks, answer = lsa_decontam.masks_of(item), lsa_decontam.masks_of(item[-13:])
    look = lambda passage: lsa_decontam.alike(item, masks, answer, passage, 0.75)
    assert look([*range(10, 30), -1, *range(40, 80)]) == (0.0, 0) and look([12] * 100) == (0.0, 0) and look([]) == (0.0, 0) and not asked
    assert look([-1, -1, *item.tolist(), -1])[0] == 1 and look([*range(30), *range(5, 10)])[0] >= 0.75
    assert look([*range(29, 19, -1), *range(19, 9, -1), *range(10)]) == (0.0, 0) and asked


# 9: repeated spans


@settings(deadline=None)
@given(st.lists(st.integers(0, 4), max_size=60))
def test_suffix_array(s):
    assert repeated_spans.suffix_array(np.array(s, np.int64)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def test_doubled():
    s = np.random.default_rng(1).integers(0, 3, 200)
    assert repeated_spans.doubled(s).tolist() == sorted(range(200), key=lambda i: s[i:].tolist())


def test_suffix_array_of_more_places_than_21_bits_number():
    n = 3_300_000
    assert (repeated_spans.suffix_array(np.zeros(n, np.int64)) == np.arange(n - 1, -1, -1)).all()


def shorn(rows, length=50):
    seen, out = {}, {}
    for k, text in sorted(rows, key=lambda r: r[0]):
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        own = [b[i : i + length] for i in range(len(b) - length + 1)]
        for i, w in enumerate(own):
            if seen.get(w, k) < k:
                gone[i : i + length] = True
        for w in own:
            seen.setdefault(w, k)
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out[k] = (len(b), int(gone.sum()), int((np.diff(np.append(0, gone.astype(int))) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def test_repeated_spans(spark, rows):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op9_suffix_dedup(spark, SF).collect()}
    assert got == shorn(list(rows.items()))


@pytest.mark.parametrize("frequent", [25, 1])
def test_repeats_in_periodic_and_overlapping_texts(spark, monkeypatch, frequent):
    monkeypatch.setattr(repeated_spans, "FREQUENT", frequent)
    r = random.Random(9)
    passage = "".join(r.choice("abcdefgh ") for _ in range(90))
    made = [(k, "".join(r.choice("xyz ") for _ in range(r.randrange(60))) + passage[r.randrange(30) : 60 + r.randrange(30)] + "é" * r.randrange(3) + "".join(r.choice("uvw ") for _ in range(40))) for k in range(60)]
    made += [(100, "a" * 400), (101, "a" * 700 + "b"), (102, "ab" * 300), (103, "ab" * 310), (104, "a" * 49), (105, ""), (106, None)]
    got = repeated_spans.remove_repeats(spark.createDataFrame(made, "doc_id long, text string"))
    assert {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got.collect()} == shorn(made)


@pytest.mark.parametrize("small", [300, 1 << 19])
def test_parts_of_a_bucket_give_the_same_spans(monkeypatch, small):
    """A bucket in small parts (minimizers split by string, runs compared a few at a time) as in one."""
    monkeypatch.setattr(repeated_spans, "SORTED", small)
    monkeypatch.setattr(repeated_spans, "COMPARED", small)
    r = random.Random(5)
    passage = "".join(r.choice("abcdefgh ") for _ in range(120))
    made = [(k, "".join(r.choice("xyz ") for _ in range(r.randrange(60))) + passage[r.randrange(40) : 80 + r.randrange(40)] + "".join(r.choice("uvw ") for _ in range(30))) for k in range(80)]
    made += [(100, "ab" * 300), (101, "ab" * 310)]
    none = np.zeros(0, np.uint64)
    by_bucket = lambda batches: pa.Table.from_batches(list(batches)).sort_by([("bucket", "ascending"), ("kind", "ascending")]).to_batches()
    batch = pa.record_batch([pa.array([k for k, _ in made]), pa.array([0] * len(made)), pa.array([t for _, t in made])], ["doc_id", "row", "text"])
    first = pa.Table.from_batches(list(repeated_spans.compared(iter(by_bucket(repeated_spans.dealt(iter([batch]), 50, none, 3)))))).to_pylist()
    look = {k: [(x["lo"], x["n"]) for x in first if x["look"] and x["doc_id"] == k] for k, _ in made}
    lists = [pa.array([[p[i] for p in look[k]] for k, _ in made], pa.list_(pa.int32())) for i in (0, 1)]
    asked = pa.record_batch([*batch.columns, *lists], ["doc_id", "row", "text", "los", "ns"])
    rest = pa.Table.from_batches(list(repeated_spans.sorted_buckets(iter(by_bucket(repeated_spans.opened(iter([asked]), 50, none, 3))), 50))).to_pylist()
    own = {k: [x for x in first + rest if not x["look"] and x["doc_id"] == k] for k, _ in made}
    texts = pa.record_batch([batch.column(0), batch.column(2), *(pa.array([[x[c] for x in own[k]] for k, _ in made], pa.list_(pa.int32())) for c in ("lo", "n"))], ["doc_id", "text", "los", "ns"])
    got = pa.Table.from_batches(list(repeated_spans.shorn(iter([texts]), 50))).to_pylist()
    assert {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in got} == shorn(made)


@pytest.mark.parametrize("n", [1, 40])
def test_parts_stay_small_however_many_strings_are_equal(monkeypatch, n):
    """Runs of one minimizer, all of the same string (of one string each as frequent ones come, or of several)."""
    monkeypatch.setattr(repeated_spans, "SORTED", 1000)
    monkeypatch.setattr(repeated_spans, "COMPARED", 100)
    x = np.zeros(300, repeated_spans.RUN)
    x["doc"], x["row"], x["n"] = np.arange(300)[::-1] // 3, np.arange(300), n
    x["h"], x["body"] = n > 1, 7
    got = set()
    for y, own in repeated_spans.parts_of(x, np.full(300 * (n + 49), 97, np.uint8), 50):
        assert len(own) <= 1000 + 50
        run, first, count = repeated_spans.sorted_out(y, own, 50)
        for r, f, c in zip(y[run], first.tolist(), count.tolist(), strict=True):
            got |= {(int(r["row"]), int(r["lo"]) + f + i) for i in range(c)}
    assert got == {(k, i) for k in range(297) for i in range(n)}  # all but those of document 0


# 10: quality rules


def counted(text):
    w = re.findall("[^\x20\x09-\x0d]+", text or "")
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n = collections.Counter(windows)
    covered = {j for i, x in enumerate(windows) if n[x] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)


def test_quality(spark, docs, rows):
    got = queries.op10_quality_rules(spark, SF).collect()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == counted(rows[r.doc_id])
        assert not (r.base_failed and r.kept)
    kept = {r.doc_id for r in quality_rules.keep_good(docs).collect()}
    assert kept == {r.doc_id for r in got if r.kept}
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    clean = [k for k, x in labels.items() if x.quality == 1 and x.toxic == 0 and not counted(rows[k])[5]]
    junk = [k for k, x in labels.items() if x.quality == 0]
    assert len([k for k in clean if k in kept]) >= 0.97 * len(clean) and len([k for k in junk if k in kept]) <= 0.1 * len(junk)


def plain_em(rows, rounds=quality_rules.ROUNDS):
    """P(good) of every row of votes (0 bad, 1 none, 2 good), row by row."""
    x = np.array(rows)
    prior = {c: np.array(p) for c, p in quality_rules.PRIOR.items()}
    weight = quality_rules.WEIGHT * len(x) + 1
    q = (1 + (x == 2).sum(1)) / (2 + (x != 1).sum(1))
    for _ in range(rounds):
        odds = np.zeros(len(x))
        for c, mass in ((True, q), (False, 1 - q)):
            whole = mass.sum() + weight
            like = np.array([[(mass[x[:, j] == v].sum() + weight * prior[c][v]) / whole for v in range(3)] for j in range(x.shape[1])])
            odds += (1 if c else -1) * (np.log(like)[np.arange(x.shape[1]), x].sum(1) + np.log(whole))
        q = 1 / (1 + np.exp(-odds))
    return q


def pattern(votes):
    return sum(v * 3 ** (len(votes) - 1 - j) for j, v in enumerate(votes))


def test_posteriors_are_those_of_a_plain_em():
    r = random.Random(2)
    odd = lambda good: [r.choices([0, 1, 2], [[6, 3, 1], [1, 3, 6]][good])[0] for _ in quality_rules.RULES]
    rows = [odd(k % 4 > 0) for k in range(400)]
    post = quality_rules.posteriors(collections.Counter(map(pattern, rows)))
    assert np.allclose([post[pattern(x)] for x in rows], plain_em(rows), atol=1e-9)
    right = sum((post[pattern(x)] >= 0.5) == (k % 4 > 0) for k, x in enumerate(rows))
    assert right > sum((0 not in x) == (k % 4 > 0) for k, x in enumerate(rows)) and right >= 0.97 * len(rows)
    assert quality_rules.posteriors({}) == {}


def test_no_rule_has_a_veto_and_silence_counts():
    n = len(quality_rules.RULES)
    noisy = [[0 if k % 3 == 0 else 2, *[2] * (n - 1)] for k in range(600)]  # the first rule errs on a third of the good texts
    bad = [[r, *[0] * 4, *[1] * (n - 5)] for r in (0, 2) for _ in range(100)]  # the last ones keep silent on bad texts
    post = quality_rules.posteriors(collections.Counter(map(pattern, noisy + bad)))
    assert post[pattern([0, *[2] * (n - 1)])] > 0.9
    silent = quality_rules.posteriors(collections.Counter(map(pattern, [*noisy, *bad, [1] * n])))
    assert silent[pattern([1] * n)] < 0.5


def test_posteriors_beat_all_must_pass_on_labels(spark):
    """Of labelled documents that aren't base_failed, more good ones are kept than without any bad vote, and not more bad ones."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    kept = quality_rules.quality_report(docs).where("not base_failed").select("doc_id", "kept")
    votes = docs.join(labels, "doc_id").select("doc_id", "quality", "toxic", quality_rules.coded(quality_rules.let(F.col("text"), quality_rules.measures)).alias("p"))
    got = votes.join(kept, "doc_id").collect()
    passed = {r.doc_id for r in got if 0 not in quality_rules.digits(r.p)}
    stays = {r.doc_id for r in got if r.kept}
    clean, junk = {r.doc_id for r in got if r.quality and not r.toxic}, {r.doc_id for r in got if not r.quality}
    assert len(clean & stays) > len(clean & passed) and len(junk & stays) <= len(junk & passed)
    assert len(clean & stays) >= 0.99 * len(clean) and len(junk & stays) <= 0.02 * len(junk)


# All: SQL


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    got, want = queries.queries()[name](spark, SF), oracle_rows(SF, oracle.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got.toPandas()) == canon(want)


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_queries_equal_their_sql_on_odd_rows(spark, odd, tmp_path, name):
    """Null, empty, blank, tied, repeated and long texts, null ids; moved and repeated lines, near copies, licences, and junk."""
    r = random.Random(15)
    words = [f"w{k}" for k in range(300)]
    base = [" ".join(r.choices(words, k=9)) + "." for _ in range(12)]
    made = [(100 + k, "\n".join(r.sample(base, r.randrange(1, 12)) + [" ".join(r.choices(words, k=r.randrange(1, 40)))] * r.randrange(3))) for k in range(30)]
    near = r.choices(words, k=120)
    made += [(200 + k, " ".join(w if r.random() > 0.01 else "x" for w in near)) for k in range(12)]
    made += [(300, "# $ | " * 30), (301, "LOUD!! " * 40), (302, "mit license and CC BY-SA 4.0, gpl v3 only"), (303, "short"), (303, "other text of an id that is there twice")]
    more = spark.createDataFrame(made, "doc_id long, text string").selectExpr("doc_id", "text")
    odd.select("doc_id", "text").unionByName(more).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got, want = queries.queries()[name](spark, str(tmp_path)), oracle_rows(str(tmp_path), oracle.oracle_sql()[name], ["documents"])
    assert canon(got.toPandas()) == canon(want)


# All: odd rows and empty tables


def cases():
    return {
        "lines": lambda d: line_dedup.dedup_lines(d, report=True), "near": bagminhash.near_duplicates, "shards": sharding.shard_by_bytes, "pack": packing.pack, "licences": license_scan.license_report,
        "tokens": token_counts.token_counts, "repeats": repeated_spans.remove_repeats, "quality": quality_rules.quality_report,
    }


@pytest.mark.parametrize("name", sorted(cases()))
def test_odd_rows(odd, none, name):
    got = cases()[name](odd).collect()
    assert collections.Counter(r.doc_id for r in got if name != "pack" or r.start == 0) == collections.Counter([1, 2, 3, None, 4, 5, 5, 6, None])
    assert cases()[name](none).collect() == []


SAME = "same text here " * 20
NO_TEXT = hashlib.sha256(b"").hexdigest()


def values(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def test_values_of_odd_rows(spark, odd):
    """Null, empty, blank, tied, repeated and very long texts, and null ids, one operator after the other."""
    long, ids = odd.where("doc_id = 6").first().text, [1, 2, 3, 4, 5, 5, 6, None, None]
    texts = ["", "", " \n ", SAME, SAME, SAME, long, "one two three", ""]
    expect = lambda *columns: sorted(zip(ids, *columns, strict=True), key=repr)
    lines = values(line_dedup.dedup_lines(odd, report=True), "doc_id", "n_lines", "n_removed", "text")
    assert lines == expect([0, 0, 0, 1, 1, 1, 1, 1, 0], [0, 0, 0, 0, 1, 1, 0, 0, 0], [*texts[:4], "", "", *texts[6:]])
    near = values(bagminhash.near_duplicates(odd), "doc_id", "class_id", "n_shingles", "kept")
    assert near == expect([1, 1, 3, 4, 4, 4, 6, None, 1], [0, 0, 0, 56, 56, 56, 19_996, 1, 0], [True, False, True, True, False, False, True, False, False])
    shards = values(sharding.shard_by_bytes(odd), "doc_id", "size", "text_crc32")
    assert shards == expect([len(t) + 8 for t in texts], [zlib.crc32(t.encode()) for t in texts])
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    packed = values(packing.pack(odd).where("start = 0"), "doc_id", "doc_tokens")
    assert packed == expect([len(tokenizer.encode(t).ids) + 1 for t in texts])
    scan = values(license_scan.license_report(odd), "doc_id", "n_words", "n_base", "first_word", "base_labels", "labels", "score")
    assert scan == expect([0, 0, 0, 60, 60, 60, 20_000, 3, 0], [0] * 9, [None] * 9, [""] * 9, [""] * 9, [0.0] * 9)
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    tokens = values(token_counts.token_counts(odd), "doc_id", "n_bytes", "n_tokens")
    assert tokens == expect([len(t) for t in texts], [len(x) for x in sp.encode(texts)])
    whole, (_, gone, spans, kept) = shorn([(4, SAME), (5, SAME)]), shorn([(4, SAME), (5, SAME)])[5]
    rest = [NO_TEXT, NO_TEXT, hashlib.sha256(b" \n ").hexdigest(), whole[4][3], kept, kept, hashlib.sha256(long.encode()).hexdigest(), hashlib.sha256(b"one two three").hexdigest(), NO_TEXT]
    repeats = values(repeated_spans.remove_repeats(odd), "doc_id", "n_removed", "n_spans", "kept_sha256")
    assert repeats == expect([0, 0, 0, 0, gone, gone, 0, 0, 0], [0, 0, 0, 0, spans, spans, 0, 0, 0], rest)
    rules = values(quality_rules.quality_report(odd), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert all((r[0], *r[1:7]) == (r[0], *counted(t)) and not (r[6] and r[7]) for r, (_, t) in zip(rules, sorted(zip(ids, texts, strict=True), key=lambda x: repr((x[0], *counted(x[1])))), strict=True))


def test_odd_rows_of_tables(spark, odd, none):
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    assert {r.doc_id for r in lsa_decontam.contamination(odd, bench).collect()} == {None}
    assert lsa_decontam.contamination(none, bench).isEmpty()
    kept = {}
    stages = {"good": quality_rules.keep_good, "lines": line_dedup.dedup_lines, "near": bagminhash.drop_near_duplicates, "clean": lambda d: lsa_decontam.drop_contaminated(d, bench)}
    for name, keep in stages.items():
        assert keep(odd).columns == odd.columns and keep(none).columns == odd.columns and keep(none).isEmpty()
        kept[name] = keep(odd).collect()
        assert all(list(r)[3:] == list(range(len(odd.columns) - 3)) for r in kept[name])  # columns of clashing names keep their values
    none_first = lambda name: sorted(((r.doc_id, r.key) for r in kept[name]), key=repr)
    assert none_first("near") == [(1, "k"), (3, "k"), (4, "a"), (6, "z"), (None, "k")]
    assert len(kept["lines"]) == 9 and sorted(r.text or "" for r in kept["lines"]).count(SAME) == 1
    assert len(kept["clean"]) == 8 and all(r.text != "one two three" for r in kept["clean"])
    assert {r.doc_id for r in kept["good"]} <= {4, 5, 6}
    pages = odd.selectExpr("doc_id AS page_id", "key AS url", "text AS html", "text", "1 AS page")
    assert html_extract.extract_main_text(pages).count() == 9 and html_extract.extract_main_text(pages.limit(0)).isEmpty()


def test_pipeline_on_odd_rows_and_empty_tables(spark, odd, none, tmp_path):
    import corpus_pipeline

    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES:
            before = docs.columns
            docs = stage(spark, docs, SF)
            assert name == "packing" or docs.columns == before
            docs.collect()
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/benchmark.parquet").limit(0).write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).isEmpty()


def test_pipeline(spark):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in docs.collect()}
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and {r.doc_id for r in docs.collect()} <= before
    assert {r.doc_id for r in got} == {r.doc_id for r in docs.collect()}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "packing"]
