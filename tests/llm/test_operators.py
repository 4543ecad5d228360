"""Each operator against a brute-force version, the library, or planted cases, on small tables."""

import hashlib
import math
import random
import re
import zlib
from array import array
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from covaria.llm import bpe, common, exact_dedup, html_extract, language_id, ngram_join, packing, pitman_yor, quality_rules, token_counts, toxicity

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, w string, g long, h string, n long, block long, id long, score double, row string, norm string, rank string"
LONG = " ".join(f"word{k % 97}" for k in range(60_000))
SPACE = re.compile(r"[\x20\x09-\x0D]")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows):
    """docs with columns whose names clash with ones that operators use inside."""
    return spark.createDataFrame([(i, t, lang, "w", 1, "h", 2, 3, 4, 0.5, "r", "n", "k") for i, t, lang in rows], SCHEMA)


EDGES = [
    (1, None, None), (2, "", "en"), (3, " \n\t ", None), (4, "one", "en"), (5, "the cat sat on the mat today", "en"), (6, "The cat sat on  the mat today", "en"),
    (6, "The cat sat on  the mat today", "en"), (None, "a row without an id and some words", None), (7, LONG, "en"), (8, "日本語 text é ΑΣ <|endoftext|> ok", None), (9, "1234 !!! ???", "de"),
]


def identify(docs):
    plain = docs.select("doc_id", "text")
    return language_id.identify(plain, {"en": "the cat sat on the mat and the dog", "de": "der hund und die katze sind auf dem"})


def scored(docs):
    return toxicity.score(docs, ({}, toxicity.Trees(np.zeros((0, len(toxicity.FEATURES))), np.zeros(0)), toxicity.Isotonic(np.zeros(0), np.zeros(0))))


OPERATORS = {
    "op1": ngram_join.ngram_components,
    "op2": scored,
    "op3": identify,
    "op4": lambda d: bpe.bpe_round_trip(d, WORD),
    "op5": lambda d: packing.pack(d, BYTE),
    "op6": quality_rules.quality_rules,
    "op8": lambda d: pitman_yor.lm_scores(d.select("doc_id", (F.col("doc_id") == 5).alias("held_out"), "text")),
    "op9": lambda d: token_counts.token_counts(d, WORD),
    "op10": exact_dedup.exact_dedup,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_edge_rows_have_one_result_each(spark, name):
    got = OPERATORS[name](frame(spark, EDGES)).collect()
    ids = Counter(r["doc_id"] for r in got)
    if name == "op5":
        assert set(ids) == {i for i, _, _ in EDGES}
    else:
        assert ids == Counter(i for i, _, _ in EDGES)
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    assert by[6][0].asDict() == by[6][1].asDict() or name in ("op5", "op8")


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](frame(spark, [])).collect() == []


def near_copies(seed=3, groups=12, most=14):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(400)]
    shared = [r.choice(vocabulary) for _ in range(40)]
    docs = []
    for g in range(groups):
        base = [r.choice(vocabulary) for _ in range(r.choice((6, 30, 90, 150)))] + (shared if g % 3 == 0 else [])
        for _ in range(r.randint(1, most)):
            words = base[:]
            for _ in range(r.choice((0, 0, 1, 1, 2, 4, 9))):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            docs.append(" ".join(words) if r.random() < 0.8 else "\n".join(words).upper())
    r.shuffle(docs)
    return list(enumerate(docs, 100))


def brute_components(docs):
    sets = {}
    for i, t in docs:
        w = [x.lower() if x.isascii() else x for x in WORDS.findall(t or "")]
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = [i for i, _ in docs]
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            u = len(sets[a] | sets[b])
            if u and 100 * len(sets[a] & sets[b]) >= 80 * u:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("seed", [3, 4])
def test_ngram_join_finds_all_links(spark, seed):
    docs = near_copies(seed)
    want = brute_components(docs)
    # tiny counters and filters must not change results
    for sizes in ({}, {"slots": 1 << 15, "bits": 1 << 19}):
        got = ngram_join.ngram_components(frame(spark, [(i, t, None) for i, t in docs]).repartition(3), **sizes).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
        if seed == 4:
            break


def passages(n, seed=9, kinds=20, size=30, own=6):
    """n documents of one of `kinds` openings, their own words, and one of as many endings: many share passages, few link."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(5))
    a, b = ([[word() for _ in range(size)] for _ in range(kinds)] for _ in range(2))
    return [(k, " ".join([*r.choice(a), *(word() for _ in range(own)), *r.choice(b)])) for k in range(n)]


def probed(spark, docs):
    docs = frame(spark, [(i, t, None) for i, t in docs])
    counts = np.zeros(1 << 16, np.uint8)
    for i, t in ((r["doc_id"], r["text"]) for r in docs.collect()):
        for s in ngram_join.Sets()(pa.array([t])):
            counts[(s & np.uint64(0xFFFF)).astype(np.int64)] += 1
    entries = ngram_join._entries(docs, 5, counts, np.full(1 << 16, 255, np.uint8)).select(F.lit(0).cast("long").alias("g"), "h", F.col("doc_id").alias("id"), "n", "pos")
    return sum(ngram_join.search(docs, common.stored(entries, "test"), 5, counts)[1])


def test_shared_passages_do_not_pair_out(spark):
    """Four times the documents of the same passages: at most about four times the pairs that are probed."""
    few, many = probed(spark, passages(400)), probed(spark, passages(1600))
    assert many <= 6 * max(few, 400)


@pytest.mark.parametrize("short", [2, 32])
def test_ngram_join_on_shared_passages(spark, short):
    docs = passages(240, kinds=4, own=3) + passages(120, seed=10, kinds=3, own=9)
    docs = [(k, t) for k, (_, t) in enumerate(docs)]
    got = ngram_join.ngram_components(frame(spark, [(i, t, None) for i, t in docs]).repartition(3), short=short).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(docs)


def test_linked_is_the_exact_threshold():
    for n in range(1, 60):
        a = np.arange(n, dtype=np.uint64)
        for k in range(n + 1):
            b = np.concatenate([a[:k], np.arange(1000, 1000 + n - k, dtype=np.uint64)])
            assert ngram_join.linked(a, b) == (100 * k >= 80 * (2 * n - k))


def test_word_hashes_do_not_depend_on_chunks(spark, monkeypatch):
    r = random.Random(1)
    texts = [None if r.random() < 0.1 else "".join(r.choice("abC \n\té\x0b\x1c") for _ in range(r.choice((0, 1, 5, 30, 90)))) for _ in range(300)]
    words = [(t or "").encode().lower().split() for t in texts]
    of, counts = {}, None
    for chunk in (7, 64, 1 << 20):
        monkeypatch.setattr(common, "_CHUNK", chunk)
        h, n = common.WordHashes()(pa.array(["x", *texts, "y"]).slice(1, len(texts)))
        assert n.tolist() == list(map(len, words))
        assert counts is None or (h == counts).all()
        counts = h
    for w, x in zip((w for ws in words for w in ws), counts.tolist(), strict=True):
        assert of.setdefault(w, x) == x
    assert len(set(of.values())) == len(of)


def test_components_of_paths_and_hubs(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, k) for k in range(101, 160)] + [(159, 7)]
    got = {r["id"]: r["root"] for r in common.components(spark.createDataFrame(edges, "a long, b long"), "test").collect()}
    assert set(got.values()) == {0} and len(got) == 30 + 60


def test_bpe_matches_the_library(spark):
    from tokenizers import Tokenizer

    r = random.Random(1)
    texts = [t for _, t, _ in EDGES if t] + ["a" * 3000, "ab" * 700 + "!" * 900, "'s don't I'LL\x85x"]
    texts += ["".join(r.choice("etaoin shrdluETA.,'’|\n é") for _ in range(r.randint(1, 300))) for _ in range(60)]
    texts += ["".join(chr(r.choice([r.randint(1, 0x2FF), r.randint(0x370, 0x1FFF), r.randint(0x2000, 0xD7FF)])) for _ in range(40)) for _ in range(40)]
    for path in (WORD, BYTE):
        library, own = Tokenizer.from_file(path), bpe.Pieces(path, most=50)
        for t in texts:
            ids, decoded = own(t.encode())
            want = library.encode(t, add_special_tokens=False).ids
            assert list(array("I", ids)) == want
            assert decoded.decode() == library.decode(want, skip_special_tokens=False)
    tokens = bpe.Tokens(WORD, window=32)
    assert tokens._plain("abcdefghij" * 400) == bpe.Tokens(WORD, window=10_000)._plain("abcdefghij" * 400)


def test_bpe_of_long_texts_goes_part_by_part():
    from tokenizers import Tokenizer

    text = " ".join(f"word{k % 97} naïve-{k}!\u2003x" for k in range(4000))
    for path in (WORD, BYTE):
        parts = list(bpe.Pieces(path).stream(text.encode(), 1000))
        want = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
        assert len(parts) > 20 and list(array("I", b"".join(p[0] for p in parts))) == want
        assert b"".join(p[1] for p in parts).decode() == Tokenizer.from_file(path).decode(want, skip_special_tokens=False)


def test_bpe_digest(spark):
    row = bpe.bpe_round_trip(frame(spark, [(1, "Hello there", None)]), WORD, texts=True).first()
    assert row["n_tokens"] == len(row["ids"]) == 2
    assert row["ids_sha256"] == hashlib.sha256(array("I", row["ids"]).tobytes()).hexdigest()
    assert row["decoded_sha256"] == hashlib.sha256(row["decoded"].encode()).hexdigest()


def test_lookahead_is_sufficient():
    """Tokens that end before the lookahead do not change with any continuation."""
    tokens = bpe.Tokens(BYTE)
    merges, r = tokens.merges, random.Random(5)
    for _ in range(300):
        a = [tokens.base[ord(r.choice("aeinrst "))] for _ in range(merges.lookahead + 40)]
        b = a + [tokens.base[ord(r.choice("aeinrst "))] for _ in range(30)]
        at, got = 0, merges.apply(a[:])
        whole = merges.apply(b[:])
        for x, y in zip(got, whole, strict=False):
            at += tokens.lengths[x]
            if at > len(a) - merges.lookahead:
                break
            assert x == y


def test_packing_is_a_partition_with_little_padding(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTE)
    docs = spark.read.parquet(f"{SF}/documents.parquet").union(spark.createDataFrame([(10**9, None, None, None, None), (10**9 + 1, "", None, None, None)], "doc_id long, text string, lang string, source string, n_chars long"))
    pieces = packing.pack(docs.repartition(3), BYTE).collect()
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_bin[p["sequence_id"]].append(p)
    for r in docs.collect():
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        at = 0
        for p in sorted(by_doc[r["doc_id"]], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(array("I", ids[at : at + p["length"]]).tobytes())
            at += p["length"]
        assert at == len(ids)
    tokens = padded = 0
    for run in by_bin.values():
        at = 0
        for p in sorted(run, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert 0 < at <= 2048
        tokens += at
        padded += at if at & (at - 1) == 0 else 2048
    assert padded <= 1.01 * tokens
    assert len(pieces) < len(by_doc) + 2.5 * tokens / 2048 + 50


@pytest.mark.parametrize("lengths", [[0], [1] * 5000, [700] * 9, [1024, 1024, 1023], [2047] * 40 + [3] * 50, [5000, 2048, 100_000], list(range(1, 900))])
def test_packer_places_every_token_once(lengths):
    packer, pieces = packing.Packer(3), []
    for k, n in enumerate(lengths):
        pieces += packer.add(k, array("I", range(n)).tobytes())
        assert packer.room < 2 * 2048 and len(packer.open) <= packing.CLASSES
    pieces += packer.end()
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p[0]].append(p)
        by_bin[p[5]].append(p)
    for k, n in enumerate(lengths):
        at = 0
        for _, start, length, crc, total, _, _ in sorted(by_doc[k], key=lambda p: p[1]):
            assert start == at and total == n and crc == zlib.crc32(array("I", range(at, at + length)).tobytes())
            at += length
        assert at == n
    sizes = []
    for run in by_bin.values():
        at = 0
        for p in sorted(run, key=lambda p: p[6]):
            assert p[6] == at
            at += p[2]
        sizes.append(at)
    assert all(2048 - n <= 16 or n & (n - 1) == 0 for n in sizes)
    assert len(pieces) <= len(lengths) + 3 * len(sizes)


def brute_counts(text):
    text = text or ""
    w = WORDS.findall(text)
    seen = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {k + d for k, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if seen[g] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark):
    rows = [(k, t, None) for k, (_, t, _) in enumerate(EDGES)] + [(100 + k, r["text"], None) for k, r in enumerate(spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect())]
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(frame(spark, rows)).collect()}
    for i, t, _ in rows:
        r = got[i]
        n, chars, symbols, lines, repeat = brute_counts(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, lines, repeat)
        assert r["base_failed"] == (n < 50 or 100 * repeat > 50 * n)
        assert not (r["kept"] and r["base_failed"])


def test_quality_verdict_keeps_prose_and_drops_junk(spark):
    words = [f"subject{k} was of{k} the kind{k * 7}" for k in range(30)]
    prose, junk = " ".join(words), " ".join(f"item{k} |" for k in range(80))
    got = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(frame(spark, [(1, prose, None), (2, junk, None)])).collect()}
    assert got == {1: True, 2: False}


PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><a href="/">Site</a></header><nav><ul><li><a>Menu</a></ul></nav>'
    '<div class="cookie-notice">We use cookies</div><script>var x = "</p>";</script><article><h1>Head &amp; line</h1><p>One  two<br>three <b>bo</b>ld<p>Next &lt;tag&gt;'
    '<div class="ad">Buy</div><blockquote>Said</blockquote><form><input>F</form></article><aside>Side</aside><section id="comments"><p>A comment</p></section><footer>&copy; x</footer>'
)


def test_html_text(spark):
    rows = [(1, "http://a.example/x", PAGE), (2, "http://a.example/y", None), (3, None, "<p>Only text"), (4, "http://a.example/z", ""), (5, "x", "no markup  at all"), (1, "http://a.example/x", PAGE)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, path string").withColumn("host", F.lit("z"))
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in html_extract.extract(pages).orderBy("page_id").collect()]
    text = "Head & line\n\nOne two three bold\n\nNext <tag>\n\nSaid"
    want = [(1, text), (1, text), (2, ""), (3, "Only text"), (4, ""), (5, "no markup at all")]
    assert got == [(i, t, len(t)) for i, t in want]
    assert html_extract.extract(pages.limit(0)).collect() == []


def test_html_marks():
    page = lambda body: html_extract.Page(body).text("")
    wrapper = '<div class="content has-sidebar"><h1>T</h1><p>The text of the page is here, it is long.</p><div class="sidebar">Side</div></div>'
    assert page(f"<body>{wrapper}<div class=comments><p>said</p></div>") == "T\n\nThe text of the page is here, it is long."
    assert page('<body><h1>T</h1><p>short</p><div class="reader-comments"><p>' + "much longer than the text " * 9 + "</p></div>") == "T\n\nshort"
    assert page("<body><main><table><tr><td>a<td>b<tr><td>c</table><ul><li>d<li>e</ul></main>") == "a\n\nb\n\nc\n\nd\n\ne"
    assert page("<body><article>a &amp;lt; b&nbsp;c <a href='x>y'>d</a></article>") == "a &lt; b c d"


def test_html_elements_without_an_end_tag():
    page = lambda body: html_extract.Page(body).text("")
    for odd in ("<svg class=i/>", "<svg><path d='M0'/>", "<svg/><svg><title>t</svg>", "<svg><style/><text>t</text></svg>", "<button>t", "<select><option>t", "<video src=v>", "<noscript>t", "<svg>t<svg>u</svg>"):
        assert page(f"<p>one</p>{odd}<p>two</p>") == page(f"<div><p>one{odd}</p><p>two</p></div><p><svg>x</svg>") == "one\n\ntwo", odd
    assert page("<html><head><meta charset=u><title>T</title><style>p{}</style><link rel=x><body><h1>H</h1><p>two</p>") == "H\n\ntwo"
    assert page("<head><title>T</title><p>one</p>") == "one"
    assert page("<p>one <math><mi>x</mi><mo>=</mo><mn>1</mn></math> two</p>") == "one x=1 two"
    assert page("<p>a<button>b<p>c</p></button>d<svg>e<svg>f</svg>g</svg>h</p>") == "adh"
    assert page("<p>one</p><script>var x = '<p>';") == page("<p>one</p><textarea>two<p>three") == "one"
    odd = "<svg><button>t" * 20_000
    assert page(f"<p>one</p>{odd}<p>two</p>") == "one\n\ntwo"


def test_html_headers_and_searches():
    page = lambda body: html_extract.Page(body).text("")
    assert page("<main><header><h1>Title</h1></header><p>text</p></main>") == "Title\n\ntext"
    assert page("<main><header><p>Site</p></header><p>text</p></main>") == "text"
    assert page('<body><h1>T</h1><section class="search-history"><p>about searches</p></section><div class="search-box">find</div><div class="site-search">find</div>') == "T\n\nabout searches"
    assert page("<article>a <button-group>b</button-group> c</article>") == "a b c"


def test_html_paths_without_a_broadcast(spark):
    rows = spark.createDataFrame([(k, f"u{k}", "<p>x", f"h{k % 3}") for k in range(20)] + [(None, None, None, "")], "page_id long, url string, html string, host string")
    paths = spark.createDataFrame([("h0", ">body"), ("h1", ">main")], "host string, path string")
    one, other = (sorted(map(str, html_extract._with_paths(rows, paths, most=n).collect())) for n in (1 << 20, 0))
    assert one == other and len(one) == 21


def test_html_ties_go_to_the_first_path(spark):
    pages = spark.createDataFrame([(k, "http://t.example/", f"<body><div class={c}><h1>T</h1><p>same text</p></div>") for k, c in enumerate("ba")], "page_id long, url string, html string")
    assert [r["path"] for r in html_extract.winning_paths(pages).collect()] == [">body>div.a"]


def test_html_of_a_very_long_page():
    body = "<p>" + "</p><p>".join(f"block {k} of the page" for k in range(60_000)) + "</p>"
    text = html_extract.Page(f"<body><nav>menu</nav><article>{body}</article>").text("")
    assert text.count("\n\n") == 59_999 and text.startswith("block 0 of") and "menu" not in text


def test_html_consensus_outvotes_an_odd_page(spark):
    good = "<body><div class=main{k}><h1>T{k}</h1>" + "<p>long text of the article, with words</p>" * 5 + "</div><div class=extra><p>{more}</p></div>"
    rows = [(k, "http://b.example/", good.format(k=k, more="tail")) for k in range(5)] + [(9, "http://b.example/", good.format(k=9, more="much more text than the article itself has, " * 9).replace("<h1>T9</h1>", ""))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert [r["path"] for r in html_extract.winning_paths(pages).collect()] == [">body>div.main#"]
    odd = {r["page_id"]: r["text"] for r in html_extract.extract(pages).collect()}[9]
    assert "much more" not in odd and odd.count("long text") == 5


def phrases(reference, text):
    """Greedy longest matches, by substring search."""
    n = k = 0
    while k < len(text):
        e = k + 1
        while e <= len(text) and text[k:e] in reference:
            e += 1
        k = max(k + 1, e - 1)
        n += 1
    return n


@pytest.mark.parametrize("dense", [language_id.DENSE, 0])
def test_cross_parsing_equals_substring_search(spark, monkeypatch, dense):
    """Whole texts, whatever the blocks; tables and sorted transitions alike."""
    monkeypatch.setattr(language_id.Automaton.__init__, "__defaults__", (dense,))
    rows = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    texts = defaultdict(str)
    for r in rows[:100]:
        texts[r["lang"]] += r["text"][:1500]
    model = language_id.Model({k: v[:4000] for k, v in texts.items()})
    refs = [bytes(model.read([texts[lang][:4000]])[0].astype(np.uint8)) for lang in model.langs]
    some = [r["text"][:3000] for r in rows[100:120]] + ["", "  \n", "?!", "日本語", "a", "ab" * 600, texts[model.langs[0]][:3900]]
    counts = []
    for t in some:
        x = bytes(model.read([t])[0].astype(np.uint8))
        counts.append([math.ceil(phrases(ref, x) * w - 1e-9) for ref, w in zip(refs, model.weights, strict=True)])
    for block in (7, 100, 1024):
        langs, scores = model.predict(some, block)
        for t, c, lang, s in zip(some, counts, langs, scores, strict=True):
            two = sorted(c)
            assert lang == (model.langs[int(np.argmin(c))] if any(map(str.isalpha, t)) else "und")
            assert s == (two[1] / (two[0] + two[1]) if lang != "und" else 0.0)


def test_a_large_alphabet_takes_little_memory():
    r = random.Random(4)
    letters = [chr(0x4E00 + k) for k in range(3000)]
    text = "".join(r.choice(letters) for _ in range(20_000))
    model = language_id.Model({"zh": text, "en": "the cat sat on the mat " * 300})
    assert sum(x.nbytes for a in model.automata for x in (a.steps, a.keys, getattr(a, "next", None)) if x is not None) < 64 << 20
    assert model.predict([text[500:800], "a cat on a mat"])[0] == ["zh", "en"]


def test_references_are_whole_texts(spark):
    rows = [(k, "wort " * 40, "de") for k in range(9)] + [(20, "x" * 900, "long"), (21, "y" * 800, "long"), (22, None, "none"), (23, "text", None), (24, "", "empty")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.reference_texts(docs, chars=700)
    assert got == {"de": "\n".join(["wort " * 40] * 3), "long": "y" * 800}
    assert language_id.reference_texts(docs.limit(0)) == {}


def test_identify_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "the cat", 7)], "id long, text string, `a b`  int").withColumn("score", F.lit("x"))
    got = language_id.identify(docs, {"en": "the cat"}).first()
    assert got["a b"] == 7 and got["lang_pred"] == "en" and got["score"] == 1.0


def test_rare_languages_leave_the_others_alone(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    docs = spark.createDataFrame([(r["doc_id"], r["text"], r["lang"]) for r in rows[:100]] + [(-1, "Jumps fox over quick the lazy brown dog.", "aa"), (-2, "12 34 !?", "ab")], "doc_id long, text string, lang string")
    model = language_id.Model(language_id.reference_texts(docs))
    some = [r for r in rows[100:] if len(r["text"] or "") > 100 and r["lang"]]
    langs, _ = model.predict([r["text"] for r in some])
    assert "ab" not in model.langs and sum(lang == r["lang"] for lang, r in zip(langs, some, strict=True)) > 0.97 * len(some)
    assert model.predict(["quick the lazy brown dog"])[0] == ["aa"]
    assert language_id.Model({"ab": "12"}).predict(["text"]) == (["und"], [0.0])


def test_language_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = language_id.op3(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    right, n = got.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert right / n > 0.97


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    got = toxicity.op2(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    hit = sum(r["predicted"] == 1 and r["toxic"] == 1 for r in got)
    assert hit / sum(r["predicted"] for r in got) > 0.9 and hit / sum(r["toxic"] for r in got) > 0.85
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)


def test_repeated_labels_count_once_and_null_ones_not(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (None, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (1, 0), (2, 0), (2, None), (3, None), (None, 1)], "doc_id long, toxic int")
    assert sorted((r["doc_id"], r["toxic"]) for r in toxicity.sampled_labels(docs, labels).collect()) == [(1, 1), (2, 0)]


def test_isotonic_is_monotone_and_trees_learn():
    r = np.random.default_rng(0)
    x = r.standard_normal((3000, 4))
    y = (x[:, 0] + x[:, 1] ** 2 + r.standard_normal(3000) * 0.3 > 1).astype(float)
    trees = toxicity.Trees(x[:2000], y[:2000], rounds=60)
    m = trees.margin(x[2000:])
    assert ((m > 0) == (y[2000:] > 0)).mean() > 0.9
    curve = toxicity.Isotonic(m, y[2000:])
    p = curve(np.linspace(-8, 8, 200))
    assert (np.diff(p) >= 0).all() and p.min() >= 0 and p.max() <= 1


def test_lm_base_is_exact_and_model_beats_it(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", (common.remainder(F.col("doc_id"), 7) == 2).alias("held_out"), "text")
    got = {r["doc_id"]: r for r in pitman_yor.lm_scores(docs, block_tokens=9000).collect()}
    tokens = {r["doc_id"]: [*(w.lower() if w.isascii() else w.encode().lower().decode() for w in WORDS.findall(r["text"])), "\n"] for r in docs.collect()}
    c = Counter(w for i, t in tokens.items() if not got[i]["held_out"] for w in t)
    n, v = sum(c.values()), len(c)
    model = base = 0.0
    for i, t in tokens.items():
        r = got[i]
        assert r["n_tokens"] == len(t) and r["train_tokens"] == n and r["n_known"] == sum(c[w] > 0 for w in t)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
        assert r["score"] < 0
        if r["held_out"]:
            model, base = model + r["score"], base + r["base_score"]
    assert model > base
    rates = {r["held_out"]: r for r in pitman_yor.perplexity(spark.createDataFrame(list(got.values()))).collect()}
    tokens_held = sum(r["n_tokens"] for r in got.values() if r["held_out"])
    assert math.isclose(rates[True]["perplexity"], 10 ** (-model / tokens_held)) and rates[True]["perplexity"] < rates[True]["base_perplexity"]


def test_lm_probabilities_sum_to_about_one(spark):
    """All texts of up to two words, where training texts have two: with one unseen word they hold nearly all probability."""
    r = random.Random(2)
    words = ["ab", "cd", "ef", "gh", "ij", "never"]
    train = [(k, f"{r.choice(words[:5])} {r.choice(words[:5])}", False) for k in range(600)]
    tests = [(1000 + 10 * a + b, f"{words[a]} {words[b]}", True) for a in range(6) for b in range(6)] + [(2000 + a, words[a], True) for a in range(6)] + [(3000, None, True)]
    docs = spark.createDataFrame(train + tests, "doc_id long, text string, held_out boolean")
    p = {i["doc_id"]: 10 ** i["score"] for i in pitman_yor.lm_scores(docs).where("held_out").collect()}
    assert len(p) == len(tests) and all(v > 0 for v in p.values())
    assert 0.6 < sum(p.values()) < 1.01


def test_stirling_ratios():
    """S(c, t) as sums over partitions of c customers into t tables, each weighed by rising products."""
    d = 0.6
    s = {(1, 1): 1.0}
    for c in range(2, 300):
        for t in range(1, c + 1):
            s[c, t] = s.get((c - 1, t - 1), 0.0) + (c - 1 - d * t) * s.get((c - 1, t), 0.0) if c < 60 else 0.0
    found = pitman_yor.Stirling(d)
    for c in (2, 3, 7, 40, 59):
        at, scale = found.place(np.array([c]))
        for t in range(1, c):
            assert math.isclose(found.ratio(at, scale, t)[0], s[c, t + 1] / s[c, t], rel_tol=1e-9)
    small, large = pitman_yor.Stirling(d, 256), pitman_yor.Stirling(d, 1024)
    for t in (1, 3, 9, 20):  # the scaling law against the table
        a, b = (x.ratio(*x.place(np.array([1000])), t)[0] for x in (small, large))
        assert math.isclose(a, b, rel_tol=0.05)


def test_seatings_follow_the_exact_posterior():
    """One restaurant whose every seating can be weighed: mean tables and mean share of the parent."""
    c, p0, d, theta = [6, 3, 2, 1], [0.3, 0.1, 0.05, 0.2], 0.5, 2.0
    s = {(1, 1): 1.0}
    for n in range(2, 7):
        for t in range(1, n + 1):
            s[n, t] = s.get((n - 1, t - 1), 0.0) + (n - 1 - d * t) * s.get((n - 1, t), 0.0)
    total, mean = 0.0, np.zeros(4)
    for ts in np.ndindex(*c):
        ts = [t + 1 for t in ts]
        weight = math.prod(s[n, t] * p**t for n, t, p in zip(c, ts, p0, strict=True)) * math.prod(theta + d * k for k in range(sum(ts)))
        total += weight
        mean += weight * np.array(ts)
    copies = 4000
    rooms = np.repeat(np.arange(copies), 4)
    kept = pitman_yor.seat(np.tile(c, copies), rooms, copies, np.tile(p0, copies), d, common.mix64(np.arange(4 * copies, dtype=np.uint64)), theta=theta, sweeps=12, burn_in=6)
    got = np.mean([t.reshape(copies, 4).mean(0) for t in kept], axis=0)
    assert np.allclose(got, mean / total, atol=0.02)


def test_lm_scores_do_not_depend_on_the_layout(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", (F.col("doc_id") % 5 == 0).alias("held_out"), "text")
    one, many = (sorted(pitman_yor.lm_scores(docs.repartition(k), block_tokens=n, part_tokens=1 << 14).collect()) for k, n in ((1, 1 << 21), (7, 5000)))
    assert len(one) == 200
    for a, b in zip(one, many, strict=True):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9) and math.isclose(a[6], b[6], rel_tol=1e-9)


def test_token_counts_match_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD)
    rows = [(k, t, None) for k, (_, t, _) in enumerate(EDGES)] + [(100 + k, r["text"], None) for k, r in enumerate(spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect())]
    got = {r["doc_id"]: r for r in token_counts.token_counts(frame(spark, rows), WORD).collect()}
    for i, t, _ in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len((t or "").encode()), n > 2048)
    for path in (BYTE, public_tokenizers.path("piece_bpe_32k.model")):
        assert token_counts.Counter(path).count([b"Hello there", b""])[1] == 0


def brute_dedup(rows):
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[SPACE.sub("", t or "")].append((-len(t or ""), i if i is not None else 2**63, i))
    return {key: (min(v)[2], len(v)) for key, v in groups.items()}


@pytest.mark.parametrize("bits", [128, 4])
def test_exact_dedup(spark, bits):
    rows = [*EDGES, (20, "xyz", None), (21, "x y z ", None), (22, "x y z ", None), (23, "XYZ", None)] + [(100 + k, f"text {k % 40}" + " " * (k % 3), None) for k in range(200)]
    want = brute_dedup(rows)
    got = exact_dedup.exact_dedup(frame(spark, rows), bits).collect()
    assert len(got) == len(rows)
    texts = {i: t for i, t, _ in rows}
    for r in got:
        key = SPACE.sub("", texts[r["doc_id"]] or "")
        keep, n = want[key]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (keep, n, r["doc_id"] == keep)
        assert r["text_sha256"] == hashlib.sha256(key.encode()).hexdigest()


def test_exact_dedup_runs_no_python(spark):
    plan = exact_dedup.exact_dedup(frame(spark, EDGES))._jdf.queryExecution().optimizedPlan().toString()
    assert "InArrow" not in plan and "Python" not in plan


def test_isotonic_pools_equal_margins_whatever_their_order():
    m, y = np.array([0.0] * 4 + [1.0] * 4), np.array([0, 0, 1, 1, 0, 1, 1, 1.0])
    curves = [toxicity.Isotonic(m[p], y[p]) for p in (np.arange(8), np.arange(8)[::-1], np.array([2, 0, 3, 1, 7, 4, 6, 5]))]
    assert all(c.x.tolist() == [0.0, 1.0] for c in curves)
    assert all(np.array_equal(c(m), curves[0](m)) for c in curves)
    assert curves[0].y == pytest.approx([(2 + 0.5) / 5, (3 + 1 / (1 + math.exp(-1))) / 5])


def test_first_split_has_the_largest_gain_of_all():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 6, (200, 3)).astype(float)
    y = (x[:, 1] + rng.normal(0, 1, 200) > 3).astype(float)
    trees = toxicity.Trees(x, y, rounds=1, depth=1)
    p = 1 / (1 + math.exp(-trees.start))

    def gain(left):
        sides = [((y[s] - p).sum() ** 2 / (s.sum() * p * (1 - p) + 1.0), s.sum() * p * (1 - p)) for s in (left, ~left)]
        return sum(g for g, _ in sides) if min(h for _, h in sides) >= 3.0 else -1.0

    best = max(gain(x[:, f] <= c) for f in range(3) for c in range(6))
    (feature, cut), = trees.trees[0][0]
    assert gain(x[:, feature[0]] <= trees.edges[feature[0]][cut[0]]) == pytest.approx(best)


@pytest.mark.parametrize("labels", [[], [None, None, None, None], [0, 0, 0, 0], [1, 1, 1, 1], [0, 1, None, 1]])
def test_toxicity_fits_few_null_and_one_class_labels(spark, labels):
    """Nothing learned gives the labels' smoothed share, one for all texts; a null or empty text has a score too."""
    texts = ["you are fine", None, "", "a clean text of some words"]
    rows = [(k, t, y) for (k, t), y in zip(enumerate(texts), labels, strict=False)]
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    got = toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    assert len(got) == 4 and all(0 <= r["score"] <= 1 for r in got)
    known = [y for y in labels if y is not None]
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in got)
    if len(set(known)) < 2:
        assert len({r["score"] for r in got}) == 1
        assert got[0]["score"] == pytest.approx((sum(known) + 0.5) / (len(known) + 1), abs=0.2)
