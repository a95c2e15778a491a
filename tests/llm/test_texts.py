"""Operators on single texts against plain versions of themselves."""

import hashlib
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomline.llm import bpe, decontam, html_main, license_scan, toxicity
from loomline.llm.bytewords import Words, pieces, text_bytes

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
ODD = [None, "", " ", "one", "É'ß 42\x00x\x1cy z", "ΣΑΣ İ K <|endoftext|>a<|startoftext|> I'M we'Ve", "aaaa aaaaaaa haha" * 40, "²Ⅷ½ 日本語 � é", "!!! ... ---"]
TEXTS = "id bigint, text string, ids string, words string, row string, key string"


def words_of(text):
    return WORD.findall((text or "").encode().translate(FOLD))


def frame(spark, texts):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "a", "b", "c", "d") for i, t in enumerate(texts)], TEXTS.replace("id bigint", "doc_id bigint"))


def test_words_and_pieces():
    texts = [*ODD, "x" * 5000, "a b" * 3000]
    buf, off = text_bytes(pa.array(texts))
    got = [[] for _ in texts]
    for lo, hi, b, o in pieces(buf, off, 1000):
        w = Words(b, o)
        for d in range(hi - lo):
            got[lo + d] = [bytes(w.low[s:e]) for s, e in zip(w.start[w.off[d] : w.off[d + 1]], w.end[w.off[d] : w.off[d + 1]], strict=True)]
    assert got == [words_of(t) for t in texts]
    w = Words(*text_bytes(pa.array(["a b c", "a b", "a b c"])))
    at, h = w.grams(3)
    assert at.tolist() == [0, 5] and h[0] == h[1]


def test_bpe_is_the_library(spark):
    lib = Tokenizer.from_file(bpe.default_path())
    some = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(40).collect()]
    got = bpe.encode(frame(spark, ODD + some), piece_bytes=3000).orderBy("doc_id").collect()
    for t, r in zip(ODD + some, got, strict=True):
        want = lib.encode(t or "", add_special_tokens=False)
        assert np.frombuffer(r.ids, "<u4").tolist() == want.ids
        assert r.decoded == lib.decode(want.ids, skip_special_tokens=False) == bpe.tokenizer(bpe.default_path()).decode(r.ids)
    assert bpe.encode(frame(spark, []).limit(0)).count() == 0


def test_bpe_forgets_and_goes_on(monkeypatch):
    b = bpe.WordBpe(bpe.default_path())
    want = [x.to_pylist() for x in b.encode_batch(["some words here, and more of them", "words again"])]
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    assert [x.to_pylist() for x in bpe.WordBpe(bpe.default_path()).encode_batch(["some words here, and more of them", "words again"])] == want


def test_toxicity(spark):
    rng = np.random.default_rng(0)
    vocabulary = ["".join(rng.choice(list("abcdefg"), 6)) for _ in range(300)]
    texts, toxic = [], []
    for i in range(900):
        bad = i % 6 == 0
        texts.append(" ".join([*rng.choice(vocabulary, 30), *(["scumbag", "vilething"] if bad else [])]))
        toxic.append(int(bad))
    docs = frame(spark, texts + ODD)
    labels = spark.createDataFrame([(i, t) for i, t in enumerate(toxic)] + [(0, 1), (None, 1), (3, None), (10**6, 1)], "doc_id bigint, toxic int")
    model = toxicity.train(docs, labels, max_rows=600)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [i for i in range(900) if toxicity.held_out(i)]
    right = sum((got[i] >= toxicity.THRESHOLD) == bool(toxic[i]) for i in held)
    assert right / len(held) > 0.98 and all(0 <= s <= 1 for s in got.values())
    assert all(got[900 + k] < toxicity.THRESHOLD for k in range(len(ODD)))
    assert toxicity.score(docs, model).columns == [*docs.columns, "score"]
    nothing = toxicity.train(docs, labels.where("toxic = 0"))
    assert toxicity.score(docs, nothing).agg(F.max("score")).first()[0] < 1e-9
    assert toxicity.score(docs.limit(0), model).count() == 0 and toxicity.train(docs.limit(0), labels).features.size == 0


def test_risk_never_takes_unlabelled_for_negative():
    """Positives hidden among the unlabelled keep a high score."""
    rows = [np.array([0])] * 40 + [np.array([0])] * 40 + [np.array([1])] * 120
    p, u = np.r_[np.ones(40), np.zeros(160)], np.r_[np.zeros(40), np.ones(160)]
    w, b = toxicity.nnpu_fit(rows, p, u, 2, 0.25)
    assert w[0] + b > 1 > -1 > w[1] + b


def brute_hits(docs, items, window=13):
    found = {}
    for i, t in items:
        w = words_of(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            found.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = {}
    for i, t in docs:
        w, hit, ids = words_of(t), set(), set()
        for n in {len(k) for k in found}:
            for k in range(len(w) - n + 1):
                if (x := found.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    ids |= x
        out[i] = len(w), len(hit), sorted(ids), bool(hit) and 20 * len(hit) >= len(w)
    return out


@pytest.mark.parametrize("block", [4_000_000, 60])
def test_decontamination(spark, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
    rng = np.random.default_rng(1)
    text = lambda n: " ".join(rng.choice(list("abc"), n))
    items = [(1, text(30)), (2, text(14)), (2, text(20)), (3, "Rare Word"), (4, ""), (5, None), (6, "ÉTÉ-x"), (7, "single")]
    docs = [*enumerate([*(text(int(n)) for n in rng.integers(0, 400, 40)), items[0][1], "x " + items[0][1] + " y", "a rare, word b", "été x ÉTÉ x", "a single b", None, "", text(9000)])]
    got = decontam.scan(frame(spark, [t for _, t in docs]), spark.createDataFrame(items, "item_id int, text string"))
    assert {r.doc_id: (r.n_words, r.n_hit, r["items"], r.contaminated) for r in got.collect()} == brute_hits(docs, items)
    longest = got.where("doc_id = 41").first()
    assert longest.spans[0].asDict() == {"start": 1, "end": 31}
    none = decontam.scan(frame(spark, ["a b"]), spark.createDataFrame([], "item_id int, text string")).first()
    assert (none.n_words, none.n_hit, none.contaminated) == (2, 0, False)


@pytest.mark.parametrize("block", [4_000_000, 60])
def test_contaminated_rows_go_one_by_one(spark, monkeypatch, block):
    """Repeated and null ids: each row is judged by its own text, whatever the number of blocks."""
    monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
    item, other = (" ".join(f"{x}{i}" for i in range(30)) for x in ("word", "other"))
    items = spark.createDataFrame([(1, item), (2, "some more text of another item"), (3, item + " on"), (None, None)], "item_id int, text string")
    rows = [(1, item), (1, other), (None, item), (None, other), (2, other), (2, other), (3, None), (4, "")]
    docs = spark.createDataFrame([(i, t, "a", "b", "c", "d") for i, t in rows], TEXTS.replace("id bigint", "doc_id bigint"))
    got = decontam.without_contaminated(docs, items)
    assert got.columns == docs.columns
    assert sorted(str((r.doc_id, r.text)) for r in got.collect()) == sorted(str(x) for x in rows if x[1] != item)


def test_main_text(spark):
    page = """<html><head><title>T</title><script>var a="</p>";</script><style>p{}</style></head><body><header>Site head</header><nav><a href="/">Home</a></nav>
    <div class="ad">Buy this, now, really, it is cheap.</div><div id="cookie-notice">We use cookies, many of them, on this page.</div>
    <article><h1>Title &amp; more</h1><p><b>First paragraph, with commas,\n and\tspace&nbsp;here.<br><p>Second one, a bit longer than the first, with <a href=x>a link</a> inside.
    <form><input value=x>Sign up</form><ul><li>one<li>two</ul></article><section class="comments"><p>A reader says, at length, that this is nice, and so on.</p></section><footer>&copy; me</footer>"""
    got = html_main.extract(spark.createDataFrame([(1, "u", page, "x"), (2, "u", None, "x"), (3, None, "", "x"), (4, "u", "just text", "x"), (5, "u", "<p>cut <b", "x"), (6, "u", "<div>" * 500 + "deep", "x")], "page_id long, url string, html string, text string")).orderBy("page_id").collect()
    assert got[0].text == "Title & more\nFirst paragraph, with commas, and space here.\nSecond one, a bit longer than the first, with a link inside.\none\ntwo"
    assert [r.text for r in got[1:]] == ["", "", "just text", "cut", "deep"] and all(r.n_chars == len(r.text) for r in got)
    layout = '<div class="wrap"><div class="sidebar"><p>Links, links, and more links in a side column here.</p></div><div class="content"><p>The text, of some length, stands here for all to read.</p><p>And goes on, for a while, in a second paragraph.</p></div></div>'
    assert html_main.main_text(layout) == "The text, of some length, stands here for all to read.\nAnd goes on, for a while, in a second paragraph."


ARTICLE = "<p>The text, of some length, stands here for all to read.</p><p>And goes on, for a while, in a second paragraph.</p>"
PLAIN = "The text, of some length, stands here for all to read.\nAnd goes on, for a while, in a second paragraph."


@pytest.mark.parametrize("name", ["content no-sidebar", "layout has-sidebar", "entry comments-open", "post share-enabled", "page header-fixed", "ad-free story", "with-related main", "form"])
def test_layout_names_keep_the_article(name):
    side = '<div class="sidebar-left"><p>Links, links, and more links in a side column here.</p></div><div class="post-comments"><p>A reader says, at great length, in many words, with commas, that this is nice, and so on, and on.</p></div>'
    assert html_main.main_text(f'<div class="{name}">{ARTICLE}</div>{side}') == PLAIN
    assert html_main.main_text(f'<article><div class="{name}">{ARTICLE}</div></article>{side}') == PLAIN


def test_scoring_needs_no_article_element(spark):
    """Of the test pages the same text comes out when their article is a plain div."""
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        found = html_main.main_text(r.html)
        assert found == html_main.main_text(re.sub(r"<(/?)(article|main)\b", r"<\1div", r.html or "")) and (found or not r.html)


def test_pages_are_read_in_linear_time():
    began = time.perf_counter()
    for page in ("<div>" + "<span>x</b>" * 30000, "<i><div>" + "<b>" * 20000 + "</i>" * 20000 + "<p>" * 20000 + "<li>" * 20000, "<div>x" * 20000, "<a" * 50000):
        html_main.main_text(page)
    assert time.perf_counter() - began < 20


def test_licenses(spark):
    texts = [*ODD, "Released under the MIT License.", "mit license MIT-License, apache\nlicense", "GNU General Public License; general public  license", "Licensed under CC BY-NC 4.0.", "Permission is hereby granted, free of charge, to any person getting a copy of this software and associated documentation files", "Kit license mit", "public license"]
    got = license_scan.scan(frame(spark, texts)).orderBy("doc_id").collect()
    phrases = {(b"mit", b"license"): "mit", (b"apache", b"license"): "apache", (b"general", b"public", b"license"): "gpl"}
    for t, r in zip(texts, got, strict=True):
        w = words_of(t)
        at = [(k, label) for k in range(len(w)) for p, label in phrases.items() if tuple(w[k : k + len(p)]) == p]
        starts = [k for k, _ in at]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at})))
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    by = {t: r for t, r in zip(texts, got, strict=True)}
    assert by["Licensed under CC BY-NC 4.0."].labels == "cc-by-nc" and by[texts[-3]].labels == "mit" and by[texts[-3]].score < 1
    assert license_scan.scan(frame(spark, ["a"]).limit(0)).count() == 0
    twice = frame(spark, ["mit license"])
    assert license_scan.scan(twice.unionByName(twice)).count() == 2


def test_license_texts_in_order(spark):
    """Whole notices with changes are found by their order; the same words in another order, or a part of them, aren't."""
    rng = np.random.default_rng(4)
    notice, label = max(license_scan.NOTICES.items(), key=lambda x: len(x[0]))
    w = re.findall(license_scan.WORDS, notice)
    changed = [x for x in w if rng.random() > 0.03]
    mixed = [w[k : k + 2] for k in range(0, len(w), 2)]
    texts = [" ".join(w), "so it is " + " ".join(changed) + " in the end", " ".join(x for p in rng.permutation(len(mixed)) for x in mixed[p]), " ".join(w[: len(w) // 2]), "the license " * 30000 + " ".join(w)]
    only = {notice: label}
    for k in (2, 4):
        base = license_scan.PHRASES if k == 2 else {}
        got = {r.doc_id: r for r in license_scan.scan(frame(spark, texts), k=k, phrases=base, notices=only, enough=0.7).collect()}
        assert [bool(got[i].spans) for i in range(5)] == [True, True, False, False, True]
        assert min(got[0].score, got[4].score) > 0.99 and 0.7 <= got[1].score < got[0].score and got[4].spans[0].first == 60000 and got[4].spans[0].last == 60000 + len(w) - 1
    with pytest.raises(ValueError):
        license_scan.scan(frame(spark, texts), k=3)


def test_digest_queries(spark):
    from loomline.llm import catalog

    r = catalog.op2_bpe(spark, "/root/testdata/sf0.001").first()
    assert len(r.ids_sha256) == len(hashlib.sha256().hexdigest())
