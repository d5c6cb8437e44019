"""Pages, archives, vectors and the pipeline."""

import hashlib
import time
import re
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from crashlens.llm import cross_polytope, html_blocks, warc
from crashlens.llm.store import new_folder
from pyspark.sql import functions as F

from .conftest import words

PAGE = ('<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">A</a></li>'
        '<li><a href="/b">B</a></li></ul></nav><!-- ad --><div class="ad">Buy this now.</div><article><h1>Head &amp; line</h1>'
        "<p><b>First   part.<br><p>Second\n part of the story goes on.</p></article><footer>&copy; site</footer></body></html>")


def test_blocks():
    got = html_blocks.blocks_of(PAGE)
    assert [b.text for b in got] == ["A", "B", "Buy this now.", "Head & line", "First part.", "Second part of the story goes on.", "© site"]
    assert html_blocks.blocks_of(None) == [] and html_blocks.blocks_of("<p") == [] and html_blocks.blocks_of("a &am")[0].text == "a &am"


def test_hidden_elements_take_nothing_else():
    said = lambda inner: [b.text for b in html_blocks.blocks_of(f"<body><article>{inner}</article><p>After.</p></body>")]
    for gone in ('<svg class="i"/>', "<svg class=i><path d='M0'/><title>t</title></svg>", "<svg><svg><text>x</text></svg><text>y</text></svg>", "<math/>",
                 "<object data='a.swf' />", "<iframe src='/x'/>", "<script src='/x'/>", "<textarea/>", "<title>a <script> b</title>", "<select><option>A<option>B</select>",
                 '<button class="x"><div><p>Share</div> this</button>', "<template><p>A<template><p>B</p></template>C</p></template>", "<textarea></div></textarea>"):
        assert said(f"<p>One {gone} two.</p><p>Three.</p>") == ["One two.", "Three.", "After."], gone
    for kept in ("<math><mi>x</mi></math>", "<object data=a>x</object>", "<noscript>x</noscript>", "<object data=a>x", "<noscript>x", "<math><mi>x", "<textarea>x", "<title>x"):
        assert said(f"<p>One {kept} two.</p><p>Three.</p>") == ["One x two.", "Three.", "After."], kept
    for tag in ("svg", "button", "select", "object", "template", "iframe", "title", "textarea", "math", "noscript"):
        for later in ("", f"<{tag}>no</{tag}>"):
            own = " ".join(said(f"<p>One <{tag} id='q'>two.</p><p>Three.</p><div>{later}</div><p>Four.</p>")).replace(" no ", " ")
            assert own == "One two. Three. Four. After.", (tag, later)
        own = said(f"<{tag}><p>One.</p><p>Two.</p>")
        assert own == ["One.", "Two.", "After."], tag
    assert said('<p><a href="/x">One <button>in <a href="/y">link</a></button> two</a></p>') == ["One two", "After."]
    assert html_blocks.blocks_of('<p><a href="/x">One <button>Go</button>two</a></p>')[0].links > 0.8
    assert [b.text for b in html_blocks.blocks_of("<svg><button>" * 20_000 + "<p>One.")][-1] == "One."
    assert [b.text for b in html_blocks.blocks_of("<title><textarea>" * 20_000 + "<p>One.")] == ["One."]
    page = PAGE.replace("<b>First", '<svg class="i"/><b>First').replace("<article>", '<article><button class="share">')
    assert html_blocks.main_texts(html_blocks.trained(), [page])[0].endswith("Head & line\nFirst part.\nSecond part of the story goes on.")


def test_main_text(spark):
    net = html_blocks.trained()
    pages, y = html_blocks.page_sample(150, 99)
    assert ((net.scores(html_blocks.sequences(pages)) > 0) == (y > 0)).mean() > 0.97  # held out
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    truth = {r.page_id: "\n".join(b.text for b in html_blocks.blocks_of(re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)[1])) for r in rows}
    odd = [(1000, None, None), (1001, "u", ""), (None, "u", PAGE), (1002, "u", "<!-- only"), (1003, "u", "<div>" * 3000), (1004, "u", PAGE), (1004, "u", PAGE)]
    df = spark.createDataFrame([(r.page_id, r.url, r.html, "x") for r in rows] + [(*r, "x") for r in odd], "page_id bigint, url string, html string, text string")
    got = html_blocks.extract(df).collect()
    by = {r.page_id: r for r in got}
    assert sum(by[k].text == t for k, t in truth.items()) >= 0.99 * len(truth)
    assert all(r.n_chars == len(r.text) for r in got) and [by[k].text for k in (1000, 1001, 1002, 1003)] == [""] * 4
    assert Counter(r.page_id for r in got)[1004] == 2 and by[1004].text == "Head & line\nFirst part.\nSecond part of the story goes on."
    assert html_blocks.extract(df.limit(0)).collect() == []


def test_archive(spark):
    same, crlf = "ü" * 700, "x\r\n\r\nWARC/1.1\r\n" * 100
    rows = [(1, "http://a b\r\n", same), (2, None, same), (3, "u", same), (3, "u", same), (4, "u", None), (5, "u", ""), (6, "u", "small"), (7, "u", "small"),
            (8, "u", crlf), (9, "u", crlf), (None, "u", same), (10, "u", "y" * 300_000), (11, "u", "z" * 9_000_000), (12, "u", "\r\n\r\n"),
            (13, "u", "a\r\n"), (14, "u", "\r\n\r\n\r\n\r"), (15, "u", ("\r\n\r\nWARC/1.1\r\nContent-Length: 3" + "q\r\n") * 40_000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, digest string").repartition(3)
    path = new_folder(spark, "warc-test")
    got = warc.archive(df, path).collect()
    top = defaultdict(int)
    for k, _, h in rows:
        top[h] = max(top[h], k or 0)
    want = Counter()
    for k, _, h in rows:
        body = (h or "").encode()
        other = len(body) >= 1000 and top[h] != k
        want[(k, len(body), hashlib.sha1(body).hexdigest(), "revisit" if other else "response", top[h] if other else None)] += 1
    assert Counter((r.key, r.full_bytes, r.full_sha1, r.record_type, r.refers_to_key) for r in got) == want
    back = {r.key: bytes(r.payload).decode() for r in warc.read_archive(spark, path).filter("record_type = 'response'").collect()}
    assert back[9] == crlf and back[3] == same and back[4] == ""
    assert warc.archive(df.limit(0), new_folder(spark, "warc-test")).collect() == []


def test_nearest(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(600, 12)) * r.choice([0.3, 1, 7], (600, 1))
    x[50:90] = x[50]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(599, x[599].tolist()), (700, None), (720, [0.0] * 12), (740, [float("nan")] * 12),
                                                       (760, [None] * 12), (780, []), (None, x[0].tolist()), (800, [1.0, 2.0]), (801, [2.0, 1.0])]
    df = spark.createDataFrame([(*v, "x") for v in rows], "vec_id bigint, embedding array<double>, rank string").repartition(3)
    got = defaultdict(list)
    for v in cross_polytope.search(df, F.col("vec_id") % 20 == 0).collect():
        got[v.query_id].append((v["rank"], v.vec_id, v.score))
    assert set(got) == {*range(0, 600, 20), 800} and [v[1] for v in got[800]] == [801]
    hit = 0
    for q in range(0, 600, 20):
        own = sorted(got[q])
        assert [v[0] for v in own] == list(range(1, len(own) + 1)) and q not in {v[1] for v in own}
        assert all(abs(v[2] - x[q] @ x[v[1]]) < 1e-9 for v in own) and own == sorted(own, key=lambda v: (-v[2], v[1]))
        s = x @ x[q]
        s[q] = -np.inf
        hit += len({v[1] for v in own} & set(np.lexsort((np.arange(600), -s))[:20].tolist()))
    assert hit >= 0.9 * 600
    assert cross_polytope.search(df.limit(0), F.col("vec_id") % 20 == 0).collect() == []


def test_nearest_finds_k_for_every_query(spark):
    r = np.random.default_rng(8)
    near = r.normal(size=64) + 0.02 * r.normal(size=(2900, 64))
    x = r.permutation(np.concatenate((near, r.normal(size=(100, 64)))))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>").repartition(3)
    got = defaultdict(set)
    for v in cross_polytope.search(df, F.col("vec_id") % 4 == 0).collect():
        got[v.query_id].add(v.vec_id)
    assert {q: len(got[q]) for q in range(0, 3000, 4) if len(got[q]) != 20} == {}
    hit = []
    for q in range(0, 3000, 4):
        s = x @ x[q]
        s[q] = -np.inf
        hit.append(len(got[q] & set(np.argsort(-s)[:20].tolist())))
    far = [n for q, n in zip(range(0, 3000, 4), hit) if np.linalg.norm(x[q] - np.median(x, axis=0)) > 2]
    assert len(far) >= 15 and sum(hit) >= 0.9 * 20 * len(hit) and sum(far) >= 0.9 * 20 * len(far) and min(hit) >= 8
    few = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x[:13] * r.choice([0.1, 1, 9], (13, 1)))], df.schema)
    assert Counter(v.query_id for v in cross_polytope.search(few, F.lit(True)).collect()) == {i: 12 for i in range(13)}


def test_pipeline_stages(spark, docs, no_docs):
    at = docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, at, "")
        rows = out.collect()
        if i < 4:
            assert out.columns == docs.columns, name
            at = spark.createDataFrame(rows, docs.schema)
        ids = {r.doc_id for r in rows}
        if i == 0:
            assert ids == {0, 6, 10, 11, 12, 13, 20, 21, 22, 30, 31, 32, 33, 34, 35, 42, 43, None} - {6}
        if i == 1:
            assert {10, 11, 12, 13, 20, None} <= ids and not {21, 22} & ids
        if i == 2:
            assert [len(words(r.text)) for r in rows if r.doc_id == 11] == [len(words(x.text)) - 60 for x in docs.collect() if x.doc_id == 11]
        if i == 3:
            assert rows
    assert rows and {"sequence_id", "offset"} <= set(out.columns)
    assert corpus_pipeline.STAGES[3][1](spark, no_docs, "").collect() == []


def test_unlike_texts_under_one_id(spark, docs):
    r = np.random.default_rng(4)
    a, b, c, d = (" ".join(f"w{x}" for x in r.integers(0, 10**6, 80)) for _ in range(4))
    near = lambda t: t + " more"
    # 7 has a copy of 3's text and one of its own, in both orders; 12 has copies of two unlike texts; 20 has two near copies
    rows = [(3, a), (7, a), (7, "a " + b), (7, "a " + b), (8, a), (8, "z " + c), (12, near(a)), (12, d), (15, near(d)), (20, "y " + a[::-1]), (20, near("y " + a[::-1])),
            (None, a), (None, a), (-5, near("z " + c))]
    df = spark.createDataFrame([(k, t, "en", "s", len(t), "x", 1, "y", 2.0) for k, t in rows], docs.schema).repartition(3)
    got = Counter((x.doc_id, x.text) for x in corpus_pipeline.near_duplicates(spark, df, "").collect())
    y = [k for k in got if k[0] == 20]
    assert len(y) == 1 and y[0] in rows
    assert Counter({k: n for k, n in got.items() if k[0] != 20}) == Counter([(3, a), (7, "a " + b), (-5, near("z " + c)), (12, d), (None, a), (None, a)])


def test_hidden_elements_of_any_depth():
    """What an open element hides does not depend on how many are open in it."""
    for n in (1, 63, 64, 65, 5000):
        for tag in ("template", "svg"):
            page = f"<p>One</p>{f'<{tag}>' * n}hidden{f'</{tag}>' * n}<p>Two</p>"
            assert [b.text for b in html_blocks.blocks_of(page)] == ["One", "Two"], (tag, n)
    assert [b.text for b in html_blocks.blocks_of("<div>" + "<select>a" * 3000 + "</select>b</div>c")][-1] == "c"
    begin = time.process_time()
    html_blocks.blocks_of("<template><svg>" * 50_000 + "</svg>" * 10 + "<button>" * 50_000)
    assert time.process_time() - begin < 20


def test_archive_of_one_large_file(spark, monkeypatch):
    """More bytes than a batch holds, from one file; a choice that is not broadcast gives the same."""
    rows = [(i, "u", f"{i} " + "\r\n\r\nq" * 60_000) for i in range(12)] + [(100 + i, "u", "same " * 600) for i in range(30)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1)
    got = warc.archive(df, new_folder(spark, "warc-test")).collect()
    assert Counter(r.record_type for r in got) == {"response": 13, "revisit": 29} and {r.refers_to_key for r in got} == {None, 129}
    assert {r.key: r.full_sha1 for r in got} == {k: hashlib.sha1(h.encode()).hexdigest() for k, _, h in rows}
    monkeypatch.setattr(warc, "REVISITS", 0)
    again = warc.archive(df, new_folder(spark, "warc-test")).drop("record_id").collect()
    assert sorted(map(str, again)) == sorted(map(str, (r for r in spark.createDataFrame(got).drop("record_id").select(again[0].__fields__).collect())))
    plain = new_folder(spark, "warc-test")
    spark.createDataFrame([("x",)], "v string").write.text(plain)
    with pytest.raises(ValueError, match="not compressed"):
        warc.read_archive(spark, plain)
