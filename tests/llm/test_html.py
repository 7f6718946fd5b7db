import html
import re
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest

from newsengine.llm.html import INPUTS, BiLstm, Reader, blocks, extract_main_text, made_page, train

PAGES = pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist() if Path("/root/testdata/sf0.01/pages.parquet").exists() else []


@pytest.fixture(scope="module")
def model():
    return train(PAGES[:60], made=500)


def test_gradients():
    m, rng = BiLstm.new(4), np.random.default_rng(0)
    x = rng.normal(size=(3, 5, INPUTS)).astype(np.float32)
    mask = np.array([[1] * 5, [1] * 3 + [0] * 2, [1] * 4 + [0]], bool)
    y = (rng.random((3, 5)) < 0.5).astype(np.float32)
    g, _ = m.gradients(x, mask, y)
    m.w, m.out = m.w.astype(float), m.out.astype(float)

    def loss():
        z = m.logits(x, mask)
        return float(((np.logaddexp(0, z) - y * z) * mask).sum() / mask.sum())

    for at in [(0, 3, 2), (1, INPUTS + 1, 5), (0, INPUTS + 2, 9), (1, -1, 14)]:
        old, e = m.w[at], 1e-3
        m.w[at] = old + e
        up = loss()
        m.w[at] = old - e
        assert abs((up - loss()) / (2 * e) - g[at]) < 1e-5
        m.w[at] = old


def test_blocks():
    got = [b.text for b in blocks("<p>a &amp;lt; <b>b</b><br>c<!-- x --><p>d  e<script>var p='</p>';</script><div>f<span>g</span></div>h<li>i<li>j &copy</ul>k < l")]
    assert got == ["a &lt; b c", "d e", "fg", "h", "i", "j ©", "k < l"]
    assert blocks(None) == blocks("") == blocks("<div> \n </div>") == []
    assert [b.path[-1] for b in blocks('<div class="cookieBanner x-y"><p>t</p></div>')] == ["<p>"]
    assert {"cookie", "banner"} <= set(blocks('<div class="cookieBanner x-y"><p>t</p></div>')[0].path)


@pytest.mark.skipif(not PAGES, reason="no test tables")
def test_given_pages_held_out(spark, model):
    def gold(page):
        inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
        texts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:h1|p)>", inner)]
        return "\n".join(t for t in texts if t)

    rows = list(enumerate(PAGES[60:])) + [(1000, None), (1001, "")]
    df = spark.createDataFrame(rows * 2, "page_id long, html string").selectExpr("*", "'old' as text")
    got = extract_main_text(df, model).collect()
    assert len(got) == 2 * len(rows)
    for r in got:
        assert r.text == (gold(r.html) if r.html else "")
    assert extract_main_text(df.limit(0), model).count() == 0


def test_other_layouts_held_out(model):
    rng, reader, wrong, total = np.random.default_rng(99), Reader(), 0, 0
    for _ in range(150):
        rows, y = made_page(rng, ["Some words of a sentence, here.", "Another text with more words, and more, until the end of it.", "Short one."])
        got = model.main_blocks([reader.vectors(rows)])[0]
        wrong += int((got != (y > 0)).sum())
        total += len(y)
    assert wrong / total < 0.08


def test_long_pages_in_pieces(model):
    rows = [(("<html>", "<body>", "<article>", "<p>"), f"Paragraph number {i} of the long text, with words.", 0) for i in range(2500)]
    assert model.main_blocks([Reader().vectors(rows)])[0].mean() > 0.95


def test_scanner_keeps_text_and_is_linear():
    import time

    from newsengine.llm.html import blocks

    texts = lambda p: [b.text for b in blocks(p)]
    assert texts("<p title=it's>hello</p><p>two") == ["hello", "two"]
    assert texts("<p>x <math><mi>a</mi>+b</math> y<noscript>no</noscript>") == ["x a+b y", "no"]
    assert texts("<p>a<script>if(a<b){</script><div class='x>y'>b</div><svg><text>q</text></svg>") == ["a", "b"]
    assert texts("<p>u 1 < 2 &lt; 3</p>") == ["u 1 < 2 < 3"] and texts(None) == []
    began = time.time()
    for part in ('<a "', '<a x="', "<a x='>", "<script>", "<!-- ", "<p><"):
        blocks(part * 40_000)
    assert time.time() - began < 20


def test_a_long_page_is_read_as_one_sequence():
    import numpy as np

    from newsengine.llm.html import INPUTS, PIECE, BiLstm, padded

    model = BiLstm.new()
    page = np.random.default_rng(1).normal(0, 1, (2 * PIECE + 77, INPUTS)).astype(np.float32)
    x, mask = padded([page])
    assert np.allclose(model.logits(x, mask)[0], model.long_logits(page), atol=1e-4)
    assert (model.main_blocks([page, page[:5], page[:0]])[0] == (model.logits(x, mask)[0] > 0)).all()


def test_comments_that_are_whole_and_elements_that_are_never_closed_hide_nothing():
    texts = lambda p: [b.text for b in blocks(p)]
    assert texts("<p>a<!-->b</p><p>c") == texts("<p>a<!--->b</p><p>c") == ["ab", "c"]
    assert texts("<p>a<!-- x -- > y -->b") == ["ab"]
    assert texts("<div><p>x<svg><p>y</p></div><p>z</p>") == ["x", "y", "z"]
    assert texts("<article><p>x<template><p>y</article><p>z") == ["x", "y", "z"]
    assert texts("<p>x<svg><p>in</p></svg><p>y<iframe><p>z") == ["x", "y", "z"]
    assert texts("<p>x<svg>in<svg>in</svg>in</svg><p>y") == ["x", "y"]
