import numpy as np

from stackline.llm import html_labeller as h
from stackline.llm.html_blocks import blocks

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><!-- ad --><div class="ad">Buy this now please</div>
<article><h1>A  title&amp;more</h1><p><b>First paragraph of the story with some words in it.<br><p>Second&nbsp;one,
over two lines, is a sentence that goes on.</p><ul><li>item one of the list</li></ul></article>
<section class="comments"><div class="comment"><p>Nice post, I liked it.</p></div></section><aside class="sidebar">Related things</aside><footer>&copy; site</footer></body></html>"""


def test_blocks():
    found = blocks(PAGE)
    assert [b.text for b in found] == ["Home", "News", "Buy this now please", "A title&more", "First paragraph of the story with some words in it.", "Second one, over two lines, is a sentence that goes on.", "item one of the list", "Nice post, I liked it.", "Related things", "© site"]
    assert found[5].path[-2:] == ("article", "p") and found[0].linked == 4
    for odd in ("", "<", "<p", "a < b", "<p title='x>y", "</p>", "<script>x", "<p>" * 3000 + "x", "&#0;&bogus;"):
        blocks(odd)


def test_held_out_accuracy_and_extraction(spark):
    model = h.trained()
    found, labels = h.made_pages(150, 4242)
    right = np.concatenate([a == np.array(b) for a, b in zip(model.label(found), labels, strict=True)])
    assert right.mean() > 0.97
    rows = [(1, "u", PAGE, "t"), (2, None, None, "t"), (3, "u", "", "t"), (1, "u", PAGE, "t"), (4, "u", PAGE.replace("First", "word " * 50_000), "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = sorted(map(tuple, h.extract(df, model).collect()), key=str)
    want = "A title&more\nFirst paragraph of the story with some words in it.\nSecond one, over two lines, is a sentence that goes on.\nitem one of the list"
    assert out[0] == out[1] == (1, "u", want, len(want)) and out[2][2:] == ("", 0) and out[3][2:] == ("", 0)
    assert out[4][2].startswith("A title&more\nword word ") and out[4][3] == len(out[4][2]) > 250_000
    assert h.extract(df.where("page_id < 0"), model).collect() == []


def texts(page):
    return [b.text for b in blocks(page)]


def test_nothing_after_an_odd_element_is_lost():
    assert texts("<p>a</p><svg/><p>b</p>") == ["a", "b"] and texts("<p>a</p><svg><path d=''/><title>t</title><p>b") == ["a", "b"]
    assert texts("<p>a<select><option>x<option>y<p>b</p>") == ["a", "x", "y", "b"] and blocks("<p>a<select><option>x<p>b</p>")[-1].path == ("p",)
    assert texts("<p>a</p><iframe src=x><p>b</p>") == ["a", "b"] and texts("<p>a</p><iframe>gone</iframe><p>b</p>") == ["a", "b"]
    assert texts("<noscript><p>a</p></noscript><object data=q>f</object>c<template>d</template>e<textarea>g") == ["a", "f", "ceg"]
    assert texts("<p>x <math><mi>y</mi></math> z<math/> w</p>") == ["x y z w"]
    assert texts("a<script>b") == ["a"] and texts("a<script src=x/>b") == ["ab"] and texts("a<style>b</style >c") == ["ac"]


TABLES = """<html><body><table width=100%><tr><td colspan=2><a href=/>Old Site</a> | <a href=/n>News</a> | <a href=/c>Contact</a></td></tr><tr><td width=120><a href=1>Archive 2001</a><br><a href=2>Archive 2002</a><br><a href=3>Links</a></td>
<td class="content"><h2>How we built the boat</h2><p>We began in the spring with two planks and a borrowed saw, and had no idea how long it would take.</p><p>By the end of the summer the hull was done. The neighbours came to look at it every evening, and most of them laughed.</p><p>It floated on the first of October.</p></td></tr>
<tr><td colspan=2>Copyright 2003 Old Site. All rights reserved.</td></tr></table></body></html>"""
MODERN = """<!doctype html><html><head><title>x</title></head><body><div id="__app"><header class="site-header sticky"><div class="logo">Daily Paper</div><nav aria-label="Main"><a href=/w>World</a><a href=/s>Sport</a></nav></header>
<div class="cookie-banner">We use cookies to make this site better. <button>Accept</button></div>
<main id="main"><article class="post-full"><header><h1>River reaches its highest level in ten years</h1></header><div class="post-content"><p>The river rose by two metres on Sunday night, the water board said in a statement.</p><p>Schools near the bank stay closed until Wednesday, and buses take another way.</p>
<div class="ad-slot advert">Advertisement: new boots at half price</div><blockquote>We have not seen anything like it since I came here.</blockquote><ul><li>Open roads: north and east.</li><li>Closed roads: all by the bank.</li></ul></div></article></main>
<aside class="related-posts"><h3>Read next</h3><a href=/a>Ten tips for wet weather</a></aside><section id="comments" class="comments-area"><h2>2 comments</h2><div class="comment-body"><p>Stay safe all of you down there.</p></div></section><form class="newsletter"><label>Your mail</label><button>Subscribe</button></form><footer class="site-footer">About us. Terms. Privacy.</footer></div></body></html>"""
DOCS = """<html><body><noscript>Please turn on scripts.</noscript><div class="sidebar toc"><ul><li><a href=#a>Install</a></li><li><a href=#b>Use</a></li></ul></div><div role="main" class="document"><div class="section body content"><h1>Install</h1><p>Unpack the file and copy it to a folder of your choice.</p><pre>tar xf tool.tar
cp tool /usr/local/bin</pre><h2>Use</h2><p>The area of a circle is <math><mi>A</mi><mo>=</mo><mi>r</mi></math> as everyone knows.</p><table><tr><th>Option</th><th>Meaning</th></tr><tr><td>-v</td><td>say more about it</td></tr></table><svg/><p>That is all there is to say.</p></div></div><footer>Built with a generator. <select><option>v1</option><option>v2</option></select></footer></body></html>"""


def test_pages_of_other_layouts():
    """Pages written by hand, of which the generator has none; each block's label was given by reading."""
    model = h.trained()
    kept = {
        TABLES: (2, 6),
        MODERN: (4, 11),
        DOCS: (3, 13),
    }
    for page, (first, last) in kept.items():
        found = blocks(page)
        said = [b.text for b, main in zip(found, model.label([found])[0], strict=True) if main]
        want = [b.text for b in found[first:last] if not b.text.startswith("Advertisement")]
        assert said == want


def test_gradients_match_differences():
    found, labels = h.made_pages(3, 1)
    model, pages = h.Labeller(2), [h.Page(f) for f in found]
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    grad, _ = model.gradients(pages, labels)
    for name in ("hf", "hb", "o", "cf", "xb"):
        at = np.unravel_index(np.abs(grad[name]).argmax(), grad[name].shape)
        old, step = model.w[name][at], 1e-2
        losses = []
        for d in (step, -step):
            model.w[name][at] = old + d
            losses.append(model.gradients(pages, labels)[1])
        model.w[name][at] = old
        assert abs((losses[0] - losses[1]) / (2 * step) - grad[name][at]) < 0.02 * abs(grad[name][at]) + 1e-3


def test_megabytes_of_odd_marks_take_linear_time():
    import time

    mb = 1 << 20
    odd = ['<a "', "<div>", "<div>x", "<i>", "<i>x ", '<a ">">', "<a \">\"'", "<", "<title>", "<!--", "&", "<b>x<'", "</div>", "<p><u>", "<li>x"]
    pages = [x * (mb // len(x)) for x in odd] + ["<div><u><p>" + "<i>" * 90_000 + "</u>" * 90_000, "<div>" * 90_000 + "</section>" * 60_000]
    for page in pages:
        began = time.process_time()
        found = blocks(page)
        took = time.process_time() - began
        assert took < 2, (page[:20], took)
        began = time.process_time()
        h.Page(found) if found else None
        assert time.process_time() - began < 10


def test_paths_share_what_is_above():
    found = blocks("<div id=a>" * 50_000 + "x<p>y")
    assert found[0].leaf is found[1].leaf.parent and len(found[0].path) == 50_000
    assert h.path_slots(found[1].leaf) and h.path_slots(None) == 0
