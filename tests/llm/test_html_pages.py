"""Pages written by hand after common layouts, against the text that a reader takes for the article.

None of these comes from the generator that the labeller is trained on.
"""

from __future__ import annotations

import pytest

from quadrel.llm import html

#: (name, page, texts that must be kept in this order, texts that must go)
PAGES = [
    ("blog", """<!DOCTYPE html><html lang="en-US"><head><title>Baking rye bread &#8211; Crumb &amp; Crust</title><link rel="stylesheet" href="s.css"><script>window._q=[];</script></head>
<body class="post-template single"><a class="skip-link" href="#content">Skip to content</a>
<header id="masthead" class="site-header"><p class="site-title"><a href="/">Crumb &amp; Crust</a></p><p class="site-description">Notes from a small bakery</p>
<nav class="main-navigation"><ul><li><a href="/">Home</a></li><li><a href="/recipes">Recipes</a></li><li><a href="/about">About</a></li></ul></nav></header>
<div id="content" class="site-content"><main><article id="post-77" class="post hentry"><h1 class="entry-title">Baking rye bread</h1>
<div class="entry-content"><p>Rye flour has little gluten, so the dough will feel more like mortar than like the elastic dough you know from wheat.</p>
<p>Start the evening before. Mix the sourdough with <em>lukewarm</em> water and 300&nbsp;g of flour, cover the bowl and leave it in a warm place.</p>
<h2>The next morning</h2><ul><li>Add salt, the rest of the flour and some water.</li><li>Let it rest for two hours.</li></ul>
<p>Bake it hot for the first quarter of an hour, then turn the oven down and be patient.</p></div></article>
<div id="comments" class="comments-area"><h2 class="comments-title">2 thoughts on this</h2><ol class="comment-list"><li class="comment"><p>I tried it with spelt and it worked well.</p></li><li class="comment"><p>How long does it keep?</p></li></ol>
<form class="comment-form"><label>Name</label><input name="n"><button>Post Comment</button></form></div></main>
<aside class="widget-area"><h3>Recent posts</h3><ul><li><a href="/a">Why I weigh water</a></li><li><a href="/b">A new oven</a></li></ul></aside></div>
<footer class="site-footer"><p>Proudly powered by flour. All rights reserved.</p></footer></body></html>""",
     ["Baking rye bread", "Rye flour has little gluten, so the dough will feel more like mortar than like the elastic dough you know from wheat.", "Start the evening before. Mix the sourdough with lukewarm water and 300 g of flour, cover the bowl and leave it in a warm place.", "The next morning", "Add salt, the rest of the flour and some water.", "Let it rest for two hours.", "Bake it hot for the first quarter of an hour, then turn the oven down and be patient."],
     ["Skip to content", "Notes from a small bakery", "Recipes", "spelt", "How long does it keep?", "Post Comment", "Recent posts", "All rights reserved"]),
    ("news", """<html><head><title>Harbour bridge closed</title><style>.x{}</style></head><body><div id="cookie-banner" class="consent"><p>We and our partners use cookies to store information on your device.</p><button>Agree</button></div>
<div class="topbar"><a href="/">The Coast Daily</a> <a href="/login">Sign in</a></div><nav><a href="/local">Local</a> | <a href="/sport">Sport</a> | <a href="/culture">Culture</a></nav>
<div class="layout"><div class="article-body"><h1>Harbour bridge closed after storm damage</h1>
<p>The old harbour bridge will stay closed for at least three weeks, the city council said on Tuesday.</p>
<div class="advertisement">Advertisement</div>
<p>Engineers found cracks in two of its seven pillars after last week's storm. "We can't take any risk," said the head of the works department.</p>
<figure><img src="b.jpg" alt=""><figcaption>The bridge on Monday morning.</figcaption></figure>
<p>Buses will be diverted through the northern tunnel; cyclists can take the ferry free of charge.</p></div>
<div class="related"><h3>More on this</h3><ul><li><a href="/1">Storm leaves thousands without power</a></li><li><a href="/2">Ferry timetable changes again</a></li></ul></div></div>
<div id="footer"><a href="/imprint">Imprint</a> <a href="/privacy">Privacy</a> &copy; The Coast Daily</div></body></html>""",
     ["Harbour bridge closed after storm damage", "The old harbour bridge will stay closed for at least three weeks, the city council said on Tuesday.", "Engineers found cracks in two of its seven pillars after last week's storm. \"We can't take any risk,\" said the head of the works department.", "The bridge on Monday morning.", "Buses will be diverted through the northern tunnel; cyclists can take the ferry free of charge."],
     ["cookies", "Agree", "Sign in", "Sport", "Advertisement", "More on this", "Storm leaves thousands", "Imprint"]),
    ("manual", """<!doctype html><html><head><title>sort</title></head><body><div class="wrapper"><div class="sidebar"><ul class="menu"><li><a href="a.html">Introduction</a></li><li><a href="b.html">Installation</a></li><li><a href="c.html">Reference</a></li></ul></div>
<main class="documentation"><h1>Sorting rows</h1><p>Rows are sorted by one or more keys. A key that is missing sorts last.</p><pre><code>table.sort(by="name", reverse=True)</code></pre>
<p>The sort is stable: rows with equal keys keep their order.</p><table><tr><th>Argument</th><th>Meaning</th></tr><tr><td>by</td><td>name of the key</td></tr></table>
<p>See the next chapter for grouping.</p></main></div><div class="pagination"><a href="p">Previous</a> <a href="n">Next</a></div><footer>Built with care from plain text files.</footer></body></html>""",
     ["Sorting rows", "Rows are sorted by one or more keys. A key that is missing sorts last.", 'table.sort(by="name", reverse=True)', "The sort is stable: rows with equal keys keep their order.", "Argument", "Meaning", "by", "name of the key", "See the next chapter for grouping."],
     ["Introduction", "Installation", "Previous", "Built with care"]),
    ("old tables", """<HTML><HEAD><TITLE>Walking the ridge</TITLE></HEAD><BODY bgcolor=white><table width=100%><tr><td colspan=2 id=header><font size=5>Hill Walkers Club</font></td></tr>
<tr><td class=menu valign=top><a href=i.htm>Start</a><br><a href=w.htm>Walks</a><br><a href=l.htm>Links</a></td>
<td class=content><h2>Walking the ridge</h2><p>We met at the station at eight, fourteen of us, and took the path behind the mill.<p>The first climb is steep but short. From the top you see the lake and, on a clear day, the sea.<p>Bring water, for there is none on the way.</td></tr>
<tr><td colspan=2 class=footer>Last changed in May. Mail to the webmaster.</td></tr></table></BODY></HTML>""",
     ["Walking the ridge", "We met at the station at eight, fourteen of us, and took the path behind the mill.", "The first climb is steep but short. From the top you see the lake and, on a clear day, the sea.", "Bring water, for there is none on the way."],
     ["Hill Walkers Club", "Walks", "webmaster"]),
    ("encyclopedia", """<html><body><div id="nav" class="navbox"><ul><li><a href="/m">Main page</a></li><li><a href="/r">Random page</a></li></ul></div><div id="content"><h1>Reed warbler</h1><div id="toc" class="toc"><h2>Contents</h2><ul><li><a href="#1">Description</a></li><li><a href="#2">Habitat</a></li></ul></div>
<div class="mw-parser-output"><p>The <b>reed warbler</b> is a small bird of reed beds. It weighs some <math><mn>12</mn></math> grams.</p><h2>Description</h2><p>Its back is plain brown and its underside pale. The sexes look alike.</p><h2>Habitat</h2><p>It breeds in Europe and in western Asia, and spends the winter south of the Sahara.</p></div></div>
<div id="footer"><ul><li>This page was last edited in June.</li><li><a href="/p">Privacy policy</a></li></ul></div></body></html>""",
     ["Reed warbler", "The reed warbler is a small bird of reed beds. It weighs some 12 grams.", "Description", "Its back is plain brown and its underside pale. The sexes look alike.", "Habitat", "It breeds in Europe and in western Asia, and spends the winter south of the Sahara."],
     ["Main page", "Random page", "last edited", "Privacy policy"]),
    ("German news", """<html lang="de"><body><header><a href="/">Stadtanzeiger</a></header><nav class="navigation"><ul><li><a href="/p">Politik</a></li><li><a href="/w">Wirtschaft</a></li></ul></nav><main><article><h1>Neue Züge für die Küste</h1><p>Ab Herbst fahren auf der Strecke an die Küste neue Züge. Sie haben mehr Plätze für Fahrräder und sind leiser.</p><div class="newsletter"><p>Jeden Morgen die wichtigsten Meldungen: jetzt anmelden!</p><form><input><button>Anmelden</button></form></div><p>Die alten Wagen gehen an eine Museumsbahn, die sie in den Ferien einsetzen will.</p></article></main><section class="kommentare comments"><h2>Kommentare</h2><div class="comment"><p>Endlich! Darauf warten wir seit Jahren.</p></div></section><footer>Impressum und Datenschutz</footer></body></html>""",
     ["Neue Züge für die Küste", "Ab Herbst fahren auf der Strecke an die Küste neue Züge. Sie haben mehr Plätze für Fahrräder und sind leiser.", "Die alten Wagen gehen an eine Museumsbahn, die sie in den Ferien einsetzen will."],
     ["Politik", "Jeden Morgen", "Kommentare", "Endlich", "Impressum"]),
    ("plain", """<html><body><h1>On keeping a diary</h1><p>I have kept a diary since I was nine.</p><p>Most days I write three lines: what the weather was like, whom I met, and one thing I would otherwise forget.</p><p>It is dull to read, and that is the point of it.</p></body></html>""",
     ["On keeping a diary", "I have kept a diary since I was nine.", "Most days I write three lines: what the weather was like, whom I met, and one thing I would otherwise forget.", "It is dull to read, and that is the point of it."], []),
    ("links only", """<html><body><header><h1>Directory</h1></header><nav><ul><li><a href="/1">Shops</a></li><li><a href="/2">Towns</a></li><li><a href="/3">Maps</a></li></ul></nav><footer><p>All rights reserved.</p></footer></body></html>""", [], ["Shops", "Towns", "All rights reserved"]),
]


@pytest.fixture(scope="module")
def labelled():
    net = html.trained()
    out = {}
    for name, page, _, _ in PAGES:
        found = html.page(page)[0]
        out[name] = [t for t, k in zip(found.texts, net.label([found])[0], strict=True) if k]
    return out


def test_pages(labelled):
    """Nearly all of each article is kept, and nearly nothing beside it."""
    kept = wanted = wrong = shut_out = 0
    for name, _, main, other in PAGES:
        got = labelled[name]
        kept += sum(t in got for t in main)
        wanted += len(main)
        wrong += sum(any(t in x for x in got) for t in other)
        shut_out += len(other)
    assert kept >= 0.95 * wanted and wrong <= 0.1 * shut_out


@pytest.mark.parametrize("tag", ["svg", "math", "object", "noscript"])
def test_text_of_odd_elements_is_kept(tag):
    net = html.trained()
    inner = {"svg": "<svg><text>drawn words</text></svg>", "math": "<math><mi>drawn</mi> <mi>words</mi></math>", "object": "<object>drawn words</object>", "noscript": "<noscript>drawn words</noscript>"}[tag]
    page = html.page(f"<html><body><nav><a href=/>Home</a></nav><article><h1>A title of some words</h1><p>It was a long day and the road went on {inner} until they came to the river.</p><p>There they stopped for the night and made a fire.</p></article></body></html>")[0]
    text = " ".join(t for t, k in zip(page.texts, net.label([page])[0], strict=True) if k)
    assert "the road went on drawn words until they came to the river." in text


def test_long_pages_take_linear_time_and_bounded_memory():
    """Deep nesting and many blocks, alone and among short pages."""
    import time
    import tracemalloc

    def took(page: str) -> float:
        began = time.process_time()
        html.page(page)
        return time.process_time() - began

    for make in (lambda n: "<div>x" * n, lambda n: "<p><table><tr><td>" + "<div>x" * n, lambda n: "<p>some words</p>" * n, lambda n: "<div>x" * n + "</div>" * n):
        small, large = max(0.02, min(took(make(5_000)) for _ in range(2))), took(make(40_000))
        assert large < 8 * 3 * small
    net = html.Labeller().freeze()
    pages = [html.page("<p>some words</p>" * 40_000)[0]] + [html.page("<p>a</p>" * 10)[0] for _ in range(63)]
    alone = [net.label([p])[0] for p in pages]
    tracemalloc.start()
    together = net.label(pages)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150 << 20 and all((a == b).all() for a, b in zip(alone, together, strict=True))


def test_chunks_of_a_run_agree(monkeypatch):
    """A run worked in chunks gives the same logits as the training pass."""
    import numpy as np

    rng = np.random.default_rng(1)
    net = html.Labeller()
    pages = [html.page("".join(f"<p class=c{rng.integers(9)}>{'word ' * int(rng.integers(1, 9))}</p>" for _ in range(n)))[0] for n in (1, 7, 40)]
    x, mask, _ = net.inputs(pages)
    want = net.logits(x, mask)[0]
    for steps in (1, 6, 10_000):
        monkeypatch.setattr(html, "STEPS", steps)
        got = x @ net.p["skip"] + net._ahead("f", x, mask) + net._ahead("b", x, mask) + net.p["off"][0]
        assert np.allclose(got[mask], want[mask])
