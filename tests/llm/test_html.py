"""HTML extraction: pages made by hand, long and deep pages, and the network's gradients."""

from __future__ import annotations

import resource
import time

import numpy as np
import pytest

from umbra.llm import op9_html
from umbra.llm.html_blocks import blocks

M, R = "\x01", "\x02"  # before main text, before the rest
BODY = (
    "The ferry left the harbour shortly after six, with two cars and a tractor on its deck.",
    "Nobody had expected the weather to hold, and yet the strait lay as flat as a plate.",
    "By noon the crew had mended the winch, and the captain slept in a chair by the wheel.",
    "A second boat was sighted off the northern cape, but it turned away before the evening.",
)

#: Pages of six kinds, written for this test; the labeller learns from other ones.
PAGES = {
    "news": f"""<body><header class="masthead"><a href="/">{R}The Daily Strait</a><nav class="topnav"><a href="/w">{R}World</a> <a href="/s">{R}Sport</a></nav></header>
        <div class="cookie-banner" role="dialog"><p>{R}We use cookies to improve your experience. Accept all cookies?</p><button>{R}Accept</button></div>
        <main><article><h1>{M}A quiet crossing</h1><p>{M}{BODY[0]}</p><p>{M}{BODY[1]}</p><div class="ad">{R}Advertisement: buy two, get one free</div><p>{M}{BODY[2]}</p><blockquote>{M}It was the calmest day of the year.</blockquote><p>{M}{BODY[3]}</p></article></main>
        <aside class="sidebar"><h3>{R}Most read</h3><ul><li><a href="/1">{R}Storm warning for the coast</a></li><li><a href="/2">{R}Prices fall again</a></li></ul></aside>
        <footer><p>{R}Copyright The Daily Strait. All rights reserved.</p></footer></body>""",
    "blog": f"""<body><div id="header"><a href="/">{R}My boats</a></div><div id="navbar"><ul><li><a href="/about">{R}About</a></li><li><a href="/contact">{R}Contact</a></li></ul></div>
        <div class="post"><h1 class="title">{M}Mending a winch</h1><div class="entry-content"><p>{M}{BODY[2]}</p><ul><li>{M}First take off the drum and clean its axle.</li><li>{M}Then grease the bearing.</li></ul><p>{M}{BODY[0]}</p></div></div>
        <div id="comments"><h2>{R}2 comments</h2><ol class="comment-list"><li class="comment">{R}Thanks, this helped me a lot with my own old boat last week.</li><li class="comment">{R}What grease do you use?</li></ol><form class="comment-form"><label>{R}Your name</label><input><button>{R}Send</button></form></div>
        <div class="footer">{R}Powered by a small engine</div></body>""",
    "bare": f"""<body><nav><ul><li><a href="/">{R}Home</a></li><li><a href="/x">{R}News</a></li></ul></nav><h1>{M}Harbour notes</h1><p>{M}{BODY[1]}</p><p>{M}{BODY[3]}</p><table><tr><td>{M}Depth</td><td>{M}Seven fathoms</td></tr></table><footer>{R}Imprint</footer></body>""",
    "wrapped": f"""<body><div id="page"><div class="wrapper"><header class="site-header"><h1>{R}Strait Gazette</h1></header><div class="notice">{R}This site needs scripts. Please enable them in your browser settings.</div>
        <div id="content"><article class="post"><header class="entry-header"><h1 class="entry-title">{M}Of winches</h1></header><p>{M}{BODY[0]} <a href="/y">{M}Read on</a> about it.</p><h2>{M}Later that day</h2><p>{M}{BODY[1]}</p><pre>{M}06:10 cast off</pre></article></div>
        <div class="related"><h3>{R}Related posts</h3><ul><li><a href="/a">{R}On ropes</a></li></ul></div><form class="search"><label>{R}Search</label><input></form><footer>{R}Terms and privacy</footer></div></div></body>""",
    "section": f"""<body><nav class="main-navigation"><a href="/">{R}Start</a></nav><section class="ads"><p>{R}Angebot: jetzt kaufen und sparen</p></section><main id="main"><h1>{M}Die stille Fahrt</h1><p>{M}Die Fähre verließ den Hafen kurz nach sechs, mit zwei Wagen an Bord.</p><p>{M}Niemand hatte mit solchem Wetter gerechnet.</p></main><section id="comments"><div class="comment"><p>{R}Danke für den schönen Bericht!</p></div></section><footer>{R}Impressum und Datenschutz</footer></body>""",
    "nothing": f"""<body><nav><ul><li><a href="/">{R}Home</a></li><li><a href="/n">{R}News</a></li></ul></nav><div class="ad">{R}Buy now</div><footer>{R}All rights reserved</footer></body>""",
}


@pytest.fixture(scope="module")
def model():
    return op9_html.trained()


def test_pages_made_by_hand(model):
    right = []
    for page in PAGES.values():
        made = blocks(page)
        labels = np.array([M in b.text for b in made])
        made = [b._replace(text=b.text.replace(M, "").replace(R, "")) for b in made]
        right.append((model.probabilities(op9_html.Features([made])) >= 0.5) == labels)
    assert np.mean(np.concatenate(right)) >= 0.95


def test_words_tell_where_places_do_not(model):
    """Blocks of equal paths: the words alone say which is the notice."""
    page = blocks(f"<body><div><p>{BODY[0]}</p></div><div><p>{BODY[1]}</p></div><div><p>We use cookies: accept our privacy policy and cookie settings.</p></div></body>")
    p = model.probabilities(op9_html.Features([page]))
    assert p[2] < min(p[0], p[1])


def test_batches_and_windows_do_not_matter(model, monkeypatch):
    pages, _ = op9_html.training_pages(40, 5)
    alone = [op9_html.main_text([p], model)[0] for p in pages]
    for cells in (1, 7, 300, 1 << 14):
        monkeypatch.setattr(op9_html, "CELLS", cells)
        monkeypatch.setattr(op9_html.grouped, "__defaults__", (cells,))
        assert op9_html.main_text(pages, model) == alone


@pytest.mark.parametrize("page", [
    "<article>" + "<p>some words of text here.</p>" * 100_000 + "</article>", "<div>" * 100_000 + "text", '<div class="x">text' * 20_000,
    "<div><b>" + "<i>" * 100_000 + "</b>" * 100_000 + "x", "<p>" + "<b>" * 50_000 + "<div>" * 50_000, "<svg>" + "<g>" * 50_000 + "</g>" * 60_000 + "x", "<li>" * 50_000, "<table>" + "<tr><td>x" * 30_000,
])
def test_long_and_deep_pages(model, page):
    before, start = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.perf_counter()
    assert len(op9_html.main_text([blocks(page), blocks("<p>a</p>")] + [[]] * 3, model)) == 5
    assert time.perf_counter() - start < 30
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300 << 10


def test_gradients_against_differences(monkeypatch):
    pages, labels = op9_html.training_pages(4, 9)
    model = op9_html.Labeller(1)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x, y = op9_html.Features(pages), np.concatenate(labels)
    shown = (np.arange(len(y)) % 3 > 0).astype(np.float64)

    def loss():
        dense = op9_html.Features(pages)
        whole = dense.word_vectors
        dense.word_vectors = lambda t: whole(t, shown)
        p = model.probabilities(dense)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    grads = model.gradients(x, y, shown)
    rng = np.random.default_rng(0)
    for name, g in grads.items():
        for at in [np.unravel_index(np.abs(g).argmax(), g.shape), *[tuple(rng.integers(0, s) for s in g.shape) for _ in range(3)]]:
            step = 2e-2
            model.p[name][at] += step
            up = loss()
            model.p[name][at] -= 2 * step
            down = loss()
            model.p[name][at] += step
            assert g[at] == pytest.approx((up - down) / (2 * step), rel=0.08, abs=2e-5)


def test_repeated_rows_and_ids_of_any_type(spark, model):
    rows = [("a", "u", PAGES["news"]), ("a", "u", PAGES["news"]), (None, None, None)]
    got = op9_html.extract(spark.createDataFrame(rows, "page_id string, url string, html string"), model).collect()
    assert [r.page_id for r in got] == ["a", "a", None] and got[0].text == got[1].text != "" and got[2].text == ""
