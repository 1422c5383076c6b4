"""HTML extraction by a recurrent block labeller.

A page is read as its sequence of leaf blocks.  Each block has a vector: hashed tokens of
its tag path (element names, classes, ids), the mean of the learned vectors of its hashed
words, and a few measures (length, share of linked text, digits, punctuation, place).  A
bidirectional LSTM in numpy reads the whole sequence and labels every block as main text or
not, so a block is judged by the document around it.  The text is that of the blocks
labelled main, in page order.

The labeller is trained here, by one task when first used, on pages made by a seeded
generator (``training_pages``) whose labels are known by construction; the pages to extract
are never learned from.  Its weights have a fixed size (a few hundred KB) and go to the
executors with the function.

Every page is read alone and whole: one pass, no shuffle.  Pages of similar length are
labelled together, as many as ``CELLS`` blocks allow; longer pages alone, in windows of
steps with the state carried on, so that what a task holds is a window and one page.

Defined cases: null and empty pages, and pages without main text, have the empty text;
repeated rows, null ids and ids of any type each get their row; extra columns are not read;
neither the length of a page nor the depth of its elements has a limit.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from umbra.llm.common import table
from umbra.llm.html_blocks import Block, Element, blocks
from umbra.llm.tokens import slices, split_words

PATH_SLOTS, WORD_SLOTS, WORD_SIZE, MEASURES, HIDDEN = 512, 2048, 12, 6, 16
#: Training: pages, passes, pages a step, and the seed of all of it.
PAGES, EPOCHS, STEP, SEED = 2000, 8, 40, 20240229
#: While training, this share of blocks hides its words, so that places alone say enough.
HIDDEN_WORDS = 0.4
#: Blocks labelled at once.
CELLS = 1 << 14


# Features

@cache
def _bit(token: str) -> int:
    return 1 << zlib.crc32(token.encode()) % PATH_SLOTS


def _own(element: Element, prefix: str = "") -> int:
    mask = 0
    for token in element.tokens.split():
        mask |= _bit(prefix + token)
    return mask


def path_mask(element: Element) -> int:
    """Slots, as bits, of the tokens anywhere on the path, and again of those of the last two elements."""
    above, e = [], element
    while e.mask is None:
        above.append(e)
        if e.parent is None:
            break
        e = e.parent
    for e in reversed(above):
        e.mask = (e.parent.mask if e.parent else 0) | _own(e)
    return element.mask | _own(element, "/") | (_own(element.parent, "/") if element.parent else 0)


def measures(page: list[Block]) -> np.ndarray:
    n = len(page)
    out = np.zeros((n, MEASURES), np.float32)
    for i, b in enumerate(page):
        size = len(b.text)
        out[i] = (min(np.log1p(size) / 6, 2), min(1.0, b.linked / size), b.text[-1] in ".!?", b.text.count(" ") < 5, i / n, 1)
    return out


class Features:
    """What the labeller reads of some pages, block after block."""

    def __init__(self, pages: list[list[Block]]):
        self.lengths = np.array([len(p) for p in pages])
        self.measures = np.concatenate([measures(p) for p in pages])
        of_element: dict[int, int] = {}  # by identity: pages are alive as long as this runs
        of_mask: dict[int, int] = {}
        self.path = np.empty(len(self.measures), np.int64)
        for i, b in enumerate(b for p in pages for b in p):
            key = id(b.path)
            if key not in of_element:
                of_element[key] = of_mask.setdefault(path_mask(b.path), len(of_mask))
            self.path[i] = of_element[key]
        lists = [np.flatnonzero(np.unpackbits(np.frombuffer(m.to_bytes(PATH_SLOTS // 8, "little"), np.uint8), bitorder="little")) for m in of_mask]
        self.path_of_slot = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        self.slots = np.concatenate(lists)
        words = split_words(pa.array([b.text for p in pages for b in p], pa.string()), lower_ascii=True)
        hashed = (zlib.crc32(w.strip(".,;:!?()[]|\"'").encode()) % WORD_SLOTS for w in words.vocabulary.to_pylist())
        self.words = np.fromiter(hashed, np.int64, len(words.vocabulary))[words.codes]
        self.n_words = np.diff(words.offsets)
        self.block_of_word = np.repeat(np.arange(len(self.n_words)), self.n_words)

    def word_vectors(self, table_: np.ndarray, shown: np.ndarray | None = None) -> np.ndarray:
        """The mean vector of each block's words."""
        out = np.zeros((len(self.n_words), WORD_SIZE), np.float32)
        has = np.flatnonzero(self.n_words)
        if len(has):
            starts = np.concatenate([[0], np.cumsum(self.n_words[has])[:-1]])
            out[has] = np.add.reduceat(table_[self.words], starts, axis=0) / self.n_words[has, None]
        return out if shown is None else out * shown[:, None]


# The labeller

class Labeller:
    """Two LSTMs, one for each direction, and a logistic output; parameters by name."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.p: dict[str, np.ndarray] = {"words": rng.normal(0, 0.1, (WORD_SLOTS, WORD_SIZE))}
        for d in "fb":
            self.p["path" + d] = rng.normal(0, 0.15, (PATH_SLOTS, 4 * HIDDEN))
            self.p["in" + d] = rng.normal(0, 0.15, (WORD_SIZE + MEASURES, 4 * HIDDEN))
            self.p["rec" + d] = rng.normal(0, 0.15, (HIDDEN, 4 * HIDDEN))
        self.p["out"] = rng.normal(0, 0.15, (2 * HIDDEN + 1,))
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def of_paths(self, d: str, x: Features) -> np.ndarray:
        """The part of each distinct path in all gates."""
        out = np.zeros((x.path_of_slot[-1] + 1 if len(x.path_of_slot) else 1, 4 * HIDDEN), np.float32)
        np.add.at(out, x.path_of_slot, self.p["path" + d][x.slots])
        return out

    @staticmethod
    def step(z: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(activations, cells, hidden) after one step; z: the sums of all gates."""
        a = np.empty_like(z)
        np.tanh(z * _HALF, out=a)  # a logistic function is a tanh of half its argument
        a[:, :3 * HIDDEN] = 0.5 * a[:, :3 * HIDDEN] + 0.5
        i, f, o, g = (a[:, k * HIDDEN:(k + 1) * HIDDEN] for k in range(4))
        c = f * c + i * g
        return a, c, o * np.tanh(c)

    def probabilities(self, x: Features) -> np.ndarray:
        """For every block; pages are read together, a window of steps at a time."""
        dense = np.concatenate([x.word_vectors(self.p["words"]), x.measures], axis=1)
        n = len(x.lengths)
        page = np.repeat(np.arange(n), x.lengths)
        step = np.arange(len(page)) - np.repeat(np.cumsum(x.lengths) - x.lengths, x.lengths)
        longest, window = int(x.lengths.max()), max(1, CELLS // n)
        both = np.ones((len(page), 2 * HIDDEN + 1), np.float32)
        for k, d in enumerate("fb"):
            place = step if d == "f" else x.lengths[page] - 1 - step
            order = np.argsort(place, kind="stable")
            bounds = np.searchsorted(place[order], np.arange(0, longest + window, window))
            paths, rec = self.of_paths(d, x), self.p["rec" + d]
            h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
            for w, (s, e) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                own = order[s:e]
                at = place[own] - w * window
                z = np.zeros((int(at.max(initial=-1)) + 1, n, 4 * HIDDEN), np.float32)
                z[at, page[own]] = paths[x.path[own]] + dense[own] @ self.p["in" + d]
                seen = np.empty((len(z), n, HIDDEN), np.float32)
                for t in range(len(z)):
                    _, c, h = self.step(z[t] + h @ rec, c)
                    seen[t] = h
                both[own, k * HIDDEN:(k + 1) * HIDDEN] = seen[at, page[own]]
        return _logistic(both @ self.p["out"])

    def gradients(self, x: Features, labels: np.ndarray, shown: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy; ``shown``: 0 for blocks whose words are hidden."""
        n, steps = len(x.lengths), int(x.lengths.max())
        page = np.repeat(np.arange(n), x.lengths)
        step = np.arange(len(page)) - np.repeat(np.cumsum(x.lengths) - x.lengths, x.lengths)
        dense = np.concatenate([x.word_vectors(self.p["words"], shown), x.measures], axis=1)
        both, kept = np.ones((len(page), 2 * HIDDEN + 1), np.float32), {}
        for k, d in enumerate("fb"):
            place = step if d == "f" else x.lengths[page] - 1 - step
            z = np.zeros((steps, n, 4 * HIDDEN), np.float32)
            z[place, page] = self.of_paths(d, x)[x.path] + dense @ self.p["in" + d]
            h, c = np.zeros((steps + 1, n, HIDDEN), np.float32), np.zeros((steps + 1, n, HIDDEN), np.float32)
            rec = self.p["rec" + d]
            for t in range(steps):
                z[t], c[t + 1], h[t + 1] = self.step(z[t] + h[t] @ rec, c[t])
            kept[d] = place, z, c, h
            both[:, k * HIDDEN:(k + 1) * HIDDEN] = h[1:][place, page]
        dlogit = ((_logistic(both @ self.p["out"]) - labels) / len(labels)).astype(np.float32)
        grads = {"out": both.T @ dlogit}
        dboth = dlogit[:, None] * self.p["out"][None, :]
        dwords = np.zeros((len(page), WORD_SIZE), np.float32)
        for k, d in enumerate("fb"):
            place, acts, c, h = kept[d]
            dh_out = np.zeros((steps, n, HIDDEN), np.float32)
            dh_out[place, page] = dboth[:, k * HIDDEN:(k + 1) * HIDDEN]
            dx, grads["rec" + d] = self.backward(self.p["rec" + d], acts, c, h, dh_out)
            rows = dx[place, page]
            grads["in" + d] = dense.T @ rows
            dwords += rows @ self.p["in" + d][:WORD_SIZE].T
            by_path = np.zeros((x.path.max() + 1, 4 * HIDDEN), np.float32)
            np.add.at(by_path, x.path, rows)
            grads["path" + d] = np.zeros_like(self.p["path" + d])
            np.add.at(grads["path" + d], x.slots, by_path[x.path_of_slot])
        dwords *= (shown / np.maximum(x.n_words, 1))[:, None]
        cell = (x.words[:, None] * WORD_SIZE + np.arange(WORD_SIZE)).ravel()
        grads["words"] = np.bincount(cell, dwords[x.block_of_word].ravel(), WORD_SLOTS * WORD_SIZE).reshape(WORD_SLOTS, WORD_SIZE).astype(np.float32)
        return grads

    @staticmethod
    def backward(rec: np.ndarray, acts: np.ndarray, c: np.ndarray, h: np.ndarray, dh_out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(gradient of the gates' sums, gradient of the recurrent weights).

        Steps behind the end of a page give no gradient: nothing there is asked for.
        """
        steps, n = acts.shape[:2]
        dz = np.empty_like(acts)
        dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        for t in range(steps - 1, -1, -1):
            i, f, o, g = (acts[t][:, k * HIDDEN:(k + 1) * HIDDEN] for k in range(4))
            dh = dh + dh_out[t]
            tc = np.tanh(c[t + 1])
            dc = dc + dh * o * (1 - tc * tc)
            dz[t] = np.concatenate([dc * g * i * (1 - i), dc * c[t] * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
            dh = dz[t] @ rec.T
            dc = dc * f
        return dz, h[:-1].reshape(-1, HIDDEN).T @ dz.reshape(-1, 4 * HIDDEN)

    def fit(self, pages: list[list[Block]], labels: list[np.ndarray], epochs: int = EPOCHS, step: int = STEP, rate: float = 0.012, seed: int = SEED) -> Labeller:
        """Adam on the cross-entropy of all blocks; pages of similar length make a step, in random order."""
        rng = np.random.default_rng(seed)
        by_length = sorted(range(len(pages)), key=lambda i: len(pages[i]))
        steps = [by_length[k:k + step] for k in range(0, len(pages), step)]
        made = [(Features([pages[i] for i in own]), np.concatenate([labels[i] for i in own])) for own in steps]
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        t = 0
        for epoch in range(epochs):
            lr = rate * (0.3 if epoch >= epochs * 2 // 3 else 1.0)
            for k in rng.permutation(len(made)):
                x, own = made[k]
                shown = (rng.random(len(own)) >= HIDDEN_WORDS).astype(np.float32)
                t += 1
                for name, g in self.gradients(x, own, shown).items():
                    first[name] += 0.1 * (g - first[name])
                    second[name] += 0.001 * (g * g - second[name])
                    self.p[name] -= (lr * (first[name] / (1 - 0.9**t)) / (np.sqrt(second[name] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return self


_HALF = np.repeat(np.array([0.5, 0.5, 0.5, 1.0], np.float32), HIDDEN)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


# Pages to learn from

_MAIN, _REST, _PART = "\x01", "\x02", "\x03"
_SLOT = re.compile("([\x01\x02\x03])(\\d+),(\\d+),(\\w*);")


#: Words that places of a page are known for, in four languages (fixed values).
TYPICAL = {
    "menu": "home about contact news products services blog login register help search menu start über kontakt aktuelles produkte anmelden hilfe suche accueil propos contactez actualités produits connexion aide recherche inicio acerca contacto noticias productos entrar ayuda buscar",
    "notice": "cookies cookie consent accept privacy settings policy website experience agree datenschutz zustimmen akzeptieren einstellungen accepter confidentialité paramètres aceptar privacidad configuración notice alert important javascript enable browser",
    "advert": "advertisement sponsored buy now sale offer discount free shipping deal save shop anzeige werbung kaufen angebot rabatt gratis jetzt publicité acheter offre remise maintenant anuncio comprar oferta descuento ahora promo",
    "form": "subscribe newsletter email name submit send sign password username message abonnieren senden absenden abonner envoyer inscrire suscribirse enviar correo nombre",
    "side": "related popular recent posts share follow tags categories archive more twitter facebook trending ähnliche beliebte teilen folgen kategorien archiv mehr articles populaires partager suivre relacionados populares compartir seguir etiquetas",
    "comments": "comment comments reply says posted ago thanks great agree first replies kommentar antworten sagt danke répondre commentaire dit merci responder comentario dice gracias",
    "footer": "copyright rights reserved terms imprint sitemap powered contact impressum alle rechte vorbehalten nutzungsbedingungen mentions légales droits réservés conditions aviso legal derechos reservados términos ©",
}
_COMMON = "the and of to in a is that it for on with as was der die das und ist in den von zu mit le la les de des et en un une que dans el los las y en que por con para".split()


@cache
def _lexicon() -> list[str]:
    """Invented words, so many that hardly any place is known for one, and common ones among them."""
    rng = np.random.default_rng(SEED)
    letters = np.array(list("etaoinshrdlucmfwypvbgkéüñ"))
    return ["".join(letters[rng.integers(0, len(letters), k)]) for k in rng.integers(1, 9, 14_000)] + _COMMON * 100


def _prose(rng: np.random.Generator, low: int, high: int, kind: str = "") -> str:
    """A sentence; for a part of the page half of the time of words typical of it."""
    words = _lexicon()
    n = int(rng.integers(low, high + 1))
    found = [words[i] for i in rng.integers(0, len(words), n).tolist()]
    share = (0.7 if rng.random() < 0.5 else 0.0) if kind else (0.2 if rng.random() < 0.05 else 0.0)
    if share:
        typical = TYPICAL[kind or _pick(rng, *TYPICAL)].split()
        found = [typical[i % len(typical)] if x < share else w for w, x, i in zip(found, rng.random(n).tolist(), rng.integers(0, 1 << 30, n).tolist(), strict=True)]
    text = " ".join(found).capitalize()
    return text + ("" if rng.random() < 0.2 else ".")


def _pick(rng: np.random.Generator, *options: str) -> str:
    return options[rng.integers(len(options))]


def training_page(rng: np.random.Generator) -> str:
    """A page whose main blocks start with one mark and whose other blocks with another."""
    # Text is marked by its place and size first, and written when the page is whole.
    main = lambda lo=2, hi=60: f"{_MAIN}{lo},{hi},;"
    rest = lambda lo=1, hi=12, kind="side": f"{_REST}{lo},{hi},{kind};"
    part = lambda lo, hi: f"{_PART}{lo},{hi},;"
    maybe = lambda p: rng.random() < p

    def items(lo: int, hi: int, kind: str) -> str:
        entry = lambda: f'<a href="/{rng.integers(99)}">{rest(1, 4, kind)}</a>'
        return "".join(f"<li>{entry()}</li>" for _ in range(rng.integers(lo, hi + 1)))

    def menu() -> str:
        return _pick(rng, "<nav>{}</nav>", "<nav>{}</nav>", '<nav class="main-navigation">{}</nav>', '<div class="nav">{}</div>', '<ul class="breadcrumbs">{}</ul>', '<div class="menu">{}</div>', '<div id="navbar">{}</div>', '<div role="navigation">{}</div>', '<header><nav>{}</nav></header>').format(f"<ul>{items(2, 8, 'menu')}</ul>")

    def box(kind: str, *names: str, lo: int = 1, hi: int = 25) -> str:
        name = _pick(rng, *names)
        some = lambda: rest(lo, hi, kind)
        body = _pick(rng, some(), f"<p>{some()}</p>", f"<p>{some()}</p><p>{some()}</p>", f"<h3>{rest(1, 4, kind)}</h3><ul>{items(1, 4, kind)}</ul>")
        return f'<{name}>{body}</{name.split()[0]}>'

    def advert() -> str:
        return box("advert", 'div class="ad"', 'div class="ad-container"', 'div class="ad-slot"', 'section class="ads"', 'div class="ads"', 'div class="advert"', 'div class="advertisement"', 'div class="banner"', 'div class="promo"', 'div class="sponsored"', 'aside class="ad"', 'div id="ad-top"', "aside", lo=1, hi=30)

    def notice() -> str:
        return box("notice", 'div class="cookie"', 'div class="cookie-notice"', 'div class="notice"', 'div id="consent"', 'div class="alert"', 'div role="alert"', 'div class="popup"', lo=3, hi=30)

    def form() -> str:
        body = f"<label>{rest(1, 4, 'form')}</label><input type=text><button>{rest(1, 2, 'form')}</button>"
        return _pick(rng, f"<form>{body}</form>", f'<form class="search">{body}</form>', f'<div class="newsletter"><form><p>{rest(3, 15, "form")}</p>{body}</form></div>', f"<form><select><option>{rest(1, 2, 'form')}</option><option>{rest(1, 2, 'form')}</option></select></form>")

    def side() -> str:
        return box("side", "aside", 'aside class="sidebar"', 'aside class="widget-area"', 'div class="sidebar"', 'div id="sidebar"', 'div class="related"', 'section class="related-posts"', 'div class="widget"', 'div class="share"', 'div class="social"', lo=2, hi=30)

    def comments() -> str:
        each = "".join(_pick(rng, '<div class="comment"><p>{}</p></div>', '<li class="comment">{}</li>', '<article class="comment"><p>{}</p></article>').format(rest(3, 50, "comments")) for _ in range(rng.integers(1, 5)))
        return _pick(rng, f'<div id="comments" class="comments-area"><h2 class="comments-title">{rest(1, 4, "comments")}</h2><ol class="comment-list">{each}</ol><form class="comment-form"><label>{rest(1, 4, "comments")}</label></form></div>', f'<section id="comments">{each}</section>', f'<section class="comments"><h2>{rest(1, 3, "comments")}</h2>{each}</section>', f'<div id="comments">{each}</div>', f'<ol class="comment-list">{each}</ol>', f'<div class="replies">{each}</div>')

    def footer() -> str:
        return box("footer", "footer", 'div class="footer"', 'div id="footer"', "footer", lo=3, hi=25) if maybe(0.5) else f"<footer>{rest(2, 25, 'footer')}</footer>"

    def article() -> str:
        title = main(2, 14)
        head = _pick(rng, f"<h1>{title}</h1>", f'<header class="entry-header"><h1 class="entry-title">{title}</h1></header>', f'<header class="article-header"><h1>{title}</h1><p>{main(4, 20)}</p></header>', f'<h1 class="title">{title}</h1>', f"<header><h1>{title}</h1></header>", f"<h1>{title}</h1><h2>{main(2, 10)}</h2>", f"<h1>{title}</h1><p><b>{title}<br>")
        parts = []
        for _ in range(rng.integers(1, 14)):
            parts.append(_pick(rng, f"<p>{main()}</p>", f"<p>{main()}</p>", f"<p>{main(1, 4)}</p>", f"<p><b>{main()}<br>{main(3, 30)}<p>{main()}</p>", f"<h2>{main(1, 8)}</h2>", f"<ul><li>{main(2, 20)}</li><li>{main(2, 20)}</li></ul>",
                               f"<blockquote><p>{main(4, 40)}</p></blockquote>", f'<p>{main(4, 30)} <a href="/x">{part(1, 4)}</a> {part(2, 20)}</p>', f"<p>{main(30, 120)}</p>", f"<pre>{main(3, 20)}</pre>", f"<table><tr><td>{main(1, 3)}</td><td>{main(1, 3)}</td></tr></table>"))
            if maybe(0.03):  # many short ones in a row
                parts += [f"<p>{main(1, 4)}</p>"] * int(rng.integers(2, 20))
            if maybe(0.06):
                parts.append(_pick(rng, advert, side, form, notice)())
        body = head + "".join(parts)
        named = _pick(rng, "main", "text", "body", "story", "page-content", "article", "entry", "single", "post-body", "primary", "c" + str(rng.integers(99)))
        return _pick(rng, "<article>{}</article>", "<article>{}</article>", "<article>{}</article>", "{}", f'<div id="{named}">{{}}</div>', f'<div class="{named}">{{}}</div>', f'<article class="post {named}"><div class="{named}">{{}}</div></article>', f'<main id="{named}">{{}}</main>', "<main>{}</main>", "<main><article>{}</article></main>", '<div class="content">{}</div>', '<div id="content">{}</div>', '<div class="post"><div class="entry-content">{}</div></div>', '<section class="story">{}</section>', '<div class="article-body">{}</div>', "<article>{}").format(body)

    parts = []
    if maybe(0.4):
        parts.append(notice())
    if maybe(0.35):
        parts.append(_pick(rng, "<header>{}</header>", '<header class="site-header">{}</header>', '<div class="header">{}</div>', '<div id="header">{}</div>').format(_pick(rng, f"<h1>{rest(1, 4)}</h1>", f'<a href="/">{rest(1, 3)}</a><p>{rest(2, 9)}</p>', rest(1, 12))))
    if maybe(0.9):
        parts.append(menu())
    for chance, make in ((0.5, advert), (0.15, form), (0.2, side)):
        if maybe(chance):
            parts.append(make())
    parts.append(article())
    for chance, make in ((0.2, advert), (0.3, side), (0.3, comments), (0.2, form), (0.9, footer), (0.1, notice)):
        if maybe(chance):
            parts.append(make())
    body = "".join(parts)
    if maybe(0.25):
        body = f'<div id="page"><div class="wrapper">{body}</div></div>'
    page = f"<!DOCTYPE html><html><head><title>{part(2, 9)}</title></head><body>{body}" + _pick(rng, "</body></html>", "")
    return _SLOT.sub(lambda m: ("" if m[1] == _PART else m[1]) + _prose(rng, int(m[2]), int(m[3]), m[4]), page)


def training_pages(n: int, seed: int) -> tuple[list[list[Block]], list[np.ndarray]]:
    rng = np.random.default_rng(seed)
    pages, labels = [], []
    for _ in range(n):
        page = blocks(training_page(rng))
        labels.append(np.array([_MAIN in b.text for b in page], np.float32))
        pages.append([b._replace(text=b.text.replace(_MAIN, "").replace(_REST, "")) for b in page])
    return pages, labels


@cache
def trained() -> Labeller:
    pages, labels = training_pages(PAGES, SEED)
    return Labeller().fit(pages, labels)


_trained: dict[str, Labeller] = {}


def trained_by(spark) -> Labeller:
    """The labeller, trained by one task of the cluster the first time an application asks."""
    app = spark.sparkContext.applicationId
    if app not in _trained:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _ in batches:
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(trained().p)], pa.binary())], names=["weights"])

        model = Labeller.__new__(Labeller)
        model.p = pickle.loads(spark.range(1, numPartitions=1).mapInArrow(run, "weights binary").first()["weights"])
        _trained[app] = model
    return _trained[app]


# Extraction

def grouped(lengths: list[int], cells: int = CELLS) -> Iterator[list[int]]:
    """The numbers of pages, shortest first, in groups whose size times longest page is at most ``cells`` (or one page)."""
    group: list[int] = []
    for i in sorted((i for i, n in enumerate(lengths) if n), key=lengths.__getitem__):
        if group and lengths[i] * (len(group) + 1) > cells:
            yield group
            group = []
        group.append(i)
    if group:
        yield group


def main_text(pages: list[list[Block]], labeller: Labeller) -> list[str]:
    texts = [""] * len(pages)
    for group in grouped([len(p) for p in pages]):
        main = labeller.probabilities(Features([pages[i] for i in group])) >= 0.5
        at = 0
        for i in group:
            texts[i] = " ".join(b.text for b, m in zip(pages[i], main[at:at + len(pages[i])], strict=True) if m)
            at += len(pages[i])
    return texts


def extract(pages: DataFrame, labeller: Labeller | None = None, html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every row."""
    weights = (labeller or trained_by(pages.sparkSession)).p
    rows = pages.select("page_id", "url", pages[html_col].alias("html"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema[:2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Labeller.__new__(Labeller)
        model.p = weights
        for whole in batches:
            for batch in slices(whole, "html"):
                texts = main_text([blocks(x.as_py()) for x in batch.column("html")], model)
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"{fields}, text string, n_chars long")


def op9_html(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
