from __future__ import annotations

import random

import numpy as np
import pytest

from tidemark.llm import html_text

LONG = " ".join(f"Sentence {i} of the text says what a reader came to this page for." for i in range(12))
TWO = " ".join(f"Another story has line {i} that is worth to be read as well." for i in range(12))
LINKS = "".join(f'<li><a href="/{i}">Somewhere {i}</a></li>' for i in range(12))


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (f'<body><ul>{LINKS}</ul><h1 class="entry-title">T</h1><div class="text"><p>{LONG}</p><p>{TWO}</p></div></body>', f"T {LONG} {TWO}"),
        (f'<body><div class="post">Short teaser.</div><div><p>{LONG}</p></div></body>', f"Short teaser. {LONG}"),
        (f"<body><article><p>{LONG}</p></article><ul>{LINKS}</ul><article><p>{TWO}</p></article></body>", f"{LONG} {TWO}"),
        (f"<body><article><p>{LONG}</p><article><p>{TWO}</p></article><p>End.</p></article></body>", f"{LONG} {TWO} End."),
        (f"<body><article><h1>H</h1><p>{LONG}</p><p>End.</p></article><ul>{LINKS}</ul></body>", f"H {LONG} End."),
    ],
)
def test_clusters_choose_among_all_regions(html, text):
    assert html_text.main_text(html) == text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        # names that an article uses as well
        (f'<article><p>{LONG}</p><h2 id="discussion">Discussion</h2><section id="related-work"><p>{TWO}</p></section><p class="legal">{LONG}</p></article>', f"{LONG} Discussion {TWO} {LONG}"),
        (f'<article class="social-history"><p>{LONG}</p></article>', LONG),
        (f'<article><p>{LONG}</p><div class="related"><ul>{LINKS}</ul></div></article>', LONG),
        (f'<body><div><p>{LONG}</p></div><div class="share"><a href="/">Share</a></div></body>', LONG),
        # what wraps everything is no furniture
        (f'<body><div class="content-sidebar-wrap"><div><p>{LONG}</p></div></div></body>', LONG),
        (f'<body><form action="/"><input><div><p>{LONG}</p><p>{TWO}</p></div></form></body>', f"{LONG} {TWO}"),
        (f'<body><div id="overlay"><article><p>{LONG}</p><form>Search here</form></article><footer><p>{TWO}</p></footer></div></body>', LONG),
        # comments are longer than the article
        (f'<article><p>{LONG}</p></article><div id="comments">{"".join(f"<p>{TWO}</p>" for _ in range(30))}</div>', LONG),
        (f'<article><p>{LONG}</p><div class="comments"><p>{TWO}</p></div><div class="cookie-notice"><p>{TWO}</p></div></article>', LONG),
        (f'<div class="post comments-open no-sidebar"><p>{LONG}</p></div><div class="comments-area">{"".join(f"<p>{TWO}</p>" for _ in range(9))}</div>', LONG),
        # one inside the other, and side by side
        (f"<main><p>Intro of some length for a start.</p><article><p>{LONG}</p></article><p>Outro of some length for an end.</p></main>", f"Intro of some length for a start. {LONG} Outro of some length for an end."),
        (f'<body><div class="entry"><p>{LONG}</p></div><div class="entry"><p>{TWO}</p></div></body>', f"{LONG} {TWO}"),
        (f'<p>{LONG}<span class="ad">Buy</span> End.</p>', f"{LONG} End."),
    ],
)
def test_names_are_hints(html, text):
    assert html_text.main_text(html) == text


def _nameless(seed):
    """A page of plain blocks, and its paragraphs."""
    r = random.Random(seed)
    words = lambda n: " ".join(r.choice(("river", "stone", "light", "harbour", "under", "seven", "walking")) for _ in range(n))
    links = lambda: "<ul>" + "".join(f'<li><a href="/{i}">{words(2)}</a></li>' for i in range(r.randint(8, 20))) + "</ul>"
    paragraphs = [words(r.randint(60, 200)) + "." for _ in range(r.randint(4, 12))]
    body = "".join(f"<div>{p}</div>" if seed % 2 else f"<p>{p}" for p in paragraphs)
    plain = "".join(f"<div><span>{words(1)}</span></div>" for _ in range(8))
    return f"<html><body>{plain}{links()}<table><tr><td>{links()}</td><td><div>{body}</div></td></tr></table>{links()}{plain}</body></html>", " ".join(paragraphs)


@pytest.mark.parametrize("seed", range(8))
def test_pages_without_any_name(seed):
    html, text = _nameless(seed)
    assert html_text.main_text(html) == text


def test_the_clusters_decide(monkeypatch):
    pages = [_nameless(s)[0] for s in range(8)] + [f'<body><div class="post">Short teaser.</div><div><p>{LONG}</p></div></body>', f"<body><article><p>{LONG}</p></article><ul>{LINKS}</ul><article><p>Tiny.</p></article></body>"]
    pages += [f'<article><p>{LONG}</p><section id="related"><p>{TWO}</p></section></article>', f'<article><p>{LONG}</p><div class="related"><ul>{LINKS}</ul></div></article>']
    found = [html_text.main_text(p) for p in pages]
    for value in (True, False):
        monkeypatch.setattr(html_text, "clusters", lambda lines, value=value: np.full(len(lines), value))
        changed = [html_text.main_text(p) != x for p, x in zip(pages, found, strict=True)]
        assert sum(changed) >= 9


def test_a_very_long_page():
    html = "<article>" + f"<p>{LONG}</p>" * 5000 + "</article>"
    assert html_text.main_text(html) == " ".join([LONG] * 5000)
