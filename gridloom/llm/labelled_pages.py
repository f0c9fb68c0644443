"""Labelled pages from which the content model is trained: written for this library and put together from parts.

``data-y`` labels an element and what lies below it until the next label: 1 is main text, 0 is not. Each page has one
frame for its main text, boxes around it and sometimes boxes inside it; frames, boxes and texts are drawn
with a fixed seed, so that every frame and every box occurs with short and long texts, with lists and with links.
A part of the pages has no names at all: plain boxes around a story that is longer than they are.
"""

from __future__ import annotations

import random

SENTENCES = [
    "A whole sentence of the story, with a comma, tells what happened.",
    "Another one follows it, and ends here.",
    "The next paragraph goes on for a while; it has several clauses, some numbers like 42, and a full stop.",
    "One short line.",
    "No comma here at all but quite a few words in a row.",
    "Why is that so?",
    "First point",
    "Some words of a title",
    "Nine",
]
# opening tags of frames of main text; {} takes the label
FRAMES = [
    "<article {}>", "<article {}>", '<article class="post" {}>', '<article id="article" class="entry" {}>', "<main {}>", '<main id="main" {}>',
    '<main role="main" class="content" {}>', '<div id="content" {}>', '<div class="content" {}>', '<div class="main-content" {}>',
    '<div id="main" {}>', '<div class="post-body" {}>', '<div class="entry-content" {}>', '<div class="article-body" {}>',
    '<div class="article" {}>', '<div class="story" {}>', '<div class="story-text" {}>', '<div class="body-text" {}>', '<div id="text" {}>',
    '<div itemprop="articleBody" class="article__body" {}>', '<section class="content" {}>', '<section class="post" {}>', "<section {}>",
    '<div class="page-content" {}>', '<div role="main" {}>', '<div role="article" {}>', '<div class="blog-post" {}>', "<div {}>", '<td class="content" {}>',
]
# tag and attributes of boxes that are no main text
BOXES = [
    ("nav", ""), ("nav", ""), ("nav", 'class="menu"'), ("nav", 'class="breadcrumb"'), ("header", ""), ("header", 'class="site-header"'), ("footer", ""),
    ("footer", ""), ("footer", 'class="site-footer"'), ("aside", ""), ("aside", ""), ("aside", 'class="sidebar"'), ("form", ""), ("form", 'class="search"'),
    ("div", 'class="menu"'), ("div", 'id="menu"'), ("div", 'class="nav"'), ("div", 'id="navigation"'), ("div", 'role="navigation"'), ("div", 'class="navbar"'),
    ("div", 'class="topbar"'), ("div", 'class="header"'), ("div", 'id="header"'), ("div", 'role="banner"'), ("div", 'class="masthead"'), ("div", 'class="logo"'),
    ("div", 'class="footer"'), ("div", 'id="footer"'), ("div", 'role="contentinfo"'), ("div", 'class="bottom"'), ("div", 'class="copyright"'),
    ("div", 'class="legal"'), ("div", 'class="imprint"'), ("div", 'class="sidebar"'), ("div", 'id="sidebar"'), ("div", 'class="side-bar widget"'), ("div", 'class="widget"'),
    ("div", 'role="complementary"'), ("div", 'class="related"'), ("section", 'class="related-posts"'), ("div", 'class="recommended"'), ("div", 'class="popular"'),
    ("div", 'class="teaser"'), ("div", 'class="ad"'), ("div", 'class="ad"'), ("div", 'class="ads"'), ("div", 'class="advert"'), ("div", 'class="advertisement"'), ("div", 'class="ad-box"'),
    ("div", 'class="sponsored"'), ("div", 'class="sponsor"'), ("div", 'class="promo"'), ("div", 'class="banner"'), ("div", 'class="notice"'), ("div", 'class="notice"'), ("div", 'class="alert"'),
    ("div", 'class="warning"'), ("div", 'class="message"'), ("div", 'class="cookie-notice"'), ("div", 'class="cookies"'), ("div", 'id="cookie-banner"'), ("div", 'class="consent"'),
    ("div", 'class="gdpr privacy"'), ("div", 'role="dialog"'), ("div", 'class="modal"'), ("div", 'class="popup overlay"'), ("div", 'role="alert"'), ("dialog", ""),
    ("div", 'class="comments"'), ("section", 'class="comments"'), ("section", 'id="comments"'), ("div", 'class="comment"'), ("div", 'id="comments"'), ("div", 'class="comment-list"'), ("ol", 'class="commentlist"'),
    ("div", 'class="reader-comments"'), ("div", 'id="disqus_thread"'), ("div", 'class="discussion"'), ("div", 'class="responses replies"'), ("div", 'class="reviews"'), ("div", 'class="user-comments"'),
    ("div", 'class="share"'), ("div", 'class="social"'), ("div", 'class="follow"'), ("div", 'class="newsletter"'), ("div", 'class="subscribe"'), ("div", 'class="signup"'),
    ("div", 'class="login"'), ("div", 'class="search"'), ("div", 'class="form"'), ("div", 'class="pagination"'), ("div", 'class="pager"'), ("div", 'class="tags"'), ("div", 'class="meta"'),
    ("div", 'class="byline author"'), ("div", 'class="toolbar"'), ("div", 'class="skip"'), ("div", 'class="disclaimer"'), ("div", 'class="breadcrumbs"'), ("ul", 'class="menu"'), ("ul", 'class="nav links"'),
    ("p", 'class="copyright"'), ("p", 'class="notice"'), ("p", 'class="ad"'),
]
WRAPPERS = ["", "", "", '<div class="page">', '<div id="wrapper">', '<div class="container">', '<div class="wrap row">', '<div class="layout grid"><div class="col">', '<div id="page">']


def _text(draw: random.Random) -> str:
    return " ".join(draw.choice(SENTENCES) for _ in range(draw.choice((1, 1, 2, 3))))


def _links(draw: random.Random) -> str:
    return "<ul>" + "".join(f'<li><a href="/x">{draw.choice(("Home", "News", "About us", "Next story"))}</a></li>' for _ in range(draw.randint(2, 5))) + "</ul>"


def _story(draw: random.Random) -> str:
    parts = [f"<h1>{draw.choice(SENTENCES)}</h1>"] if draw.random() < 0.8 else []
    for _ in range(draw.randint(1, 7)):
        kind = draw.random()
        if kind < 0.66:
            parts.append(f"<p>{_text(draw)}</p>")
        elif kind < 0.76:
            parts.append(f"<h2>{draw.choice(SENTENCES)}</h2><p>{_text(draw)}</p>")
        elif kind < 0.84:
            tag = draw.choice(("ul", "ol"))
            parts.append(f"<{tag}>" + "".join(f"<li>{_text(draw)}</li>" for _ in range(draw.randint(2, 4))) + f"</{tag}>")
        elif kind < 0.88:
            parts.append(f"<blockquote><p>{_text(draw)}</p></blockquote>")
        elif kind < 0.92:
            parts.append(f"<div><p>{_text(draw)}</p><p>{_text(draw)}</p></div>")
        elif kind < 0.95:
            parts.append("<pre>x = 1</pre><figure><figcaption>What the picture shows</figcaption></figure>")
        elif kind < 0.98:
            parts.append(f"<section><h3>{draw.choice(SENTENCES)}</h3><p>{_text(draw)} <a>Link</a></p></section>")
        else:
            parts.append("<table><tr><th>Name</th><td>Value</td></tr><tr><td>One</td><td>42</td></tr></table><dl><dt>Term</dt><dd>Meaning.</dd></dl>")
    return "".join(parts)


def _box(draw: random.Random, tag: str, attributes: str) -> str:
    kind = draw.random()
    if tag in ("ul", "ol"):
        inner = "".join(f"<li><p>{_text(draw)}</p></li>" for _ in range(draw.randint(1, 4)))
    elif tag == "p":
        inner = _text(draw)
    elif kind < 0.3:
        inner = _links(draw)
    elif kind < 0.5:
        inner = _text(draw)
    elif kind < 0.85:
        head = draw.choice(("h1", "h2", "h2", "h3", "h4"))
        inner = f"<{head}>{draw.choice(SENTENCES)}</{head}>" * draw.randint(0, 1) + "".join(
            draw.choice(("<p>{}</p>", "<p>{}</p>", "<div><p>{}</p></div>", "<div><span>Name</span><p>{}</p></div>")).format(_text(draw)) for _ in range(draw.randint(1, 5))
        )
    else:
        inner = f"<label>Mail</label><p>{_text(draw)}</p>"
    return f'<{tag} {attributes} data-y="0">{inner}</{tag}>'


def _nameless(draw: random.Random) -> str:
    """A page of boxes without names: short ones, or lists of links, around a long story."""

    def box() -> str:
        kind = draw.random()
        tag = draw.choice(("div", "div", "div", "section"))
        inner = _links(draw) if kind < 0.5 else f"<p>{draw.choice(SENTENCES)}</p>" * draw.randint(1, 2) if kind < 0.8 else f"<h3>{draw.choice(SENTENCES)}</h3>" + _links(draw)
        return f"<{tag}>{inner}</{tag}>"

    if draw.random() < 0.5:  # few long paragraphs
        story = "".join(f"<p>{' '.join(_text(draw) for _ in range(draw.randint(3, 6)))}</p>" for _ in range(draw.randint(2, 4)))
    else:
        story = "".join(_story(draw) for _ in range(draw.randint(2, 4)))
    if draw.random() < 0.6:
        story = f"<h1>{draw.choice(SENTENCES)}</h1>{story}"
    tag = draw.choice(("div", "div", "section"))
    before, behind = ("".join(box() for _ in range(draw.randint(0, 3))) for _ in range(2))
    wrapper = draw.choice(("", "", "<div>", "<div><div>"))
    return f'<body data-y="0">{wrapper}{before}<{tag} data-y="1">{story}</{tag}>{behind}{"</div>" * wrapper.count("<div")}</body>'


def build(number: int = 220, seed: int = 7, nameless: int = 120) -> list[str]:
    """The labelled pages; every frame and box is used in turn, and ``nameless`` pages have neither."""
    draw, pages, at = random.Random(seed), [], 0

    def some(n: int) -> list[str]:
        nonlocal at
        at += n
        return [_box(draw, *BOXES[k % len(BOXES)]) for k in range(at - n, at)]

    for k in range(number):
        story = _story(draw)
        if draw.random() < 0.5:  # boxes among the paragraphs
            cut = story.find("</p>") + 4 if "</p>" in story else 0
            inside = some(draw.randint(1, 2))
            story = story[:cut] + inside[0] + story[cut:] + "".join(inside[1:])
        around = some(draw.randint(2, 5))
        middle = draw.randint(0, len(around))
        wrapper = WRAPPERS[k % len(WRAPPERS)]
        if k % 8 == 7:  # no frame: labelled elements right in the body
            for tag in ("h1", "h2", "p", "ul", "ol", "blockquote", "pre", "figure", "section", "table", "dl"):
                story = story.replace(f"<{tag}>", f'<{tag} data-y="1">')
            framed = story
        else:
            opening = FRAMES[k % len(FRAMES)]
            framed = opening.format('data-y="1"') + story + f"</{opening[1:].split()[0].rstrip('>')}>"
        inner = "".join(around[:middle]) + framed + "".join(around[middle:])
        pages.append(f'<body data-y="0">{wrapper}{inner}{"</div>" * wrapper.count("<div")}</body>')
    return pages + [_nameless(draw) for _ in range(nameless)]
