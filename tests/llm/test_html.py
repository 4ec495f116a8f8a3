"""Main text of pages made for the purpose: names of furniture, what holds a page, depth, clusters."""

import time

import numpy as np
import pytest

from wrenchwork.llm import html_extract
from wrenchwork.llm.html_extract import main_text

STORY = " ".join(f"word{i}" for i in range(80))
PROSE = "A nice piece, I liked it a lot, and I will read the rest of it as well. " * 3
MENU = "<ul><li><a href=/a>One</a><li><a href=/b>Two</a><li><a href=/c>Three</a></ul>"

FURNITURE = (
    "comment-list user-comments comments-section comment-thread reader-comments commentlist comments site-footer "
    "pageFooter ad-container related-posts sidebar-right site-notice promo-box author-sidebar cookie-bar newsletter_box"
).split()


@pytest.mark.parametrize("name", FURNITURE)
def test_furniture_goes_whatever_else_its_name_says(name):
    for tag in ("div", "section", "article"):
        part = f"<{tag} class='{name}'><p>{PROSE}</p><p>{PROSE}</p></{tag}>"
        for around in ("main", "article", "div"):
            assert main_text(f"<body><{around}><p>{STORY}</p>{part}</{around}></body>") == STORY
        assert main_text(f"<body><article><p>{STORY}</p></article>{part}</body>") == STORY


def test_pages_of_furniture_have_no_text():
    for part in (
        f"<div class='cookie-notice'>{PROSE}</div>", f"<div class=comments>{PROSE}</div>", f"<aside>{PROSE}</aside>",
        f"<form><label>{PROSE}</label><input><button>Send</button></form>", f"<footer>{PROSE}</footer>", MENU.join(["<nav>", "</nav>"]),
    ):
        assert main_text(f"<body>{part}</body>") == ""


def test_parts_that_hold_the_page_stay():
    story = f"<h1>Title</h1><p>{STORY}</p>"
    for open_ in ("<div class=sidebar-right>", "<div id=page class='no-comments'>", "<article class=comments-open>", "<div class='sidebar-wrapper'>"):
        page = f"<body><p>Skip to the text</p>{open_}{story}</{open_[1:].split()[0]}></body>"
        assert main_text(page).endswith(f"Title\n{STORY}")
    assert main_text(f"<body><form id=aspnet><header>{MENU}</header><article>{story}</article></form></body>") == f"Title\n{STORY}"
    beside = f"<body><div class=sidebar><article><p>{PROSE[:60]}</p></article></div><div class=story>{story}</div></body>"
    assert main_text(beside) == f"Title\n{STORY}"
    code = f"<article><p>{STORY}</p><pre>x = 1 <span class='hl-comment'># why</span></pre></article>"
    assert main_text(code) == f"{STORY}\nx = 1 # why"


def test_clusters_decide(monkeypatch):
    """Without the clustering, lists of links inside an article and poor hinted parts are text."""
    hinted = f"<div class=search-tips>{MENU}</div>"
    page = f"<body><article><h1>Title</h1><p>{STORY}</p>{MENU}{hinted}<p>{STORY}</p></article></body>"
    assert main_text(page) == f"Title\n{STORY}\n{STORY}"
    steps = "<ul><li>one step<li>another step<li>a third</ul>"
    assert main_text(f"<article><p>{STORY}</p>{steps}</article>") == f"{STORY}\none step\nanother step\na third"
    monkeypatch.setattr(html_extract, "content_lines", lambda lines: np.ones(len(lines), dtype=bool))
    assert "Three" in main_text(page)


@pytest.mark.parametrize(
    "page",
    ["<div>" * 100_000 + "x", "<div>t" * 30_000, "<b>" * 50_000 + "<p>x" * 5_000, "<ul><li>" + "<b>" * 30_000 + "</li><li>" * 10_000,
     "<p>" + "<b>" * 20_000 + "</i>" * 20_000 + "x", f"<article>{'<div class=sidebar>' * 20_000}<p>{STORY}"],
)
def test_deep_pages_take_linear_time(page):
    start = time.perf_counter()
    main_text(page)
    assert time.perf_counter() - start < 10
