"""Pages whose content is not one article of paragraphs."""

import pytest

from dockpulse.llm import html_text

LONG = ["Paragraph %d " % i + "word " * 118 + "end." for i in range(8)]


def page(body):
    return f"<html><body><nav>menu</nav>{body}<footer>foot</footer></body></html>"


@pytest.mark.parametrize(
    "block, lines",
    [
        ("<ul><li>one</li><li>two</li><li>three</li></ul>", ["one", "two", "three"]),
        ("<blockquote>A short quote</blockquote>", ["A short quote"]),
        ("<table><tr><td>a</td><td>b</td></tr></table>", ["a", "b"]),
        ("<section><div>Nested twice</div></section>", ["Nested twice"]),
    ],
)
def test_blocks_within_the_content_stay(block, lines):
    paragraphs = [f"<p>{t}</p>" for t in LONG]
    html = page("<div>" + "".join(paragraphs[:4]) + block + "".join(paragraphs[4:]) + "</div><div>by</div>")
    assert html_text.main_text(html).split("\n") == LONG[:4] + lines + LONG[4:]


def test_paragraphs_in_blocks_of_their_own_stay():
    blocks = "".join(f"<div><p>{t}</p></div>" for t in LONG)
    html = page(f"<div>{blocks}<div><p>Short end.</p></div></div><div>by</div>")
    assert html_text.main_text(html).split("\n") == [*LONG, "Short end."]


def test_a_short_article_counts():
    html = page(f"<article><h1>{'h' * 20}</h1><p>{'p' * 60}</p></article><div>{'x' * 500}</div>")
    assert html_text.main_text(html) == "h" * 20 + "\n" + "p" * 60


@pytest.mark.parametrize("name", ["right-sidebar", "no-sidebar", "nav-open", "sidebar", "widget search"])
@pytest.mark.parametrize("tag", ["div", "span", "section"])
def test_a_wrapper_of_any_name_keeps_the_page(name, tag):
    content = "".join(f"<p>{t}</p>" for t in LONG)
    for inner in (f"<article>{content}</article>", f"<div>{content}</div>"):
        html = page(f"<{tag} id=page class='{name}'>{inner}<div class='social-share'>share it</div></{tag}>")
        assert html_text.main_text(html).split("\n") == LONG


def test_a_small_article_in_a_named_element_is_judged_anew():
    html = page(f"<div class=widget><article><p>Short article.</p></article></div><div>{'x' * 500}</div>")
    assert html_text.main_text(html) == "Short article."


def test_headings_in_an_entry_header_stay():
    html = page("<article><div class='entry-header'><h1>Head</h1></div><p>Text.</p><p class='ad'>Buy</p></article>")
    assert html_text.main_text(html) == "Head\nText."


TEXT = "<p>" + "</p><p>".join(LONG[:2]) + "</p>"


@pytest.mark.parametrize(
    "noise",
    [
        "<div class=comments-area><p>What a very nice text this is, thank you.</p></div>",
        "<div id=comments>" + f"<p>{LONG[5]}</p>" * 9 + "</div>",
        "<div class='site-header'>A site of texts</div>",
        "<div class=site-footer><p>All rights reserved by all of us here</p></div>",
        "<div id=comments><article class=comment-body><p>I have read this twice.</p></article></div>",
        "<div class=replies><article><p>Me too.</p></article></div>",
    ],
)
def test_names_with_further_parts_exclude(noise):
    for content in (f"<div>{TEXT}</div>", f"<article>{TEXT}</article>"):
        assert html_text.main_text(page(content + noise)).split("\n") == LONG[:2]
        assert html_text.main_text(page(noise + content)).split("\n") == LONG[:2]


@pytest.mark.parametrize("name", ["comment-list", "share-buttons", "related-posts", "ad-slot", "article-share"])
def test_named_parts_of_an_article_go(name):
    html = page(f"<article>{TEXT}<ol class={name}><li>one of several further things</li></ol></article>")
    assert html_text.main_text(html).split("\n") == LONG[:2]


def test_the_cluster_overrules_a_landmark():
    """The ratios alone decide: the same teaser is passed over beside long text, and taken alone."""
    teaser = "<article><p>Teaser</p></article>"
    assert html_text.main_text(page(f"<div>{TEXT}</div>{teaser}")).split("\n") == LONG[:2]
    assert html_text.main_text(page(f"<div>{teaser}{TEXT}</div>")).split("\n") == ["Teaser", *LONG[:2]]
    assert html_text.main_text(page(f"<div>by me</div>{teaser}")) == "Teaser"


def test_without_landmarks_the_ratios_decide():
    links = "".join(f"<span><a href=/{i}>link {i}</a></span> " for i in range(40))
    html = page(f"<div><p>{links}</p></div><div>{TEXT}</div><div><p>{links}</p></div>")
    assert html_text.main_text(html).split("\n") == LONG[:2]
