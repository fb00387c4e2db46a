"""Names and hidden elements of pages: what loses furniture must not lose articles."""

import pytest

from recallforge.llm import html_extract as h

TREE = h.trained_tree()
PROSE = "The committee met on Tuesday to discuss the new bridge, which has been under repair since the spring flood. "
BODY = "".join(f"<p>{PROSE * n}</p>" for n in (2, 3, 2))
WANT = "\n".join((PROSE * n).strip() for n in (2, 3, 2))
MENU = '<nav><a href="/">Home</a> <a href="/news">News</a></nav>'


def text(page):
    return h.main_text(f"<html><body>{MENU}{page}</body></html>", TREE)


@pytest.mark.parametrize("start", [
    '<article title="The hidden cost of war">', '<article data-title="Hidden Figures">', '<article class="overflow hidden md:block">', '<article class="content lg:hidden">',
    '<article data-hidden="1" style="display: block">', '<article aria-hidden="false">', '<article title="how to use display: none">',
    '<article class="share-story">', '<article id="search-for-meaning">', '<article class="comment-ary">', '<article class="legal-notice-explained">', '<article class="login-required">',
    '<article class="post search-result">', '<article class="ad-hoc-committee-report">', '<article role="article" class="social-history">',
])
def test_articles_stay(start):
    assert text(f"{start}{BODY}</article>") == WANT


@pytest.mark.parametrize("name", ["share-story", "search-for-meaning", "comment-ary", "legal-notice-explained", "login-required"])
def test_articles_without_an_article_element_stay(name):
    assert text(f'<div class="{name}">{BODY}</div>') == WANT


def test_the_title_of_a_post_stays():
    assert text(f'<main><div class="post-header"><h1>A bridge for the valley</h1></div>{BODY}</main>') == f"A bridge for the valley\n{WANT}"


@pytest.mark.parametrize("start,end", [
    ('<div class="comment-list">', "</div>"), ('<section id="comments">', "</section>"), ('<div class="article-sidebar">', "</div>"), ('<div class="cookie-banner">', "</div>"), ('<div class="related-posts">', "</div>"),
    ("<div hidden>", "</div>"), ('<div HIDDEN="">', "</div>"), ('<div aria-hidden="true">', "</div>"), ('<div style="color: red; display : none">', "</div>"), ('<div class="site-footer">', "</div>"),
    ('<div class="newsletter-signup-box">', "</div>"), ("<aside>", "</aside>"), ('<div role="complementary">', "</div>"),
])
def test_furniture_goes(start, end):
    other = "Subscribers told us that they would rather not see any of this between the paragraphs of the text that they came for."
    assert text(f"<article>{BODY}{start}<p>{other}</p>{end}</article>") == WANT


def test_hidden_elements_nest():
    assert text(f"<article>{BODY}<svg><svg></svg>inner words</svg></article>") == WANT
    assert text(f"<article><svg/>{BODY}<template><div><template><p>a</p></template>{PROSE}</div></template></article>") == WANT
    assert text(f"<article>{BODY}<svg><svg/>x</svg><p>{PROSE}</p></article>") == f"{WANT}\n{PROSE.strip()}"
