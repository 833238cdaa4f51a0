"""What names of elements say is weighed: wrappers do not hide articles, parts beside them go."""

import pytest

from lodestone.llm import extraction

LONG = "The council met on Monday and it was agreed by all of them that the bridge will be closed for the summer while repairs are made. "
MORE = "Residents who live on the other side of the river said that they had not been asked about it, and that they would like to be. "


@pytest.mark.parametrize("name", ["content no-sidebar", "has-sidebar", "with-sidebar", "no-ads", "page-header", "post-header", "top-banner", "sidebar-right-layout", "promo"])
def test_a_wrapper_does_not_hide_an_article(name):
    page = f'<nav>Home</nav><div class="{name}"><article><h1>Title</h1><p>{LONG}</p><p>Short.</p></article></div><footer>end</footer>'
    assert extraction.main_text(page).split("\n") == ["Title", LONG.strip(), "Short."]
    # nor most of the page's text without an article element
    page = f'<nav>Home</nav><div class="{name}"><p>{LONG}</p><p>{MORE}</p></div><footer>end</footer>'
    assert extraction.main_text(page).split("\n") == [LONG.strip(), MORE.strip()]


@pytest.mark.parametrize("name", ["share-prices", "legal-analysis", "search-term", "related-work", "tags-explained", "notice-text"])
def test_names_with_other_words_keep_text(name):
    page = f'<article><p>{LONG}</p><div class="{name}"><p>{MORE}</p></div><p>{LONG}</p></article>'
    assert extraction.main_text(page).split("\n") == [LONG.strip(), MORE.strip(), LONG.strip()]


def test_a_title_in_an_entry_header_stays():
    page = f'<article><div class="entry-header"><h1>Title</h1></div><p>{LONG}</p></article>'
    assert extraction.main_text(page).split("\n") == ["Title", LONG.strip()]


@pytest.mark.parametrize("name", ["ad", "ads", "sidebar", "related-posts", "share-buttons", "newsletter-box", "cookie-banner", "comments", "comment-list", "promo_block", "adSlot"])
def test_parts_beside_the_article_go(name):
    side = f'<div class="{name}"><p>{MORE}</p></div>'
    assert extraction.main_text(f"<article><p>{LONG}</p>{side}<p>{LONG}</p></article>").split("\n") == [LONG.strip()] * 2
    assert extraction.main_text(f"<div><p>{LONG}</p><p>{LONG}</p></div>{side}").split("\n") == [LONG.strip()] * 2


def test_teasers_and_comments():
    teaser = f'<div class="related"><article><p>{MORE}</p></article></div>'
    assert extraction.main_text(f"<article><p>{LONG}</p></article>{teaser}") == LONG.strip()
    comments = f'<section id="comments">{"".join(f"<p>{MORE}</p>" for _ in range(30))}</section>'
    assert extraction.main_text(f"<div><p>{LONG}</p></div>{comments}") == LONG.strip()
