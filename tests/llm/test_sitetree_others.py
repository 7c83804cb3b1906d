"""Comments and adverts inside articles, and names that hold a listed word among others."""

import pytest
from inkveil.llm import sitetree


def kept(page):
    return [t for _, _, gone, t in sitetree.blocks(page) if not gone]


@pytest.mark.parametrize("part", ["<li class=comment>X</li>", "<p class='comment'>X</p>", "<p class=advert>X</p>", "<p class='ad-box'>X</p>", "<ul><li class='reply item'>X</li></ul>", "<div class='sponsored'><p>X</p></div>"])
def test_what_others_wrote_goes_from_articles(part):
    assert kept(f"<article><p>One</p>{part}<p>Two</p></article>") == ["One", "Two"]


@pytest.mark.parametrize("part", ["<p class=notice>X</p>", "<li class='comment-worthy'>X</li>", "<p class='no-comment'>X</p>", "<p class='lead'>X</p>", "<blockquote class=comment>X</blockquote>"])
def test_other_names_leave_paragraphs_of_articles(part):
    assert kept(f"<article><p>One</p>{part}<p>Two</p></article>") == ["One", "X", "Two"]


def test_a_listed_word_among_others_does_not_empty_a_page():
    assert kept("<nav>Menu</nav><div class='notice-board'><p>The article</p></div>") == ["The article"]
    assert kept("<div class='page-content social-science'><p>The article</p></div><footer>F</footer>") == ["The article"]
    assert kept("<div class='notice-board'><p>Board</p></div><div><p>The article</p></div>") == ["The article"]
    assert kept("<div class='cookie-notice'><p>Cookies</p></div>") == []
