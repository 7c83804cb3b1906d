import pytest
from test_sitetree import kept


@pytest.mark.parametrize("page, want", [
    ("<div class='content-with-sidebar'><p>a</p></div>", ["a"]), ("<div class='layout no-sidebar'><article>a</article></div>", ["a"]),
    ("<div class=has-comments><p>a</p></div>", ["a"]), ("<div id=page-header-wrap><article><p>a</p></article></div>", ["a"]),
    ("<div class=sidebar><p>s</p><main><p>a</p><div class=ad>buy</div><p>b</main>t</div>", ["a", "b"]), ("<div class=sidebar><article>teaser</article></div><article>a</article>", ["a"]),
    ("<article><div class=entry-header><h1>T</h1></div><p>x</p></article>", ["T", "x"]), ("<div class=page-header>site</div><p>x", ["x"]),
    ("<nav class=menu><article>n</article></nav><p>x", ["x"]), ("<div class=sidebar><aside><article>n</article></aside></div><p>x", ["x"]),
])
def test_names_do_not_remove_articles(page, want):
    assert kept(page) == want
