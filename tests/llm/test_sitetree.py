import math
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from inkveil.llm import sitetree as S


def kept(page):
    found = S.blocks(page)
    marked = [t for _, a, o, t in found if a and not o]
    return marked or [t for _, _, o, t in found if not o]


@pytest.mark.parametrize("page, want", [
    ("", []), ("plain &amp; simple", ["plain & simple"]), ("<p>a<p>b", ["a", "b"]), ("<ul><li>a<li>b</ul>", ["a", "b"]),
    ("<p>one <b>two</b>\n three<br>four</p>", ["one two three four"]), ("<script>var x='</p>'</script><style>p{}</style><p>x", ["x"]),
    ("<nav>menu</nav><article><header><h1>T</h1></header><p>x</p></article><footer>f</footer>", ["T", "x"]), ("<header>site</header><p>x", ["x"]),
    ("<div class='Comments-list'>c</div><div id=sidebar>s</div><div class=adverb>ok</div>", ["ok"]), ("<div role=navigation>n</div><form>f</form><p hidden>h</p>t", ["t"]),
    ("<article><p>a</p><div class=ad>buy</div><p>b", ["a", "b"]), ("x < 3 and <unknown>y</unknown>", ["x < 3 and y"]), ("<!-- <p>no</p> -->yes<![CDATA[no]]>", ["yes"]),
    ("<p title='a>b'>q</p>", ["q"]), ("<table><tr><td>1<td>2<tr><td>3</table>", ["1", "2", "3"]), ("<p>&eacute;&#233;&#xE9;&nbsp;&bogus;</p>", ["ééé &bogus;"]),
    ("</p></div>text</article>", ["text"]), ("<div>" * 400 + "deep", ["deep"]), ("<p>cut off <b", ["cut off <b"]),
])
def test_pages(page, want):
    assert kept(page) == want


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, 1, "x") for i, (u, h) in enumerate(rows)], "page_id long, url string, html string, row long, text string").coalesce(2)


def test_site_tree_removes_what_a_host_repeats(spark):
    one = [("http://a.example/%d" % i, f"<div class=box>Follow us today</div><div class=story><p>Story {i} of many</p></div><div class=box2>All rights %s</div>" % "kept") for i in range(8)]
    few = [("http://b.example/%d" % i, "<div class=box>Follow us today</div><p>Text</p>") for i in range(2)]
    odd = [(None, None), ("http://a.example/x", ""), ("http://c.example/", "<article><p>Same</p></article>")] + [(f"http://c.example/{i}", "<article><p>Same</p></article><p>loose</p>") for i in range(9)]
    got = {r["page_id"]: r["text"] for r in S.main_text(pages(spark, one + few + odd)).collect()}
    assert [got[i] for i in range(8)] == [f"Story {i} of many" for i in range(8)]
    assert [got[i] for i in (8, 9)] == ["Follow us today\nText"] * 2
    assert got[10] == got[11] == "" and all(got[i] == "Same" for i in range(12, 22))


def path_of(*names):
    path = S._hash("")
    for name in names:
        path = S._hash(f"{path}/{name}")
    return path


def brute_tree(rows):
    """path -> (pages, presentation, content, composite, importance) of one host, by the definitions."""
    distinct = {}
    for html in rows:
        found, nodes = S.read(html)
        own, kids, up = {}, {}, {}
        for n, _, out, text in found:
            if not out:
                own.setdefault(nodes[n].path, set()).add(text)
                at = n
                while nodes[at].up >= 0:
                    above = nodes[nodes[at].up].path
                    up[nodes[at].path] = above
                    kids.setdefault(above, []).append(nodes[at].path) if nodes[at].path not in kids.get(above, []) else None
                    at = nodes[at].up
        seen = dict.fromkeys((nodes[n].path, text) for n, _, out, text in found if not out)
        distinct.setdefault(tuple(seen), (own, kids, up))
    pages = list(distinct.values())
    paths = {p for own, kids, _ in pages for p in (*own, *kids)}
    up = {k: v for _, _, u in pages for k, v in u.items()}

    def entropy(counts, m):
        return 1.0 if m <= 1 else -sum(c / m * math.log(c / m, m) for c in counts)

    m = {p: sum(p in own or p in kids for own, kids, _ in pages) for p in paths}
    pres = {p: entropy(Counter(tuple(kids.get(p, ())) for own, kids, _ in pages if p in own or p in kids).values(), m[p]) for p in paths}
    texts = {p: Counter(t for own, _, _ in pages for t in own.get(p, ())) for p in paths}
    content = {p: sum(c * (1 - (math.log(c) / math.log(m[p]) if m[p] > 1 else 0)) for c in t.values()) / sum(t.values()) for p, t in texts.items() if t}

    def within(p, q):
        while p != q and p in up:
            p = up[p]
        return p == q

    composite = {}
    for p in paths:
        below = [q for q in content if within(q, p)]
        n = {q: sum(texts[q].values()) for q in below}
        mean = sum(n[q] * content[q] for q in below) / sum(n.values())
        raw = S.MIX * mean + ((1 - S.MIX) * pres[p] if mean > 0 else 0)
        composite[p] = (raw * (m[p] - 1) + S.PRIOR) / (m[p] - 1 + S.PRIOR)
    weight = {p: (content[p] * (m[p] - 1) + composite.get(up.get(p), 1.0) * S.PRIOR) / (m[p] - 1 + S.PRIOR) for p in content}
    return {p: (m[p], pres[p], content.get(p), composite[p], weight.get(p)) for p in paths}


def test_tree_against_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for i in range(40):
        menu = "".join(f"<li>{rng.choice('abcd')}{rng.choice('xy')}</li>" for _ in range(rng.randrange(1, 5)))
        story = "".join(f"<p>{rng.choice(['same', i, rng.randrange(9)])} text</p>" for _ in range(rng.randrange(4)))
        box = "<div class=box>Follow <span>us</span><div><b>now</b></div></div>" if i % 3 else "<div class=box><p>now</p></div>"
        rows.append(f"<div id=top{i}><ul class=m>{menu}</ul></div>{box}<div>{story}<section class=x>end</section></div>")
    rows += rows[:9] * 3 + ["", "bare"]
    got = S.style_tree(S.different(S.parsed(pages(spark, [("http://a.example/%d" % i, r) for i, r in enumerate(rows)])).withColumn("row", F.monotonically_increasing_id()))).collect()
    want = brute_tree(rows)
    assert {r["path"] for r in got} == set(want)
    for r in got:
        for a, b in zip((r["pages"], r["presentation"], r["content"], r["composite"], r["importance"]), want[r["path"]]):
            assert a is b is None or abs(a - b) < 1e-9, (r, want[r["path"]])


def test_importance(spark):
    rows = [("http://a.example/%d" % i, f"<div class=box2>Home</div><p>Unlike {i}</p>") for i in range(6)]
    tree = {r["path"]: r for r in S.style_tree(S.parsed(pages(spark, rows)).withColumn("row", F.lit(1))).collect()}
    assert abs(tree[path_of("div|class=box#")]["content"]) < 1e-9 and abs(tree[path_of("p")]["content"] - 1) < 1e-9 and abs(tree[path_of()]["presentation"]) < 1e-9


@pytest.mark.parametrize("page, want", [
    ("<article><p class='notice'>Real para one</p><div class='related-work'><p>Related work text</p></div><p>Two</p></article>", ["Real para one", "Related work text", "Two"]),
    ("<article><p>a</p><div class=share-buttons>s</div><div class='comment-list'><p>c</p></div><ul class=comments><li>c</ul><blockquote class=comment>kept</blockquote></article>", ["a", "kept"]),
    ("<a b='x>y' c=\"it's\">t</a><hr><i d='>u</i>", ["t", "u"]), ("<p>x</p><i y='z", ["x", "<i y='z"]),
])
def test_articles_stay_whole(page, want):
    assert kept(page) == want


def test_the_tree_judges_silent_styles_in_articles(spark):
    rows = [(f"http://a.example/{i}", f"<main><h1>Same headline</h1><div class=bx>Read more of us</div><p>Story {i}</p><p>Same last line</p></main>") for i in range(12)]
    rows += [(f"http://b.example/{i}", f"<main><h1>Same headline</h1><div class=bx>Read more of us</div><p>Story {i}</p></main>") for i in range(3)]
    got = {r["page_id"]: r["text"] for r in S.main_text(pages(spark, rows)).collect()}
    assert [got[i] for i in range(12)] == [f"Same headline\nStory {i}\nSame last line" for i in range(12)]
    assert [got[i] for i in range(12, 15)] == [f"Same headline\nRead more of us\nStory {i}" for i in range(3)]


@pytest.mark.parametrize("page", [
    "<i x='" * 170_000, "<i x='>" * 140_000 + "'", "<i x=\"'>" * 110_000, "<div>" * 200_000 + "x", "<b>" * 150_000 + "<hr>" * 150_000, "<" * 1_000_000,
    "<script>" * 120_000, "<li><b>" * 140_000, "<!--" * 250_000, "<p></div>" * 110_000, "<b></p>" * 140_000, "<div class=a>" * 70_000 + "</p>" * 70_000,
])
def test_time_grows_with_length(page):
    start = time.process_time()
    S._parse(page)
    assert time.process_time() - start < 6


def test_a_very_long_page(spark):
    long = "<main>" + "".join(f"<p>Paragraph {i} &amp; more</p>" for i in range(60_000)) + "</main>"
    (row,) = S.main_text(pages(spark, [("u", long)])).collect()
    assert row["text"].split("\n") == [f"Paragraph {i} & more" for i in range(60_000)]


def test_query_shape(spark):
    rows = S.main_text(pages(spark, [("u", "<p>é\n b</p>"), ("u", "<p>é\n b</p>")])).orderBy("page_id").collect()
    assert [(r["page_id"], r["url"], r["text"], r["n_chars"]) for r in rows] == [(0, "u", "é b", 3), (1, "u", "é b", 3)]
    assert S.main_text(pages(spark, [("u", "x")]).where("false")).count() == 0
