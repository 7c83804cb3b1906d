"""Main text of web pages by a site style tree (operator 6).

Each page is parsed once, by a scanner that never goes back, into blocks: runs of text between
block-level tags, each with the style node that holds it (tag, id, class and role of every
block-level ancestor; equal siblings share a node; nesting beyond ``DEPTH`` levels counts as
that level).  The DOMs of one host merged by these nodes are its site style tree.  Copies of
a page count once in it.  Per host and style node there are

* content importance (nodes with text of their own): the average over its texts of 1 - log c /
  log m, where c of the node's m pages have the text: 0 if all pages share it, 1 if one has it;
* presentation importance: entropy, base the number of pages, of the child styles under it;
* composite importance of a branch: a mix of its presentation's and the average content
  importance of all texts that it holds.

A text node's importance is its content's, and that of the branch around it for lack of
evidence: the branch counts as ``PRIOR`` further pages, and is itself taken as important by as
many.  So nothing is gone because of one page, and no number of pages switches the tree on.
Nodes of low importance are removed from every page of the host.

The tree judges where style is silent.  Tags and roles that name what is no part of an
article (navigation, forms, scripts, ...) go on any page, and so do branches with such a
class or id, unless the page's only article is in them, or names that merely hold such a word
(notice-board) would leave nothing of the page.  Where a page marks its article
(article, main or role=main) only that part is taken.  Inside it what has no style of its own
stays however often it is repeated, as articles may quote the same lines; a name removes only
what holds blocks, not a paragraph or list item (but for names of comments and adverts), and
only if it is made of such words alone; anything else is the tree's to judge.

Character references are decoded, white space inside a block becomes one space, blocks are
trimmed and joined by a line feed in page order.  Null html counts as empty; null urls are
one host.  Repeated rows stay and get equal texts.  Very long pages are read whole, in time
that grows with their length.  Further columns are not read, whatever their names.  An empty
table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import batch, pieces_of, staged

LOW, MIX, PRIOR, DEPTH = 0.2, 0.9, 2.0, 64

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td "
    "tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("caption dd dt head html body legend li option summary tbody td tfoot th thead tr".split()) | {"p"}
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dd": ({"dd", "dt"}, {"dl"}),
    "dt": ({"dd", "dt"}, {"dl"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}),
    "option": ({"option"}, {"select", "datalist"}),
}
DROPPED = frozenset(
    "nav footer aside form script style noscript template iframe object embed svg canvas button select textarea input menu dialog "
    "head title audio video noembed noframes xmp datalist search".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
# Words of ids and classes that name what is no part of an article.
STYLES = frozenset(
    "ad ads advert adverts advertisement advertising adbox adsense adslot banner promo promoted sponsor sponsored nav navbar navigation "
    "menu submenu topbar sidebar sidenav breadcrumb breadcrumbs footer masthead header comment comments disqus respond reply replies "
    "cookie cookies consent gdpr notice notices disclaimer popup modal overlay newsletter subscribe subscription signup login share "
    "sharing social related recommended widget pager pagination toolbar copyright skip".split()
)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
# A tag with no bracket in its quotes: the common case, and tried no further than the next one.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']++|\"[^\"<>]*+\"|'[^'<>]*+')*+)>")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_VALUE = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"(?:^|[\s/])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/]|$)", re.I)
# Words that turn such a name into its absence, or into what holds it among other things.
AROUND = frozenset("no non not has have with without wrap wrapper wrapping container layout".split())
# Words that go with such a name without making it another.
PARTS = frozenset("list area box block section slot unit link links button buttons bar post posts icon icons thread item items panel".split())
NONE, ARTICLE, OUT, NAMED, HEADING, WHOLE, OTHERS = 0, 1, 2, 3, 4, 5, 6
# Of these, those that name what readers or advertisers wrote, which is no part of an article as a paragraph or list item either.
FOREIGN = frozenset("ad ads advert adverts advertisement advertising sponsored promo promoted comment comments disqus respond reply replies".split())
# Elements that hold a piece of text, which no other name removes from an article.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th blockquote pre caption figcaption center".split())

# Of these, those that a comment or an advert may be by itself; a quotation of one is the article's.
LINES = frozenset("p li dd dt td".split())


def _style(tag: str, attributes: str) -> tuple[str, int]:
    """The node's name in the style tree, and whether the style itself decides."""
    found = {}
    if attributes and "=" in attributes or "hidden" in attributes:
        for name, a, b, c in _ATTRIBUTE.findall(attributes):
            found.setdefault(name.lower(), a or b or c)
    role = found.get("role", "").lower()
    name = tag
    for key in ("id", "class", "role"):
        if found.get(key):
            name += f"|{key}={re.sub(r'[0-9]+', '#', ' '.join(found[key].split()))}"
    if tag in ("article", "main") or role in ("main", "article"):
        return name, ARTICLE
    if tag in DROPPED or role in ROLES or "hidden" in found or found.get("aria-hidden") == "true":
        return name, OUT
    kind = NONE
    if tag not in ("html", "body"):
        for key in ("id", "class"):
            for word in (found.get(key) or "").split():
                parts = {p.lower() for p in _WORD.findall(word)}
                listed = STYLES & parts
                if listed and not AROUND & parts:
                    own = HEADING if listed == {"header"} else NAMED if not parts <= STYLES | PARTS else OTHERS if parts <= FOREIGN | PARTS else WHOLE
                    kind = max(kind, own, key=(NONE, HEADING, NAMED, WHOLE, OTHERS).index)
    return name, kind


class Scanner:
    """Tags and texts of a page, in one pass."""

    def __init__(self, page: str):
        self.page, self.open_quotes = page, False
        self.last = {q: page.rfind(q) for q in "\"'"}

    def tag(self, at: int):
        """(end, closing, name, attributes) of the tag that starts at ``at``, or None."""
        m = _TAG.match(self.page, at)
        if m:
            return m.end(), m[1], m[2], m[3]
        page = self.page
        slash = page.startswith("/", at + 1)
        m = _NAME.match(page, at + 1 + slash)
        if m is None:
            return None
        end = -1
        if not self.open_quotes:
            i = m.end()
            while (v := _VALUE.search(page, i)) is not None:
                if v[0] == ">":
                    end = v.start()
                    break
                if v.start() >= self.last[v[0]]:
                    break
                i = page.index(v[0], v.end()) + 1
            # Once quotes leave no end for a tag, those of later tags are not followed either.
            self.open_quotes = end < 0
        if end < 0:
            end = page.find(">", m.end())
        return None if end < 0 else (end + 1, "/" if slash else "", m[0], page[m.end() : end])

    def tokens(self):
        """Texts as (None, text), tags as (closing, name, attributes, end); send() an end to go on from there."""
        page, at, size = self.page, 0, len(self.page)
        while at < size:
            i = page.find("<", at)
            if i < 0:
                yield None, page[at:]
                return
            if i > at:
                yield None, page[at:i]
            at = i
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                at = size if end < 0 else end + 3
            elif page.startswith("<![CDATA[", at):
                end = page.find("]]>", at)
                at = size if end < 0 else end + 3
            elif page.startswith(("<!", "<?"), at):
                end = page.find(">", at)
                at = size if end < 0 else end + 1
            elif (found := self.tag(at)) is not None:
                at, closing, name, attributes = found
                moved = yield closing, name.lower(), attributes, at
                if moved is not None:
                    at = moved
                    yield  # for send()
            else:
                yield None, "<"
                at += 1


class _Open:
    # hard: removed by its tag or role; named: by a word of its class or id; nested: an article in something named;
    # node: the style node of the nearest block around; owner: the nearest element that ends a run of text.
    # doubtful: named only by a word among others.
    __slots__ = ("tag", "node", "owner", "article", "hard", "named", "nested", "out", "doubtful")

    def __init__(self, tag, node, article, hard, named, nested, doubtful=False):
        self.tag, self.node, self.article, self.hard, self.named, self.nested = tag, node, article, hard, named, nested
        self.doubtful = doubtful
        self.out = hard or named or nested
        self.owner = self


@dataclass
class Node:
    path: int
    up: int  # place of the node above, -1 for the root
    depth: int
    loose: bool  # the tree may remove it


def _deeper(nodes: list[Node], places: dict, at: int, name: str, loose: bool) -> int:
    above = nodes[at]
    if above.depth >= DEPTH:
        return at
    path = _hash(f"{above.path}/{name}")
    if (path, loose) not in places:
        places[path, loose] = len(nodes)
        nodes.append(Node(path, at, above.depth + 1, loose))
    return places[path, loose]


def read(page: str) -> tuple[list[tuple[int, bool, bool, str]], list[Node]]:
    """Blocks (place of its node, inside an article, removed by its style, text) in page order, without
    empty ones, and the page's style nodes, each after the one above it.

    A word of a class or id removes no article that is below it, unless the page has another.
    """
    out: list[tuple[int, bool, bool, str]] = []
    nested: list[int] = []
    doubtful_: list[int] = []
    nodes, places = [Node(_hash(""), -1, 0, True)], {}
    stack = [_Open("", 0, False, False, False, False)]
    owner, run, styles, opened = stack[0], [], {}, Counter()

    def flush() -> None:
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            run.clear()
            if text:
                if owner.nested and not owner.hard and not owner.named:
                    nested.append(len(out))
                if owner.named and owner.doubtful and not owner.hard:
                    doubtful_.append(len(out))
                out.append((owner.node, owner.article, owner.out, text))

    def pop_to(n: int) -> None:
        for x in stack[n:]:
            opened[x.tag] -= 1
        del stack[n:]

    tokens = Scanner(page).tokens()
    for token in tokens:
        if token[0] is None:
            run.append(token[1])
            continue
        closing, tag, attributes, at = token
        if not closing:
            if tag in CLOSES_P and opened["p"]:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == "p":
                        flush()
                        pop_to(i)
                        break
                    if stack[i].tag in BLOCK:
                        break
            if tag in ENDS and any(opened[x] for x in ENDS[tag][0]):
                ended, within = ENDS[tag]
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in within:
                        break
                    if stack[i].tag in ended:
                        flush()
                        pop_to(i)
                        if tag != "tr":
                            break
            owner = stack[-1].owner if not run else owner
            if tag in BLOCK or tag in DROPPED:
                flush()
            if tag == "br":
                run.append(" ")
            if tag in VOID:
                owner = stack[-1].owner if not run else owner
                continue
            parent = stack[-1]
            if (tag, attributes) not in styles:
                styles[tag, attributes] = _style(tag, attributes)
            name, kind = styles[tag, attributes]
            # A header inside an article may hold its headline.
            hard = parent.hard or kind == OUT or (tag == "header" and not parent.article)
            if parent.article:
                named = parent.named or (kind == OTHERS and tag in LINES) or (kind in (WHOLE, OTHERS) and tag in BLOCK and tag not in PROSE)
            else:
                named = parent.named or kind in (NAMED, HEADING, WHOLE, OTHERS)
            doubtful = parent.doubtful if parent.named else kind in (NAMED, HEADING)
            below = parent.nested or (kind == ARTICLE and parent.named and not parent.article)
            if below and not parent.nested:
                named = False
            inside = parent.article or (kind == ARTICLE and not hard and not named)
            block = tag in BLOCK or tag in DROPPED
            if tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(page, at)
                tokens.send(close.end() if close else len(page))
                continue
            if attributes.endswith("/") and tag not in BLOCK:
                continue
            node = parent.node
            if block:
                plain = parent.article and name == tag
                node = _deeper(nodes, places, node, name, nodes[node].loose if plain else not (inside and kind == ARTICLE))
            own = _Open(tag, node, inside, hard, named, below, doubtful)
            if block or own.out != parent.out:
                if own.out != parent.out:
                    flush()
            else:
                own.owner = parent.owner
            stack.append(own)
            opened[tag] += 1
        elif opened[tag]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    if tag in BLOCK or tag in DROPPED or stack[i].out != stack[i - 1].out:
                        flush()
                    pop_to(i)
                    break
                if tag not in BLOCK and stack[i].tag in BLOCK and tag not in DROPPED:
                    break
        elif tag in BLOCK:
            flush()
        top = stack[-1].owner
        if owner is not top:
            if run and owner.node != top.node:
                flush()
            owner = top
    flush()
    if nested and not any(article and not gone for _, article, gone, _ in out):
        for i in nested:
            out[i] = (out[i][0], True, False, out[i][3])
    if all(gone for _, _, gone, _ in out):  # a name that only holds such a word does not empty a page
        for i in doubtful_:
            out[i] = (out[i][0], out[i][1], False, out[i][3])
    return out, nodes


def blocks(page: str) -> list[tuple[int, bool, bool, str]]:
    return read(page)[0]


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


# loose: the tree may remove it.
_BLOCKS = pa.list_(pa.struct([("path", pa.int64()), ("loose", pa.bool_()), ("text", pa.string())]))
_NODES = pa.list_(pa.struct([("path", pa.int64()), ("style", pa.int64()), ("ups", pa.list_(pa.int64()))]))
_TEXTS = pa.list_(pa.struct([("path", pa.int64()), ("text", pa.int64())]))
_PARSED = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("host", pa.int64()), ("page", pa.int64()), ("blocks", _BLOCKS), ("nodes", _NODES), ("texts", _TEXTS)]
)
_PARSED_DDL = (
    "page_id long, url string, host long, page long, blocks array<struct<path:long,loose:boolean,text:string>>, "
    "nodes array<struct<path:long,style:long,ups:array<long>>>, texts array<struct<path:long,text:long>>"
)
_HOST = re.compile(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)")


def _host(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def _parse(page: str):
    """The blocks that may be kept; the style nodes with text that style does not remove, and those above
    them, with a hash of the child styles of each; and the different texts of each node."""
    found, nodes = read(page)
    found = [x for x in found if not x[2]]
    used = dict.fromkeys(x[0] for x in found)
    children: dict[int, dict[int, None]] = {}
    for at in list(used):
        while (up := nodes[at].up) >= 0:
            children.setdefault(up, {})[nodes[at].path] = None
            used[up] = None
            at = up

    def ups(at: int) -> list[int]:
        out = []
        while (at := nodes[at].up) >= 0:
            out.append(nodes[at].path)
        return out

    merged = {}
    for at in used:
        # Parts of an article and others of the same style are one node of the tree.
        merged.setdefault(nodes[at].path, {"path": nodes[at].path, "style": _hash("\n".join(map(str, children.get(at, ())))), "ups": ups(at)})
    texts = dict.fromkeys((nodes[x[0]].path, _hash(x[3])) for x in found)
    kept = [x for x in found if x[1]] or found
    kept = [{"path": nodes[n].path, "loose": nodes[n].loose, "text": t} for n, _, _, t in kept]
    return kept, list(merged.values()), [{"path": p, "text": t} for p, t in texts]


def _page(texts: list[dict]) -> int:
    """A hash of what the page holds: copies of a page have the same."""
    return _hash("\n".join(f"{t['path']} {t['text']}" for t in texts))


def parsed(pages: DataFrame) -> DataFrame:
    def run(batches):
        for b in pieces_of(batches, rows=1000, size=4 << 20, column="html"):
            all_ = [_parse(x) for x in b.column("html").to_pylist()]
            urls = b.column("url").to_pylist()
            rows = {"page_id": b.column("page_id"), "url": urls, "host": [_hash(_host(u)) for u in urls], "page": [_page(x[2]) for x in all_]}
            yield batch(rows | {k: [x[i] for x in all_] for i, k in enumerate(("blocks", "nodes", "texts"))}, _PARSED)

    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")
    )
    return rows.mapInArrow(run, _PARSED_DDL)


def style_tree(pages: DataFrame, mix: float = MIX, prior: float = PRIOR) -> DataFrame:
    """host, path, pages, presentation, content, composite, importance (content and importance: null
    where a node has no text of its own) of each style node, from parsed pages.

    Counts are aggregated by host, node and feature before anything meets by host, so a host
    with a third of all pages costs one row for each of its distinct features and task.
    """
    node = ["host", "path"]

    def sums(column: str, feature: str, *more):
        each = pages.select("host", F.explode(column).alias("n")).select("host", "n.*")
        counted = each.groupBy(*node, feature).agg(F.count("*").alias("c"), *more)
        first = [F.first(x).alias(x) for x in counted.columns if x == "ups"]
        return counted.groupBy(*node).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log("c")).alias("s"), *first)

    def held_by(value, pages_, belief):
        return (value * (pages_ - 1) + belief * prior) / (pages_ - 1 + prior)

    styles = sums("nodes", "style", F.first("ups").alias("ups")).withColumnRenamed("n", "pages")
    styles = styles.select(*node, "pages", "ups", F.when(F.col("pages") > 1, 1 - F.col("s") / (F.col("pages") * F.log("pages"))).otherwise(1.0).alias("presentation"))
    level = styles.join(sums("texts", "text"), node, "left")
    level = level.select(
        *node, "pages", "ups", "presentation", "n",
        F.when(F.col("n").isNotNull(), F.when(F.col("pages") > 1, 1 - F.col("s") / (F.col("n") * F.log("pages"))).otherwise(1.0)).alias("content"),
    )
    around = F.explode(F.concat(F.array("path"), "ups")).alias("path")
    below = level.where("n is not null").select("host", around, "n", "content").groupBy(*node).agg((F.sum(F.col("n") * F.col("content")) / F.sum("n")).alias("mean"))
    raw = mix * F.col("mean") + F.when(F.col("mean") > 0, (1 - mix) * F.col("presentation")).otherwise(0.0)
    tree = level.join(below, node).withColumn("composite", held_by(raw, F.col("pages"), F.lit(1.0)))
    above = tree.select("host", F.col("path").alias("up"), F.col("composite").alias("branch"))
    text = tree.where("n is not null").select(*node, "pages", "content", F.get("ups", F.lit(0)).alias("up"))
    text = text.join(above, ["host", "up"], "left")
    text = text.select(*node, held_by(F.col("content"), F.col("pages"), F.coalesce("branch", F.lit(1.0))).alias("importance"))
    return tree.join(text, node, "left").select(*node, "pages", "presentation", "content", "composite", "importance")


def different(rows: DataFrame) -> DataFrame:
    """One row of each page of a host: copies tell nothing of what its pages have in common."""
    pages = rows.select("host", "page", "row")
    repeated = pages.groupBy("host", "page").agg(F.count("*").alias("copies"), F.min("row").alias("first")).where("copies > 1")
    again = pages.join(repeated, ["host", "page"]).where("row <> first").select("row")
    return rows.join(again, "row", "left_anti")


def main_text(pages: DataFrame, low: float = LOW) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages."""
    rows = staged(parsed(pages).withColumn("row", F.monotonically_increasing_id()), "parsed")
    weak = staged(style_tree(different(rows)).where(F.col("importance") < low).select("host", "path"), "weak")
    used = rows.select("row", "host", F.explode(F.array_distinct(F.transform(F.filter("blocks", lambda b: b["loose"]), lambda b: b["path"]))).alias("path"))
    gone = used.join(weak, ["host", "path"]).groupBy("row").agg(F.collect_set("path").alias("weak"))
    # Only pages with a block that the tree may remove meet its verdicts; the others' texts are not shuffled.
    open_ = F.exists("blocks", lambda b: b["loose"])
    page = rows.select("row", "page_id", "url", "blocks")
    full = page.where(open_).join(gone, "row", "left").unionByName(page.where(~open_).withColumn("weak", F.lit(None).cast("array<long>")))
    kept = F.when(F.col("weak").isNull(), F.col("blocks")).otherwise(F.filter("blocks", lambda b: ~(b["loose"] & F.array_contains(F.col("weak"), b["path"]))))
    return full.select("page_id", "url", F.concat_ws("\n", F.transform(kept, lambda b: b["text"])).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
