"""Main text of web pages by tree scoring.

The page becomes a tree (tags may be unclosed, crossed or cut off). Elements that never hold an article's text (scripts,
controls, hidden ones) go. Elements that usually hold none are suspects: those named nav, header, footer, aside, form and
the like, those with such a role, and those whose class or id says menu, advert, notice, comment, teaser and the like. A
word of a class says so only if nothing before or after it in the same name takes it back ("has-sidebar", "no-share",
"comments-open"). A suspect is a layout's wrapper, and stays, if the prose in it outweighs the prose outside of all
suspects: as much, if a word of content or an article or main element stands in it, else WRAPPER times as much; nav,
header, footer, aside and dialogs need the article or main element. Lists made of links alone are menus and go.

Every block with text of its own passes points for its length and commas to its parent, half to the grandparent, less to
those above; points are discounted by the share of a container's text that stands in links, lowered in suspects that
stayed, and raised by a word of content and for article and main elements. The container with the most points is the
best. If the article or main element around it scores at least half as well, that is taken instead. Siblings of the best are
kept that score near it or read like prose or headings; an article or main element stands for itself.

White space inside a block becomes one space, a line break among it; blocks are joined in page order by a newline.

Cases: a null, empty or text-free page gives the empty string; repeated rows are worked one by one; pages of any length
and depth are read whole and without recursion; a null url stays null; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import read

# Elements by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset(
    "script style noscript template head title button select option textarea input label iframe object embed svg math canvas audio video map datalist output progress".split()
)
ASIDE = frozenset("nav header footer aside menu dialog".split())
FORM = frozenset("form fieldset".split())
BLOCK = frozenset(
    "html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption address center details summary hr hgroup search".split()
)
ENDS_P = BLOCK | frozenset("nav header footer aside form fieldset menu dialog".split())
#: A start tag ends open elements of these names, up to the nearest of the barriers.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "thead": ({"tbody", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
}
# Words in a class or id, and roles, that mark boilerplate; words that mark content.
BOILERPLATE = frozenset(
    """ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promoted promotion sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs
    footer foot header masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup signin login share sharing social related recommended recommendations
    comment comments disqus reply replies respond widget widgets toolbar pagination pager skip skiplink outbrain taboola paywall disclaimer aside toc""".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
CONTENT = frozenset("article content post entry story text body main page hentry blog".split())
# Words of a name that take back what stands after them, and before them.
TAKE_BACK = frozenset("no has with without not hide show is js non".split())
STATES = frozenset("open closed on off enabled disabled count allowed".split())
#: How many times the prose outside a suspect must hold that no word of content and no article vouches for.
WRAPPER = 9
#: Characters of prose a form must hold to be a layout's wrapper.
FORM_PROSE = 250
NAMES, PARTS = re.compile(r"[^\s]+"), re.compile(r"[a-z]+")
CUT_TAG = re.compile(r"<(?:/?[a-zA-Z]|[!?])[^<>]*\Z")


def marks_of(names: str) -> tuple[bool, bool]:
    """Whether the names of a class or id say boilerplate, and whether they say content."""
    bad = good = False
    for name in NAMES.findall(names.lower()):
        parts = PARTS.findall(name)
        for k, part in enumerate(parts):
            good |= part in CONTENT
            if part in BOILERPLATE and not TAKE_BACK.intersection(parts[:k]) and not (k + 1 < len(parts) and parts[k + 1] in STATES):
                bad = True
    return bad, good


class Node:
    __slots__ = ("tag", "parent", "children", "dropped", "suspect", "content", "prose", "points", "size", "linked", "links", "holds")

    def __init__(self, tag: str, parent: Node | None, dropped: bool = False, suspect: bool = False, content: bool = False) -> None:
        self.tag, self.parent, self.dropped, self.suspect, self.content = tag, parent, dropped, suspect, content
        self.children: list[Node | str] = []
        self.prose = 0  # characters outside links and outside suspects below this node
        self.points = 0.0
        self.size = self.linked = self.links = 0
        self.holds = False  # an article or main element that is no suspect stands inside


class Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", None)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ENDS_P:
            self._end({"p"}, ENDS_P - {"p"})
        if tag in ENDS:
            self._end(*ENDS[tag])
        values = dict(attrs)
        bad, good = marks_of(f"{values.get('class') or ''} {values.get('id') or ''}")
        hidden = "hidden" in values or (values.get("aria-hidden") or "").lower() == "true" or "display:none" in (values.get("style") or "").replace(" ", "").lower()
        suspect = tag in ASIDE or tag in FORM or (values.get("role") or "").lower() in ROLES or bad and tag not in ("html", "body")
        node = Node(tag, self.at, tag in NEVER or hidden, suspect, good)
        self.at.children.append(node)
        if tag in ("article", "main") and not suspect:
            above = self.at
            while above and not above.holds:
                above.holds = True
                above = above.parent
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        # An inline element's end does not close the block around it.
        while node.parent and node.tag != tag:
            if tag not in ENDS_P and node.tag in ENDS_P:
                return
            node = node.parent
        if node.parent:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)

    def _end(self, names: set[str], barriers: set[str] | frozenset[str]) -> None:
        node = self.at
        while node.parent and node.tag not in barriers:
            if node.tag in names:
                self.at = node.parent
            node = node.parent


def parse(html: str) -> Node:
    builder = Builder()
    builder.feed(CUT_TAG.sub("", html))
    builder.close()
    judge_suspects(builder.root)
    return builder.root


def _order(root: Node) -> list[Node]:
    """Nodes that are not dropped, parents first."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(c for c in node.children if isinstance(c, Node) and not c.dropped)
    return out


def judge_suspects(root: Node) -> None:
    """Suspects that are no wrappers are dropped, and lists of links."""
    order = _order(root)
    for node in reversed(order):
        text = sum(len(" ".join(c.split())) for c in node.children if isinstance(c, str))
        node.size += text
        node.prose += text
        if node.tag == "a":
            node.linked, node.prose, node.links = node.size, 0, node.links + 1
        above = node.parent
        if above:
            above.size += node.size
            above.linked += node.linked
            above.links += node.links
            above.prose += 0 if node.suspect else node.prose
        if node.tag in ("ul", "ol", "dl") and node.links >= 2 and node.linked >= 0.8 * node.size:
            node.dropped = True
    outside = root.prose
    vouched = [(not (n.content or n.holds), -n.prose, k, n) for k, n in enumerate(order) if n.suspect]
    for bare, _, _, node in sorted(vouched, key=lambda x: x[:3]):
        least = outside * (WRAPPER if bare else 1)
        may = not bare and (node.holds or node.tag not in ASIDE) or bare and node.tag not in ASIDE and (node.tag not in FORM or node.prose >= FORM_PROSE)
        if may and node.prose and node.prose >= least:
            outside += node.prose
        else:
            node.dropped = True
    for node in order:
        node.size = node.linked = 0


def blocks(roots: list[Node]) -> list[str]:
    """Texts of the blocks under the roots, in page order."""
    out: list[str] = []
    line: list[str] = []

    def flush() -> None:
        if text := " ".join("".join(line).split()):
            out.append(text)
        line.clear()

    stack: list[Node | str | None] = list(reversed(roots))
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            line.append(x)
        elif x.tag == "br":
            line.append(" ")
        elif not x.dropped:
            block = x.tag in BLOCK
            if block:
                flush()
                stack.append(None)
            stack.extend(reversed(x.children))
    flush()
    return out


def score(root: Node) -> list[Node]:
    """Fills points, size (characters) and linked (characters in links); the nodes that are not dropped, children first."""
    order = _order(root)
    order.reverse()
    for node in order:
        own, inline_text = [], 0
        for c in node.children:
            if isinstance(c, str):
                own.append(c)
                inline_text += len(" ".join(c.split()))
            elif not c.dropped:
                node.size += c.size
                node.linked += c.linked
                if c.tag not in BLOCK:
                    inline_text += c.size
        text = " ".join("".join(own).split())
        node.size += len(text)
        if node.tag == "a":
            node.linked = node.size
        if node.tag in BLOCK and node.tag not in ("html", "body") and inline_text >= 25:
            points = 1 + text.count(",") + min(inline_text / 100, 3.0)
            above, share = node.parent, 1.0
            for share in (1.0, 0.5, 0.25, 0.15):
                while above and above.tag not in BLOCK and above.parent:
                    above = above.parent
                if not above or not above.parent:
                    break
                above.points += points * share
                above = above.parent
            node.points += points * 0.5  # a container may itself hold the text
    for node in order:
        if node.content:
            node.points *= 1.25
        if node.suspect:
            node.points *= 0.5
        if node.tag in ("article", "main"):
            node.points *= 2
        elif node.tag in ("ul", "ol", "dl", "table", "thead", "tbody", "tr"):
            node.points *= 0.7
        node.points *= 1 - node.linked / node.size if node.size else 0
    return order


def main_nodes(root: Node) -> list[Node]:
    order = score(root)
    best = max(reversed(order), key=lambda n: n.points, default=None)
    if best is None or not best.size:
        return []
    if not best.points:  # no block long enough to score: the article if there is one, else all
        return [next((n for n in reversed(order) if n.tag in ("article", "main") and n.size), root)]
    if best.tag not in ("article", "main"):
        above = best.parent
        while above and above.tag not in ("article", "main"):
            above = above.parent
        if above and above.points >= 0.5 * best.points:
            best = above
    if best.tag in ("article", "main") or not best.parent or best.parent.tag in ("html", "#root"):
        return [best]
    kept = []
    for c in best.parent.children:
        if not isinstance(c, Node) or c.dropped:
            continue
        density = c.linked / c.size if c.size else 1.0
        prose = c.tag in ("p", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "figure", "table", "ul", "ol", "dl") and density < 0.25
        if c is best or c.points >= max(1.0, 0.2 * best.points) and density < 0.5 or prose and c.size:
            kept.append(c)
    return kept


def extract(html: str | None) -> str:
    return "\n".join(blocks(main_nodes(parse(html)))) if html else ""


def main_text(html: Column | str) -> Column:
    """Main text of a column of pages."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(extract)

    return run(html)


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return pages.select("page_id", "url", main_text(F.coalesce("html", F.lit(""))).alias("text")).withColumn("n_chars", F.length("text").cast("long"))


QUERIES = {"op7_html": op7_html}
