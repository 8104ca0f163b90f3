"""Main text of web pages, with the templates of their sites removed.

Element subtrees of a page are hashed and Spark counts, per host, on how many distinct pages each
hash occurs; subtrees that recur on many pages of the host are its template and are deleted. Two
hashes are counted:

- of a subtree's tag, class, and text or children: the same words again and again;
- beside the articles of a page that has any, of a named slot, which is its path of tags, classes
  and ids without text: a menu, an advert or a footer recurs whatever it says. Named are elements
  with a class, id or role, and sectioning ones; a plain block is judged by its words alone.

Articles share sentences, so inside them a subtree must recur on half of the host's pages to be
template, far above any common sentence. What a page itself declares not to be content (navigation,
headers, footers, asides, forms, scripts, styles, adverts, notices, comments) goes as well, for
hosts with too few pages to count.

Pages of a host with the same text count as one page, and for subtrees of articles pages with the
same articles do, so that a copied article does not become a template. Subtrees without text are no
templates, nor are parts of a line of text, such as a bold word.
"""

from __future__ import annotations

import html as markup
import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import Settled, join_by_group, settle

#: Share of a host's distinct pages, and number of them, from which a subtree is template: beside
#: articles by its words, inside them by its words, and beside them by its place.
RATIO = 0.05
INSIDE_RATIO = 0.5
SLOT_RATIO = 0.5
MIN_PAGES = 5

# HTML's elements by what they mean for a page's text.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
_NEVER = frozenset(
    "script style noscript template iframe head title nav header footer aside form button select "
    "input textarea dialog menu svg canvas object embed audio video map label fieldset datalist".split()
)
_BLOCKS = frozenset(
    "address article blockquote body caption center dd details div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_CLOSES_P = _BLOCKS - {"html", "body"}
# Never shown as text, whatever the words of a page's markup.
_SILENT = frozenset("script style noscript template iframe head title svg canvas object embed audio video datalist".split())
_SECTIONS = frozenset("nav header footer aside section form menu dialog".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
_NOISE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsbygoogle|sponsor\w*|promo\w*|banner\w*|cookie\w*|consent|notice\w*|gdpr|popup|modal|"
    r"overlay|newsletter|subscri\w*|signup|share|sharing|social|related|recommend\w*|sidebar\w*|side|menu\w*|nav|navbar|"
    r"navigation|breadcrumb\w*|pagination|pager|comments?|commentlist|respond|disqus\w*|replies|footer\w*|header|masthead|"
    r"toolbar|widget\w*|login|search)(?:$|[\s_-])",
    re.IGNORECASE,
)
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACES = re.compile(r"\s+")


@dataclass
class Element:
    tag: str
    attributes: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)  # elements and texts, in order
    hash: int = 0
    text: bool = False  # whether there is text in its subtree
    inside: bool = False  # whether it is, or is in, an article

    def key(self) -> int:
        """The subtree's hash, another one inside articles, where pages are told apart by other text."""
        return self.hash ^ (self.inside << 62)

    def noise(self, words: bool = True) -> bool:
        """Whether the page itself declares it no content; without `words` only what is never text is."""
        if not words:
            return self.tag in _SILENT
        a = self.attributes
        if not a:
            return self.tag in _NEVER
        if self.tag in _NEVER or a.get("role", "").lower() in _ROLES or "hidden" in a or a.get("aria-hidden") == "true":
            return True
        return any(_NOISE.search(a[k]) for k in ("class", "id") if k in a)


def parse(page: str) -> Element:
    """A tree of a page, however broken: unclosed elements end with their parents."""
    root = Element("html")
    stack, at = [root], 0
    while at < len(page):
        match = _TAG.search(page, at)
        if match is None:
            break
        if match.start() > at:
            stack[-1].children.append(page[at : match.start()])
        at = match.end()
        if match[2] is None:
            if match[0].startswith("<![CDATA["):
                stack[-1].children.append(match[0][9:-3])
            continue
        tag = match[2].lower()
        if match[1]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    del stack[depth:]
                    break
                if stack[depth].tag in ("article", "main", "body") and tag not in ("article", "main", "body", "html"):
                    break  # a stray end tag does not leave the container
            continue
        _end_implied(stack, tag)
        values = {}
        if match[3].strip(" /\n\t"):
            for name, double, single, bare in _ATTRIBUTE.findall(match[3]):
                values.setdefault(name.lower(), markup.unescape(double or single or bare))
        element = Element(tag, values)
        stack[-1].children.append(element)
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(page, at)
            element.children.append(page[at : end.start() if end else len(page)])
            at = end.end() if end else len(page)
        elif tag not in _VOID and not match[3].endswith("/"):
            stack.append(element)
    if at < len(page):
        stack[-1].children.append(page[at:])
    return root


def _end_implied(stack: list[Element], tag: str) -> None:
    """Elements that a start tag ends without saying so: paragraphs, items, cells, rows."""
    ends = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"},
            "tr": {"tr", "td", "th"}, "option": {"option"}}.get(tag, set())
    if tag in _CLOSES_P:
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].tag == "p":
                del stack[depth:]
                break
            if stack[depth].tag in _BLOCKS:
                break
    while ends and stack[-1].tag in ends and len(stack) > 1:
        stack.pop()


def _walk(root: Element):
    """Elements, children before parents, without recursion: pages may nest as deep as they like."""
    order, todo = [], [root]
    while todo:
        element = todo.pop()
        order.append(element)
        todo.extend(c for c in element.children if isinstance(c, Element))
    return reversed(order)


def hash_subtrees(root: Element) -> Element:
    """Give every element the hash of its subtree: tag, class, and text or children."""
    for element in _walk(root):
        parts = [element.tag, element.attributes.get("class", "")]
        for child in element.children:
            if isinstance(child, Element):
                parts.append(f"\x00{child.hash:x}")
                element.text |= child.text
            elif text := child.strip():
                parts.append("\x01" + " ".join(text.split()))
                element.text = True
        element.hash = xxh3_64_intdigest("\x02".join(parts).encode("utf-8", "replace")) >> 1
    return root


def _content(root: Element, words: bool = True) -> list[Element]:
    """Elements outside noise, in page order."""
    order, todo = [], [root]
    while todo:
        element = todo.pop()
        order.append(element)
        todo.extend(c for c in reversed(element.children) if isinstance(c, Element) and not c.noise(words))
    return order


def slots(root: Element, articles: list[Element]) -> dict[int, int]:
    """id of element -> key of its slot, for the outermost named elements beside the articles."""
    if not articles:
        return {}
    outer, around = {id(a) for a in articles}, set()
    for element in _walk(root):  # children first
        if any(isinstance(c, Element) and (id(c) in outer or id(c) in around) for c in element.children):
            around.add(id(element))
    found, todo = {}, [(root, "")]
    while todo:
        element, path = todo.pop()
        for child in element.children:
            if not isinstance(child, Element) or id(child) in outer or child.tag in _SILENT:
                continue
            names = [child.attributes.get(a, "") for a in ("class", "id", "role")]
            place = "\x02".join([path, child.tag, *names])
            if id(child) not in around and child.text and (child.tag in _SECTIONS or any(names)):
                found[id(child)] = xxh3_64_intdigest(f"\x03{place}".encode("utf-8", "replace")) >> 1
            else:
                todo.append((child, place))
    return found


def mark_articles(root: Element) -> list[Element]:
    """The outermost articles, else mains, in page order; `inside` is set on all that is in them."""
    content = _content(root)
    found = [e for e in content if e.tag == "article"]
    found = found or [e for e in content if e.tag == "main" or e.attributes.get("role", "").lower() == "main"]
    outermost = []
    for top in found:
        if not top.inside:
            outermost.append(top)
            for element in _content(top):
                element.inside = True
    return outermost


def _own_lines(parent: Element) -> list[Element]:
    """Children that may be templates: they hold text, and no text of the parent is in line with them."""
    inline = sum(
        (c.text and c.tag not in _BLOCKS) if isinstance(c, Element) else bool(c.strip()) for c in parent.children
    )
    return [
        c for c in parent.children if isinstance(c, Element) and c.text and (c.tag in _BLOCKS or inline == 1)
    ]


def main_text(root: Element, templates: set[int] | frozenset[int] = frozenset(), words: bool = True) -> str:
    """Text blocks of the page, without noise and template subtrees."""
    places = slots(root, mark_articles(root)) if templates else {}
    blocks: list[list[str]] = [[]]
    todo: list = [("open", root)]
    while todo:
        what, node = todo.pop()
        if what == "text":
            blocks[-1].append(node)
        elif what == "close":
            blocks.append([])
        else:
            if node is not root and node.noise(words) or places.get(id(node)) in templates:
                continue
            if node.tag == "br":
                blocks[-1].append(" ")
            block = node.tag in _BLOCKS
            if block:
                blocks.append([])
                todo.append(("close", node))
            gone = {id(c) for c in _own_lines(node) if c.key() in templates} if templates else ()
            todo.extend(
                ("open" if isinstance(c, Element) else "text", c) for c in reversed(node.children) if id(c) not in gone
            )
    texts = (_SPACES.sub(" ", markup.unescape("".join(b))).strip() for b in blocks)
    return "\n".join(t for t in texts if t)


def _host(url: str | None) -> str:
    rest = (url or "").partition("://")[2] or (url or "")
    return re.split(r"[/?#]", rest, maxsplit=1)[0].rpartition("@")[2].lower().partition(":")[0]


# What a hash is of: words beside articles, words inside them, a named slot beside them.
_BESIDE, _INSIDE, _SLOT = 0, 1, 2


def page_subtrees(page: str) -> list[tuple[int, int, list[int]]]:
    """(kind, hash of the text that tells pages apart, keys of subtrees) of a page."""
    root = hash_subtrees(parse(page))
    articles = mark_articles(root)
    keys: dict[int, set[int]] = {_BESIDE: set(), _INSIDE: set()}
    for parent in _content(root):
        for element in _own_lines(parent):
            if not element.noise():
                keys[_INSIDE if element.inside else _BESIDE].add(element.key())
    parts = [(_BESIDE, main_text(root))]
    if articles:
        parts.append((_INSIDE, "\n".join(main_text(a) for a in articles)))
        parts.append((_SLOT, parts[0][1]))
        keys[_SLOT] = set(slots(root, articles).values())
    return [(kind, xxh3_64_intdigest(text.encode("utf-8", "replace")) >> 1, list(keys[kind])) for kind, text in parts]


def subtree_counts(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(host, kind, key, n): distinct pages of the host with each subtree.

    The NULL key counts the host's distinct pages: by the text of their articles, or by all their text.
    """

    def run(batches):
        for batch in batches:
            rows = [
                (_host(url), *part)
                for url, page in zip(batch["url"], batch["html"], strict=True)
                for part in page_subtrees(page or "")
            ]
            yield pd.DataFrame(rows, columns=["host", "kind", "page", "keys"])

    plain = pages.select(F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    found = plain.mapInPandas(run, "host STRING, kind INT, page BIGINT, keys ARRAY<BIGINT>")
    with_total = F.concat(F.array(F.lit(None).cast("bigint")), F.col("keys"))
    each = found.select("host", "kind", "page", F.explode(with_total).alias("key")).distinct()
    return each.groupBy("host", "kind", "key").agg(F.count(F.lit(1)).alias("n"))


def site_templates(
    pages: DataFrame, url_col: str = "url", html_col: str = "html", ratio: float = RATIO, min_pages: int = MIN_PAGES,
    inside_ratio: float = INSIDE_RATIO, slot_ratio: float = SLOT_RATIO,
) -> DataFrame:
    """(host, keys): each host's template subtrees; fewer than (elements per page) / ratio of them."""
    counts = settle(
        subtree_counts(pages, url_col, html_col).where((F.col("n") >= min_pages) | F.col("key").isNull()), "subtrees"
    )
    totals = counts.where(F.col("key").isNull()).select("host", "kind", F.col("n").alias("total"))
    least = F.when(F.col("kind") == _BESIDE, ratio).when(F.col("kind") == _INSIDE, inside_ratio).otherwise(slot_ratio)
    return (
        counts.where(F.col("key").isNotNull())
        .join(totals, ["host", "kind"])
        .where(F.col("n") / F.col("total") > least)
        .groupBy("host")
        .agg(F.collect_set("key").alias("keys"))
    )


def extract_text(
    pages: DataFrame, url_col: str = "url", html_col: str = "html", text_col: str = "text",
    ratio: float = RATIO, min_pages: int = MIN_PAGES, words: bool = True,
) -> DataFrame:
    """`pages` with `text_col`: the text of every page without noise and templates, '' where there is none.

    Character references are decoded, white space inside a block is one space, blocks are joined by
    a line feed in page order. NULL html counts as empty; a page without a usable URL belongs to the
    host ''. Repeated pages are one page in the counts and are all extracted. No rows give no rows.
    """
    templates = Settled(site_templates(pages, url_col, html_col, ratio, min_pages), "templates")
    host = F.coalesce(
        F.lower(F.regexp_extract(F.coalesce(F.col(url_col).cast("string"), F.lit("")),
                                 r"^(?:[^/?#]*?://)?(?:[^/?#]*@)?([^/?#:]*)", 1)), F.lit(""))
    rows = pages.select(F.struct("*").alias("row"), host.alias("host"))
    joined = join_by_group(rows, templates, "host", lambda: F.xxhash64("row"))

    @F.pandas_udf("string")
    def text_of(htmls: pd.Series, keys: pd.Series) -> pd.Series:
        return pd.Series(
            [
                main_text(hash_subtrees(parse(h or "")), frozenset(() if k is None else k.tolist()), words)
                for h, k in zip(htmls, keys, strict=True)
            ],
            dtype=object,
        )

    text = text_of(F.col("row").getField(html_col).cast("string"), F.col("keys"))
    kept = [F.col("row").getField(c).alias(c) for c in pages.columns if c != text_col]
    return joined.select(*kept, text.alias(text_col))
