"""HTML operators: a small tree, the selectors that site profiles need, paragraphs and links."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements without an end tag.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}


@dataclass
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list[Node | str] = field(default_factory=list)
    parent: Node | None = None

    def walk(self) -> Iterator[Node]:
        """The elements below, in document order."""
        open_ = [c for c in reversed(self.children) if isinstance(c, Node)]
        while open_:
            node = open_.pop()
            yield node
            open_ += [c for c in reversed(node.children) if isinstance(c, Node)]

    def texts(self) -> Iterator[str]:
        open_: list[Node | str] = [self]
        while open_:
            node = open_.pop()
            if isinstance(node, str):
                yield node
            elif node.tag not in ("script", "style"):
                open_ += reversed(node.children)

    def text(self, strip: bool = True) -> str:
        """The texts below, joined by a blank; strip: each without white space around, blank ones left out."""
        parts = list(self.texts())
        return " ".join(p for p in map(str.strip, parts) if p) if strip else " ".join(parts)

    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def drop(self) -> None:
        if self.parent is not None:
            self.parent.children = [c for c in self.parent.children if c is not self]


class Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("")
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "p" and self.open[-1].tag == "p":
            self.open.pop()
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)}, parent=self.open[-1])
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1].tag == tag:
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def parse(html: str | None) -> Node:
    tree = Tree()
    tree.feed(html or "")
    tree.close()
    return tree.root


ONE = re.compile(r"([\w-]+|\*)|\.([\w-]+)|#([\w-]+)|\[([\w-]+)(?:([*^$~]?=)\"?([^\"\]]*)\"?)?\]|:not\(([^)]*)\)")


def simple(selector: str) -> Callable[[Node], bool]:
    """One compound selector: tag, .class, #id, [name], [name="value"], [name*="part"], :not(...)."""
    tests: list[Callable[[Node], bool]] = []
    for tag, cls, id_, name, op, value, other in ONE.findall(selector):
        if tag and tag != "*":
            tests.append(lambda n, t=tag: n.tag == t)
        elif cls:
            tests.append(lambda n, c=cls: c in n.classes())
        elif id_:
            tests.append(lambda n, i=id_: n.attrs.get("id") == i)
        elif name:
            how = {
                "": lambda a, v: True, "=": lambda a, v: a == v, "*=": lambda a, v: v in a,
                "^=": lambda a, v: a.startswith(v), "$=": lambda a, v: a.endswith(v), "~=": lambda a, v: v in a.split(),
            }[op]
            tests.append(lambda n, k=name, v=value, h=how: k in n.attrs and h(n.attrs[k], v))
        elif other:
            inner = simple(other)
            tests.append(lambda n, f=inner: not f(n))
    return lambda n: all(t(n) for t in tests)


def select(root: Node, selectors: str) -> list[Node]:
    """Elements below root that one of the comma-separated selectors fits, in document order; blanks are descent."""
    chains = [[simple(part) for part in one.split()] for one in selectors.split(",") if one.strip()]

    def fits(node: Node, chain: list[Callable[[Node], bool]]) -> bool:
        if not chain[-1](node):
            return False
        rest, up = list(chain[:-1]), node.parent
        while rest and up is not None and up is not root.parent:
            if rest[-1](up):
                rest.pop()
            up = up.parent
        return not rest

    return [n for n in root.walk() if any(fits(n, c) for c in chains)]


@dataclass(frozen=True)
class Site:
    """What a site's articles and lists look like."""

    host: str
    base: str
    body: str
    trash: str
    paragraphs: str
    direct: bool
    least: int
    links: str
    banned: tuple[str, ...] = ()
    ending: str = ""
    head: tuple[str, ...] = ()
    strip: bool = True
    skip_author: bool = False


#: Selectors and limits of the known sites; `plain` is for pages of any make.
SITES = {
    "vnexpress": Site(
        "vnexpress.net", "https://vnexpress.net", "article.fck_detail",
        "figcaption, .fig_caption, .tplCaption, .box-tin-lien-quan, .list-news, table, .compound-box", "p, div", True, 50,
        "h1.title-news a, h2.title-news a, h3.title-news a, h4.title-news a, div.thumb-art a",
        ("/video/", "/podcast/", "/interactive/", "/infographics/"),
    ),
    "dantri": Site(
        "dantri.com.vn", "https://dantri.com.vn",
        'div[data-slot="content"], div.singular-content, div.e-magazine__body, div.dt-news__content',
        'figure, figcaption, .video, table, .related-news, .dantri-widget, .ad-container, [data-slot="ads-in-content"]', "p", False, 40,
        "h3.article-title a, h2.article-title a, div.article-thumb a", ("/video/", "/emagazine/", "/infographic/", "/podcast/"),
        head=('h1[data-slot="title"], h1.title-page', 'h2[data-slot="sapo"], h2.singular-sapo'), strip=False, skip_author=True,
    ),
    "thanhnien": Site(
        "thanhnien.vn", "https://thanhnien.vn", "div.detail-cmain, div.detail-content",
        "figcaption, .image-caption, .quote, .relate-container, table, .video-wrap", "p", False, 40,
        "h2 a, h3 a, h4 a, .box-title-text, .box-category-link-title", ("/video/", "/podcast/", "/infographic/", "/interactive/"), ending=".htm",
    ),
    "forum": Site("voz.vn", "https://voz.vn", ".bbWrapper", "blockquote", "", False, 25, '.structItem--thread:not(.structItem--sticky) .structItem-title a[href*="/t/"]'),
    "plain": Site("", "", "article", "figure, figcaption, table, blockquote", "p", False, 40, "a"),
}
MORE, INVITE, SPACES = re.compile(r">>\s*Xem thêm:.*$", re.I), re.compile(r"Mời các bạn tham gia.*$", re.I), re.compile(r"\s+")


def normal(text: str, site: Site) -> str:
    text = MORE.sub("", text)
    if site.host == SITES["thanhnien"].host:
        text = INVITE.sub("", text)
    text = SPACES.sub(" ", text)
    return text if site.strip else text.strip()


def right_aligned(node: Node) -> bool:
    return "text-align:right" in node.attrs.get("style", "").replace(" ", "")


def paragraphs_of(html: str | None, site: Site) -> list[str]:
    """An article's or a thread's texts in order, each longer than the site's least length."""
    root = parse(html)
    found: list[str] = []
    if not site.paragraphs:  # every block is one text
        for block in select(root, site.body):
            for node in select(block, site.trash):
                node.drop()
            found.append(block.text())
        return [t for t in found if len(t) > site.least]
    for selectors in site.head:
        found += [normal(n.text(site.strip), site) for n in select(root, selectors)[:1]]
    for body in select(root, site.body)[:1]:
        for node in select(body, site.trash):
            node.drop()
        own = [n for n in select(body, site.paragraphs) if not site.direct or n.parent is body]
        for node in own:
            if not right_aligned(node) and not (site.skip_author and "author" in str(node.classes())):
                found.append(normal(node.text(site.strip), site))
    found = [t for t in found if len(t) > site.least]
    return list(dict.fromkeys(found)) if site.skip_author else found


def links_of(html: str | None, site: Site) -> list[str]:
    """Links of a list page in order, each once, without query and fragment, of the site and none of its banned kinds."""
    found = []
    for node in select(parse(html), site.links):
        href = node.attrs.get("href")
        if not href:
            continue
        url = urljoin(site.base, href) if site.base else href
        if site.ending and not url.endswith(site.ending):
            continue
        url = url.split("?")[0].split("#")[0]
        if site.host in url and not any(b in url for b in site.banned):
            found.append(url.split("unread")[0].rstrip("/") if site.host == SITES["forum"].host else url)
    return list(dict.fromkeys(found))


def paragraphs(pages: DataFrame, site: str, id: str = "page_id", html: str = "html") -> DataFrame:
    """(id, idx from 1, text): a row per paragraph. Null pages have none."""
    own = SITES[site]

    @F.pandas_udf("array<string>")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: paragraphs_of(v, own))

    return pages.select(F.col(id), F.posexplode(run(F.col(html))).alias("idx", "text")).withColumn("idx", F.col("idx") + 1)


def links(pages: DataFrame, site: str, id: str = "page_id", html: str = "html") -> DataFrame:
    """(id, idx from 1, link): a row per link."""
    own = SITES[site]

    @F.pandas_udf("array<string>")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: links_of(v, own))

    return pages.select(F.col(id), F.posexplode(run(F.col(html))).alias("idx", "link")).withColumn("idx", F.col("idx") + 1)


def hrefs(html: Column) -> Column:
    """All `a href` values as they stand in simple pages, each once, without a parser."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r'(?i)<a\s[^>]*?href="([^"]*)"'), F.lit(1)))


def is_bot_wall(html: Column) -> Column:
    from corpuscle.functions.rules import BOT_WALL

    return html.contains(BOT_WALL[0]) | html.contains(BOT_WALL[1])


def page_url(pattern: str, base: Column, page: Column) -> Column:
    """List pages: pattern `-p{n}`, `/trang-{n}.htm`, `/page-{n}?prefix_id={p}`; the first page is the base itself."""
    before, _, after = pattern.partition("{n}")
    return F.when(page <= 1, base).otherwise(F.concat(base, F.lit(before), page.cast("string"), F.lit(after)))
