"""The one Python-worker job: element paths that need document structure.

`mapInArrow` over (site, ord, url, html): a page is parsed once with the standard library's
tokenizer and only elements of the wanted kinds are returned, keyed by page and number. Elements
point to their parent while a page is read; ancestor chains are made when rows are written, in
batches bounded by their length. Selector and path texts are plain expressions over the chains.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from pagelens.schemas import DOM_NODE

# Fixed values.
VOID_TAGS = {
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr",
}
CLOSED_BY_SIBLING = {
    "li": {"li"}, "p": {"p", "div", "ul", "ol", "table", "article", "section", "h1", "h2", "h3", "h4", "h5", "h6", "footer", "header", "nav", "aside", "form"},
    "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"},
}
NODE_TAGS = ("title", "meta", "link", "script", "img", "a")

_NODE_TYPE = pa.schema([
    ("site", pa.string()), ("ord", pa.int64()), ("url", pa.string()), ("tag", pa.string()), ("n", pa.int32()),
    ("ancestors", pa.list_(pa.struct([
        ("tag", pa.string()), ("nth", pa.int32()), ("n_same", pa.int32()), ("id", pa.string()), ("class", pa.string()),
    ]))),
])


class _Outline(HTMLParser):
    """Collects the wanted elements; each knows its parent, and sibling totals are known at the end."""

    def __init__(self, wanted: Iterable[str]):
        super().__init__(convert_charrefs=True)
        self.wanted = set(wanted)
        self.stack: list[dict] = [{"tag": "", "kids": {}, "up": None}]
        self.hits: list[tuple[str, int, dict]] = []
        self.seen: dict[str, int] = {}

    def handle_starttag(self, tag, attrs):
        while len(self.stack) > 1 and tag in CLOSED_BY_SIBLING.get(self.stack[-1]["tag"], ()):
            self.stack.pop()
        parent = self.stack[-1]
        nth = parent["kids"][tag] = parent["kids"].get(tag, 0) + 1
        named = dict(reversed(attrs))
        node = {"tag": tag, "nth": nth, "up": parent, "id": named.get("id"), "class": named.get("class"), "kids": {}}
        if tag in self.wanted:
            self.seen[tag] = self.seen.get(tag, 0) + 1
            self.hits.append((tag, self.seen[tag], node))
        if tag not in VOID_TAGS:
            self.stack.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS and self.stack[-1]["tag"] == tag:
            self.stack.pop()

    def handle_endtag(self, tag):
        for depth in range(len(self.stack) - 1, 0, -1):
            if self.stack[depth]["tag"] == tag:
                del self.stack[depth:]
                return


def outline(html: str, wanted: Iterable[str] = NODE_TAGS) -> Iterator[tuple[str, int, list[dict]]]:
    parser = _Outline(wanted)
    parser.feed(html or "")
    parser.close()
    for tag, n, node in parser.hits:
        chain = []
        while node["up"] is not None:
            chain.append({"tag": node["tag"], "nth": node["nth"], "n_same": node["up"]["kids"][node["tag"]], "id": node["id"], "class": node["class"]})
            node = node["up"]
        yield tag, n, chain[::-1]


# Ancestor entries per batch: bounds what a worker holds besides one page.
BATCH_ENTRIES = 50_000


def _map_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[dict] = []
    held = 0
    for batch in batches:
        for i in range(batch.num_rows):
            site, ord_, url, html = (batch.column(c)[i].as_py() for c in range(4))
            for tag, n, ancestors in outline(html):
                rows.append({"site": site, "ord": ord_, "url": url, "tag": tag, "n": n, "ancestors": ancestors})
                held += len(ancestors)
                if held >= BATCH_ENTRIES:
                    yield pa.RecordBatch.from_pylist(rows, schema=_NODE_TYPE)
                    rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=_NODE_TYPE)


CSS_SELECTOR = (
    "array_join(transform(slice(ancestors, greatest(1, id_at), size(ancestors)), a -> "
    "case when coalesce(a.id, '') <> '' then concat(a.tag, '#', a.id) "
    "when a.n_same > 1 then concat(a.tag, ':nth-of-type(', a.nth, ')') else a.tag end), ' > ')"
)
XPATH = "concat('/', array_join(transform(ancestors, a -> if(a.n_same > 1, concat(a.tag, '[', a.nth, ']'), a.tag)), '/'))"
LINK_POSITION = (
    "coalesce(get(filter(transform(reverse(slice(ancestors, 1, greatest(size(ancestors) - 1, 0))), a -> case "
    "when a.tag in ('nav', 'header') then 'navigation' when a.tag = 'footer' then 'footer' when a.tag = 'aside' then 'sidebar' "
    "when a.tag in ('article', 'main', 'section', 'div') then case "
    "when lower(a.class) rlike 'sidebar|side-bar|widget' then 'sidebar' "
    "when lower(a.class) rlike 'nav|menu|header' then 'navigation' "
    "when lower(a.class) rlike 'footer|bottom' then 'footer' end end), p -> p is not null), 0), 'content')"
)


def dom_nodes(crawl: DataFrame) -> DataFrame:
    """One row per title, meta, link, script, img and a element with its paths and position."""
    schema = "site string, ord bigint, url string, tag string, n int, " + DOM_NODE[DOM_NODE.index("ancestors"):].strip()
    pages = crawl.selectExpr("site", "ord", "coalesce(nullif(final_url, ''), url) as url", "html")
    nodes = pages.mapInArrow(_map_nodes, schema)
    # Position of the last ancestor with an id: the selector starts there.
    id_at = "array_max(concat(array(0), transform(ancestors, (a, i) -> if(coalesce(a.id, '') <> '', i + 1, 0))))"
    return nodes.selectExpr("*", f"{id_at} as id_at").selectExpr(
        "site", "ord", "url", "tag", "n", f"{CSS_SELECTOR} as css_selector", f"{XPATH} as xpath", f"{LINK_POSITION} as link_position", "ancestors"
    )


def issue_locators(issues: DataFrame, nodes: DataFrame) -> DataFrame:
    """Findings with the selector and path of the element they are about."""
    at = nodes.selectExpr("site", "ord", "tag as loc_tag", "n as loc_n", "css_selector", "xpath")
    located = ["Title Too Short", "Title Too Long", "Meta Description Too Short", "Meta Description Too Long",
               "Canonical Mismatch", "Invalid JSON-LD", "Missing Alt Text"]
    wanted = issues.where(issues.issue_type.isin(located))
    rest = issues.where(~issues.issue_type.isin(located)).selectExpr("*", "cast(null as string) as css_selector", "cast(null as string) as xpath")
    joined = wanted.join(at, ["site", "ord", "loc_tag", "loc_n"], "left").select(*issues.columns, "css_selector", "xpath")
    return joined.unionByName(rest)


def link_positions(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """The edge list with the position of each link on its page; null where the parser met no such element."""
    at = nodes.where("tag = 'a'").select("site", "ord", "n", "link_position")
    return links.join(at, ["site", "ord", "n"], "left")
