"""Fields of HTML pages, by the standard library's parser in Arrow batches: one pass gives all of them."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from html.entities import html5
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "title string, text string, person string, tables string, links array<struct<text:string,url:string>>, pdfs array<string>"
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
# Which open elements a start tag ends, looked for from the innermost outwards up to a boundary.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CELLS = frozenset("table td th caption".split())
BLOCKS = frozenset("address article aside blockquote details div dl fieldset figure footer form header hr main menu nav ol p pre section table ul".split()) | HEADINGS
ENDED_BY = {
    "li": (frozenset(("li",)), CELLS | {"ul", "ol", "menu"}),
    "dt": (frozenset(("dt", "dd")), CELLS | {"dl"}),
    "dd": (frozenset(("dt", "dd")), CELLS | {"dl"}),
    "tr": (frozenset(("tr", "caption")), frozenset(("table",))),
    "td": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "th": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "thead": (frozenset(("thead", "tbody", "tfoot", "caption")), frozenset(("table",))),
    "tbody": (frozenset(("thead", "tbody", "tfoot", "caption")), frozenset(("table",))),
    "tfoot": (frozenset(("thead", "tbody", "tfoot", "caption")), frozenset(("table",))),
    "option": (frozenset(("option",)), frozenset(("select", "optgroup"))),
    "optgroup": (frozenset(("optgroup", "option")), frozenset(("select",))),
    "a": (frozenset(("a",)), CELLS),
    "body": (frozenset(("head",)), frozenset()),
} | {b: (frozenset(("p",)), CELLS | {"button"}) for b in BLOCKS}
#: Start tags that end a heading left open; a div may stand in one.
AFTER_HEADINGS = HEADINGS | frozenset("p ul ol dl li table hr pre blockquote main article section footer nav form".split())
#: Ampersands with what may be their reference; scripts, styles and comments, where none is read, go by whole.
REFERENCE = re.compile(r"<(script|style)(?=[\s/>])(?:.*?</\1(?=[\s/>])|.*)|<!--(?:.*?-->|.*)|&(#[0-9]+;|#x[0-9a-f]+;|[a-z][a-z0-9]*;)?", re.I | re.S)


@dataclass(frozen=True)
class HtmlParams:
    main_id: str = "mainContent"
    noise_tags: frozenset[str] = frozenset(("script", "style", "noscript", "svg"))
    noise_classes: frozenset[str] = frozenset()
    noise_tag_classes: frozenset[tuple[str, str]] = frozenset((("button", "kontrol"),))
    # Headings that say nothing.
    generic_titles: frozenset[str] = frozenset(("duyuru detay", "haber detay", "anasayfa", "detay", ""))
    # Whether references without a semicolon are read, as browsers do; otherwise they stay as they are written.
    bare_references: bool = True


@dataclass
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)

    def walk(self):
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(c for c in reversed(n.children) if isinstance(c, Node))

    def strings(self, skip=lambda n: False):
        stack: list = [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                yield n
            elif not skip(n):
                stack.extend(reversed(n.children))

    def text(self, sep: str = " ") -> str:
        return sep.join(s.strip() for s in self.strings() if s.strip())


class _Tree(HTMLParser):
    """Nodes with the ends that HTML implies: of paragraphs, headings, list items, cells, rows, options and anchors. A
    tag is looked for among the open ones only if one is open, so that deep nests cost no more than their tags."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("")
        self.open = [self.root]
        self.count: Counter = Counter()

    def cut(self, i: int) -> None:
        self.count.subtract(n.tag for n in self.open[i:])
        del self.open[i:]

    def end(self, tags: frozenset[str], bounds: frozenset[str]) -> None:
        """Closes the innermost open element of tags, with all in it, unless a boundary stands between."""
        if not any(self.count[t] for t in tags):
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                return self.cut(i)
            if self.open[i].tag in bounds:
                return

    def handle_starttag(self, tag, attrs):
        if tag in ENDED_BY:
            self.end(*ENDED_BY[tag])
        if tag in AFTER_HEADINGS:
            self.end(HEADINGS, CELLS | {"div", "button"})
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)
            self.count[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        # Any heading's end ends a heading; what stands in a cell ends nothing outside it.
        structure = tag in CELLS or tag in ("tr", "thead", "tbody", "tfoot", "body", "html")
        self.end(HEADINGS if tag in HEADINGS else frozenset((tag,)), frozenset() if structure else CELLS)

    def handle_data(self, data):
        self.open[-1].children.append(data)


def _table(table: Node) -> str:
    rows = []
    for tr in (n for n in table.walk() if n.tag == "tr"):
        cells = [c for n in tr.walk() if n.tag in ("td", "th") and (c := n.text())]
        if cells:
            rows.append(" | ".join(cells))
    return "\n".join(rows)


def closed_references(html: str) -> str:
    """html with ampersands escaped that begin no number or known name closed by a semicolon."""

    def told(m: re.Match) -> str:
        if m[0][0] == "<" or m[2] and (m[2][0] == "#" or m[2] in html5):
            return m[0]
        return f"&amp;{m[2] or ''}"

    return REFERENCE.sub(told, html)


def fields_of(html: str, base: str, p: HtmlParams) -> tuple:
    """The fields of one page, in the order of SCHEMA."""
    tree = _Tree()
    tree.feed(html if p.bare_references else closed_references(html))
    tree.close()
    nodes = list(tree.root.walk())
    first = lambda ok, among=nodes: next((n for n in among if ok(n)), None)
    main = first(lambda n: n.tag == "main" and n.attrs.get("id") == p.main_id) or first(lambda n: n.tag == "body") or tree.root
    inside = list(main.walk())

    links = []
    for a in inside:
        href = a.attrs.get("href", "").strip() if a.tag == "a" else ""
        if href and not href.startswith(("#", "javascript:", "mailto:", "tel:")):
            links.append({"text": a.text(), "url": _join(base, href)})
    pdfs = [u for n in nodes if n.tag == "iframe" and n.attrs.get("src") and ".pdf" in (u := _join(base, n.attrs["src"])).lower()]

    title = next((t for tag in ("h1", "h2", "h3") for n in inside if n.tag == tag and (t := n.text("")) and t.lower() not in p.generic_titles), None)
    if title is None:
        named = first(lambda n: n.tag == "title")
        title = named.text("") if named else ""
    person = first(lambda n: n.tag == "h6", inside)
    tables = "\n".join(t for n in nodes if n.tag == "table" and (t := _table(n)))

    def noise(n: Node) -> bool:
        classes = n.attrs.get("class", "").split()
        return n.tag in p.noise_tags or any(c in p.noise_classes or (n.tag, c) in p.noise_tag_classes for c in classes)

    parts: list[str] = []
    stack: list = [main]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            parts.append(n)
        elif n.tag == "table" and not noise(n):
            parts.append(_table(n))
        elif not noise(n):
            stack.extend(reversed(n.children))
    text = "\n".join(s for x in parts for line in x.split("\n") if (s := line.strip()))
    return title, text, person.text() if person else "", tables, links, pdfs


def _join(base: str, href: str) -> str:
    try:
        return urljoin(base, href)
    except ValueError:
        return href


def extract(df: DataFrame, html: str = "html", url: str = "url", p: HtmlParams = HtmlParams(), out: str = "page") -> DataFrame:
    """df with a struct of title, main text (tables as bar-separated lines), person name, tables, links and embedded
    PDFs. Links and headings are read before noise is cut. Null or empty HTML gives empty fields; a null URL leaves
    links relative. Tags that are not closed end where HTML implies it, or with their parent."""
    @F.pandas_udf(SCHEMA)
    def run(h: pd.Series, u: pd.Series) -> pd.DataFrame:
        rows = [fields_of(x or "", b or "", p) for x, b in zip(h, u, strict=True)]
        return pd.DataFrame(rows, columns=["title", "text", "person", "tables", "links", "pdfs"])

    return df.withColumn(out, run(F.col(html), F.col(url)))


def links(extracted: DataFrame, page: str = "page") -> DataFrame:
    """One row for each link: the columns of extracted but the struct, then place, text and url of the link."""
    rest = [c for c in extracted.columns if c != page]
    return extracted.select(*rest, F.posexplode(f"{page}.links").alias("place", "link")).select(*rest, "place", F.col("link.text").alias("link_text"), F.col("link.url").alias("link_url"))


def program_ids(html: Column) -> Column:
    """Distinct course programme ids in script calls, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r"derslistegetir\((\d+)\)"), F.lit(1)))


#: The token of a person's page, by which its tabs are asked for.
TOKEN = r"Sayfa_Getir\('[^']+','([^']+)'\)"


def person_token(html: Column) -> Column:
    """The token of a person's tabs, null where there is none."""
    return F.nullif(F.regexp_extract(html, TOKEN, 1), F.lit(""))


def person_text(tabs: DataFrame, key: str = "url") -> DataFrame:
    """(key, text) of tabs(key, tab_no, label, body): the filled tabs of a person under their labels, in order."""
    filled = tabs.filter(F.trim(F.coalesce("body", F.lit(""))) != "").select(key, F.struct("tab_no", F.concat_ws("\n", "label", F.trim("body")).alias("t")).alias("tab"))
    ordered = F.array_sort(F.collect_list("tab"))
    return filled.groupBy(key).agg(F.array_join(F.transform(ordered, lambda t: t["t"]), "\n\n").alias("text"))
