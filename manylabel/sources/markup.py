"""Fields and links of HTML pages by selectors on their nesting.

A page is read once into flat lists: the tag, attributes and parent of each element, its place
among its parent's children of that tag, and the range of the page's text inside it. All rules are
matched on these lists, so a field ends where its own element ends, however deep others of
the same tag are nested in it. Void elements hold nothing, an end tag closes everything opened since
its start tag, one that closes nothing is skipped, and what stays open ends with the page.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: A start tag of these ends the open element of the same name that it stands in.
NO_NESTING = frozenset("dd dt li option p td th tr".split())
#: Their content is no markup, and no text of the page.
RAW = re.compile(r"(?i)</(script|style)\b[^>]*>")
MARK = re.compile(
    r"<!--(?s:.*?)(?:-->|\Z)|<[!?][^>]*>"
    r"|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+|[^>]*)>"
)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
SOLID = re.compile(r"\S")


@dataclass(frozen=True)
class Step:
    """An element: its tag, attributes (null: any value), text, children it must have, and its
    number among its parent's children of that tag (from 1)."""

    tag: str
    attributes: tuple[tuple[str, str | None], ...] = ()
    text: str | None = None
    having: tuple[Step, ...] = ()
    number: int | None = None


@dataclass(frozen=True)
class Selector:
    """Elements reached from anywhere over child steps; their text, or one attribute of theirs."""

    steps: tuple[Step, ...]
    attribute: str | None = None


def _valued(label: str, *steps: Step) -> Selector:
    """The value next to a ``div`` that names it."""
    path = steps or (Step("span"),)
    return Selector((Step("div", having=(Step("div", text=label),)), Step("span"), Step("div"), *path))


def _stars(stars: int) -> Selector:
    return Selector(
        (Step("div", having=(Step("span", text=str(stars)),)), Step("span", (("title", None),))), "title"
    )


# Fields of an app page.
APP_PAGE: dict[str, Selector] = {
    "Category": Selector((Step("a", (("itemprop", "genre"),)),)),
    "Name": Selector((Step("h1", (("itemprop", "name"),)), Step("span"))),
    "Price": Selector((Step("button", (("aria-label", None),), having=(Step("span", having=(Step("span"),)),)),)),
    "Updated": _valued("Updated"),
    "Size": _valued("Size"),
    "Installs": _valued("Installs"),
    "Requires_Android": _valued("Requires Android"),
    "Age": _valued("Content Rating", Step("span"), Step("div")),
    "Inapp_Products": _valued("In-app Products"),
    "Developer": _valued("Offered By"),
    "Description": Selector((Step("content"), Step("div", (("jsname", "sngebd"),)))),
    "Rating": Selector((Step("div", (("class", "BHMmbe"),)),)),
    "Rating_Total": Selector((Step("span", (("aria-label", None),)),)),
    "Content_Feature": _valued("Content Rating", Step("span"), Step("div", number=2)),
    "Version": _valued("Current Version"),
    **{f"Rating_{n}": _stars(n) for n in (5, 4, 3, 2, 1)},
}
#: Ids of the similar apps that a page shows.
SIMILAR = Selector((Step("span", (("class", "preview-overlay-container"),)),), "data-docid")


class Page:
    """The elements of a page in document order."""

    def __init__(self, html: str):
        self.tags: list[str] = []
        self.marks: list[str] = []
        self.parents: list[int] = []
        self.numbers: list[int] = []
        self.begins: list[int] = []
        self.ends: list[int] = []
        self.children: dict[int, list[int]] = {}
        self.by_tag: dict[str, list[int]] = {}
        self._read: dict[int, dict[str, str]] = {}
        texts, size, at = [], 0, 0
        open_, counts, depth = [-1], [{}], {}

        def close() -> None:
            element = open_.pop()
            counts.pop()
            self.ends[element] = size
            depth[self.tags[element]] -= 1

        while True:
            mark = MARK.search(html, at)
            piece = unescape(html[at : mark.start() if mark else len(html)])
            texts.append(piece)
            size += len(piece)
            if not mark:
                break
            at = mark.end()
            if mark["tag"] is None:
                continue
            tag = mark["tag"].lower()
            if mark["end"]:
                if depth.get(tag):
                    while self.tags[open_[-1]] != tag:
                        close()
                    close()
                continue
            if tag in NO_NESTING and len(open_) > 1 and self.tags[open_[-1]] == tag:
                close()
            element, parent = len(self.tags), open_[-1]
            number = counts[-1][tag] = counts[-1].get(tag, 0) + 1
            self.tags.append(tag)
            self.marks.append(mark["rest"])
            self.parents.append(parent)
            self.numbers.append(number)
            self.begins.append(size)
            self.ends.append(size)
            self.children.setdefault(parent, []).append(element)
            self.by_tag.setdefault(tag, []).append(element)
            if tag in ("script", "style"):
                over = RAW.search(html, at)
                at = over.end() if over else len(html)
            elif tag not in VOID and not mark["rest"].endswith("/"):
                open_.append(element)
                counts.append({})
                depth[tag] = depth.get(tag, 0) + 1
        while len(open_) > 1:
            close()
        self.text = "".join(texts)

    def attributes(self, element: int) -> dict[str, str]:
        found = self._read.get(element)
        if found is None:
            found = self._read[element] = {}
            for name, *values in ATTRIBUTE.findall(self.marks[element]):
                found.setdefault(name.lower(), unescape("".join(values)))
        return found

    def says(self, element: int, text: str) -> bool:
        """Whether the element's text is ``text``, blanks around it aside."""
        end = self.ends[element]
        first = SOLID.search(self.text, self.begins[element], end)
        if first is None or not text:
            return first is None and not text
        last = first.start() + len(text)
        return last <= end and self.text.startswith(text, first.start()) and SOLID.search(self.text, last, end) is None

    def fits(self, element: int, step: Step) -> bool:
        if self.tags[element] != step.tag or step.number not in (None, self.numbers[element]):
            return False
        if step.attributes:
            own = self.attributes(element)
            if any(n not in own or v not in (None, own[n]) for n, v in step.attributes):
                return False
        if step.text is not None and not self.says(element, step.text):
            return False
        return all(any(self.fits(c, s) for c in self.children.get(element, ())) for s in step.having)

    def found(self, selector: Selector):
        """Values of the elements that fit, in document order."""
        for last in self.by_tag.get(selector.steps[-1].tag, ()):
            element = last
            for step in reversed(selector.steps):
                if element < 0 or not self.fits(element, step):
                    break
                element = self.parents[element]
            else:
                if selector.attribute is None:
                    yield self.text[self.begins[last] : self.ends[last]].strip()
                elif selector.attribute in self.attributes(last):
                    yield self.attributes(last)[selector.attribute]


def page_fields(html: Column, rules: Mapping[str, Selector] = APP_PAGE) -> Column:
    """Map of the rules that a page matches to the value of the first element of each.

    A null page gives null; a page without markup gives an empty map.
    """
    rules = dict(rules)

    @F.arrow_udf("map<string,string>")
    def fields(pages: pa.Array) -> pa.Array:
        out = []
        for html in pages.to_pylist():
            page = None if html is None else Page(html)
            values = None if page is None else [(k, next(page.found(r), None)) for k, r in rules.items()]
            out.append(values and [(k, v) for k, v in values if v is not None])
        return pa.array(out, pa.map_(pa.string(), pa.string()))

    return fields(html)


def parse_fields(pages: DataFrame, rules: Mapping[str, Selector] = APP_PAGE, html: str = "html") -> DataFrame:
    """``pages`` with the map column ``fields``; other columns never leave the JVM."""
    return pages.withColumn("fields", page_fields(F.col(html), rules))


def parse_links(pages: DataFrame, key: str = "page_id", html: str = "html", selector: Selector = SIMILAR) -> DataFrame:
    """``(src, dst)`` of the distinct values that ``selector`` finds on each page."""

    @F.arrow_udf("array<string>")
    def links(pages: pa.Array) -> pa.Array:
        found = (None if x is None else list(dict.fromkeys(Page(x).found(selector))) for x in pages.to_pylist())
        return pa.array(found, pa.list_(pa.string()))

    return pages.select(F.col(key).alias("src"), F.explode(links(F.col(html))).alias("dst"))
