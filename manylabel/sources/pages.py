"""Declarative field and link extraction from HTML pages, with built-in expressions only."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}


@dataclass(frozen=True)
class Rule:
    """A pattern whose first group is the field; text rules drop inner tags."""

    pattern: str
    is_text: bool = True


def tag_text(tag: str, **attributes: str) -> Rule:
    """Text of the first ``tag`` holding all the attribute values."""
    tests = "".join(
        rf"(?=[^>]*\b{name}\s*=\s*[\"']{re.escape(value)}[\"'])"
        for name, value in attributes.items()
    )
    return Rule(rf"(?is)<{tag}\b{tests}[^>]*>(.*?)</{tag}\s*>")


def tag_attribute(tag: str, attribute: str) -> Rule:
    return Rule(rf"(?is)<{tag}\b[^>]*\b{attribute}\s*=\s*[\"']([^\"']*)[\"']", is_text=False)


def labelled(label: str, inner: str = "") -> Rule:
    """Value in the span/div/span that follows a ``div`` holding exactly ``label``."""
    opened = r"\s*<span[^>]*>\s*<div[^>]*>\s*<span[^>]*>"
    return Rule(rf"(?is)<div[^>]*>\s*{re.escape(label)}\s*</div>{opened}{inner}(.*?)</")


def starred(stars: int) -> Rule:
    """``title`` of the span next to the span that names the number of stars."""
    return Rule(
        rf"(?is)<span[^>]*>\s*{stars}\s*</span>(?:\s*<span\b(?![^>]*\btitle)[^>]*>.*?</span>)*?"
        r"\s*<span\b[^>]*\btitle\s*=\s*[\"']([^\"']*)[\"']",
        is_text=False,
    )


# Fields of an app page.
APP_PAGE_RULES: dict[str, Rule] = {
    "Category": tag_text("a", itemprop="genre"),
    "Name": Rule(r"(?is)<h1\b[^>]*\bitemprop\s*=\s*[\"']name[\"'][^>]*>\s*<span[^>]*>(.*?)</span>"),
    "Price": Rule(
        r"(?is)<button\b(?=[^>]*\baria-label)[^>]*>"
        r"(\s*<span[^>]*>\s*<span[^>]*>.*?)</button>"
    ),
    "Updated": labelled("Updated"),
    "Size": labelled("Size"),
    "Installs": labelled("Installs"),
    "Requires_Android": labelled("Requires Android"),
    "Age": labelled("Content Rating", r"\s*<div[^>]*>"),
    "Inapp_Products": labelled("In-app Products"),
    "Developer": labelled("Offered By"),
    "Description": tag_text("div", jsname="sngebd"),
    "Rating": tag_text("div", **{"class": "BHMmbe"}),
    "Rating_Total": Rule(r"(?is)<span\b(?=[^>]*\baria-label)[^>]*>(.*?)</span>"),
    "Content_Feature": labelled("Content Rating", r"\s*<div[^>]*>[^<]*</div>\s*<div[^>]*>"),
    "Version": labelled("Current Version"),
    "Rating_5": starred(5),
    "Rating_4": starred(4),
    "Rating_3": starred(3),
    "Rating_2": starred(2),
    "Rating_1": starred(1),
}
PREVIEW_LINKS = (
    r"(?is)<span\b(?=[^>]*\bclass\s*=\s*[\"']preview-overlay-container[\"'])"
    r"[^>]*\bdata-docid\s*=\s*[\"']([^\"']+)[\"']"
)
HREF_LINKS = r"(?i)href=\"([^\"]+)\""

# Fields of a general web page.
WEB_PAGE_RULES: dict[str, Rule] = {
    "lang": tag_attribute("html", "lang"),
    "title": tag_text("title"),
    "h1": tag_text("h1"),
    "article": tag_text("article"),
}


def inner_text(c: Column) -> Column:
    """Drop tags, decode the common entities, trim."""
    plain = F.regexp_replace(c, r"<[^>]*>", "")
    for entity, char in ENTITIES.items():
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    return F.regexp_replace(plain, r"^\s+|\s+$", "")


def extract_field(html: Column, rule: Rule) -> Column:
    """Value of one rule; null when the page does not match."""
    value = F.regexp_extract(html, rule.pattern, 1)
    shown = inner_text(value) if rule.is_text else value
    return F.when(F.regexp_like(html, F.lit(rule.pattern)), shown)


def extract_fields(
    pages: DataFrame, rules: Mapping[str, Rule] = APP_PAGE_RULES, html: str = "html"
) -> DataFrame:
    """Add map column ``fields`` holding the rules that matched."""
    entries = F.array(*[
        F.struct(F.lit(name).alias("key"), extract_field(F.col(html), rule).alias("value"))
        for name, rule in rules.items()
    ])
    found = F.filter(entries, lambda e: e["value"].isNotNull())
    return pages.withColumn("fields", F.map_from_entries(found))


def extract_links(
    pages: DataFrame, key: str = "page_id", html: str = "html", pattern: str = HREF_LINKS
) -> DataFrame:
    """``(src, dst)`` of the distinct links of each page."""
    links = F.array_distinct(F.regexp_extract_all(F.col(html), F.lit(pattern), F.lit(1)))
    return pages.select(F.col(key).alias("src"), F.explode(links).alias("dst"))
