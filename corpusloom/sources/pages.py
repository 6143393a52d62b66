"""Collection pages: link items and next pages from a table of (url, html). Parsing runs in Arrow batches; URL rules are Columns."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class _Anchors(HTMLParser):
    """(href, title by the fallback chain, classes) of each anchor."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[dict] = []
        self.open: dict | None = None

    def handle_starttag(self, tag, attrs):
        own = dict(attrs)
        if tag == "a":
            self._close()
            self.open = {"href": own.get("href") or "", "text": [], "title": own.get("title") or "", "label": own.get("aria-label") or "", "alt": "", "classes": (own.get("class") or "").split(), "rel": own.get("rel") or ""}
        elif tag == "img" and self.open is not None and not self.open["alt"]:
            self.open["alt"] = own.get("alt") or ""

    def handle_endtag(self, tag):
        if tag == "a":
            self._close()

    def handle_data(self, data):
        if self.open is not None:
            self.open["text"].append(data)

    def _close(self):
        if self.open is not None:
            self.found.append(self.open)
            self.open = None

    def close(self):
        super().close()
        self._close()


def anchors(page: str) -> list[dict]:
    parser = _Anchors()
    parser.feed(page or "")
    parser.close()
    for a in parser.found:
        a["name"] = next((t for t in (re.sub(r"\s+", " ", x).strip() for x in ("".join(a["text"]), a["title"], a["label"], a["alt"])) if t), "")
    return parser.found


def page_number(url: Column) -> Column:
    """N of /page/N or ?page=N, else null."""
    return F.coalesce(F.nullif(F.regexp_extract(url, r"/page/(\d+)", 1), F.lit("")), F.nullif(F.regexp_extract(url, r"[?&]page=(\d+)", 1), F.lit(""))).cast("int")


def allowed_domain(url: Column, domains: Sequence[str]) -> Column:
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("HOST"))).isin(list(domains)), F.lit(False))


def matches_any(text: Column, patterns: Sequence[str]) -> Column:
    """Any pattern, ignoring case."""
    return F.coalesce(text.rlike("(?iu)" + "|".join(f"(?:{p})" for p in patterns)), F.lit(False)) if patterns else F.lit(False)


def detail_url(url: Column, domains: Sequence[str], detail: Sequence[str] = (), exclude: Sequence[str] = (), listing: Sequence[str] = ()) -> Column:
    """Allowed, neither excluded nor a list, and a detail page by pattern where patterns are given."""
    return allowed_domain(url, domains) & ~matches_any(url, exclude) & ~matches_any(url, listing) & (matches_any(url, detail) if detail else F.lit(True))


def items(pages: DataFrame, classes: Sequence[str] = (), stop_words: Sequence[str] = ("home", "login", "next", "previous", "contact")) -> DataFrame:
    """page_url, url, title, position: anchors with one of the classes and a title of 2 characters or more; a page where that
    gives none falls back to all anchors with a title of 6 or more and no stop word. One row per url of a page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = []
            for url, page in zip(frame["url"], frame["html"], strict=True):
                links = [a for a in anchors(page) if a["href"]]
                chosen = [a for a in links if set(a["classes"]) & set(classes) and len(a["name"]) >= 2] if classes else []
                chosen = chosen or [a for a in links if len(a["name"]) >= 6 and a["name"].lower() not in stop_words]
                seen: set[str] = set()
                for a in chosen:
                    full = urljoin(url or "", a["href"])
                    if full not in seen:
                        seen.add(full)
                        rows.append((url, full, a["name"], len(seen)))
            yield pd.DataFrame(rows, columns=["page_url", "url", "title", "position"])

    return pages.select("url", "html").mapInPandas(run, "page_url string, url string, title string, position int")


def next_pages(pages: DataFrame) -> DataFrame:
    """page_url, next_url: of the links with a page number, the smallest above the page's own, else the first rel=next."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = [(u, urljoin(u or "", a["href"]), a["rel"] == "next", i) for u, p in zip(frame["url"], frame["html"], strict=True) for i, a in enumerate(anchors(p)) if a["href"]]
            yield pd.DataFrame(rows, columns=["page_url", "link", "is_next", "position"])

    links = pages.select("url", "html").mapInPandas(run, "page_url string, link string, is_next boolean, position int")
    n, own = page_number(F.col("link")), F.coalesce(page_number(F.col("page_url")), F.lit(1))
    by_number = F.min_by("link", F.when(n > own, n))
    first = F.min_by("link", F.when(F.col("is_next"), F.col("position")))
    return links.groupBy("page_url").agg(F.coalesce(by_number, first).alias("next_url")).where("next_url is not null")


def first_seen(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first arrival of each key."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")
