"""Links and scripts of pages, read from the HTML by an Arrow-batched function that gives an array per page."""

from __future__ import annotations

from collections.abc import Callable
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpie.functions import urls

ELEMENT = "array<struct<ordinal:int,kind:string,href:string,type:string,body:string>>"
#: An element visitor: (tag, attributes, text) -> rows of (kind, href, type, body).
Visitor = Callable[[str, dict[str, str | None], str], list[tuple[str, str | None, str | None, str | None]]]


class Walker(HTMLParser):
    """Calls a visitor for each a and script element in document order, scripts with their text."""

    def __init__(self, visit: Visitor) -> None:
        super().__init__(convert_charrefs=True)
        self.visit, self.rows, self.script, self.text = visit, [], None, []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        first: dict[str, str | None] = {}
        for k, v in attrs:
            first.setdefault(k, v)
        if tag == "script":
            self.close_script()
            self.script, self.text = first, []
        else:
            self.rows += self.visit(tag, first, "")

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        # a slash does not close an element of HTML
        self.handle_starttag(tag, attrs)
        if tag in self.CDATA_CONTENT_ELEMENTS:
            self.set_cdata_mode(tag)

    def handle_data(self, data: str) -> None:
        if self.script is not None:
            self.text.append(data)

    def handle_endtag(self, tag: str) -> None:
        if tag == "script":
            self.close_script()

    def close_script(self) -> None:
        if self.script is not None:
            self.rows += self.visit("script", self.script, "".join(self.text))
            self.script = None


def links_and_scripts(tag: str, attributes: dict[str, str | None], text: str) -> list[tuple[str, str | None, str | None, str | None]]:
    if tag == "a" and attributes.get("href") is not None:
        return [("link", attributes["href"], None, None)]
    if tag == "script":
        kind = attributes.get("type") if attributes.get("type") is not None else ("" if "type" in attributes else None)
        if "src" in attributes:
            return [("remote", attributes["src"] or "", kind, None)]
        return [("embedded", None, kind, text.strip())]
    return []


def walk(html: str | None, visit: Visitor = links_and_scripts) -> list[dict]:
    if not html:
        return []
    w = Walker(visit)
    w.feed(html)
    w.close()
    w.close_script()
    return [{"ordinal": k, "kind": kind, "href": href, "type": type_, "body": body} for k, (kind, href, type_, body) in enumerate(w.rows)]


def elements(html: Column, visit: Visitor = links_and_scripts) -> Column:
    """array<struct<ordinal, kind, href, type, body>> of a page, in document order."""

    @F.pandas_udf(ELEMENT)
    def read(pages: pd.Series) -> pd.Series:
        return pages.map(lambda h: walk(h, visit))

    return read(html)


def extract_dom(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """page_url and the elements of each page, one row each."""
    return pages.select(F.col(url).alias("page_url"), F.explode(elements(F.col(html))).alias("e")).select("page_url", "e.*")


def page_links(dom: DataFrame) -> DataFrame:
    """page_url, ordinal, url: links that may lead to pages, resolved against the site's root."""
    href = F.regexp_replace("href", r"^\s+|\s+$", "")
    links = dom.where(F.col("kind") == "link").withColumn("href", href).where(urls.is_page_link(F.col("href")))
    resolved = links.withColumn("url", urls.resolve(urls.site_root(F.col("page_url")), F.col("href")))
    return resolved.where("url is not null").where(urls.is_page_path(F.col("url"))).select("page_url", "ordinal", "url")


def is_javascript() -> Column:
    return F.col("type").isNull() | F.contains(F.col("type"), F.lit("javascript"))


def embedded_scripts(dom: DataFrame) -> DataFrame:
    """The embedded ones of page_scripts(): no URL is resolved for them."""
    rows = dom.where(F.col("kind") == "embedded").where(is_javascript()).where("body <> ''")
    return rows.select("page_url", "ordinal", "kind", F.lit(None).cast("string").alias("script_url"), F.col("body").alias("source"))


def remote_scripts(dom: DataFrame) -> DataFrame:
    """The remote ones of page_scripts()."""
    return page_scripts(dom.where(F.col("kind") == "remote"))


def page_scripts(dom: DataFrame) -> DataFrame:
    """page_url, ordinal, kind, script_url, source: JavaScript elements; embedded ones with their text."""
    js = dom.where(F.col("kind").isin("remote", "embedded")).where(is_javascript())
    remote = F.col("kind") == "remote"
    url = F.when(remote, urls.resolve(urls.site_root(F.col("page_url")), F.when(remote, F.col("href"))))
    rows = js.select("page_url", "ordinal", F.when(remote, "url").otherwise("embedded").alias("kind"), url.alias("script_url"), F.col("body").alias("source"))
    return rows.where("(kind = 'url' and script_url is not null) or (kind = 'embedded' and source <> '')")


def wanted_scripts(scripts: DataFrame) -> DataFrame:
    """Without remote scripts of known hosts and libraries; embedded ones all pass."""
    return scripts.where((F.col("kind") == "embedded") | ~urls.is_skipped_script(F.col("script_url")))


def distinct_scripts(scripts: DataFrame) -> DataFrame:
    """Remote scripts once each by exact URL; embedded ones are never merged. Only URLs are compared."""
    remote = scripts.where("kind = 'url'").dropDuplicates(["script_url"])
    return remote.unionByName(scripts.where("kind = 'embedded'"))
