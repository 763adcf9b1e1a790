"""Many sites in one dataflow: every page belongs to a site, and the crawl's budget holds for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kelpie.functions import urls
from kelpie.plans.scan import Scan, scan_pages
from kelpie.sources.rules import Rule


def site_pages(sites: DataFrame, pages: DataFrame, max_walks: int = 30) -> DataFrame:
    """site, url, html: of each site (name, website), at most max_walks pages of its host, canonical URLs once, by URL.

    The site list is matched by host; pages of hosts that are not listed are not read further.
    """
    listed = sites.select(F.col("name").alias("site"), urls.host(F.col("website")).alias("host"))
    keyed = pages.select("url", urls.host(F.col("url")).alias("host"), urls.canonical(F.col("url")).alias("canon"))
    once = keyed.groupBy("host", "canon").agg(F.min("url").alias("url"))
    ranked = once.join(listed, "host").withColumn("n", F.row_number().over(Window.partitionBy("site").orderBy("url"))).where(F.col("n") <= max_walks)
    return ranked.select("site", "url").join(pages.select("url", "html"), "url")


def scan_sites(sites: DataFrame, pages: DataFrame, rules: list[Rule] | None = None, max_walks: int = 30) -> Scan:
    return scan_pages(site_pages(sites, pages, max_walks), rules)
