"""The pipeline from pages or scripts to findings and statistics, as one dataflow.

Each table of the result is its own plan: what is not asked for is not computed. The two Python steps (DOM and
JavaScript reading) run in Arrow batches; everything else is built-in expressions. The only shuffles are the
deduplication of remote scripts, by URL, and the final distinct counts.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpie.functions.strings import column_of, line_of
from kelpie.operators import detect, dom, jslex
from kelpie.sources import web
from kelpie.sources.rules import Rule


@dataclass(frozen=True)
class Scan:
    """What a scan gives: tables, evaluated when they are used."""

    pages: DataFrame
    scripts: DataFrame
    literals: DataFrame
    findings: DataFrame
    errors: DataFrame

    def summary(self) -> DataFrame:
        return summary(self.findings, self.scripts, self.pages)


@dataclass(frozen=True)
class Collector:
    """Options of requests for scripts. with_* methods give changed copies."""

    user_agent: str | None = None
    headers: tuple[tuple[str, str], ...] = ()
    timeout: float | None = None
    timeout_connect: float | None = None

    def with_random_ua(self, on: bool) -> Collector:
        """A random agent; asked for again, or not wanted, none."""
        return replace(self, user_agent=web.random_user_agent() if on and self.user_agent is None else None)

    def with_headers(self, headers: list[tuple[str, str]]) -> Collector:
        return replace(self, headers=(*self.headers, *headers))

    def requests(self) -> web.Requests:
        agent = (("User-Agent", self.user_agent),) if self.user_agent else ()
        return web.Requests((*agent, *self.headers), self.timeout, self.timeout_connect)


def wanted_remote(elements: DataFrame) -> DataFrame:
    """Remote scripts to be read, each URL once."""
    return dom.wanted_scripts(dom.remote_scripts(elements)).dropDuplicates(["script_url"])


def fetch_scripts(pages: DataFrame, requests: web.Requests) -> DataFrame:
    """What came of the remote scripts of pages (url, html), each fetched once; a plan that fetches, so to be kept."""
    scripts = wanted_remote(dom.extract_dom(pages))
    return web.fetched(scripts.select(F.col("script_url").alias("url")), requests)


def scan_pages(pages: DataFrame, rules: list[Rule] | None = None, fetched: DataFrame | None = None, url: str = "url", html: str = "html") -> Scan:
    """pages: url, html and perhaps content_type; fetched: script_url, source and perhaps content_type.

    Pages whose content type lacks "html", and scripts whose lacks "javascript", are left out; no type passes.
    Remote scripts are read where fetched has them; without fetched only embedded ones are.
    """
    if "content_type" in pages.columns:
        pages = pages.where(F.col("content_type").isNull() | F.contains("content_type", F.lit("html")))
    elements = dom.extract_dom(pages, url, html)
    embedded = dom.embedded_scripts(elements).withColumn("script_url", F.col("page_url"))
    scripts = embedded
    if fetched is not None:
        if "content_type" in fetched.columns:
            fetched = fetched.where(F.contains("content_type", F.lit("javascript")))
        bodies = fetched.select("script_url", F.col("source").alias("__body"))
        remote = wanted_remote(elements).drop("source").join(bodies, "script_url").select("page_url", "ordinal", "kind", "script_url", F.col("__body").alias("source"))
        scripts = embedded.unionByName(remote)
    return scan_scripts(scripts, rules, pages)


def scan_scripts(scripts: DataFrame, rules: list[Rule] | None = None, pages: DataFrame | None = None) -> Scan:
    """scripts: page_url, ordinal, kind, script_url, source."""
    parsed = jslex.with_literals(scripts)
    literals = jslex.script_literals(parsed)
    findings = positioned(detect.detect(literals, rules)).drop("source")
    errors = jslex.script_errors(parsed).select(F.lit("parse").alias("stage"), F.lit("ParserFailed").alias("kind"), F.col("script_url").alias("url"), F.col("error").alias("detail"))
    return Scan(pages if pages is not None else scripts.select("page_url").distinct(), scripts, literals.drop("source"), findings, errors)


def positioned(findings: DataFrame, source: str = "source") -> DataFrame:
    """With line and column, counted from 1; columns count bytes."""
    return findings.withColumn("line", line_of(F.col(source), F.col("start"))).withColumn("column", column_of(F.col(source), F.col("start")))


def summary(findings: DataFrame, scripts: DataFrame, pages: DataFrame) -> DataFrame:
    """One row: keys_found (distinct secrets), scripts_checked, pages_crawled."""
    keys = findings.agg(F.count_distinct("secret").alias("keys_found"))
    checked = scripts.agg(F.count(F.lit(1)).alias("scripts_checked"))
    crawled = pages.agg(F.count(F.lit(1)).alias("pages_crawled"))
    # one row each
    return keys.join(checked).join(crawled)


def findings_by_rule(findings: DataFrame) -> DataFrame:
    """How many findings and distinct secrets each rule has."""
    return findings.groupBy("rule_idx", "rule_id").agg(F.count(F.lit(1)).alias("findings"), F.count_distinct("secret").alias("secrets"))


#: An assignment of a quoted string in free text: the name, then the string in either kind of quotes.
DOUBLE = r'([A-Za-z_$][A-Za-z0-9_$]*)\s*[=:]\s*"([^"\n]*)"'
SINGLE = r"([A-Za-z_$][A-Za-z0-9_$]*)\s*[=:]\s*'([^'\n]*)'"
#: The same without backtracking: a name is tried at the beginning of its run of characters only.
ONCE = r"(?<![A-Za-z0-9_$])[0-9]*+([A-Za-z_$][A-Za-z0-9_$]*+)\s*+[=:]\s*+Q([^Q\n]*+)Q"


def text_assignments(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, literal (its place), quote, key_name, value: assignments of quoted strings in free text.

    Only texts with a quote after a sign are searched for names, once for each kind of quotes; what is found, which is
    short, is then taken apart.
    """

    def found(kind: str, mark: str, q: int) -> Column:
        pattern = ONCE.replace("Q", mark)
        whole = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
        some = F.when(F.rlike(F.col(text), F.lit(rf"[=:]\s*+{mark}")), whole).otherwise(F.array().cast("array<string>"))
        part = lambda x, g: F.regexp_extract(x, pattern, g)
        return F.transform(some, lambda x, i: F.struct((i * 2 + q).alias("literal"), F.lit(kind).alias("quote"), part(x, 1).alias("key_name"), part(x, 2).alias("value")))

    each = F.concat(found("double", '"', 0), found("single", "'", 1))
    return docs.select(F.col(id_col), each.alias("each")).where(F.size("each") > 0).select(id_col, F.explode("each").alias("a")).select(id_col, "a.*")


def scan_text(docs: DataFrame, rules: list[Rule] | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Findings among the assignments of free text; offsets count from the value's first byte."""
    return detect.detect(text_assignments(docs, id_col, text), rules, span_start=None)
