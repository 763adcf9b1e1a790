"""Command line: crawl from one or more URLs, over the web or over a table of pages, and report what scripts leak."""

from __future__ import annotations

import argparse
import sys
import time
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpie.plans.crawl import CrawlConfig, crawl_many, cut
from kelpie.plans.scan import Scan, fetch_scripts, scan_pages, summary
from kelpie.report import reports
from kelpie.sources import web
from kelpie.sources.rules import default_rules, rules_from_file
from kelpie.sources.web import parse_header


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="kelpie", description="Find leaked credentials in the scripts of web pages.")
    p.add_argument("url", nargs="*", help="where a crawl starts; https:// is put in front if no scheme is given")
    p.add_argument("--pages", help="a Parquet table of pages (url, html) that stands for the web; without it pages are fetched")
    p.add_argument("--sites", help="a CSV of sites (Name, Website), of which each is an entry after those given")
    p.add_argument("-o", "--output", help="a folder for the report; the console without it")
    p.add_argument("-f", "--format", choices=("default", "json"), default="default")
    p.add_argument("-r", "--redact", action="store_true", help="hide all but the first bytes of secrets; not applied to JSON")
    p.add_argument("-m", "--max-walks", type=int, default=20)
    p.add_argument("-U", "--no-random-ua", action="store_true")
    p.add_argument("-H", "--header", action="append", default=[], type=parse_header)
    p.add_argument("--headers-for-scripts", action="store_true", help="send the headers with requests for scripts, too")
    p.add_argument("--timeout", type=float, help="seconds to wait for data")
    p.add_argument("--timeout-connect", type=float, help="seconds to wait for a connection")
    p.add_argument("-v", "--verbose", action="count", default=0)
    p.add_argument("-q", "--quiet", action="count", default=0)
    p.add_argument("--rules", help="a rule file instead of the packaged rules")
    return p


def log_level(verbose: int, quiet: int) -> str:
    return ("OFF", "ERROR", "WARN", "INFO", "DEBUG")[max(0, min(4, 2 + verbose - quiet))]


def config_of(args: argparse.Namespace) -> CrawlConfig:
    config = CrawlConfig().with_max_walks(args.max_walks).with_cookie_jar(True).with_headers_for_scripts(args.headers_for_scripts)
    if args.no_random_ua:
        config = config.with_random_ua(False)
    for name, value in args.header:
        config = config.with_header(name, value)
    if args.timeout:
        config = config.with_timeout(args.timeout)
    return config.with_timeout_connect(args.timeout_connect) if args.timeout_connect else config


def scan_sites(spark: SparkSession, pages: DataFrame | None, entries: list[str], config: CrawlConfig, rules: list) -> tuple[Scan, DataFrame]:
    """Crawls from each entry with one cache, scans what was visited; the scan and the errors of walks that failed.

    Without a table of pages, remote scripts are fetched as well.
    """
    walks = crawl_many(spark, pages, entries, config)
    visited, errors = (reduce(DataFrame.unionByName, x) for x in ([w.visited.select("url", "html") for w in walks], [w.errors.where(F.lit(not w.succeeded)) for w in walks]))
    if pages is not None:
        return scan_pages(visited, rules), errors
    visited = cut(visited)
    # a checkpoint: every script is fetched once
    answers = cut(fetch_scripts(visited, config.script_requests()))
    return scan_pages(visited, rules, web.fetched_scripts(answers)), errors


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    began = time.time()
    spark = spark or SparkSession.builder.appName("kelpie").getOrCreate()
    if args.verbose or args.quiet:
        spark.sparkContext.setLogLevel(log_level(args.verbose, args.quiet))
    # what a caller lists stays on the driver: a crawl takes one entry after the other
    listed = [r.website for r in web.site_list(spark, args.sites).toLocalIterator()] if args.sites else []
    entries = [u if "://" in u else f"https://{u}" for u in args.url] + listed
    if not entries:
        raise SystemExit("no URL and no site is given")
    rules = rules_from_file(args.rules) if args.rules else default_rules()
    scan, errors = scan_sites(spark, spark.read.parquet(args.pages) if args.pages else None, entries, config_of(args), rules)
    findings = scan.findings.persist()
    if args.format == "json":
        lines = reports.json_lines(findings)
    else:
        sources = scan.scripts.select("script_url", "ordinal", "source")
        lines = reports.graphical(findings.join(sources, ["script_url", "ordinal"]), args.redact, "source", colours=not args.output and sys.stdout.isatty())
    if args.output:
        lines.write.mode("overwrite").text(args.output)
    else:
        for row in lines.toLocalIterator():
            print(row.value)
    if args.format == "default":
        print(reports.summary_line(summary(findings, scan.scripts, scan.pages), time.time() - began).first().value)
    findings.unpersist()
    return reports.exit_code(errors)


if __name__ == "__main__":
    sys.exit(main())
