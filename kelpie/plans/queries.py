"""Queries over the driver's tables, one for each group of operators, and the SQL that gives the same rows."""

from __future__ import annotations

import random
import re
import re._parser as sre
from collections.abc import Callable

import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpie.functions import urls
from kelpie.functions.strings import byte_histogram, column_of, line_of, redact, shannon_entropy
from kelpie.operators import detect, dom, jslex
from kelpie.plans import crawl as crawling
from kelpie.plans import scan
from kelpie.report import reports
from kelpie.sources.rules import Rule, compile_rule, default_rules, rules_df

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# pages


def dom_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dom.extract_dom(table(spark, sf_dir, "pages"))
    return rows.groupBy("page_url", "kind").agg(F.count(F.lit(1)).alias("n"))


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = dom.page_links(dom.extract_dom(table(spark, sf_dir, "pages")))
    return links.groupBy("page_url", "url").agg(F.count(F.lit(1)).alias("n"))


def embedded_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dom.page_scripts(dom.extract_dom(table(spark, sf_dir, "pages"))).select("page_url", "kind", "source")


def script_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    scripts = dom.page_scripts(dom.extract_dom(keyed_pages(spark, sf_dir)))
    return jslex.script_literals(jslex.with_literals(scripts)).select("page_url", "literal", "literal_kind", "value", "key_name", "span_start", "span_end")


def keyed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages, every fifth with a script more that holds a made key, a made token and a harmless text."""
    own = F.col("page_id").cast("string")
    script = F.concat(
        F.lit("<script>\nvar plain = 1;\nconst key"), own, F.lit(' = "AKIA'), F.upper(F.substring(F.md5(own.cast("binary")), 1, 16)),
        F.lit('",\n  token = "'), F.md5(F.concat(F.lit("t"), own).cast("binary")), F.lit('", colour = "red";\n</script>'),
    )
    return table(spark, sf_dir, "pages").withColumn("html", F.when(F.col("page_id") % 5 == 0, F.concat("html", script)).otherwise(F.col("html")))


def page_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From pages to findings."""
    found = scan.scan_pages(keyed_pages(spark, sf_dir)).findings
    return found.select("script_url", "rule_id", "key_name", "secret", "line", "column")


def page_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.scan_pages(keyed_pages(spark, sf_dir)).summary()


def canonical_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.canonical(F.col("url")).alias("canon"), urls.host(F.col("url")).alias("host"), urls.path(F.col("url")).alias("path"), urls.site_root(F.col("url")).alias("root"))


def url_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(urls.canonical(F.col("url")).alias("canon")).distinct()


def whitelisted_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", urls.host(F.col("url")).alias("host"))
    allowed = pages.where("page_id % 7 = 0").select("host").distinct()
    return pages.join(allowed, "host", "left_semi")


SCRIPT_URLS = (
    "https://ajax.googleapis.com/x.js", "https://unpkg.com/a.js", "https://cdn.example.com/jquery.min.js", "https://cdn.example.com/app.js", "https://example.com/React.js",
    "https://example.com/lib/react-dom.js?v=2", "https://example.com/app.js?lodash=1", "https://youtube.com/a", "https://www.youtube.com/a", "https://events.framer.com/script",
)


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def skip_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = values(spark, [(u,) for u in SCRIPT_URLS], "script_url string").withColumn("kind", F.lit("url"))
    return dom.wanted_scripts(rows).select("script_url")


# free text


def doc_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.text_assignments(table(spark, sf_dir, "documents"))


def entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan.text_assignments(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "literal", F.size(byte_histogram(F.col("value"))).alias("symbols"), F.round(shannon_entropy(F.col("value")), 6).alias("bits"))


def rule_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("value")).repartition(spark.sparkContext.defaultParallelism)
    hits = detect.rule_hits(docs, ascii_rules(), key_name=None)
    return hits.groupBy("rule_idx").agg(F.count(F.lit(1)).alias("docs"), F.min("doc_id").alias("first_doc"))


def ascii_rules() -> list[Rule]:
    """The rules as they read ASCII: what other engines understand, so that they can be compared on any text."""
    return [Rule(**{**r.__dict__, "value_re": r.value_re.replace("(?iu)", "(?i)").replace("(?U)", ""), "name_re": r.name_re and r.name_re.replace("(?iu)", "(?i)").replace("(?U)", "")}) for r in default_rules()]


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan.scan_text(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "literal", "key_name", "rule_idx", "rule_id", "group_idx", "secret", "start", "end")


def findings_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.findings_by_rule(scan.scan_text(table(spark, sf_dir, "documents")))


def distinct_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan.summary(scan.scan_text(docs), scan.text_assignments(docs), docs)


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line and column of the middle byte of every text."""
    middle = F.floor(F.octet_length("text") / 2).cast("int")
    return table(spark, sf_dir, "documents").select("doc_id", line_of(F.col("text"), middle).alias("line"), column_of(F.col("text"), middle).alias("column"))


def redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(spark, sf_dir).select("doc_id", "literal", "group_idx", redact(F.col("secret")).alias("shown"))


def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan.scan_text(table(spark, sf_dir, "documents"))
    return found.select("rule_id", "description", "key_name", "secret", F.lit(1).alias("line"), (F.col("start") + 1).alias("column"), F.concat(F.lit("doc:"), F.col("doc_id")).alias("script_url"))


def json_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.json_lines(report_rows(spark, sf_dir))


def graphical_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.graphical(report_rows(spark, sf_dir), redacted=True)


def rule_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules_df(spark).select("rule_idx", "rule_id", "n_groups", (F.col("name_re").isNotNull()).alias("split"), F.col("min_entropy").cast("double").alias("min_entropy"))


# made literals: one that matches, one cut short, and one with a name, for each rule


class Sampler:
    """Strings that match a pattern, from its parse tree."""

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def one(self, tree) -> str:  # noqa: ANN001
        out = []
        for op, arg in tree:
            name = str(op)
            if name == "LITERAL":
                out.append(chr(arg))
            elif name == "NOT_LITERAL":
                out.append("~" if arg != ord("~") else "!")
            elif name == "ANY":
                out.append("x")
            elif name == "IN":
                out.append(self.member(arg))
            elif name == "SUBPATTERN":
                out.append(self.one(arg[3]))
            elif name == "BRANCH":
                out.append(self.one(self.r.choice(arg[1])))
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
                low, high, inner = arg
                out += [self.one(inner) for _ in range(self.r.randint(low, min(int(high), low + 3)))]
        return "".join(out)

    def member(self, items) -> str:  # noqa: ANN001
        if str(items[0][0]) == "NEGATE":
            taken = {c for op, a in items[1:] for c in ([a] if str(op) == "LITERAL" else range(a[0], a[1] + 1) if str(op) == "RANGE" else [])}
            return self.r.choice([c for c in "abcXYZ789" if ord(c) not in taken] or ["~"])
        op, a = self.r.choice(items)
        if str(op) == "LITERAL":
            return chr(a)
        if str(op) == "RANGE":
            return chr(self.r.randint(a[0], a[1]))
        kind = str(a)
        return self.r.choice("0123456789" if "DIGIT" in kind else " " if "SPACE" in kind else "abcXYZ019")


def made_literals() -> list[tuple[int, str, str | None, int]]:
    """(case, value, key name, span start): ASCII literals drawn from every rule's own patterns."""
    rows = []
    for r in default_rules():
        s = Sampler(r.rule_idx)
        plain = lambda p: sre.parse(re.sub(r"\(\?[a-zA-Z]+\)", "", p).replace(r"\z", r"\Z"))
        value = s.one(plain(r.value_re)).replace("\x00", "")
        name = None if r.name_re is None else s.one(plain(r.name_re))
        for v, k in ((value, name), (value[: len(value) // 2], name), (value, None), (value + "-tail", (name or "x") + "_1")):
            if v.isascii() and (k or "").isascii():
                rows.append((len(rows), v, k, 7 * len(rows)))
    return rows


def synthetic_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = values(spark, made_literals(), "case_id int, value string, key_name string, span_start int").repartition(8)
    found = detect.detect(rows).where("group_idx <= 9")
    return found.select("case_id", "rule_idx", "rule_id", "group_idx", "secret", "start", "end")


#: Patterns, and literals with the places of their groups told by hand: rule, value, then group, start, secret.
PLACES = (
    ("(?:ab)=([a-z]+);(ab)", "ab=qq;ab", ((0, 0, "ab=qq;ab"), (1, 3, "qq"), (2, 6, "ab"))),
    ("(a)|(b+)c", "..bbc a", ((0, 2, "bbc"), (2, 2, "bb"))),
    ("x(?:([0-9])-)+", "x1-2-1-", ((0, 0, "x1-2-1-"), (1, 5, "1"))),
    ("([a-z])([a-z])=([a-z])", "zz zy=z", ((0, 3, "zy=z"), (1, 3, "z"), (2, 4, "y"), (3, 6, "z"))),
    ("k( +)(k)", "k  k", ((0, 0, "k  k"), (2, 3, "k"))),
    ("((s)t)", "st", ((0, 0, "st"), (2, 0, "s"))),
)


def capture_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [r for k, (p, _, _) in enumerate(PLACES) if (r := compile_rule(k, {"id": f"rule{k}", "description": "", "regex": p}))]
    rows = values(spark, [(k, v) for k, (_, v, _) in enumerate(PLACES)], "case_id int, value string").withColumn("key_name", F.lit(None).cast("string"))
    return detect.detect(rows, rules, span_start=None).where("case_id = rule_idx").select("case_id", "group_idx", "start", "end", "secret")


# crawling

EDGES = tuple((f"https://site.example/{a}", f"https://site.example/{b}") for a, b in ("ab", "ac", "bd", "cd", "de", "ea", "ef", "fg", "xg", "gb"))


def crawl_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawling.depths(values(spark, list(EDGES), "src string, dst string"), EDGES[0][0], max_depth=12)


def budgeted_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawling.budgeted(table(spark, sf_dir, "pages"), 3).select("page_url", "href", "place")


def linked_site(spark: SparkSession) -> DataFrame:
    pages: dict[str, list[str]] = {}
    for a, b in EDGES:
        pages.setdefault(a, []).append(b)
        pages.setdefault(b, [])
    body = lambda u: "".join(f'<a href="{x}">x</a>' for x in [*pages[u], "mailto:a@b", "/z.png"]) + f'<script>var k = "{u}"</script>'
    return values(spark, [(u, body(u)) for u in pages], "url string, html string")


def crawl_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawling.crawl(spark, linked_site(spark), EDGES[0][0], crawling.CrawlConfig(user_agent=None)).visited.select("url", "depth")


def crawl_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A site whose pages lead to one another in a row of fifty, each by way of its second link."""
    body = lambda k: f'<a href="/p{k}">this</a><a href="/p{k + 1}">next</a>'
    site = values(spark, [(f"https://row.example/p{k}", body(k)) for k in range(50)], "url string, html string")
    return crawling.crawl(spark, site, "https://row.example/p0", crawling.CrawlConfig(user_agent=None)).visited.select("url", "depth")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        dom_elements, page_links, embedded_scripts, script_literals, page_findings, page_summary, canonical_urls, url_dedup, whitelisted_pages, skip_scripts, doc_assignments, entropy,
        rule_hits, findings, findings_by_rule, distinct_secrets, positions, redacted, json_report, graphical_report, rule_table, synthetic_findings, capture_places, crawl_depth, budgeted_frontier, crawl_site, crawl_chain,
    )
}


# the same in SQL


def quoted(x: object) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)


def sql_rules() -> str:
    rows = ascii_rules()
    listed = ", ".join("(" + ", ".join(map(quoted, (r.rule_idx, r.rule_id, r.name_re, r.value_re, r.n_groups, r.min_entropy, r.description))) + ")" for r in rows)
    return f"rules(rule_idx, rule_id, name_re, value_re, n_groups, min_entropy, description) AS (VALUES {listed})"


HOST = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"
CANON = f"""CASE WHEN len(kept) = 0 THEN regexp_extract(url, '^[^?#]*') ELSE regexp_extract(url, '^[^?#]*') || '?' || array_to_string(kept, '') END"""
KEPT = f"""list_transform(list_filter(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'),
    lambda p: list_contains([{", ".join(map(quoted, urls.KEPT_KEYS))}], split_part(p, '=', 1))), lambda p: CASE WHEN contains(p, '=') THEN p ELSE p || '=' END)"""
LINKS = """l AS (SELECT page_id, url, hrefs[i] AS href, i FROM (SELECT *, unnest(range(1, len(hrefs) + 1)) AS i
    FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hrefs FROM pages)))"""
SCRIPTS = """s AS (SELECT url AS page_url, unnest(regexp_extract_all(html, '(?s)<script>(.*?)</script>', 1)) AS source FROM pages)"""
#: The scripts of keyed_pages, and their assigned texts with the places of the quotes.
KEYED = """keyed AS (SELECT url, CASE WHEN page_id % 5 = 0 THEN html || '<script>' || chr(10) || 'var plain = 1;' || chr(10) || 'const key' || page_id || ' = "AKIA' || upper(left(md5(page_id::VARCHAR), 16))
    || '",' || chr(10) || '  token = "' || md5('t' || page_id) || '", colour = "red";' || chr(10) || '</script>' ELSE html END AS html FROM pages),
  s AS (SELECT url AS page_url, k, trim(b[k], ' ' || chr(9) || chr(10) || chr(13)) AS source FROM (SELECT *, unnest(range(1, len(b) + 1)) AS k FROM (SELECT url, regexp_extract_all(html, '(?s)<script>(.*?)</script>', 1) AS b FROM keyed))),
  t AS (SELECT page_url, k, source, n[i] AS key_name, v[i] AS value, i - 1 AS literal FROM (SELECT *, unnest(range(1, len(n) + 1)) AS i
    FROM (SELECT *, regexp_extract_all(source, '([A-Za-z_$][A-Za-z0-9_$]*) *= *"([^"]*)"', 1) AS n, regexp_extract_all(source, '([A-Za-z_$][A-Za-z0-9_$]*) *= *"([^"]*)"', 2) AS v FROM s))),
  a AS (SELECT *, strlen(split_part(source, '"' || value || '"', 1)) AS span_start FROM t)"""


def sql_assignments() -> str:
    """CTE a: assignments of quoted strings in the documents."""
    double, single = scan.DOUBLE, scan.SINGLE.replace("'", "''")
    each = [
        f"""SELECT doc_id, i * 2 + {q} AS literal, '{kind}' AS quote, n[i + 1] AS key_name, v[i + 1] AS value FROM (SELECT *, unnest(range(len(n))) AS i FROM
        (SELECT doc_id, regexp_extract_all(text, '{p}', 1) AS n, regexp_extract_all(text, '{p}', 2) AS v FROM documents))"""
        for q, (kind, p) in enumerate((("double", double), ("single", single)))
    ]
    return "a AS (" + " UNION ALL ".join(each) + ")"


def made_places() -> str:
    """For SQL, which tells no places of groups: case, rule, group and start of the made literals' matches, by Python's engine."""
    rows = []
    for r in default_rules():
        java = r.value_re
        pattern = regex.compile(java.replace("(?iu)", "").replace("(?U)", "").replace(r"\z", r"\Z"), regex.V1 | (regex.IGNORECASE if "(?iu)" in java else 0))
        for case, value, _, _ in made_literals():
            if m := pattern.search(value):
                rows += [(case, r.rule_idx, g, m.start(g)) for g in range(min(10, len(m.groups()) + 1)) if m[g]]
    return "places(case_id, rule_idx, group_idx, start) AS (VALUES " + ", ".join(map(str, rows)) + ")"


def sql_findings(rows: str, keys: str, places: str = "") -> str:
    """CTE f: findings of a(keys, value, key_name); start counts from the value's first byte.

    Without a table of places, a group stands where its text stands first in the match: so it is for all but patterns
    that hold a group's text twice.
    """
    start, join = "strpos(value, whole) + strpos(whole, secret) - 2", "JOIN places USING (case_id, rule_idx, group_idx)" if places else ""
    groups = " UNION ALL ".join(
        f"SELECT {keys}, value, rule_idx, rule_id, description, min_entropy, {g} AS group_idx, regexp_extract(value, value_re, {g}) AS secret, regexp_extract(value, value_re, 0) AS whole FROM h WHERE n_groups >= {g}"
        for g in range(10)
    )
    return f"""{rows}, {sql_rules()},{places and " " + places + ","}
  h AS (SELECT a.*, rules.* FROM a JOIN rules ON regexp_matches(a.value, rules.value_re) AND (rules.name_re IS NULL OR coalesce(regexp_matches(a.key_name, rules.name_re), false))),
  g AS (SELECT *{"" if places else f", {start} AS start"} FROM ({groups}) {join} WHERE trim(secret) <> ''),
  d AS (SELECT *, lag(start) OVER w AS s0, lag(secret) OVER w AS t0 FROM g WINDOW w AS (PARTITION BY {keys}, rule_idx ORDER BY group_idx)),
  f AS (SELECT d.*, start + strlen(secret) AS "end" FROM d WHERE (s0 IS NULL OR s0 <> start OR t0 <> secret)
    AND (NOT starts_with(rule_id, 'generic') OR regexp_matches(secret, '[0-9]'))
    AND (min_entropy IS NULL OR list_aggregate(string_split(secret, ''), 'entropy') >= min_entropy))"""


def oracle_sql() -> dict[str, str]:
    found = sql_findings(sql_assignments(), "doc_id, literal, key_name")
    pages_found = sql_findings(KEYED, "page_url, k, literal, source, span_start, key_name")
    places = ", ".join(f"({k}, {g}, {at}, {quoted(secret)})" for k, (_, _, groups) in enumerate(PLACES) for g, at, secret in groups)
    made = ", ".join("(" + ", ".join(map(quoted, row)) + ")" for row in made_literals())
    synthetic = sql_findings(f"a(case_id, value, key_name, span_start) AS (VALUES {made})", "case_id, key_name, span_start", made_places())
    edges = ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in EDGES)
    walk = f"""WITH RECURSIVE e(src, dst) AS (VALUES {edges}), walk(url, depth) AS (
        SELECT {quoted(EDGES[0][0])}, 0 UNION ALL SELECT e.dst, depth + 1 FROM walk JOIN e ON e.src = walk.url WHERE depth < 12
      ) SELECT url, min(depth)::INTEGER AS depth FROM walk GROUP BY url"""
    skipped = " OR ".join([f"{HOST} IN ({', '.join(map(quoted, urls.SKIP_DOMAINS))})", *[f"contains(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), {quoted(p)})" for p in urls.SKIP_PATHS]])
    return {
        "dom_elements": f"WITH {LINKS}, {SCRIPTS} SELECT url AS page_url, 'link' AS kind, count(*) AS n FROM l GROUP BY ALL UNION ALL SELECT page_url, 'embedded', count(*) FROM s GROUP BY ALL",
        "page_links": f"""WITH {LINKS} SELECT url AS page_url, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*') || replace(replace(url_encode(href), '%2F', '/'), '%2C', ',') AS url, count(*) AS n
          FROM l GROUP BY ALL""",
        "embedded_scripts": f"WITH {SCRIPTS} SELECT page_url, 'embedded' AS kind, trim(source) AS source FROM s WHERE trim(source) <> ''",
        "script_literals": f"""WITH {KEYED} SELECT page_url, literal::INTEGER AS literal, 'string' AS literal_kind, value, key_name, span_start::INTEGER AS span_start,
          (span_start + strlen(value) + 2)::INTEGER AS span_end FROM a""",
        "page_findings": f"""WITH {pages_found}, q AS (SELECT *, left(source, (span_start + start)::INTEGER) AS p FROM f)
          SELECT page_url AS script_url, rule_id, key_name, secret, (len(p) - len(replace(p, chr(10), '')) + 1)::INTEGER AS line, (len(string_split(p, chr(10))[-1]) + 1)::INTEGER AS "column" FROM q""",
        "page_summary": f"WITH {pages_found} SELECT (SELECT count(DISTINCT secret) FROM f) AS keys_found, (SELECT count(*) FROM s WHERE source <> '') AS scripts_checked, (SELECT count(*) FROM pages) AS pages_crawled",
        "capture_places": f"""SELECT case_id::INTEGER AS case_id, group_idx::INTEGER AS group_idx, start::INTEGER AS start, (start + strlen(secret))::INTEGER AS "end", secret FROM (VALUES {places}) t(case_id, group_idx, start, secret)""",
        "crawl_chain": "SELECT 'https://row.example/p' || k AS url, k::INTEGER AS depth FROM range(50) t(k)",
        "canonical_urls": f"""SELECT page_id, {CANON} AS canon, {HOST} AS host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[^/]*//[^/?#]*') || '/' AS root
          FROM (SELECT *, {KEPT} AS kept FROM pages)""",
        "url_dedup": f"SELECT DISTINCT {CANON} AS canon FROM (SELECT *, {KEPT} AS kept FROM pages)",
        "whitelisted_pages": f"WITH h AS (SELECT page_id, {HOST} AS host FROM pages) SELECT host, page_id FROM h WHERE host IN (SELECT host FROM h WHERE page_id % 7 = 0)",
        "skip_scripts": f"SELECT url AS script_url FROM (VALUES {', '.join(f'({quoted(u)})' for u in SCRIPT_URLS)}) t(url) WHERE NOT ({skipped})",
        "doc_assignments": f"WITH {sql_assignments()} SELECT doc_id, literal::INTEGER AS literal, quote, key_name, value FROM a",
        "entropy": f"""WITH {sql_assignments()} SELECT doc_id, literal::INTEGER AS literal, len(list_distinct(string_split(value, '')))::INTEGER AS symbols,
          round(list_aggregate(string_split(value, ''), 'entropy'), 6) AS bits FROM a""",
        "rule_hits": f"WITH {sql_rules()} SELECT rule_idx, count(*) AS docs, min(doc_id) AS first_doc FROM documents JOIN rules ON regexp_matches(text, value_re) GROUP BY rule_idx",
        "findings": f"""WITH {found} SELECT doc_id, literal::INTEGER AS literal, key_name, rule_idx, rule_id, group_idx, secret, start::INTEGER AS start, "end"::INTEGER AS "end" FROM f""",
        "findings_by_rule": f"WITH {found} SELECT rule_idx, rule_id, count(*) AS findings, count(DISTINCT secret) AS secrets FROM f GROUP BY ALL",
        "distinct_secrets": f"WITH {found} SELECT (SELECT count(DISTINCT secret) FROM f) AS keys_found, (SELECT count(*) FROM a) AS scripts_checked, (SELECT count(*) FROM documents) AS pages_crawled",
        "positions": """WITH p AS (SELECT doc_id, hex(encode(text))[: 2 * (strlen(text) // 2)] AS h FROM documents),
          b AS (SELECT doc_id, h, regexp_extract_all(h, '..') AS bytes FROM p)
          SELECT doc_id, (len(list_filter(bytes, lambda x: x = '0A')) + 1)::INTEGER AS line, (len(bytes) - coalesce(list_max(list_filter(range(1, len(bytes) + 1), lambda i: bytes[i] = '0A')), 0) + 1)::INTEGER AS column FROM b""",
        "redacted": f"WITH {found} SELECT doc_id, literal::INTEGER AS literal, group_idx, CASE WHEN strlen(secret) <= 4 THEN repeat('•', strlen(secret)) ELSE left(secret, 4) || repeat('•', strlen(secret) - 4) END AS shown FROM f",
        "json_report": f"""WITH {found} SELECT to_json(struct_pack("column" := start + 1, key_name := key_name, line := 1, rule_id := rule_id, script_url := 'doc:' || doc_id, secret := secret))::VARCHAR AS value FROM f""",
        "graphical_report": f"""WITH {found}, r AS (SELECT *, CASE WHEN strlen(secret) <= 4 THEN repeat('•', strlen(secret)) ELSE left(secret, 4) || repeat('•', strlen(secret) - 4) END AS shown FROM f)
          SELECT '🔑 ' || rule_id || ': ' || description || chr(10) || 'Found key "' || shown || '" in script doc:' || doc_id || ' (1:' || (start + 1) || ')' || chr(10) || chr(10) ||
          '   Rule ID:      ' || rule_id || chr(10) || '   Script URL:   doc:' || doc_id || chr(10) || '   API Key Name: ' || coalesce(key_name, '<None>') || chr(10) ||
          '   Secret:       ' || shown || chr(10) || '   Line:         1' || chr(10) || '   Column:       ' || (start + 1) || chr(10) AS value FROM r""",
        "rule_table": f"WITH {sql_rules()} SELECT rule_idx, rule_id, n_groups, name_re IS NOT NULL AS split, min_entropy::DOUBLE AS min_entropy FROM rules",
        "synthetic_findings": f"""WITH {synthetic} SELECT case_id, rule_idx, rule_id, group_idx, secret, (span_start + start)::INTEGER AS start, (span_start + "end")::INTEGER AS "end" FROM f""",
        "crawl_depth": walk,
        "budgeted_frontier": f"WITH {LINKS} SELECT url AS page_url, href, i::INTEGER AS place FROM l WHERE i <= 3",
        "crawl_site": walk,
    }
