import json

import pytest
from kelpie import cli
from kelpie.plans import crawl as c
from kelpie.plans.scan import Collector, scan_pages, scan_text
from kelpie.plans.sites import site_pages
from kelpie.report import reports
from kelpie.sources import web
from kelpie.streaming import stream
from pyspark.sql import functions as F

AWS = "AKIA" + "QWERTYUIOPASDFGH"


def pages(spark, site):
    rows = [(u, "".join(f'<a href="{x}">l</a>' for x in links) + f'<script>var k = "{u}"</script>') for u, links in site.items()]
    return spark.createDataFrame(rows, "url string, html string")


S = "https://s.com/"


def walk(spark, site, **options):
    got = c.crawl(spark, pages(spark, site), S, c.CrawlConfig(user_agent=None, **options))
    return {r.url.removeprefix(S): r.depth for r in got.visited.collect()}, got


def test_crawl_follows_levels_and_stays_on_the_host(spark):
    site = {S: ["a", "b", "https://other.com/"], S + "a": ["b", "c"], S + "b": ["", "#x"], S + "c": ["a", "d"], S + "d": ["x", "y"], "https://other.com/": ["q", "r"]}
    visited, got = walk(spark, site)
    assert visited == {"": 0, "a": 1, "b": 1, "c": 2, "d": 3}
    assert got.succeeded and {r.url for r in got.errors.collect()} == {S + "x", S + "y"}
    assert got.scripts.count() == 5


def test_budget_of_pages_that_share_a_url(spark):
    rows = [(S, "<script>1</script>" + "".join(f'<a href="{k}{x}">l</a>' for x in "abcd")) for k in (1, 2)] + [(S + "x", '<a href="y">l</a>'), (S, None)]
    got = c.budgeted(spark.createDataFrame(rows, "url string, html string"), 3).select("page_url", "href", "place").collect()
    assert sorted(map(tuple, got)) == [(S, f"{k}{x}", at) for k in (1, 2) for at, x in enumerate("abc", 1)] + [(S + "x", "y", 1)]


def test_single_link_pages_skip_whitelist_and_budget(spark):
    site = {S: ["https://other.com/"], "https://other.com/": []}
    assert walk(spark, site)[0] == {"": 0, "https://other.com/": 1}
    assert walk(spark, site, strict_single_link=True)[0] == {"": 0}


def test_budget(spark):
    site = {S: ["a", "b", "c"], S + "a": [], S + "b": [], S + "c": []}
    assert walk(spark, site, max_walks=3)[0] == {"": 0, "a": 1, "b": 1}


def test_discovered_links_use_up_budget(spark):
    site = {S: ["a", "https://other.com/1", "https://other.com/2"], S + "a": ["b", "c"], S + "b": [], S + "c": []}
    assert walk(spark, site, max_walks=4)[0] == {"": 0, "a": 1, "b": 2, "c": 2}
    assert walk(spark, site, max_walks=4, count_discovered=True)[0] == {"": 0, "a": 1}


def test_shared_cache(spark):
    site = {S: ["a", "b"], S + "a": [], S + "b": []}
    _, first = walk(spark, site)
    again = c.crawl(spark, pages(spark, site), S, c.CrawlConfig(user_agent=None), seen=first.seen)
    assert again.visited.count() == 0 and not again.succeeded


def test_config():
    config = c.CrawlConfig()
    assert len(config.all_headers()) == 6 and config.with_header("User-Agent", "x").all_headers()[0] == ("User-Agent", "x")
    assert len(config.with_header("User-Agent", "x").all_headers()) == 6 and len(config.with_headers([("User-Agent", "y")]).all_headers()) == 7
    assert len(config.with_random_ua(False).all_headers()) == 5
    with pytest.raises(ValueError):
        config.with_max_walks(0)


def test_collector_options():
    asked = Collector().with_random_ua(True)
    assert asked.user_agent in web.USER_AGENTS and asked.with_random_ua(True).user_agent is None and asked.with_random_ua(False).user_agent is None
    assert asked.with_headers([("A", "b")]).with_headers([("C", "d")]).requests().headers == (("User-Agent", asked.user_agent), ("A", "b"), ("C", "d"))


def test_scan_reports_and_summary(spark, tmp_path):
    source = f'var a = 1;\nvar k = "{AWS}";'
    html = f"<script>{source}</script><script src='/r.js'></script><script>let bad = '</script>"
    fetched = spark.createDataFrame([("https://s.com/r.js", f'x("{AWS}")', "text/javascript"), ("https://s.com/q.js", "1", "text/plain")], "script_url string, source string, content_type string")
    table = spark.createDataFrame([(S, html, None), (S + "2", "<p>", "text/html"), (S + "3", html, "image/png")], "url string, html string, content_type string")
    got = scan_pages(table, fetched=fetched)
    rows = sorted((r.script_url, r.rule_id, r.key_name, r.secret, r.line, r.column) for r in got.findings.collect())
    # the place is that of the quote, one left of the secret
    assert rows == [("https://s.com/", "aws-access-token", "k", AWS, 2, 9), ("https://s.com/r.js", "aws-access-token", None, AWS, 1, 3)]
    assert got.errors.count() == 1
    assert got.summary().first().asDict() == {"keys_found": 1, "scripts_checked": 3, "pages_crawled": 2}
    lines = [json.loads(r.value) for r in reports.json_lines(got.findings).collect()]
    assert all(list(x) == ["column", "key_name", "line", "rule_id", "script_url", "secret"] for x in lines) and {x["key_name"] for x in lines} == {"k", None}
    text = reports.graphical(got.findings.where("key_name = 'k'"), redacted=True).first().value
    assert text.startswith("🔑 aws-access-token: ") and "AKIA" + "•" * 16 in text and AWS not in text and "API Key Name: k" in text
    assert reports.summary_line(got.summary(), 1.234).first().value == "Found 1 key(s) across 3 script(s) and 2 page(s) in 1.23s"
    reports.write_json(got.findings, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    r = reports.json_reporter(str(tmp_path / "k"))
    r.report(got.findings)
    assert r.keys_found == 1 and spark.read.text(str(tmp_path / "k")).count() == 2
    assert reports.exit_code(got.errors) == 0


def test_snippets(spark):
    source = "\n".join(f"l{k}" for k in range(1, 10))
    df = spark.createDataFrame([("r", "d", None, "s", 5, 1, "u", source), ("r", "d", None, "s", 1, 1, "u", "x" * 200)], "rule_id string, description string, key_name string, secret string, line int, column int, script_url string, source string")
    first, second = (r.value for r in reports.graphical(df, source="source").collect())
    assert "  2 l2\n" in first and "  8 l8" in first and "l9" not in first and "<None>" in first
    assert "xxx" not in second


def test_text_scan_and_sites(spark):
    docs = spark.createDataFrame([(1, 'token = "0123456789abcdef0123" colour = \'red\''), (2, None), (3, "")], "doc_id int, text string")
    assert {(r.doc_id, r.rule_id) for r in scan_text(docs).collect()} == {(1, "generic-api-key")}
    sites = spark.createDataFrame([("one", "https://a.com"), ("two", "https://b.com/x")], "name string, website string")
    table = spark.createDataFrame([("https://a.com/1", ""), ("https://a.com/1#f", ""), ("https://a.com/2", ""), ("https://c.com/", "")], "url string, html string")
    assert {r.url for r in site_pages(sites, table, 1).collect()} == {"https://a.com/1"}


def test_site_list(spark, tmp_path):
    (tmp_path / "s.csv").write_text("Name,Website\na,a.com\nMillion,m.com\nb,http://b.com\n")
    assert {tuple(r) for r in web.site_list(spark, str(tmp_path / "s.csv")).collect()} == {("a", "https://a.com"), ("b", "http://b.com")}
    assert web.parse_header(" X-A : b:c ") == ("X-A", "b:c")
    with pytest.raises(ValueError):
        web.parse_header("nothing")


def test_http_source(spark):
    import http.server
    import threading

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            ok = self.path != "/missing"
            body = b"<a href=/x>x</a>" if ok else b""
            self.send_response(200 if ok else 404)
            self.send_header("Content-Type", "text/javascript" if self.path.endswith(".js") else "text/html; charset=utf-8")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    got = web.http_table(spark, [f"{base}/a", f"{base}/s.js", f"{base}/missing"], [("User-Agent", "t")]).cache()
    assert {r.url for r in web.fetched_pages(got).collect()} == {f"{base}/a"}
    assert {r.script_url for r in web.fetched_scripts(got).collect()} == {f"{base}/s.js"}
    assert {(r.url, r.kind) for r in web.fetch_errors(got).collect()} == {(f"{base}/s.js", "NotHtml"), (f"{base}/missing", "WalkFailed")}
    server.shutdown()


class Site:
    """A site on a local port: answers by path, and what was asked."""

    def __init__(self, answers):
        import http.server
        import threading

        self.asked = asked = []

        class Handler(http.server.BaseHTTPRequestHandler):
            def do_GET(self):
                asked.append((self.path, {k.lower(): v for k, v in self.headers.items()}))
                kind, body, *more = answers.get(self.path, (None, ""))
                self.send_response(200 if kind else 404)
                self.send_header("Content-Type", kind or "text/plain")
                self.send_header("Content-Length", str(len(body.encode())))
                for name, value in more:
                    self.send_header(name, value)
                self.end_headers()
                self.wfile.write(body.encode())

            def log_message(self, *_):
                pass

        self.server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.url = f"http://localhost:{self.server.server_port}/"


def test_live_crawl_and_remote_scripts(spark, capsys):
    html, js = "text/html; charset=utf-8", "text/javascript"
    site = Site({
        "/": (html, "<a href=/a>a</a><a href=/b>b</a><a href=https://other.example/>o</a><script src=/jquery.js></script>", ("Set-Cookie", "k=1; Path=/")),
        "/a": (html, "<a href=/c>c</a><a href=/text>t</a><script src='/app.js'></script>"), "/b": (html, "<a href=/a>a</a><a href=/gone>g</a><a href=/empty>e</a>"),
        "/c": (html, "<p>end</p><script src=/app.js></script><script src=/note.txt></script>"), "/text": ("text/plain", "x"), "/empty": (html, ""),
        "/app.js": (js, f'var k = "{AWS}";'), "/note.txt": ("text/plain", f'var n = "{AWS[:-1]}Z";'),
    })
    config = c.CrawlConfig(user_agent="agent").with_header("X-Own", "1").with_cookie_jar(True).with_timeout(5).with_timeout_connect(5).with_close_channel(True)
    walked = c.crawl(spark, None, site.url, config)
    assert sorted((r.url.removeprefix(site.url), r.depth) for r in walked.visited.collect()) == [("", 0), ("a", 1), ("b", 1), ("c", 2)]
    assert {(r.url.removeprefix(site.url), r.kind) for r in walked.errors.collect()} == {("text", "NotHtml"), ("gone", "WalkFailed"), ("empty", "NoContent")}
    assert walked.succeeded and walked.done
    paths = [p for p, _ in site.asked]
    assert len(paths) == len(set(paths)) and "/app.js" not in paths
    assert all(h["user-agent"] == "agent" and h["x-own"] == "1" and h["dnt"] == "1" for _, h in site.asked)
    assert all((h.get("cookie") == "k=1") == (p != "/") for p, h in site.asked)
    site.asked.clear()
    assert cli.main([site.url, "-U", "-H", "X-Own: 1", "--timeout", "5"], spark) == 0
    out = capsys.readouterr().out
    assert AWS in out and f"{site.url}app.js" in out and "Found 1 key(s) across 1 script(s) and 4 page(s)" in out
    scripts = [(p, h) for p, h in site.asked if "." in p]
    assert {p for p, _ in scripts} == {"/app.js", "/note.txt"} and len(scripts) == 2 and all("x-own" not in h for _, h in scripts)
    site.asked.clear()
    assert cli.main([site.url, "-U", "-H", "X-Own: 1", "--headers-for-scripts"], spark) == 0
    assert all(h["x-own"] == "1" for p, h in site.asked if "." in p)
    site.server.shutdown()


def test_fetching_bounds_and_errors(spark):
    site = Site({"/big": ("text/html", "x" * 5000), "/ok": ("text/html; charset=nonsense", "é")})
    urls = spark.createDataFrame([(f"{site.url}{p}", k) for k, p in enumerate(["big", "ok", "none"])] + [("http://localhost:1/", 3), ("nothing", 4)], "url string, k int")
    got = {r.k: r for r in web.fetched(urls, web.Requests(timeout=3, max_bytes=1000)).collect()}
    assert got[0].body is None and "more than 1000 bytes" in got[0].error and got[1].body == "é" and got[2].status == 404 and got[3].error and got[4].error
    site.server.shutdown()


def test_walks_fail_with_their_only_links(spark):
    """A page fails if its only link does, or if all the pages it leads to that could be read do."""
    assert not walk(spark, {S: ["gone"]})[1].succeeded
    assert not walk(spark, {S: ["a"], S + "a": ["b"], S + "b": ["gone"]})[1].succeeded
    assert not walk(spark, {S: ["a", "b"], S + "a": ["gone"], S + "b": ["lost"]})[1].succeeded
    assert walk(spark, {S: ["a", "b"], S + "a": ["gone"], S + "b": []})[1].succeeded
    assert walk(spark, {S: ["gone", "lost"]})[1].succeeded
    assert not walk(spark, {"https://t.com/": []})[1].succeeded


def test_several_entries_share_a_cache(spark, tmp_path, capsys):
    site = {S: ["a", "b"], S + "a": ["b", "/"], S + "b": ["a", "c"], S + "c": []}
    first, second = c.crawl_many(spark, pages(spark, site), [S + "b", S + "a"], c.CrawlConfig(user_agent=None))
    assert {r.url for r in first.visited.collect()} == set(site) and second.visited.count() == 0
    assert c.crawl(spark, pages(spark, site), S + "a", seen=c.no_cache(spark)).visited.count() == 4
    table = str(tmp_path / "p")
    spark.createDataFrame([("https://s.com/", f'<script>k = "{AWS}"</script>'), ("https://t.com/", f'<script>k = "{AWS}"</script>')], "url string, html string").write.parquet(table)
    assert cli.main(["s.com", "t.com", "--pages", table, "-q"], spark) == 0
    assert "Found 1 key(s) across 2 script(s) and 2 page(s)" in capsys.readouterr().out
    (tmp_path / "sites.csv").write_text("Name,Website\none,s.com\ntwo,https://t.com\n")
    assert cli.main(["--sites", str(tmp_path / "sites.csv"), "--pages", table, "-f", "json"], spark) == 0
    assert capsys.readouterr().out.count(AWS) == 2
    with pytest.raises(SystemExit):
        cli.main(["--pages", table], spark)
    assert [cli.log_level(v, q) for v, q in ((0, 0), (1, 0), (5, 0), (0, 1), (0, 9))] == ["WARN", "INFO", "DEBUG", "ERROR", "OFF"]


def test_console_report_redacts_and_prints_everything(spark, capsys):
    df = spark.createDataFrame([("r", "d", None, f"{AWS}{k}", 1, 1, "u") for k in range(1200)], "rule_id string, description string, key_name string, secret string, line int, column int, script_url string")
    r = reports.graphical_reporter(None, redacted=True)
    r.report(df)
    out = capsys.readouterr().out
    assert out.count("Found key") == 1200 and AWS not in out and r.keys_found == 1200
    source = 'var a = "var b";\nlet x = 1;'
    shown = spark.createDataFrame([(source, 1)], "s string, line int").select(reports.snippet(F.col("s"), F.col("line"), True).alias("x")).first().x
    assert shown == '  1 \x1b[35mvar\x1b[0m a = "var b";\n  2 \x1b[35mlet\x1b[0m x = 1;'


def test_stream(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    rows = [(1, S, f'<script>k = "{AWS}"</script>'), (2, S + "#again", f'<script>k = "{AWS}"</script>'), (3, S + "2", f'<script>k = "{AWS}"</script>')]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(source))
    once = stream.unseen_pages(stream.read_pages(spark, str(source)))
    q = stream.run(once.select("url", "html"), lambda df, n: df.select("script_url", "secret").write.mode("overwrite").parquet(f"{out}/{n}"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(f"{out}/*").count() == 2


def test_cli(spark, tmp_path, capsys):
    table = str(tmp_path / "p")
    spark.createDataFrame([("https://s.com/", f'<a href=/a>a</a><script>k = "{AWS}"</script>'), ("https://s.com/a", "<p>")], "url string, html string").write.parquet(table)
    assert cli.main(["s.com", "--pages", table, "-r", "-U", "-H", "A: b"], spark) == 0
    out = capsys.readouterr().out
    assert "AKIA••" in out and "Found 1 key(s) across 1 script(s) and 2 page(s)" in out
    assert cli.main(["s.com", "--pages", table, "-f", "json", "-o", str(tmp_path / "o")], spark) == 0
    assert json.loads(spark.read.text(str(tmp_path / "o")).first().value)["secret"] == AWS
    assert cli.main(["https://none.com", "--pages", table, "-f", "json"], spark) == 1


def test_crawl_of_deep_and_wide_pages(spark):
    """Places neither grow with the depth nor collide on pages with thousands of elements."""
    site = {S if k == 0 else f"{S}p{k}": [f"/p{k + 1}"] for k in range(19)}
    got = c.crawl(spark, pages(spark, site), S, c.CrawlConfig(user_agent=None)).visited.collect()
    assert sorted(r.depth for r in got) == list(range(19))
    # the first page's links come before the second's, however many elements it has
    wide = spark.createDataFrame([(S, "<a href='/a'>a</a><a href='/b'>b</a>"), (f"{S}a", "<p>x</p>" * 5000 + "<a href='/y'>y</a><a href='/z'>z</a>"), (f"{S}b", "<a href='/v'>v</a><a href='/w'>w</a>"), (f"{S}y", ""), (f"{S}v", "")], "url string, html string")
    crawled = c.crawl(spark, wide, S, c.CrawlConfig(user_agent=None, max_walks=4))
    assert {r.url for r in crawled.visited.collect()} == {S, f"{S}a", f"{S}b", f"{S}y"}
