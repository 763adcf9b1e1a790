"""Sources from the web: site lists, headers, and a Spark data source that fetches URLs."""

from __future__ import annotations

import http.client
import json
import random
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass
from http.cookiejar import CookieJar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from kelpie.functions.urls import host, with_scheme

#: The user agents that requests are sent with.
USER_AGENTS = (
    "Windows 10/ Edge browser: Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/42.0.2311.135 Safari/537.36 Edge/12.246",
    "Windows 7/ Chrome browser: Mozilla/5.0 (Windows NT 6.1; WOW64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/47.0.2526.111 Safari/537.36",
    "Mac OS X10/Safari browser: Mozilla/5.0 (Macintosh; Intel Mac OS X 10_11_2) AppleWebKit/601.3.9 (KHTML, like Gecko) Version/9.0.2 Safari/601.3.9",
    "Linux PC/Firefox browser: Mozilla/5.0 (X11; Ubuntu; Linux x86_64; rv:15.0) Gecko/20100101 Firefox/15.0.1",
    "Chrome OS/Chrome browser: Mozilla/5.0 (X11; CrOS x86_64 8172.45.0) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/51.0.2704.64 Safari/537.36",
    "Mozilla/5.0 (Windows NT 6.1; WOW64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/47.0.2526.111 Safari/537.36",
)


def random_user_agent(seed: int | None = None) -> str:
    return random.Random(seed).choice(USER_AGENTS)


FETCHED = "url string, status int, content_type string, content_length long, body string, error string, cookies string"
FETCHED_NAMES = [c.split()[0] for c in FETCHED.split(", ")]


def site_list(spark: SparkSession, path: str) -> DataFrame:
    """name, website of a CSV file with the header Name,Website; malformed rows and the site named million are left out."""
    rows = spark.read.schema("Name string, Website string").csv(path, header=True, mode="DROPMALFORMED")
    return rows.where((F.lower("Name") != "million") & F.col("Website").isNotNull()).select(F.col("Name").alias("name"), with_scheme(F.col("Website")).alias("website"))


def parse_header(text: str) -> tuple[str, str]:
    """Name and value of a header given as "Name: value"."""
    name, colon, value = text.partition(":")
    if not colon:
        raise ValueError(f"a header needs a colon: {text!r}")
    return name.strip(), value.strip()


@dataclass(frozen=True)
class Requests:
    """How URLs are fetched. Bodies of more than max_bytes are errors; per_host tasks share the URLs of a host."""

    headers: tuple[tuple[str, str], ...] = ()
    timeout: float | None = None
    timeout_connect: float | None = None
    cookies: bool = False
    max_bytes: int = 64 << 20
    per_host: int = 4


def opener(requests: Requests, jar: CookieJar) -> urllib.request.OpenerDirector:
    """Opens URLs with a time to connect and one to wait for data, and with cookies where they are kept."""
    connect, read = requests.timeout_connect or requests.timeout or 10.0, requests.timeout or 10.0

    def timed(kind: type) -> type:
        class Timed(kind):
            def connect(self) -> None:
                self.timeout = connect
                super().connect()
                self.sock.settimeout(read)

        return Timed

    class Http(urllib.request.HTTPHandler):
        def http_open(self, request):  # noqa: ANN001, ANN202
            return self.do_open(timed(http.client.HTTPConnection), request)

    class Https(urllib.request.HTTPSHandler):
        def https_open(self, request):  # noqa: ANN001, ANN202
            return self.do_open(timed(http.client.HTTPSConnection), request)

    return urllib.request.build_opener(Http, Https, *([urllib.request.HTTPCookieProcessor(jar)] if requests.cookies else []))


def fetch(url: str, requests: Requests, opened: urllib.request.OpenerDirector, cookie: str | None = None) -> tuple:
    """A row of FETCHED but for its cookies; whatever goes wrong is its error."""
    try:
        request = urllib.request.Request(url)
        for name, value in requests.headers:
            request.add_header(name, value)
        if cookie:
            request.add_header("Cookie", cookie)
        with opened.open(request) as r:
            kind, length = r.headers.get("Content-Type"), r.headers.get("Content-Length")
            raw = r.read(requests.max_bytes + 1)
            size = int(length) if length and length.isdigit() else None
            if len(raw) > requests.max_bytes:
                return url, r.status, kind, size, None, f"a body of more than {requests.max_bytes} bytes"
            try:
                body = raw.decode(r.headers.get_content_charset() or "utf-8", "replace")
            except LookupError:
                body = raw.decode("utf-8", "replace")
            return url, r.status, kind, size, body, None
    except urllib.error.HTTPError as e:
        return url, e.code, e.headers.get("Content-Type"), None, None, f"status {e.code}"
    except (OSError, ValueError, http.client.HTTPException) as e:
        return url, None, None, None, None, str(e) or type(e).__name__


def fetched(urls: DataFrame, requests: Requests = Requests()) -> DataFrame:  # noqa: B008
    """The rows of urls (url, perhaps cookie, and others) and what came of each URL, errors included.

    URLs are dealt by host, each host to per_host tasks at most, and stay on the cluster. cookies are those of the
    task's jar for the URL's host, where they are kept. Rows come out of a plan: read them once (a checkpoint).
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    own = urls.schema
    schema = StructType([*own.fields, *StructType.fromDDL(FETCHED).fields[1:]])
    arrow = to_arrow_schema(schema)
    dealt = urls.repartition(host(F.col("url")), F.pmod(F.xxhash64("url"), F.lit(requests.per_host)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        jar = CookieJar()
        opened = opener(requests, jar)
        for batch in batches:
            for row in batch.to_pylist():
                got = fetch(row["url"], requests, opened, row.get("cookie"))
                name = urllib.parse.urlsplit(row["url"]).hostname or ""
                kept = "; ".join(f"{c.name}={c.value}" for c in jar if name.endswith(c.domain.lstrip(".").removesuffix(".local"))) or row.get("cookie")
                # one row at a time: a body may be large
                yield pa.RecordBatch.from_pylist([row | dict(zip(FETCHED_NAMES, (*got, kept), strict=True))], schema=arrow)

    return dealt.mapInArrow(run, schema)


class Part(InputPartition):
    def __init__(self, urls: list[str]) -> None:
        self.urls = urls


class HttpReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.urls = json.loads(options["urls"])
        self.requests = Requests(tuple(map(tuple, json.loads(options.get("headers", "[]")))), float(options.get("timeout", 10)))
        self.per_task = int(options.get("pertask", 16))

    def partitions(self) -> list[Part]:
        return [Part(self.urls[k : k + self.per_task]) for k in range(0, len(self.urls), self.per_task)]

    def read(self, partition: Part) -> Iterator[tuple]:
        opened = opener(self.requests, CookieJar())
        for url in partition.urls:
            yield *fetch(url, self.requests, opened), None


class HttpSource(DataSource):
    """spark.read.format("kelpie_http").option("urls", json list): a row for each URL, errors included.

    For a short list on the driver; tables of URLs go through fetched().
    """

    @classmethod
    def name(cls) -> str:
        return "kelpie_http"

    def schema(self) -> str:
        return FETCHED

    def reader(self, schema) -> HttpReader:  # noqa: ARG002, ANN001
        return HttpReader(self.options)


def http_table(spark: SparkSession, urls: list[str], headers: list[tuple[str, str]] | None = None, timeout: float = 10) -> DataFrame:
    spark.dataSource.register(HttpSource)
    return spark.read.format("kelpie_http").option("urls", json.dumps(urls)).option("headers", json.dumps(headers or [])).option("timeout", timeout).load()


def is_page() -> Column:
    """Of answers: whether they are pages. Their type, if any, has html in it, and their length is not 0."""
    return F.col("error").isNull() & (F.col("content_type").isNull() | F.contains("content_type", F.lit("html"))) & (F.coalesce("content_length", F.lit(1)) != 0)


def fetched_pages(answers: DataFrame) -> DataFrame:
    """url, html, content_type of answers that are pages."""
    return answers.where(is_page()).select("url", F.col("body").alias("html"), "content_type")


def fetched_scripts(answers: DataFrame) -> DataFrame:
    """script_url, source, content_type of answers that are JavaScript."""
    return answers.where(F.col("error").isNull() & F.contains("content_type", F.lit("javascript"))).select(F.col("url").alias("script_url"), F.col("body").alias("source"), "content_type")


def fetch_errors(answers: DataFrame) -> DataFrame:
    """stage, kind, url, status, detail of answers that are no pages."""
    kind = F.when(F.col("error").isNotNull(), "WalkFailed").when(F.col("content_length") == 0, "NoContent").when(~F.contains("content_type", F.lit("html")), "NotHtml")
    return answers.withColumn("kind", kind).where("kind is not null").select(F.lit("walk").alias("stage"), "kind", "url", "status", F.coalesce("error", "content_type").alias("detail"))
