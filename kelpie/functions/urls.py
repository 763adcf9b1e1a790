"""URLs: resolution, canonical form, hosts and the fixed skip lists."""

from __future__ import annotations

import re
from functools import lru_cache
from ipaddress import ip_address
from urllib.parse import quote, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query keys that tell pages apart.
KEPT_KEYS = ("tab", "tabid", "tab_id", "tab-id", "id", "page", "page_id", "page-id")
#: Hosts whose scripts are not fetched.
SKIP_DOMAINS = ("ajax.googleapis.com", "apis.google.com", "youtube.com", "www.googletagmanager.com", "assets.calendly.com", "cdn.jsdelivr.net", "unpkg.com", "events.framer.com")
#: Parts of paths whose scripts are not fetched.
SKIP_PATHS = ("jquery", "react", "lodash", "unpkg")
#: Path endings of links that are no pages.
SKIP_ENDINGS = (".pdf", ".png", ".jpg")
#: Beginnings of links that are no pages.
SKIP_SCHEMES = ("#", "mailto:", "javascript:")
DEFAULT_PORTS = {"http": 80, "https": 443, "ftp": 21, "ws": 80, "wss": 443}
SAFE = "%!$&'()*+,;=:@/~-._[]|"


def normalize(url: str) -> str | None:
    """An absolute URL in one form: scheme and host in lower case, no default port, a path, escapes where needed."""
    try:
        p = urlsplit(re.sub(r"[\t\r\n]", "", url.strip()))
        if not p.scheme:
            return None
        if p.scheme not in DEFAULT_PORTS:
            return urlunsplit(p)
        host = (p.hostname or "").encode("idna").decode()
        if not host or re.search(r"[\s<>^|%]", host):
            return None
        port = "" if p.port in (None, DEFAULT_PORTS[p.scheme]) else f":{p.port}"
        user = p.netloc.rpartition("@")[0]
        path = quote(p.path.replace("\\", "/"), safe=SAFE) or "/"
        return urlunsplit((p.scheme, (user + "@" if user else "") + (f"[{host}]" if ":" in host else host) + port, path, quote(p.query, safe=SAFE + "?/`{}\\^"), quote(p.fragment, safe=SAFE + "?/{}\\^#")))
    except (ValueError, UnicodeError):
        return None


def resolve_one(root: str | None, href: str | None) -> str | None:
    if href is None:
        return None
    try:
        return normalize(urljoin(root or "", href.strip()))
    except ValueError:
        return None


def resolve(root: Column, href: Column) -> Column:
    """A link against the site's root, not the page's own URL; null where it can't be read."""

    @F.pandas_udf("string")
    def read(roots: pd.Series, hrefs: pd.Series) -> pd.Series:
        one = lru_cache(100_000)(resolve_one)
        return pd.Series([one(r, h) for r, h in zip(roots, hrefs, strict=True)], dtype=object)

    # else the optimizer puts a copy of the call under every filter on its result
    return read.asNondeterministic()(root, href)


def site_root(url: Column) -> Column:
    """scheme://host[:port]/ of an absolute URL."""
    return F.concat(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1), F.lit("/"))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Without fragment, and of the query only the kept keys, as key=value one after another with nothing between."""
    base = F.regexp_extract(url, r"^[^?#]*", 0)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda p: F.substring_index(p, "=", 1).isin(*KEPT_KEYS))
    pairs = F.transform(kept, lambda p: F.when(F.contains(p, F.lit("=")), p).otherwise(F.concat(p, F.lit("="))))
    joined = F.array_join(pairs, "")
    return F.when(joined == "", base).otherwise(F.concat(base, F.lit("?"), joined))


def with_scheme(url: Column) -> Column:
    """https:// in front where no scheme is given."""
    return F.when(F.instr(url, "://") == 0, F.concat(F.lit("https://"), url)).otherwise(url)


def entry_url(url: str) -> str:
    """The URL a crawl starts from; an address instead of a domain is an error."""
    got = normalize(url.strip().rstrip("/"))
    name = urlsplit(got).hostname if got else None
    if not got or not name:
        raise ValueError(f"not an absolute URL with a domain: {url!r}")
    try:
        ip_address(name)
    except ValueError:
        return got
    raise ValueError(f"the host is an address, not a domain: {url!r}")


def is_page_link(href: Column) -> Column:
    """Whether a trimmed href may lead to a page, before it is resolved."""
    ok = href != ""
    for s in SKIP_SCHEMES:
        ok &= ~F.startswith(href, F.lit(s))
    return ok


def is_page_path(url: Column) -> Column:
    ok = F.lit(True)
    for e in SKIP_ENDINGS:
        ok &= ~F.endswith(path(url), F.lit(e))
    return ok


def is_skipped_script(url: Column) -> Column:
    """Remote scripts that are not fetched: known hosts, and library names in the path."""
    skipped = host(url).isin(*SKIP_DOMAINS)
    for s in SKIP_PATHS:
        skipped |= F.contains(path(url), F.lit(s))
    return skipped
