import math
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from kelpie.functions import urls
from kelpie.functions.strings import column_of, line_of, redact, shannon_entropy
from pyspark.sql import functions as F


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column.alias("x")).first().x


def entropy(s):
    b = s.encode()
    return -sum(n / len(b) * math.log2(n / len(b)) for n in Counter(b).values()) if b else 0.0


def test_entropy(spark):
    cases = ["hello world", "", "a", "ab", "é", "日本語", "x" * 300]
    rows = spark.createDataFrame([(c,) for c in cases], "v string").select("v", shannon_entropy(F.col("v")).alias("e")).collect()
    for r in rows:
        assert r.e == pytest.approx(entropy(r.v), abs=1e-9)
    assert abs(next(r.e for r in rows if r.v == "hello world") - 2.8453512) < 1e-5


def test_redaction(spark):
    cases = {"": "", "abc": "•••", "abcd": "••••", "abcdef": "abcd••", "éé": "••••", "aééb": "aé•••", "日本語": "日••••••"}
    rows = spark.createDataFrame([(c,) for c in cases], "v string").select("v", redact(F.col("v")).alias("r")).collect()
    assert {r.v: r.r for r in rows} == cases


def test_positions(spark):
    s = "ab\né日\nxyz"
    for offset in range(len(s.encode()) + 1):
        prefix = s.encode()[:offset]
        got = spark.createDataFrame([(s, offset)], "s string, o int").select(line_of(F.col("s"), F.col("o")).alias("l"), column_of(F.col("s"), F.col("o")).alias("c")).first()
        assert (got.l, got.c) == (prefix.count(b"\n") + 1, len(prefix.split(b"\n")[-1]) + 1)


CANON = {
    "https://a.b/c#top": "https://a.b/c",
    "https://a.b/c?utm=1&page=2&x=3": "https://a.b/c?page=2",
    "https://a.b/c?id=1&page=2#f": "https://a.b/c?id=1page=2",
    "https://a.b/c?ref=1": "https://a.b/c",
    "https://a.b/c?tab": "https://a.b/c?tab=",
    "https://a.b/": "https://a.b/",
}


def test_canonical(spark):
    rows = spark.createDataFrame([(u,) for u in CANON], "v string").select("v", urls.canonical(F.col("v")).alias("c")).collect()
    assert {r.v: r.c for r in rows} == CANON
    for c in set(CANON.values()):
        if "1page" not in c:
            assert one(spark, urls.canonical(F.col("v")), c) == c


def test_resolution():
    r = urls.resolve_one
    assert r("https://a.b/", "c/d") == "https://a.b/c/d"
    assert r("https://a.b/", "/x y") == "https://a.b/x%20y"
    assert r("https://A.b:443/", "?q=1") == "https://a.b/?q=1"
    assert r("https://a.b/", "//C.D/e") == "https://c.d/e"
    assert r("https://a.b/", "für") == "https://a.b/f%C3%BCr"
    assert r("https://a.b/", "http://[bad") is None and r("https://a.b/", None) is None


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=30))
def test_normalizing_twice_changes_nothing(tail):
    once = urls.normalize("https://a.b/" + tail)
    assert once is None or urls.normalize(once) == once


def test_entry():
    assert urls.entry_url(" https://a.b/// ") == "https://a.b/"
    for bad in ("https://127.0.0.1/", "nothing", "https://[::1]/"):
        with pytest.raises(ValueError):
            urls.entry_url(bad)


def test_skips(spark):
    cases = {"https://unpkg.com/x": True, "https://x.unpkg.com/x": False, "https://a.b/jquery.js": True, "https://a.b/JQuery.js": False, "https://a.b/x?react": False}
    rows = spark.createDataFrame([(u,) for u in cases], "v string").select("v", urls.is_skipped_script(F.col("v")).alias("s")).collect()
    assert {r.v: r.s for r in rows} == cases
    assert one(spark, urls.with_scheme(F.col("v")), "a.b") == "https://a.b"
