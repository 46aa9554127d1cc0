"""URL1-URL9 against the standard library on hand-picked traps and random strings."""

import re
from urllib.parse import unquote, urldefrag, urljoin, urlparse

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from crawlscope.functions import urls as U
from crawlscope.operators import links as L

# URL -> its normal form, written out by hand
TRAPS = {
    "https://Example.COM/a%2Fb/c": "https://example.com/a/b/c",
    "https://example.com/a+b": "https://example.com/a+b",
    "https://example.com/%zz/x": "https://example.com/%25zz/x",
    "https://example.com/w%C3%A4rmepumpe": "https://example.com/w%C3%A4rmepumpe",
    "https://example.com/wärmepumpe": "https://example.com/w%C3%A4rmepumpe",
    "https://example.com/f(1)": "https://example.com/f%281%29",
    "HTTP://EX.com": "http://ex.com/",
    "https://example.com/a;p=1?q=a b&x=%41#frag": "https://example.com/a;p=1?q=a%20b&x=A",
    "https://example.com/path/?": "https://example.com/path/",
    "https://example.com/Pfad/Produkte": "https://example.com/Pfad/Produkte",
    "https://example.com/a b/c?d=e f": "https://example.com/a%20b/c?d=e%20f",
    "https://example.com/%C3": "https://example.com/%EF%BF%BD",
    "https://example.com:8080/x": "https://example.com:8080/x",
    "https://example.com/a/b;c/d;e": "https://example.com/a/b;c/d;e",
}


def _run(spark, values, expr):
    df = spark.createDataFrame([(v,) for v in values], "u string")
    return [r[0] for r in df.select(expr(F.col("u"))).collect()]


def test_normalize_matches_urllib_on_traps(spark):
    assert _run(spark, list(TRAPS), U.normalize) == list(TRAPS.values())


def test_normalize_is_idempotent(spark):
    once = _run(spark, list(TRAPS), U.normalize)
    assert _run(spark, once, U.normalize) == once


_chars = st.sampled_from(list("abcXYZ019/-._~%+ ;=?&:@!$'()*,äé#"))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(_chars, min_size=0, max_size=12), min_size=1, max_size=8))
def test_normalize_random_paths(spark, paths):
    urls = ["https://Host.example/" + p for p in paths]
    for url, normal in zip(urls, _run(spark, urls, U.normalize)):
        old, new = urlparse(urldefrag(url)[0]), urlparse(normal)
        # the same path and query when decoded, in unreserved characters, escapes and those kept
        assert unquote(new.path) == (unquote(old.path) or "/") and unquote(new.query) == unquote(old.query)
        assert new.params == old.params and (new.scheme, new.netloc, new.fragment) == ("https", "host.example", "")
        assert re.fullmatch(r"(?:[\w.~/:@!$&'*+,;=?-]|%[0-9A-F]{2})*", new.path + new.query, re.A)


RESOLVE = [
    ("https://h.example/a/b", "/x"),
    ("https://h.example/a/b", "x"),
    ("https://h.example/x/y", "p//q"),
    ("https://h.example/x//y/", "p//"),
    ("https://h.example/a/b/", "x/y"),
    ("https://h.example/a/b", "../x"),
    ("https://h.example/a/b/c", "./x/../y"),
    ("https://h.example/a/b", "?q=1"),
    ("https://h.example/a/b?z", "#top"),
    ("https://h.example/a/b", "//other.example/p"),
    ("https://h.example/a/b", "https://other.example/p#f"),
    ("https://h.example", "x"),
    ("https://h.example/a/b", "/../x"),
]


def test_resolve_matches_urljoin(spark):
    df = spark.createDataFrame(RESOLVE, "b string, h string")
    got = [r[0] for r in df.select(U.resolve(F.col("b"), F.col("h"))).collect()]
    assert got == [urldefrag(urljoin(b, h))[0] for b, h in RESOLVE]
    staged = U.resolve_df(df, "b", "h", "r").select("r").collect()
    assert [r[0] for r in staged] == got


def test_host_projections(spark):
    hosts = ["www.site.example", "test.site.example:8080", "site.example", "solar.site.example", "10.0.0.1",
             "a.b.c.d.example", "prod.www.site.example"]
    df = spark.createDataFrame([(h,) for h in hosts], "h string")
    rows = df.select(U.environment(F.col("h")), U.without_environment(F.col("h")),
                     U.registrable_domain(F.col("h"))).collect()
    assert [tuple(r) for r in rows] == [
        ("", "site.example", "site.example"),
        ("test", "site.example", "site.example"),
        ("", "site.example", "site.example"),
        ("", "solar.site.example", "site.example"),
        ("", "10.0.0.1", "10.0.0.1"),
        ("", "a.b.c.d.example", "d.example"),
        ("prod", "www.site.example", "site.example"),
    ]


def test_same_host_and_files(spark):
    df = spark.createDataFrame([("WWW.X.example:443", "www.x.example", "https://x.example/Doc.PDF?v=2"),
                                ("", "", "https://x.example/a.html"),
                                ("a.example", "b.example", "https://x.example/dir.pdf/")],
                               "a string, b string, u string")
    rows = df.select(U.same_host(F.col("a"), F.col("b")), U.is_file(F.col("u")), U.file_extension(F.col("u"))).collect()
    assert [tuple(r) for r in rows] == [(True, True, "pdf"), (False, False, "html"), (False, False, "")]


def test_paths_without_params_and_odd_hosts(spark):
    assert _run(spark, ["https://h/f.pdf;jsessionid=1?x", "https://h/a.b/c;d.pdf", "https://h/x.TAR"], U.is_file) == [True, False, True]
    assert _run(spark, ["https://h/f.pdf;jsessionid=1", "https://h/a.b/c"], U.file_extension) == ["pdf", ""]
    assert _run(spark, ["www.example.com.", ".a.example.com:80", "10.0.0.1", "localhost"], U.registrable_domain) == ["example.com", "example.com", "10.0.0.1", "localhost"]


def test_link_base_after_a_redirect(spark):
    rows = [("https://www.h.example/a", "https://h.example/b/c;p?q=1#f", "https://www.h.example/b/c?q=1"), ("https://h.example/a", "", "https://h.example/a"), ("https://h.example/a", None, "https://h.example/a")]
    df = spark.createDataFrame(rows, "u string, r string, want string")
    assert df.where(~L.link_base(F.col("u"), F.col("r")).eqNullSafe(F.col("want"))).count() == 0
