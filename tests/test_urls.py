"""URL expressions against the standard library's URL functions."""

import itertools
import random
from urllib.parse import urljoin, urlparse

import pytest
from pyspark.sql import functions as F

from siteindex.constants import CRAWL_MODES
from siteindex.functions import urls as U

BASES = [
    "https://example.com", "https://example.com/", "https://example.com/a/b/c.html?x=1#top",
    "http://user@Example.com:8080/a/b/;p?q", "https://example.com/a/b;t=1/c;u=2", "file:///srv/site/index.html",
    "https://example.com?x=1", "HTTPS://Example.com/A/", "https://example.com/a b|c/d",
]
REFERENCES = [
    "", "#", "#x", "?", "?p=2", "?p=2#y", "https:b", "http:b", "mailto:a@b.c", "//o/b", "//o",
    "../../../z", "/c/../d/./e", "/c/..", "/c/.", "..", ".", "./", "../", "g", "./g", "g/", "/g", ";x",
    "g;x", "g;x=1/../y", "g;x?y#s", "  /lead", "/trail ", "/a\nb", "javascript:void(0)", "tel:1",
    "http://example.com", "https://Other.org/a?b#c", "https://other.org?", "https://other.org/#", "ftp://f/x",
    "a//b", "/a//b", "///x", "g:h", "1:2", "/a:b", "x/y:z", "data:text/plain,hi", "http:///x", "//",
    "/é/ü?ö#ä", "foo/../../..//bar/.", "http://[::1]/x", "http://[::1", "http://a]b/", "//[bad]/x", "https:",
    "https:?q", "https:#f", "HTTP://X/y", "/..a/.b/c.", "/a/...", "svn+ssh://h/p", "foo;", "/;", "?;#;",
]


def joined(base, ref):
    try:
        return urljoin(base, ref)
    except ValueError:
        return None


def check(spark, pairs):
    df = spark.createDataFrame(pairs, "base string, ref string")
    rows = df.select("base", "ref", U.resolve("base", "ref").alias("url")).collect()
    wrong = [(r.base, r.ref, r.url, joined(r.base, r.ref)) for r in rows if r.url != joined(r.base, r.ref)]
    assert not wrong, wrong[:10]


def test_resolve_known_cases(spark):
    check(spark, list(itertools.product(BASES, REFERENCES)))


def test_resolve_random_cases(spark):
    rng = random.Random(7)
    pieces = ["/", "//", "..", ".", "a", "b.html", ":", "?", "#", ";", "http", "https", " ", "x=1", "é", "%20"]
    refs = ["".join(rng.choices(pieces, k=rng.randint(1, 7))) for _ in range(1500)]
    check(spark, [(rng.choice(BASES), ref) for ref in refs])


def test_parts(spark):
    values = [v for v in BASES + REFERENCES if joined("https://e.com/", v) is not None]
    df = spark.createDataFrame([(v,) for v in values], "url string")
    for row in df.select("url", U.url_parts(F.col("url")).alias("p")).collect():
        parsed = urlparse(row.url)
        path = parsed.path + (";" + parsed.params if parsed.params else "")
        assert row.p.scheme == parsed.scheme and row.p.netloc == parsed.netloc
        if not row.p.path.endswith(";"):
            assert row.p.path == path
        assert (row.p.query, row.p.fragment) == (parsed.query, parsed.fragment)


@pytest.mark.parametrize(
    "url,base,exclude,expected",
    [
        ("https://example.com/docs", "https://example.com", [], True),
        ("ftp://example.com/docs", "https://example.com", [], False),
        ("https://other.com/docs", "https://example.com", [], False),
        ("https://example.com/docs#section", "https://example.com", ["#"], False),
        ("https://example.com/a.JSON", "https://example.com", [], False),
        ("https://x.js.org/a", "https://x.js.org", [], False),
        ("https://example.com/docs", "https://example.com", ["docs"], False),
        ("https://example.com/docs", "https://example.com", ["Docs"], True),
    ],
)
def test_valid_page_url(spark, url, base, exclude, expected):
    df = spark.createDataFrame([(url, base, [], exclude)], "u string, b string, i array<string>, x array<string>")
    assert df.select(U.valid_page_url(*(F.col(c) for c in "ubix"))).first()[0] is expected


def test_include_patterns(spark):
    df = spark.createDataFrame(
        [("https://e.com/docs/a", ["/docs/", "/api/"]), ("https://e.com/blog", ["/docs/"]), ("https://e.com/x", None)],
        "u string, i array<string>",
    )
    got = df.select(U.valid_page_url(F.col("u"), F.lit("https://e.com"), F.col("i"), F.lit(None).cast("array<string>")))
    assert [r[0] for r in got.collect()] == [True, False, True]


def test_sitemap_url_differs_from_page_url(spark):
    df = spark.createDataFrame([("https://e.com/a.svg",), ("https://e.com/a.exe",), ("https://e.com/a",)], "u string")
    got = df.select(U.valid_sitemap_url(F.col("u"), F.lit("https://e.com/x"))).collect()
    assert [r[0] for r in got] == [True, False, True]


def test_mode_filters(spark):
    df = spark.createDataFrame([("https://a.b/DOCS/x",), ("https://a.b/wiki/x",), ("https://a.b/news/x",)], "u string")
    hits = [[r[0] for r in df.select(U.link_matches(F.col("u"), words)).collect()] for _, words, _ in CRAWL_MODES.values()]
    assert hits == [[True, False, False], [False, True, False], [False, False, True]]


def test_path_title_slash_depth_bare_host(spark):
    urls = ["https://e.com/docs/api-v2_x.html", "https://e.com/", "https://e.com", "https://e.com/en/474.html/",
            "https://e.com/it's-ÉCOLE", "https://e.com/-/"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    for r in df.select("url", U.path_title(F.col("url")), U.slash_depth(F.col("url")), U.is_bare_host(F.col("url"))).collect():
        path = urlparse(r.url).path
        words = path.strip("/").replace("-", " ").replace("_", " ").title()
        assert r[1] == (words if path not in ("", "/") else None)
        assert r[2] == r.url.count("/") - 2
        assert r[3] == (r.url.rstrip("/") == urlparse(r.url).netloc)


def test_normalise_input(spark):
    df = spark.createDataFrame(
        [("@https://e.com", False), ("e.com/x", False), ("http://e.com", False), ("/srv/a", True), ("file:///a", True), ("@@e.com", False)],
        "u string, l boolean",
    )
    got = [r[0] for r in df.select(U.normalise_input(F.col("u"), F.col("l"))).collect()]
    assert got == ["https://e.com", "https://e.com/x", "http://e.com", "file:///srv/a", "file:///a", "https://@e.com"]
    local = spark.createDataFrame([("./a/b.html",), ("c",), ("/d",)], "u string")
    got = [r[0] for r in local.select(U.normalise_input(F.col("u"), F.lit(True), "/srv/")).collect()]
    assert got == ["file:///srv/a/b.html", "file:///srv/c", "file:///d"]
