import random
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from siteindex.plans.sitemap import sitemap_info, sitemap_info_urls, sitemap_urls, url_type
from siteindex.sources.sitemaps import existing, robots_sitemaps, sitemap_documents
from siteindex.sources.xml_entries import read_entries
from siteindex.sources.snapshot import RESPONSES, pages_of, read_files

NS = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'


def urlset(*locs, ns=NS):
    return f"<?xml version='1.0'?><urlset {ns}>" + "".join(f"<url><loc>{u}</loc></url>" for u in locs) + "</urlset>"


def index(*locs):
    return f"<sitemapindex {NS}>" + "".join(f"<sitemap><loc>{u}</loc></sitemap>" for u in locs) + "</sitemapindex>"


E = "https://e.com"
ROWS = [
    (f"{E}/robots.txt", 200, "text/plain", f"User-agent: *\r\n  SITEMAP: {E}/index.xml \nsitemap:\nSitemap:{E}/sitemap.xml"),
    (f"{E}/index.xml", 200, "application/xml", index(f"{E}/a.xml", f"{E}/b.xml", f"{E}/index.xml", f"{E}/gone.xml")),
    (f"{E}/a.xml", 200, "text/xml; charset=utf-8", urlset(f"{E}/docs/1", f"{E}/api/2", "https://o.org/3", f"{E}/x.JSON", f"{E}/blog/a&amp;b")),
    (f"{E}/b.xml", 200, None, urlset(f"{E}/docs/1", f"{E}/tutorials/4")),
    (f"{E}/gone.xml", 404, "text/xml", urlset(f"{E}/never")),
    (f"{E}/sitemap.xml", 200, "application/xml", urlset(f"{E}/how-to/5")[:-12]),
    (f"{E}/sitemap1.xml", 200, "application/xml", urlset(f"{E}/no-namespace", ns="")),
    (f"{E}/sitemap_news.xml", 200, "TEXT/HTML", f'<a href="/html-type">x</a><a href="mailto:x@y.z">m</a>'),
    (f"{E}/sitemap_products.xml", 200, "", "<a href='/sniffed'>x</a>"),
    (f"{E}/sitemap.html", 200, "text/html", "<a href='h'>1</a><a href='h'>1</a><a href='/f.pdf'>f</a><a href='//o.org/x'>o</a>"),
    (f"{E}/directory", 200, "text/xml", "<a href='/dir'>1</a>"),
    (f"{E}/links", 500, "text/html", "<a href='/broken'>1</a>"),
]


@pytest.fixture(scope="module")
def snapshot(spark):
    sites = spark.createDataFrame([("e", E + "/start/here"), ("o", "https://o.org")], "site_id string, base_url string")
    return sites, spark.createDataFrame(ROWS, RESPONSES)


def test_robots(snapshot):
    rows = robots_sitemaps(*snapshot).orderBy("pos").collect()
    assert [(r.site_id, r.sitemap_url) for r in rows] == [("e", f"{E}/index.xml"), ("e", f"{E}/sitemap.xml")]


def test_existing(snapshot):
    rows = existing(*snapshot, ("/sitemap.html", "/links", "/none")).collect()
    assert [(r.site_id, r.pos, r.sitemap_url) for r in rows] == [("e", 0, f"{E}/sitemap.html")]


def test_documents(snapshot):
    rows = {r.url: r for r in sitemap_documents(snapshot[1]).collect()}
    assert rows[f"{E}/index.xml"].children == [f"{E}/a.xml", f"{E}/b.xml", f"{E}/index.xml", f"{E}/gone.xml"]
    assert rows[f"{E}/index.xml"].locations == []
    assert rows[f"{E}/a.xml"].locations == [f"{E}/docs/1", f"{E}/api/2", "https://o.org/3", f"{E}/x.JSON", f"{E}/blog/a&b"]
    assert rows[f"{E}/b.xml"].locations == [f"{E}/docs/1", f"{E}/tutorials/4"]
    assert rows[f"{E}/sitemap.xml"].locations == []
    assert rows[f"{E}/sitemap1.xml"].locations == []
    assert rows[f"{E}/sitemap_news.xml"].locations == [f"{E}/html-type"]
    assert rows[f"{E}/sitemap_products.xml"].locations == [f"{E}/sniffed"]


def test_xml_forms(spark):
    prefixed = ('<sm:urlset xmlns:sm="http://www.sitemaps.org/schemas/sitemap/0.9"><sm:url><sm:loc> https://e.com/a\n</sm:loc>'
                "<sm:priority>1</sm:priority></sm:url><sm:url><sm:loc/></sm:url><sm:url/></sm:urlset>")
    cdata = f"<!-- c --><urlset {NS}><url><loc><![CDATA[https://e.com/?a&b]]></loc></url></urlset>"
    late = "\n " + urlset("https://e.com/late")  # a declaration must come first
    rows = [("0", 200, None, late), ("1", 200, "xml", prefixed), ("2", 200, "xml", cdata), ("3", 200, "xml", ""), ("4", 200, "xml", f"<urlset {NS}/>")]
    got = {r.url: r.locations for r in sitemap_documents(spark.createDataFrame(rows, RESPONSES)).collect()}
    assert got == {"0": [], "1": [" https://e.com/a\n"], "2": ["https://e.com/?a&b"], "3": [], "4": []}


def test_sitemap_urls(snapshot):
    rows = sitemap_urls(*snapshot).collect()
    assert sorted(r.url for r in rows) == sorted(
        f"{E}/{p}" for p in ("docs/1", "api/2", "blog/a&b", "tutorials/4", "html-type", "sniffed", "h", "dir"))
    assert {r.site_id for r in rows} == {"e"}


def test_sitemap_info(snapshot):
    rows = {r.site_id: r for r in sitemap_info(*snapshot).collect()}
    e = rows["e"]
    assert e.robots_txt_sitemaps == [f"{E}/index.xml", f"{E}/sitemap.xml"]
    assert e.sitemap_urls == e.robots_txt_sitemaps + [f"{E}/sitemap.xml", f"{E}/sitemap1.xml", f"{E}/sitemap_news.xml", f"{E}/sitemap_products.xml"]
    assert e.html_sitemaps == [f"{E}/sitemap.html"]
    assert e.total_urls == 7
    assert e.urls_by_type == {"documentation": 1, "api": 1, "guides": 0, "tutorials": 1, "blog": 1, "other": 3}
    assert rows["o"].total_urls == 0 and rows["o"].sitemap_urls == [] and len(rows["o"].urls_by_type) == 6
    assert sitemap_info_urls(*snapshot).count() == 7


def test_url_type(spark):
    urls = ["/guide/api/", "/reference/how-to/", "/how-to/", "/guides/blog/", "/TUTORIAL/", "/articles/", "/x"]
    df = spark.createDataFrame([(E + u,) for u in urls], "url string")
    assert [r[0] for r in df.select(url_type(F.col("url"))).collect()] == [
        "documentation", "api", "guides", "guides", "tutorials", "blog", "other"]


def test_pages_of_responses(snapshot):
    urls = {r.url for r in pages_of(snapshot[1]).collect()}
    assert f"{E}/links" not in urls and f"{E}/gone.xml" not in urls and f"{E}/a.xml" in urls


def test_crawl_takes_only_status_200(spark):
    rows = [("a", 200, None, "x"), ("b", 304, None, "x"), ("c", 404, None, "x")]
    df = spark.createDataFrame(rows, RESPONSES)
    assert [r.url for r in pages_of(df).orderBy("url").collect()] == ["a", "b"]
    assert [r.url for r in pages_of(df, crawl=True).collect()] == ["a"]


def test_read_files(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>x</p>\n<p>y</p>")
    rows = read_files(spark, str(tmp_path / "*.html")).collect()
    assert [(r.url.split("/")[-1], r.html) for r in rows] == [("a.html", "<p>x</p>\n<p>y</p>")]
    assert rows[0].url.startswith("file:///")


def test_forms_of_xml(spark):
    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    entry = "<url><loc>https://e.com/a</loc></url>"
    bodies = {
        "plain": f"<urlset {ns}>{entry}</urlset>\n<!-- end -->\n",
        "quotes": f"<?xml version='1.0'?><urlset xmlns = '{ns[7:-1]}'>{entry}</urlset>",
        "prefix": f"<s:urlset xmlns:s{ns[5:]}>{entry.replace('<', '<s:').replace('<s:/', '</s:')}</s:urlset>",
        "two roots": f"<urlset {ns}>{entry}</urlset><x/>",
        "text after": f"<urlset {ns}>{entry}</urlset> more",
        "other namespace": f'<urlset xmlns="urn:x" note="{ns[7:-1]}">{entry}</urlset>',
        "mentioned only": f"<urlset><!-- {ns} -->{entry}</urlset>",
        "deeper": f"<urlset {ns}><group>{entry}</group></urlset>",
        "children in the namespace": f"<feed>{entry.replace('<url>', f'<url {ns}>')}</feed>",
        "deeper location": f"<urlset {ns}><url><x><loc>https://e.com/a</loc></x></url></urlset>",
        "unknown entity": f"<urlset {ns}>{entry}&nope;</urlset>",
    }
    rows = [(name, 200, "text/xml", body) for name, body in bodies.items()]
    responses = spark.createDataFrame(rows, "url string, status int, content_type string, body string")
    got = {r.url: r.locations for r in sitemap_documents(responses).collect()}
    one = {name for name, found in got.items() if found == ["https://e.com/a"]}
    assert one == {"plain", "quotes", "prefix", "deeper", "children in the namespace"}
    assert all(found == [] for name, found in got.items() if name not in one)


def test_entries_are_those_of_a_tree():
    """Against the tree of the standard library, on documents made of few pieces."""
    rng = random.Random(3)
    pieces = ["<url>", "</url>", "<loc>", "</loc>", "<sm:url>", "</sm:url>", "<sm:loc>", "</sm:loc>", "u", " v ",
              "<x>", "</x>", "<loc/>", "<!-- c -->", "<![CDATA[w&]]>", "&amp;", "<o:loc>z</o:loc>", "<loc>y</loc>",
              "<url><loc>k</loc></url>", "<sitemap><loc>s</loc></sitemap>", "&nope;"]
    names = {"sm": NS[7:-1]}
    good = 0
    for i in range(6000):
        root = rng.choice(["urlset", "sm:urlset", "sitemapindex", "url", "sm:sitemapindex"])
        inner = "".join(rng.choices(pieces[:-1] if i % 9 else pieces, k=rng.randint(0, 7)))
        body = f'<{root} {rng.choice([NS, ""])} xmlns:sm="{NS[7:-1]}" xmlns:o="urn:o">{inner}</{root}>'
        try:
            tree = ElementTree.fromstring(body)
        except ElementTree.ParseError:
            assert read_entries(body) is None
            continue
        good += 1
        is_index = "sitemapindex" in tree.tag
        found = tree.findall(f".//sm:{'sitemap' if is_index else 'url'}/sm:loc", names)
        assert read_entries(body) == (is_index, [e.text for e in found if e.text]), body
    assert good > 1000


def test_a_long_sitemap_is_read_in_one_pass():
    body = urlset(*(f"{E}/{i}" for i in range(200_000)))
    assert len(body) > 5_000_000 and read_entries(body) == (False, [f"{E}/{i}" for i in range(200_000)])
    assert read_entries("<a>" * 50_000 + "</a>" * 50_000) == (False, [])
