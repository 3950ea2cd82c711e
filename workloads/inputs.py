"""Inputs that Spark derives from the given tables; they grow with them.

The links of ``pages`` never lead to another page of the table. ``linked_pages`` gives
the pages new addresses and inserts links: blocks of 500 pages, five hosts per block,
the pages of a host linked as a binary heap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteindex.config import RULES
from siteindex.sources.snapshot import read_pages

# path of an ordinary page, path of the link to another host
PATHS = {"docs": ("docs", "guide"), "research": ("wiki", "article"), "map": ("blog", "news")}
BLOCK, HOSTS = 500, 5
#: Pages and depth of the crawls: the first is cut by its pages, the second by its depth.
CRAWL_CAPS = {"docs": (12, 3), "research": (60, 3), "map": (60, 5)}


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_pages(spark, f"{sf_dir}/pages.parquet", spark.sparkContext.defaultParallelism)


def _heap(df: DataFrame) -> DataFrame:
    return df.selectExpr(
        "*",
        f"page_id div {BLOCK} AS block",
        f"(page_id % {BLOCK}) % {HOSTS} AS host",
        f"(page_id % {BLOCK}) div {HOSTS} AS node",
    ).selectExpr("*", "concat('site', block, '-', host) AS site_id")


def linked_pages(spark: SparkSession, sf_dir: str, mode: str = "docs") -> DataFrame:
    """Pages with columns ``site_id, block, host, node`` and links to their heap children."""
    path, other = PATHS[mode]
    child = f"{BLOCK} * block + {HOSTS} * (2 * node + {{}}) + host"
    paragraph = (
        "concat('<article><p>This paragraph links to the neighbouring pages of site ', site_id,"
        f" '. <a href=\"/{path}/', {BLOCK} * block + host, '\">Home</a>',"
        f" ' <a href=\"/{path}/', {child.format(1)}, '\">First</a>',"
        f" ' <a href=\"/{path}/', {child.format(2)}, '\">Second</a>',"
        f" ' <a href=\"https://other.example.org/{other}/x\">Elsewhere</a></p>')"
    )
    return _heap(pages(spark, sf_dir)).selectExpr(
        "page_id",
        f"concat('https://', site_id, '.example.com/{path}/', page_id) AS url",
        f"replace(html, '<article>', {paragraph}) AS html",
        "site_id", "block", "host", "node",
    )


def rich_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with metadata, JSON-LD, code and lists inserted."""
    head = (
        "concat('<meta charset=\"utf-8\"><meta name=\"description\" content=\" Page ', page_id, ' \">',"
        " '<meta property=\"og:title\" content=\"first\"><meta name=\"og:title\" content=\"T', page_id % 7, '\">',"
        " '<meta name=\"empty\" content=\"\">',"
        " '<script type=\"application/ld+json\">{\"id\": 0}</script>',"
        " '<script type=\"application/ld+json\">{\"id\": ', page_id, '}</script>',"
        " '<script type=\"application/ld+json\">{\"id\": </script>')"
    )
    body = (
        "concat('<article><pre class=\"language-python\">print(', page_id, ')\\n  x &amp; y</pre>',"
        " '<p><code class=\"x js\">call_', page_id, '_long()</code> <code>short</code></p>',"
        " '<pre data-language=\"go\"><code>inner ', page_id, '</code></pre>',"
        " '<ul><li>item ', page_id, '<ul><li>sub</li></ul></li><li><a href=\"/docs/', page_id, '\"> two </a></li></ul>',"
        " '<ol><li>one<ol><li>nested</li></ol></li><li>three ', page_id, '</li></ol><h2>Head <a href=\"/h\">link</a></h2>')"
    )
    return pages(spark, sf_dir).selectExpr(
        "page_id",
        "url",
        f"replace(replace(html, '<meta charset=\"utf-8\">', {head}), '<article>', {body}) AS html",
    )


def broken_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of which some hold a link or a declaration that cannot be read."""
    insert = (
        "CASE page_id % 4 WHEN 0 THEN '<article><a href=\"http://[x/\">t</a>'"
        " WHEN 1 THEN '<article><![nope[x]]>' ELSE '<article>' END"
    )
    return pages(spark, sf_dir).selectExpr(
        "page_id", "url", f"replace(html, '<article>', {insert}) AS html"
    )


def host_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One site per authority of ``pages`` and block of pages, with settings by rule."""
    authority = "regexp_extract(url, '^https?://([^/?#]*)', 1)"
    listed = (
        pages(spark, sf_dir)
        .selectExpr("page_id", "url", f"{authority} AS authority", f"page_id div {BLOCK} AS block")
        .groupBy("authority", "block")
        .agg(F.array_sort(F.collect_list(F.struct("page_id", "url")))["url"].alias("urls"))
    )
    none = F.array().cast("array<string>")
    return listed.select(
        F.concat_ws("#", "authority", "block").alias("site_id"),
        "urls",
        F.when(F.length("authority") % 3 == 0, F.array(F.lit("th"), F.lit("/E"))).otherwise(none).alias(
            "include_patterns"
        ),
        F.when(F.length("authority") % 3 == 1, F.array(F.lit("/an"))).otherwise(none).alias(
            "exclude_patterns"
        ),
        F.when(F.length("authority") % 4 == 0, 3).cast("int").alias("max_pages"),
    )


def linked_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One site per host of the linked pages (at most 100 pages), one without pages per block."""
    placed = _heap(pages(spark, sf_dir).select("page_id"))
    address = F.concat(
        F.lit("https://"), "site_id", F.lit(".example.com/docs/"), F.col("page_id").cast("string")
    )
    hosts = placed.groupBy("site_id", "block", "host").agg(
        F.array_sort(F.collect_list(F.struct("page_id", address.alias("url"))))["url"].alias("urls")
    )
    empty = placed.select("block").distinct().select(
        F.concat(F.lit("site"), "block", F.lit("-none")).alias("site_id"),
        "block",
        F.lit(-1).cast("bigint").alias("host"),
        F.array(F.concat(F.lit("https://none"), "block", F.lit(".example.com/"))).alias("urls"),
    )
    none = F.array().cast("array<string>")
    rules = F.array(
        _rule("Ones", ["/docs/1"], []),
        _rule("The", [], ["the", "Never"]),
        _rule("Five", ["5"], ["zzz"]),
    )
    return hosts.unionByName(empty).select(
        "site_id",
        F.concat(F.lit("Site "), "site_id").alias("name"),
        F.concat(F.lit("Pages of "), "site_id").alias("description"),
        F.when(F.col("host") == 2, F.concat(F.lit("Seen in block "), "block")).alias("additional_info"),
        "urls",
        none.alias("include_patterns"),
        none.alias("exclude_patterns"),
        rules.alias("category_rules"),
        F.when(F.col("host") == 1, 60).cast("int").alias("max_pages"),
        F.lit(3).alias("max_depth"),
        F.lit("docs").alias("traversal_mode"),
    )


def _rule(name: str, url_patterns: list[str], title_patterns: list[str]):
    def words(values):
        return F.array(*map(F.lit, values)).cast("array<string>")

    return F.struct(
        F.lit(name).alias("category"),
        words(url_patterns).alias("url_patterns"),
        words(title_patterns).alias("title_patterns"),
    )


def roots(spark: SparkSession, sf_dir: str, mode: str = "docs") -> DataFrame:
    """``(site_id, url)`` of the heap roots."""
    path = PATHS[mode][0]
    placed = _heap(pages(spark, sf_dir).select("page_id"))
    return placed.where(F.col("node") == 0).select(
        "site_id",
        F.concat(
            F.lit("https://"), "site_id", F.lit(f".example.com/{path}/"), F.col("page_id").cast("string")
        ).alias("url"),
    )


def mixed_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heap roots with crawl settings that differ from host to host, or are missing."""
    host = "cast(split_part(site_id, '-', 2) AS int)"
    return roots(spark, sf_dir).selectExpr(
        "*",
        f"CASE {host} % 3 WHEN 0 THEN 'docs' WHEN 1 THEN 'map' END AS traversal_mode",
        f"CASE WHEN {host} % 3 = 0 THEN 12 END AS max_pages",
        f"CASE WHEN {host} % 3 = 1 THEN 9 END AS max_depth",
    )


def copied_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with later copies of every third, and each fifth twice under its own id."""
    given = pages(spark, sf_dir)
    later = given.where("page_id % 3 = 0").selectExpr("page_id + 1000000000 AS page_id", "url", "'<p>old</p>' AS html")
    return given.unionByName(later).unionByName(given.where("page_id % 5 = 0"))


def json_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with JSON-LD that repeats a key, holds no number, or is not JSON."""
    script = (
        "concat('<script type=\"application/ld+json\">', CASE page_id % 3"
        " WHEN 0 THEN concat('{\"a\": 1, \"a\": ', page_id, '}')"
        " WHEN 1 THEN concat('{\"v\": NaN, \"w\": [-Infinity], \"id\": ', page_id, '}')"
        " ELSE '{\"v\": nan}' END, '</script><article>')"
    )
    return pages(spark, sf_dir).selectExpr(
        "page_id", "url", f"replace(html, '<article>', {script}) AS html"
    )


def sitemap_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(site_id, base_url)`` of the linked hosts."""
    return roots(spark, sf_dir).withColumnRenamed("url", "base_url")


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshot with status and type: robots.txt, sitemaps of all kinds, a cycle, bad XML."""
    placed = _heap(pages(spark, sf_dir).select("page_id")).withColumn(
        "base", F.concat(F.lit("https://"), "site_id", F.lit(".example.com"))
    )
    kinds = F.array(*map(F.lit, ("docs", "api", "guides", "tutorials", "blog", "misc")))
    placed = placed.withColumn(
        "entry",
        F.concat(
            F.lit("<url><loc>"), "base", F.lit("/"), F.get(kinds, (F.col("page_id") % 6).cast("int")),
            F.lit("/"), F.col("page_id").cast("string"), F.lit("?a=1&amp;b=2</loc></url><url><loc>"),
            "base", F.lit("/files/"), F.col("page_id").cast("string"), F.lit(".pdf</loc></url>"),
        ),
    ).withColumn(
        "anchor",
        F.concat(
            F.lit('<li><a href="/pages/'), F.col("page_id").cast("string"), F.lit('">p</a> <a href="/pages/'),
            F.col("page_id").cast("string"), F.lit('">again</a></li>'),
        ),
    )

    def texts(name, test=None):
        kept = F.struct("page_id", F.col(name).alias("t"))
        kept = kept if test is None else F.when(test, kept)
        return F.array_join(F.array_sort(F.collect_list(kept))["t"], "")

    even = F.col("node") % 2 == 0
    hosts = placed.groupBy("site_id", "base").agg(
        texts("entry", even).alias("even"), texts("entry", ~even).alias("odd"), texts("anchor").alias("anchors")
    )
    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'

    def row(path, status, kind, body):
        return (
            f"struct(concat(base, '{path}') AS url, {status} AS status, "
            f"cast({kind} AS string) AS content_type, {body} AS body)"
        )

    def named(path):
        return f"'<sitemap><loc>', base, '{path}</loc></sitemap>'"

    robots = (
        r"concat('User-agent: *\n  SITEMAP: ', base, '/sitemap_index.xml \r\nsitemap:\nAllow: /\nSitemap:', base,"
        r" '/sm-a.xml')"
    )
    rows = [
        row("/robots.txt", 200, "'text/plain'", robots),
        row("/sitemap_index.xml", 200, "'application/xml'",
            f"concat('<sitemapindex {ns}>', {named('/sm-a.xml')}, {named('/sm-b.xml')}, {named('/sitemap_index.xml')}, '</sitemapindex>')"),
        row("/sm-a.xml", 200, "'Text/XML; charset=utf-8'", f"concat('<urlset {ns}>', even, '</urlset>')"),
        row("/sm-b.xml", 200, "NULL", f"concat('<?xml version=\"1.0\"?><urlset {ns}>', odd, '</urlset>')"),
        row("/sitemap.xml", 404, "'text/xml'", "''"),
        row("/sitemap.html", 200, "'text/html'",
            "concat('<ul>', anchors, '<li><a href=\"/x.pdf\">f</a><a href=\"https://other.example.org/a\">o</a></li></ul>')"),
        row("/sitemap1.xml", 200, "'application/xml'", f"concat('<urlset {ns}>', even)"),
    ]
    return hosts.selectExpr(f"explode(array({', '.join(rows)})) AS r").selectExpr("r.*")


def typed_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page addresses as users type them: with @, without scheme, local, blank."""
    return pages(spark, sf_dir).selectExpr(
        "page_id",
        "CASE page_id % 5 WHEN 0 THEN concat('@', url) WHEN 1 THEN regexp_replace(url, '^https?://', '')"
        " WHEN 2 THEN concat('/srv/', page_id, '.html') WHEN 3 THEN url ELSE if(page_id % 2 = 0, '  ', NULL) END AS url",
        "page_id % 5 = 2 AS is_local",
    )


def partial_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One site per page, with settings missing by rule."""
    return pages(spark, sf_dir).selectExpr(
        "concat('p', page_id) AS site_id",
        "if(page_id % 5 = 0, NULL, concat('Name ', page_id)) AS name",
        "if(page_id % 7 = 0, NULL, concat('About ', page_id)) AS description",
        "cast(NULL AS string) AS additional_info",
        "CASE WHEN page_id % 11 = 0 THEN NULL WHEN page_id % 3 = 0 THEN array() ELSE array(url) END AS urls",
        "cast(NULL AS array<string>) AS include_patterns",
        "cast(NULL AS array<string>) AS exclude_patterns",
        f"cast(NULL AS {RULES}) AS category_rules",
        "cast(if(page_id % 2 = 0, NULL, page_id) AS int) AS max_pages",
        "cast(if(page_id % 3 = 0, NULL, page_id) AS int) AS max_depth",
        "if(page_id % 4 = 0, NULL, 'map') AS traversal_mode",
    )


def page_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as responses: some with an error status, some without a body."""
    return pages(spark, sf_dir).selectExpr(
        "url",
        "CASE page_id % 6 WHEN 0 THEN 404 WHEN 1 THEN 304 ELSE 200 END AS status",
        "'text/html' AS content_type",
        "CASE WHEN page_id % 9 = 2 THEN '' ELSE html END AS body",
    )


def main_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a ``main`` beside the article, which holds what cleaners and selectors take out.

    Addresses and metadata reach every source of a title but the usual two.
    """
    inserted = (
        "concat('<main><nav>menu</nav>',"
        " if(page_id % 3 = 2, concat('<meta name=\"title\" content=\" Meta ', page_id, ' \">'), ''),"
        " if(page_id % 2 = 1, concat('<meta property=\"og:description\" content=\"Og ', page_id, '\">'), ''),"
        " '<div id=\"content\" class=\"x\"><h3 class=\"name\">Own title ', page_id, '</h3>',"
        " '<p class=\"promo big\">buy</p><div class=\"share ad\">ad</div><aside>aside</aside>',"
        " '<p>kept ', page_id, ' <span data-x=\"go-1\">gone</span><span data-x=\"no\">stays</span></p>',"
        " '<ul><li>one</li></ul></div></main><article>')"
    )
    address = (
        "concat('https://e.example.com/', if(page_id % 3 = 1, '', concat('docs/api-v', page_id, '_x/')))"
    )
    return pages(spark, sf_dir).selectExpr(
        "page_id", f"{address} AS url", f"replace(html, '<article>', {inserted}) AS html"
    )


def link_rich_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that begin with 15 links for each kind of crawl."""
    links = (
        "array_join(transform(sequence(0, 14), i -> concat("
        + ", ".join(f"'<a href=\"/{path}/', page_id, '-', i, '\">x</a>'" for path, _ in PATHS.values())
        + ")), '')"
    )
    return pages(spark, sf_dir).selectExpr("page_id", "url", f"concat({links}, html) AS html")


def sitemap_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sitemap for each page, in forms that differ by rule: deep, prefixed, foreign, broken."""
    space = "http://www.sitemaps.org/schemas/sitemap/0.9"
    entry = "'<', p, 'url><', p, 'loc>https://e.com/', page_id, '?a=1&amp;b=2</', p, 'loc></', p, 'url>'"
    forms = {
        0: f"concat('<urlset xmlns=\"{space}\"><group><more>', {entry}, '</more></group>', {entry}, '</urlset>')",
        1: f"concat('<?xml version=\"1.0\"?><s:urlset xmlns:s=\"{space}\">', {entry}, '</s:urlset>')",
        2: f"concat('<urlset xmlns=\"urn:other\">', {entry}, '</urlset>')",
        3: f"concat('<urlset xmlns=\"{space}\">', {entry}, '</urlset><x/>')",
        4: f"concat('<s:sitemapindex xmlns:s=\"{space}\"><s:sitemap><s:loc><![CDATA[https://e.com/sm-', page_id,"
           " '.xml]]></s:loc></s:sitemap></s:sitemapindex>')",
        5: f"concat('<urlset xmlns=\"{space}\">', {entry}, '<url><loc>', '</urlset>')",
    }
    cases = " ".join(f"WHEN {k} THEN {body}" for k, body in forms.items())
    prefixed = pages(spark, sf_dir).selectExpr("page_id", "if(page_id % 6 IN (1, 4), 's:', '') AS p")
    return prefixed.selectExpr(
        "concat('https://e.com/sitemap-', page_id, '.xml') AS url", "200 AS status",
        "'application/xml' AS content_type", f"CASE page_id % 6 {cases} END AS body",
    )


def encoded_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as bytes in five encodings: declared, marked, or neither."""
    latin = "regexp_replace(html, '[^\\u0000-\\u007f\\u00a0-\\u00ff]', 'x')"
    declared = "replace({}, '<meta charset=\"utf-8\">', '{}')"
    meta = '<meta http-equiv=\"Content-Type\" content=\"text/html; charset=ISO-8859-1\">'
    content = (
        "CASE page_id % 5"
        " WHEN 0 THEN encode(html, 'UTF-8')"
        f" WHEN 1 THEN encode({declared.format(latin, meta)}, 'ISO-8859-1')"
        " WHEN 2 THEN concat(X'FFFE', encode(html, 'UTF-16LE'))"
        " WHEN 3 THEN concat(X'FEFF', encode(html, 'UTF-16BE'))"
        f" ELSE concat(encode({declared.format(latin, '')}, 'ISO-8859-1'), X'80E9') END"
    )
    return pages(spark, sf_dir).selectExpr("page_id", "url", f"{content} AS content")


def block_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``site_id, category_rules``: a site for each block of pages, three patterns for each page.

    The patterns are pieces of URLs and headings, so that a page meets many rules and the first
    is rarely its own; the last page of a block has the first rule.
    """
    heading = "coalesce(regexp_extract(html, '<h1>(.*?)</h1>', 1), '')"
    rules = (
        "struct(concat('page ', page_id) AS category,"
        " array(substr(url, 9, 9), right(url, 6)) AS url_patterns,"
        f" array(lower(substr({heading}, 1, 6))) AS title_patterns)"
    )
    placed = pages(spark, sf_dir).selectExpr(
        f"concat('block', page_id div {BLOCK}) AS site_id", "-page_id AS at", f"{rules} AS rule"
    )
    listed = F.array_sort(F.collect_list(F.struct("at", "rule")))["rule"]
    return placed.groupBy("site_id").agg(listed.cast(RULES).alias("category_rules"))
