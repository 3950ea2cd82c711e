"""One query per operator family; each takes ``(spark, sf_dir)`` and returns rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteindex import config
from siteindex.constants import CRAWL_MODES, HTML_SITEMAP_PROBES, XML_SITEMAP_PATHS
from siteindex.functions import text, urls
from siteindex.operators import extract as X
from siteindex.operators.views import (
    DOCUMENT,
    clean_formatting,
    keeping,
    remove_scripts,
    removing,
    with_view,
)
from siteindex.plans import pages as P
from siteindex.plans import render
from siteindex.plans.catalog import catalog, categorised, category
from siteindex.plans.crawl import crawl
from siteindex.plans.discover import discover
from siteindex.plans.sitemap import sitemap_info, sitemap_info_urls, sitemap_urls
from siteindex.plans.run import run
from siteindex.session import configure, keep, shared_dir
from siteindex.sources.nodes import anchors
from siteindex.sources.sitemaps import existing, robots_sitemaps, sitemap_documents
from siteindex.sources.snapshot import decoded, fetched, first_copies, pages_of
from workloads import inputs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    def configured(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(configure(spark), sf_dir)

    QUERIES[function.__name__] = configured
    return function


def _each(df: DataFrame, keys: list, array: str, item: str) -> DataFrame:
    """Array items as rows with their place.

    An inner ``posexplode`` adds a filter on the array's size that works out the whole
    array a second time; the outer form does not.
    """
    rows = df.select(*keys, F.posexplode_outer(array).alias("pos", item))
    return rows.where(F.col("pos").isNotNull())


def _long(name: str):
    return F.col(name).cast("bigint").alias(name)


# --- URLs ----------------------------------------------------------------------


@query
def url_parts(spark, sf_dir):
    pages = inputs.pages(spark, sf_dir).select("page_id", "url")
    parts = pages.withColumn("p", urls.url_parts(F.col("url")))
    return parts.select(
        "page_id", "p.scheme", "p.netloc", "p.path", "p.query", "p.fragment",
        urls.slash_depth(F.col("url")).cast("bigint").alias("slash_depth"),
        urls.is_bare_host(F.col("url")).alias("is_homepage"),
    )


@query
def url_normalise(spark, sf_dir):
    typed = inputs.typed_addresses(spark, sf_dir)
    return typed.where(~urls.blank(F.col("url"))).select(
        "page_id", urls.normalise_input(F.col("url"), F.col("is_local")).alias("address")
    )


@query
def requested_sites(spark, sf_dir):
    typed = inputs.typed_addresses(spark, sf_dir).withColumn(
        "site_id", F.concat(F.lit("p"), F.col("page_id").cast("string"))
    )
    return config.requested_sites(typed).select(
        "site_id", "name", "description", F.get("urls", F.lit(0)).alias("url"),
        _long("max_pages"), _long("max_depth"), "traversal_mode",
    )


def _all_links(pages):
    url = F.col("url")
    found = fetched(pages).select("page_id", "url", X.hrefs(anchors(F.col("html"))).alias("hrefs"))
    based = found.withColumn("base", urls.url_parts(url))
    return _each(based, ["page_id", "url", "base"], "hrefs", "href").withColumn(
        "link", urls.resolve("url", "href", "base")
    )


@query
def page_links(spark, sf_dir):
    links = _all_links(inputs.pages(spark, sf_dir))
    return links.where(urls.is_web(F.col("link"))).select("page_id", _long("pos"), "href", "link")


@query
def valid_links(spark, sf_dir):
    links = _all_links(inputs.pages(spark, sf_dir))
    include, exclude = F.array(F.lit("th"), F.lit("/E")), F.array(F.lit("/an"))
    return links.where(
        urls.valid_page_url(F.col("link"), F.col("url"), include, exclude)
    ).select("page_id", _long("pos"), "link")


@query
def link_mode_filter(spark, sf_dir):
    links = _all_links(inputs.linked_pages(spark, sf_dir))
    return links.select(
        "url", _long("pos"), "link",
        *(
            urls.link_matches(F.col("link"), words).alias(f"is_{label}")
            for label, words, _ in CRAWL_MODES.values()
        ),
    )


# --- page fields ---------------------------------------------------------------


@query
def page_lookup(spark, sf_dir):
    found = fetched(pages_of(inputs.page_responses(spark, sf_dir)))
    return found.select("url", F.length("html").cast("bigint").alias("n_chars"))


@query
def single_copies(spark, sf_dir):
    kept = first_copies(inputs.copied_pages(spark, sf_dir))
    return kept.select("page_id", "url", F.length("html").cast("bigint").alias("n_chars"))


@query
def decoded_pages(spark, sf_dir):
    """Texts of pages that come as bytes in several encodings."""
    read = inputs.encoded_pages(spark, sf_dir).withColumn("html", decoded(F.col("content")))
    return read.select(
        "url", F.length("html").cast("bigint").alias("n_chars"), F.sha2("html", 256).alias("sha256")
    )


@query
def crawl_lookup(spark, sf_dir):
    found = fetched(pages_of(inputs.page_responses(spark, sf_dir), crawl=True))
    return found.select("url", F.length("html").cast("bigint").alias("n_chars"))


@query
def clean_text(spark, sf_dir):
    return P.processed(inputs.pages(spark, sf_dir)).select("url", "main_content")


@query
def custom_cleaners(spark, sf_dir):
    """Scripts removed and formatting cleaned, but navigation kept and no container chosen."""
    done = P.processed(inputs.pages(spark, sf_dir), (remove_scripts, clean_formatting))
    return done.select("url", "title", "main_content")


@query
def custom_selectors(spark, sf_dir):
    """Removed parts, container and title all named by selectors that the caller brings."""
    cleaners = (
        remove_scripts,
        removing(".promo", "#content > p span[data-x^=go]", "ul, ol"),
        clean_formatting,
        keeping("#nowhere", "div#content"),
    )
    done = P.processed(
        inputs.main_pages(spark, sf_dir), cleaners, extra=["page_id"], titles=["main h3.name"]
    )
    return done.select("page_id", "title", "main_content")


@query
def main_container(spark, sf_dir):
    """A main element before an article, with navigation and boilerplate inside; other titles."""
    done = P.processed(inputs.main_pages(spark, sf_dir), extra=["page_id"])
    return done.select("page_id", "title", "description", "main_content")


@query
def followed_links(spark, sf_dir):
    """How many of 15 matching links each kind of crawl follows, and the last of them."""
    found = P.crawl_links(inputs.link_rich_pages(spark, sf_dir), list(CRAWL_MODES))
    each = [
        column
        for mode in CRAWL_MODES
        for column in (
            F.size(f"follow_{mode}").cast("bigint").alias(f"n_{mode}"),
            F.element_at(f"follow_{mode}", -1).alias(f"last_{mode}"),
        )
    ]
    return found.select("url", *each)


@query
def titles(spark, sf_dir):
    return P.processed(inputs.pages(spark, sf_dir)).select("url", "title")


@query
def titles_traverser(spark, sf_dir):
    return P.crawl_records(inputs.pages(spark, sf_dir), "docs").select("url", "title")


@query
def main_text_traverser(spark, sf_dir):
    return P.crawl_records(inputs.pages(spark, sf_dir), "docs").select("url", "content")


@query
def record_links(spark, sf_dir):
    records = P.crawl_records(inputs.linked_pages(spark, sf_dir), "docs")
    return _each(records, ["url"], "links", "link").select("url", _long("pos"), "link")


@query
def descriptions(spark, sf_dir):
    return P.processed(inputs.linked_pages(spark, sf_dir)).select("url", "description")


@query
def headings(spark, sf_dir):
    done = P.processed(inputs.rich_pages(spark, sf_dir))
    return _each(done, ["url"], "headings", "h").select(
        "url", _long("pos"), F.col("h.level").cast("bigint").alias("level"), "h.text",
        F.col("h.id").alias("anchor"),
    )


@query
def code_blocks(spark, sf_dir):
    done = P.processed(inputs.rich_pages(spark, sf_dir))
    return _each(done, ["url"], "code_blocks", "c").select("url", _long("pos"), "c.type", "c.language", "c.content")


@query
def internal_external_links(spark, sf_dir):
    done = P.processed(inputs.linked_pages(spark, sf_dir))
    return _each(done, ["url"], "links", "a").select(
        "url", _long("pos"), F.col("a.url").alias("link"), "a.text", "a.type"
    )


def _document(spark, sf_dir):
    return with_view(P.parsed(inputs.rich_pages(spark, sf_dir)), DOCUMENT)


@query
def metadata(spark, sf_dir):
    read = _document(spark, sf_dir)
    return read.select("url", F.explode(X.metadata(F.col("elements"))).alias("name", "content"))


@query
def structured_data(spark, sf_dir):
    read = _document(spark, sf_dir)
    return read.select(
        "url", X.structured_data(F.col("elements"), F.col("nodes")).alias("structured_data")
    )


@query
def structured_forms(spark, sf_dir):
    read = with_view(P.parsed(inputs.json_pages(spark, sf_dir)), DOCUMENT)
    return read.select(
        "url", X.structured_data(F.col("elements"), F.col("nodes")).alias("structured_data")
    )


@query
def page_structure(spark, sf_dir):
    read = P.parsed(inputs.linked_pages(spark, sf_dir))
    shaped = read.select("url", X.structure(F.col("nodes"), F.col("url")).alias("s"))
    return shaped.select(
        "url", F.col("s.depth").cast("bigint").alias("depth"), "s.is_homepage", "s.has_navigation",
        "s.has_sidebar", "s.has_footer", F.col("s.heading_count").cast("bigint").alias("heading_count"),
        F.col("s.link_count").cast("bigint").alias("link_count"),
    )


@query
def to_markdown(spark, sf_dir):
    return P.markdown_pages(inputs.rich_pages(spark, sf_dir))


@query
def failed_pages(spark, sf_dir):
    done = P.processed(inputs.broken_pages(spark, sf_dir))
    return done.select("url", "title", "description", F.size("links").cast("bigint").alias("n_links"))


@query
def normalise_whitespace(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return documents.select("doc_id", text.squeeze(F.col("text")).alias("text"))


@query
def categorise(spark, sf_dir):
    rules = F.array(
        inputs._rule("French", ["/fr/"], []),
        inputs._rule("Thematic", ["#never"], ["the", "ERE"]),
        inputs._rule("Numbered", [".html", "?page="], ["zzz"]),
    )
    done = P.processed(inputs.pages(spark, sf_dir))
    return done.select("url", category(F.col("url"), F.col("title"), rules).alias("category"))


@query
def many_rules(spark, sf_dir):
    """Pages by rules of 1,500 patterns for each block of 500 pages."""
    done = P.processed(inputs.pages(spark, sf_dir), extra=["page_id"])
    titled = keep(
        done.selectExpr(
            f"concat('block', page_id div {inputs.BLOCK}) AS site_id",
            f"page_id % {inputs.BLOCK} AS rank", "url", "title",
        ),
        "titled",
    )
    rules = keep(inputs.block_rules(spark, sf_dir), "rules")
    return categorised(titled, rules).select("site_id", _long("rank"), "url", "category")


# --- sites ---------------------------------------------------------------------


@query
def config_defaults(spark, sf_dir):
    filled = config.with_defaults(inputs.partial_sites(spark, sf_dir))
    return filled.select(
        "site_id", "name", "description", F.array_join("urls", " ").alias("urls"),
        _long("max_pages"), _long("max_depth"), "traversal_mode",
    )


@query
def config_errors(spark, sf_dir):
    return config.violations(inputs.partial_sites(spark, sf_dir))


@query
def discover_pages(spark, sf_dir):
    sites = inputs.host_sites(spark, sf_dir)
    links = P.site_links(inputs.pages(spark, sf_dir))
    return discover(sites, links).select("site_id", "url", "source", _long("rank"))


def _sites_and_catalog(spark, sf_dir):
    sites = keep(inputs.linked_sites(spark, sf_dir), "sites")
    return sites, catalog(sites, inputs.linked_pages(spark, sf_dir))


@query
def page_catalog(spark, sf_dir):
    _, built = _sites_and_catalog(spark, sf_dir)
    return built.withColumn("rank", F.col("rank").cast("bigint"))


@query
def category_counts(spark, sf_dir):
    _, built = _sites_and_catalog(spark, sf_dir)
    return render.category_counts(built)


def _lines(spark, sf_dir, *artifacts):
    sites, built = _sites_and_catalog(spark, sf_dir)
    return render.lines(sites, keep(built, "catalog"), artifacts)


def _artifact(spark, sf_dir, artifact):
    return _lines(spark, sf_dir, artifact).select("site_id", "line_no", "line")


@query
def index_lines(spark, sf_dir):
    return _artifact(spark, sf_dir, "index")


@query
def index_full(spark, sf_dir):
    return _artifact(spark, sf_dir, "full")


@query
def context_short(spark, sf_dir):
    return _artifact(spark, sf_dir, "context")


@query
def context_full(spark, sf_dir):
    return _artifact(spark, sf_dir, "context_full")


@query
def site_documents(spark, sf_dir):
    return render.documents(keep(_lines(spark, sf_dir, "index", "context_full"), "lines"))


@query
def catalog_json(spark, sf_dir):
    """Records read back field by field, as text with another key order would not differ."""
    _, built = _sites_and_catalog(spark, sf_dir)
    fields = [F.get_json_object("record", f"$.{name}").alias(name) for name in render.RECORD]
    return render.records(built).select("site_id", _long("rank"), *fields)


@query
def run_summary(spark, sf_dir):
    sites, built = _sites_and_catalog(spark, sf_dir)
    requests = sites.select("site_id", F.get("urls", F.lit(0)).alias("url"))
    blank = requests.select(F.concat("site_id", F.lit("/blank")).alias("site_id"), F.lit(" ").alias("url"))
    summary = render.run_summary(requests.unionByName(blank), built, "out")
    return summary.select(
        "site_id", "success", "error", _long("pages_processed"),
        F.array_join("files_generated", ",").alias("files_generated"), "output_directory",
    )


@query
def site_files(spark, sf_dir):
    """Lines of the documents that a run writes, read back by artifact and site."""
    output = f"{shared_dir(spark)}/run-{uuid.uuid4().hex}"
    run(inputs.linked_sites(spark, sf_dir), inputs.linked_pages(spark, sf_dir), output, context=True)
    files = spark.read.text(f"{output}/documents")
    return files.groupBy("site_id", "artifact").agg(F.count(F.lit(1)).alias("n_lines"))


@query
def written_files(spark, sf_dir):
    """Size and SHA-256 of every single file that a run writes."""
    output = f"{shared_dir(spark)}/run-{uuid.uuid4().hex}"
    sites, pages = inputs.linked_sites(spark, sf_dir), inputs.linked_pages(spark, sf_dir)
    run(sites, pages, output, context=True, single_files=True)
    files = spark.read.format("binaryFile").load(f"{output}/files/*/*")
    name = F.regexp_extract("path", "files/([^/]+)/([^/.]+)[.](txt|json)$", 1)
    return files.select(
        name.alias("site_id"),
        F.regexp_extract("path", "files/([^/]+)/([^/.]+)[.](txt|json)$", 2).alias("artifact"),
        F.col("length").alias("n_bytes"),
        F.sha2("content", 256).alias("sha256"),
    )


# --- crawl ---------------------------------------------------------------------


def _crawl(spark, sf_dir, mode, *extra):
    max_pages, max_depth = inputs.CRAWL_CAPS[mode]
    visited = crawl(
        inputs.roots(spark, sf_dir, mode), inputs.linked_pages(spark, sf_dir, mode), mode,
        max_pages, max_depth,
    )
    return visited.select(
        "site_id", _long("rank"), "url", "title", _long("depth"), "traversal_mode",
        F.array_join("links", " ").alias("links"), F.length("content").cast("bigint").alias("n_chars"),
        *extra,
    )


@query
def crawl_docs(spark, sf_dir):
    return _crawl(spark, sf_dir, "docs")


@query
def crawl_research(spark, sf_dir):
    return _crawl(spark, sf_dir, "research")


@query
def crawl_structure(spark, sf_dir):
    return _crawl(
        spark, sf_dir, "map",
        "structure_info.has_footer",
        F.col("structure_info.heading_count").cast("bigint").alias("heading_count"),
        F.col("structure_info.link_count").cast("bigint").alias("link_count"),
    )


@query
def crawl_mixed(spark, sf_dir):
    visited = crawl(inputs.mixed_roots(spark, sf_dir), inputs.linked_pages(spark, sf_dir))
    return visited.select(
        "site_id", _long("rank"), "url", _long("depth"), "traversal_mode",
        F.col("structure_info").isNotNull().alias("has_structure"),
    )


# --- sitemaps ------------------------------------------------------------------


def _snapshot(spark, sf_dir):
    """Sites and responses, written once as a snapshot would be."""
    return (
        keep(inputs.sitemap_sites(spark, sf_dir), "sites"),
        keep(inputs.responses(spark, sf_dir), "responses"),
    )


@query
def robots(spark, sf_dir):
    found = robots_sitemaps(inputs.sitemap_sites(spark, sf_dir), inputs.responses(spark, sf_dir))
    return found.select("site_id", "sitemap_url")


@query
def sitemap_locations(spark, sf_dir):
    sites, responses = inputs.sitemap_sites(spark, sf_dir), inputs.responses(spark, sf_dir)
    found = existing(sites, responses, XML_SITEMAP_PATHS + HTML_SITEMAP_PROBES)
    return found.select("site_id", _long("pos"), "sitemap_url")


@query
def sitemap_forms(spark, sf_dir):
    """What sitemaps of many forms name, pages and further sitemaps."""
    read = sitemap_documents(inputs.sitemap_forms(spark, sf_dir))
    named = F.concat(
        F.transform("locations", lambda u: F.struct(F.lit("page").alias("kind"), u.alias("named"))),
        F.transform("children", lambda u: F.struct(F.lit("sitemap").alias("kind"), u.alias("named"))),
    )
    return read.select("url", F.posexplode(named).alias("pos", "n")).select(
        "url", _long("pos"), "n.kind", "n.named"
    )


@query
def sitemap_pages(spark, sf_dir):
    return sitemap_urls(*_snapshot(spark, sf_dir))


@query
def sitemap_url_types(spark, sf_dir):
    return sitemap_info_urls(*_snapshot(spark, sf_dir))


@query
def sitemap_summary(spark, sf_dir):
    info = sitemap_info(*_snapshot(spark, sf_dir))
    return info.select(
        "site_id", "base_url",
        F.array_join("sitemap_urls", " ").alias("sitemap_urls"),
        F.array_join("robots_txt_sitemaps", " ").alias("robots_txt_sitemaps"),
        F.array_join("html_sitemaps", " ").alias("html_sitemaps"),
        _long("total_urls"),
        *(
            F.col("urls_by_type")[name].alias(name)
            for name in ("documentation", "api", "guides", "tutorials", "blog", "other")
        ),
    )
