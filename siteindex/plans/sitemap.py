"""URLs of a site from its sitemaps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteindex.constants import (
    HTML_SITEMAP_PATHS,
    HTML_SITEMAP_PROBES,
    URL_TYPE_OTHER,
    URL_TYPES,
    XML_SITEMAP_PATHS,
)
from siteindex.functions.text import contains_any
from siteindex.functions.urls import valid_sitemap_url
from siteindex.session import keep
from siteindex.sources.sitemaps import (
    existing,
    robots_sitemaps,
    sitemap_documents,
    with_html_locations,
)


def _named(sites: DataFrame, responses: DataFrame) -> DataFrame:
    """Sitemaps from robots.txt and from the well-known XML paths, repeats kept."""
    return robots_sitemaps(sites, responses).unionByName(
        existing(sites, responses, XML_SITEMAP_PATHS)
    )


def closure(named: DataFrame, responses: DataFrame) -> DataFrame:
    """``(site_id, base_url, url)`` listed by sitemaps and by those their indexes name.

    Each sitemap is read once per site, which also ends cycles. A sitemap that several
    sites name is parsed once per level.
    """
    frontier = named.select("site_id", "base_url", F.col("sitemap_url").alias("url")).distinct()
    bodies = responses.where(F.col("status") < 400)
    seen: list[DataFrame] = []
    listed: list[DataFrame] = []
    while True:
        frontier = keep(frontier, "frontier")
        documents = sitemap_documents(
            bodies.join(frontier.select("url").distinct(), "url", "left_semi")
        )
        found = keep(frontier.join(documents, "url"), "sitemaps")
        listed.append(
            found.select("site_id", "base_url", F.explode("locations").alias("url"))
        )
        seen.append(frontier)
        if found.where(F.size("children") > 0).isEmpty():  # most levels are the last
            break
        frontier = (
            found.select("site_id", "base_url", F.explode("children").alias("url"))
            .distinct()
            .join(_union(seen), ["site_id", "base_url", "url"], "left_anti")
        )
    return _union(listed)


def _valid(urls: DataFrame) -> DataFrame:
    """Filter first: it needs no shuffle and leaves less to make distinct."""
    kept = urls.where(valid_sitemap_url(F.col("url"), F.col("base_url")))
    return kept.select("site_id", "url").distinct()


def html_sitemap_urls(sites: DataFrame, responses: DataFrame) -> DataFrame:
    """``(site_id, base_url, url)``: links of the HTML pages at well-known paths."""
    asked = existing(sites, responses, HTML_SITEMAP_PATHS).select(
        "site_id", "base_url", F.col("sitemap_url").alias("page_url")
    )
    bodies = responses.where(F.col("status") == 200).select(
        F.col("url").alias("page_url"), "body"
    )
    wanted = bodies.join(asked.select("page_url").distinct(), "page_url", "left_semi")
    read = with_html_locations(wanted, "page_url", F.col("body")).select(
        "page_url", F.col("_links").alias("locations")
    )
    return asked.join(read, "page_url").select(
        "site_id", "base_url", F.explode("locations").alias("url")
    )


def sitemap_urls(sites: DataFrame, responses: DataFrame) -> DataFrame:
    """``(site_id, url)``: all valid URLs from XML and HTML sitemaps, without repeats.

    ``sites`` is ``(site_id, base_url)``, ``responses`` a snapshot with status and type.
    """
    listed = closure(_named(sites, responses), responses)
    return _valid(listed.unionByName(html_sitemap_urls(sites, responses)))


def url_type(url: Column) -> Column:
    lowered = F.lower(url)
    kind = F.lit(URL_TYPE_OTHER)
    for name, words in reversed(URL_TYPES):
        kind = F.when(contains_any(lowered, words), name).otherwise(kind)
    return kind


def sitemap_info_urls(sites: DataFrame, responses: DataFrame) -> DataFrame:
    """``(site_id, url, url_type)``: the URLs that ``sitemap_info`` counts.

    HTML sitemaps go by content type here and only five paths are tried.
    """
    named = _named(sites, responses).unionByName(existing(sites, responses, HTML_SITEMAP_PROBES))
    return _valid(closure(named, responses)).withColumn("url_type", url_type(F.col("url")))


def _lists(found: DataFrame, name: str) -> DataFrame:
    """Sitemap addresses per site in order; they come from one file or a fixed list."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "sitemap_url")))
    return found.groupBy("site_id").agg(ordered["sitemap_url"].alias(name))


def sitemap_info(sites: DataFrame, responses: DataFrame, urls: DataFrame | None = None) -> DataFrame:
    """One row per site: its sitemaps, the number of URLs, and that number by type.

    The URLs themselves are rows of ``sitemap_info_urls`` (pass a written one as
    ``urls``), not lists in one cell: a site may have any number of them. All six types
    are always there.
    """
    urls = sitemap_info_urls(sites, responses) if urls is None else urls
    types = [name for name, _ in URL_TYPES] + [URL_TYPE_OTHER]
    counts = urls.groupBy("site_id").agg(
        F.count(F.lit(1)).alias("total_urls"),
        *(F.count(F.when(F.col("url_type") == name, 1)).alias(name) for name in types),
    )
    robots = _lists(robots_sitemaps(sites, responses), "robots_txt_sitemaps")
    common = _lists(existing(sites, responses, XML_SITEMAP_PATHS), "common")
    pages = _lists(existing(sites, responses, HTML_SITEMAP_PROBES), "html_sitemaps")
    joined = sites.select("site_id", "base_url")
    for part in (robots, common, pages, counts):
        joined = joined.join(part, "site_id", "left")
    none = F.array().cast("array<string>")
    filled = joined.na.fill(0, ["total_urls", *types]).withColumns(
        {name: F.coalesce(name, none) for name in ("robots_txt_sitemaps", "common", "html_sitemaps")}
    )
    by_type = F.create_map(*(part for name in types for part in (F.lit(name), F.col(name))))
    return filled.select(
        "site_id",
        "base_url",
        F.concat("robots_txt_sitemaps", "common").alias("sitemap_urls"),
        "robots_txt_sitemaps",
        "html_sitemaps",
        "total_urls",
        by_type.alias("urls_by_type"),
    )


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)
