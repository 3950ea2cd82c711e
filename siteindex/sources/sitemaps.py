"""Sitemap sources: robots.txt, well-known paths, XML and HTML sitemaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteindex.functions.text import strip
from siteindex.functions.urls import is_web, resolve, resolve_all, url_parts
from siteindex.operators import extract as X
from siteindex.sources.nodes import anchors
from siteindex.sources.xml_entries import entries

def robots_sitemaps(sites: DataFrame, responses: DataFrame) -> DataFrame:
    """``(site_id, base_url, pos, sitemap_url)`` named by each site's robots.txt."""
    asked = sites.select(
        "site_id", "base_url", resolve("base_url", "'/robots.txt'").alias("url")
    )
    files = responses.where(F.col("status") == 200).select("url", "body")
    lines = asked.join(files, "url").select(
        "site_id", "base_url", F.posexplode(F.split("body", "\n")).alias("pos", "line")
    )
    line = strip(F.col("line"))
    named = lines.where(F.startswith(F.lower(line), F.lit("sitemap:"))).select(
        "site_id", "base_url", "pos", strip(F.substring(line, 9, 1 << 30)).alias("sitemap_url")
    )
    return named.where(F.col("sitemap_url") != "")


def existing(sites: DataFrame, responses: DataFrame, paths: Sequence[str]) -> DataFrame:
    """``(site_id, base_url, pos, sitemap_url)`` of the well-known paths that exist."""
    asked = sites.select(
        "site_id", "base_url", F.posexplode(F.array(*map(F.lit, paths))).alias("pos", "path")
    ).select(
        "site_id", "base_url", "pos", resolve("base_url", "path").alias("sitemap_url")
    )
    there = responses.where(F.col("status") == 200).select(F.col("url").alias("sitemap_url"))
    return asked.join(there, "sitemap_url", "left_semi")


def is_xml(content_type: Column, body: Column) -> Column:
    """Format by content type, else by the first characters."""
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    return (
        F.when(F.contains(kind, F.lit("xml")), True)
        .when(F.contains(kind, F.lit("html")), False)
        .otherwise(F.startswith(strip(body), F.lit("<?xml")))
    )


def with_html_locations(df: DataFrame, url: str, body: Column) -> DataFrame:
    """Add ``_links``: web links of an HTML body up to the first that cannot be read."""
    read = df.withColumns({"_hrefs": X.hrefs(anchors(body)), "_base": url_parts(F.col(url))})
    read = read.withColumn("_links", resolve_all(url, "_hrefs", "_base"))
    links = F.filter(X.readable_head(F.col("_links")), is_web)
    none = F.array().cast("array<string>")
    return read.withColumn("_links", F.coalesce(links, none)).drop("_hrefs", "_base")


def sitemap_documents(responses: DataFrame) -> DataFrame:
    """``(url, locations, children)`` of responses taken as sitemaps.

    ``children`` are the sitemaps an index names. XML that cannot be read to its end names
    nothing; entries are found at any depth (see ``xml_entries``). Keeps other columns.
    """
    xml = is_xml(F.col("content_type"), F.col("body"))
    split = responses.withColumn("_xml", xml)
    read = with_html_locations(split, "url", F.when(~F.col("_xml"), F.col("body")))
    read = read.withColumn("_entries", entries(F.when(F.col("_xml"), F.col("body"))))
    none = F.array().cast("array<string>")
    is_index = F.coalesce(F.col("_entries.is_index"), F.lit(False))
    found = F.coalesce(F.col("_entries.locations"), none)
    return read.withColumns(
        {
            "locations": F.when(~F.col("_xml"), F.col("_links")).when(is_index, none).otherwise(found),
            "children": F.when(is_index, found).otherwise(none),
        }
    ).drop("_xml", "_entries", "_links", "body", "content_type", "status")
