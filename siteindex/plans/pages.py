"""Row-wise page processing: no shuffle, HTML is dropped once it is parsed."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteindex.constants import (
    CRAWL_MODES,
    DISCOVERY_SKIP,
    FAILED_DESCRIPTION,
    FAILED_TITLE,
    TEXT_REMOVED_TAGS,
)
from siteindex.functions.urls import link_matches, resolve_all, same_site, url_parts
from siteindex.operators import extract as X
from siteindex.operators.markdown import markdown
from siteindex.operators.views import (
    CLEANERS,
    CRAWLED,
    DOCUMENT,
    Cleaner,
    Texts,
    View,
    element,
    text_of,
    view_of,
    with_tokens,
    with_view,
)
from siteindex.sources.nodes import anchors, bit, nodes
from siteindex.sources.snapshot import fetched

PROCESSED = (
    "url", "title", "description", "main_content", "headings", "code_blocks", "links",
    "metadata", "structured_data",
)


def parsed(pages: DataFrame, view: View = DOCUMENT) -> DataFrame:
    """Pages with content and their node array; the HTML is gone.

    The nodes have marks for the selectors that ``view`` brings along.
    """
    found = nodes(F.col("html"), view.own, view.folded if view.own else 0)
    return fetched(pages).withColumn("nodes", found).drop("html")


def processed(
    pages: DataFrame,
    cleaners: Sequence[Cleaner] = CLEANERS,
    extra: Sequence[str] = (),
    titles: Sequence[str] = (),
) -> DataFrame:
    """Processed pages: title, description, text, headings, code, links, metadata.

    Cleaners run first and the fields are read from what they leave. A page that
    cannot be read, or that holds a link that cannot be read, becomes a failure row.
    ``extra`` names further columns to keep, ``titles`` selectors of titles to be tried before
    the usual ones. Cleaners and titles may use any selector (``sources.selectors``).
    """
    view = view_of(cleaners).knowing(*titles)
    return extracted(parsed(pages, view), cleaners, extra, titles)


def extracted(
    df: DataFrame,
    cleaners: Sequence[Cleaner] = CLEANERS,
    extra: Sequence[str] = (),
    titles: Sequence[str] = (),
) -> DataFrame:
    """Same, over pages that are parsed already, with the marks of the same selectors."""
    url, tokens, elements = F.col("url"), F.col("tokens"), F.col("elements")
    texts = Texts(F.col("texts"))
    view = view_of(cleaners).knowing(*titles)
    # title and description are read first; the text and all that follows them never
    # show scripts or navigation, whatever the cleaners left
    later = replace(view, dropped=view.dropped | bit(*TEXT_REMOVED_TAGS))
    fields = with_view(df, view).withColumns(
        {
            "title": X.title(elements, texts, url, [view.mask(s) for s in titles]),
            "description": X.description(elements, texts),
            "base": url_parts(url),
        }
    )
    if later != view:
        fields = with_tokens(fields, later)
    fields = fields.withColumn("anchors", X.anchor_texts(elements, texts)).withColumn(
        "links", X.page_links("anchors", "url", "base")
    )
    # a page fails for a link that cannot be read and shows text; no text is built for that
    fields = fields.withColumn("shown_hrefs", X.shown_hrefs(elements, texts))
    unread = F.exists(resolve_all("url", "shown_hrefs", "base"), lambda u: u.isNull())
    fields = fields.withColumn("failed", F.col("nodes").isNull() | unread)

    def unless_failed(value, otherwise):
        return F.when(F.col("failed"), otherwise).otherwise(value)

    def empty(kind: str):
        return F.array().cast(kind)

    return fields.select(
        *extra,
        "url",
        unless_failed(F.col("title"), F.lit(FAILED_TITLE)).alias("title"),
        unless_failed(F.col("description"), F.lit(FAILED_DESCRIPTION)).alias("description"),
        unless_failed(X.main_text(tokens, F.col("place")), F.lit("")).alias("main_content"),
        unless_failed(
            X.headings(elements, texts), empty("array<struct<level:int,text:string,id:string>>")
        ).alias("headings"),
        unless_failed(
            X.code_blocks(elements, texts),
            empty("array<struct<type:string,language:string,content:string>>"),
        ).alias("code_blocks"),
        unless_failed(
            F.col("links"), empty("array<struct<url:string,text:string,type:string>>")
        ).alias("links"),
        unless_failed(X.metadata(elements), F.create_map().cast("map<string,string>")).alias(
            "metadata"
        ),
        unless_failed(
            X.structured_data(elements, F.col("nodes")), F.lit(None).cast("string")
        ).alias("structured_data"),
    )


def markdown_pages(pages: DataFrame) -> DataFrame:
    """One markdown-like text per page."""
    read = fetched(pages).withColumn("nodes", nodes(F.col("html")))
    return read.select("url", markdown(F.col("nodes"), F.col("html")).alias("text"))


def site_links(pages: DataFrame) -> DataFrame:
    """``(url, links)``: links of each page that lead to pages of the same host.

    Keeps document order and repeats. Only anchors leave the parser.
    """
    url = F.col("url")
    hrefs = fetched(pages).select("url", X.hrefs(anchors(F.col("html"))).alias("hrefs"))
    based = hrefs.withColumn("base", url_parts(url))
    complete = based.withColumn("links", resolve_all("url", "hrefs", "base"))
    return complete.select(
        "url",
        F.filter(
            X.readable_head(F.col("links")),
            lambda link: same_site(link, F.col("base.netloc"), DISCOVERY_SKIP),
        ).alias("links"),
    )


def crawl_links(pages: DataFrame, modes: Sequence[str]) -> DataFrame:
    """``(url, follow_…)``: the few links that each mode would follow from a page.

    Pages are left out, or followed no further, as in ``crawl_records``. Only anchors leave
    the parser; the marks they carry tell which part of the page they stand in.
    """
    url, n = F.col("url"), F.col("nodes")
    read = fetched(pages).withColumn("nodes", anchors(F.col("html"))).drop("html")
    read = read.where(n.isNotNull()).withColumns(
        {
            "base": url_parts(url),
            "hrefs": X.hrefs(n),
            "kept_hrefs": X.hrefs(F.filter(n, lambda node: element(node, CRAWLED))),
        }
    )
    read = _resolved(read)
    return read.select(
        "url", *(_followed(*CRAWL_MODES[mode][1:]).alias(f"follow_{mode}") for mode in modes)
    )


def _resolved(read: DataFrame) -> DataFrame:
    """Links of the page and of its kept part; pages with an unreadable kept link go."""
    return read.withColumns(
        {
            "all_links": resolve_all("url", "hrefs", "base"),
            "kept_links": resolve_all("url", "kept_hrefs", "base"),
        }
    ).where(~F.exists("kept_links", lambda u: u.isNull()))


def _followed(words: Sequence[str], width: int):
    return F.when(
        F.exists("all_links", lambda u: u.isNull()), F.array().cast("array<string>")
    ).otherwise(F.slice(F.filter("all_links", lambda u: link_matches(u, words)), 1, width))


def crawl_records(pages: DataFrame, mode: str) -> DataFrame:
    """What a crawl reads from each page, and the few links it would follow.

    A page with an unreadable link in its kept part gives no record; one with such a
    link anywhere is recorded but not followed.
    """
    return crawl_records_of(pages, [mode]).withColumnRenamed(f"follow_{mode}", "follow")


def crawl_records_of(pages: DataFrame, modes: Sequence[str]) -> DataFrame:
    """The same with the links of several modes, ``follow_…``, read in one pass."""
    url, n = F.col("url"), F.col("nodes")
    read = parsed(pages).where(n.isNotNull())
    read = with_view(read, CRAWLED).withColumns(
        {
            "base": url_parts(url),
            "hrefs": X.hrefs(n),
            "kept_hrefs": X.hrefs(F.filter(n, lambda node: element(node, CRAWLED))),
        }
    )
    read = _resolved(read)
    columns = [
        url,
        X.crawl_title(n, url).alias("title"),
        text_of(F.col("tokens"), F.col("place")).alias("content"),
        X.web_links(F.col("kept_links")).alias("links"),
        *(_followed(*CRAWL_MODES[mode][1:]).alias(f"follow_{mode}") for mode in modes),
    ]
    if "map" in modes:
        columns.append(X.structure(n, url).alias("structure_info"))
    return read.select(*columns)
