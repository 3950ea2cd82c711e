"""Catalogue: the discovered pages of each site with title, text and category."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteindex.constants import OTHER_CATEGORY
from siteindex.functions.text import contains_any_of, first_where
from siteindex.operators.patterns import BLOCK_TEXTS, first_categories, pattern_count
from siteindex.operators.views import CLEANERS, Cleaner
from siteindex.plans.discover import discover, seeds
from siteindex.plans.pages import processed, site_links
from siteindex.session import keep

RECORD = ("url", "title", "description", "content", "category", "source")
#: Patterns of a site up to which each is tested by itself, without a pass through Python.
FEW_PATTERNS = 64


def category(url: Column, title: Column, rules: Column) -> Column:
    """Category of the first rule that matches URL or lower-cased title, or Other."""
    lowered = F.lower(title)
    match = first_where(
        rules,
        lambda r: contains_any_of(url, r["url_patterns"])
        | contains_any_of(lowered, r["title_patterns"]),
    )
    return F.coalesce(match["category"], F.lit(OTHER_CATEGORY))


def page_facts(
    pages: DataFrame, cleaners: Sequence[Cleaner] = CLEANERS, titles: Sequence[str] = ()
) -> DataFrame:
    """``(url, title, description, content)``: all a catalogue needs from a page."""
    return processed(pages, cleaners, titles=titles).select(
        "url", "title", "description", F.col("main_content").alias("content")
    )


def only(pages: DataFrame, listed: DataFrame) -> DataFrame:
    """The pages of the listed URLs, before anything is parsed.

    Pass a written list: its size decides whether it is sent to the pages, so that these
    stay where they are, or the pages are met by URL.
    """
    return pages.join(listed.select("url").distinct(), "url", "left_semi")


def build_catalog(
    discovered: DataFrame,
    pages: DataFrame,
    sites: DataFrame,
    cleaners: Sequence[Cleaner] = CLEANERS,
    titles: Sequence[str] = (),
) -> DataFrame:
    """``(site_id, rank, url, title, description, content, category, source)``.

    Pages that were not found are left out. Only listed pages are parsed, each once, and
    the rules meet the list before the text does.
    """
    rules = keep(sites.select("site_id", "category_rules"), "rules")
    listed = keep(discovered, "listed")
    facts = keep(page_facts(only(pages, listed), cleaners, titles), "facts")
    few = (rules.agg(F.max(pattern_count())).first()[0] or 0) <= FEW_PATTERNS
    if few:
        labelled = listed.join(rules, "site_id", "left").join(facts, "url").withColumn(
            "category", category(F.col("url"), F.col("title"), F.col("category_rules"))
        )
    else:
        titled = keep(listed.join(facts.select("url", "title"), "url"), "titled")
        named = keep(categorised(titled, rules), "named").drop("title")
        sources = listed.select("site_id", "rank", "source")
        labelled = named.join(sources, ["site_id", "rank"]).join(facts, "url")
    return labelled.select("site_id", "rank", *RECORD)


def categorised(titled: DataFrame, rules: DataFrame) -> DataFrame:
    """``site_id, rank, url, title, category``, by one automaton for the patterns of a site.

    The same as ``category`` at a cost that hardly depends on the number of patterns; ranks are
    those of the list, so that a block of them is bounded. ``titled`` is read twice.
    """
    block = F.expr(f"rank div {BLOCK_TEXTS}")
    return first_categories(titled, rules, block)


def catalog(
    sites: DataFrame,
    pages: DataFrame,
    cleaners: Sequence[Cleaner] = CLEANERS,
    titles: Sequence[str] = (),
) -> DataFrame:
    """Discover, process and categorise.

    Start pages are read for their links, discovered pages for their text; other pages of
    the snapshot are not parsed.
    """
    starts = keep(seeds(sites).select(F.col("base_url").alias("url")).distinct(), "starts")
    links = site_links(only(pages, starts))
    return build_catalog(discover(sites, links), pages, sites, cleaners, titles)
