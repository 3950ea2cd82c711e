"""Breadth-first crawl of a page snapshot, level by level; only visited pages are parsed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteindex.constants import CRAWL_MODES, DEFAULT_CRAWL_PAGES, DEFAULT_MAX_DEPTH, DEFAULT_MODE
from siteindex.operators.ranking import major, minor, numbered, place
from siteindex.plans.catalog import only
from siteindex.plans.pages import crawl_records_of
from siteindex.session import keep


def crawl(
    starts: DataFrame,
    pages: DataFrame,
    mode: str = DEFAULT_MODE,
    max_pages: int = DEFAULT_CRAWL_PAGES,
    max_depth: int = DEFAULT_MAX_DEPTH,
    keep_html: bool = False,
) -> DataFrame:
    """Pages reached from ``starts(site_id, url)``, ranked in visiting order per site.

    A queue visits level by level: within a level by the rank of the linking page and
    the place of the link. Each URL is visited once per site, also when its page is
    missing; only pages found count towards ``max_pages``. Unknown modes crawl docs.
    Columns ``traversal_mode``, ``max_pages`` and ``max_depth`` of ``starts`` give sites
    settings of their own; where they are missing or NULL the arguments hold.

    A level looks its candidates up among the URLs of the snapshot, numbers those that are
    there, and reads and parses only pages that its sites have room for, each page once in
    the whole crawl. A page that turns out empty or unreadable gives its room to the next
    candidates of its site.
    """
    given = {"traversal_mode": mode, "max_pages": max_pages, "max_depth": max_depth}
    own = [name for name in given if name in starts.columns]
    sites = starts.select(
        "site_id", "url", *(F.coalesce(name, F.lit(given[name])).alias(name) for name in own),
        *(F.lit(value).alias(name) for name, value in given.items() if name not in own),
    )
    known = F.col("traversal_mode").isin(*CRAWL_MODES)
    sites = sites.withColumn(
        "traversal_mode", F.when(known, F.col("traversal_mode")).otherwise(DEFAULT_MODE)
    )
    settings = ["site_id", *given]
    if own:
        sites = keep(sites, "crawl-sites")
    modes = tuple(CRAWL_MODES) if "traversal_mode" in own else (mode,) if mode in CRAWL_MODES else (DEFAULT_MODE,)
    deepest = max_depth
    if "max_depth" in own:
        deepest = sites.agg(F.max("max_depth")).first()[0]
    deepest = -1 if deepest is None else deepest
    followed = F.coalesce(
        *(F.when(F.col("traversal_mode") == m, F.col(f"follow_{m}")) for m in modes)
    )

    frontier = sites.select(
        *settings, "url", F.lit(0).alias("parent"), F.lit(0).alias("pos"), F.lit(0).alias("taken")
    ).where(F.col("max_depth") >= 0)
    seen: list[DataFrame] = []
    records: list[DataFrame] = []
    steps: list[DataFrame] = []
    for depth in range(max(deepest, 0) + 1):
        level = keep(_candidates(frontier, settings, seen, pages), "level")
        seen.append(level.select("site_id", "url"))
        window = level.where(F.col("at") < F.col("room")).withColumn("high", F.col("room"))
        chosen = [window]
        wanted = window.count()
        while True:
            records.append(keep(_records(chosen[-1], pages, modes, records), "records"))
            read = _union([r.select("url", *(f"follow_{m}" for m in modes)) for r in records])
            found = _union([c.drop("high") for c in chosen]).join(read, "url")
            reached = found.count()
            if reached == wanted:
                break
            # pages that failed: the windows of their sites move on by as many candidates
            failed = chosen[-1].join(read, "url", "left_anti").groupBy("site_id", "high")
            moved = failed.agg(F.count(F.lit(1)).cast("int").alias("n"))
            further = (
                level.join(moved, "site_id")
                .where((F.col("at") >= F.col("high")) & (F.col("at") < F.col("high") + F.col("n")))
                .withColumn("high", F.col("high") + F.col("n"))
                .drop("n")
            )
            chosen.append(keep(further, "further"))
            added = chosen[-1].count()
            if not added:
                break
            wanted = reached + added
        if reached < wanted or len(chosen) > 1:  # failed pages leave gaps in the numbers
            found = numbered(keep(found.drop("at"), "found"), ["site_id"], "parent", ["pos"], "at")
        step = found.withColumn("rank", F.col("taken") + F.col("at")).select(
            *settings, "url", "rank", F.lit(depth).alias("depth"), followed.alias("follow")
        )
        steps.append(step)
        if depth >= deepest or not reached:
            break
        taken = (
            step.groupBy("site_id")
            .agg((F.max("rank") + 1).alias("taken"), F.first("max_pages").alias("cap"))
            .where(F.col("taken") < F.col("cap"))
            .drop("cap")
        )
        frontier = (
            step.where(F.col("max_depth") > depth)
            .join(taken, "site_id")
            .select(
                *settings,
                "taken",
                F.col("rank").alias("parent"),
                F.posexplode("follow").alias("pos", "url"),
            )
        )

    visited = _union(steps).select("site_id", "url", "rank", "depth", "traversal_mode")
    shown = _union(records).drop(*(f"follow_{m}" for m in modes))
    crawled = visited.join(shown, "url")
    if "map" in modes:
        crawled = crawled.withColumn(
            "structure_info", F.when(F.col("traversal_mode") == "map", F.col("structure_info"))
        )
    labels = F.create_map(*(F.lit(x) for m, (label, *_) in CRAWL_MODES.items() for x in (m, label)))
    crawled = crawled.withColumn("traversal_mode", labels[F.col("traversal_mode")])
    if not keep_html:
        return crawled
    # a written list: if it is short it is broadcast, and not the snapshot shuffled to it
    pages = only(pages, keep(visited.select("url"), "visited"))
    return crawled.join(pages.select("url", "html"), "url")


def _candidates(
    frontier: DataFrame, settings: list[str], seen: list[DataFrame], pages: DataFrame
) -> DataFrame:
    """Candidates of a level that the snapshot has and no level had before, numbered by site.

    ``at`` is the number, ``room`` how many pages the site may still visit. Of the snapshot
    only the URLs are read. Missing pages need not be remembered: they stay missing.
    """
    first = (
        frontier.groupBy(*settings, "url", "taken")
        .agg(F.min(place("parent", "pos")).alias("code"))
        .select(*settings, "url", "taken", major("code").alias("parent"), minor("code").alias("pos"))
    )
    if seen:
        first = first.join(_union(seen), ["site_id", "url"], "left_anti")
    # written, so that its size decides whether it is sent to the URLs of the snapshot
    first = keep(first, "frontier")
    there = pages.select("url").join(first.select("url").distinct(), "url", "left_semi")
    present = first.join(there.distinct(), "url", "left_semi")
    return numbered(present, ["site_id"], "parent", ["pos"], "at").withColumn(
        "room", F.col("max_pages") - F.col("taken")
    )


def _records(
    chosen: DataFrame, pages: DataFrame, modes: tuple[str, ...], known: list[DataFrame]
) -> DataFrame:
    """What the chosen pages hold; those read before, for another site, are left out."""
    urls = chosen.select("url").distinct()
    if known:
        urls = urls.join(_union([r.select("url") for r in known]), "url", "left_anti")
    return crawl_records_of(only(pages, urls), modes)


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)
