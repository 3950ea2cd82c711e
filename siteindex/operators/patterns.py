"""First rules that match, for sites with many patterns.

A test of each pattern on each text costs their product. Here the patterns of a site are one
automaton that reads a text once, however many there are. Texts keep no copy of the rules: the
rules of a site come as one row before each block of its texts, so that a task holds the
automata of one site at a time and a large site lies over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteindex.constants import OTHER_CATEGORY

#: Texts of a site that go by one copy of its rules.
BLOCK_TEXTS = 4096


class FirstPattern:
    """The least number among the patterns that a text contains, else None."""

    def __init__(self, numbered):
        import ahocorasick

        least: dict[str, int] = {}
        for number, patterns in numbered:
            for pattern in patterns or ():
                if pattern is not None:
                    least.setdefault(pattern, number)
        self.always = least.pop("", None)  # every text contains the empty pattern
        self.automaton = ahocorasick.Automaton() if least else None
        for pattern, number in least.items():
            self.automaton.add_word(pattern, number)
        if least:
            self.automaton.make_automaton()

    def __call__(self, text: str | None) -> int | None:
        if text is None:
            return None
        best = self.always
        if self.automaton is not None:
            for _, number in self.automaton.iter(text):
                if best is None or number < best:
                    best = number
        return best


class Rules:
    """The rules of one site: category of the first that matches URL or lower-cased title."""

    def __init__(self, rules):
        known = [(i, r) for i, r in enumerate(rules or ()) if r is not None]
        self.names = {i: r["category"] for i, r in known}
        self.urls = FirstPattern((i, r["url_patterns"]) for i, r in known)
        self.titles = FirstPattern((i, r["title_patterns"]) for i, r in known)

    def category(self, url: str | None, lowered: str | None) -> str:
        found = [n for n in (self.urls(url), self.titles(lowered)) if n is not None]
        name = self.names[min(found)] if found else None
        return OTHER_CATEGORY if name is None else name


def pattern_count(rules: str = "category_rules") -> Column:
    """How many patterns the rules of a site hold."""
    sizes = F.transform(
        F.col(rules),
        lambda r: F.greatest(F.size(r["url_patterns"]), F.lit(0))
        + F.greatest(F.size(r["title_patterns"]), F.lit(0)),
    )
    return F.coalesce(F.aggregate(sizes, F.lit(0), lambda a, x: a + x), F.lit(0))


def first_categories(
    texts: DataFrame, rules: DataFrame, block: Column, keys: Sequence[str] = ("rank",)
) -> DataFrame:
    """``site_id, *keys, url, title, category`` for ``texts`` with these columns but the last.

    ``rules`` is ``(site_id, category_rules)``, one row per site. ``block`` splits the texts of a
    site into parts of bounded size, as ``rank div BLOCK_TEXTS`` does. Texts of sites without
    rules are of the category Other. ``texts`` is read twice: pass a written table.
    """
    shown = texts.select("site_id", block.alias("_block"), *keys, "url", "title")
    blocks = shown.select("site_id", "_block").distinct()
    heads = blocks.join(rules.select("site_id", "category_rules"), "site_id")
    lowered = shown.withColumn("_lowered", F.lower("title")).withColumn("_at", F.lit(1))
    rows = lowered.unionByName(heads.withColumn("_at", F.lit(0)), allowMissingColumns=True)
    placed = rows.repartition("site_id", "_block").sortWithinPartitions("site_id", "_block", "_at")
    out = texts.select("site_id", *keys, "url", "title").schema.add("category", "string")
    kept = ["site_id", *keys, "url", "title"]

    def match(batches):
        held, site = Rules(None), None
        for batch in batches:
            heads = batch.column("_at").to_pylist()
            sites = batch.column("site_id").to_pylist()
            urls, titles = batch.column("url").to_pylist(), batch.column("_lowered").to_pylist()
            rules_at = batch.column("category_rules")
            places, found = [], []
            for i, head in enumerate(heads):
                if not head:
                    if sites[i] != site:
                        held, site = Rules(rules_at[i].as_py()), sites[i]
                    continue
                if sites[i] != site:  # no row of rules came before
                    held, site = Rules(None), sites[i]
                places.append(i)
                found.append(held.category(urls[i], titles[i]))
            if places:
                columns = [batch.column(name).take(pa.array(places)) for name in kept]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(found, pa.string())], [*kept, "category"]
                )

    return placed.mapInArrow(match, out)
