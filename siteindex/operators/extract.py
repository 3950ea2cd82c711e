"""Fields of a page, read from its elements and tokens (see ``views.with_view``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from siteindex.constants import (
    CODE_LANGUAGES,
    CRAWL_TITLE_SEPARATORS,
    CRAWL_UNTITLED,
    TITLE_SEPARATORS,
    UNTITLED,
)
from siteindex.functions.text import cut_at, first_where, let, squeeze, strip
from siteindex.functions.urls import (
    is_bare_host,
    is_web,
    netloc,
    path_title,
    resolve_sql,
    slash_depth,
)
from siteindex.operators.views import (
    DOCUMENT,
    Texts,
    carrying,
    element,
    has,
    span,
    text_of,
    token,
)
from siteindex.sources.nodes import HEADINGS, bit


#: NaN and infinities where JSON has a value.
NOT_NUMBERS = r"(?<=[:,\[]\s{0,9})-?(?:NaN|Infinity)(?=\s*[,}\]])"


def _having(elements: Column, *selectors: str) -> Column:
    mask = bit(*selectors)
    return F.filter(elements, lambda n: has(n["own"], mask))


def _first_text(places: Column, texts: Texts, test) -> Column:
    """Stripped text of the first place that passes a test of the length it has stripped."""
    return strip(texts.of(first_where(places, lambda n: test(texts.stripped_length(n)))))


def _meta(elements: Column, attribute: str, value: str) -> Column:
    """Content of the first meta element of that name; NULL if missing or empty."""
    found = first_where(
        elements, lambda n: has(n["own"], bit("meta")) & (n["attrs"][attribute] == value)
    )
    return let(found["attrs"]["content"], lambda content: F.when(content != "", strip(content)))


def title(
    elements: Column, texts: Texts, url: Column, own: Sequence[int] = ()
) -> Column:
    """Title element without site name, first real h1, meta title, URL path.

    ``own`` are masks of the elements to look at before, best first.
    """
    chosen = [
        _first_text(F.filter(elements, carrying(mask)), texts, lambda size: size > 3)
        for mask in own
    ]
    named = strip(texts.of(F.get(_having(elements, "title"), F.lit(0))))
    own_title = cut_at(named, TITLE_SEPARATORS)
    return F.coalesce(
        *chosen,
        let(own_title, lambda t: F.when(F.length(t) > 3, t)),
        _first_text(_having(elements, "h1"), texts, lambda size: size > 3),
        _meta(elements, "name", "title"),
        F.nullif(path_title(url), F.lit("")),
        F.lit(UNTITLED),
    )


def crawl_title(nodes: Column, url: Column) -> Column:
    """Title as the crawler reads it from the untouched page."""

    def text(place: Column) -> Column:
        tokens = F.transform(span(nodes, place), lambda n: token(n, DOCUMENT, F.lit(False)))
        return strip(F.array_join(tokens, ""))

    def first(selector: str) -> Column:
        return first_where(nodes, lambda n: element(n, DOCUMENT, bit(selector)))

    return F.coalesce(
        let(cut_at(text(first("title")), CRAWL_TITLE_SEPARATORS), lambda t: F.nullif(t, F.lit(""))),
        text(first("h1")),
        path_title(url),
        F.lit(CRAWL_UNTITLED),
    )


def description(elements: Column, texts: Texts) -> Column:
    """Meta description, og:description, first paragraph of medium length, or ''."""
    return F.coalesce(
        _meta(elements, "name", "description"),
        _meta(elements, "property", "og:description"),
        _first_text(_having(elements, "p"), texts, lambda size: (size > 50) & (size < 300)),
        F.lit(""),
    )


def main_text(tokens: Column, place: Column) -> Column:
    return squeeze(text_of(tokens, place))


def headings(elements: Column, texts: Texts) -> Column:
    """Headings that show text."""
    return F.transform(
        F.filter(_having(elements, *HEADINGS), texts.shows),
        lambda n: F.struct(
            F.substring(n["tag"], 2, 1).cast("int").alias("level"),
            strip(texts.of(n)).alias("text"),
            F.coalesce(n["attrs"]["id"], F.lit("")).alias("id"),
        ),
    )


def language(node: Column) -> Column:
    """Code language named by the element's own class or data attribute."""

    def named(word: Column) -> Column:
        return F.startswith(word, F.lit("language-")) | word.isin(*CODE_LANGUAGES)

    word = first_where(F.split(F.coalesce(node["attrs"]["class"], F.lit("")), r"\s+"), named)
    return F.coalesce(
        F.when(F.startswith(word, F.lit("language-")), F.replace(word, F.lit("language-"), F.lit("")))
        .otherwise(word),
        F.nullif(node["attrs"]["data-language"], F.lit("")),
        F.lit("text"),
    )


def code_blocks(elements: Column, texts: Texts) -> Column:
    """pre elements, and longer code elements that do not stand in a pre."""
    is_block = lambda n: has(n["own"], bit("pre"))
    kept = F.filter(
        _having(elements, "pre", "code"),
        lambda n: is_block(n) | (~has(n["up"], bit("pre")) & (texts.length(n) > 10)),
    )
    return F.transform(
        kept,
        lambda n: F.struct(
            F.when(is_block(n), "block").otherwise("inline").alias("type"),
            language(n).alias("language"),
            texts.of(n).alias("content"),
        ),
    )


def _shown_links(elements: Column, texts: Texts) -> Column:
    return F.filter(elements, lambda n: has(n["own"], bit("a[href]")) & texts.shows(n))


def anchor_texts(elements: Column, texts: Texts) -> Column:
    """Structs of href and text of the links that have both."""
    return F.transform(
        _shown_links(elements, texts),
        lambda n: F.struct(n["attrs"]["href"].alias("href"), strip(texts.of(n)).alias("text")),
    )


def shown_hrefs(elements: Column, texts: Texts) -> Column:
    """Hrefs of the links that have both address and text."""
    return F.transform(_shown_links(elements, texts), lambda n: n["attrs"]["href"])


def page_links(anchors: str, url: str, parts: str) -> Column:
    """Structs of url, text and type; the ``url`` is NULL where a link cannot be read.

    Takes column names: that of ``anchor_texts``, the page's URL and its parts.
    """
    complete = F.expr(
        f"transform({anchors}, a -> named_struct('url', {resolve_sql(url, 'a.href', parts)}, "
        "'text', a.text))"
    )
    return F.transform(
        complete,
        lambda a: F.struct(
            a["url"].alias("url"),
            a["text"].alias("text"),
            F.when(netloc(a["url"]) != F.col(parts)["netloc"], "external")
            .otherwise("internal")
            .alias("type"),
        ),
    )


def hrefs(nodes_or_elements: Column) -> Column:
    """Every href in document order, empty ones included."""
    anchors = F.filter(nodes_or_elements, lambda n: has(n["own"], bit("a")) & (n["kind"] == "el"))
    return F.filter(
        F.transform(anchors, lambda n: n["attrs"]["href"]), lambda href: href.isNotNull()
    )


def readable_head(links: Column) -> Column:
    """Links before the first one that cannot be read: reading stops there."""
    size = F.size(links)
    stop = F.array_position(F.transform(links, lambda u: u.isNull()), True)
    return F.when(stop > 0, F.slice(links, F.lit(1), (stop - 1).cast("int"))).otherwise(
        F.when(size >= 0, links)
    )


def web_links(links: Column) -> Column:
    return F.filter(links, is_web)


def metadata(elements: Column) -> Column:
    """Map of meta name (or property) to content; the last of a name wins."""
    named = F.transform(
        _having(elements, "meta"),
        lambda n, i: F.struct(
            F.coalesce(
                F.nullif(n["attrs"]["name"], F.lit("")), F.nullif(n["attrs"]["property"], F.lit(""))
            ).alias("key"),
            i.alias("i"),
            n["attrs"]["content"].alias("value"),
        ),
    )
    filled = F.array_sort(F.filter(named, lambda m: m["key"].isNotNull() & (m["value"] != "")))

    def last_of_each(items: Column) -> Column:
        kept = F.filter(
            items, lambda m, i: F.coalesce(F.get(items, i + 1)["key"] != m["key"], F.lit(True))
        )
        return F.map_from_entries(
            F.transform(kept, lambda m: F.struct(m["key"].alias("k"), m["value"].alias("v")))
        )

    return let(filled, last_of_each)


def structured_data(elements: Column, nodes: Column) -> Column:
    """Last JSON-LD script that parses, as JSON text; NULL if there is none."""
    scripts = F.transform(
        F.filter(
            elements,
            lambda n: has(n["own"], bit("script")) & (n["attrs"]["type"] == "application/ld+json"),
        ),
        lambda n: F.array_join(F.transform(span(nodes, n), lambda m: m["text"]), ""),
    )
    # numbers that are none are read like others; a key that repeats needs a session setting
    plain = lambda s: F.regexp_replace(s, NOT_NUMBERS, "0")
    parsed = F.filter(scripts, lambda s: F.try_parse_json(plain(s)).isNotNull())
    return F.when(F.size(parsed) > 0, F.element_at(parsed, -1))


def structure(nodes: Column, url: Column) -> Column:
    """Shape of a page: depth, homepage, nav, aside, footer, headings, links."""

    def any_of(tag: str) -> Column:
        return F.exists(nodes, lambda n: element(n, DOCUMENT, bit(tag)))

    return F.struct(
        slash_depth(url).cast("int").alias("depth"),
        is_bare_host(url).alias("is_homepage"),
        any_of("nav").alias("has_navigation"),
        any_of("aside").alias("has_sidebar"),
        any_of("footer").alias("has_footer"),
        F.size(F.filter(nodes, lambda n: element(n, DOCUMENT, bit(*HEADINGS)))).alias(
            "heading_count"
        ),
        F.size(hrefs(nodes)).alias("link_count"),
    )
