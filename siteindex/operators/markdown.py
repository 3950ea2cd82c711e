"""Page to markdown-like text on one line.

Rewrites happen in a fixed order (headings, links, bullets, numbered items, pre, code)
and each one takes the text its element has by then: a link in a heading loses its
markup, a list item keeps that of a link in it. The marks of the enclosing elements
tell which rewrite came first, so no element is compared with another.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siteindex.constants import MARKDOWN_REMOVED_TAGS
from siteindex.functions.text import let, squeeze, strip
from siteindex.operators.views import View, has, text_of, token
from siteindex.sources.nodes import HEADINGS, bit

_VIEW = View(dropped=bit(*MARKDOWN_REMOVED_TAGS))
_LINK, _BULLET, _NUMBER = bit("a:top"), bit("ul li"), bit("ol li")
_PRE, _CODE = bit("pre"), bit("code")
_BEFORE_BULLETS = bit(*HEADINGS) | _LINK
_BEFORE_NUMBERS = _BEFORE_BULLETS | _BULLET
_BEFORE_PRE = _BEFORE_NUMBERS | _NUMBER


def _stands(n: Column, own: int, taken: int) -> Column:
    """Element (or its end) that no earlier rewrite has turned into text."""
    gone = has(n["above"].bitwiseOR(n["own"]), _VIEW.dropped)
    return has(n["own"], own) & ~has(n["above"], taken) & ~gone


def _numbered(n: Column) -> Column:
    return _stands(n, _NUMBER, _BEFORE_NUMBERS) & ~has(n["own"], _BULLET)


def _fences(n: Column, opening: str, closing: str) -> Column:
    return F.when(n["kind"] == "el", opening).otherwise(closing)


def _with_headings(n: Column) -> Column:
    text = token(n, _VIEW, F.lit(False))
    for level, tag in enumerate(HEADINGS, 1):
        text = F.when(
            _stands(n, bit(tag), bit(*HEADINGS[:level])), _fences(n, f"\n{'#' * level} ", "\n")
        ).otherwise(text)
    return text


def _rewritten(n: Column, texts: Column) -> Column:
    plain = F.get(texts, n["id"])
    link = let(
        strip(text_of(texts, n)),
        lambda text: F.when(
            text != "", F.concat(F.lit("["), text, F.lit("]("), n["attrs"]["href"], F.lit(")"))
        ).otherwise(text_of(texts, n)),
    )
    return (
        F.when(_stands(n, _LINK, 0), link)
        .when(has(n["above"], _LINK), "")
        .when(_stands(n, _BULLET, _BEFORE_NUMBERS), _fences(n, "\n- ", "\n"))
        .when(_numbered(n) & ~has(n["above"], _NUMBER), _fences(n, "", "\n"))
        .when(_stands(n, _PRE, _BEFORE_PRE | _PRE), _fences(n, "\n```\n", "\n```\n"))
        .when(_stands(n, _CODE, _BEFORE_PRE | _PRE | _CODE), F.lit("`"))
        .otherwise(plain)
    )


def _items(nodes: Column) -> Column:
    """Items of ordered lists in document order, counted per outermost list.

    Items nested in items are counted too, but only outer ones show their number.
    """
    lists = F.filter(
        nodes, lambda n: (n["kind"] == "el") & has(n["own"], bit("ol")) & ~has(n["above"], bit("ol"))
    )

    def count(outer: Column) -> Column:
        inside = F.slice(nodes, outer["id"] + 1, outer["last"] - outer["id"] + 1)
        found = F.filter(inside, lambda n: (n["kind"] == "el") & _numbered(n))
        return F.transform(
            found,
            lambda n, i: F.struct(
                n["id"].alias("id"),
                F.when(
                    ~has(n["above"], _NUMBER), F.concat(F.lit("\n"), i + 1, F.lit(". "))
                ).otherwise("").alias("lead"),
            ),
        )

    return F.flatten(F.transform(lists, count))


def _stitched(parts: Column) -> Column:
    tokens, items = parts["tokens"], parts["items"]

    def chunk(item: Column, i: Column) -> Column:
        end = F.coalesce(F.get(items, i + 1)["id"], F.size(tokens))
        return F.concat(
            item["lead"], F.array_join(F.slice(tokens, item["id"] + 1, end - item["id"]), "")
        )

    start = F.coalesce(F.get(items, F.lit(0))["id"], F.size(tokens))
    head = F.array_join(F.slice(tokens, F.lit(1), start), "")
    return F.concat(head, F.array_join(F.transform(items, chunk), ""))


def markdown(nodes: Column, html: Column) -> Column:
    """Markdown-like text of a page; the HTML itself if it could not be read."""
    texts = F.transform(nodes, _with_headings)
    tokens = let(texts, lambda t: F.transform(nodes, lambda n: _rewritten(n, t)))
    parts = F.struct(tokens.alias("tokens"), _items(nodes).alias("items"))
    return F.coalesce(squeeze(let(parts, _stitched)), html)
