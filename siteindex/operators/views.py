"""Cleaning of a page as a view over its node array.

Cleaning never rewrites the array. A view says which marked subtrees are gone, which
elements turn into fenced text and which container is kept; the nodes are then read
through it. Positions stay those of the parser, so the text of an element is a slice.

A cleaner is a function ``View -> View``. ``CLEANERS`` is the usual list; pass another
one to leave some out or to add your own. Selectors may be any that ``sources.selectors``
reads: the view remembers those the parser does not know by itself, and the parser is made
for them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteindex.constants import (
    BLANKS,
    BOILERPLATE_CLASSES,
    CONTENT_SELECTORS,
    CRAWL_CONTENT_SELECTORS,
    CRAWL_REMOVED_TAGS,
    NAVIGATION_TAGS,
    SCRIPT_TAGS,
)
from siteindex.functions.text import first_where, let, strip
from siteindex.sources.nodes import EMPHASIS, MARKS, STRONG, UNSEEN, bit
from siteindex.sources.selectors import field, own_marks, words


@dataclass(frozen=True)
class View:
    """How the nodes of a page are read."""

    dropped: int = 0
    """Marks whose subtrees are gone."""
    fences: tuple[tuple[int, str], ...] = ()
    """Marks of elements that become plain text between two fences, in order."""
    tidy: bool = False
    """Strip each text node outside pre and code, and show notes as text."""
    containers: tuple[str, ...] = ()
    """Selectors of the part to keep, best first; the whole page if none is there."""
    own: tuple[str, ...] = ()
    """Selectors that the parser has to be told; marks follow from their order."""

    def knowing(self, *selectors: str) -> View:
        """The view with these selectors among those it has marks for."""
        new = dict.fromkeys(s for s in selectors if s not in MARKS and s not in self.own)
        return replace(self, own=(*self.own, *new)) if new else self

    def mask(self, *selectors: str) -> int:
        """Mask of selectors that the view knows."""
        marks = own_marks(self.own).masks if self.own else {}
        parts = (bit(s) if s in MARKS else marks[s] for s in selectors)
        return reduce(lambda a, b: a | b, parts, 0)

    @property
    def folded(self) -> int:
        return reduce(lambda a, b: a | b, (mask for mask, _ in self.fences), 0)

    def drop(self, *selectors: str) -> View:
        if self.fences:
            raise ValueError("remove markup before formatting is turned into text")
        view = self.knowing(*selectors)
        return replace(view, dropped=view.dropped | view.mask(*selectors))


Cleaner = Callable[[View], View]


def remove_scripts(view: View) -> View:
    return view.drop(*SCRIPT_TAGS)


def remove_navigation(view: View) -> View:
    return view.drop(*NAVIGATION_TAGS)


def remove_boilerplate(view: View) -> View:
    """Elements with a boilerplate class; ids do not count."""
    return view.drop(*("." + name for name in BOILERPLATE_CLASSES))


FORMATS: tuple[tuple[tuple[str, ...], str], ...] = ((STRONG, "**"), (EMPHASIS, "*"))


def clean_formatting(view: View, formats: Sequence[tuple[Sequence[str], str]] = FORMATS) -> View:
    """Bold and italic elements become ``**text**`` and ``*text*``."""
    for selectors, _ in formats:
        view = view.knowing(*selectors)
    fences = tuple((view.mask(*selectors), sign) for selectors, sign in formats)
    return replace(view, fences=fences, tidy=True)


def keep_main_content(view: View, selectors: Sequence[str] = CONTENT_SELECTORS) -> View:
    return replace(view.knowing(*selectors), containers=tuple(selectors))


def removing(*selectors: str) -> Cleaner:
    """A cleaner that removes what any of these selectors names."""
    return lambda view: view.drop(*selectors)


def keeping(*selectors: str) -> Cleaner:
    """A cleaner that keeps the first element of the first selector that names any."""
    return lambda view: keep_main_content(view, selectors)


CLEANERS: tuple[Cleaner, ...] = (
    remove_scripts,
    remove_navigation,
    remove_boilerplate,
    clean_formatting,
    keep_main_content,
)


def view_of(cleaners: Sequence[Cleaner] = CLEANERS) -> View:
    return reduce(lambda view, cleaner: cleaner(view), cleaners, View())


DOCUMENT = View()
CLEANED = view_of()
CRAWLED = View(dropped=bit(*CRAWL_REMOVED_TAGS), containers=CRAWL_CONTENT_SELECTORS)


def has(marks: Column, mask: int) -> Column:
    """Whether a word of marks has a bit of a standard mask."""
    return marks.bitwiseAND(F.lit(mask).cast("bigint")) != 0


def _any_word(mask: int, test: Callable[[int, int], Column]) -> Column:
    return reduce(lambda a, b: a | b, (test(n, part) for n, part in words(mask)), F.lit(False))


def carries(node: Column, mask: int) -> Column:
    """Whether a node itself has one of the marks, standard or own."""
    return _any_word(mask, lambda n, part: has(node[field("own", n)], part))


def carrying(mask: int) -> Callable[[Column], Column]:
    return lambda node: carries(node, mask)


def inside(node: Column, mask: int) -> Column:
    """Whether an element around a node has one of the marks."""
    return _any_word(mask, lambda n, part: has(node[field("above", n)], part))


def covered(node: Column, mask: int) -> Column:
    """Whether a node or an element around it has one of the marks."""
    both = lambda n: node[field("above", n)].bitwiseOR(node[field("own", n)])
    return _any_word(mask, lambda n, part: has(both(n), part))


def element(node: Column, view: View, mask: int = -1) -> Column:
    """Element that the view still shows as an element, with one of the marks."""
    test = (node["kind"] == "el") & ~covered(node, view.dropped | view.folded)
    return test if mask == -1 else test & carries(node, mask)


def container(nodes: Column, view: View) -> Column:
    """Struct node of the part to keep; NULL for the whole page."""
    if not view.containers:
        return F.lit(None).cast("struct<id:int,last:int>")
    mask = view.mask(*view.containers)
    marks = [field("own", number) for number, _ in words(mask)]
    places = F.transform(
        F.filter(nodes, lambda n: element(n, view, mask)),
        lambda n: F.struct(
            n["id"].alias("id"), n["last"].alias("last"), *(n[m].alias(m) for m in marks)
        ),
    )

    def best(found: Column) -> Column:
        firsts = (
            first_where(found, carrying(view.mask(selector))) for selector in view.containers
        )
        choice = F.coalesce(*firsts)
        return F.when(
            choice.isNotNull(), F.struct(choice["id"].alias("id"), choice["last"].alias("last"))
        )

    return let(places, best)


def token(node: Column, view: View, contained: Column) -> Column:
    """Text that a single node adds to the page's text."""
    gone = covered(node, view.dropped)
    fenced = F.lit(False)
    folded = 0
    fence = F.lit("")
    for mask, sign in reversed(view.fences):
        outer = 0
        for other, _ in view.fences:
            outer |= other
            if other == mask:
                break
        fence = F.when(carries(node, mask) & ~inside(node, outer), sign).otherwise(fence)
        folded |= mask
    if folded:
        fenced = inside(node, folded)
    unseen = has(node["above"], bit(*UNSEEN))
    verbatim = has(node["up"], bit("pre", "code"))
    if view.tidy:
        hidden = unseen & (fenced | contained)
        text = F.when(fenced | verbatim, node["text"]).otherwise(strip(node["text"]))
        note = F.when(fenced | verbatim | hidden, "").otherwise(strip(node["text"]))
    else:
        hidden, text, note = unseen, node["text"], F.lit("")
    return (
        F.when(gone, "")
        .when(node["kind"] == "text", F.when(hidden, "").otherwise(text))
        .when(node["kind"] == "note", note)
        .otherwise(fence)
    )


def span(items: Column, place: Column) -> Column:
    """Items of the subtree of a node (or struct with id and last)."""
    return F.slice(items, place["id"] + 1, place["last"] - place["id"] + 1)


def text_of(tokens: Column, place: Column) -> Column:
    """Text of an element without added separators."""
    return F.array_join(span(tokens, place), "")


#: Tokens whose sums are worked out one after the other; blocks of them are added up after.
_BLOCK = 64


class Texts:
    """Texts of elements as slices of one page text.

    ``texts`` has the page's text as bytes, for each node what stands before it (bytes,
    characters, the end of the last character that is not blank, and the number of nodes that
    show any), and the place of the first such character of each node that shows one. The
    length of an element's text, stripped or not, is a subtraction; its text is a slice.
    """

    def __init__(self, texts: Column):
        self.bytes, self.at, self.starts = texts["bytes"], texts["at"], texts["starts"]

    def _edges(self, place: Column) -> tuple[Column, Column]:
        return F.get(self.at, place["id"]), F.get(self.at, place["last"] + 1)

    def of(self, place: Column) -> Column:
        a, z = self._edges(place)
        return F.substring(self.bytes, a["b"] + 1, z["b"] - a["b"]).cast("string")

    def length(self, place: Column) -> Column:
        """Characters of the text."""
        a, z = self._edges(place)
        return z["c"] - a["c"]

    def shows(self, place: Column) -> Column:
        """Whether the text has more than white space."""
        a, z = self._edges(place)
        return z["n"] > a["n"]

    def stripped_length(self, place: Column) -> Column:
        """Characters of the text without blanks at its ends."""
        a, z = self._edges(place)
        return F.when(z["n"] > a["n"], z["e"] - F.get(self.starts, a["n"])).otherwise(0)


def _sums(b: Column, c: Column, e: Column, n: Column) -> Column:
    return F.struct(*(x.cast("int").alias(k) for k, x in zip("bcen", (b, c, e, n), strict=True)))


def _after(done: Column, text: Column) -> Column:
    """Sums up to a token and with it."""
    end = F.length(F.rtrim(text, F.lit(BLANKS)))
    return _sums(
        done["b"] + F.octet_length(text),
        done["c"] + F.length(text),
        F.when(end > 0, done["c"] + end).otherwise(done["e"]),
        done["n"] + F.when(end > 0, 1).otherwise(0),
    )


def _moved(base: Column, part: Column) -> Column:
    """Sums within a block on top of those before it."""
    return _sums(
        base["b"] + part["b"],
        base["c"] + part["c"],
        F.when(part["e"] > 0, base["c"] + part["e"]).otherwise(base["e"]),
        base["n"] + part["n"],
    )


def _running(items: Column, step: Callable[[Column, Column], Column]) -> Column:
    """Sums before each item and after the last."""
    none = F.array(_sums(*[F.lit(0)] * 4))
    return F.aggregate(
        items, none, lambda done, item: F.array_append(done, step(F.element_at(done, -1), item))
    )


def page_texts(tokens: Column) -> Column:
    """The struct that ``Texts`` reads."""
    count = F.floor((F.size(tokens) + _BLOCK - 1) / _BLOCK).cast("int")
    numbers = F.filter(F.sequence(F.lit(0), count), lambda k: k < count)
    blocks = F.transform(
        numbers, lambda k: _running(F.slice(tokens, k * _BLOCK + 1, _BLOCK), _after)
    )

    def joined(inner: Column) -> Column:
        totals = F.transform(inner, lambda sums: F.element_at(sums, -1))

        def placed(bases: Column) -> Column:
            before = F.transform(
                inner,
                lambda sums, k: F.transform(
                    F.slice(sums, 1, F.size(sums) - 1), lambda part: _moved(F.get(bases, k), part)
                ),
            )
            return F.array_append(F.flatten(before), F.element_at(bases, -1))

        return let(_running(totals, _moved), placed)

    def with_starts(at: Column) -> Column:
        shown = F.filter(
            F.transform(
                tokens,
                lambda t, i: F.when(
                    F.length(F.rtrim(t, F.lit(BLANKS))) > 0,
                    F.get(at, i)["c"] + F.length(t) - F.length(F.ltrim(t, F.lit(BLANKS))),
                ),
            ),
            lambda start: start.isNotNull(),
        )
        text = F.encode(F.array_join(tokens, ""), "utf-8")
        return F.struct(text.alias("bytes"), at.alias("at"), shown.alias("starts"))

    return let(let(blocks, joined), with_starts)


def with_view(df: DataFrame, view: View = CLEANED, nodes: str = "nodes") -> DataFrame:
    """Add what the extractors read: ``place``, ``tokens``, ``texts``, ``elements``, ``contained``.

    ``tokens`` has one text per node, at the node's position, and ``texts`` where each begins
    (see ``Texts``); ``elements`` holds the elements left by the view.
    """
    n = F.col(nodes)
    found = df.withColumn("_box", container(n, view))
    found = found.withColumn("contained", F.col("_box").isNotNull()).withColumn(
        "place",
        F.when(F.col("contained"), F.col("_box")).otherwise(
            F.struct(F.lit(0).alias("id"), (F.size(n) - 1).alias("last"))
        ),
    )
    return with_tokens(found.drop("_box"), view, nodes)


def with_tokens(df: DataFrame, view: View, nodes: str = "nodes") -> DataFrame:
    """Set ``tokens``, ``texts`` and ``elements`` for the container that is chosen already."""
    n = F.col(nodes)
    shown = lambda node: F.coalesce(token(node, view, F.col("contained")), F.lit(""))
    read = df.withColumns(
        {
            "tokens": F.transform(n, shown),
            "elements": F.filter(span(n, F.col("place")), lambda node: element(node, view)),
        }
    )
    return read.withColumn("texts", page_texts(F.col("tokens")))
