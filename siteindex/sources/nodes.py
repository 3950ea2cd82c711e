"""HTML text to node array: the one place where rows pass through Python.

``nodes(html)`` is an Arrow UDF on the tokenizer of the standard library. It only
reports what is there, in document order; every selection, pruning and extraction
is a Catalyst expression over the array. A node is

``id``     position in the array, from 0
``last``   position of the last node of the element's subtree
``kind``   ``el``, ``text``, ``note`` (comment, doctype, instruction) or ``close``
           (end of an element that takes a closing mark, see ``FENCED``)
``tag``    element name
``attrs``  the attributes named in ``ATTRIBUTES``
``text``   text of ``text`` and ``note`` nodes
``own``    marks of the element itself
``up``     marks of the parent element
``above``  marks of all enclosing elements

A mark is one bit per selector of ``MARKS``: a tag, a class, a tag with a class, a tag
with a non-empty attribute, a tag inside another, and ``a:top``, a link that stands in
no other link and in no heading. "Inside nav or footer" is then one AND
of two integers, so no operator has to compare pairs of nodes. Selectors that a caller brings
along have marks in further words, ``own1``, ``above1`` and so on (see ``selectors``); a parser
is made for each list of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteindex.constants import (
    BOILERPLATE_CLASSES,
    CONTENT_SELECTORS,
    NAVIGATION_TAGS,
    SCRIPT_TAGS,
)
from siteindex.sources.selectors import field, own_marks, word

HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
STRONG = ("strong", "b")
EMPHASIS = ("em", "i")
UNSEEN = ("script", "style", "template", "rt", "rp")  # their text is not part of the page's text

MARKS = (
    SCRIPT_TAGS
    + NAVIGATION_TAGS
    + tuple("." + name for name in BOILERPLATE_CLASSES)
    + STRONG
    + EMPHASIS
    + UNSEEN[2:]
    + ("pre", "code")
    + HEADINGS
    + ("a", "a[href]", "a:top", "p", "title", "meta", "ul", "ol", "ul li", "ol li")
    + CONTENT_SELECTORS
    + ("div.content", "body")
)
ATTRIBUTES = ("href", "id", "class", "name", "property", "content", "type", "data-language")
FENCED = STRONG + EMPHASIS + HEADINGS + ("pre", "code", "ul li", "ol li")

NODE = T.StructType([
    T.StructField("id", T.IntegerType()),
    T.StructField("last", T.IntegerType()),
    T.StructField("kind", T.StringType()),
    T.StructField("tag", T.StringType()),
    T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
    T.StructField("text", T.StringType()),
    T.StructField("own", T.LongType()),
    T.StructField("up", T.LongType()),
    T.StructField("above", T.LongType()),
])
NODES = T.ArrayType(NODE)


def node_type(extra: int = 0) -> T.ArrayType:
    """Type of a page's nodes whose marks have so many further words."""
    names = [field(name, n + 1) for n in range(extra) for name in ("own", "above")]
    return T.ArrayType(T.StructType([*NODE.fields, *(T.StructField(n, T.LongType()) for n in names)]))



# --- fixed values: elements without content, and those that keep their blanks ----
VOID = frozenset((
    "area", "base", "br", "col", "embed", "hr", "img", "input", "keygen", "link", "menuitem",
    "meta", "param", "source", "track", "wbr", "basefont", "bgsound", "command", "frame", "image",
    "isindex", "nextid", "spacer",
))
PRESERVING = frozenset(("pre", "textarea"))
_ASCII_BLANKS = " \n\t\f\r"
_CHUNK = 8 << 20  # characters of HTML per output batch


def bit(*selectors: str) -> int:
    """Mask of the given standard marks."""
    mask = 0
    for selector in selectors:
        mask |= 1 << MARKS.index(selector)
    return mask


class _Marks:
    """Lookup tables from names to bits."""

    def __init__(self):
        self.tags, self.classes, self.tag_classes, self.filled, self.inside = {}, {}, {}, {}, {}
        self.link, self.covered = bit("a[href]"), bit("a[href]", *HEADINGS)
        for position, selector in enumerate(MARKS):
            value = 1 << position
            if selector == "a:top":
                self.top = value
            elif " " in selector:
                outer, inner = selector.split(" ")
                self.inside.setdefault(inner, []).append((1 << MARKS.index(outer), value))
            elif "[" in selector:
                tag, attribute = selector.rstrip("]").split("[")
                self.filled.setdefault(tag, []).append((attribute, value))
            elif selector.startswith("."):
                self.classes[selector[1:]] = value
            elif "." in selector:
                self.tag_classes[tuple(selector.split("."))] = value
            else:
                self.tags[selector] = value

    def of(self, tag: str, attrs: dict, above: int) -> int:
        own = self.tags.get(tag, 0)
        names = attrs.get("class")
        if names:
            for name in names.split():
                own |= self.classes.get(name, 0) | self.tag_classes.get((tag, name), 0)
        for attribute, value in self.filled.get(tag, ()):
            if attrs.get(attribute):
                own |= value
        if own & self.link and not above & self.covered:
            own |= self.top
        for outer, value in self.inside.get(tag, ()):
            if above & outer:
                own |= value
        return own


class _Columns:
    """Nodes of many pages as flat lists, turned into one Arrow array."""

    def __init__(self, extra: int = 0):
        self.extra = [{"own": [], "above": []} for _ in range(extra)]
        self.starts, self.failed = [0], []
        self.id, self.last, self.kind, self.tag, self.text = [], [], [], [], []
        self.own, self.up, self.above = [], [], []
        self.attr_starts, self.attr_keys, self.attr_values = [0], [], []

    def add(self, position, kind, tag, text, own, up, above, attrs=()):
        self.id.append(position)
        self.last.append(position)
        self.kind.append(kind)
        self.tag.append(tag)
        self.text.append(text)
        self.own.append(word(own, 0))
        self.up.append(word(up, 0))
        self.above.append(word(above, 0))
        for number, lists in enumerate(self.extra, 1):
            lists["own"].append(word(own, number))
            lists["above"].append(word(above, number))
        for key in attrs:
            self.attr_keys.append(key)
            self.attr_values.append(attrs[key])
        self.attr_starts.append(len(self.attr_keys))

    def drop_from(self, row):
        """Forget the nodes of a page that could not be read to its end."""
        extra = [values for lists in self.extra for values in lists.values()]
        for values in (self.id, self.last, self.kind, self.tag, self.text,
                       self.own, self.up, self.above, *extra):
            del values[row:]
        del self.attr_starts[row + 1:]
        del self.attr_keys[self.attr_starts[-1]:], self.attr_values[self.attr_starts[-1]:]

    def end_page(self, failed):
        self.starts.append(len(self.id))
        self.failed.append(failed)

    def to_arrow(self) -> pa.Array:
        attrs = pa.MapArray.from_arrays(
            pa.array(self.attr_starts, pa.int32()),
            pa.array(self.attr_keys, pa.string()),
            pa.array(self.attr_values, pa.string()),
        )
        fields = {
            "id": pa.array(self.id, pa.int32()),
            "last": pa.array(self.last, pa.int32()),
            "kind": pa.array(self.kind, pa.string()),
            "tag": pa.array(self.tag, pa.string()),
            "attrs": attrs,
            "text": pa.array(self.text, pa.string()),
            "own": pa.array(self.own, pa.int64()),
            "up": pa.array(self.up, pa.int64()),
            "above": pa.array(self.above, pa.int64()),
        }
        for number, lists in enumerate(self.extra, 1):
            for name, values in lists.items():
                fields[field(name, number)] = pa.array(values, pa.int64())
        structs = pa.StructArray.from_arrays(list(fields.values()), names=list(fields))
        return pa.ListArray.from_arrays(
            pa.array(self.starts, pa.int32()), structs, mask=pa.array(self.failed, pa.bool_())
        )


class _Reader(HTMLParser):
    """Tokens of one page into ``_Columns``; knows open elements and their marks."""

    def __init__(self, marks: _Marks, only: int = 0, own: tuple[str, ...] = (), fenced: int = 0):
        super().__init__(convert_charrefs=False)
        self.marks, self.only = marks, only
        self.own = own_marks(own) if own else None
        self.fenced = bit(*FENCED) | fenced

    def read(self, html: str, out: _Columns) -> None:
        self.reset()
        self.out, self.first = out, len(out.id)
        self.open = []  # (tag, node, own, above)
        self.counts = {}
        self.pending = []
        self.keeping = 0
        try:
            self.feed(html)
            self.close()
            self._text()
            while self.open:
                self._pop()
        except (AssertionError, ValueError, RecursionError):
            out.drop_from(self.first)
            out.end_page(True)
        else:
            out.end_page(False)

    def _place(self):
        """Marks of the innermost open element and of everything around a new node."""
        if not self.open:
            return 0, 0
        _, _, own, above = self.open[-1]
        return own, own | above

    def _next(self):
        return len(self.out.id) - self.first

    def _text(self, kind="text"):
        if not self.pending:
            return
        data = "".join(self.pending)
        self.pending = []
        if not data.strip(_ASCII_BLANKS) and not self.keeping:
            data = "\n" if "\n" in data else " "
        if data and not self.only:
            up, above = self._place()
            self.out.add(self._next(), kind, None, data, 0, up, above)

    def _pop(self):
        tag, node, own, above = self.open.pop()
        self.counts[tag] -= 1
        if tag in PRESERVING:
            self.keeping -= 1
        if node is None:
            return
        if own & self.fenced and not self.only:
            up = self.open[-1][2] if self.open else 0
            self.out.add(self._next(), "close", tag, None, own, up, above)
        self.out.last[self.first + node] = self._next() - 1

    def _start(self, tag, attrs):
        self._text()
        values = {key: "" if value is None else value for key, value in attrs}
        up, above = self._place()
        own = self.marks.of(tag, values, above)
        if self.own:
            own |= self.own.of(tag, values, up, above)
        node = None
        if not self.only or own & self.only:
            node = self._next()
            kept = {key: values[key] for key in ATTRIBUTES if key in values}
            self.out.add(node, "el", tag, None, own, up, above, kept)
        self.open.append((tag, node, own, above))
        self.counts[tag] = self.counts.get(tag, 0) + 1
        if tag in PRESERVING:
            self.keeping += 1

    def _end(self, tag):
        self._text()
        if self.counts.get(tag):
            while self.open[-1][0] != tag:
                self._pop()
            self._pop()

    def handle_starttag(self, tag, attrs):
        self._start(tag, attrs)
        if tag in VOID:
            self._pop()

    def handle_startendtag(self, tag, attrs):
        self._start(tag, attrs)
        self._end(tag)

    def handle_endtag(self, tag):
        if tag not in VOID:
            self._end(tag)

    def handle_data(self, data):
        self.pending.append(data)

    def handle_entityref(self, name):
        # an unknown name stays as it is, but loses its semicolon
        self.pending.append(html5.get(name + ";") or html5.get(name) or "&" + name)

    def handle_charref(self, name):
        self.pending.append(_character(name))

    def _note(self, data, kind="note"):
        self._text()
        self.pending.append(data)
        self._text(kind)

    def handle_comment(self, data):
        self._note(data)

    def handle_decl(self, decl):
        self._note(decl[len("DOCTYPE "):])

    def handle_pi(self, data):
        self._note(data)

    def unknown_decl(self, data):
        if data.upper().startswith("CDATA["):
            self._note(data[len("CDATA["):], "text")
        else:
            self._note(data)


def _character(name: str) -> str:
    code = int(name[1:], 16) if name[:1] in "xX" else int(name)
    if code < 256:
        try:
            return bytes((code,)).decode("windows-1252")
        except UnicodeDecodeError:
            pass
    try:
        return chr(code)
    except (ValueError, OverflowError):
        return "\N{REPLACEMENT CHARACTER}"


def _read_batches(
    batches: Iterator[pa.Array], only: int, own: tuple[str, ...] = (), fenced: int = 0
) -> Iterator[pa.Array]:
    reader = _Reader(_Marks(), only, own, fenced)
    extra = own_marks(own).words if own else 0
    for batch in batches:
        out, size = _Columns(extra), 0
        for value in batch:
            html = value.as_py()
            if html is None:
                out.end_page(True)
                continue
            reader.read(html, out)
            size += len(html)
            if size >= _CHUNK:
                yield out.to_arrow()
                out, size = _Columns(extra), 0
        if out.failed or not len(batch):
            yield out.to_arrow()


@F.arrow_udf(NODES)
def _all_nodes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    yield from _read_batches(batches, 0)


@F.arrow_udf(NODES)
def _anchor_nodes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    yield from _read_batches(batches, bit("a"))


@lru_cache(maxsize=64)
def _parser(own: tuple[str, ...], fenced: int):
    """The parser that also marks what these selectors name."""

    @F.arrow_udf(node_type(own_marks(own).words))
    def marked_nodes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from _read_batches(batches, 0, own, fenced)

    return marked_nodes.asNondeterministic()


# Filters over a parsed page would be pushed below the parser and parse it again;
# what is not deterministic stays where it is, so each page is parsed once.
_all_nodes = _all_nodes.asNondeterministic()
_anchor_nodes = _anchor_nodes.asNondeterministic()


def nodes(html: Column, own: tuple[str, ...] = (), fenced: int = 0) -> Column:
    """Node array of a page; NULL for NULL or HTML the tokenizer rejects.

    ``own`` are selectors beyond ``MARKS`` that elements are marked with, ``fenced`` the marks
    whose elements also take a closing node.
    """
    return _parser(own, fenced)(html) if own else _all_nodes(html)


def anchors(html: Column) -> Column:
    """Only the ``a`` elements of a page: far less data for link-only work."""
    return _anchor_nodes(html)
