"""Entries of XML sitemaps, read as a stream of events.

``entries(body)`` is an Arrow UDF on the event parser of the standard library. An entry is a
``loc`` directly inside a ``url`` (in an index: a ``sitemap``), both in the sitemap namespace by
whatever prefix, at any depth below the root. Nothing of the tree is kept but the names of the
open elements and the addresses. XML that is not well-formed to its end names nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteindex.constants import SITEMAP_NAMESPACE

ENTRIES = T.StructType([
    T.StructField("is_index", T.BooleanType()),
    T.StructField("locations", T.ArrayType(T.StringType())),
])
_TYPE = pa.struct([("is_index", pa.bool_()), ("locations", pa.list_(pa.string()))])
_END = "}"  # between namespace and name
_LOCATION = SITEMAP_NAMESPACE + _END + "loc"


class _Events:
    """Handlers of one document."""

    def __init__(self):
        self.open: list[tuple[str, int]] = []  # names and, of entries, their numbers
        self.is_index, self.entry = False, ""
        self.numbers, self.found = 0, []
        self.text: list[str] | None = None

    def start(self, name, _):
        self.text = None  # what follows a child is not the text of a location
        if not self.open:
            self.is_index = "sitemapindex" in name
            self.entry = SITEMAP_NAMESPACE + _END + ("sitemap" if self.is_index else "url")
            self.open.append((name, 0))
            return
        parent, number = self.open[-1]
        if name == _LOCATION and number and parent == self.entry:
            self.text = []
            self.found.append((number, len(self.found), self.text))
        if name == self.entry:
            self.numbers += 1
        self.open.append((name, self.numbers if name == self.entry else 0))

    def end(self, _):
        self.open.pop()
        self.text = None

    def data(self, text):
        if self.text is not None:
            self.text.append(text)

    def locations(self) -> list[str]:
        """Filled locations by entry, outer entries before those inside them."""
        texts = ("".join(parts) for *_, parts in sorted(self.found, key=lambda f: f[:2]))
        return [text for text in texts if text]


def read_entries(body: str) -> tuple[bool, list[str]] | None:
    """Whether a document is an index, and its locations; None if it cannot be read."""
    events = _Events()
    parser = expat.ParserCreate(namespace_separator=_END)
    parser.StartElementHandler, parser.EndElementHandler = events.start, events.end
    parser.CharacterDataHandler = events.data
    try:
        parser.Parse(body, True)
    except (expat.ExpatError, UnicodeEncodeError):
        return None
    return events.is_index, events.locations()


@F.arrow_udf(ENTRIES)
def _entries(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        out = []
        for body in batch.to_pylist():
            read = None if body is None else read_entries(body)
            out.append(read and {"is_index": read[0], "locations": read[1]})
        yield pa.array(out, _TYPE)


# filters over what was read would be pushed below the parser and read it again
_entries = _entries.asNondeterministic()


def entries(body: Column) -> Column:
    """``is_index`` and ``locations`` of an XML body; NULL if it is NULL or cannot be read."""
    return _entries(body)
