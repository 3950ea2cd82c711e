"""Benchmark items in documents, with edits: pigeonhole pieces and bit-parallel verification.

Texts are compared in lower case with everything but letters and digits taken as one blank.
An item of ``m`` characters may differ by ``k = m * ERROR_RATE`` edits. Cut into ``k + 1``
pieces, an occurrence with at most ``k`` edits holds one of them unchanged. An automaton of all
pieces runs over each whole document; around each hit the smallest edit distance of the item to
any stretch of the window is worked out with bit vectors (one step for each character).
Items of fewer than ``MIN_CHARS`` compared characters would be found anywhere with an edit or
inside other words: they are looked for whole, without edits and as whole words.

The items are the query set: they are sent to the workers in blocks of ``BLOCK_CHARS`` characters,
each block with a scan of its own, so what is sent is bounded whatever the benchmark's size. The
driver holds one block at a time.

Defined cases: null and empty documents hold nothing; items without letters or digits are found
nowhere; equal items are matched once and reported each; a null item id is reported as null; rows of one document id are matched each, and
a pair's best match is kept.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteindex.llm.common import KEY, id_key, id_of, whole_text

ERROR_RATE, MIN_CHARS, BLOCK_CHARS = 0.07, 24, 8_000_000
_GAPS = re.compile(r"[\W_]+")


def compared(text: str) -> str:
    return _GAPS.sub(" ", text.lower()).strip()


def distance(pattern_bits: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Smallest edit distance of a pattern to any stretch of a text, and where that ends.

    Bit ``i`` of the vectors says how the distance changes from row ``i`` to ``i + 1`` of the
    column; Python's integers are as wide as the pattern.
    """
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, end = m, 0
    known = pattern_bits.get
    for at, char in enumerate(text, 1):
        equal = known(char, 0)
        across = (((equal & up) + up) ^ up) | equal
        equal |= down
        rise, fall = down | ~(across | up) & full, up & across
        if rise & top:
            score += 1
        elif fall & top:
            score -= 1
            if score < best:
                best, end = score, at
        rise, fall = rise << 1, fall << 1  # a match may start anywhere: nothing enters at the top
        up = (fall | ~(equal | rise)) & full
        down = rise & equal
    return best, end


class Items:
    """Benchmark items, ready to be looked for; those below ``min_chars`` as whole words."""

    def __init__(self, texts: Sequence[str], error_rate: float, min_chars: int = MIN_CHARS):
        import ahocorasick

        self.texts = texts
        self.budget = [int(len(t) * error_rate) if len(t) >= min_chars else 0 for t in texts]
        self.bits: list[dict[str, int]] = []
        pieces: dict[str, list[tuple[int, int]]] = defaultdict(list)
        # documents are run through with a blank at both ends, so that a short item with its two
        # blanks is a word or several; the offset is that of the item's start in the piece
        for item, text in enumerate(texts):
            bits: dict[str, int] = defaultdict(int)
            for i, char in enumerate(text):
                bits[char] |= 1 << i
            self.bits.append(dict(bits))
            if len(text) < min_chars:
                pieces[f" {text} "].append((item, 0))
                continue
            edges = np.linspace(0, len(text), self.budget[item] + 2).astype(int).tolist()
            for a, b in zip(edges, edges[1:], strict=False):
                pieces[text[a:b]].append((item, a + 1))
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, (len(piece), places))
        if pieces:
            self.automaton.make_automaton()
        self.empty = not pieces

    def windows(self, text: str) -> Iterator[tuple[int, int, int]]:
        """Item, start and end of the stretches that may hold it, those that meet as one."""
        if self.empty:
            return
        starts: dict[int, set[int]] = defaultdict(set)
        for end, (size, places) in self.automaton.iter(f" {text} "):
            for item, offset in places:
                starts[item].add(end + 1 - size - offset)
        for item, found in starts.items():
            k, m = self.budget[item], len(self.texts[item])
            begin = stop = None
            for start in sorted(found):
                a, b = max(0, start - k), start + m + k
                if begin is not None and a <= stop:
                    stop = max(stop, b)
                    continue
                if begin is not None:
                    yield item, begin, stop
                begin, stop = a, b
            yield item, begin, stop

    def matches(self, text: str) -> Iterator[tuple[int, int, int]]:
        """Item, distance and end of the best match of each window within the item's budget."""
        plain = compared(text)
        for item, begin, stop in self.windows(plain):
            best, end = distance(self.bits[item], len(self.texts[item]), plain[begin:stop])
            if best <= self.budget[item]:
                yield item, best, begin + end


def _blocks(items: DataFrame) -> Iterator[tuple[list[str], list[list[int | None]]]]:
    """Compared texts and the ids of the items that have them, in blocks of bounded size."""
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // BLOCK_CHARS))
    for i in range(n):
        part = items.where(F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(n)) == i)
        ids: dict[str, list[int | None]] = defaultdict(list)
        for row in part.select("item_id", "text").collect():
            text = compared(row.text or "")
            if text:
                ids[text].append(row.item_id)
        yield list(ids), list(ids.values())


def contamination(
    docs: DataFrame, items: DataFrame, error_rate: float = ERROR_RATE, min_chars: int = MIN_CHARS
) -> DataFrame:
    """``doc_id, item_id, distance, budget, end``: the best match of each document and item.

    ``end`` is where it ends in the document as it is compared.
    """
    rows = docs.select(id_key().alias(KEY), whole_text().alias("text"))
    found = None
    for texts, ids in _blocks(items):
        sent = docs.sparkSession.sparkContext.broadcast((texts, ids))

        def search(batches, sent=sent):
            texts, ids = sent.value
            ready = Items(texts, error_rate, min_chars)
            for batch in batches:
                out = [
                    (key, item_id, best, ready.budget[item], end)
                    for key, text in zip(
                        batch.column(KEY).to_pylist(), batch.column("text").to_pylist(), strict=True
                    )
                    for item, best, end in ready.matches(text)
                    for item_id in ids[item]
                ]
                columns = list(zip(*out, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in columns],
                    [KEY, "item_id", "distance", "budget", "end"],
                )

        shape = f"{KEY} long, item_id long, distance long, budget long, end long"
        part = rows.mapInArrow(search, shape)
        found = part if found is None else found.union(part)
    best = found.groupBy(KEY, "item_id").agg(
        F.min(F.struct("distance", "end", "budget")).alias("best")
    )
    return best.select(
        id_of().alias("doc_id"), "item_id", "best.distance", "best.budget", "best.end"
    )


def is_contaminated(
    docs: DataFrame, items: DataFrame, error_rate: float = ERROR_RATE, min_chars: int = MIN_CHARS
) -> Column:
    """Whether a text of ``docs`` holds any item."""

    def search(sent):
        @F.pandas_udf("boolean")
        def holds(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            ready = Items(sent.value, error_rate, min_chars)
            for batch in batches:
                yield pd.Series([any(True for _ in ready.matches(t or "")) for t in batch], dtype=bool)

        return holds(F.col("text"))

    result = F.lit(False)
    for texts, _ in _blocks(items):
        result = result | search(docs.sparkSession.sparkContext.broadcast(texts))
    return result
