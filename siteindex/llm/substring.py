"""Long passages that stand in several places are kept where they stand first.

A window is ``window`` consecutive words. It is removed if the same words also start earlier.
Windows are too many to sort them all, so texts are parsed by recompression: in each of two
rounds equal neighbours become a run and pairs are formed at places that depend on the names of
the neighbours alone. Names are 64-bit hashes of what they stand for, so they are global without
a dictionary, and equal passages get equal symbols in their interior: whether a symbol ends
between two words follows from ``CONTEXT`` words on either side. More rounds would need more
context than a window of 20 words has.

Each window is filed under the least name among the symbol borders of its interior (the name of
the words around the border), so that equal windows share a name wherever they stand, and
consecutive windows mostly share a row: one name, a place, and the 64-bit name of each window.
Rows meet by name, in the order of documents, and stream by; windows are equal if their 64-bit
names are, as far as they are filed under one name. What is found goes back as intervals of words.

A line that many documents surround differently would bring all its windows under one name. Names
of over ``HOT`` windows, by a sample of the documents, are left out of the filing: their windows
are rows of their own, filed under the windows' names, in every task alike.

A task leaves rows out that repeat one it has sent with a smaller place: their windows are known
to be repeats. So a passage in a third of all documents sends few rows under its names.

Defined cases: null, empty and blank texts have no words; a null id counts as the smallest; rows
of one id with different texts are documents in the order of a hash of the text, and equal rows
are one document, all of which lose the same words. Other columns are not read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteindex.llm.common import KEY, VERSION, id_of, keyed

WINDOW = 20
#: Words on either side that decide whether a symbol of the second round ends at a place.
CONTEXT = 3
#: Rows that a task remembers to leave repeats out.
REMEMBERED = 400_000
#: Windows from which a name is split, and one in how many documents is looked at to find such.
HOT, SAMPLE_OF = 1_000_000, 64
_BASE = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.uint64((1 << 64) - 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    return tuple(
        np.multiply.accumulate(np.r_[np.uint64(1), np.full(size, b, np.uint64)])
        for b in (_BASE, inverse)
    )


class Sequences:
    """Names of all stretches of a length, in constant time for each."""

    def __init__(self, words: np.ndarray):
        self.n = len(words)
        up, self.down = _powers(1 << max(10, self.n.bit_length()))
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(words * up[: self.n], out=self.sums[1:])

    def names(self, length: int) -> np.ndarray:
        n = max(0, self.n - length + 1)
        part = self.sums[length : length + n] - self.sums[:n]
        return _mixed(part * self.down[:n] + np.uint64(length))


def borders(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether a symbol of the second round starts at each word; ``first``: a text starts there."""

    def at(shift: int, of: np.ndarray, fill):
        out = np.full(len(of), fill, of.dtype)
        if shift < 0:
            out[-shift:] = of[:shift]
        elif shift:
            out[:-shift] = of[shift:]
        else:
            out[:] = of
        return out

    second = (_mixed(words) >> np.uint64(63)).astype(bool)  # takes the right place of a pair
    w = {k: at(k, words, _NONE) for k in range(-3, 3)}
    r = {k: at(k, second, False) for k in range(-3, 3)}
    starts_run = first | (w[0] != w[-1])
    round_1 = first | (starts_run & ~(~r[-1] & r[0]))

    # the symbols before and after each border, by letters; runs of over two words are not seen past
    short, two = w[-2] != w[-1], w[-3] != w[-2]
    letter_before, right_before = np.where(short, w[-2], w[-3]), np.where(short, r[-2], r[-3])
    paired = r[-1] & ~right_before & (letter_before != _NONE)
    left = np.where(paired, _mixed(letter_before * np.uint64(3) + w[-1]), w[-1])
    frozen = r[-1] & ~short & ~two
    short, two = w[1] != w[0], w[2] != w[1]
    letter_after, right_after = np.where(short, w[1], w[2]), np.where(short, r[1], r[2])
    paired = ~r[0] & right_after & (letter_after != _NONE)
    right = np.where(paired, _mixed(w[0] * np.uint64(3) + letter_after), w[0])
    frozen |= ~r[0] & ~short & ~two
    takes_right = lambda names: (_mixed(names ^ _BASE) >> np.uint64(63)).astype(bool)
    joined = (left == right) | (~takes_right(left) & takes_right(right))
    return first | (round_1 & (frozen | ~joined))


def _least(values: np.ndarray, span: int) -> np.ndarray:
    """Minimum of each ``span`` neighbours, by doubling."""
    n, have = len(values) - span + 1, 1
    while 2 * have <= span:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    return np.minimum(values[:n], values[span - have : span - have + n])


def filed_windows(lengths: np.ndarray, words: np.ndarray, window: int):
    """Of texts laid end to end: where rows of windows start and end, their names, the windows'."""
    n = len(words) - window + 1
    if n <= 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    ends = np.cumsum(lengths)
    first = np.zeros(len(words), bool)
    first[(ends - lengths)[lengths > 0]] = True
    sequences = Sequences(words)
    around = np.full(len(words), _NONE, np.uint64)
    names = sequences.names(2 * CONTEXT)
    around[CONTEXT : CONTEXT + len(names)] = names
    span = window - 2 * CONTEXT + 1
    border = _least(np.where(borders(words, first), around, _NONE)[CONTEXT : len(words)], span)
    any_place = _least(around[CONTEXT : len(words)], span) if (border[:n] == _NONE).any() else border
    name = np.where(border[:n] == _NONE, any_place[:n], border[:n])
    text = np.repeat(np.arange(len(lengths)), lengths)
    inside = text[:n] == text[window - 1 :]
    change = np.flatnonzero(
        np.r_[True, (name[1:] != name[:-1]) | (text[1:n] != text[: n - 1]) | ~inside[:-1] | ~inside[1:]]
    )
    stop = np.r_[change[1:], n]
    rows = inside[change]
    return change[rows], stop[rows], name[change[rows]], sequences.names(window)


def _merged(batches, rows: int):
    """Arrow batches of so many rows at least."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if size:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _filed(texts: list[list[bytes]], window: int):
    """``filed_windows`` of texts as words, and the texts' lengths."""
    digest = xxhash.xxh64_intdigest
    lengths = np.array([len(t) for t in texts], np.int64)
    words = np.array([digest(w) for t in texts for w in t], np.uint64)
    return lengths, *filed_windows(lengths, words, window)


def hot_names(docs: DataFrame, window: int, hot: int = HOT, sample_of: int = SAMPLE_OF) -> np.ndarray:
    """The names of over ``hot`` windows, sorted; there are as many as windows by ``hot`` at most."""

    def count(batches):
        for batch in _merged(batches, 512):
            texts = [text.encode().split() for text in batch.column("text").to_pylist()]
            _, begin, end, name, _ = _filed(texts, window)
            names, at = np.unique(name, return_inverse=True)
            sizes = np.bincount(at, end - begin, len(names)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(sizes)], ["k", "n"])

    sample = keyed(docs).where(F.pmod(F.xxhash64(KEY, VERSION), F.lit(sample_of)) == 0)
    sizes = sample.select("text").mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
    found = sizes.where(F.col("n") > hot / sample_of).select("k").toArrow().column("k")
    return np.sort(found.to_numpy().view(np.uint64))


def window_rows(
    docs: DataFrame, window: int, remembered: int = REMEMBERED, hot: np.ndarray | None = None
) -> DataFrame:
    """``k, d, s, n, w``: name, document, version and word, windows and their names.

    ``w`` is null for windows known to repeat earlier ones. Windows of the names in ``hot`` are
    rows of their own under their own names.
    """
    if hot is None:
        hot = np.zeros(0, np.uint64)
    split = docs.sparkSession.sparkContext.broadcast(hot)

    def rows_of(batches):
        sent: dict[int, tuple[int, int]] = {}
        for batch in _merged(batches, 512):
            texts = [text.encode().split() for text in batch.column("text").to_pylist()]
            lengths, begin, end, name, windows = _filed(texts, window)
            if not len(begin):
                continue
            begin, end, name = _split(begin, end, name, windows)
            offsets = np.cumsum(lengths) - lengths
            text = np.searchsorted(offsets + lengths, begin, side="right")
            doc = batch.column(KEY).to_numpy()[text]
            version = batch.column("v").to_numpy()[text]
            start = (version << 32) | (begin - offsets[text])
            totals = np.r_[np.uint64(0), np.cumsum(_mixed(windows ^ _BASE))]
            content = totals[end] - totals[begin]
            repeats = np.zeros(len(begin), bool)
            pairs = zip(name.tolist(), content.tolist(), doc.tolist(), start.tolist(), strict=True)
            for i, (k, c, d, s) in enumerate(pairs):
                known = sent.get(c << 64 | k)
                if known is not None and known < (d, s):
                    repeats[i] = True
                elif known is not None or len(sent) < remembered:
                    sent[c << 64 | k] = (d, s)
            yield _rows(begin, end, name, windows, doc, start, repeats)

    def _split(begin, end, name, windows):
        apart = np.isin(name, split.value)
        if not apart.any():
            return begin, end, name
        copies = np.where(apart, end - begin, 1)
        step = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
        apart, first = np.repeat(apart, copies), np.repeat(begin, copies) + step
        last = np.where(apart, first + 1, np.repeat(end, copies))
        return first, last, np.where(apart, windows[first], np.repeat(name, copies))

    def _rows(begin, end, name, windows, doc, start, repeats):
        count = end - begin
        shown = np.where(repeats, 0, count)
        offsets = np.r_[0, np.cumsum(shown)]
        source = np.repeat(begin - offsets[:-1], shown) + np.arange(offsets[-1])
        nulls = pa.py_buffer(np.packbits(~repeats, bitorder="little").tobytes())
        data = pa.Array.from_buffers(
            pa.binary(),
            len(begin),
            [
                nulls,
                pa.py_buffer((8 * offsets).astype(np.int32).tobytes()),
                pa.py_buffer(windows[source].tobytes()),
            ],
        )
        spread = _mixed(start.astype(np.uint64) ^ _mixed(doc.astype(np.uint64)))
        key = np.where(repeats, spread, name).view(np.int64)
        columns = [pa.array(x) for x in (key, doc, start, count)]
        return pa.RecordBatch.from_arrays([*columns, data], ["k", "d", "s", "n", "w"])

    rows = keyed(docs).select(
        KEY, F.col(VERSION).bitwiseAND(F.lit(0x7FFFFFFF)).alias("v"), "text"
    )
    return rows.mapInArrow(rows_of, "k long, d long, s long, n long, w binary")


def repeated_windows(rows: DataFrame) -> DataFrame:
    """``d, s, n``: stretches of window starts whose windows also start earlier."""

    def find(batches):
        last, seen = None, np.zeros(0, np.uint64)
        for batch in _merged(batches, 20_000):
            k, d, s, n = (batch.column(i).to_numpy() for i in range(4))
            shown = batch.column("w").is_valid().to_numpy(zero_copy_only=False)
            out = [np.stack([d[~shown], s[~shown], n[~shown]])]
            k, d, s, n = k[shown], d[shown], s[shown], n[shown]
            if len(k):
                data = b"".join(batch.column("w").drop_null().to_pylist())
                names = np.frombuffer(data, np.uint64)
                group = np.cumsum(np.r_[True, k[1:] != k[:-1]]) - 1
                of_window = np.repeat(group, n)
                order = np.lexsort((names, of_window))
                x, y = order[1:], order[:-1]
                repeated = np.zeros(len(names), bool)
                repeated[x] = (names[x] == names[y]) & (of_window[x] == of_window[y])
                if k[0] == last:
                    head = of_window == 0
                    repeated[head] |= np.isin(names[head], seen)
                tail = np.unique(names[of_window == group[-1]])
                seen = np.union1d(seen, tail) if k[-1] == last else tail
                last = k[-1]
                out.append(_stretches(repeated, d, s, n))
            d, s, n = np.concatenate(out, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (d, s, n)], ["d", "s", "n"])

    def _stretches(repeated, d, s, n):
        ends = np.cumsum(n)
        row = np.repeat(np.arange(len(n)), n)
        step = np.arange(len(row)) - np.repeat(ends - n, n)
        starts = repeated & (np.r_[True, ~repeated[:-1]] | (step == 0))
        stops = repeated & (np.r_[~repeated[1:], True] | np.r_[step[1:] == 0, True])
        a, b = np.flatnonzero(starts), np.flatnonzero(stops)
        return np.stack([d[row[a]], s[row[a]] + step[a], b - a + 1])

    sorted_rows = rows.repartition("k").sortWithinPartitions("k", "d", "s")
    return sorted_rows.mapInArrow(find, "d long, s long, n long")


def drop_repeats(
    docs: DataFrame,
    window: int = WINDOW,
    remembered: int = REMEMBERED,
    hot: int = HOT,
    sample_of: int = SAMPLE_OF,
) -> DataFrame:
    """``doc_id, n_words, n_removed, text`` with the kept words of each row."""
    if window <= 2 * CONTEXT:
        raise ValueError(f"a window has over {2 * CONTEXT} words")
    split = hot_names(docs, window, hot, sample_of)
    found = repeated_windows(window_rows(docs, window, remembered, split)).select(
        F.col("d").alias(KEY),
        F.shiftright("s", 32).alias("v"),
        F.struct(F.col("s").bitwiseAND(F.lit(0xFFFFFFFF)).alias("s"), "n").alias("x"),
    )
    stretches = found.groupBy(KEY, "v").agg(F.collect_list("x").alias("x"))
    rows = keyed(docs).withColumn("v", F.col(VERSION).bitwiseAND(F.lit(0x7FFFFFFF)))
    joined = rows.join(stretches, [KEY, "v"], "left").select(KEY, "text", "x")

    def apply(batches):
        for batch in batches:
            kept, counts, removed = [], [], []
            for text, found in zip(
                batch.column("text").to_pylist(), batch.column("x").to_pylist(), strict=True
            ):
                words = text.encode().split()
                counts.append(len(words))
                if found:
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, [x["s"] for x in found], 1)
                    np.add.at(edge, [x["s"] + x["n"] + window - 1 for x in found], -1)
                    stays = np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()
                    words = [words[i] for i in stays]
                removed.append(counts[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(KEY), pa.array(counts), pa.array(removed), pa.array(kept)],
                [KEY, "n_words", "n_removed", "text"],
            )

    done = joined.mapInArrow(apply, f"{KEY} long, n_words long, n_removed long, text string")
    return done.select(id_of().alias("doc_id"), "n_words", "n_removed", "text")
