"""Word pointers over Arrow text buffers, and their sort."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of words are marked by 1: ASCII letters, and all bytes of characters beyond ASCII.
LETTER = bytes(chr(b).isalpha() or b > 127 for b in range(256))
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Bytes that are compared at once, and masks that keep the first of them.
WIDTH = 8
_KEEP = np.array([(1 << 64) - (1 << 8 * (WIDTH - n)) for n in range(WIDTH + 1)], np.uint64)
#: A slice of at most so many pointers is no longer split about a pivot.
SMALL = 1 << 15
#: Pointers whose keys are made at once.
BLOCK = 1 << 17


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text array without nulls, and the offsets of its rows."""
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32) if offsets else np.zeros(1, int)
    ends = ends[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if not len(ends):
        ends = np.zeros(1, np.int64)
    bytes_ = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return bytes_[ends[0] : ends[-1]], ends - ends[0]


def translated(data: np.ndarray, table: bytes) -> np.ndarray:
    return np.frombuffer(data.tobytes().translate(table), np.uint8)


def word_pointers(
    data: np.ndarray, ends: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and row of each word; no word spans two rows."""
    narrow = np.int32 if len(data) < 1 << 30 else np.int64
    inside = translated(data, LETTER).view(bool)
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    first, last = ends[ends < len(data)], ends[ends > 0] - 1
    opens[first], closes[last] = inside[first], inside[last]
    starts = np.flatnonzero(opens).astype(narrow)
    lengths = np.flatnonzero(closes).astype(narrow) + narrow(1) - starts
    in_row = np.diff(np.searchsorted(starts, ends.astype(narrow)))
    return starts, lengths, np.repeat(np.arange(len(in_row), dtype=narrow), in_row)


def cut(data: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Starts and ends of pieces of a text, ``size`` bytes at most unless a word is longer.

    Pieces end after a byte outside words, so that no word and no character is cut.
    """

    def marks(at: int) -> bytes:
        return data[at : at + size].tobytes().translate(LETTER)

    start = 0
    while len(data) - start > size:
        block, gap = start, marks(start).rfind(0)
        while gap < 0 and block + size < len(data):  # the word is longer
            block += size
            gap = marks(block).find(0)
        if gap < 0:
            break
        yield start, block + gap + 1
        start = block + gap + 1
    yield start, len(data)


class PointerSort:
    """Sorts words by their bytes: three-way splits about a pivot of ``WIDTH`` bytes at a depth.

    What equals the pivot goes on at the next depth, so a frequent word leaves in one split.
    Small slices are ordered at once, all their runs of equal bytes together. Equal words keep
    their order.
    """

    def __init__(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        self.data = np.r_[data, np.zeros(WIDTH, np.uint8)]
        # the number that the bytes from each place on make
        self.numbers = np.ndarray(len(data) + 1, ">u8", self.data, strides=(1,))
        self.starts, self.lengths = starts, lengths

    def keys(self, at: np.ndarray, depth: int) -> np.ndarray:
        """The bytes of words from ``depth`` on as a number; zeros follow a word's end."""
        found = np.empty(len(at), np.uint64)
        for i in range(0, len(at), BLOCK):
            some = at[i : i + BLOCK]
            rest = np.clip(self.lengths[some] - depth, 0, WIDTH)
            places = np.minimum(self.starts[some] + depth, len(self.numbers) - 1)
            found[i : i + BLOCK] = self.numbers[places] & _KEEP[rest]
        return found

    def _small(self, at: np.ndarray, keys: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(keys, kind="stable")
        at, keys = at[order], keys[order]
        new = np.r_[True, keys[1:] != keys[:-1]]
        while True:
            depth += WIDTH
            run = np.cumsum(new) - 1
            goes_on = np.zeros(run[-1] + 1, bool)
            goes_on[run[self.lengths[at] > depth]] = True
            places = np.flatnonzero(goes_on[run])
            if not len(places):
                return at, new
            some = at[places]
            keys = self.keys(some, depth)
            order = np.lexsort((keys, run[places]))
            at[places], keys = some[order], keys[order]
            differ = np.r_[True, keys[1:] != keys[:-1]]
            new[places] |= differ

    def pieces(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pointers in order, piece by piece, and whether each starts a run of equal words."""
        every = np.arange(len(self.starts), dtype=self.starts.dtype)
        stack = [(every, self.keys(every, 0), 0)] if len(every) else []
        del every
        while stack:
            at, keys, depth = stack.pop()
            if keys is None:  # one word
                new = np.zeros(len(at), bool)
                new[0] = True
                yield at, new
                continue
            if len(at) <= SMALL:
                yield self._small(at, keys, depth)
                continue
            middle = keys[:: max(1, len(keys) // 1024)]
            pivot = np.partition(middle, len(middle) // 2)[len(middle) // 2]
            less, equal = keys < pivot, keys == pivot
            more = ~(less | equal)
            if more.any():
                stack.append((at[more], keys[more], depth))
            same = at[equal]
            if int(pivot) & 255 and (self.lengths[same] > depth + WIDTH).any():
                stack.append((same, self.keys(same, depth + WIDTH), depth + WIDTH))
            else:
                stack.append((same, None, depth))
            if less.any():
                stack.append((at[less], keys[less], depth))

    def sorted(self) -> tuple[np.ndarray, np.ndarray]:
        at, new = np.empty(len(self.starts), self.starts.dtype), np.empty(len(self.starts), bool)
        done = 0
        for some, starts_run in self.pieces():
            at[done : done + len(some)], new[done : done + len(some)] = some, starts_run
            done += len(some)
        return at, new

    def texts(self, at: np.ndarray) -> pa.Array:
        """The words of these pointers."""
        sizes = self.lengths[at]
        ends = np.r_[0, np.cumsum(sizes, dtype=np.int64)]
        places = np.repeat(self.starts[at] - ends[:-1], sizes) + np.arange(ends[-1])
        return pa.LargeStringArray.from_buffers(
            len(at), pa.py_buffer(ends), pa.py_buffer(self.data[places])
        ).cast(pa.string())
