"""Token ids as files: frequency-ranked ids in one to four bytes, with separate control bytes.

Texts are encoded once, where they are scanned, and written. All ids are counted; the most
frequent id gets rank 0, so that common tokens take one byte. Documents are range-partitioned
by id and each task writes one file of blocks in ascending order. A block holds its documents'
ids and token counts, then two bits for the width of each rank, four to a control byte, then the
bytes of the ranks. A reader looks control bytes up in a table of widths and gathers all ranks
of a block at once.

File layout, little-endian: ``MAGIC``; for each block five u64 (documents, control bytes, data
bytes, null ids, 0), the null flags (u8), document ids (i64), token counts (u64), control bytes,
data bytes. Each document starts a control byte of its own; unused places of its last one are
zero. The ids by rank (u32) are the file ``ranks`` of the folder. Files are named for each
attempt, and only those of successful tasks are listed in the manifest.

Defined cases: a null text is encoded as the empty one, to the end id alone; null document ids
come first; rows of one id follow each other, repeated rows are written as often as they occur.
Other columns are not read. No table of documents gives no files and no rows.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteindex.llm.common import KEY, id_key, whole_text, written
from siteindex.session import shared_dir

END_ID = 2
MAGIC = b"RANKVB01"
BLOCK_TOKENS = 1 << 20
#: Words, and pieces of words, whose ids a worker remembers.
CACHED = 400_000

#: The steps of the word tokenizer that may be taken by hand, as its file has them.
WORD_STEPS = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [
            {"type": "NFC"},
            {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "},
            {"type": "Lowercase"},
        ],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {
                "type": "Split",
                "pattern": {
                    "Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
                },
                "behavior": "Removed",
                "invert": True,
            },
            {
                "type": "ByteLevel",
                "add_prefix_space": False,
                "trim_offsets": True,
                "use_regex": False,
            },
        ],
    },
}
#: Characters for which those steps are plain: no composition, one lower-case letter each.
LETTERS = "a-zª\xb5ºÀ-ÖØ-öø-įı-ſ"
NUMBERS = "0-9²³¹¼-¾"
PIECE = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^ \t\n\r{LETTERS}{NUMBERS}]+"
)
OTHER = re.compile("[^ \t\n\r!-~¡-įı-ſ]")


class Remembered(dict):
    """Values by key, worked out where they are missing; the first ``room`` of them stay."""

    def __init__(self, make, room: int):
        super().__init__()
        self.make, self.room = make, room

    def __missing__(self, key):
        value = self.make(key)
        if len(self) < self.room:
            self[key] = value
        return value


class TextEncoder:
    """Ids of texts, as ``Tokenizer.encode`` gives them, with the ids of words remembered.

    Spaces, tabs and line ends part pieces and compose with nothing, so that what stands
    between them is encoded on its own.
    """

    def __init__(self, path: str, cached: int = CACHED):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            steps = json.load(file)
        self.special = [x["content"] for x in steps["added_tokens"]]
        self.by_word = all(steps[k] == v for k, v in WORD_STEPS.items()) and all(
            not x[k] for x in steps["added_tokens"] for k in ("lstrip", "rstrip", "normalized")
        )
        self.bytes_of = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.width = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.words, self.pieces = Remembered(self._word, cached), Remembered(self._piece, cached)

    def whole(self, text: str) -> bytes:
        return self._packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _packed(self, ids: list[int]) -> bytes:
        return array("H" if self.width == "<u2" else "I", ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        mapped = piece if piece.isascii() else self.bytes_of(piece)[0][0]
        return self._packed([x.id for x in self.tokenizer.model.tokenize(mapped)])

    def _word(self, word: str) -> bytes:
        if OTHER.search(word) or any(x in word for x in self.special):
            return self.whole(word)
        return b"".join([self.pieces[p] for p in PIECE.findall(word.lower())])

    def __call__(self, text: str) -> bytes:
        if not self.by_word:
            return self.whole(text)
        words = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        return b"".join(map(self.words.__getitem__, words))


@lru_cache(maxsize=2)
def encoder(path: str) -> TextEncoder:
    return TextEncoder(path)


def encoded(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """``_key``, ``row`` and the ids of each row, the end id included."""

    def encode(batches):
        to_ids = encoder(tokenizer_path)
        end = np.array([END_ID], to_ids.width).tobytes()
        for batch in batches:
            ids = [to_ids(text) + end for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(KEY), batch.column("row"), pa.array(ids, pa.binary())],
                [KEY, "row", "ids"],
            )

    rows = docs.select(
        id_key().alias(KEY), F.monotonically_increasing_id().alias("row"), whole_text().alias("text")
    )
    return rows.mapInArrow(encode, f"{KEY} long, row long, ids binary")


def ids_by_rank(ids: DataFrame, width: str) -> np.ndarray:
    """The ids in use, most frequent first; ties go to the smaller id."""

    def count(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            data = b"".join(batch.column("ids").to_pylist())
            found = np.bincount(np.frombuffer(data, width))
            if len(found) > len(total):
                total = np.pad(total, (0, len(found) - len(total)))
            total[: len(found)] += found
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    counts = ids.select("ids").mapInArrow(count, "id long, n long")
    ordered = counts.groupBy("id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "id")
    return np.array([r.id for r in ordered.select("id").collect()], "<u4")


def packed(ranks: np.ndarray, lengths: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of documents of so many ranks each."""
    code = (ranks >= 1 << 8).astype(np.uint8) + (ranks >= 1 << 16) + (ranks >= 1 << 24)
    places, size = _places(lengths)
    control = np.zeros(size, np.uint8)
    control[places] = code
    control = control.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)
    data = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)
    return (
        np.bitwise_or.reduce(control, axis=1).astype(np.uint8).tobytes(),
        data[np.arange(4) <= code[:, None]].tobytes(),
    )


def _places(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """Where ranks stand if each document starts a control byte, and the number of places."""
    ends = np.cumsum(lengths)
    room = (lengths + 3) // 4 * 4
    shift = np.cumsum(room) - room - (ends - lengths)
    return np.arange(ends[-1]) + np.repeat(shift, lengths), int(room.sum())


#: The widths of the four ranks of each control byte.
WIDTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + 1


def unpacked(control: np.ndarray, data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    places, _ = _places(lengths)
    widths = WIDTHS[control].reshape(-1)[places]
    starts = np.cumsum(widths, dtype=np.int64) - widths
    ranks = data[starts].astype(np.uint32)
    for k in (1, 2, 3):
        wide = np.flatnonzero(widths > k)
        if not len(wide):
            break
        ranks[wide] |= data[starts[wide] + k].astype(np.uint32) << np.uint32(8 * k)
    return ranks


def filesystem(uri: str):
    """The store of a shared folder, from any executor, and the folder's path in it."""
    from pyarrow import fs

    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    return fs.FileSystem.from_uri(uri)


def write_tokens(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write the files; the manifest: ``part, path, ranks, docs, tokens`` in ascending order."""
    spark = docs.sparkSession
    width = encoder(tokenizer_path).width
    ids = written(encoded(docs, tokenizer_path), "token-ids")
    by_rank = ids_by_rank(ids, width)
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    store, path = filesystem(folder)
    store.create_dir(path, recursive=True)
    with store.open_output_stream(f"{path}/ranks") as out:
        out.write(by_rank.tobytes())
    rank_of = np.zeros(int(by_rank.max(initial=0)) + 1, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)

    def block(doc_ids, chunks):
        lengths = np.array([len(c) for c in chunks], np.int64) // np.dtype(width).itemsize
        control, data = packed(rank_of[np.frombuffer(b"".join(chunks), width)], lengths)
        nulls = np.array([d == -(1 << 63) for d in doc_ids], np.uint8)
        head = struct.pack("<5Q", len(chunks), len(control), len(data), int(nulls.sum()), 0)
        parts = (head, nulls, np.array(doc_ids, "<i8"), lengths.astype("<u8"))
        return b"".join([*(bytes(x) for x in parts), control, data]), int(lengths.sum())

    def write(batches):
        from pyspark import TaskContext

        store, path = filesystem(folder)
        part = TaskContext.get().partitionId()
        name = f"{path}/{part:08d}-{uuid.uuid4().hex}"
        out, docs, tokens, held, doc_ids, chunks = None, 0, 0, 0, [], []

        def flush():
            nonlocal out, docs, tokens, held, doc_ids, chunks
            if out is None:
                out = store.open_output_stream(name)
                out.write(MAGIC)
            made, n = block(doc_ids, chunks)
            out.write(made)
            docs, tokens = docs + len(chunks), tokens + n
            held, doc_ids, chunks = 0, [], []

        for batch in batches:
            for key, ids in zip(
                batch.column(KEY).to_pylist(), batch.column("ids").to_pylist(), strict=True
            ):
                doc_ids.append(key)
                chunks.append(ids)
                held += len(ids) // 2
                if held >= BLOCK_TOKENS:
                    flush()
        if chunks:
            flush()
        if out is not None:
            out.close()
            row = [[part], [name], [f"{path}/ranks"], [docs], [tokens]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in row], ["part", "path", "ranks", "docs", "tokens"]
            )

    ordered = ids.repartitionByRange(KEY, "row").sortWithinPartitions(KEY, "row")
    manifest = ordered.select(KEY, "ids").mapInArrow(
        write, "part long, path string, ranks string, docs long, tokens long"
    )
    return written(manifest.withColumn("folder", F.lit(folder)), "token-manifest")


def read_tokens(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document, with ``ids`` if wanted."""
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = manifest.withColumn("start", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)))

    def read(batches):
        for files in batches:
            for file in files.to_pylist():
                store, _ = filesystem(file["folder"])
                with store.open_input_stream(file["ranks"]) as ranks:
                    by_rank = np.frombuffer(ranks.read(), "<u4")
                with store.open_input_stream(file["path"]) as data:
                    if data.read(len(MAGIC)) != MAGIC:
                        raise ValueError(f"not a token file: {file['path']}")
                    start = file["start"]
                    while head := data.read(40):
                        rows, start = _block_rows(data, head, by_rank, start, with_ids)
                        yield rows

    shape = "doc_id long, start long, n_tokens long, ids_crc32 long"
    shape += ", ids array<int>" if with_ids else ""
    files = max(1, manifest.count())
    return starts.repartition(files).mapInArrow(read, shape)


def _block_rows(data, head: bytes, by_rank: np.ndarray, start: int, with_ids: bool):
    n, n_control, n_data, _, _ = struct.unpack("<5Q", head)
    nulls = np.frombuffer(data.read(n), np.uint8)
    doc_ids = np.frombuffer(data.read(8 * n), "<i8")
    lengths = np.frombuffer(data.read(8 * n), "<u8").astype(np.int64)
    control = np.frombuffer(data.read(n_control), np.uint8)
    ids = by_rank[unpacked(control, np.frombuffer(data.read(n_data), np.uint8), lengths)]
    ends = np.cumsum(lengths)
    begins = ends - lengths
    sums = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(begins, ends, strict=True)]
    columns = [
        pa.array(doc_ids, pa.int64(), mask=nulls.astype(bool)),
        pa.array(begins + start, pa.int64()),
        pa.array(lengths, pa.int64()),
        pa.array(sums, pa.int64()),
    ]
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    if with_ids:
        offsets = np.concatenate([[0], ends]).astype(np.int32)
        columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32))))
        names.append("ids")
    return pa.RecordBatch.from_arrays(columns, names), start + int(ends[-1])
