"""Near-duplicates by SimHash: fingerprints that differ in few bits are linked.

A fingerprint has a bit for each of 64 places, set if over half of the text's shingle hashes
have it. Equal fingerprints are one node, so copies are never paired. Fingerprints are split
into ``BLOCKS`` blocks; two that differ in ``d`` bits agree in all but ``d`` blocks at least, so
a row for each choice of ``BLOCKS - d`` blocks brings all such pairs together. What shares those
blocks can differ in the rest only: at most 2 ** 16 fingerprints for d = 2, whatever the input.
There the Hamming distance is verified; in groups of over ``PAIRED`` by clearing each choice of
``d`` open bits and linking what becomes equal, which finds the same components without pairs.

Defined cases: a text without words (null, empty, blank) has fingerprint zero and is linked like
any other; null ids take part and are named by the smallest id that is not null, if any; rows
of one id each have their own fingerprint. Other columns are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteindex.llm.common import KEY, NO_ID, VERSION, id_key, id_of, keyed, whole_text, written
from siteindex.llm.components import components

SHINGLE_WORDS, MAX_BITS, BLOCKS, PAIRED = 3, 2, 8, 256
SEED = 42


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of each shingle of the text with A-Z lower-cased."""
    found = text.encode().lower().split()  # on bytes: ASCII letters and blanks only
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(sizes + 1) - 1
    begins = (ends - sizes)[: len(found) - words + 1].tolist()
    digest, seed = xxhash.xxh64_intdigest, SEED
    return np.array(
        [digest(joined[a:b], seed) for a, b in zip(begins, ends[words - 1 :].tolist(), strict=True)],
        np.uint64,
    )


def fingerprint(text: str, words: int = SHINGLE_WORDS) -> int:
    hashes = shingle_hashes(text, words)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8), bitorder="little")
        ones += bits.reshape(-1, 64).sum(axis=0, dtype=np.int64)
    packed = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(packed.view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """``_key, _version, fp`` of each row."""

    def compute(batches):
        for batch in batches:
            fps = [fingerprint(text, words) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(KEY), batch.column(VERSION), pa.array(fps, pa.int64())],
                [KEY, VERSION, "fp"],
            )

    rows = keyed(docs).select(KEY, VERSION, "text")
    return rows.mapInArrow(compute, f"{KEY} long, {VERSION} long, fp long")


def _masks(blocks: int, differ: int) -> list[tuple[int, int]]:
    """For each choice of ``differ`` open blocks: the shared bits and the open bits."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    full = (1 << 64) - 1
    masks = []
    for open_blocks in combinations(range(blocks), differ):
        bits = sum(((1 << edges[b + 1]) - 1) ^ ((1 << edges[b]) - 1) for b in open_blocks)
        masks.append((full ^ bits, bits))
    return masks


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _group_links(
    fps: np.ndarray, open_bits: int, max_bits: int, paired: int = PAIRED
) -> list[np.ndarray]:
    """Links (2 x n) of fingerprints of one block group that join all close pairs."""
    if len(fps) <= paired:
        differ = np.bitwise_count(fps[:, None] ^ fps[None, :])
        a, b = np.nonzero(np.triu(differ <= max_bits, 1))
        return [np.stack([fps[a], fps[b]])]
    places = [1 << i for i in range(64) if open_bits >> i & 1]
    links = []
    for cleared in combinations(places, max_bits):
        rest = fps & np.uint64(((1 << 64) - 1) ^ sum(cleared))
        order = np.argsort(rest, kind="stable")
        same = np.flatnonzero(rest[order][1:] == rest[order][:-1])
        links.append(np.stack([fps[order[same]], fps[order[same + 1]]]))
    return [np.unique(np.concatenate(links, axis=1), axis=1)]


def close_links(
    distinct: DataFrame, max_bits: int = MAX_BITS, blocks: int = BLOCKS, paired: int = PAIRED
) -> DataFrame:
    """Links ``a, b`` between different fingerprints of ``distinct(fp)``."""
    masks = _masks(blocks, max_bits)
    shared = F.array(*(F.col("fp").bitwiseAND(F.lit(_signed(m))) for m, _ in masks))
    rows = distinct.select("fp", F.posexplode(shared).alias("c", "s"))

    def link(batches):
        held = np.zeros((3, 0), np.int64)

        def of(groups):
            c, s, fp = groups
            starts = np.flatnonzero(np.r_[True, (c[1:] != c[:-1]) | (s[1:] != s[:-1])])
            ends = np.r_[starts[1:], len(c)]
            found = []
            for a, b in zip(starts[ends - starts > 1], ends[ends - starts > 1], strict=True):
                found += _group_links(fp[a:b].view(np.uint64), masks[c[a]][1], max_bits, paired)
            pairs = np.concatenate([np.zeros((2, 0), np.uint64), *found], axis=1).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

        for batch in batches:
            new = [batch.column(i).to_numpy().astype(np.int64) for i in range(3)]
            held = np.concatenate([held, np.stack(new)], axis=1)
            tail = (held[0] != held[0, -1]) | (held[1] != held[1, -1])
            cut = int(np.flatnonzero(tail)[-1]) + 1 if tail.any() else 0
            if cut:
                yield of(np.ascontiguousarray(held[:, :cut]))
            held = held[:, cut:]
        if held.shape[1]:
            yield of(np.ascontiguousarray(held))

    grouped = rows.repartition("c", "s").sortWithinPartitions("c", "s").select("c", "s", "fp")
    return grouped.mapInArrow(link, "a long, b long")


def _print_roots(
    prints: DataFrame, max_bits: int, blocks: int, paired: int
) -> DataFrame:
    """``fp, least, root`` of each different fingerprint: its least id and its component."""
    least = F.min(id_of()).alias("least")
    nodes = written(prints.groupBy("fp").agg(least), "nodes")
    roots = components(close_links(nodes.select("fp"), max_bits, blocks, paired))
    return nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )


def near_duplicates(
    docs: DataFrame,
    words: int = SHINGLE_WORDS,
    max_bits: int = MAX_BITS,
    blocks: int = BLOCKS,
    paired: int = PAIRED,
) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of each row."""
    prints = written(fingerprints(docs, words), "fingerprints")
    rooted = _print_roots(prints, max_bits, blocks, paired)
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_print = written(rooted.join(named, "root").select("fp", "component_id"), "print-components")
    return prints.join(of_print, "fp").select(
        id_of().alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def one_of_each(
    docs: DataFrame,
    words: int = SHINGLE_WORDS,
    max_bits: int = MAX_BITS,
    blocks: int = BLOCKS,
    paired: int = PAIRED,
) -> DataFrame:
    """One row of ``docs`` of each component: that of the least id, ids before null.

    Rows of one id in a component are told apart by the hash of their texts, and of rows that
    agree in id and text one stays. Only rows that are left out or agree with others are
    shuffled; a document without a near-duplicate is never moved with its text.
    """
    prints = written(fingerprints(docs, words), "fingerprints")
    rooted = _print_roots(prints, max_bits, blocks, paired).select("fp", "root")
    place = F.struct(F.col(KEY) == NO_ID, KEY, VERSION)
    rows = written(prints.join(rooted, "fp").select("root", KEY, VERSION), "rows-in-components")
    first = rows.groupBy("root").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    shared = written(first.where("n > 1").select("root", "first"), "shared-components")
    members = rows.join(shared, "root").groupBy(KEY, VERSION, "first").agg(
        F.count(F.lit(1)).alias("copies")
    )
    is_first = (F.col(f"first.{KEY}") == F.col(KEY)) & (F.col(f"first.{VERSION}") == F.col(VERSION))
    marks = written(
        members.select(
            F.col(KEY).alias("_k"), F.col(VERSION).alias("_v"),
            is_first.alias("_first"), "copies",
        ),
        "marked-rows",
    )
    whole = docs.select(
        F.struct(*docs.columns).alias("_row"),
        id_key().alias("_k"),
        F.xxhash64(whole_text()).alias("_v"),
    )
    out = marks.where(~F.col("_first") | (F.col("copies") > 1)).select("_k", "_v")
    doubled = marks.where("_first and copies > 1").select("_k", "_v")
    stays = whole.join(out, ["_k", "_v"], "left_anti").select("_row")
    one = whole.join(doubled, ["_k", "_v"], "left_semi").dropDuplicates(["_k", "_v"])
    return stays.union(one.select("_row")).select("_row.*")
