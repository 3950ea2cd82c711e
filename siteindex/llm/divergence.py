"""Source divergence audit: how far the words of a source differ from those of its language.

Each task takes its rows in slices of at most ``SLICE_BYTES``, with the rows of a (language,
source) group beside each other; a longer text is cut between words, and its pieces are added up.
The task marks the start of every word in the Arrow buffer and sorts these pointers with a
multikey quicksort (``words.PointerSort``). A run of equal words then gives the documents that
hold the word and its occurrences in each source. Spark adds the runs of all slices, keeps the
terms found in enough documents of a language, and derives the shares.

Shares are whole numbers of 10^-9, and divergences are whole numbers too, so results do not
depend on the order of sums; an overflow would raise an error. Pairs of sources are compared
without a row for each term and pair: all absent terms of a source have one share, so what
departs from ``V`` times the divergence of two absent terms is summed over the terms that occur,
from a histogram of shares where one of the two sources lacks the term, and over the sources
that share a term else. The rows of a term are one for each source at most.

Defined cases: null language, source and text are empty; every row is a document, rows of one id
too, and ids are not read. A text without words still makes its group occur; a language without
kept terms has pairs of value 0 and no term rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteindex.llm.common import written
from siteindex.llm.words import LOWER, PointerSort, buffer_of, cut, translated, word_pointers

#: Bytes of rows that are sorted together; a task needs about ten times as many, 25 times where all
#: words have one letter.
SLICE_BYTES = 4 << 20
#: Runs that go to Spark at once.
RUNS = 1 << 15
MIN_DOCS, TOP_TERMS, ONE = 3, 200, 1_000_000_000
_GROUP = ["lang", "source"]


def slice_counts(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """``lang, source, term, n, docs`` of a slice with ``lang, source, text``."""
    langs, sources = (rows.column(c).combine_chunks().dictionary_encode() for c in _GROUP)
    pairs = np.asarray(langs.indices, np.int64) * len(sources.dictionary) + sources.indices
    order = np.argsort(pairs, kind="stable")
    known, group = np.unique(pairs[order], return_inverse=True)
    texts = rows.column("text").cast(pa.large_string()).take(pa.array(order)).combine_chunks()
    data, ends = buffer_of(texts)
    starts, lengths, row = word_pointers(data, ends)
    pointers = PointerSort(translated(data, LOWER), starts, lengths)
    del texts, data
    at, new_term = pointers.sorted()
    doc = row[at]
    new_doc = new_term | np.r_[True, doc[1:] != doc[:-1]][: len(at)]
    of = group.astype(np.int32)[doc]
    new_run = new_term | np.r_[True, of[1:] != of[:-1]][: len(at)]
    first = np.flatnonzero(new_run)
    del row, doc, new_term, new_run
    counts = np.diff(np.r_[first, len(at)])
    docs = np.add.reduceat(new_doc, first, dtype=np.int64) if len(first) else first
    for i in range(0, len(first), RUNS):
        run = slice(i, i + RUNS)
        pair = known[of[first[run]]]
        yield pa.RecordBatch.from_arrays(
            [
                langs.dictionary.take(pa.array(pair // len(sources.dictionary))),
                sources.dictionary.take(pa.array(pair % len(sources.dictionary))),
                pointers.texts(at[first[run]]),
                pa.array(counts[run]),
                pa.array(docs[run]),
            ],
            ["lang", "source", "term", "n", "docs"],
        )


def text_counts(row: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The same of one row whose text is cut into pieces; it holds a term of several pieces once."""
    data, _ = buffer_of(row.column("text"))
    found = []
    for start, end in cut(data, SLICE_BYTES):
        text = pa.array([data[start:end].tobytes()], pa.large_binary()).cast(pa.large_string())
        piece = pa.table([*(row.column(c) for c in _GROUP), text], [*_GROUP, "text"])
        found += [pa.Table.from_batches([runs]) for runs in slice_counts(piece)]
        if found:
            of_term = pa.concat_tables(found).group_by([*_GROUP, "term"], use_threads=False)
            added = of_term.aggregate([("n", "sum"), ("docs", "max")])
            added = added.select([*_GROUP, "term", "n_sum", "docs_max"])
            found = [added.rename_columns([*_GROUP, "term", "n", "docs"])]
    for runs in found:
        yield from runs.to_batches(RUNS)


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, halved until they fit in a slice."""
    if batch.nbytes <= SLICE_BYTES or batch.num_rows < 2:
        yield batch
        return
    half = batch.num_rows // 2
    yield from _parts(batch.slice(0, half))
    yield from _parts(batch.slice(half))


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for part in (p for b in batches for p in _parts(b)):
        if part.nbytes > SLICE_BYTES:
            yield from text_counts(part)
            continue
        if size + part.nbytes > SLICE_BYTES:
            yield from slice_counts(pa.Table.from_batches(held))
            held, size = [], 0
        held.append(part)
        size += part.nbytes
    if held:
        yield from slice_counts(pa.Table.from_batches(held))


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences and documents of each term of each group."""
    named = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in [*_GROUP, "text"]))
    runs = named.mapInArrow(_runs, "lang string, source string, term string, n long, docs long")
    return runs.groupBy(*_GROUP, "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: str, total: str, terms: str) -> Column:
    """``1 + floor(10^9 (n + 1) / (total + terms))``; decimals keep the product exact."""
    return F.expr(
        f"1 + (cast({ONE} as decimal(10, 0)) * cast({n} + 1 as decimal(20, 0)))"
        f" div cast(nullif({total} + {terms}, 0) as decimal(20, 0))"
    )


def divergence(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q}) div {q})"


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank`` of every group that occurs.

    Part ``pair`` has the other sources of the language, by divergence from each over all kept
    terms; part ``term`` the ``top`` terms that the group has more of than its language.
    """
    of_term = Window.partitionBy("lang", "term")
    kept = written(
        term_counts(docs)
        .withColumn("held", F.sum("docs").over(of_term))
        .where(F.col("held") >= min_docs)
        .withColumn("in_lang", F.sum("n").over(of_term))
        .withColumn("once", F.row_number().over(of_term.orderBy("source")) == 1)
        .drop("docs", "held"),
        "kept-terms",
    )
    langs = kept.groupBy("lang").agg(
        F.sum("n").alias("lang_total"), F.count_if("once").alias("terms")
    )
    totals = kept.groupBy(*_GROUP).agg(F.sum("n").alias("total"))
    present = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in _GROUP)).distinct()
    groups = written(
        present.join(langs, "lang", "left")
        .join(totals, _GROUP, "left")
        .fillna(0, ["lang_total", "terms", "total"])
        .withColumn("absent", share("0", "total", "terms")),
        "groups",
    )
    shares = written(
        kept.join(groups, _GROUP)
        .withColumn("p", share("n", "total", "terms"))
        .withColumn("q", share("in_lang", "lang_total", "terms"))
        .select(*_GROUP, "term", "p", "q", "absent"),
        "shares",
    )
    return _terms(shares, top).unionByName(_pairs(shares, groups))


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy(*_GROUP).orderBy(F.desc("value"), "item")
    return rows.select(
        *_GROUP, F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank")
    )


def _terms(shares: DataFrame, top: int) -> DataFrame:
    more = shares.where("p > q").selectExpr(
        *_GROUP, "term as item", f"{divergence('p', 'q')} as value"
    )
    return _ranked(more, "term").where(F.col("rank") <= top)


def _pairs(shares: DataFrame, groups: DataFrame) -> DataFrame:
    g = groups.selectExpr("lang", "source", "absent as p0", "terms")
    h = groups.selectExpr("lang", "source as item", "absent as q0")
    others = g.join(h, "lang").where("source <> item")
    neither = divergence("p0", "q0")
    same = shares.groupBy(*_GROUP, "p").agg(F.count(F.lit(1)).alias("m"))
    here = same.join(others, _GROUP).selectExpr(
        *_GROUP, "item", f"m * ({divergence('p', 'q0')} - {neither}) as value"
    )
    there = (
        same.selectExpr("lang", "source as item", "p as q", "m")
        .join(others, ["lang", "item"])
        .selectExpr(*_GROUP, "item", f"m * ({divergence('p0', 'q')} - {neither}) as value")
    )
    sources = F.collect_list(F.struct("source", "p", "absent")).alias("of")
    both = (
        shares.groupBy("lang", "term")
        .agg(sources)
        .where(F.size("of") > 1)
        .select("lang", "of", F.explode("of").alias("g"))
        .select("lang", "g", F.explode("of").alias("h"))
        .where("g.source <> h.source")
        .selectExpr(
            "lang", "g.source as source", "h.source as item",
            "g.p as p", "g.absent as p0", "h.p as q", "h.absent as q0",
        )
        .selectExpr(
            *_GROUP, "item",
            f"{divergence('p', 'q')} - {divergence('p', 'q0')}"
            f" - {divergence('p0', 'q')} + {neither} as value",
        )
    )
    pair = [*_GROUP, "item"]
    # each part is summed by itself, so that its rows combine before they are shuffled
    parts = [part.groupBy(*pair).agg(F.sum("value").alias("value")) for part in (here, there, both)]
    departs = parts[0].unionByName(parts[1]).unionByName(parts[2])
    summed = departs.groupBy(*pair).agg(F.sum("value").alias("departs"))
    value = f"coalesce(terms * {neither} + coalesce(departs, 0), 0)"
    rows = others.join(summed, pair, "left").selectExpr(*pair, f"{value} as value")
    return _ranked(rows, "pair")
