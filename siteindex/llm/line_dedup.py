"""Lines that many documents share are kept once.

A line's key is the line without blanks at its ends and with A-Z lower-cased. Keys become two
64-bit hashes; their rows (hash, document, position) are range-partitioned by hash and sorted
by hash, document and position, so the copies of a line stream by in order: the first document
met, the one with the largest id, keeps its lines, the others lose theirs if enough documents
hold the line. What comes back is not text but a bitmap of lines to keep for each document
that loses any: words of 64 lines, those that keep all left out.

A line may stand in a third of all documents. Such keys are found in a sample, at most
``1 / HOT_SHARE`` of them; their documents are counted apart with partial sums, and their rows
are dealt to ``SALTS`` groups. The sample only deals work out, it decides no line.

Defined cases: a null text is one empty line, as is an empty one; a null id is one document
below all others; rows of one id are one document: they count once and, if it is the largest
id of a line, all of them keep it. Equal rows lose the same lines. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteindex.llm.common import BLANKS, KEY, LOWER, UPPER, VERSION, id_of, keyed, written

MIN_CHARS, MIN_DOCS = 20, 3
#: A key with more than this share of a sample of the rows is dealt to ``SALTS`` groups.
HOT_SHARE, SAMPLE_OF, SALTS = 1 / 2000, 64, 64


def line_rows(docs: DataFrame, min_chars: int) -> DataFrame:
    """A row for each line whose key is long enough: its hashes, document and position."""
    lowered = F.translate("text", UPPER, LOWER)
    lines = keyed(docs).select(KEY, VERSION, F.posexplode(F.split(lowered, "\n", -1)))
    key = F.btrim("col", F.lit(BLANKS))
    return lines.withColumn("_line", key).where(F.char_length("_line") >= min_chars).select(
        F.xxhash64("_line").alias("h1"),
        F.xxhash64(F.lit(1), "_line").alias("h2"),
        KEY, VERSION, "pos",
    )


def _hot(rows: DataFrame) -> DataFrame:
    """Number of documents and largest id of the keys that have many rows."""
    sample = rows.where(F.pmod(F.xxhash64(KEY, "pos"), F.lit(SAMPLE_OF)) == 0)
    least = max(64, int(sample.count() * HOT_SHARE))
    keys = sample.groupBy("h1", "h2").count().where(F.col("count") > least).select("h1", "h2")
    documents = rows.join(F.broadcast(keys), ["h1", "h2"]).select("h1", "h2", KEY).distinct()
    return documents.groupBy("h1", "h2").agg(
        F.count(F.lit(1)).alias("_docs"), F.max(KEY).alias("_last")
    )


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS):
    """``_key, _version, words, n_dropped`` of each document that loses lines.

    ``words`` is sorted: ``w`` counts 64 lines each, bit ``i`` of ``keep`` is line ``64 w + i``.
    Words that are not listed keep all their lines.
    """
    rows = written(line_rows(docs, min_chars), "line-rows")
    hot = written(_hot(rows), "line-hot")
    salted = rows.join(F.broadcast(hot), ["h1", "h2"], "left").withColumn(
        "_salt",
        F.when(F.col("_docs").isNotNull(), F.pmod(F.xxhash64(KEY), F.lit(SALTS))).otherwise(0),
    )
    group = ["h1", "h2", "_salt"]
    ranged = salted.repartitionByRange(*group)
    stream = Window.partitionBy(*group).orderBy(F.desc(KEY), VERSION, "pos")
    met = F.lag(KEY).over(stream)
    copies = ranged.withColumn("_new", (met.isNull() | (met != F.col(KEY))).cast("bigint"))
    copies = copies.withColumn("_first", F.first(KEY).over(stream))
    decided = copies.withColumn("_all", F.sum("_new").over(Window.partitionBy(*group))).where(
        (F.coalesce("_docs", "_all") >= min_docs) & (F.col(KEY) != F.coalesce("_last", "_first"))
    )
    word = F.floor(F.col("pos") / 64).cast("int")
    words = (
        decided.select(KEY, VERSION, word.alias("w"), F.expr("shiftleft(1L, pos % 64)").alias("b"))
        .groupBy(KEY, VERSION, "w")
        .agg(F.bit_or("b").alias("b"))
    )
    return words.groupBy(KEY, VERSION).agg(
        F.array_sort(F.collect_list(F.struct("w", F.bitwise_not("b").alias("keep")))).alias(
            "words"
        ),
        F.sum(F.bit_count("b").cast("bigint")).alias("n_dropped"),
    )


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``doc_id, n_lines, n_dropped, text`` with the kept lines of each row."""
    joined = keyed(docs).join(bitmaps, [KEY, VERSION], "left")

    def filled(item, i):
        earlier = F.when(i == 0, F.lit(-1)).otherwise(F.get("words", i - 1)["w"])
        gap = F.array_repeat(F.lit(-1).cast("bigint"), item["w"] - earlier - 1)
        return F.concat(gap, F.array(item["keep"]))

    dense = F.flatten(F.transform("words", filled))
    lines = F.split("text", "\n", -1)

    def stays(_, i):
        bits = F.coalesce(F.get("_dense", F.floor(i / 64).cast("int")), F.lit(-1).cast("bigint"))
        at = F.pmod(i, F.lit(64)).cast("int")
        return F.call_function("shiftrightunsigned", bits, at).bitwiseAND(F.lit(1)) == 1

    return joined.withColumn("_dense", dense).select(
        id_of().alias("doc_id"),
        F.size(lines).cast("bigint").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).alias("n_dropped"),
        F.when(F.col("words").isNull(), F.col("text"))
        .otherwise(F.array_join(F.filter(lines, stays), "\n"))
        .alias("text"),
    )


def drop_shared_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS):
    return apply_bitmaps(docs, keep_bitmaps(docs, min_chars, min_docs))
