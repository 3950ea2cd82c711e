"""Shards that each hold the mixture of sources: proportional stratified interleaving.

Rows are shuffled by a seeded hash within their source and ranked there. The rank over the
size of the source is a fraction; in order of these fractions every stretch of rows has each
source in proportion, so equal cuts of that order are shards of the whole's mixture. Row
counts of shards are at most one apart (law ``rows``).

A source may hold most rows: ranks are worked out by blocks of the hash and counts of the
blocks before, and the global order by blocks of the fraction, so no task sorts a source.
Only ids, hashes and counts are moved; the texts join their places once, at the end.

Defined cases: a null source is a source of its own; a null text counts one byte and has the
crc32 of no bytes; null ids shuffle as one id; repeated rows each get a place of their own; an
empty table gives no rows. Columns of the input named as results are replaced by these.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteindex.llm.common import id_key, ranked, whole_text, written

SEED = 20_11
#: Rows that one task sorts at most, about.
BLOCK_ROWS = 10_000


def assign_shards(docs: DataFrame, shards: int = 16, seed: int = SEED) -> DataFrame:
    """``doc_id, source, size, text_crc32, shard, slot`` for each row."""
    rows = written(
        docs.select(
            F.col("doc_id").cast("bigint").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            (F.octet_length(whole_text()) + F.lit(1).cast("bigint")).alias("size"),
            F.crc32(whole_text()).alias("text_crc32"),
            F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias(
                "_stratum"
            ),
            F.xxhash64(F.lit(seed), id_key()).alias("_hash"),
        ),
        "shard-rows",
    )
    total = rows.count()
    blocks = max(1, -(-total // BLOCK_ROWS))
    dealt = rows.withColumn("_block", F.pmod(F.shiftrightunsigned("_hash", 1), F.lit(blocks)))
    order = ["_hash", "doc_id", "text_crc32", "size"]
    within = ranked(dealt, ["_stratum"], "_block", order, "_rank")
    sizes = rows.groupBy("_stratum").agg(F.count(F.lit(1)).alias("_rows"))
    fraction = (F.col("_rank") + 0.5) / F.col("_rows")
    placed = written(
        within.join(sizes, "_stratum")
        .withColumn("_fraction", fraction)
        .withColumn("_part", F.floor(F.col("_fraction") * blocks))
        .drop("_block", "_hash", "_rows"),
        "shard-ranks",
    )
    at = ranked(placed, [], "_part", ["_fraction", "_stratum", "_rank"], "_at")
    shard = F.expr(f"_at * {shards}L div {max(total, 1)}L")
    first = F.expr(f"(shard * {total}L + {shards - 1}L) div {shards}L")
    return (
        at.withColumn("shard", shard)
        .withColumn("slot", F.col("_at") - first)
        .select(
            "doc_id", "source", "size", "text_crc32",
            F.col("shard").cast("int").alias("shard"), "slot",
        )
    )


def sharded_documents(docs: DataFrame, shards: int = 16, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` with ``shard`` and ``slot``; texts are moved once.

    Rows that agree in id, source, size and crc32 are told apart by number; they may stand for
    each other.
    """
    stratum = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    places = assign_shards(docs, shards, seed).select(
        id_key().alias("_key"), stratum.alias("_stratum"), "size", "text_crc32", "shard", "slot"
    )
    rows = docs.select(
        F.struct(*docs.columns).alias("_row"),
        id_key().alias("_key"),
        stratum.alias("_stratum"),
        (F.octet_length(whole_text()) + F.lit(1).cast("bigint")).alias("size"),
        F.crc32(whole_text()).alias("text_crc32"),
    )
    same = ["_key", "_stratum", "size", "text_crc32"]
    number = F.row_number().over(Window.partitionBy(*same).orderBy("size"))
    kept = [F.col("_row")[c].alias(c) for c in docs.columns if c not in ("shard", "slot")]
    joined = rows.withColumn("_n", number).join(places.withColumn("_n", number), [*same, "_n"])
    return joined.select(*kept, "shard", "slot")
