"""Logged conversations as chat text, snapshots of longer ones left out.

Systems often log a conversation again at each turn. Each turn has a hash of its place, role and
text; the exclusive or of the hashes up to a turn, 128 bits, names that prefix. A conversation
whose whole is a proper prefix of another is left out by an anti join on length and name, and of
equal conversations the one with the smallest id stays. What remains is rendered.

A conversation may be very long: places and prefix names are worked out in blocks of
``BLOCK_TURNS`` turns from those of earlier blocks, and the text comes in numbered parts of as
many turns, so no cell or task holds it whole. Only hashes are compared; texts move once.

Defined cases: a row logged twice (id, turn, role and text equal) counts once; rows of one turn
that differ follow each other in the order of their hashes; null ids are one conversation, null
turns come first, a null role is rendered as ``unknown`` and a null text as none, and both differ
from empty ones. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteindex.llm.common import KEY, NO_ID, id_key, id_of, ranked, written

BLOCK_TURNS = 1024
#: What stands around a turn.
TURN_START, ROLE_END, TURN_END = "<|", "|>\n", "<|end|>\n"

_TURN = [KEY, "turn", "h1", "h2"]


def _turns(conversations: DataFrame) -> DataFrame:
    role, text = F.col("role").cast("string"), F.col("text")
    return conversations.select(
        id_key("conv_id").alias(KEY),
        F.coalesce(F.col("turn").cast("bigint"), F.lit(NO_ID)).alias("turn"),
        F.xxhash64(role, text).alias("h1"),
        F.xxhash64(F.lit(1), text, role).alias("h2"),
        role.alias("role"),
        text.alias("text"),
    )


def _named_prefixes(turns: DataFrame) -> DataFrame:
    """Each turn once: its place, and the name of the prefix that ends there."""
    block = F.floor(F.col("turn") / BLOCK_TURNS)
    once = written(turns.select(*_TURN).distinct().withColumn("block", block), "chat-turns")
    placed = ranked(once, [KEY], "block", ["turn", "h1", "h2"], "place")
    hashed = written(
        placed.withColumn("e1", F.xxhash64("place", "h1", "h2")).withColumn(
            "e2", F.xxhash64(F.lit(1), "place", "h2", "h1")
        ),
        "chat-places",
    )
    both = lambda of: [F.bit_xor(e).alias(f"_{e}") for e in of]
    blocks = hashed.groupBy(KEY, "block").agg(*both(["e1", "e2"]))
    before = Window.partitionBy(KEY).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    earlier = blocks.select(
        KEY,
        "block",
        *(F.coalesce(F.bit_xor(f"_{e}").over(before), F.lit(0)).alias(f"_{e}") for e in ("e1", "e2")),
    )
    within = (
        Window.partitionBy(KEY, "block")
        .orderBy("place")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    rolled = hashed.withColumns(
        {f"r{e}": F.bit_xor(e).over(within) for e in ("e1", "e2")}
    ).join(earlier, [KEY, "block"])
    return rolled.select(
        *_TURN, "place",
        F.col("re1").bitwiseXOR(F.col("_e1")).alias("p1"),
        F.col("re2").bitwiseXOR(F.col("_e2")).alias("p2"),
    )


def maximal(prefixes: DataFrame) -> DataFrame:
    """``_key, n_turns, n_equal`` of the conversations that no other one continues."""
    lengths = prefixes.groupBy(KEY).agg(F.max("place").alias("last"))
    ended = prefixes.join(lengths, KEY)
    name = ["place", "p1", "p2"]
    wholes = ended.where(F.col("place") == F.col("last")).groupBy(*name)
    wholes = wholes.agg(F.min(KEY).alias(KEY), F.count(F.lit(1)).alias("n_equal"))
    continued = ended.where(F.col("place") < F.col("last")).select(*name).distinct()
    kept = wholes.join(continued, name, "left_anti")
    return kept.select(KEY, (F.col("place") + 1).alias("n_turns"), "n_equal")


def chat_texts(conversations: DataFrame, part_turns: int = BLOCK_TURNS) -> DataFrame:
    """``conv_id, n_turns, n_equal, part, text`` of the maximal conversations."""
    turns = _turns(conversations)
    prefixes = written(_named_prefixes(turns), "chat-prefixes")
    kept = written(maximal(prefixes), "chat-kept")
    places = prefixes.join(kept, KEY).select(*_TURN, "place", "n_turns", "n_equal")
    said = turns.groupBy(*_TURN).agg(F.any_value("role").alias("role"), F.any_value("text").alias("text"))
    piece = F.concat(
        F.lit(TURN_START), F.coalesce("role", F.lit("unknown")), F.lit(ROLE_END),
        F.coalesce("text", F.lit("")), F.lit(TURN_END),
    )
    part = F.floor(F.col("place") / part_turns)
    pieces = said.join(places, _TURN).select(
        KEY, "n_turns", "n_equal", part.alias("part"), "place", piece.alias("piece")
    )
    texts = pieces.groupBy(KEY, "n_turns", "n_equal", "part").agg(
        F.array_sort(F.collect_list(F.struct("place", "piece"))).alias("pieces")
    )
    joined = F.array_join(F.transform("pieces", lambda x: x["piece"]), "")
    return texts.select(id_of().alias("conv_id"), "n_turns", "n_equal", "part", joined.alias("text"))
