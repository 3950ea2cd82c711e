"""Trie of conversations by shared turn prefixes, with totals rolled up over subtrees.

Every conversation is rebuilt from the first turns of its base conversation and its own later
ones. The exclusive or of the hashes of place and turn, 128 bits, names each prefix; equal names
are one node, known from then on by its smallest member and its depth.

Totals over subtrees come from a centroid decomposition of the parent edges. For every node the
rows below it, ``weight``, are known from grouping alone: the members below, each as often as it
has nodes there. In a component the nodes with more than half of the top's weight form the path
from the top to the centroid. A round takes each large component, cuts the centroid off the path
and its children off it, sums each new component, adds the centroid's total to every node of the
path and takes its weight off them. All parts have half of the weight at most, so the rounds grow
with the logarithm of the rows and not with the depth of the trie, however long a conversation
or however many copies of it there are. Components of at most ``LOCAL_NODES`` nodes are finished
by the same rounds in numpy, many in a task.

Turns are ordered by range partitions, places and names are worked out for blocks of turns, and
the ids of equal conversations are hashed from blocks sorted over all tasks: SHA-256 takes the
blocks of one node one after another, all else of a long conversation or a large group of copies
is spread. A join on a very common prefix has one row on its other side; skew handling of the
adaptive planner splits it.

Defined cases: rows without ``conv_id`` belong to no conversation and are left out; null turns
come first; null role or text is empty; rows of one turn follow each other by the md5 of role and
text, repeated rows are turns of their own. An empty table has no nodes. Other columns are not
read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteindex.llm.common import NO_ID, discard, written

#: Base conversations are those whose id is divisible by this; at most ``HEADS - 1`` turns go over.
GROUP, HEADS = 100, 6
#: Turns of a conversation that a task places together.
BLOCK_TURNS = 4096
#: Nodes of a component that one task finishes.
LOCAL_NODES = 1 << 15
#: Ids of a node's conversations that are joined to one text before hashing.
BLOCK_IDS = 4096
_NODE = ["conv", "depth"]


def base_of(conv: str = "conv") -> Column:
    return F.expr(f"{conv} - {conv} % {GROUP}")


def taken_over(conv: str = "conv") -> Column:
    """How many first turns of the base a conversation starts with, if the base has them."""
    return (F.crc32(F.col(conv).cast("string")) % HEADS).cast("bigint")


def _turns(conversations: DataFrame) -> DataFrame:
    """Turns in order: conversation, range partition, place there, hashes and text length."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv"),
        F.coalesce(F.col("turn").cast("bigint"), F.lit(NO_ID)).alias("turn"),
        F.col("turn").isNotNull().alias("numbered"),
        F.substring(F.md5(F.concat_ws("\n", role, text)), 1, 16).alias("tie"),
        F.xxhash64(role, text).alias("t1"),
        F.xxhash64(F.lit(1), text, role).alias("t2"),
        F.length(text).cast("bigint").alias("chars"),
        F.monotonically_increasing_id().alias("row"),
    )
    order = ["conv", "numbered", "turn", "tie", "row"]
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(
        sorted_rows.withColumn("block", F.spark_partition_id()).drop("row"), "trie-turns"
    )


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``conv, turns, depth, t1, t2, chars`` of every rebuilt turn, and ``conv, turns`` of all."""
    turns = _turns(conversations)
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = written(
        turns.groupBy("conv", "block")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))),
        "trie-blocks",
    )
    inner = Window.partitionBy("conv", "block").orderBy("numbered", "turn", "tie")
    first = turns.join(blocks.where(f"before < {HEADS}"), ["conv", "block"]).where(
        f"conv % {GROUP} = 0"
    )
    heads = (
        first.withColumn("idx", F.col("before") + F.row_number().over(inner))
        .where(F.col("idx") < HEADS)
        .groupBy(F.col("conv").alias("base"))
        .agg(F.array_sort(F.collect_list(F.struct("idx", "t1", "t2", "chars"))).alias("head"))
    )
    own = blocks.groupBy("conv").agg(F.sum("n").alias("own"))
    head = F.slice("head", F.lit(1), F.col("skip").cast("int"))
    convs = written(
        own.withColumn("base", base_of())
        .withColumn("skip", taken_over())
        .join(heads, "base", "left")
        .select("conv", "own", "skip", head.alias("head"))
        .withColumn("given", F.coalesce(F.size("head"), F.lit(0)).cast("bigint"))
        .withColumn("turns", F.col("given") + F.greatest(F.lit(0), F.col("own") - F.col("skip"))),
        "trie-conversations",
    )
    # one row for each block of a conversation, so that a long one is not one join key
    later = turns.join(
        blocks.join(convs.select("conv", "skip", "given", "turns"), "conv"), ["conv", "block"]
    )
    own_rows = (
        later.withColumn("idx", F.col("before") + F.row_number().over(inner))
        .where(F.col("idx") > F.col("skip"))
        .withColumn("depth", F.col("idx") - F.col("skip") + F.col("given"))
        .select("conv", "turns", "depth", "t1", "t2", "chars")
    )
    given = convs.select("conv", "turns", F.explode("head").alias("of")).select(
        "conv", "turns", F.col("of.idx").alias("depth"), "of.t1", "of.t2", "of.chars"
    )
    return own_rows.unionByName(given), convs.select("conv", "turns")


def prefixes(rows: DataFrame) -> DataFrame:
    """The rows with ``p1, p2, q1, q2``: names of the prefix up to a turn and before it."""
    placed = written(
        rows.select(
            "conv",
            "turns",
            "depth",
            F.xxhash64("depth", "t1", "t2").alias("e1"),
            F.xxhash64("depth", F.lit(1), "t2", "t1").alias("e2"),
            "chars",
            F.floor(F.col("depth") / BLOCK_TURNS).alias("block"),
        ),
        "trie-rows",
    )
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    earlier = (
        placed.groupBy("conv", "block")
        .agg(F.bit_xor("e1").alias("x1"), F.bit_xor("e2").alias("x2"))
        .select(
            "conv",
            "block",
            *(F.coalesce(F.bit_xor(f"x{i}").over(before), F.lit(0)).alias(f"b{i}") for i in (1, 2)),
        )
    )
    inner = Window.partitionBy("conv", "block").orderBy("depth").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    named = placed.join(earlier, ["conv", "block"])
    for i in (1, 2):
        named = named.withColumn(f"p{i}", F.expr(f"b{i}").bitwiseXOR(F.bit_xor(f"e{i}").over(inner)))
    return written(
        named.select(
            "conv", "turns", "depth", "p1", "p2",
            F.col("p1").bitwiseXOR(F.col("e1")).alias("q1"),
            F.col("p2").bitwiseXOR(F.col("e2")).alias("q2"),
            "chars",
        ),
        "trie-prefixes",
    )


def nodes_of(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """Every node: ``conv, depth, parent, n_convs, weight, chars`` and its name ``p1, p2``."""
    below = F.sum(F.col("turns") - F.col("depth") + 1).alias("weight")
    grouped = rows.groupBy("depth", "p1", "p2").agg(
        F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"), below,
        F.min("chars").alias("chars"), F.min("q1").alias("q1"), F.min("q2").alias("q2"),
    )
    root = convs.agg(
        F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"),
        F.sum(F.col("turns") + 1).alias("weight"),
    ).where("n_convs > 0")
    zero = F.lit(0).cast("bigint")
    top = root.select(
        zero.alias("depth"), zero.alias("p1"), zero.alias("p2"), "conv", "n_convs", "weight",
        zero.alias("chars"), zero.alias("q1"), zero.alias("q2"),
    )
    named = written(grouped.unionByName(top), "trie-nodes")
    above = named.select(
        (F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"),
        F.col("conv").alias("parent"),
    )
    at = ["depth", "q1", "q2"]
    return written(
        named.where("depth > 0").join(above, at).unionByName(
            named.where("depth = 0").withColumn("parent", F.lit(None).cast("bigint"))
        ).drop("q1", "q2"),
        "trie-edges",
    )


# -- the rollup --------------------------------------------------------------------------------

_STATE = ["conv", "depth", "parent", "weight", "x1", "x2", "r1", "r2", "top_conv", "top_depth"]
_TOP = ["top_conv", "top_depth"]


def _numpy_rounds(parent: np.ndarray, weight: np.ndarray, x: np.ndarray) -> np.ndarray:
    """For each node the sum of ``x`` over its subtree: the rounds of the module, in memory.

    ``parent`` is the place of a node's parent, its own for a top.
    """
    total = np.zeros_like(x)
    up, weight = parent.copy(), weight.copy()
    active = np.arange(len(parent))
    level = np.zeros(len(parent), np.int64)  # number of ancestors, to find the deepest
    jump = parent.copy()
    step = (jump != np.arange(len(parent))).astype(np.int64)
    level += step
    while (jump != jump[jump]).any():
        level += level[jump]
        jump = jump[jump]
    while len(active):
        top = up.copy()
        while (top[active] != (hop := top[top[active]])).any():
            top[active] = hop
        of = top[active]
        path = active[2 * weight[active] > weight[of]]
        order = np.lexsort((level[path], top[path]))
        path = path[order]
        last = np.r_[top[path][1:] != top[path][:-1], True]
        centroid = np.full(len(parent), -1)
        centroid[top[path][last]] = path[last]
        mine = centroid[of]  # of each active node
        cut = up.copy()
        under = up[active] == mine  # children of the centroid; a top may be one itself
        cut[active[under]] = active[under]
        cut[path[last]] = path[last]
        part = cut.copy()
        while (part[active] != (hop := part[part[active]])).any():
            part[active] = hop
        sums = np.zeros_like(x)
        np.add.at(sums, part[active], x[active])
        below = x.copy()  # a centroid's total: its own and those of the parts of its children
        child = active[under & (active != mine)]
        below_c = np.zeros_like(x)
        np.add.at(below_c, up[child], sums[child])
        below += below_c
        goes = centroid[top[path]]
        total[path] += below[goes]
        lower = path[path != goes]
        weight[lower] -= weight[centroid[top[lower]]]
        up = cut
        active = active[active != mine]
    return total


def _finish(batches):
    """Components, whole and one after another in each task, with their sums added."""

    def solve(table: pa.RecordBatch) -> pa.RecordBatch:
        get = {c: table.column(c).to_numpy() for c in _STATE if c != "parent"}
        above = table.column("parent").fill_null(NO_ID).to_numpy()
        differ = [get[c][1:] != get[c][:-1] for c in _TOP]
        component = np.cumsum(np.r_[True, np.any(differ, axis=0)])
        places = pd.MultiIndex.from_arrays([component, get["depth"], get["conv"]])
        wanted = pd.MultiIndex.from_arrays([component, get["depth"] - 1, above])
        is_top = (get["conv"] == get["top_conv"]) & (get["depth"] == get["top_depth"])
        parent = np.where(is_top, np.arange(len(above)), places.get_indexer(wanted))
        sums = _numpy_rounds(parent, get["weight"], np.stack([get["x1"], get["x2"]], axis=1))
        columns = [get["conv"], get["depth"], get["r1"] + sums[:, 0], get["r2"] + sums[:, 1]]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in columns], ["conv", "depth", "r1", "r2"]
        )

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size > LOCAL_NODES:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            tops = [whole.column(c).to_numpy() for c in _TOP]
            changes = np.flatnonzero(np.any([t[1:] != t[:-1] for t in tops], axis=0)) + 1
            if len(changes):  # the last component may go on
                cut = int(changes[-1])
                yield solve(whole.slice(0, cut))
                whole = whole.slice(cut)
            held, size = [whole], whole.num_rows
    if size:
        yield solve(pa.Table.from_batches(held).combine_chunks().to_batches()[0])


def rollup(nodes: DataFrame, rows: DataFrame, local_nodes: int = LOCAL_NODES) -> DataFrame:
    """``conv, depth, r1, r2``: sums of ``x1, x2`` of ``nodes`` over each subtree."""
    zero = F.lit(0).cast("bigint")
    first = nodes.agg(F.min("conv")).first()[0]
    state = written(
        nodes.select(
            "conv", "depth", "parent", "weight", "x1", "x2", zero.alias("r1"), zero.alias("r2"),
            F.lit(first).cast("bigint").alias("top_conv"), zero.alias("top_depth"),
        ),
        "trie-state",
    )
    result = ["conv", "depth", "r1", "r2"]
    done = []
    while True:
        is_top = (F.col("conv") == F.col("top_conv")) & (F.col("depth") == F.col("top_depth"))
        sizes = written(
            state.groupBy(*_TOP).agg(
                F.count(F.lit(1)).alias("size"), F.max(F.when(is_top, F.col("weight"))).alias("all")
            ),
            "trie-sizes",
        )
        small = state.join(sizes.where(F.col("size") <= local_nodes).select(*_TOP), _TOP)
        grouped = small.select(*_STATE).repartition(*_TOP).sortWithinPartitions(*_TOP)
        done.append(
            written(grouped.mapInArrow(_finish, ", ".join(f"{c} long" for c in result)), "trie-part")
        )
        large = sizes.where(F.col("size") > local_nodes).select(*_TOP, "all")
        if large.isEmpty():
            break
        earlier = state
        finished, state = _round(state.join(large, _TOP), rows)
        discard(earlier)
        done.append(finished)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def _round(state: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One round on the large components: results of their centroids, and what is left."""
    on_path = 2 * F.col("weight") > F.col("all")
    centroids = written(
        state.where(on_path)
        .groupBy(*_TOP)
        .agg(F.max(F.struct("depth", "conv", "weight", "x1", "x2")).alias("c"))
        .select(
            *_TOP, F.col("c.depth").alias("c_depth"), F.col("c.conv").alias("c_conv"),
            F.col("c.weight").alias("c_weight"), F.col("c.x1").alias("c_x1"),
            F.col("c.x2").alias("c_x2"),
        ),
        "trie-centroids",
    )
    joined = state.join(centroids, _TOP)
    # A node below the centroid's depth is under it if its smallest member goes through it: the
    # member's prefix one turn deeper names the child. One lookup for each member and block.
    block = F.floor(F.col("depth") / BLOCK_TURNS)
    deeper = joined.where(F.col("depth") > F.col("c_depth")).select(
        "conv", *_TOP, "c_depth", "c_conv", block.alias("block")
    ).distinct()
    wanted = written(deeper, "trie-wanted")
    members = wanted.select("conv", (F.col("c_depth") + 1).alias("depth")).distinct()
    passed = members.join(rows, _NODE).select("conv", "depth", "child", "under")
    parts = wanted.withColumn("at", F.col("c_depth") + 1).join(
        passed.withColumnRenamed("depth", "at"), ["conv", "at"]
    )
    parts = parts.where(F.col("under") == F.col("c_conv")).select(
        "conv", *_TOP, "block", F.col("child").alias("part_conv"), F.col("at").alias("part_depth")
    )
    labelled = written(
        joined.withColumn("block", block)
        .join(parts, ["conv", *_TOP, "block"], "left")
        .withColumn("under", F.col("part_conv").isNotNull() & (F.col("depth") > F.col("c_depth"))),
        "trie-labels",
    )
    below = (
        labelled.where("under").groupBy(*_TOP).agg(F.sum("x1").alias("s1"), F.sum("x2").alias("s2"))
    )
    totals = written(
        centroids.join(below, _TOP, "left").select(
            *_TOP,
            (F.col("c_x1") + F.coalesce("s1", F.lit(0))).alias("s1"),
            (F.col("c_x2") + F.coalesce("s2", F.lit(0))).alias("s2"),
        ),
        "trie-totals",
    )
    summed = labelled.join(totals, _TOP)
    is_centroid = (F.col("conv") == F.col("c_conv")) & (F.col("depth") == F.col("c_depth"))
    add = lambda r, s: (F.col(r) + F.when(on_path, F.col(s)).otherwise(0)).alias(r)
    left = summed.where(~is_centroid).select(
        "conv", "depth", "parent",
        (F.col("weight") - F.when(on_path, F.col("c_weight")).otherwise(0)).alias("weight"),
        "x1", "x2", add("r1", "s1"), add("r2", "s2"),
        F.when(F.col("under"), F.col("part_conv")).otherwise(F.col("top_conv")).alias("top_conv"),
        F.when(F.col("under"), F.col("part_depth")).otherwise(F.col("top_depth")).alias("top_depth"),
    )
    finished = summed.where(is_centroid).select(
        "conv", "depth", (F.col("r1") + F.col("s1")).alias("r1"), (F.col("r2") + F.col("s2")).alias("r2")
    )
    return written(finished, "trie-finished"), written(left, "trie-state")


# -- the ends ----------------------------------------------------------------------------------


def _joined_ids(batches):
    """Blocks of the decimal ids of a node, from rows sorted by node and id."""
    node, ids = None, []
    shape = pa.schema([(c, pa.int64()) for c in ("conv", "depth", "first")] + [("ids", pa.string())])

    def rows(found):
        columns = [pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), shape, strict=True)]
        return pa.RecordBatch.from_arrays(columns, schema=shape)

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv", "depth", "member")]
        out = []
        for conv, depth, member in zip(*columns, strict=True):
            if (conv, depth) != node or len(ids) >= BLOCK_IDS:
                if ids:
                    out.append((*node, ids[0], ",".join(map(str, ids))))
                node, ids = (conv, depth), []
            ids.append(member)
        if out:
            yield rows(out)
    if ids:
        yield rows([(*node, ids[0], ",".join(map(str, ids)))])


def _hashed(batches):
    """SHA-256 of the blocks of each node, from rows sorted by node and first id."""
    node, digest = None, None
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv", "depth", "ids")]
        out = []
        for conv, depth, ids in zip(*columns, strict=True):
            if (conv, depth) == node:
                digest.update(b"," + ids.encode())
            else:
                if node:
                    out.append((*node, digest.hexdigest()))
                node, digest = (conv, depth), hashlib.sha256(ids.encode())
        if out:
            yield _hash_rows(out)
    if node:
        yield _hash_rows([(*node, digest.hexdigest())])


def _hash_rows(rows) -> pa.RecordBatch:
    convs, depths, hashes = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(convs, pa.int64()), pa.array(depths, pa.int64()), pa.array(hashes)],
        ["conv", "depth", "ends"],
    )


def ends_of(nodes: DataFrame, rows: DataFrame, convs: DataFrame) -> DataFrame:
    """``conv, depth, ends``: the hash of the ids of the conversations that end at a node."""
    root = nodes.where("depth = 0").select("conv").first()
    turnless = convs.where("turns = 0").select(
        F.col("conv").alias("member"), F.lit(0).cast("bigint").alias("depth"),
        F.lit(root and root.conv).cast("bigint").alias("conv"),
    )
    last = rows.where("depth = turns").select(
        F.col("conv").alias("member"), "depth", F.col("child").alias("conv")
    )
    ending = written(last.unionByName(turnless), "trie-ends").select("conv", "depth", "member")
    order = ["conv", "depth", "member"]
    blocks = (
        ending.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .mapInArrow(_joined_ids, "conv long, depth long, first long, ids string")
    )
    whole = blocks.repartition(*_NODE).sortWithinPartitions(*_NODE, "first")
    return whole.mapInArrow(_hashed, "conv long, depth long, ends string")


def trie(conversations: DataFrame, local_nodes: int = LOCAL_NODES) -> DataFrame:
    """A row for each node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256``."""
    turns, convs = rebuilt(conversations)
    convs = written(convs, "trie-lengths")
    named = prefixes(turns)
    nodes = nodes_of(named, convs)
    name = nodes.select(
        "depth", "p1", "p2", F.col("conv").alias("child"), F.col("parent").alias("under")
    )
    rows = written(
        named.select("conv", "turns", "depth", "p1", "p2")
        .join(name, ["depth", "p1", "p2"])
        .select("conv", "turns", "depth", "child", "under"),
        "trie-members",
    )
    children = (
        nodes.where("depth > 0")
        .groupBy(F.col("parent").alias("conv"), (F.col("depth") - 1).alias("depth"))
        .agg(F.count(F.lit(1)).alias("n_children"))
    )
    full = written(
        nodes.join(children, _NODE, "left")
        .withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("bigint")))
        .withColumn("x1", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("bigint"))
        .withColumn("x2", (F.col("n_convs") - 1) * F.col("chars"))
        .drop("p1", "p2"),
        "trie-full",
    )
    sums = rollup(full, rows, local_nodes)
    none = hashlib.sha256(b"").hexdigest()
    return (
        full.join(sums, _NODE)
        .join(ends_of(full, rows, convs), _NODE, "left")
        .select(
            F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"),
            "n_convs", "n_children", F.col("r1").alias("n_leaves"),
            F.col("r2").alias("saved_tokens"),
            F.coalesce("ends", F.lit(none)).alias("ends_sha256"),
        )
    )
