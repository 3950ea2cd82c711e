"""Approximate nearest neighbours by balanced posting lists.

Inner products become distances by one more component, which brings all vectors to one length.
On a bounded sample (``SAMPLE_ROWS`` rows of smallest hash) balanced bisection finds centroids;
a neighbour graph over them is kept in memory and searched best-first for many vectors at once.
Every vector goes to the list of its nearest centroid, and a vector near a border to further
lists whose distance is within ``BORDER`` of the nearest, ``REPLICAS`` in all. A query looks at a
fixed part of all lists (``SHARE``, and ``BEAM`` at least), so that recall does not fall as the
table grows. Of these it reads the lists within ``REACH`` of its nearest centroid, and more until
they hold ``ENOUGH`` rows for each neighbour wanted. Where a search would come by most centroids
anyway, it compares with all of them. Scores are inner products of the
original vectors in double precision.

Lists are split into parts of about ``PART_ROWS`` rows, and the queries of a list into blocks, so
that a vector that many rows share, or many queries, makes no large group.

Defined cases: vectors that are null, zero, of another length than most, or hold null or
non-finite components take no part, neither as queries nor as candidates; rows of one id count
as one candidate with the best of their scores, and are never neighbours of each other; ties go
to the smaller id; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteindex.llm.common import KEY, id_key, id_of, written

NEIGHBOURS = 20
SAMPLE_ROWS, LIST_ROWS, PART_ROWS, SEED = 20_000, 150, 4_000, 6
#: At most this many lists hold a vector; the least beam of a query and the part of the lists it is.
REPLICAS, BEAM, SHARE, DEGREE, ENTRIES = 4, 64, 0.2, 24, 16
BORDER, REACH, ENOUGH = 0.12, 0.5, 30


def usable(vector: str) -> Column:
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(ok & F.exists(vector, lambda x: x != 0), F.lit(False))


def bisected(points: np.ndarray, lists: int) -> np.ndarray:
    """Centroids of groups of equal size, by halving groups along their two means."""
    random = np.random.default_rng(SEED)
    groups = [np.arange(len(points))]
    while len(groups) < lists:
        groups.sort(key=len)
        group = groups.pop()
        if len(group) < 2:
            groups.append(group)
            break
        own = points[group]
        means = own[random.choice(len(own), 2, replace=False)]
        half = len(group) // 2
        for _ in range(6):
            order = np.argsort(own @ (means[1] - means[0]), kind="stable")
            means = np.stack([own[order[:half]].mean(0), own[order[half:]].mean(0)])
        groups += [group[order[:half]], group[order[half:]]]
    return np.stack([points[g].mean(0) for g in groups])


@dataclass
class Centroids:
    """Centroids and the graph of their nearest others."""

    points: np.ndarray
    graph: np.ndarray
    entries: np.ndarray

    @classmethod
    def of(cls, points: np.ndarray) -> Centroids:
        n = len(points)
        degree = min(DEGREE, max(1, n - 1))
        graph = np.empty((n, degree), np.int32)
        squares = (points**2).sum(1)
        for a in range(0, n, 1024):
            far = squares[a : a + 1024, None] + squares - 2 * points[a : a + 1024] @ points.T
            far[np.arange(len(far)), np.arange(a, a + len(far))] = np.inf
            graph[a : a + 1024] = np.argsort(far, axis=1, kind="stable")[:, :degree]
        entries = np.unique(np.linspace(0, n - 1, min(n, ENTRIES)).astype(np.int32))
        return cls(points, graph, entries)

    def distances(self, vectors: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return np.sqrt(((self.points[ids] - vectors[:, None]) ** 2).sum(2))

    def nearest(self, vectors: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` nearest centroids found for each vector, and their distances."""
        if beam * self.graph.shape[1] >= len(self.points):
            return self.nearest_of_all(vectors, beam)
        rows = np.arange(len(vectors))[:, None]
        ids = np.tile(self.entries, (len(vectors), 1))
        far = self.distances(vectors, ids)
        done = np.zeros(ids.shape, bool)
        while True:
            waiting = np.where(done, np.inf, far)
            pick = waiting.argmin(1)[:, None]
            active = np.isfinite(waiting[rows, pick])[:, 0]
            if not active.any():
                return ids, far
            done[rows, pick] = True
            new = self.graph[ids[rows, pick][:, 0]]
            new_far = self.distances(vectors, new)
            known = (new[:, :, None] == ids[:, None, :]).any(2) | ~active[:, None]
            new_far[known] = np.inf
            ids = np.concatenate([ids, new], 1)
            far = np.concatenate([far, new_far], 1)
            done = np.concatenate([done, known], 1)
            order = np.argsort(far, axis=1, kind="stable")[:, :beam]
            ids, far, done = ids[rows, order], far[rows, order], done[rows, order]
            done |= ~np.isfinite(far)

    def nearest_of_all(self, vectors: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        squares = (self.points**2).sum(1) + (vectors**2).sum(1)[:, None]
        far = np.sqrt(np.maximum(0.0, squares - 2 * vectors @ self.points.T))
        ids = np.argsort(far, axis=1, kind="stable")[:, :beam].astype(np.int32)
        return ids, np.take_along_axis(far, ids, 1)

    def homes(self, vectors: np.ndarray) -> list[np.ndarray]:
        """The lists of each vector."""
        ids, far = self.nearest(vectors, 4 * REPLICAS)
        chosen = np.isfinite(far) & (far <= (1 + BORDER) * far[:, :1])
        chosen[:, REPLICAS:] = False
        return [i[c] for i, c in zip(ids, chosen, strict=True)]

    def lists_for(self, vectors: np.ndarray, sizes: np.ndarray, rows: int) -> list[np.ndarray]:
        """The lists to read for each query."""
        ids, far = self.nearest(vectors, max(BEAM, int(np.ceil(SHARE * len(self.points)))))
        held = np.cumsum(sizes[ids], axis=1) - sizes[ids]
        read = np.isfinite(far) & ((far <= (1 + REACH) * far[:, :1]) | (held < rows))
        return [i[r] for i, r in zip(ids, read, strict=True)]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _batches(batches, rows: int = 512):
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _best(queries: pd.DataFrame, rows: pd.DataFrame, dim: int, k: int) -> pd.DataFrame:
    """The ``k`` best rows of a part for each query, ties included in full before the cut."""
    q = np.frombuffer(b"".join(queries["vector"]), "<f8").reshape(-1, dim)
    x = np.frombuffer(b"".join(rows["vector"]), "<f8").reshape(-1, dim)
    ids = rows[KEY].to_numpy()
    out = []
    for query, own, near in zip(q, queries["query"].to_numpy(), q @ x.T, strict=True):
        near = np.where(ids == own, -np.inf, near)
        take = np.flatnonzero(np.isfinite(near))
        if len(take) > k:
            least = np.partition(near, len(near) - k)[len(near) - k]
            take = np.flatnonzero(near >= least - 1e-9 * max(1.0, abs(least)))
        exact = (x[take] * query).sum(axis=1)
        order = np.lexsort((ids[take], -exact))
        _, first = np.unique(ids[take][order], return_index=True)
        order = order[np.sort(first)][:k]
        out.append(pd.DataFrame({"query": own, KEY: ids[take][order], "score": exact[order]}))
    return pd.concat(out)


def nearest(
    vectors: DataFrame,
    is_query: Column,
    neighbours: int = NEIGHBOURS,
    vec_id: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the nearest rows found for each query row."""
    spark = vectors.sparkSession
    shape = "query_id long, rank int, vec_id long, score double"
    all_rows = vectors.where(usable(vector)).select(
        id_key(vec_id).alias(KEY),
        F.col(vector).cast("array<double>").alias("v"),
        F.coalesce(is_query, F.lit(False)).alias("is_query"),
    )
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    shapes = all_rows.groupBy(F.size("v").alias("dim")).agg(
        F.count(F.lit(1)).alias("n"), F.max(square).alias("top")
    )
    most = shapes.orderBy(F.desc("n"), "dim").first()
    if most is None:
        return spark.createDataFrame([], shape)
    dim, total, top = most
    rows = all_rows.where(F.size("v") == dim)
    sample = rows.orderBy(F.xxhash64(F.lit(SEED), KEY), KEY).limit(SAMPLE_ROWS).select("v").toArrow()
    points = _matrix(sample.column("v").combine_chunks(), dim)

    def longer(x: np.ndarray, to: float) -> np.ndarray:
        return np.c_[x, np.sqrt(np.maximum(0.0, to - (x**2).sum(1)))]

    lists = max(1, min(-(-total // LIST_ROWS), len(points) // 8))
    centroids = spark.sparkContext.broadcast(Centroids.of(bisected(longer(points, top), lists)))

    def place(batches):
        for batch in _batches(batches):
            x = _matrix(batch.column("v"), dim)
            yield _filed(batch.column(KEY), x, centroids.value.homes(longer(x, top)))

    def _filed(ids, x, homes):
        lengths = np.array([len(h) for h in homes])
        at = pa.array(np.repeat(np.arange(len(homes)), lengths))
        data = pa.array([v.tobytes() for v in x], pa.binary())
        home = pa.array(np.concatenate([*homes, np.zeros(0, np.int32)]).astype(np.int32))
        return pa.RecordBatch.from_arrays([home, ids.take(at), data.take(at)], ["list", KEY, "vector"])

    filed_shape = f"list int, {KEY} long, vector binary"
    filed = written(rows.select(KEY, "v").mapInArrow(place, filed_shape), "posting-lists")
    # one row for each list, and there are SAMPLE_ROWS / 8 lists at most
    sizes = np.zeros(lists, np.int64)
    for r in filed.groupBy("list").count().collect():
        sizes[r["list"]] = r["count"]
    enough = neighbours * ENOUGH

    def look(batches):
        for batch in _batches(batches):
            x = _matrix(batch.column("v"), dim)
            wanted = centroids.value.lists_for(np.c_[x, np.zeros(len(x))], sizes, enough)
            yield _filed(batch.column(KEY), x, wanted)

    queries = rows.where("is_query").select(KEY, "v").mapInArrow(look, filed_shape)
    queries = written(queries.withColumnRenamed(KEY, "query"), "list-queries")
    asked = {r["list"]: r["count"] for r in queries.groupBy("list").count().collect()}
    splits = spark.createDataFrame(
        [(i, -(-int(sizes[i]) // PART_ROWS), -(-n // PART_ROWS)) for i, n in asked.items()],
        "list int, parts int, blocks int",
    )
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    group = ["list", "part", "block"]
    left = queries.join(F.broadcast(splits.where("parts > 0")), "list").select(
        "list", numbers("parts").alias("part"), dealt("query", "blocks").alias("block"), "query", "vector"
    )
    right = filed.join(F.broadcast(splits), "list").select(
        "list", dealt(KEY, "parts").alias("part"), numbers("blocks").alias("block"), KEY, "vector"
    )

    def match(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if q.empty or x.empty:
            return pd.DataFrame({"query": [], KEY: [], "score": []})
        return _best(q, x, dim, neighbours)

    found = (
        left.groupBy(*group)
        .cogroup(right.groupBy(*group))
        .applyInPandas(match, f"query long, {KEY} long, score double")
    )
    order = Window.partitionBy("query").orderBy(F.desc("score"), KEY)
    best = found.groupBy("query", KEY).agg(F.max("score").alias("score"))
    return (
        best.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= neighbours)
        .select(id_of("query").alias("query_id"), "rank", id_of().alias("vec_id"), "score")
    )
