"""Approximate nearest neighbours by an inverted multi-index.

Vectors are compared by cosine, so they are scaled to length one and cut into two
halves. A codebook of ``CODES`` centroids per half is fitted by k-means on a bounded
sample (``SAMPLE`` vectors, by a hash of the id); every vector then belongs to one
of ``CODES`` squared cells, and every vector is indexed.

A query orders the centroids of each half by distance and takes pairs from a heap by
the sum of both distances, until the cells taken hold ``SHARE`` of all vectors (and at
least ``LEAST`` of them). Vectors without structure need a large share for a recall
of 0.9; the parameter trades work for recall.

Cells meet their queries by a key of cell, slice of vectors and slice of queries, each
of bounded size, so a cell that holds a third of all vectors is many groups. A group
gives the best ``k`` of its vectors per query; scores are sums over the components of
the original vectors, in the same order for every vector, so equal vectors tie.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components
take no part, nor do rows without an id or of another dimension than most; rows that
repeat an id count once (the least vector); fewer candidates than ``k`` give all of
them; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formline.session import materialize

CODES, SAMPLE, ROUNDS = 16, 20_000, 20
SHARE, LEAST = 0.7, 2000
VECTORS_TOGETHER, QUERIES_TOGETHER = 8192, 1024
#: How far approximate scores may stand from exact ones.
SLACK = 1e-9


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, v`` (array of doubles) of the rows that take part, one per id."""
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.coalesce(sound, F.lit(False)) & F.exists("v", lambda x: x != 0))
    rows = rows.groupBy("vec_id").agg(F.min("v").alias("v"))
    size = rows.groupBy(F.size("v").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "size").limit(1)
    return rows.join(F.broadcast(size.select("size")), F.size("v") == F.col("size")).select("vec_id", "v")  # one row


def matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def scaled(v: np.ndarray) -> np.ndarray:
    """Vectors times a power of two each, which changes no cosine, so that squares stay in range."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True))[1])


def unit(v: np.ndarray) -> np.ndarray:
    v = scaled(v)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def halves(v: np.ndarray) -> list[np.ndarray]:
    """Both halves; a vector of one component has an empty second half."""
    cut = (v.shape[1] + 1) // 2
    return [v[:, :cut], v[:, cut:]]


def squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ centroids.T + (centroids * centroids).sum(axis=1)[None], 0)


def codebook(x: np.ndarray, codes: int = CODES) -> np.ndarray:
    """k-means centroids, started from distant points."""
    rng = np.random.default_rng(11)
    start = [int(rng.integers(len(x)))]
    away = squared(x, x[start])[:, 0]
    while len(start) < min(codes, len(x)) and away.sum() > 0:
        start.append(int(rng.choice(len(x), p=away / away.sum())))
        away = np.minimum(away, squared(x, x[start[-1:]])[:, 0])
    centroids = x[start].copy()
    for _ in range(ROUNDS):
        nearest = squared(x, centroids).argmin(axis=1)
        for c in np.unique(nearest):
            centroids[c] = x[nearest == c].mean(axis=0)
    return centroids


def traverse(distances: list[np.ndarray], sizes: np.ndarray, wanted: int) -> list[int]:
    """Cells by summed distance, from a heap, until they hold ``wanted`` vectors."""
    order = [np.argsort(d, kind="stable") for d in distances]
    a, b = (d[o] for d, o in zip(distances, order))
    heap, pushed, held, cells = [(a[0] + b[0], 0, 0)], {(0, 0)}, 0, []
    while heap and held < wanted:
        _, i, j = heapq.heappop(heap)
        cell = int(order[0][i]) * len(b) + int(order[1][j])
        if sizes[cell]:
            cells.append(cell)
            held += int(sizes[cell])
        for at in ((i + 1, j), (i, j + 1)):
            if at[0] < len(a) and at[1] < len(b) and at not in pushed:
                pushed.add(at)
                heapq.heappush(heap, (a[at[0]] + b[at[1]], *at))
    return cells


def best(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int):
    """``(query, vector, score)`` of the ``k`` best vectors of every query, exact scores, ties to smaller ids."""
    near = unit(queries) @ unit(vectors).T
    near[query_ids[:, None] == ids[None]] = -np.inf
    queries, vectors = scaled(queries), scaled(vectors)
    lengths = [np.sqrt((x * x).sum(axis=1)) for x in (queries, vectors)]
    out: tuple[list, list, list] = ([], [], [])
    for i in range(len(queries)):
        row = near[i]
        m = min(k, len(row))
        least = np.partition(row, len(row) - m)[len(row) - m]
        at = np.flatnonzero(row >= max(least - SLACK, -2))
        score = (vectors[at] * queries[i]).sum(axis=1) / (lengths[1][at] * lengths[0][i])
        pick = np.lexsort((ids[at], -score))[:k]
        out[0].extend([int(query_ids[i])] * len(pick))
        out[1].extend(ids[at[pick]].tolist())
        out[2].extend(score[pick].tolist())
    return out


def nearest(vectors: DataFrame, is_query: Column | None = None, k: int = 5, share: float = SHARE,
            id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` of the nearest found for the rows of ``is_query``, a condition on ``vec_id``."""
    rows = materialize(usable(vectors, id_col, vector_col))
    n = rows.count()
    picked = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, 1.2 * SAMPLE / max(n, 1)) + 1))
    sample = picked.orderBy(F.xxhash64("vec_id")).limit(SAMPLE).select("v").toArrow()
    if not len(sample):
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    books = [codebook(h) for h in halves(unit(matrix(sample["v"])))]
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def assign(batches):
        for batch in batches:
            v = matrix(batch.column(1))
            codes = [squared(h, b).argmin(axis=1) for h, b in zip(halves(unit(v)), shared.value)] if len(v) else [np.zeros(0, int)] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes[0] * len(shared.value[1]) + codes[1], pa.int64())],
                                             ["vec_id", "v", "cell"])

    indexed = materialize(rows.mapInArrow(assign, "vec_id long, v array<double>, cell long"))
    sizes = np.zeros(len(books[0]) * len(books[1]), np.int64)
    for cell, m in indexed.groupBy("cell").agg(F.count(F.lit(1))).collect():  # at most codes squared rows
        sizes[cell] = m
    wanted = min(n, max(int(share * n), LEAST, 50 * k))

    def route(batches):
        for batch in batches:
            v = matrix(batch.column(1)) if len(batch) else np.zeros((0, 1))
            apart = [np.sqrt(squared(h, b)) ** 2 for h, b in zip(halves(unit(v)), shared.value)] if len(v) else []
            cells = [traverse([d[i] for d in apart], sizes, wanted) for i in range(len(v))]
            at = np.repeat(np.arange(len(v)), [len(c) for c in cells])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), batch.column(1).take(pa.array(at, pa.int64())),
                 pa.array([c for found in cells for c in found], pa.int64())], ["query_id", "q", "cell"])

    queries = rows.where(is_query) if is_query is not None else rows
    routed = queries.mapInArrow(route, "query_id long, q array<double>, cell long")
    q_slices = max(1, -(-queries.count() // QUERIES_TOGETHER))
    parts = F.element_at(F.array(*(F.lit(max(1, -(-int(m) // VECTORS_TOGETHER))) for m in sizes)), (F.col("cell") + 1).cast("int"))
    left = routed.withColumn("qs", F.pmod(F.xxhash64("query_id"), F.lit(q_slices))).withColumn(
        "vs", F.explode(F.sequence(F.lit(0), parts - 1).cast("array<long>")))
    right = indexed.withColumn("vs", F.pmod(F.xxhash64("vec_id"), parts)).withColumn(
        "qs", F.explode(F.sequence(F.lit(0), F.lit(q_slices - 1)).cast("array<long>")))

    def meet(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        out = ([], [], [])
        if len(queries) and len(vectors):
            out = best(matrix(queries["q"]), queries["query_id"].to_numpy(), matrix(vectors["v"]), vectors["vec_id"].to_numpy(), k)
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    keys = ["cell", "vs", "qs"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
