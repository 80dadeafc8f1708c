"""Exact top-k search by inner product as a Voronoi join.

1. A bounded sample of vectors (as many as the root of their number, within ``PIVOTS``, the first by a hash of their id) are the pivots; every vector belongs to
   the cell of its nearest pivot. Nothing but the work depends on which they are.
2. Summaries of each cell (rows, least and greatest distance from its pivot) are all that the driver sees. With
   d = |x - p|, q . x lies within q . p - |q| d and q . p + |q| d: the nearest row of every cell bounds a query's k-th
   best score from below, the farthest bounds all scores of a cell from above.
3. A query goes only to cells whose upper bound reaches its lower one. Cells are split into chunks of about ``CHUNK``
   rows by a hash, so a cell that holds most rows is many tasks; data rows move once, the queries are replicated.
4. Each chunk multiplies its queries, in blocks, with its rows and keeps k of each; the k best of all chunks remain.

Rows that repeat an id and a vector become one before anything is bounded or ranked. An id may have several vectors:
each counts under its own score, and equal scores of one id count once, in a chunk before its k are taken.

Scores are sums of integers below 2**53 and exact in floating point.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholium.llm.shared import materialize

#: Pivots: the root of the number of rows, within these bounds, so that cells grow as slowly as their number.
PIVOTS = (32, 2048)
CHUNK = 40_000
BLOCK = 4_000_000
#: Relative slack of the bounds against rounding.
SLACK = 1e-9


def quantised(vector: Column, by: int) -> Column:
    """floor(by * x) of each component, as double; null for a vector that is null or holds null, NaN or an infinity."""
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * by).cast("double"))
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(vector.isNotNull() & usable, whole)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _cells(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(id, v, is_query, cell, far): the nearest pivot and the distance from it."""
    dim = pivots.shape[1]
    square = (pivots**2).sum(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = matrix(b.column("v"), dim)
            cell = (square - 2 * v @ pivots.T).argmin(1)
            far = np.sqrt(((v - pivots[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32()), pa.array(far)], names=[*b.schema.names, "cell", "far"])

    return rows.mapInArrow(run, "id long, v array<double>, is_query boolean, cell int, far double")


def wanted(q: np.ndarray, pivots: np.ndarray, count: np.ndarray, near: np.ndarray, far: np.ndarray, k: int, spread: int = 1) -> np.ndarray:
    """Which cells each query needs. The rows of one id lie in at most ``spread`` cells: so many bounds may be of a query's own id, or of one result."""
    norm = np.sqrt((q**2).sum(1))[:, None]
    dot = q @ pivots.T
    slack = SLACK * (1 + np.abs(dot) + norm * far)
    low = np.where(count > 0, dot - norm * near - slack, -np.inf)
    place = (k + 1) * spread
    kth = np.sort(low, axis=1)[:, -place] if low.shape[1] >= place else np.full(len(q), -np.inf)
    return (dot + norm * far + slack >= kth[:, None]) & (count > 0)


def _route(queries: DataFrame, pivots: np.ndarray, count: np.ndarray, near: np.ndarray, far: np.ndarray, chunks: np.ndarray, k: int, spread: int) -> DataFrame:
    """(id, v, chunk): a query once for each chunk that it needs."""
    first = np.cumsum(chunks) - chunks
    dim = pivots.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, cell = np.nonzero(wanted(matrix(b.column("v"), dim), pivots, count, near, far, k, spread))
            n = chunks[cell]
            row = np.repeat(row, n)
            chunk = np.repeat(first[cell], n) + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            for lo in range(0, len(row), 20_000):
                pick = pa.array(row[lo : lo + 20_000])
                yield pa.RecordBatch.from_arrays([b.column("id").take(pick), b.column("v").take(pick), pa.array(chunk[lo : lo + 20_000])], names=["id", "v", "chunk"])

    return queries.select("id", "v").mapInArrow(run, "id long, v array<double>, chunk long")


def once(score: np.ndarray, ids: np.ndarray) -> None:
    """Of the columns with one id (``ids`` is sorted) and one score in a row, all but the first become -inf."""
    same = ids[1:] == ids[:-1]
    cols = np.flatnonzero(np.append(same, False) | np.append(False, same))
    if len(cols):
        part = score[:, cols]
        own = np.broadcast_to(ids[cols], part.shape)
        order = np.lexsort((part, own), axis=-1)
        by = np.take_along_axis(part, order, 1)
        again = np.zeros(part.shape, bool)
        again[:, 1:] = (by[:, 1:] == by[:, :-1]) & (np.take_along_axis(own, order, 1)[:, 1:] == np.take_along_axis(own, order, 1)[:, :-1])
        by[again] = -np.inf
        np.put_along_axis(part, order, by, 1)
        score[:, cols] = part


def _solve(k: int):
    def run(queries: pa.Table, data: pa.Table) -> pa.Table:
        none = np.empty(0, np.int64)
        out = [(none, none, none)]
        if queries.num_rows and data.num_rows:
            q_id, x_id = queries.column("id").to_numpy(), data.column("id").to_numpy()
            order = np.argsort(x_id, kind="stable")
            x_id = x_id[order]
            v = data.column("v").combine_chunks()
            dim = len(v[0])
            x = matrix(v, dim)[order].T
            q = matrix(queries.column("v").combine_chunks(), dim)
            step = max(1, BLOCK // len(x_id))
            for lo in range(0, len(q), step):
                own = q_id[lo : lo + step]
                score = q[lo : lo + step] @ x
                score[own[:, None] == x_id] = -np.inf
                once(score, x_id)
                # all rows that reach the k-th best score, then ties by id
                least = np.partition(score, -k, axis=1)[:, -k] if score.shape[1] > k else np.full(len(own), -np.inf)
                row, col = np.nonzero((score >= least[:, None]) & np.isfinite(score))
                best = score[row, col]
                by = np.lexsort((col, -best, row))
                row, col, best = row[by], col[by], best[by]
                place = np.arange(len(row)) - np.searchsorted(row, row)
                on = place < k
                out.append((own[row[on]], x_id[col[on]], best[on].astype(np.int64)))
        a, b, s = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.table({"query_id": pa.array(a), "vec_id": pa.array(b), "score": pa.array(s)})

    return run


def voronoi_top_k(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", by: int = 256, pivots: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """query_id, rank, vec_id, score: for every query its k rows of highest inner product, ties to the smaller id.

    Components are floor(by * x). Rows whose id or vector is null, or whose vector holds a null or non-finite component,
    take no part; a row with the query's own id is no candidate. If vectors differ in length an error is raised, as they
    have no product with one another. Rows that repeat an id under one vector count once. An empty
    table gives an empty result; other columns are not read.
    """
    out = "query_id long, vec_id long, score long"
    chosen = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("id"), quantised(F.col(f"`{vector}`"), by).alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    rows = chosen.where("id is not null and v is not null and size(v) > 0")
    if pivots is None:
        pivots = int(min(max(rows.count() ** 0.5, PIVOTS[0]), PIVOTS[1]))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(pivots).select("v").collect()
    if not sample:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim = len(sample[0]["v"])
    if any(len(r["v"]) != dim for r in sample):
        raise ValueError("vectors of different lengths")
    rows = rows.withColumn("v", F.when(F.size("v") == dim, F.col("v")).otherwise(F.raise_error(F.lit("vectors of different lengths")).cast("array<double>")))
    places = np.unique(np.array([r["v"] for r in sample], float), axis=0)
    each = rows.groupBy("id", "v").agg(F.max("is_query").alias("is_query"))
    held = materialize(_cells(each, places), "cells")
    spread = held.select("id", "cell").distinct().groupBy("id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    n = len(places)
    count, near, far = np.zeros(n), np.zeros(n), np.zeros(n)
    for r in held.groupBy("cell").agg(F.count("*").alias("n"), F.min("far").alias("near"), F.max("far").alias("far")).collect():
        count[r["cell"]], near[r["cell"]], far[r["cell"]] = r["n"], r["near"], r["far"]
    chunks = np.ceil(count / chunk).astype(np.int64)
    first = np.cumsum(chunks) - chunks
    total = int(chunks.sum())
    split = F.array(*[F.lit(int(x)) for x in np.maximum(chunks, 1)])[F.col("cell")]
    start = F.array(*[F.lit(int(x)) for x in first])[F.col("cell")]
    data = held.select("id", "v", (start + F.pmod(F.xxhash64("id"), split)).cast("long").alias("chunk")).repartition(total, "chunk")
    asked = _route(held.where("is_query"), places, count, near, far, chunks, k, spread).repartition(total, "chunk")
    local = asked.groupBy("chunk").cogroup(data.groupBy("chunk")).applyInArrow(_solve(k), out).distinct()
    ranked = local.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
