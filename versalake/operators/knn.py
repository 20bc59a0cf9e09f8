"""Exact nearest neighbours of a given set of query vectors, and re-ranking of candidates.

The rows are read once. Every task compares its batches with all queries by matrix products and keeps the k best of
each query, so what goes through the shuffle is (tasks x queries x k) rows, whatever the table's size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from versalake.errors import TooLarge
from versalake.functions.vectors import METRICS, ascending, measure
from versalake.session import ship

#: Bytes of query vectors that are sent to every task; more queries are a table of their own (`knn_blocks`).
MOST_QUERY_BYTES = 64 << 20


def matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def distances(queries: np.ndarray, rows: np.ndarray, metric: str) -> np.ndarray:
    """Every query against every row; cosine of a zero vector is NaN."""
    if metric == "l2":
        squares = (queries * queries).sum(1)[:, None] - 2 * queries @ rows.T + (rows * rows).sum(1)[None, :]
        return np.maximum(squares, 0.0)
    product = queries @ rows.T
    if metric == "cosine":
        size = np.sqrt((queries * queries).sum(1))[:, None] * np.sqrt((rows * rows).sum(1))[None, :]
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(size > 0, product / size, np.nan)
    return product


def exact_distance(query: np.ndarray, rows: np.ndarray, metric: str) -> np.ndarray:
    """Without the cancellation that the product form of l2 has."""
    if metric == "l2":
        return ((rows - query) ** 2).sum(1)
    if metric == "inner_product":
        return (rows * query).sum(1)
    size = np.sqrt((rows * rows).sum(1)) * np.sqrt((query * query).sum())
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(size > 0, (rows * query).sum(1) / size, np.nan)


def top(query: np.ndarray, ids: np.ndarray, rows: np.ndarray, near: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """The k best of one query from its distances `near`, computed anew exactly; ties by smaller id."""
    sign = 1.0 if ascending(metric) else -1.0
    cost = np.where(np.isnan(near), np.inf, sign * near)
    pick = np.arange(len(cost))
    if len(cost) > k:
        edge = np.partition(cost, k - 1)[k - 1]
        pick = np.flatnonzero(cost <= edge + 1e-6 * max(1.0, abs(edge)))
    pick = pick[np.isfinite(cost[pick])]
    fine = exact_distance(query, rows[pick], metric)
    order = np.lexsort((ids[pick], sign * fine))[:k]
    return ids[pick[order]], fine[order]


def _ranked(found: DataFrame, k: int, metric: str, id_: str) -> DataFrame:
    by = F.col("distance").asc() if ascending(metric) else F.col("distance").desc()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(by, id_))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", id_, "distance")


def knn(vectors: DataFrame, queries: Sequence[tuple[int, Sequence[float]]], k: int, metric: str = "l2", id_: str = "_pos", vector: str = "embedding", reach: np.ndarray | None = None) -> DataFrame:
    """(query_id, rank from 1, id, distance) of the k nearest rows of each query (id, vector). Rows whose vector is
    null or of another length take no part. reach: queries x cells, whether a query meets the rows of a `_cell`."""
    if metric not in METRICS:
        raise ValueError(f"no metric: {metric!r}")
    numbers = np.array([q for q, _ in queries], np.int64)
    asked = np.array([list(v) for _, v in queries], np.float64).reshape(len(numbers), -1 if len(numbers) else 0)
    if asked.nbytes > MOST_QUERY_BYTES:
        raise TooLarge(f"{asked.nbytes} bytes of queries; put them in a table and use knn_blocks")
    ship(vectors.sparkSession)
    if reach is not None and not reach.any(axis=0).all():
        vectors = vectors.where(F.col("_cell").isin(np.flatnonzero(reach.any(axis=0)).tolist()))
    cell = F.lit(0) if reach is None else F.col("_cell")
    rows = vectors.select(F.col(id_).cast("long").alias(id_), F.col(vector).cast("array<double>").alias("v"), cell.cast("int").alias("_cell"))
    rows = rows.where(F.col("v").isNotNull() & (F.size("v") == asked.shape[1]) & F.forall("v", lambda x: x.isNotNull()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0))] * len(numbers)
        sign = 1.0 if ascending(metric) else -1.0
        for batch in batches:
            if not batch.num_rows:
                continue
            every, vectors, cells = np.asarray(batch.column(0)), matrix(batch.column(1)), np.asarray(batch.column(2))
            for c in np.unique(cells):
                ids, have = every[cells == c], vectors[cells == c]
                mine = np.arange(len(numbers)) if reach is None else np.flatnonzero(reach[:, c])
                for at in range(0, len(mine), 256):
                    near = distances(asked[mine[at : at + 256]], have, metric)
                    for q, row in zip(mine[at : at + 256], near):
                        new = top(asked[q], ids, have, row, k, metric)
                        both = np.concatenate([best[q][0], new[0]]), np.concatenate([best[q][1], new[1]])
                        order = np.lexsort((both[0], sign * both[1]))[:k]
                        best[q] = both[0][order], both[1][order]
        if len(numbers):
            sizes = [len(i) for i, _ in best]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(numbers, sizes)), pa.array(np.concatenate([i for i, _ in best])), pa.array(np.concatenate([d for _, d in best]))], ["query_id", id_, "distance"])

    return _ranked(rows.mapInArrow(run, f"query_id long, `{id_}` long, distance double"), k, metric, f"`{id_}`")


def knn_blocks(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "l2", id_: str = "_pos", vector: str = "embedding", query_id: str = "query_id", block: int = 4096, reach: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """The same for a table of queries of any size, in blocks of queries: each pass over the rows serves one block.
    Queries whose vector is null take no part. reach: makes `knn`'s from a block's vectors."""
    made = None
    queries = queries.where(F.col(vector).isNotNull())
    total = queries.count()
    luck = F.pmod(F.xxhash64(query_id), F.lit(max(1, -(-total // block))))
    for i in range(max(1, -(-total // block))):
        part = [(r[0], r[1]) for r in queries.where(luck == i).select(query_id, vector).collect()]
        met = reach(np.array([list(v) for _, v in part], np.float64)) if reach and part else None
        found = knn(vectors, part, k, metric, id_, vector, met)
        made = found if made is None else made.unionByName(found)
    return made


def rerank(candidates: DataFrame, vectors: DataFrame, queries: Sequence[tuple[int, Sequence[float]]] | DataFrame, k: int, metric: str, id_: str = "_pos", vector: str = "embedding") -> DataFrame:
    """Candidates (query_id, id) measured exactly by column expressions, the k best of each query. Queries may be a
    table (query_id, vector) of any size."""
    spark = vectors.sparkSession
    if isinstance(queries, DataFrame):
        asked = queries.select("query_id", F.col(vector).cast("array<double>").alias("_query"))
    else:
        asked = F.broadcast(spark.createDataFrame([(int(q), [float(x) for x in v]) for q, v in queries], "query_id long, _query array<double>"))
    met = candidates.select("query_id", id_).join(asked, "query_id").join(vectors.select(id_, F.col(vector).alias("_v")), id_)
    return _ranked(met.select("query_id", id_, measure(metric, F.col("_v"), F.col("_query")).alias("distance")), k, metric, id_)


def distance_column(metric: str, vector: Column, query: Sequence[float]) -> Column:
    """The distance to one query as an expression, for use in any plan."""
    return measure(metric, vector, F.array(*(F.lit(float(x)) for x in query)))
