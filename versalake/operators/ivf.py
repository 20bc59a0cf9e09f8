"""Inverted-file vector index: k-means cells, searched cell by cell, exact inside a cell.

Rows are written by cell, so a search reads the folders of the cells that it probes and no others. The flat kind has
one cell. Graph indexes have no counterpart in a partitioned engine; their names map to an inverted file with more
probes, which is what their callers ask for: more recall.

How many cells a search probes is measured when the index is built, unless its maker says it: a sample is searched
against brute force, and the fewest cells that reach `RECALL` there are taken, for each of the depths `DEPTHS`. A
search for more neighbours than the largest depth probes all cells. In a sample neighbours are farther away than in
the table, so the table's recall isn't less, as far as both are alike.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versalake.errors import IndexExists, IndexMissing
from versalake.functions.vectors import METRICS
from versalake.operators import knn
from versalake.session import ship
from versalake.store.files import Files

KINDS = {"FLAT": {}, "IVFPQ": {"nlist": 128}, "IVFFLAT": {"nlist": 128}, "HNSWFLAT": {"nlist": 128}, "DISKANN": {"nlist": 128}}
#: Cells that are probed at least, where the number is measured.
LEAST = {"IVFPQ": 8, "IVFFLAT": 8, "HNSWFLAT": 16, "DISKANN": 16}
#: Vectors that the cells are fitted on, at most about.
SAMPLE = 100_000
#: The recall that the probed cells reach on a sample of about MEASURED vectors, over ASKED of them as queries.
RECALL, DEPTHS, MEASURED, ASKED = 0.95, (10, 100), 1 << 14, 256


@dataclass
class IndexMeta:
    name: str
    column: str
    kind: str = "FLAT"
    metric: str = "l2"
    id_: str = "_pos"
    params: dict = field(default_factory=dict)
    centres: list = field(default_factory=list)
    commit: str | None = None
    parts: list[str] = field(default_factory=list)
    probes: dict = field(default_factory=dict)  # depth: cells to probe, as measured


class VectorIndex:
    """An index under a folder; `load` caches it, `unload` lets go."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path, Files(spark)
        self.meta: IndexMeta | None = None
        self.cached: DataFrame | None = None

    @classmethod
    def create(cls, vectors: DataFrame, path: str, name: str, column: str, kind: str = "FLAT", metric: str = "l2", id_: str = "_pos", overwrite: bool = False, commit: str | None = None, **params) -> VectorIndex:
        if kind not in KINDS:
            raise ValueError(f"no kind of index: {kind!r}")
        if metric not in METRICS:
            raise ValueError(f"no metric: {metric!r}")
        index = cls(vectors.sparkSession, path)
        if index.files.exists(f"{path}/meta.json"):
            if not overwrite:
                raise IndexExists(name)
            index.files.delete(path)
        index.meta = IndexMeta(name, column, kind, metric, id_, KINDS[kind] | params, commit=commit)
        index.meta.centres = index._fit(vectors) if kind != "FLAT" else []
        if index.meta.centres and "nprobe" not in params:
            index.meta.probes = index._measure(vectors)
        index.add(vectors)
        return index

    def _fit(self, vectors: DataFrame) -> list[list[float]]:
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        rows = vectors.where(F.col(self.meta.column).isNotNull()).select(F.col(self.meta.column).cast("array<double>").alias("v"))
        total = rows.count()
        if not total:
            return []
        if total > SAMPLE:
            rows = rows.where(F.pmod(F.xxhash64("v"), F.lit(1 << 20)) < int((1 << 20) * SAMPLE / total))
        cells = int(min(self.meta.params["nlist"], max(1, total // 8)))
        model = KMeans(k=max(2, cells), seed=17, maxIter=10).fit(rows.select(array_to_vector(self._unit("v")).alias("features")))
        return [c.tolist() for c in model.clusterCenters()]

    def _measure(self, vectors: DataFrame) -> dict[str, int]:
        """The cells to probe for each depth."""
        metric, column = self.meta.metric, self.meta.column
        rows = vectors.where(F.col(column).isNotNull()).select(F.col(column).cast("array<double>").alias("v"))
        total = rows.count()
        if total > MEASURED:
            rows = rows.where(F.pmod(F.xxhash64("v"), F.lit(1 << 20)) < int((1 << 20) * MEASURED / total))
        # The limit holds where one vector is repeated very often.
        sample = knn.matrix(rows.limit(2 * MEASURED).toArrow().column("v").combine_chunks())
        directions = self._directions(sample)
        cell = knn.distances(directions, np.array(self.meta.centres), "l2").argmin(axis=1)
        picked = np.arange(len(sample))[:: max(1, len(sample) // ASKED)]
        place = np.argsort(self._order(sample[picked]), axis=1)  # of each cell among those of the query
        ranks: dict[int, list[np.ndarray]] = {k: [] for k in DEPTHS}
        for at in range(0, len(picked), 32):
            near = knn.distances(sample[picked[at : at + 32]], sample, metric)
            for i, row in enumerate(near if metric == "l2" else -near):
                row[picked[at + i]] = np.inf
                order = np.argsort(np.where(np.isnan(row), np.inf, row), kind="stable")[: int(np.isfinite(row).sum())]
                for k in DEPTHS:
                    ranks[k].append(place[at + i][cell[order[:k]]])
        found = {}
        for k in DEPTHS:
            seen = np.concatenate(ranks[k]) if ranks[k] else np.empty(0, np.int64)
            share = np.cumsum(np.bincount(seen, minlength=len(self.meta.centres))) / max(1, len(seen))
            enough = int(np.argmax(share >= RECALL)) + 1 if len(seen) else len(self.meta.centres)
            found[str(k)] = max(enough, LEAST[self.meta.kind])
        return found

    def _directions(self, vectors: np.ndarray) -> np.ndarray:
        """`_unit` of a matrix."""
        if self.meta.metric != "cosine":
            return vectors
        return vectors / np.maximum(np.sqrt((vectors * vectors).sum(1)), 1e-300)[:, None]

    def _order(self, queries: np.ndarray) -> np.ndarray:
        """For each query all cells, the one to probe first at the front."""
        metric = "l2" if self.meta.metric == "l2" else "inner_product"
        near = knn.distances(self._directions(queries), np.array(self.meta.centres), metric)
        return np.argsort(near if metric == "l2" else -near, axis=1, kind="stable")

    def _probes(self, k: int, nprobe: int | None) -> int:
        """The cells to probe for k neighbours."""
        meta = self.meta
        cells = len(meta.centres)
        if nprobe or "nprobe" in meta.params:
            return min(nprobe or meta.params["nprobe"], cells)
        return min([cells, *(p for d, p in meta.probes.items() if int(d) >= k)])

    def _unit(self, name: str):
        """Cosine cells are cells of directions."""
        column = F.col(name).cast("array<double>")
        if self.meta.metric != "cosine":
            return column
        size = F.sqrt(F.aggregate(column, F.lit(0.0), lambda s, x: s + x * x))
        return F.when(size > 0, F.transform(column, lambda x: x / size)).otherwise(column)

    def _cell(self, vectors: DataFrame) -> DataFrame:
        if not self.meta.centres:
            return vectors.withColumn("_cell", F.lit(0))
        ship(self.spark)
        centres, column = np.array(self.meta.centres), self.meta.column

        @F.pandas_udf("int")
        def nearest(rows: pd.Series) -> pd.Series:
            x = np.stack(rows.to_numpy()).astype(np.float64)
            return pd.Series(knn.distances(x, centres, "l2").argmin(axis=1))

        return vectors.where(F.col(column).isNotNull()).withColumn("_cell", nearest(self._unit(column)))

    def add(self, vectors: DataFrame, commit: str | None = None) -> None:
        """Adds rows (id, vector) to the cells; the cells stay as they are."""
        part = f"{self.path}/part-{len(self.meta.parts):05d}"
        rows = self._cell(vectors.select(self.meta.id_, self.meta.column))
        # A large cell is written by several tasks.
        rows.repartition("_cell", F.pmod(F.xxhash64(self.meta.id_), F.lit(8))).write.partitionBy("_cell").parquet(part)
        self.meta.parts.append(part)
        self.meta.commit = commit or self.meta.commit
        self.files.write(f"{self.path}/meta.json", json.dumps(asdict(self.meta)))
        if self.cached is not None:
            self.unload()
            self.load()

    def load(self, cache: bool = True) -> VectorIndex:
        if not self.files.exists(f"{self.path}/meta.json"):
            raise IndexMissing(self.path)
        self.meta = IndexMeta(**json.loads(self.files.read(f"{self.path}/meta.json")))
        parts = [self.spark.read.option("basePath", p).parquet(p) for p in self.meta.parts]
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        self.cached = rows.cache() if cache else rows
        return self

    def unload(self) -> None:
        if self.cached is not None:
            self.cached.unpersist()
        self.cached = None

    def drop(self) -> None:
        self.unload()
        self.files.delete(self.path)

    def search(self, queries: Sequence[tuple[int, Sequence[float]]], k: int, nprobe: int | None = None, refine_factor: int = 1, where=None) -> DataFrame:
        """(query_id, rank, id, distance); `where` keeps candidates before they compete. Each query probes its own
        nearest cells: a group of queries with the same cells is searched over those cells' folders."""
        if self.cached is None:
            raise IndexMissing(f"index {self.path} isn't loaded")
        rows = self.cached if where is None else self.cached.where(where)
        meta = self.meta
        if not meta.centres:
            return knn.knn(rows, queries, k, meta.metric, meta.id_, meta.column)
        cells = self._order(np.array([list(v) for _, v in queries], np.float64))[:, : self._probes(k, nprobe)]
        spark = self.spark
        wanted = spark.createDataFrame([(int(q), [float(x) for x in v], int(c)) for (q, v), mine in zip(queries, cells) for c in mine], "query_id long, _query array<double>, _cell int")
        used = sorted({int(c) for mine in cells for c in mine})
        met = rows.where(F.col("_cell").isin(used)).join(F.broadcast(wanted), "_cell")
        distance = knn.measure(meta.metric, F.col(meta.column), F.col("_query"))
        found = knn._ranked(met.select("query_id", meta.id_, distance.alias("distance")).where(F.col("distance").isNotNull()), k * max(1, refine_factor), meta.metric, meta.id_)
        return found if refine_factor <= 1 else knn.rerank(found, rows, queries, k, meta.metric, meta.id_, meta.column)

    def search_blocks(self, queries: DataFrame, k: int, nprobe: int | None = None, where=None, query_id: str = "query_id") -> DataFrame:
        """The same for a table of queries (query_id, vector) of any size, in blocks of queries."""
        if self.cached is None:
            raise IndexMissing(f"index {self.path} isn't loaded")
        rows, meta = self.cached if where is None else self.cached.where(where), self.meta

        def reach(asked: np.ndarray) -> np.ndarray:
            out = np.zeros((len(asked), len(meta.centres)), bool)
            np.put_along_axis(out, self._order(asked)[:, : self._probes(k, nprobe)], True, axis=1)
            return out

        return knn.knn_blocks(rows, queries, k, meta.metric, meta.id_, meta.column, query_id, reach=reach if meta.centres else None)
