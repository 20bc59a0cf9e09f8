"""Approximate nearest neighbours (operator 6): a forest of random-projection trees, one shared queue, exact reranking.

*Forest.* `TREES` trees split rows at the medians of random directions, one direction a level, orthogonal to those above
it. The first levels are common to all trees: they cut the table into *blocks* of about `BLOCK` bytes of vectors, so that
a row lies in one place however many trees there are. Below them each tree goes on by itself, down to leaves of about
`LEAF` rows: the depth follows from the number of rows. The common levels are fitted on a sample bounded by `SAMPLE`
bytes, those below on all rows of their block, in the block's task, from projections alone. For the largest inner product
vectors get a further coordinate, sqrt(largest norm^2 - norm^2), and queries a 0: inner product and distance then agree.

*Index.* A table of every row's id, vector, block and leaf in each tree, written once.

*Search.* A query's queue holds nodes of the common levels and, once their block is reached, the leaves of all trees,
least summed squared margin first; leaves come out until they hold the number of rows that a query may examine. That
number is measured, not set: for `QUERIES` rows of the sample the k true neighbours among *all* rows are found by brute
force (one pass), and it is the smallest that reaches `RECALL` of them. Queries and rows meet block by block, a batch of
similar queries at a time; only rows of asked leaves are multiplied, and the best are recomputed in double precision
(ties by smaller id). Clustered vectors need a small part of their rows; vectors without structure need most of them.

The broadcast forest has at most `BLOCKS` blocks, whatever the table; beyond that blocks grow and are split by a hash,
as is a block of many equal vectors.

Vectors that are null or zero, or hold null or non-finite components, take no part; rows with a null id neither. Vectors
of fewer components than the longest count as filled up with zeros. Rows of one id are one candidate, by its best score,
and never a neighbour of a query of that id; equal rows are one. Fewer than k candidates: all. Empty tables give empty
ones. Other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from versalake.llm.common import discard, partitions, short_batches, trim, written

TREES, LEAF, RECALL, QUERIES, SEED = 4, 32, 0.95, 96, 11
#: Bytes of a block's vectors in double precision, of the sample, and the most blocks.
BLOCK, SAMPLE, BLOCKS = 1 << 22, 1 << 26, 1 << 13
#: Queries that meet one copy of a block.
ASKED = 8192
#: Queries that are multiplied with the rows of their leaves at a time.
BATCH = 64


def exact(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products in double precision; each depends on its two vectors alone."""
    return (rows * query).sum(axis=1)


def best(queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, own: np.ndarray, k: int, allowed: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query the ids and scores of its k best ids, each by its best row."""
    once, group = np.unique(ids, return_inverse=True)
    by_id = np.argsort(group, kind="stable")
    heads = np.searchsorted(group[by_id], np.arange(len(once)))
    for at in range(0, len(queries), 256):
        part = queries[at : at + 256]
        scores = part @ rows.T
        scores[own[at : at + 256, None] == ids[None, :]] = -np.inf
        if allowed is not None:
            scores[~allowed[at : at + 256]] = -np.inf
        for q, s in zip(part, scores):
            if len(once) > k:
                # The product's rounding depends on the block's shape; all that may be among the k best are recomputed.
                tops = s if len(once) == len(s) else np.maximum.reduceat(s[by_id], heads)
                edge = np.partition(tops, len(tops) - k)[len(tops) - k]
                pick = np.flatnonzero(s >= edge - 1e-9 * max(1.0, abs(edge))) if np.isfinite(edge) else np.flatnonzero(np.isfinite(s))
            else:
                pick = np.flatnonzero(np.isfinite(s))
            score = exact(q, rows[pick])
            order = np.lexsort((ids[pick], -score))
            if len(once) < len(s):
                order = order[np.sort(np.unique(ids[pick[order]], return_index=True)[1])]
            yield ids[pick[order[:k]]], score[order[:k]]


# -- the forest ----------------------------------------------------------------------------------------------


@dataclass
class Forest:
    top: np.ndarray  # common levels x (dimension + 1): their directions
    top_cuts: np.ndarray  # 2 ** levels - 1
    ways: np.ndarray  # trees x depth x (dimension + 1): directions below
    norm: float
    cuts: np.ndarray = field(default_factory=lambda: np.zeros(0))  # blocks x trees x (2 ** depth - 1)
    counts: np.ndarray = field(default_factory=lambda: np.zeros(0))  # blocks x trees x 2 ** depth: rows
    examine: float = float("inf")

    @property
    def depth(self) -> int:
        return self.ways.shape[1]

    def lifted(self, vectors: np.ndarray) -> np.ndarray:
        rest = np.maximum(self.norm**2 - (vectors * vectors).sum(axis=1), 0.0)
        return np.column_stack([vectors, np.sqrt(rest)])

    def blocks(self, rows: np.ndarray) -> np.ndarray:
        """The block of each lifted row."""
        shades = projected(rows, self.top)
        node = np.zeros(len(rows), np.int64)
        for level in range(len(self.top)):
            node = 2 * node + 1 + (shades[:, level] > self.top_cuts[node])
        return node - len(self.top_cuts)

    def shades(self, rows: np.ndarray) -> np.ndarray:
        """rows x trees x depth: projections on the directions below the common levels, in single precision."""
        flat = projected(rows, self.ways.reshape(-1, self.ways.shape[2]))
        return flat.astype(np.float32).reshape(len(rows), len(self.ways), self.depth)

    def leaf_costs(self, block: int, cost: float, shade: np.ndarray) -> np.ndarray:
        """trees x leaves: the summed squared margins from a query to each leaf of a block."""
        costs = np.full((len(self.ways), 1), cost)
        for depth in range(self.depth):
            margin = shade[:, depth, None] - self.cuts[block][:, 2**depth - 1 : 2 ** (depth + 1) - 1]
            below = np.empty((len(costs), 2 * costs.shape[1]))
            np.add(costs, np.square(np.maximum(margin, 0)), out=below[:, 0::2])
            np.add(costs, np.square(np.minimum(margin, 0)), out=below[:, 1::2])
            costs = below
        return costs

    def order(self, query: np.ndarray) -> Iterator[np.ndarray]:
        """(block, tree, leaf) that hold rows, in the order of the shared queue, some at a time."""
        lifted = np.concatenate([query, [0.0]])[None, :]
        top = projected(lifted, self.top)[0].tolist()
        shade = self.shades(lifted)[0].astype(np.float64)
        first = len(self.top_cuts)
        queue: list[tuple] = [(0.0, 0, 0)]
        costs, places = np.empty(0), np.empty((0, 3), np.int64)
        while queue:
            cost, level, node = heapq.heappop(queue)
            if node < first:
                margin = top[level] - self.top_cuts[node]
                near = 2 * node + 1 + (margin > 0)
                heapq.heappush(queue, (cost, level + 1, near))
                heapq.heappush(queue, (cost + margin * margin, level + 1, 4 * node + 3 - near))
                continue
            # The block's leaves enter the queue; those that no node in it can come before are in their final order.
            held = np.nonzero(self.counts[node - first])
            mine = np.column_stack([np.full(len(held[0]), node - first), *held])
            costs, places = np.concatenate([costs, self.leaf_costs(node - first, cost, shade)[held]]), np.concatenate([places, mine])
            out = costs <= queue[0][0] if queue else np.ones(len(costs), bool)
            ready, known = places[out], costs[out]
            costs, places = costs[~out], places[~out]
            if len(ready):
                yield ready[np.lexsort((ready[:, 2], ready[:, 1], ready[:, 0], known))]

    def search(self, query: np.ndarray) -> dict[int, np.ndarray]:
        """For each block that the query asks: trees x leaves, true for those that it examines."""
        asked: dict[int, np.ndarray] = {}
        held = 0
        for places in self.order(query):
            sums = held + np.cumsum(self.counts[tuple(places.T)])
            places = places[: np.searchsorted(sums, self.examine) + 1]
            for block in np.unique(places[:, 0]).tolist():
                mine = places[places[:, 0] == block]
                reach = asked.setdefault(block, np.zeros((len(self.ways), 2**self.depth), bool))
                reach[mine[:, 1], mine[:, 2]] = True
            held = int(sums[-1])
            if held >= self.examine:
                break
        return asked


def projected(rows: np.ndarray, ways: np.ndarray) -> np.ndarray:
    """rows x directions. Rows one by one give the same as together: a matrix product need not."""
    out = np.empty((len(rows), len(ways)))
    for i, way in enumerate(ways):
        out[:, i] = (rows * way).sum(axis=1)
    return out


def directions(number: int, dim: int, rng: np.random.Generator, above: np.ndarray) -> np.ndarray:
    """Random unit vectors, each orthogonal to those `above` and before it as far as the dimension allows."""
    out = [*above]
    while len(out) < len(above) + number:
        way = rng.normal(size=dim)
        for other in out[-(dim - 1) :] if dim > 1 else []:
            way = way - (way @ other) * other
        size = np.linalg.norm(way)
        out.append(way / size if size > 1e-9 else np.eye(dim)[len(out) % dim])
    return np.array(out[len(above) :]).reshape(number, dim)


def plant(sample: np.ndarray, rows: int, norm: float, trees: int | None = None) -> Forest:
    """A forest without its lower cuts, for a table of `rows` rows; `sample`: some of them."""
    trees = trees or TREES
    rng, dim = np.random.default_rng(SEED), sample.shape[1] + 1
    block = max(1, BLOCK // (8 * sample.shape[1]))
    levels = int(np.ceil(np.log2(max(1.0, rows / block))))
    levels = max(0, min(levels, int(np.log2(BLOCKS)), int(np.log2(max(1, len(sample) / 8)))))
    depth = max(0, int(np.log2(max(1.0, min(rows / 2**levels, block) / LEAF))))
    top = directions(levels, dim, rng, np.zeros((0, dim)))
    forest = Forest(top, np.zeros(2**levels - 1), np.stack([directions(depth, dim, rng, top) for _ in range(trees)]), norm)
    shades = projected(forest.lifted(sample), top)
    node = np.zeros(len(sample), np.int64)
    for level in range(levels):
        for n in range(2**level - 1, 2 ** (level + 1) - 1):
            mine = np.flatnonzero(node == n)
            if len(mine):
                forest.top_cuts[n] = np.median(shades[mine, level])
        node = 2 * node + 1 + (shades[:, level] > forest.top_cuts[node])
    return forest


def split(shades: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From the projections of a block's rows: cuts, leaf of each row, rows of each leaf, by tree."""
    rows, trees, depth = shades.shape
    cuts, leaves = np.zeros((trees, 2**depth - 1), np.float32), np.zeros((rows, trees), np.int64)
    for t in range(trees):
        node = np.zeros(rows, np.int64)
        for level in range(depth):
            order = np.lexsort((shades[:, t, level], node))
            first = 2**level - 1
            edges = np.searchsorted(node[order], first + np.arange(2**level + 1))
            size = np.diff(edges)
            middle = order[np.minimum(edges[:-1] + np.maximum(size - 1, 0) // 2, rows - 1)]
            cuts[t, first : first + 2**level] = np.where(size > 0, shades[middle, t, level], 0)
            node = 2 * node + 1 + (shades[:, t, level] > cuts[t, node])
        leaves[:, t] = node - (2**depth - 1)
    counts = np.stack([np.bincount(leaves[:, t], minlength=2**depth) for t in range(trees)])
    return cuts, leaves, counts


def descend(cuts: np.ndarray, shades: np.ndarray) -> np.ndarray:
    """rows x trees: leaves of rows by the cuts (trees x nodes) of their block."""
    rows, trees, depth = shades.shape
    out = np.zeros((rows, trees), np.int64)
    for t in range(trees):
        node = np.zeros(rows, np.int64)
        for level in range(depth):
            node = 2 * node + 1 + (shades[:, t, level] > cuts[t, node])
        out[:, t] = node - (2**depth - 1)
    return out


def calibrate(forest: Forest, queries: np.ndarray, found: list[tuple[int, np.ndarray, np.ndarray]], k: int, target: float) -> float:
    """How many rows a query has to examine to meet `target` of the true neighbours. found: the number of a query, and the
    blocks and leaves (neighbours x trees) of its true neighbours."""
    needs: list[float] = []
    for q, blocks, leaves in found:
        key = (blocks[:, None] * len(forest.ways) + np.arange(len(forest.ways))) * 2**forest.depth + leaves
        held, need = 0, np.full(len(blocks), np.inf)
        for places in forest.order(queries[q]):
            sums = held + np.cumsum(forest.counts[tuple(places.T)])
            met = (places[:, 0] * len(forest.ways) + places[:, 1]) * 2**forest.depth + places[:, 2]
            by = np.argsort(met)
            at = np.minimum(np.searchsorted(met[by], key), len(met) - 1)
            need = np.minimum(need, np.where(met[by][at] == key, sums[by][at], np.inf).min(axis=1))
            held = int(sums[-1])
            if np.isfinite(need).all():
                break
        needs += need.tolist()
    least = (k + 1) * len(forest.ways)  # a row comes out once a tree at most: so many hold k others
    return max(least, float(np.quantile(needs, target, method="higher"))) if needs else float(least)


def meet(forest_leaves: int, queries: np.ndarray, own: np.ndarray, reach: np.ndarray, ids: np.ndarray, rows: np.ndarray, leaves: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, ids, scores) of the k best rows in the leaves that each query asks. reach: queries x trees x leaves."""
    flat = reach.reshape(len(queries), -1)
    at = leaves + np.arange(leaves.shape[1]) * forest_leaves
    # Queries that ask the same leaves come one after another, so a batch meets few rows beside those it asks.
    order = np.lexsort(np.packbits(flat, axis=1).T[::-1]) if len(queries) > BATCH else np.arange(len(queries))
    for start in range(0, len(order), BATCH):
        some = order[start : start + BATCH]
        any_ = flat[some].any(axis=0)
        spots = np.flatnonzero(any_[at].any(axis=1))
        allowed = flat[some][:, at[spots, 0]]
        for t in range(1, at.shape[1]):
            allowed |= flat[some][:, at[spots, t]]
        for q, (i, s) in zip(some.tolist(), best(queries[some], ids[spots], rows[spots], own[some], k, allowed)):
            yield q, i, s


# -- tables --------------------------------------------------------------------------------------------------


def prepare(vectors: DataFrame, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, v, n2, size): the rows that take part; v is the vector's bytes, in the precision that it came in."""
    short_batches(vectors.sparkSession)
    kind = vectors.schema[vector].dataType.elementType
    single = isinstance(kind, T.FloatType)
    rows = vectors.where(F.col(id_).isNotNull() & F.col(vector).isNotNull()).select(F.col(id_).cast("long").alias("id"), F.col(vector).cast("array<float>" if single else "array<double>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten()
            holes = np.asarray(flat.is_null()) if flat.null_count else np.zeros(len(flat), bool)
            x = np.ascontiguousarray(flat.to_numpy(zero_copy_only=False), np.float32 if single else np.float64)
            size = np.asarray(lists.value_lengths(), np.int64)
            ends = np.concatenate([[0], np.cumsum(size)])
            bad = np.concatenate([[0], np.cumsum(holes | ~np.isfinite(x))])
            squares = np.where(np.isfinite(x), x, 0).astype(np.float64) ** 2
            some = np.flatnonzero(size > 0)
            n2 = np.zeros(len(size))
            if len(some):
                n2[some] = np.add.reduceat(squares, ends[:-1][some])
            fine = (np.diff(bad[ends]) == 0) & (n2 > 0)
            width = x.itemsize
            held = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer((ends * width).astype(np.int64)), pa.py_buffer(x)])
            out = pa.RecordBatch.from_arrays([batch.column(0), held.cast(pa.binary()), pa.array(n2), pa.array(size.astype(np.int32))], ["id", "v", "n2", "size"])
            yield out.filter(pa.array(fine))

    return rows.mapInArrow(run, "id long, v binary, n2 double, size int")


def matrix(column, dim: int, single: bool) -> np.ndarray:
    """Vectors from their bytes, in double precision, filled up with zeros to `dim` components."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, dim))
    _, offsets, data = column.buffers()
    wide = pa.types.is_large_binary(column.type)
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(np.float32 if single else np.float64)
    size = np.diff(ends) // flat.itemsize
    if (size == dim).all():
        return flat.reshape(-1, dim).astype(np.float64)
    out = np.zeros((len(column), dim))
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def brute(index: DataFrame, queries: np.ndarray, own: np.ndarray, k: int, dim: int, single: bool) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Blocks and leaves of each query's true k nearest ids among all rows. Each task gives its own k best a query."""
    shared = index.sparkSession.sparkContext.broadcast((queries, own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask, mine = shared.value
        top: list[dict[int, tuple]] = [{} for _ in ask]
        for batch in batches:
            ids, x = np.asarray(batch.column(0)), matrix(batch.column(1), dim, single)
            for q, (i, s) in enumerate(best(ask, ids, x, mine, k)):
                held, least = top[q], min((e[0] for e in top[q].values()), default=-np.inf)
                for j, score in zip(i.tolist(), s.tolist()):
                    if (len(held) < k or score >= least) and (j not in held or held[j][0] < score):
                        at = np.flatnonzero(ids == j)
                        at = int(at[np.argmax(exact(ask[q], x[at]))])
                        held[j] = (score, j, batch.column(2)[at].as_py(), batch.column(3)[at].as_py())
                top[q] = {e[1]: e for e in sorted(held.values(), key=lambda e: (-e[0], e[1]))[:k]}
        flat = [(q, *e) for q, t in enumerate(top) for e in t.values()]
        columns = list(zip(*flat)) if flat else [[]] * 5
        kinds = (pa.int32(), pa.float64(), pa.int64(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], ["q", "score", "id", "block", "leaves"])

    each = index.select("id", "v", "block", "leaves").mapInArrow(run, "q int, score double, id long, block int, leaves binary")
    once = each.groupBy("q", "id").agg(F.max(F.struct("score", "block", "leaves")).alias("e"))
    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("e.score"), "id"))
    # At most QUERIES x k rows come to the driver.
    out: dict[int, list] = {}
    for r in once.withColumn("nth", nth).where(F.col("nth") <= k).select("q", "e.block", "e.leaves").collect():
        out.setdefault(r.q, []).append((r.block, np.frombuffer(r.leaves, np.int16)))
    return [(q, np.array([b for b, _ in near]), np.stack([x for _, x in near]).astype(np.int64)) for q, near in sorted(out.items())]


def grow(rows: DataFrame, n: int, dim: int, single: bool, norm: float, k: int, recall: float) -> tuple[Forest, DataFrame]:
    """The forest of a table (id, v), and its index (id, v, block, leaves)."""
    spark = rows.sparkSession
    luck = F.pmod(F.xxhash64(F.lit("forest"), "id", "v"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.where(luck < SAMPLE / (8 * dim) / n).select("id", "v").toArrow().sort_by([("id", "ascending"), ("v", "ascending")])
    points, ids = matrix(sample.column("v"), dim, single), np.asarray(sample.column("id"))
    forest = plant(points if len(points) else np.zeros((1, dim)), n, norm)
    shared = spark.sparkContext.broadcast(forest)
    rows = rows.select("id", "v")

    def shade(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lifted = shared.value.lifted(matrix(batch.column(1), dim, single))
            said = shared.value.shades(lifted).reshape(len(lifted), -1)
            held = pa.array([r.tobytes() for r in said], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(shared.value.blocks(lifted).astype(np.int32)), held], ["block", "shades"])

    def cut(group: pa.Table) -> pa.Table:
        trees, depth = shared.value.ways.shape[:2]
        raw = group.column("shades").to_pylist()
        cuts, _, counts = split(np.frombuffer(b"".join(raw), np.float32).reshape(len(raw), trees, depth))
        return pa.table([group.column("block").slice(0, 1), pa.array([cuts.tobytes()]), pa.array([counts.astype(np.int64).tobytes()])], ["block", "cuts", "counts"])

    trees, depth, blocks = len(forest.ways), forest.depth, 2 ** len(forest.top)
    # A block may grow beyond its size: then a hash picks the rows that set its cuts, and counts are made afterwards.
    most = 16 * max(1, BLOCK // (8 * dim))
    some = F.pmod(F.xxhash64(F.lit("cuts"), "id", "v"), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, most * blocks / n)))
    got = rows.where(some).mapInArrow(shade, "block int, shades binary").groupBy("block").applyInArrow(cut, "block int, cuts binary, counts binary").collect()
    forest.cuts = np.zeros((blocks, trees, 2**depth - 1), np.float32)
    for r in got:
        forest.cuts[r.block] = np.frombuffer(r.cuts, np.float32).reshape(trees, -1)
    planted = spark.sparkContext.broadcast(forest)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trees = planted.value
            lifted = trees.lifted(matrix(batch.column(1), dim, single))
            block, shades = trees.blocks(lifted), trees.shades(lifted)
            leaves = np.zeros((len(block), len(trees.ways)), np.int16)
            for b in np.unique(block).tolist():
                mine = np.flatnonzero(block == b)
                leaves[mine] = descend(trees.cuts[b], shades[mine])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(block.astype(np.int32)), pa.array([r.tobytes() for r in leaves], pa.binary())], ["id", "v", "block", "leaves"])

    index = written(rows.mapInArrow(place, "id long, v binary, block int, leaves binary"), "ann-index")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            block = np.asarray(batch.column(0))
            leaves = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int16).reshape(len(block), trees).astype(np.int64)
            for b in np.unique(block).tolist():
                into = held.setdefault(b, np.zeros((trees, 2**depth), np.int64))
                for t in range(trees):
                    into[t] += np.bincount(leaves[block == b, t], minlength=2**depth)
        flat = [(b, t, leaf, int(x[t, leaf])) for b, x in held.items() for t, leaf in zip(*np.nonzero(x))]
        columns = list(zip(*flat)) if flat else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64()))], ["block", "tree", "leaf", "n"])

    if n > most * blocks:
        forest.counts = np.zeros((blocks, trees, 2**depth), np.int64)
        counted = index.select("block", "leaves").mapInArrow(tally, "block int, tree int, leaf int, n long").groupBy("block", "tree", "leaf").agg(F.sum("n").alias("n"))
        for r in counted.collect():  # at most BLOCKS x TREES x 2 ** depth, as the forest that is broadcast
            forest.counts[r.block, r.tree, r.leaf] = r.n
    else:
        forest.counts = np.zeros((blocks, trees, 2**depth), np.int64)
        for r in got:
            forest.counts[r.block] = np.frombuffer(r.counts, np.int64).reshape(trees, -1)
    picked = np.unique(np.linspace(0, len(points) - 1, min(len(points), QUERIES)).astype(np.int64)) if len(points) else np.zeros(0, np.int64)
    if len(picked):
        forest.examine = calibrate(forest, points[picked], brute(index, points[picked], ids[picked], k, dim, single), k, recall)
    return forest, index


def neighbours(vectors: DataFrame, is_query: Column, k: int = 20, id_: str = "vec_id", vector: str = "embedding", recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row that `is_query` (a condition on `id`)."""
    spark = vectors.sparkSession
    out = f"query_id long, rank int, {id_} long, score double"
    single = isinstance(vectors.schema[vector].dataType.elementType, T.FloatType)
    rows = first = written(prepare(vectors, id_, vector), "ann-rows")
    totals = [F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"), F.max("n2").alias("n2"), F.max("size").alias("dim")]
    stat = rows.agg(*totals).first()
    if not stat.n:
        return spark.createDataFrame([], out)
    repeated = stat.ids < stat.n
    if repeated:
        rows = written(rows.dropDuplicates(["id", "v"]), "ann-rows")
        stat = rows.agg(*totals).first()
    forest, index = grow(rows, stat.n, stat.dim, single, float(np.sqrt(stat.n2)), k, recall)
    discard(first, rows)  # the index holds all of it
    found = search(forest, index, index.where(is_query).select("id", "v"), k, stat.dim, single)
    if repeated:
        # An id with many rows may fill all that a query examines: queries with too few ids examine everything.
        found = written(found, "ann-found")
        few = found.groupBy("query_id").count().where(F.col("count") >= min(k, stat.ids - 1)).select(F.col("query_id").alias("id"))
        short = written(index.where(is_query).select("id", "v").join(few, "id", "left_anti"), "ann-short")
        if not short.isEmpty():
            everything = Forest(forest.top, forest.top_cuts, forest.ways, forest.norm, forest.cuts, forest.counts)
            again = search(everything, index, short, k, stat.dim, single)
            found = found.join(short.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(again)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_), "score")


def search(forest: Forest, index: DataFrame, queries: DataFrame, k: int, dim: int, single: bool) -> DataFrame:
    """(query_id, id, score): each query's k best of every block that it asks, once an id."""
    spark = index.sparkSession
    shared = spark.sparkContext.broadcast(forest)
    block_rows = max(1, BLOCK // (8 * dim))
    parts = np.maximum(1, -(-forest.counts[:, 0].sum(axis=1) // (2 * block_rows))).astype(np.int64)
    split_by = spark.sparkContext.broadcast(parts)
    trees, leaves = len(forest.ways), 2**forest.depth

    def seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source, where, part, reach = [], [], [], []
            for i, q in enumerate(matrix(batch.column(1), dim, single)):
                for block, asked in shared.value.search(q).items():
                    bits = np.packbits(asked).tobytes()
                    for p in range(int(split_by.value[block])):
                        source.append(i)
                        where.append(block)
                        part.append(p)
                        reach.append(bits)
            take = pa.array(source, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(where, pa.int32()), pa.array(part, pa.int32()), pa.array(reach, pa.binary())], ["id", "v", "block", "part", "tag"])

    asked = written(queries.mapInArrow(seek, "id long, v binary, block int, part int, tag binary"), "ann-queries")
    # A block that more than ASKED queries ask is there in several copies; other blocks aren't moved at all.
    load = asked.groupBy("block", "part").agg(F.ceil(F.count(F.lit(1)) / ASKED).cast("int").alias("groups"))
    asked = asked.join(load, ["block", "part"]).select("block", "part", F.pmod(F.xxhash64(F.lit("group"), "id", "v"), F.col("groups")).cast("int").alias("group"), F.lit(True).alias("asks"), "id", "v", "tag")
    table = spark.createDataFrame(pa.table({"block": np.arange(len(parts), dtype=np.int32), "parts": parts.astype(np.int32)}), "block int, parts int")
    placed = index.join(F.broadcast(table), "block").withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "id", "v"), F.col("parts")).cast("int"))
    # One row a part of a block: at most BLOCKS and the parts of those that grew, rows / (2 x block rows).
    placed = placed.join(load, ["block", "part"]).select("block", "part", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"), F.lit(False).alias("asks"), "id", "v", F.col("leaves").alias("tag"))

    def join(group: pa.Table) -> pa.Table:
        side = np.asarray(group.column("asks").combine_chunks().to_numpy(zero_copy_only=False), bool)
        ask, have = group.filter(pa.array(side)), group.filter(pa.array(~side))
        names = ["query_id", "id", "score"]
        if not ask.num_rows or not have.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names)
        bits = np.frombuffer(b"".join(ask.column("tag").to_pylist()), np.uint8).reshape(ask.num_rows, -1)
        reach = np.unpackbits(bits, axis=1, count=trees * leaves).astype(bool).reshape(-1, trees, leaves)
        tags = np.frombuffer(b"".join(have.column("tag").to_pylist()), np.int16).reshape(have.num_rows, trees).astype(np.int64)
        own = np.asarray(ask.column("id"))
        found = list(meet(leaves, matrix(ask.column("v"), dim, single), own, reach, np.asarray(have.column("id")), matrix(have.column("v"), dim, single), tags, k))
        trim()
        sizes = [len(i) for _, i, _ in found]
        return pa.table([pa.array(np.repeat(own[[q for q, _, _ in found]], sizes)), pa.array(np.concatenate([i for _, i, _ in found])), pa.array(np.concatenate([s for _, _, s in found]))], names)

    met = asked.unionByName(placed).groupBy("block", "part", "group").applyInArrow(join, "query_id long, id long, score double")
    # One shuffle by query serves both the removal of repetitions and the ranking.
    return met.repartition(partitions(spark), "query_id").groupBy("query_id", "id").agg(F.max("score").alias("score"))
