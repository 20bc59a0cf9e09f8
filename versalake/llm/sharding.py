"""Sharding by Karmarkar-Karp differencing (operator 4).

Documents with equal texts are one indivisible group; its size is the sum of its documents' sizes. A partial
partition is a tuple of shard sums, a group alone being (size, 0, ..., 0). The two partial partitions of largest
spread are combined, the largest sum of one with the smallest of the other, until one is left.

Groups fall into blocks of about `GROUPS` by the hash of their text, as many as the table needs. Each block is differenced
in its own task, `CHUNK` groups at a time and then the chunks' partial partitions. The blocks' partial partitions are
combined the same way, beyond `TOP` of them first in tasks of about as many; the driver never sees more than `TOP`. All
of them are partial partitions, so the law stays the same on every level. Rows of a text that very many share stay where
they are (`common.join_hot`).

Null text has no bytes (size 1, crc32 0) and is a group of its own; repeated rows belong to their text's group; an
empty table gives an empty one. Other columns are ignored. One text that outweighs all others makes its shard larger:
groups are never split.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versalake.llm.common import join_hot, partitions, running_sum, short_batches, written

GROUPS, CHUNK, TOP = 1 << 14, 4096, 4096


def difference(parts: list[list[int]]) -> tuple[list[list[int]], list[int]]:
    """Combines partial partitions, each a list of k sums. Gives for each input part the final shard of each of its
    slots, and the final sums."""
    k = len(parts[0])
    nodes: list[tuple[list[int], tuple | None]] = []
    heap = []
    for i, sums in enumerate(parts):
        order = sorted(range(k), key=lambda s: (-sums[s], s))
        nodes.append(([sums[s] for s in order], (None, order)))
        heap.append((nodes[i][0][-1] - nodes[i][0][0], i))
    heapq.heapify(heap)
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        both = [x + y for x, y in zip(nodes[a][0], reversed(nodes[b][0]))]
        order = sorted(range(k), key=both.__getitem__, reverse=True)
        nodes.append(([both[s] for s in order], ((a, b), order)))
        sums = nodes[-1][0]
        heapq.heappush(heap, (sums[-1] - sums[0], len(nodes) - 1))
    where: list[list[int] | None] = [None] * len(nodes)
    where[-1] = list(range(k))
    for i in range(len(nodes) - 1, -1, -1):
        children, order = nodes[i][1]
        back = [0] * k  # where each slot, as it was before sorting, ends
        for position, s in enumerate(order):
            back[s] = where[i][position]
        if children is None:
            where[i] = back
        else:
            where[children[0]], where[children[1]] = back, back[::-1]
            where[i] = None
    return where[: len(parts)], nodes[-1][0]


def assign(sizes: list[int], k: int) -> list[int]:
    """The slot of each group of one block, a chunk at a time."""
    chunks, placed = [], []
    for at in range(0, len(sizes), CHUNK):
        part = sizes[at : at + CHUNK]
        slots, sums = difference([[s] + [0] * (k - 1) for s in part])
        chunks.append(sums)
        placed.append([w[0] for w in slots])
    if len(chunks) == 1:
        return placed[0]
    moved, _ = difference(chunks)
    return [m[s] for m, p in zip(moved, placed) for s in p]


def shard(docs: DataFrame, shards: int = 16, text: str = "text") -> DataFrame:
    """The place of every document: doc_id, size, text_crc32, law, shard, slot, grown_shard (null)."""
    spark = docs.sparkSession
    short_batches(spark)
    raw = F.col(text).cast("binary")
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(raw), F.lit(0)).cast("long").alias("text_crc32"),
        F.coalesce(F.unhex(F.sha2(raw, 256)), F.lit(b"").cast("binary")).alias("hash"),
    )
    rows = written(rows, "shard-rows")
    total, distinct = rows.agg(F.count(F.lit(1)), F.approx_count_distinct("hash")).first()
    blocks = max(1, -(-distinct // GROUPS))
    groups = rows.groupBy("hash").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).withColumn("block", F.pmod(F.xxhash64("hash"), F.lit(blocks)).cast("int"))
    groups = groups.repartition(partitions(spark), "block").sortWithinPartitions("block", "hash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def give():
            slots = assign([int(s) for p in sizes for s in p], shards)
            held = pa.chunked_array(hashes).combine_chunks()
            yield pa.RecordBatch.from_arrays([held, pa.array(np.full(len(slots), now, np.int32)), pa.array(slots, pa.int32()), pa.array(np.concatenate(sizes), pa.int64()), pa.array(np.concatenate(counts), pa.int64())], ["hash", "block", "slot", "size", "n"])

        now, hashes, sizes, counts = None, [], [], []
        for batch in batches:
            block = np.asarray(batch.column("block"))
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(block)]])
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if block[a] != now and hashes:
                    yield from give()
                    hashes, sizes, counts = [], [], []
                now = int(block[a])
                hashes.append(batch.column("hash").slice(a, b - a))
                sizes.append(np.asarray(batch.column("size"))[a:b])
                counts.append(np.asarray(batch.column("n"))[a:b])
        if hashes:
            yield from give()

    placed = written(groups.mapInArrow(run, "hash binary, block int, slot int, size long, n long"), "shard-groups")
    sums = placed.groupBy("block", "slot").agg(F.sum("size").alias("size"))
    if blocks <= TOP:
        # At most TOP * shards rows come to the driver and go back.
        final = F.broadcast(_combined(spark, sums.collect(), shards, ["block", "slot", "shard"]))
    else:
        tops = -(-blocks // TOP)

        def lift(group: pa.Table) -> pa.Table:
            parts: dict[int, list[int]] = {}
            for block, slot, size in zip(*(group.column(c).to_pylist() for c in ("block", "slot", "size"))):
                parts.setdefault(block, [0] * shards)[slot] = size
            moved = difference(list(parts.values()))[0]
            flat = [(group.column("top")[0].as_py(), b, i, m[i], parts[b][i]) for b, m in zip(parts, moved) for i in range(shards)]
            return pa.table([pa.array(c, k) for c, k in zip(zip(*flat), (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64()))], ["top", "block", "slot", "up", "size"])

        lifted = sums.withColumn("top", F.pmod(F.xxhash64("block"), F.lit(tops)).cast("int")).groupBy("top")
        lifted = written(lifted.applyInArrow(lift, "top int, block int, slot int, up int, size long"), "shard-blocks")
        top = _combined(spark, lifted.groupBy("top", "up").agg(F.sum("size").alias("size")).collect(), shards, ["top", "up", "shard"])
        final = lifted.join(F.broadcast(top), ["top", "up"]).select("block", "slot", "shard")
    where = placed.join(final, ["block", "slot"]).select("hash", "shard", "n")
    found = join_hot(rows, where, "hash", total).withColumns({"_bucket": F.pmod(F.xxhash64("doc_id"), F.lit(4096)).cast("int"), "_one": F.lit(1)})
    found = running_sum(found, ["shard"], "_bucket", ["doc_id", "text_crc32", "size"], "_one", "_nth")
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_nth") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def _combined(spark: SparkSession, sums: list, shards: int, names: list[str]) -> DataFrame:
    """Combines the partial partitions of rows (part, slot, size): the shard of each part's slots."""
    parts: dict[int, list[int]] = {}
    for part, slot, size in sums:
        parts.setdefault(part, [0] * shards)[slot] = size
    known = sorted(parts)
    moved = difference([parts[p] for p in known])[0] if known else []
    columns = [np.repeat(np.array(known, np.int32), shards), np.tile(np.arange(shards, dtype=np.int32), len(known)), np.array([s for m in moved for s in m], np.int32)]
    return spark.createDataFrame(pa.table(columns, names), ", ".join(f"{n} int" for n in names))
