"""Token-ID output (operator 10): Arrow IPC files of fixed-size-list batches.

Documents in ascending doc_id order form one stream of ids, each document followed by an end id. A range of doc_ids
goes to one file, cut into sequences of equal length: column `tokens` is fixed_size_list<uint16 or uint32>[length]
(16 bits where the vocabulary allows), column `mask` fixed_size_list<bool>[length], false where the last sequence is
filled up. Nothing is compressed, so sequence i of a memory-mapped file is a slice of it: no copy, no parsing.

An index row per document (doc_id, part, file, first, n_tokens) tells where its ids lie. Texts may be null or empty
(the end id alone), doc_ids may repeat (their order follows the text) or be null (first); other columns are ignored.
An empty table gives no file and an empty index. Files carry their attempt in their name and the index is written
before it is used, so that a task that is run again, or twice, leaves no file that the index names wrongly.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from versalake.llm import bpe
from versalake.llm.common import partitions, scratch, short_batches, written

INDEX = "doc_id long, part int, file string, first long, n_tokens long"
#: Sequences in a record batch.
ROWS = 128


def _open(path: str, write: bool = False):
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path)
    if write:
        system.create_dir(at.rpartition("/")[0], recursive=True)
        return system.open_output_stream(at)
    return pa.memory_map(at) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(at)


class Writer:
    """One file of sequences; opens it with the first ids."""

    def __init__(self, path: str, length: int, wide: bool):
        self.path, self.length, self.kind = path, length, np.uint32 if wide else np.uint16
        self.schema = pa.schema([("tokens", pa.list_(pa.from_numpy_dtype(self.kind), length)), ("mask", pa.list_(pa.bool_(), length))])
        self.rest, self.held, self.total, self.file = [], 0, 0, None

    def add(self, ids: np.ndarray) -> None:
        self.rest.append(ids.astype(self.kind))
        self.held += len(ids)
        self.total += len(ids)
        full = self.length * ROWS
        if self.held >= full:
            flat = np.concatenate(self.rest)
            cut = len(flat) - len(flat) % full
            for at in range(0, cut, full):
                self._batch(flat[at : at + full], full)
            self.rest, self.held = [flat[cut:]], len(flat) - cut

    def _batch(self, flat: np.ndarray, real: int) -> None:
        if self.file is None:
            self.stream = _open(self.path, write=True)
            self.file = pa.ipc.new_file(self.stream, self.schema)
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (flat, np.arange(len(flat)) < real)]
        self.file.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def close(self) -> None:
        if self.held:
            flat = np.concatenate(self.rest)
            self._batch(np.pad(flat, (0, -len(flat) % self.length)), len(flat))
        if self.file is not None:
            self.file.close()
            self.stream.close()


class Reader:
    """Random access to a file: sequences and spans of ids, as views of its memory."""

    def __init__(self, path: str):
        self.file = pa.ipc.open_file(_open(path))
        self.length = self.file.schema.field("tokens").type.list_size
        self.full = self.length * ROWS

    def _flat(self, i: int) -> np.ndarray:
        return self.file.get_batch(i).column("tokens").flatten().to_numpy(zero_copy_only=True)

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids and the mask of sequence i."""
        batch, row = self.file.get_batch(i // ROWS), i % ROWS
        mask = batch.column("mask").slice(row, 1).flatten().to_numpy(zero_copy_only=False)
        return batch.column("tokens").slice(row, 1).flatten().to_numpy(zero_copy_only=True), mask

    def span(self, first: int, n: int) -> Iterator[np.ndarray]:
        """The ids at first .. first + n - 1, a view from each batch that they touch."""
        while n > 0:
            at = first % self.full
            part = self._flat(first // self.full)[at : at + n]
            yield part
            first, n = first + len(part), n - len(part)


def write(docs: DataFrame, path: str, to: str, end: int = 2, length: int = 2048) -> DataFrame:
    """Encodes `docs` (doc_id, text) and writes the files under the folder `to`; returns the index."""
    spark = docs.sparkSession
    short_batches(spark)
    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, task = bpe.load(path), TaskContext.get()
        part = task.partitionId()
        file = f"{to}/part-{part:06d}-{task.taskAttemptId()}.arrow"
        writer = Writer(file, length, max(coder.size, end + 1) > 1 << 16)
        for batch in batches:
            data, begin = bpe.column_bytes(batch.column(1))
            for a, b in bpe.slices(np.diff(begin)):
                flat, at = coder.encode_bytes(data[begin[a] : begin[b]], begin[a : b + 1] - begin[a])
                flat, at = np.insert(flat, at[1:], end), at + np.arange(len(at))
                n = b - a
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, n), pa.array(np.full(n, part, np.int32)), pa.array([file] * n), pa.array(writer.total + at[:-1], pa.int64()), pa.array(np.diff(at), pa.int64())],
                    ["doc_id", "part", "file", "first", "n_tokens"],
                )
                writer.add(flat)
        writer.close()

    return written(ranged.mapInArrow(run, INDEX), "token-index")


def read(index: DataFrame) -> DataFrame:
    """Reads every document's ids back from the files: the index and `start` (ids of all documents before it),
    `ids_crc32` (of the ids as little-endian unsigned 32-bit integers)."""
    spark = index.sparkSession
    totals = index.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    # A row per file: as many as the shuffle has partitions.
    before = totals.select("part", (F.sum("_n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))
    placed = index.join(before, "part").withColumn("start", F.col("_before") + F.col("first")).drop("_before")
    placed = placed.select("doc_id", "file", "first", "n_tokens", "start").repartition(partitions(spark), "file").sortWithinPartitions("file", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, reader = None, None
        for batch in batches:
            sums = []
            for file, first, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if file != name:
                    name, reader = file, Reader(file)
                crc = 0
                for part in reader.span(first, n):
                    crc = zlib.crc32(part.astype("<u4").tobytes(), crc)
                sums.append(crc)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(4), batch.column(3), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, path: str, to: str | None = None, end: int = 2, length: int = 2048) -> DataFrame:
    """Writes the files (under the shared folder unless `to` is given) and reads them back."""
    return read(write(docs, path, to or scratch(docs.sparkSession, "tokens"), end, length))
