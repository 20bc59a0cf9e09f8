"""BPE encoding and decoding of documents (operator 7): speculate and verify, see `bpe.py`.

Input rows may hold null or empty texts (no tokens), texts of any length, repeated rows and any other columns; a
column with the name of an output is replaced. Every row gives one row; an empty table gives an empty one. All work
is in one pass over the input without a shuffle; a worker remembers distinct chunks of text, bounded by `bpe.MEMO`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from versalake.llm import bpe
from versalake.llm.common import short_batches


def _extended(docs: DataFrame, new: T.StructType) -> T.StructType:
    names = set(new.fieldNames())
    return T.StructType([f for f in docs.schema.fields if f.name not in names] + new.fields)


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", end: int | None = None) -> DataFrame:
    """Adds `ids`, the token ids of `text`; with `end`, that id after each document's own."""
    short_batches(docs.sparkSession)
    schema = _extended(docs, T.StructType([T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)]))
    kept = [n for n in docs.columns if n != ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.load(path)
        for batch in batches:
            data, begin = bpe.column_bytes(batch.column(text))
            for a, b in bpe.slices(np.diff(begin)):
                flat, at = coder.encode_bytes(data[begin[a] : begin[b]], begin[a : b + 1] - begin[a])
                if end is not None:
                    flat, at = np.insert(flat, at[1:], end), at + np.arange(len(at))
                part = batch.slice(a, b - a)
                column = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in kept), column], [*kept, ids])
        bpe.release()

    return docs.mapInArrow(run, schema)


def decode(tokens: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """Adds `text`: what `ids` stand for. Null ids give an empty text; bytes that aren't UTF-8 become U+FFFD."""
    short_batches(tokens.sparkSession)
    schema = _extended(tokens, T.StructType([T.StructField(text, T.StringType(), False)]))
    kept = [n for n in tokens.columns if n != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.load(path)
        for batch in batches:
            lists = [np.asarray(x.values, np.int64) if x.is_valid else np.empty(0, np.int64) for x in batch.column(ids)]
            flat = np.concatenate(lists) if lists else np.empty(0, np.int64)
            texts = coder.decode(flat, np.concatenate([[0], np.cumsum([len(x) for x in lists], dtype=np.int64)]).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(texts, pa.string())], [*kept, text])
        bpe.release()

    return tokens.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, text: str = "text", ids: bool = False) -> DataFrame:
    """Encodes, decodes the ids and puts in place of the text n_tokens, ids_sha256 (of the decimal ids joined by
    commas) and decoded_sha256 (of the decoded text's UTF-8), with `ids` also the ids themselves, in one pass."""
    short_batches(docs.sparkSession)
    new = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    if ids:
        new.add("ids", T.ArrayType(T.IntegerType(), False))
    schema = _extended(docs, new).fields
    kept = [f.name for f in schema[: -len(new)] if f.name != text]
    schema = T.StructType([f for f in schema if f.name != text])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.load(path)
        decimal = [b"%d," % i for i in range(coder.size)]
        letters, starts = np.frombuffer(b"".join(decimal), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in decimal])])
        for batch in batches:
            data, begin = bpe.column_bytes(batch.column(text))
            for a, b in bpe.slices(np.diff(begin)):
                flat, at = coder.encode_bytes(data[begin[a] : begin[b]], begin[a : b + 1] - begin[a])
                said, sizes = bpe.gather(letters, starts, flat)
                cut = np.concatenate([[0], np.cumsum(sizes)])[at].tolist()
                said = memoryview(said)
                first = [hashlib.sha256(said[x : max(x, y - 1)]).hexdigest() for x, y in zip(cut, cut[1:])]
                second = [hashlib.sha256(t.encode()).hexdigest() for t in coder.decode(flat, at)]
                columns = [pa.array(np.diff(at), pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())]
                if ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat)))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in kept), *columns], [*kept, *new.fieldNames()])
        bpe.release()

    return docs.mapInArrow(run, schema)
