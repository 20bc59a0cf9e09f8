"""Token counts that survive edits (operator 1): a segment tree of pre-tokens for every document.

*Tree.* A document's text is cut into leaves of `LEAF` chunks, a chunk being a few whole pre-tokens that start at a
space or line end after something else than white space (or at the text's start). The tree holds, for every node, the bytes and
the tokens below it, in heap order: `spans` and `counts`, two arrays of twice the number of leaves (a power of two);
counts[1] is the document's number of tokens.

*Edit.* Whether a chunk starts at a place depends on that character and the one before alone. So an edit leaves all
leaves alone but those that hold a changed character or one next to it: only these are encoded again, from the last
leaf start before the edit to the first after it, and the sums above them are updated. Where an insertion needs more
leaves than it replaces, the leaves are spliced and the sums rebuilt, without encoding anything else.

Edits are rows (doc_id, seq, start, length, replacement); offsets are code points, edits of a document apply in the
order of seq, each to what the ones before left. They are cut to the text; a null start is the end of the text, a
null length 0, a null replacement nothing. Edits of unknown documents are ignored. Null text counts as empty; rows with one doc_id each take that
document's edits. Columns spans, counts, edits and n_encoded are replaced, others kept. Empty tables give empty ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from versalake.llm import bpe
from versalake.llm.common import short_batches, written

LEAF = 32
#: Edits up to this number of bytes are broadcast; beyond it documents and edits meet in a shuffle.
MOST_EDITS = 1 << 24
TREE = [T.StructField("spans", T.ArrayType(T.LongType(), False)), T.StructField("counts", T.ArrayType(T.LongType(), False))]


def sums(leaves: np.ndarray) -> np.ndarray:
    """The heap of a row of leaves."""
    size = 1 << max(0, int(len(leaves) - 1).bit_length())
    out = np.zeros(2 * size, np.int64)
    out[size : size + len(leaves)] = leaves
    while size > 1:
        half = size // 2
        out[half:size] = out[size : 2 * size : 2] + out[size + 1 : 2 * size : 2]
        size = half
    return out


def leaves_of(coder: bpe.ByteBPE, data: np.ndarray, begin: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text the bytes and the tokens of its leaves; one empty leaf for an empty text."""
    p, n = coder.count_bytes(data, begin)
    at, out = np.searchsorted(p, begin), []
    for i, (a, b) in enumerate(zip(at, at[1:])):
        if a == b:
            out.append((np.zeros(1, np.int64), np.zeros(1, np.int64)))
        else:
            heads = np.arange(a, b, LEAF)
            out.append((np.diff(np.append(p[heads], begin[i + 1])), np.add.reduceat(n[a:b], heads - a)))
    return out


class Tree:
    """A document's tree under edits. The text lies in its leaves, so an edit copies and decodes those that it touches
    alone. `encoded` counts the bytes that edits made it encode."""

    def __init__(self, coder: bpe.ByteBPE, text: bytes, spans: list[int], counts: list[int]):
        self.coder, self.spans, self.counts, self.encoded = coder, list(spans), list(counts), 0
        ends = np.cumsum(self.spans[len(self.spans) // 2 :])
        cuts = [0, *ends.tolist()]
        self.pieces = [text[a:b] for a, b in zip(cuts, cuts[1:])]
        heads = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
        #: The heap of code points.
        self.chars = sums(np.diff(heads[cuts])).tolist()

    @property
    def text(self) -> bytes:
        return b"".join(self.pieces)

    def __len__(self) -> int:
        return self.chars[1]

    def _find(self, at: int) -> tuple[int, int]:
        """The leaf that holds code point `at`, and where it starts."""
        node, start, size = 1, 0, len(self.chars) // 2
        while node < size:
            node *= 2
            if at - start >= self.chars[node]:
                start += self.chars[node]
                node += 1
        return node - size, start

    def edit(self, start: int, length: int, replacement: str) -> None:
        """Replaces `length` code points at `start`."""
        total = len(self)
        a = min(max(start, 0), total)
        b = min(max(start, 0) + max(length, 0), total)
        first, left = self._find(max(a - 1, 0)) if total else (0, 0)
        last, _ = self._find(min(b, total - 1)) if total else (0, 0)
        said = b"".join(self.pieces[first : last + 1]).decode()
        region = (said[: a - left] + replacement + said[b - left :]).encode()
        self.encoded += len(region)
        data = np.frombuffer(region, np.uint8)
        spans, counts = leaves_of(self.coder, data, np.array([0, len(region)]))[0]
        cuts = np.concatenate([[0], np.cumsum(spans)])
        chars = np.diff(np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[cuts])
        pieces = [region[x:y] for x, y in zip(cuts.tolist(), cuts[1:].tolist())]
        room, size = last - first + 1, len(self.spans) // 2
        fresh = {"spans": spans.tolist(), "counts": counts.tolist(), "chars": chars.tolist()}
        if len(pieces) > room:
            pieces = self.pieces[:first] + pieces + self.pieces[last + 1 :]
            used = [i for i, p in enumerate(pieces) if p] or [0]
            for name, new in fresh.items():
                old = getattr(self, name)[size:]
                row = old[:first] + new + old[last + 1 :]
                setattr(self, name, sums(np.array([row[i] for i in used], np.int64)).tolist())
            self.pieces = [pieces[i] for i in used] + [b""] * (len(self.spans) // 2 - len(used))
            return
        self.pieces[first : last + 1] = pieces + [b""] * (room - len(pieces))
        for name, new in fresh.items():
            heap = getattr(self, name)
            heap[size + first : size + last + 1] = new + [0] * (room - len(new))
            low, high = (size + first) // 2, (size + last) // 2
            while low:
                for node in range(low, high + 1):
                    heap[node] = heap[2 * node] + heap[2 * node + 1]
                low, high = low // 2, high // 2


def build(docs: DataFrame, path: str) -> DataFrame:
    """`docs` with every document's tree: spans and counts."""
    short_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("spans", "counts")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.load(path)
        for batch in batches:
            data, begin = bpe.column_bytes(batch.column("text"))
            trees = [x for a, b in bpe.slices(np.diff(begin)) for x in leaves_of(coder, data[begin[a] : begin[b]], begin[a : b + 1] - begin[a])]
            columns = []
            for i in range(2):
                heaps = [sums(t[i]) for t in trees]
                at = np.concatenate([[0], np.cumsum([len(h) for h in heaps], dtype=np.int64)]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(heaps) if heaps else np.empty(0, np.int64))))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *columns], [*kept, "spans", "counts"])
        bpe.release()

    return docs.mapInArrow(run, T.StructType([*(docs.schema[c] for c in kept), *TREE]))


def apply(trees: DataFrame, path: str) -> DataFrame:
    """Applies the column `edits` (array of struct<seq, start, length, replacement>, null: none) to text and tree;
    adds n_encoded, the bytes that were encoded again."""
    short_batches(trees.sparkSession)
    kept = [c for c in trees.columns if c not in ("text", "spans", "counts", "edits", "n_encoded")]
    names = [*kept, "text", "spans", "counts", "n_encoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edits = batch.column("edits")
            touched = np.flatnonzero(edits.is_valid().to_numpy(zero_copy_only=False))
            if not len(touched):
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:-1]), pa.array(np.zeros(batch.num_rows, np.int64))], names)
                continue
            columns = {c: batch.column(c) for c in ("text", "spans", "counts")}
            coder = bpe.load(path)
            done, encoded = {}, np.zeros(batch.num_rows, np.int64)
            for i in touched.tolist():
                tree = Tree(coder, (columns["text"][i].as_py() or "").encode(), columns["spans"][i].as_py(), columns["counts"][i].as_py())
                for e in sorted(edits[i].as_py(), key=lambda e: e["seq"]):
                    tree.edit(len(tree) if e["start"] is None else e["start"], e["length"] or 0, e["replacement"] or "")
                done[i], encoded[i] = tree, tree.encoded
            # Rows that no edit touches keep their values; edited ones are put behind and taken from there.
            order = np.arange(batch.num_rows)
            order[list(done)] = batch.num_rows + np.arange(len(done))
            for c in columns:
                fresh = [t.text.decode() if c == "text" else getattr(t, c) for t in done.values()]
                columns[c] = pa.concat_arrays([columns[c], pa.array(fresh, columns[c].type)]).take(pa.array(order))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *columns.values(), pa.array(encoded)], names)
        bpe.release()

    schema = [*(trees.schema[c] for c in kept), T.StructField("text", T.StringType()), *TREE, T.StructField("n_encoded", T.LongType())]
    return trees.mapInArrow(run, T.StructType(schema))


def with_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """`docs` with the array of each document's edits, in order; null where there are none. Edits that name a text, by
    its hash in `text_hash`, are for the rows of that text alone."""
    keys = [F.col("doc_id").alias("_id")]
    on = F.col("doc_id") == F.col("_id")
    if "text_hash" in edits.columns:
        keys.append(F.col("text_hash").alias("_hash"))
        on &= F.xxhash64("text") == F.col("_hash")
    each = edits.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("seq", "start", "length", "replacement"))).alias("edits"))
    size = edits.agg(F.sum(F.coalesce(F.octet_length("replacement"), F.lit(0)) + 48)).first()[0]
    few = (size or 0) <= MOST_EDITS
    return docs.drop("edits").join(F.broadcast(each) if few else each, on, "left").drop("_id", "_hash")


def redactions(docs: DataFrame, pattern: str = "[0-9]{9,}", replacement: str = "[number]") -> DataFrame:
    """Edits that replace every match of a pattern, last match first, so that offsets hold one after another. Each is
    for the rows of its own text (`text_hash`), and there once however often a row is repeated."""
    short_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash")).where(F.col("text").rlike(pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find = regex.compile(pattern).finditer
        for batch in batches:
            found = [(i, h, -m.start(), m.start(), m.end() - m.start(), replacement) for i, t, h in zip(*(c.to_pylist() for c in batch.columns)) for m in find(t)]
            columns = list(zip(*found)) if found else [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "text_hash", "seq", "start", "length", "replacement"])

    return rows.mapInArrow(run, "doc_id long, text_hash long, seq long, start long, length long, replacement string").distinct()


def workload() -> Column:
    """Edits of a row by a hash of its doc_id, for seven documents of eight: insertions, deletions and replacements at
    the start, inside and at the end, some longer than a leaf."""
    luck, n = F.xxhash64(F.lit("edit"), "doc_id"), F.coalesce(F.length("text"), F.lit(0))
    inside = F.pmod(luck, F.greatest(n, F.lit(1)))
    long = F.repeat(F.lit(" more words"), 3 * LEAF)

    def edit(seq: int, start, length, replacement) -> Column:
        kinds = (("seq", F.lit(seq)), ("start", start), ("length", length), ("replacement", replacement))
        return F.struct(*(c.cast("string" if name == "replacement" else "long").alias(name) for name, c in kinds))

    some, none = F.lit(200), F.lit(None)
    ways = [
        [edit(0, F.lit(0), F.lit(0), F.lit("Note: "))],
        [edit(0, none, F.lit(0), long)],
        [edit(0, inside, some, none)],
        [edit(0, inside, some, long)],
        [edit(0, F.lit(0), some, none)],
        [edit(0, F.greatest(n - 200, F.lit(0)), some, none)],
        [edit(0, inside, F.lit(0), F.lit(" [seen] ")), edit(1, F.lit(0), F.lit(1), F.lit("É"))],
    ]
    out = F.when(F.lit(False), F.array(*ways[0]))
    for i, way in enumerate(ways):
        out = out.when(F.pmod(F.xxhash64(F.lit("way"), "doc_id"), F.lit(8)) == i, F.array(*way))
    return out


def recount(docs: DataFrame, path: str, edits: DataFrame | Column | None = None) -> DataFrame:
    """doc_id, n_tokens, n_edits, n_tokens_after, n_encoded, n_bytes: every document's count before and after edits
    (by default the redaction of long numbers; a column is each row's own), and how many of its bytes were encoded
    again for it."""
    docs = docs.select("doc_id", "text")
    if isinstance(edits, Column):
        edited = docs.withColumn("edits", edits)
    else:
        edited = with_edits(docs, written(redactions(docs) if edits is None else edits, "token-edits"))
    trees = build(edited, path).withColumn("n_tokens", F.element_at("counts", 2)).withColumn("n_edits", F.coalesce(F.size("edits"), F.lit(0)))
    trees = trees.withColumn("n_edits", F.when(F.col("edits").isNull(), 0).otherwise(F.col("n_edits")).cast("long"))
    done = apply(trees.withColumn("n_bytes", F.element_at("spans", 2)), path)
    return done.select("doc_id", "n_tokens", "n_edits", F.element_at("counts", 2).alias("n_tokens_after"), "n_encoded", "n_bytes")
