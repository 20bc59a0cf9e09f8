"""Near-duplicate documents (operator 2) by BagMinHash signatures, banding and exact verification.

*Bags.* A text's bag holds its shingles of five words with their multiplicities (fewer words: one shingle of them
all). Two texts are near duplicates if the multiset overlap, sum of minima over sum of maxima, is 0.8 or more.

*Signatures.* A shingle's weights 0, 1, 2, ... are cut into dyadic blocks [0,1), [1,2), [2,4), [4,8), ... Every
(shingle, block) owns a Poisson process, drawn from hashes alone, whose points have a time, a register and a weight
level inside the block; a text of multiplicity w sees the points below level w, its heaviest block being thinned.
Each register keeps the text's earliest point, so two texts agree in a register with probability equal to their
weighted Jaccard similarity. Points are drawn only up to the time when all registers are filled: about
REGISTERS * ln(REGISTERS) of them for any length of text.

*Candidates.* Texts that agree in all `ROWS` registers of one of `BANDS` bands share a bucket; a pair of similarity
0.8 misses all with a probability under 1e-7. Nothing lists all pairs of a bucket: each member is verified against the
bucket's smallest member first, and the verified links are contracted. A bucket whose members then form one class is
settled. In the others only pairs of different classes are left, less those that can't be similar:

* A text shares with other classes no more than its shingles that some other class holds, too. If these are less than
  0.8 of its bag, it has no link outside its class. That needs one count of the shingles of all texts in such buckets,
  not of pairs. Equal hashes of different shingles only raise the bound, so nothing is lost by it. Merged classes lower
  it: who is out stays out.
* These shingles are counted in `BINS` bins by their hash. The overlap of u and v is at most the sum over the bins of
  the lesser count, and 0.8 takes 4/9 of both bags together.
* The triangle inequality (1 - similarity is a metric): |s(u,c) - s(v,c)| > 0.2 for the bucket's centre c.

The rest is verified as well, all of it, so no link inside a bucket is lost; before that, further rounds with other
centres contract classes while the pairs left are more than `LEFT` times the members. They are counted where that is
cheaper than verifying as many; else all pairs of a bucket count. Buckets of over `MANY` members are compared as arrays,
in parts.

*Verification* counts both texts' shingles exactly: hashes only sort words and shingles, those of one hash are compared
themselves. Classes are connected components, found by large-star and small-star steps over tables.

*Hot keys.* A centre that many members are verified against is met by them in shares of at most `SHARE` members, each
with its own copy of the text; the hubs of stars are few enough to broadcast (`common.HOT`), the rest is shuffled.

Equal texts are one text throughout, whose documents share a class. Null text: a class of its own. Texts without a
word link to equal texts only. Rows with one doc_id are one document; a null doc_id has the class null. Empty tables
give empty ones; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from versalake.llm import bpe
from versalake.llm.common import HOT, discard, join_hot, short_batches, trim, written

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 32, 4
REGISTERS = BANDS * ROWS
#: Ids up to this number are broadcast to pick out texts; beyond it they are joined by a shuffle.
MOST_IDS = 1_000_000
LEFT, ROUNDS = 4, 4
#: Rows of a bucket that are compared by their numbers in about the time that it takes to verify a pair.
COMPARE = 1000
BINS = 128
#: Members of a bucket that are compared by a join; those of larger ones are compared as arrays, so many by so many.
MANY, PART = 64, 2048
#: Rows of a part, and pairs' bins, that are compared at once.
ROWS_AT_ONCE, PAIRS_AT_ONCE = 256, 1 << 14
#: Bytes of text that are hashed at a time: their processes and points are held at once, at some hundred bytes a word.
SLICE = 1 << 19
#: Words of more bytes are hashed one by one.
LONG = 64
#: Members that meet one copy of a centre's text.
SHARE = 4096

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def word_spans(data: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each word starts and ends, and the text that it belongs to."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    inside = (data != 32) & ((data < 9) | (data > 13))
    edge = np.zeros(len(data) + 1, bool)
    edge[begin] = True
    first = inside & (edge[:-1] | ~np.concatenate([[False], inside[:-1]]))
    last = inside & (edge[1:] | ~np.concatenate([inside[1:], [False]]))
    p, q = np.flatnonzero(first), np.flatnonzero(last) + 1
    return p, q, np.searchsorted(begin, p, side="right") - 1


def hash_words(data: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word data[p[i]:q[i]], eight bytes mixed at a time; words of over `LONG` bytes by blake2b."""
    size = q - p
    out = _mix(size.astype(np.uint64) + _GOLDEN)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)
    live = np.flatnonzero(size <= LONG)
    at = 0
    while len(live):
        block = np.ascontiguousarray(eight[p[live] + at]).view("<u8").reshape(-1)
        rest = np.minimum(size[live] - at, 8).astype(np.uint64)
        block &= np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - rest * np.uint64(8))
        out[live] = _mix(out[live] ^ _mix(block + _GOLDEN))
        at += 8
        live = live[size[live] > at]
    long = np.flatnonzero(size > LONG).tolist()
    if long:
        raw = data.tobytes()
        out[long] = [int.from_bytes(hashlib.blake2b(raw[p[i] : q[i]], digest_size=8).digest(), "little") for i in long]
    return out


def hash_shingles(words: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of `SHINGLE` words; 0 stands for no word."""
    mixed = np.zeros(len(words), np.uint64)
    for j in range(SHINGLE):
        mixed += words[:, j] * _ODD[j]
    return _mix(mixed)


def word_codes(data: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Numbers from 1 that are equal for equal words alone: words of one hash are compared byte by byte."""
    _, first, code = np.unique(hash_words(data, p, q), return_index=True, return_inverse=True)
    code = code.astype(np.int64)
    same = (q - p)[first[code]] == q - p
    fine = np.flatnonzero(same)
    mine, size = bpe.gather(data, np.stack([p[fine], q[fine]], axis=1).reshape(-1), 2 * np.arange(len(fine)))
    its, _ = bpe.gather(data, np.stack([p[first[code[fine]]], q[first[code[fine]]]], axis=1).reshape(-1), 2 * np.arange(len(fine)))
    differ = np.flatnonzero(mine != its)
    if len(differ):
        same[fine[np.searchsorted(np.cumsum(size), differ, side="right")]] = False
    if not same.all():
        raw, named = data.tobytes(), {}
        for i in np.flatnonzero(~same).tolist():
            code[i] = named.setdefault(raw[p[i] : q[i]], len(first) + len(named))
    return code + 1


def shingle_codes(words: np.ndarray) -> np.ndarray:
    """Numbers that are equal for equal rows alone."""
    _, first, code = np.unique(hash_shingles(words.astype(np.uint64)), return_index=True, return_inverse=True)
    if (words[first[code]] != words).any():
        code = np.unique(words, axis=0, return_inverse=True)[1].reshape(-1)
    return code.astype(np.uint64)


def bags(data: np.ndarray, begin: np.ndarray, exact: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, multiplicity), sorted by text and shingle. A shingle is its hash, the same in all calls; exact: a
    number that tells it from all others of this call."""
    p, q, text = word_spans(data, begin)
    n = np.bincount(text, minlength=len(begin) - 1)
    start = np.cumsum(n) - n
    size = np.where(n >= SHINGLE, n - (SHINGLE - 1), np.minimum(n, 1))
    total = int(size.sum())
    if not total:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    word = word_codes(data, p, q) if exact else hash_words(data, p, q)
    owner = np.repeat(np.arange(len(n)), size)
    at = np.arange(total) - np.repeat(np.cumsum(size) - size, size) + start[owner]
    padded = np.concatenate([word, np.zeros(SHINGLE, word.dtype)])
    # In a text of fewer words the places beyond its end count as nothing.
    rows = np.stack([np.where(j < n[owner], padded[at + j], 0) for j in range(SHINGLE)], axis=1)
    shingle = shingle_codes(rows) if exact else hash_shingles(rows)
    order = np.lexsort((shingle, owner))
    owner, shingle = owner[order], shingle[order]
    new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (shingle[1:] != shingle[:-1])])
    spots = np.flatnonzero(new)
    return owner[spots], shingle[spots], np.diff(np.append(spots, total))


def signatures(owner: np.ndarray, shingle: np.ndarray, weight: np.ndarray, texts: int) -> np.ndarray:
    """texts x REGISTERS: the hash of each register's earliest point; 0 in texts without a shingle."""
    out = np.zeros((texts, REGISTERS), np.uint64)
    whole = np.bincount(owner, weights=weight, minlength=texts)
    todo = np.flatnonzero(whole > 0)
    reach = np.log(REGISTERS) + 2.5
    # The processes: one for each shingle and dyadic block that the multiplicity reaches into.
    blocks = np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64) + 1
    which = np.repeat(np.arange(len(owner)), blocks)
    block = np.arange(len(which)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    low = np.where(block == 0, 0, 1 << np.maximum(block - 1, 0))
    width = np.maximum(low, 1).astype(np.float64)
    text, level = owner[which], weight[which] - low
    seed = _mix(shingle[which] ^ _mix(block.astype(np.uint64) + _GOLDEN))
    while len(todo):
        limit = np.zeros(texts)
        limit[todo] = REGISTERS * reach / whole[todo]
        times, points = np.full(texts * REGISTERS, np.inf), np.zeros(texts * REGISTERS, np.uint64)
        live = np.flatnonzero(limit[text] > 0)
        clock, step = np.zeros(len(live)), 0
        while len(live):
            # A few points at a time where processes are long, that is in short texts.
            ahead = 1 if step < 4 else 8
            count = np.arange(step + 1, step + 1 + ahead, dtype=np.uint64)
            h = _mix(seed[live][:, None] + count * _GOLDEN)
            gap = -np.log(((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / width[live][:, None]
            when = clock[:, None] + np.cumsum(gap, axis=1)
            ok = when < limit[text[live]][:, None]
            row, col = np.nonzero(ok)
            mark = _mix(h[row, col] ^ _M2)
            rank = ((mark >> np.uint64(40)).astype(np.float64) * 2.0**-24 * width[live][row]).astype(np.int64)
            seen = rank < level[live][row]
            slot = text[live][row[seen]] * REGISTERS + (mark[seen] & np.uint64(REGISTERS - 1)).astype(np.int64)
            t, mark = when[row, col][seen], mark[seen]
            np.minimum.at(times, slot, t)
            won = times[slot] == t
            points[slot[won]] = mark[won]
            on = ok[:, -1]
            live, clock, step = live[on], when[on, -1], step + ahead
        full = np.isfinite(times.reshape(texts, REGISTERS)[todo]).all(axis=1)
        out[todo[full]] = points.reshape(texts, REGISTERS)[todo[full]]
        todo, reach = todo[~full], reach * 2
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    """texts x BANDS: a key that holds the band's number and registers."""
    parts = signature.reshape(len(signature), BANDS, ROWS)
    key = np.repeat((np.arange(BANDS, dtype=np.uint64) + np.uint64(1))[None, :], len(signature), axis=0) * _GOLDEN
    for i in range(ROWS):
        key = _mix(key ^ (parts[:, :, i] + _ODD[i]))
    return key


def overlap(data: np.ndarray, begin: np.ndarray, pairs: int) -> np.ndarray:
    """Multiset similarity of texts 2i and 2i + 1; 0 where one has no word."""
    owner, shingle, weight = bags(data, begin, exact=True)
    total = np.bincount(owner, weights=weight, minlength=2 * pairs)
    order = np.lexsort((shingle, owner >> 1))
    owner, shingle, weight = owner[order], shingle[order], weight[order]
    same = np.flatnonzero((owner[1:] >> 1 == owner[:-1] >> 1) & (shingle[1:] == shingle[:-1]))
    least = np.minimum(weight[same], weight[same + 1])
    both = np.bincount(owner[same] >> 1, weights=least, minlength=pairs)
    union = total[0::2] + total[1::2] - both
    return np.where(union > 0, both / np.maximum(union, 1), 0.0)


def keys(docs: DataFrame) -> DataFrame:
    """(doc_id, h1, h2, keys): the text's hash and its band keys; no keys where there is no word."""
    short_batches(docs.sparkSession)
    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("text"), "text").alias("h2"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, begin = bpe.column_bytes(batch.column(1))
            for a, b in bpe.slices(np.diff(begin), SLICE):
                owner, shingle, weight = bags(data[begin[a] : begin[b]], begin[a : b + 1] - begin[a])
                found = bands(signatures(owner, shingle, weight, b - a)).view(np.int64)
                size = np.where(np.bincount(owner, minlength=b - a) > 0, BANDS, 0)
                flat = found[size > 0].reshape(-1)
                column = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(flat))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), column], ["doc_id", "h1", "h2", "keys"])
        trim()

    return rows.mapInArrow(run, "doc_id long, h1 long, h2 long, keys array<long>")


def _texts(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, text) of these ids."""
    ids = written(ids.distinct(), "near-ids")
    few = ids.count() <= MOST_IDS
    texts = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(ids) if few else ids, "id")
    texts = written(texts, "near-texts")
    discard(ids)
    return texts


def shingles(texts: DataFrame) -> DataFrame:
    """(id, shingle, n, size): the hashes of each text's shingles with their multiplicities, and the size of its bag."""
    short_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            data, begin = bpe.column_bytes(batch.column(1))
            for a, b in bpe.slices(np.diff(begin), SLICE):
                owner, shingle, weight = bags(data[begin[a] : begin[b]], begin[a : b + 1] - begin[a])
                size = np.bincount(owner, weights=weight, minlength=b - a).astype(np.int64)
                columns = [pa.array(x) for x in (ids[a + owner], shingle.view(np.int64), weight.astype(np.int64), size[owner])]
                yield pa.RecordBatch.from_arrays(columns, ["id", "shingle", "n", "size"])
        trim()

    return texts.select("id", "text").mapInArrow(run, "id long, shingle long, n long, size long")


def verify(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, b, s): the similarity of each pair of doc_ids. Only texts that are in a pair are moved."""
    short_batches(docs.sparkSession)
    texts = _texts(pairs.select(F.explode(F.array("a", "b")).alias("id")), docs)
    degrees = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    stat = degrees.agg(F.sum("n").alias("pairs"), F.max("n").alias("most")).first()
    met = pairs.select("a", "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    centres = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    # Centres of more members than this are at most HOT, whatever the table.
    share = max(SHARE, -(-(stat.pairs or 0) // HOT))
    if (stat.most or 0) <= share:
        met = met.join(centres, "b").select("a", "b", "ta", "tb")
    else:
        parts = F.broadcast(degrees.where(F.col("n") > share).select("b", F.ceil(F.col("n") / share).cast("int").alias("parts")))
        many = F.coalesce("parts", F.lit(1))
        met = met.join(parts, "b", "left").select("a", "b", "ta", F.pmod(F.xxhash64("a"), many).cast("int").alias("part"))
        centres = centres.join(parts, "b", "left").select("b", "tb", F.explode(F.sequence(F.lit(0), many - 1)).alias("part"))
        met = met.join(centres, ["b", "part"]).select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = bpe.column_bytes(batch.column(2)), bpe.column_bytes(batch.column(3))
            scores = []
            for a, b in bpe.slices(np.diff(one[1]) + np.diff(two[1]), SLICE):
                parts = [x for i in range(a, b) for x in (one[0][one[1][i] : one[1][i + 1]], two[0][two[1][i] : two[1][i + 1]])]
                begin = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
                scores.append(overlap(np.concatenate(parts), begin, b - a))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(scores) if scores else np.empty(0))], ["a", "b", "s"])
        trim()

    found = written(met.mapInArrow(run, "a long, b long, s double"), "near-similar")
    discard(texts)
    return found


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every id in an edge (a, b): root is the smallest id that it is connected with."""
    size = lambda df: df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = written(e, "near-edges")
    state = size(e)
    while state[0]:
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = join_hot(both.where("v > u"), low, "u", 2 * state[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "near-large")
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        rest = join_hot(large, low, "u", 2 * state[0]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, e = e, written(rest.union(low.select("u", F.col("m").alias("v"))).distinct(), "near-edges")
        now = size(e)
        discard(before, large)
        if now == state:
            break
        state = now
    return e.select(F.col("u").alias("id"), F.col("v").alias("root")).union(e.select("v", "v").distinct())


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id) for every row: class_id is the smallest doc_id of the document's class."""
    every = written(keys(docs), "near-keys")
    # One document stands for all of equal text.
    stands = every.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"))
    stands = written(stands, "near-stands")
    marks = every.join(stands, ["h1", "h2"]).where("doc_id = rep").select("doc_id", F.explode("keys").alias("key"))
    buckets = marks.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    members = written(marks.join(buckets.select("key", "low"), "key").select("key", F.col("doc_id").alias("id"), F.col("low").alias("centre")).distinct(), "near-members")
    checked = verify(members.where("id <> centre").select(F.col("id").alias("a"), F.col("centre").alias("b")).distinct(), docs)
    near = checked.where(F.col("s") >= SIMILAR)
    root = written(components(near), "near-roots")
    done, open_, texts, held = checked, members, None, None
    for turn in range(ROUNDS + 1):
        left = _unsettled(open_, root, checked)
        if texts is None:
            texts = _texts(left.select("id"), docs)
            held = written(shingles(texts), "near-shingles")
        before, left = left, _linkable(left, held)
        discard(before, *([] if open_ is members else [open_]))
        open_ = left
        sizes = left.groupBy("key").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n"), F.sum(F.col("n") * F.col("n"))).first()
        if not sizes[0]:
            break
        most = LEFT * sizes[0]
        last = turn == ROUNDS or sizes[1] <= most or sizes[1] <= COMPARE * most and _across(left).count() <= most
        pairs = _across(left).distinct() if last else _stars(left, turn)
        pairs = written(pairs.join(done.select("a", "b"), ["a", "b"], "left_anti"), "near-pairs")
        found = verify(pairs, texts.withColumnRenamed("id", "doc_id"))
        before, done = done, written(done.union(found), "near-done")
        discard(pairs, *([] if before is checked else [before]))
        near = done.where(F.col("s") >= SIMILAR)
        if found.where(F.col("s") >= SIMILAR).limit(1).count():
            before, root = root, written(components(near), "near-roots")
            discard(before)
        discard(found)
        if last:
            break
    discard(members, checked, open_, texts, held, *([] if done is checked else [done]))
    own = every.select("doc_id", "h1", "h2").join(stands, ["h1", "h2"])
    own = own.join(root.withColumnRenamed("id", "rep"), "rep", "left").select("doc_id", F.coalesce("root", "rep").alias("class_id"))
    alone = docs.where("doc_id IS NULL OR text IS NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("doc_id").cast("long").alias("class_id"))
    return own.union(alone)


def _unsettled(members: DataFrame, root: DataFrame, checked: DataFrame) -> DataFrame:
    """(key, id, root, s): members of buckets that hold several classes, with the similarity to the centre."""
    known = members.drop("root").join(root, "id", "left").withColumn("root", F.coalesce("root", "id"))
    known = known.join(_several(known), "key")
    if "s" not in members.columns:
        s = checked.select(F.col("a").alias("id"), F.col("b").alias("centre"), "s")
        known = known.join(s, ["id", "centre"], "left").withColumn("s", F.coalesce("s", F.lit(1.0)))
    return written(known.select("key", "id", "root", "s"), "near-unsettled")


def _several(members: DataFrame) -> DataFrame:
    """Keys of the buckets that hold several classes."""
    return members.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("key")


def _linkable(left: DataFrame, held: DataFrame) -> DataFrame:
    """`left` with `size`, that of the text's bag, `shared`, how much of it other classes may hold, and `bins`, the same by
    bins, less members that share too little for any link and buckets that hold one class then. If an id has several
    texts, `size` is the least one's and the others are of them all."""
    roots = written(left.select("id", "root").distinct(), "near-classes")
    few = roots.count() <= MOST_IDS
    rows = written(held.join(F.broadcast(roots) if few else roots, "id"), "near-held")
    common = rows.groupBy("shingle").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count(F.lit(1)).alias("rows"))
    common = written(common.where("x < y").select("shingle", "rows"), "near-common")
    met = join_hot(rows, common, "shingle", rows.count(), "rows")
    met = met.groupBy("id", F.pmod("shingle", F.lit(BINS)).cast("int").alias("bin")).agg(F.min("size").alias("size"), F.sum("n").cast("int").alias("n"))
    met = met.groupBy("id").agg(F.min("size").alias("size"), F.sum("n").alias("shared"), F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"))
    met = met.where(F.col("shared") >= SIMILAR * F.col("size") - 1e-9)
    met = met.withColumn("bins", F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)))).drop("m")
    met = written(left.join(met, "id"), "near-met")
    out = written(met.join(_several(met), "key"), "near-linkable")
    discard(roots, rows, common, met)
    return out


def _across(left: DataFrame) -> DataFrame:
    """Pairs (a > b) of different classes that may be similar by what they share and by the triangle inequality, once for
    each bucket. Rows of small buckets meet in a join; larger ones are cut into parts of about `PART` members by a hash,
    and every two parts are compared as arrays, in a task of their own."""
    sized = left.join(left.groupBy("key").agg(F.count(F.lit(1)).alias("members")), "key")
    few = sized.where(F.col("members") <= MANY).drop("members")
    u, v = few.alias("u"), few.alias("v")
    may = (F.col("u.key") == F.col("v.key")) & (F.col("u.root") < F.col("v.root")) & (F.abs(F.col("u.s") - F.col("v.s")) <= 1 - SIMILAR + 1e-9)
    least = SIMILAR / (1 + SIMILAR) * (F.col("u.size") + F.col("v.size")) - 1e-9
    # The cheaper bound first: the other is only worked out where that one holds.
    may &= F.least("u.shared", "v.shared") >= least
    may &= F.aggregate(F.zip_with("u.bins", "v.bins", lambda x, y: F.least(x, y)), F.lit(0), lambda total, x: total + x) >= least
    met = u.join(v, may).select(F.greatest("u.id", "v.id").alias("a"), F.least("u.id", "v.id").alias("b"))
    short_batches(left.sparkSession)
    parts = F.ceil(F.col("members") / PART).cast("int")
    many = sized.where(F.col("members") > MANY).withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int"))
    many = many.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    many = many.select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "id", "root", "s", "size", "shared", "bins")
    return met.union(many.groupBy("key", "i", "j").applyInArrow(_compare, "a long, b long"))


def _compare(rows: pa.Table) -> pa.Table:
    """The pairs of `_across` between parts i and j of a bucket; i = j: inside of it."""
    part, ids, root, s, size, shared = (rows.column(c).to_numpy() for c in ("part", "id", "root", "s", "size", "shared"))
    bins = rows.column("bins").combine_chunks().flatten().to_numpy().reshape(-1, BINS)
    low, high = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
    one, two = np.flatnonzero(part == low), np.flatnonzero(part == high)
    found = [np.empty((2, 0), np.int64)]
    half = SIMILAR / (1 + SIMILAR)
    for at in range(0, len(one), ROWS_AT_ONCE):
        u = one[at : at + ROWS_AT_ONCE]
        may = (root[u][:, None] != root[two]) & (np.abs(s[u][:, None] - s[two]) <= 1 - SIMILAR + 1e-9)
        may &= np.minimum(shared[u][:, None], shared[two]) >= half * (size[u][:, None] + size[two]) - 1e-9
        if low == high:
            may &= u[:, None] < two
        x, y = np.nonzero(may)
        for k in range(0, len(x), PAIRS_AT_ONCE):
            p, q = u[x[k : k + PAIRS_AT_ONCE]], two[y[k : k + PAIRS_AT_ONCE]]
            ok = np.minimum(bins[p], bins[q]).sum(axis=1) >= half * (size[p] + size[q]) - 1e-9
            found.append(np.stack([ids[p[ok]], ids[q[ok]]]))
    pairs = np.concatenate(found, axis=1)
    return pa.table({"a": pairs.max(axis=0), "b": pairs.min(axis=0)})


def _stars(left: DataFrame, turn: int) -> DataFrame:
    """Each bucket's members against another centre, the one with the smallest hash in this turn, of another class."""
    order = F.struct(F.xxhash64(F.lit(turn), "id").alias("h"), "id", "root")
    centre = left.groupBy("key").agg(F.min(order).alias("c"))
    met = left.join(centre, "key").where("root <> c.root")
    return met.select(F.greatest("id", "c.id").alias("a"), F.least("id", "c.id").alias("b")).distinct()


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay: of each class the smallest doc_id, once."""
    stay = classes(docs).where("doc_id = class_id").select(F.col("doc_id").alias("_stay")).distinct()
    met = docs.join(stay.hint("shuffle_hash"), F.col("doc_id").cast("long") == F.col("_stay"), "left_semi")
    met = met.withColumn("_nth", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text")))).where("_nth = 1").drop("_nth")
    return met.union(docs.where("doc_id IS NULL"))
