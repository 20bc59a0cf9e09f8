"""Language identification (operator 5): averaged hashed subword embeddings with a linear softmax.

A text is the average of the embeddings of its subwords: byte 3- and 4-grams of its UTF-8 with A-Z lower-cased,
digits dropped to one sign, hashed into `BUCKETS` rows. A linear layer and a softmax follow. Embeddings and layer are
trained together by stochastic gradient descent in numpy on the driver, on a sample of labelled rows that is bounded
by `PER_LANG` rows a language, of the `LANGUAGES` most frequent (chosen by a hash; whole texts, of which only bucket
frequencies reach the driver: at most BUCKETS numbers a row).

*Calibrated rejection.* A fifth of the sample is held back, whole and cut into pieces of `PIECES` bytes. It sets the
softmax's temperature and, for each length (a power of two of subwords), two thresholds: on the calibrated probability of
the language, and on the text's familiarity, the mean log-frequency of its subwords in that language. Both are the
values under which a share of `COST` of what is in a learned language would fall, read off the tail of the held-back
pieces: a quantile that is too rare to count is continued from the two before it. Below either a text is rejected.

After training, embedding and layer are one table of BUCKETS x languages logits, beside one of log-frequencies, in whole
2^-20s. A text's sums are therefore exact: its score depends on the text alone, however rows are partitioned or batched.
Every document is scored over its whole text.

Null texts and texts without a letter are `und` with score 0, and rejected. No labelled row at all: every document is
`und`. Rows whose lang is null are not learned from; equal rows (doc_id, lang, text) are learned from once. A null
doc_id is not held out. Other columns are kept by `predict`; columns lang_pred, score and rejected are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from versalake.llm import bpe
from versalake.llm.common import short_batches, trim

#: Bytes of text that are scored at a time.
SLICE = 1 << 18
BUCKETS, DIM, PER_LANG, EPOCHS, RATE, SEED = 1 << 14, 16, 600, 12, 0.5, 7
LANGUAGES = 1000
#: Share of texts in a learned language that each rejection threshold may cost.
COST = 1e-4
#: Bytes of the pieces that held-back texts are cut into, and the fewest pieces that set a threshold.
PIECES, FEWEST = (12, 24, 48, 96, 192, 384, 768), 100
#: Weight of the even distribution in log-frequencies.
LEAST = 0.005
#: Logits and log-frequencies are held in whole parts of this size.
UNIT = 2.0**-20
UND = "und"

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[48:58] = 48
_FOLD[9:14] = 32


def _grams(data: np.ndarray, begin: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each gram length: the bucket at every byte, and which bytes start a gram that ends inside its text."""
    folded = _FOLD[data]
    room = np.repeat(begin[1:], np.diff(begin)) - np.arange(len(data))
    for n in (3, 4):
        if len(data) < n:
            continue
        h = np.zeros(len(data) - n + 1, np.uint32)
        for i in range(n):
            h = h * np.uint32(0x01000193) ^ folded[i : len(folded) - n + 1 + i] * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        yield h >> np.uint32(32 - BUCKETS.bit_length() + 1), room[: len(h)] >= n


def features(column) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """For each text: how many subwords, their buckets and the frequencies of these."""
    out = []
    data, begin = bpe.column_bytes(column)
    for a, b in zip(begin, begin[1:]):
        grams = [h[ok] for h, ok in _grams(data[a:b], np.array([0, b - a]))]
        found, counts = np.unique(np.concatenate(grams) if grams else np.empty(0, np.uint32), return_counts=True)
        out.append((int(counts.sum()), found.astype(np.int64), (counts / max(1, counts.sum())).astype(np.float32)))
    return out


def pieces(text: str) -> list[str]:
    """Two parts of each of the lengths in `PIECES` that the text exceeds, at places that its own hash picks."""
    raw, out = text.encode(), []
    for n in PIECES:
        for turn in (0, 1):
            if len(raw) > n:
                at = zlib.crc32(raw, 2 * n + turn) % (len(raw) - n)
                out.append(raw[at : at + n].decode("utf-8", "ignore"))
    return out


def length_class(count: np.ndarray) -> np.ndarray:
    """The power of two in a number of subwords."""
    return np.log2(np.maximum(count, 1)).astype(np.int64)


def tail(values: np.ndarray, cost: float = COST) -> float:
    """The value that a share of `cost` falls below. A tail loses about the same with each decade, so that from the tenth
    to the hundredth part is continued."""
    tenth, hundredth = np.quantile(values, [0.1, 0.01])
    return float(hundredth - (tenth - hundredth) * (np.log10(0.01) - np.log10(cost)))


@dataclass
class Model:
    languages: list[str]
    units: np.ndarray  # BUCKETS x languages, in UNIT: embedding times layer
    known: np.ndarray  # BUCKETS x languages, in UNIT: log-frequencies
    bias: np.ndarray
    temperature: float = 1.0
    #: For each length class: log-odds and familiarity below which a text is rejected.
    odds: np.ndarray = field(default_factory=lambda: np.full(1, -np.inf))
    familiar: np.ndarray = field(default_factory=lambda: np.full(1, -np.inf))

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def score(self, data: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logits, familiarity in the likeliest language and number of subwords of the texts data[begin[i]:begin[i + 1]]."""
        texts, grams = len(begin) - 1, []
        for h, ok in _grams(data, begin):
            spots = np.flatnonzero(ok)
            grams.append((h[spots], np.searchsorted(spots, begin)))
        count = sum((np.diff(at) for _, at in grams), np.zeros(texts, np.int64))

        def mean(pick) -> np.ndarray:
            total = np.zeros(texts, np.int64)
            for h, at in grams:
                sums = np.zeros(len(h) + 1, np.int64)
                np.cumsum(pick(h, at), out=sums[1:])
                total += np.diff(sums[at])
            return total * UNIT / np.maximum(count, 1)

        logits = np.stack([mean(lambda h, _, j=j: self.units[:, j][h]) for j in range(len(self.languages))], axis=1) + self.bias
        best = logits.argmax(axis=1)
        return logits, mean(lambda h, at: self.known[h, np.repeat(best, np.diff(at))]), count

    def rejects(self, top: np.ndarray, familiarity: np.ndarray, count: np.ndarray) -> np.ndarray:
        at = np.minimum(length_class(count), len(self.odds) - 1)
        return (log_odds(top) < self.odds[at]) | (familiarity < self.familiar[at])


def log_odds(p: np.ndarray) -> np.ndarray:
    return np.log(np.maximum(p, 1e-15)) - np.log(np.maximum(1 - p, 1e-15))


def descend(fit: list[tuple[int, np.ndarray, np.ndarray]], languages: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stochastic gradient descent over (language, buckets, frequencies): embedding, layer and bias."""
    rng = np.random.default_rng(SEED)
    embedding = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    layer, bias = rng.normal(0, 0.1, (DIM, languages)).astype(np.float32), np.zeros(languages, np.float32)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in rng.permutation(len(fit)):
            lang, at, share = fit[i]
            if not len(at):
                continue
            mean = share @ embedding[at]
            z = mean @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[lang] -= 1
            back = layer @ p
            layer -= rate * np.outer(mean, p)
            bias -= rate * 0.1 * p
            # A text's buckets share its step evenly by frequency; frequencies are small, so the step is scaled up.
            embedding[at] -= (rate * min(50.0, len(at))) * share[:, None] * back
    return embedding, layer, bias


def train(rows: list[tuple[str, bool, int, np.ndarray, np.ndarray]]) -> Model:
    """rows: language, whether it is held back to calibrate, number of subwords, buckets, frequencies."""
    languages = sorted({r[0] for r in rows})
    number = {x: i for i, x in enumerate(languages)}
    fit = [(number[lang], at, share) for lang, held, _, at, share in rows if not held]
    if len(fit) < 4 * len(languages):  # too few to hold any back
        fit = [(number[lang], at, share) for lang, _, _, at, share in rows]
    embedding, layer, bias = descend(fit, len(languages))
    logits = (embedding @ layer).astype(np.float64)
    seen = np.zeros((BUCKETS, len(languages)))
    for lang, at, share in fit:
        seen[at, lang] += share
    seen /= np.maximum(seen.sum(axis=0), 1e-9)
    units = np.rint(np.clip(logits, -1e3, 1e3) / UNIT).astype(np.int64)
    known = np.rint((np.log(seen + LEAST / BUCKETS) - np.log(1 + LEAST)) / UNIT).astype(np.int64)
    model = Model(languages, units, known, bias.astype(np.float64))
    held = [r for r in rows if r[1] and len(r[3])] or [r for r in rows if len(r[3])]
    if not held:
        return model
    z = np.array([share.astype(np.float64) @ (units[at] * UNIT) for _, _, _, at, share in held]) + model.bias
    familiarity = np.array([share.astype(np.float64) @ (known[at, x.argmax()] * UNIT) for (_, _, _, at, share), x in zip(held, z)])
    want, count = np.array([number[r[0]] for r in held]), np.array([r[2] for r in held])

    def loss(t: float) -> float:
        model.temperature = t
        return -np.log(np.maximum(model.probabilities(z)[np.arange(len(z)), want], 1e-12)).mean()

    model.temperature = min(np.geomspace(0.01, 100, 161), key=loss)
    p = model.probabilities(z)
    odds, right, size = log_odds(p.max(axis=1)), p.argmax(axis=1) == want, length_class(count)
    model.odds, model.familiar = np.full(size.max() + 1, -np.inf), np.full(size.max() + 1, -np.inf)
    for c in range(len(model.odds)):
        mine = right & (size == c)
        if mine.sum() >= FEWEST:
            model.odds[c], model.familiar[c] = tail(odds[mine]), tail(familiarity[mine])
        elif c:  # too few pieces of this length: what holds for shorter ones
            model.odds[c], model.familiar[c] = model.odds[c - 1], model.familiar[c - 1]
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(labelled: DataFrame, per_lang: int = PER_LANG) -> Model | None:
    """Learns from rows (doc_id, text, lang). The sample's rows are those with the smallest hashes: the threshold for
    each language follows from its number of rows, so about `per_lang` rows come and never more than twice that."""
    short_batches(labelled.sparkSession)
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL")
    luck = F.pmod(F.xxhash64(F.lit("language"), "doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()}
    if not counts:
        return None
    share = F.create_map(*(x for k, n in counts.items() for x in (F.lit(k), F.lit(per_lang / n))))
    # Equal rows share a hash: without repetitions no more than about per_lang rows a language can come.
    sample = rows.where(luck < F.element_at(share, F.col("lang"))).select("doc_id", "lang", "text").dropDuplicates()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, lang, text in zip(batch.column(0), batch.column(1), batch.column(2).to_pylist()):
                held = zlib.crc32(text.encode()) % 5 == 0
                parts = [text, *(pieces(text) if held else [])]
                found = features(pa.array(parts, pa.string()))
                n = len(parts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([doc_id.as_py()] * n, doc_id.type),
                        pa.array([lang.as_py()] * n, lang.type),
                        pa.array([held] * n),
                        pa.array(range(n), pa.int32()),
                        pa.array([c for c, _, _ in found], pa.int64()),
                        pa.array([a.astype(np.uint16).tobytes() for _, a, _ in found]),
                        pa.array([s.tobytes() for _, _, s in found]),
                    ],
                    ["doc_id", "lang", "held", "piece", "n", "at", "share"],
                )

    kinds = [("held", T.BooleanType()), ("piece", T.IntegerType()), ("n", T.LongType()), ("at", T.BinaryType()), ("share", T.BinaryType())]
    got = sample.mapInArrow(run, T.StructType([labelled.schema["doc_id"], labelled.schema["lang"], *(T.StructField(*k) for k in kinds)]))
    table = got.collect()
    table.sort(key=lambda r: (str(r.doc_id), r.lang, r.piece, bytes(r.at)))
    taken: dict[tuple[str, int], int] = {}
    rows_ = []
    for r in table:
        taken[r.lang, r.piece] = taken.get((r.lang, r.piece), 0) + 1
        if taken[r.lang, r.piece] <= 2 * per_lang:
            rows_.append((r.lang, r.held, r.n, np.frombuffer(r.at, np.uint16), np.frombuffer(r.share, np.float32)))
    model = train(rows_) if rows_ else None
    del got, table, rows_
    trim()  # the driver's Python outlives the training rows
    return model


def predict(docs: DataFrame, model: Model | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds lang_pred, score (the calibrated probability) and rejected (`und`, or too unlikely or too unfamiliar a text)."""
    short_batches(docs.sparkSession)
    new = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    kept = [c for c in (keep or docs.columns) if c not in {f.name for f in new}]
    rows = docs.select(*kept, F.col(text).alias("_text"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("_letter"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, begin = bpe.column_bytes(batch.column("_text"))
            letter = np.asarray(batch.column("_letter").to_numpy(zero_copy_only=False), bool)
            if model is None:
                letter = np.zeros(len(letter), bool)
            langs, scores, reject = np.full(len(letter), UND, object), np.zeros(len(letter)), ~letter
            if model is not None and len(letter):
                parts = [model.score(data[begin[a] : begin[b]], begin[a : b + 1] - begin[a]) for a, b in bpe.slices(np.diff(begin), SLICE)]
                logits, known, count = (np.concatenate(x) for x in zip(*parts))
                p = model.probabilities(logits)
                langs = np.where(letter, np.array(model.languages, object)[p.argmax(axis=1)], UND)
                scores = np.where(letter, p.max(axis=1), 0.0)
                reject = ~letter | model.rejects(p.max(axis=1), known, count)
            columns = [*(batch.column(c) for c in kept), pa.array(langs.tolist(), pa.string()), pa.array(scores, pa.float64()), pa.array(reject)]
            yield pa.RecordBatch.from_arrays(columns, [*kept, "lang_pred", "score", "rejected"])
        trim()

    return rows.mapInArrow(run, T.StructType([*(docs.schema[c] for c in kept), *new]))


def identify(docs: DataFrame) -> DataFrame:
    """Learns from the documents that aren't held out, predicts all: doc_id, held_out, lang_pred, score, rejected."""
    model = fit(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    got = predict(docs, model, keep=["doc_id"])
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
