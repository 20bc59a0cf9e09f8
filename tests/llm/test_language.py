import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from versalake.llm import bpe, language

DATA = "/root/testdata/sf0.01/documents.parquet"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(DATA)
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 150
    assert sum(r.lang_pred == r.lang for r in got) / len(got) >= 0.98
    assert all(0 <= r.score <= 1 for r in got)
    assert sum(r.rejected for r in got) <= 0.01 * len(got)


def test_predictions_use_the_text_alone(spark):
    docs = spark.read.parquet(DATA)
    model = language.fit(docs.select("doc_id", "text", "lang"))
    plain = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(docs, model).collect()}
    blind = docs.withColumns({"lang": F.lit("xx"), "source": F.lit("q"), "doc_id": F.col("doc_id") + 10**6})
    assert {r.doc_id - 10**6: (r.lang_pred, r.score) for r in language.predict(blind, model).collect()} == plain


def test_edges(spark):
    docs = spark.read.parquet(DATA)
    model = language.fit(docs.select("doc_id", "text", "lang"))
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 .. 9"), (4, "the"), (5, "the of and " * 200_000), (6, "a")], "score long, text string")
    got = {r.text: r for r in language.predict(odd, model).collect()}
    assert [got[t].lang_pred for t in (None, "", "12 .. 9")] == ["und"] * 3
    assert all(got[t].rejected and got[t].score == 0 for t in (None, "", "12 .. 9"))
    assert got["the of and " * 200_000].lang_pred == "en"
    assert language.fit(docs.select("doc_id", "text", F.lit(None).cast("string").alias("lang"))) is None
    assert {r.lang_pred for r in language.predict(odd, None).collect()} == {"und"}
    assert language.predict(odd.limit(0), model).count() == 0


def test_table_gives_the_average_of_embeddings():
    texts = ["Hello there", "x", "", "ño ño", "Hello there, Hello " * 500]
    units, table = np.random.default_rng(0).integers(-(2**22), 2**22, size=(2, language.BUCKETS, 2))
    model = language.Model(["a", "b"], units, table, np.array([0.1, -0.2]))
    found = language.features(pa.array(texts))
    logits, known, count = model.score(*bpe.column_bytes(pa.array(texts)))
    want = np.array([s.astype(np.float64) @ (units[a] * language.UNIT) for _, a, s in found]) + model.bias
    np.testing.assert_allclose(logits, want, rtol=1e-4, atol=1e-5)
    np.testing.assert_allclose(known, [s.astype(np.float64) @ (table[a, z.argmax()] * language.UNIT) for (_, a, s), z in zip(found, want)], rtol=1e-4, atol=1e-5)
    assert count.tolist() == [n for n, _, _ in found]


def test_scores_are_the_same_in_any_batch(spark):
    docs = spark.read.parquet(DATA).select("doc_id", "text", "lang")
    model = language.fit(docs)
    got = {r.doc_id: (r.lang_pred, r.score, r.rejected) for r in language.predict(docs, model).collect()}
    assert {r.doc_id: (r.lang_pred, r.score, r.rejected) for r in language.predict(docs.orderBy(F.rand(3)).repartition(5), model).collect()} == got
    rows = docs.where("doc_id % 10 = 0").collect()
    for r in rows:
        logits, known, count = model.score(*bpe.column_bytes(pa.array([r.text])))
        p = model.probabilities(logits)
        assert got[r.doc_id][1:] == (p.max(), bool(model.rejects(p.max(axis=1), known, count)[0]))


def test_descent_against_brute_force(monkeypatch):
    monkeypatch.setattr(language, "EPOCHS", 3)
    rng = np.random.default_rng(2)
    rows = []
    for i in range(60):
        at = np.sort(rng.choice(500, 40, replace=False))
        share = rng.random(40)
        rows.append((i % 3, at, (share / share.sum()).astype(np.float32)))
    got = language.descend(rows, 3)
    rng = np.random.default_rng(language.SEED)
    embedding = [[float(x) for x in r] for r in rng.normal(0, 0.1, (language.BUCKETS, language.DIM)).astype(np.float32)]
    layer = [[float(x) for x in r] for r in rng.normal(0, 0.1, (language.DIM, 3)).astype(np.float32)]
    bias, dims = [0.0] * 3, range(language.DIM)
    for epoch in range(3):
        rate = language.RATE * (1 - epoch / 3)
        for i in rng.permutation(60):
            lang, at, share = rows[i]
            mean = [sum(float(s) * embedding[b][d] for b, s in zip(at, share)) for d in dims]
            z = [sum(mean[d] * layer[d][c] for d in dims) + bias[c] for c in range(3)]
            e = [math.exp(x) for x in z]
            error = [x / sum(e) - (c == lang) for c, x in enumerate(e)]
            back = [sum(layer[d][c] * error[c] for c in range(3)) for d in dims]
            for c in range(3):
                bias[c] -= rate * 0.1 * error[c]
                for d in dims:
                    layer[d][c] -= rate * mean[d] * error[c]
            for b, s in zip(at, share):
                for d in dims:
                    embedding[b][d] -= rate * min(50, len(at)) * float(s) * back[d]
    for x, y in zip(got, (embedding, layer, bias)):
        np.testing.assert_allclose(x, np.array(y), rtol=2e-3, atol=2e-4)


ALIEN = {
    "it": "La ricerca della felicità è un diritto di ogni persona, e lo Stato deve garantire che tutti possano vivere con dignità nella propria casa.",
    "ru": "Вчера вечером мы гуляли по набережной и долго разговаривали о том, как изменился наш город за последние десять лет.",
    "ja": "昨日の夜、私たちは川沿いを歩きながら、この十年間で町がどのように変わったかについて長い間話し合いました。",
    "keys": "asdkjh qwoeiru zxmcnb alskdjf qpwoeiruty mznxbcv lkajsdhf qowieury zmxncbv poiuqwer lkjhasdf mnbvzxcv qazwsx edcrfv",
    "base64": "aGVsbG8gd29ybGQgdGhpcyBpcyBhIHRlc3Qgb2YgYmFzZTY0IGVuY29kaW5nIHdpdGggcmFuZG9tIGNvbnRlbnQ4c2RmODdzZGY4N3NkZjg3c2Rm",
}


def test_unknown_languages_and_junk_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = language.fit(docs.where(~language.held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    assert np.isfinite(model.odds[4:]).all() and np.isfinite(model.familiar[4:]).all()
    odd = spark.createDataFrame([(k, t * n) for k, t in ALIEN.items() for n in (1, 20)], "name string, text string")
    assert all(r.rejected for r in language.predict(odd, model).collect())
    # What is in a learned language stays, whole or in short pieces.
    held = docs.where(language.held_out(F.col("doc_id"))).select("doc_id", "text")
    whole = language.predict(held, model).collect()
    assert sum(r.rejected for r in whole) <= 0.002 * len(whole)
    for n in (20, 60, 200):
        cut = language.predict(held.select("doc_id", F.substring("text", 30, n).alias("text")).where(F.length("text") == n), model).collect()
        assert sum(r.rejected for r in cut) <= 0.02 * len(cut), n


def test_null_ids_repeated_rows_and_tiny_tables(spark):
    docs = spark.read.parquet(DATA).select("doc_id", "text", "lang").limit(40)
    odd = docs.union(docs).union(docs.select(F.lit(None).cast("long"), "text", "lang"))
    got = language.identify(odd).collect()
    assert len(got) == 120 and all(r.held_out is False for r in got if r.doc_id is None) and None not in {r.held_out for r in got}
    assert language.identify(docs.limit(0)).count() == 0
    one = spark.createDataFrame([(1, "only one text", "en"), (2, "x", None)], docs.schema)
    assert {r.lang_pred for r in language.predict(one, language.fit(one)).collect()} == {"en"}
