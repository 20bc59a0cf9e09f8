import hashlib
from collections import Counter

from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm import test_line_dedup, test_mixing, test_near_dedup
from versalake.llm import language
from versalake.llm.common import tokenizer_path

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(10**6, None, "en", "src0", 0), (10**6 + 1, "123 456", "en", "src1", 7), (10**6 + 2, "", None, None, 0)], docs.schema)
    docs = docs.union(odd)
    rows = {r.doc_id: r for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)

    model = language.fit(docs.where(~language.held_out(docs.doc_id)).select("doc_id", "text", "lang"))
    rejected = {r.doc_id for r in language.predict(docs, model).collect() if r.rejected}
    first = stages["language"](spark, docs, SF)
    assert first.columns == docs.columns
    kept = {r.doc_id: r for r in first.collect()}
    assert kept.keys() == rows.keys() - rejected and {10**6, 10**6 + 1, 10**6 + 2} <= rejected
    assert len(rejected) < 0.05 * len(rows)

    second = stages["line_dedup"](spark, first, SF)
    lines = {r.doc_id: r for r in second.collect()}
    want = test_line_dedup.brute([(i, r.text) for i, r in kept.items()])
    assert second.columns == docs.columns
    assert {i: r.text for i, r in lines.items()} == {i: w[2] for i, w in want.items()}
    assert all(r.n_chars == len(r.text) for r in lines.values())

    third = stages["near_dedup"](spark, second, SF)
    classes = test_near_dedup.brute([(i, r.text) for i, r in sorted(lines.items())])
    assert third.columns == docs.columns
    assert sorted(r.doc_id for r in third.collect()) == sorted(set(classes.values()))

    fourth = stages["mix"](spark, third, SF)
    taken = Counter(r.doc_id for r in fourth.collect())
    size, total, target = test_mixing.brute([(r.doc_id, r.source, r.text) for r in third.collect()])
    assert fourth.columns == docs.columns and max(taken.values()) <= 2
    for s in total:
        assert abs(sum(size[i] * n for i, n in taken.items() if rows[i].source == s) - target[s]) <= 2 * max(size.values())

    library = Tokenizer.from_file(tokenizer_path())
    out = stages["bpe"](spark, fourth, SF).collect()
    assert Counter(r.doc_id for r in out) == taken
    for r in out:
        assert r.ids == library.encode(lines[r.doc_id].text, add_special_tokens=False).ids and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(lines[r.doc_id].text.encode()).hexdigest()


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "n_tokens", "ids"} <= set(out.columns)
    assert out.count() > 0
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0
