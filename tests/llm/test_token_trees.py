import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.test_bpe import ALPHABET, EDGE
from versalake.llm import bpe, token_trees
from versalake.llm.common import tokenizer_path

SCHEMA = "doc_id long, text string, counts string, lang string"
EDITS = "doc_id long, seq long, start long, length long, replacement string"


@pytest.fixture(scope="module")
def count():
    library = Tokenizer.from_file(tokenizer_path())
    return lambda text: len(library.encode(text, add_special_tokens=False).ids)


def random_text(rng, n):
    return "".join(rng.choice(ALPHABET) for _ in range(n))


@pytest.mark.parametrize("leaf", [1, 3, 32])
def test_edits_against_encoding_anew(count, monkeypatch, leaf):
    monkeypatch.setattr(token_trees, "LEAF", leaf)
    coder, rng = bpe.load(tokenizer_path()), random.Random(leaf)
    for _ in range(60):
        text = random_text(rng, rng.choice([0, 1, 5, 60, 300]))
        raw = text.encode()
        spans, counts = token_trees.leaves_of(coder, np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]
        tree = token_trees.Tree(coder, raw, token_trees.sums(spans), token_trees.sums(counts))
        for _ in range(12):
            at, n, new = rng.randint(-1, len(text) + 2), rng.choice([0, 1, 2, 9, 40]), random_text(rng, rng.choice([0, 1, 2, 8, 50]))
            tree.edit(at, n, new)
            at = max(at, 0)
            text = text[:at] + new + text[at + n :]
            assert tree.text.decode() == text
            assert tree.counts[1] == count(text), (text, at, n, new)
            assert tree.spans[1] == len(text.encode())
            size = len(tree.counts) // 2
            assert all(tree.counts[i] == tree.counts[2 * i] + tree.counts[2 * i + 1] for i in range(1, size))


def test_small_edits_encode_little():
    coder = bpe.load(tokenizer_path())
    raw = ("some words here and there " * 4000).encode()
    spans, counts = token_trees.leaves_of(coder, np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]
    tree = token_trees.Tree(coder, raw, token_trees.sums(spans), token_trees.sums(counts))
    tree.edit(50_000, 5, "other")
    assert tree.encoded < 1000


def test_recount(spark, count):
    rng = random.Random(2)
    texts = [None, *EDGE, "card 4304158793483661 and 123456789\n4304158793483661", "12345678", "é 1234567890", *(random_text(rng, 80) + str(10**12) + random_text(rng, 9) for _ in range(30))]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], SCHEMA).repartition(3)
    got = {r.doc_id: r for r in token_trees.recount(docs, tokenizer_path()).collect()}
    import re

    for i, t in enumerate(texts):
        after = re.sub("[0-9]{9,}", "[number]", t or "")
        assert (got[i].n_tokens, got[i].n_tokens_after, got[i].n_edits) == (count(t or ""), count(after), len(re.findall("[0-9]{9,}", t or "")))
        assert got[i].n_bytes == len((t or "").encode())


def test_edit_tables(spark, count, monkeypatch):
    docs = spark.createDataFrame([(1, "hello world", "", "a"), (1, "hello world", "", "a"), (2, None, "", None), (3, "untouched", "", "")], SCHEMA)
    edits = spark.createDataFrame([(1, 1, 0, 5, "good bye"), (1, 2, 9, 5, None), (2, 0, None, None, "new"), (9, 0, 0, 0, "x"), (2, 1, 100, 1, "!")], EDITS)
    for most in (0, 1000):
        monkeypatch.setattr(token_trees, "MOST_EDITS", most)
        done = token_trees.apply(token_trees.build(token_trees.with_edits(docs, edits), tokenizer_path()), tokenizer_path())
        assert "lang" in done.columns
        assert sorted((r.doc_id, r.text, r.counts[1]) for r in done.collect()) == sorted((i, t, count(t or "")) for i, t in [(1, "good bye "), (1, "good bye "), (2, "new!"), (3, "untouched")])
    assert token_trees.recount(docs.limit(0), tokenizer_path()).count() == 0
    assert token_trees.recount(docs, tokenizer_path(), edits.limit(0)).agg(F.sum("n_encoded")).first()[0] == 0


def test_recount_of_repeated_rows(spark, count):
    one, other = "card 4304158793483661 and 123456789 more", "x 999999999999"
    docs = spark.createDataFrame([(1, one), (1, one), (1, other), (1, "plain"), (2, other)], "doc_id long, text string").repartition(3)
    got = token_trees.recount(docs, tokenizer_path()).collect()
    want = [(1, one, 2), (1, one, 2), (1, other, 1), (1, "plain", 0), (2, other, 1)]
    after = lambda text: count(re.sub("[0-9]{9,}", "[number]", text))
    assert sorted((r.doc_id, r.n_tokens, r.n_edits, r.n_tokens_after) for r in got) == sorted((i, count(t), n, after(t)) for i, t, n in want)


def test_registered_edits(spark, count):
    from versalake.llm import queries

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", token_trees.workload().alias("edits"))
    got = {r.doc_id: r for r in queries.QUERIES["op1_token_edits"](spark, sf).collect()}
    rows = docs.collect()
    assert sum(r.n_edits > 0 for r in got.values()) > 0.8 * len(rows) == 0.8 * len(got)
    edits = [e for r in rows for e in r.edits or []]
    assert any(e.length == 0 for e in edits) and any(not e.replacement for e in edits) and any(e.start is None for e in edits)
    for r in rows:
        text = r.text or ""
        for e in r.edits or []:
            at = len(text) if e.start is None else e.start
            text = text[:at] + (e.replacement or "") + text[at + e.length :]
        assert (got[r.doc_id].n_tokens, got[r.doc_id].n_tokens_after) == (count(r.text or ""), count(text))
