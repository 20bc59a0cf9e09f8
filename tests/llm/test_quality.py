import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from versalake.llm import quality

SCHEMA = "doc_id long, text string, score string"


def corpus():
    rng = random.Random(6)
    words = ["the", "of", "and", "ähnlich", "x|y", "$5", "*", "日本"]
    texts = [None, "", " \n\t", "one", "a b c d e", "a b c d e a b c d e", "same line\nsame line\n\nsame line ", "w " * 3000, ("p q r s t u v " * 4 + "\n") * 3]
    texts += ["".join(rng.choice(words) + rng.choice([" ", "  ", "\n", "\t", "\x0b", " "]) for _ in range(rng.randint(1, 80))) for _ in range(150)]
    return [(i, t, "clash") for i, t in enumerate(texts)]


def brute_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n


def test_base_columns(spark):
    rows = corpus()
    got = quality.base(spark.createDataFrame(rows, SCHEMA), "doc_id").collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_base(rows[r.doc_id][1]), rows[r.doc_id]


def test_scores_against_a_recount(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(r[0], 1, 0) for r in rows[::3]] + [(1, 0, 0), (2, 1, 1), (10, 1, 0)], "doc_id long, quality int, toxic int")
    ratios = quality.model(docs, labels)
    seen = quality.features(docs, F.col("doc_id")).collect()
    raw, good = Counter(r.bucket for r in seen), Counter(r.bucket for r in seen if r.doc_id in {x[0] for x in rows[::3]} | {10})
    n, g = raw.total() + quality.BUCKETS, good.total() + quality.BUCKETS
    want = {b: math.log((good[b] + 1) / g) - math.log((c + 1) / n) for b, c in raw.items()}
    assert {r.bucket: r.ratio for r in ratios.collect()} == pytest.approx({b: v * 1e6 for b, v in want.items()}, abs=1)
    mine: dict = {}
    for r in seen:
        mine.setdefault(r.doc_id, []).append(want[r.bucket])
    got = {r.doc_id: r for r in quality.judge(docs, ratios).collect()}
    assert len(got) == len(rows)
    for i, v in mine.items():
        assert got[i].score == pytest.approx(sum(v) / len(v), abs=1e-6)
        assert got[i].kept == (not got[i].base_failed and got[i].score >= quality.THRESHOLD)
    assert not any(got[i].kept for i in (0, 1, 2))


def test_separates_and_is_native(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.judge(docs, quality.model(docs, labels))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    met = got.join(labels, "doc_id").where("n_words >= 10").collect()
    assert sum(r.kept for r in met if r.quality == 1) >= 0.98 * sum(r.quality == 1 for r in met)
    assert sum(r.kept for r in met if r.quality == 0) <= 0.1 * sum(r.quality == 0 for r in met)


def test_empty_and_repeated(spark):
    none = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.judge(none, quality.model(none, labels)).count() == 0
    twice = spark.createDataFrame([(1, "a b c d e f g h i j k", "")] * 2 + [(None, "a b c d e f g h i j k", "")], SCHEMA)
    got = quality.judge(twice, quality.model(twice, labels)).collect()
    assert len(got) == 3 and len({r.score for r in got}) == 1
