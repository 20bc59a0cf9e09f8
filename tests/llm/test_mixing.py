import random

import pytest

from versalake.llm import mixing

SCHEMA = "doc_id long, source string, text string, size string"


def corpus(n=400):
    rng = random.Random(3)
    return [(i, rng.choice(["hot"] * 6 + ["b", "a", "zß", None]), rng.choice([None, "", " \n", "one"] + ["w " * rng.randint(1, 60)] * 8), "clash") for i in range(n)]


def brute(rows, weights=(3, 1, 2), share=1.5):
    size = {r[0]: len((r[2] or "").split()) for r in rows}
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is None, s))
    total = {s: sum(size[r[0]] for r in rows if r[1] == s) for s in sources}
    weight = {s: weights[i % 3] for i, s in enumerate(sources)}
    budget, target, open_ = share * sum(total.values()), {}, set(sources)
    while open_:
        w = sum(weight[s] for s in open_)
        over = [s for s in open_ if budget * weight[s] / w > 2 * total[s]]
        if not over:
            target |= {s: budget * weight[s] / w for s in open_}
            break
        for s in over:
            target[s] = 2 * total[s]
            open_.discard(s)
        budget -= sum(2 * total[s] for s in over)
    return size, total, target


def test_targets_and_decisions(spark):
    rows = corpus()
    size, total, target = brute(rows)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = mixing.mix(docs).collect()
    assert sorted(r.doc_id for r in got) == [r[0] for r in rows]
    largest, taken = max(size.values()), dict.fromkeys(total, 0)
    for r in got:
        assert r["size"] == size[r.doc_id] and r.source_size == total[r.source]
        assert r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 2 * r["size"] and r.taken == r.copies * r["size"]
        taken[r.source] += r.taken
    for s in total:
        assert abs(taken[s] - target[s]) <= 2 * largest
    assert sum(taken.values()) <= 1.5 * sum(total.values())
    assert {(r.doc_id, r.taken) for r in mixing.mix(docs.repartition(2)).collect()} == {(r.doc_id, r.taken) for r in got}
    out = mixing.apply(docs, mixing.mix(docs))
    assert out.columns == docs.columns
    assert out.count() == sum(r.copies for r in got)


def test_edges(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    none = mixing.mix(spark.createDataFrame([(1, "a", None, ""), (2, None, "", "")], SCHEMA)).collect()
    assert [(r.taken, r.target) for r in none] == [(0, 0.0), (0, 0.0)]
    same = spark.createDataFrame([(1, "a", "x y", "")] * 3 + [(None, "b", "z " * 20000, "")] * 2, SCHEMA)
    got = mixing.mix(same)
    assert got.count() == 5
    assert mixing.apply(same, got).count() == sum(r.copies for r in got.collect())
