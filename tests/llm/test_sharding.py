import itertools
import random
import zlib
from collections import Counter, defaultdict

import pytest

from versalake.llm import common, sharding

SCHEMA = "doc_id long, text string, shard string"


def test_differencing_beats_greedy_and_keeps_sums():
    rng = random.Random(1)
    sizes = [rng.randint(1, 10_000) for _ in range(500)]
    where, sums = sharding.difference([[s] + [0] * 15 for s in sizes])
    real = [0] * 16
    for s, w in zip(sizes, where):
        real[w[0]] += s
    assert sorted(real) == sorted(sums)
    greedy = [0] * 16
    for s in sorted(sizes, reverse=True):
        greedy[greedy.index(min(greedy))] += s
    assert max(real) - min(real) <= max(greedy) - min(greedy)


def naive(parts):
    """Differencing with nothing but lists: the two of largest spread, the earlier made first, until one is left."""
    live = [(i, sorted(p, reverse=True)) for i, p in enumerate(parts)]
    made = len(live)
    while len(live) > 1:
        live.sort(key=lambda x: (x[1][-1] - x[1][0], x[0]))
        (_, a), (_, b) = live[:2]
        live = live[2:] + [(made, sorted((x + y for x, y in zip(a, reversed(b))), reverse=True))]
        made += 1
    return live[0][1]


def test_differencing_against_brute_force():
    rng = random.Random(7)
    for _ in range(60):
        k = rng.randint(2, 5)
        parts = [[rng.randint(0, 50) for _ in range(k)] if rng.random() < 0.3 else [rng.randint(1, 200)] + [0] * (k - 1) for _ in range(rng.randint(1, 25))]
        where, sums = sharding.difference(parts)
        real = [0] * k
        for p, w in zip(parts, where):
            assert sorted(w) == list(range(k))
            for x, at in zip(p, w):
                real[at] += x
        assert real == sums and sorted(real, reverse=True) == naive(parts)
    # Never far from the best of all assignments, on inputs where those can be listed.
    for _ in range(20):
        sizes = [rng.randint(1, 60) for _ in range(8)]
        best = min(max(sum(s for s, a in zip(sizes, at) if a == j) for j in range(2)) for at in itertools.product(range(2), repeat=8))
        assert max(sharding.difference([[s, 0] for s in sizes])[1]) <= 7 / 6 * best


def test_chunks_compose(monkeypatch):
    monkeypatch.setattr(sharding, "CHUNK", 50)
    rng = random.Random(2)
    sizes = [rng.randint(1, 5000) for _ in range(333)]
    slots = sharding.assign(sizes, 4)
    sums = Counter()
    for s, at in zip(sizes, slots):
        sums[at] += s
    assert max(sums.values()) - min(sums.values()) < 0.02 * sum(sizes)


@pytest.mark.parametrize("groups, top, least", [(1 << 14, 4096, 100_000), (20, 4096, 50), (10, 3, 50)])
def test_shards(spark, monkeypatch, groups, top, least):
    monkeypatch.setattr(sharding, "GROUPS", groups)
    monkeypatch.setattr(sharding, "TOP", top)
    monkeypatch.setattr(common, "LEAST", least)
    rng = random.Random(4)
    texts = ["é" * rng.randint(0, 300) for _ in range(300)] + ["copy"] * 200 + [None, None, "", ""]
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    got = sharding.shard(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(rows)))
    groups, slots, sums = defaultdict(set), defaultdict(list), Counter()
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        groups[texts[r.doc_id]].add(r.shard)
        slots[r.shard].append(r.slot)
        sums[r.shard] += r["size"]
    assert all(len(g) == 1 for g in groups.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(16))
    assert max(sums.values()) - min(sums.values()) < 0.02 * sum(sums.values())
    assert sharding.shard(spark.createDataFrame([], SCHEMA)).count() == 0
    odd = [(None, "a", ""), (None, None, ""), (3, "long " * 200_000, "")]
    clash = spark.createDataFrame(odd, SCHEMA).selectExpr("doc_id", "text", "shard AS hash", "1 AS block", "2 AS slot", "3 AS size")
    assert sorted(r["size"] for r in sharding.shard(clash).collect()) == [1, 2, 1_000_001]
    assert sharding.shard(spark.createDataFrame([(1, "a", "")] * 3, SCHEMA)).count() == 3
