import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest

from versalake.llm import near_dedup

SCHEMA = "doc_id long, text string, class_id string"


def bag(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return Counter([tuple(words[i : i + 5]) for i in range(len(words) - 4)] if len(words) >= 5 else [tuple(words)] if words else [])


def brute(rows):
    """doc_id -> smallest doc_id of its class, over all pairs that share a shingle."""
    bags = {i: bag(t) for i, t in rows if t is not None}
    parent = {i: i for i, _ in rows}

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(i, j):
        a, b = sorted((find(i), find(j)))
        parent[b] = a

    first: dict = {}
    for i, t in rows:
        if t is not None:
            join(first.setdefault(t, i), i)
    holders = defaultdict(list)
    for t, i in first.items():
        for s in bags[i]:
            holders[s].append(i)
    seen = set()
    for h in holders.values():
        for x, i in enumerate(h):
            for j in h[:x]:
                if (i, j) not in seen:
                    seen.add((i, j))
                    if sum((bags[i] & bags[j]).values()) >= 0.8 * sum((bags[i] | bags[j]).values()):
                        join(i, j)
    return {i: find(i) for i, _ in rows}


def corpus():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefé日") for _ in range(rng.randint(2, 7)))
    texts = [None, None, "", "", " \n", "one", "one", "two words", "two  words", "w " * 3000]
    for family in range(12):
        origin = [word() for _ in range(rng.randint(20, 400))]
        for _ in range(rng.randint(1, 14)):
            copy = list(origin)
            for _ in range(rng.randint(0, max(1, len(origin) // 60))):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
            if rng.random() < 0.3:
                texts.append(texts[-1])
    shared = " ".join(word() for _ in range(60))  # a passage that many texts share
    texts += [shared + " " + " ".join(word() for _ in range(rng.randint(5, 60))) for _ in range(40)]
    drift = [word() for _ in range(120)]  # a chain: neighbours are similar, the ends aren't
    for _ in range(25):
        texts.append(" ".join(drift))
        drift[rng.randrange(len(drift))] = word()
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_classes_against_brute_force(spark):
    rows = corpus()
    got = near_dedup.classes(spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).repartition(3)).collect()
    assert {r.doc_id: r.class_id for r in got} == brute(rows)
    assert len(got) == len(rows)


def test_rounds_and_shuffled_ids(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "LEFT", 0)
    monkeypatch.setattr(near_dedup, "MOST_IDS", 0)
    rows = corpus()
    got = near_dedup.classes(spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)).collect()
    assert {r.doc_id: r.class_id for r in got} == brute(rows)


def test_real_documents_and_keep_one(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_edges(spark):
    assert near_dedup.classes(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, "a b c d e f", ""), (1, "a b c d e f", ""), (None, "a b c d e f", ""), (2, "a b c d e f", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert sorted((r.doc_id or 0, r.class_id or 0) for r in near_dedup.classes(docs).collect()) == [(0, 0), (1, 1), (1, 1), (2, 1)]
    assert sorted(r.doc_id or 0 for r in near_dedup.keep_one(docs).collect()) == [0, 1]


def test_signatures_are_unbiased():
    rng, errors = np.random.default_rng(1), []
    for _ in range(400):
        n = int(rng.integers(2, 60))
        s = np.sort(rng.integers(1, 2**63, n).astype(np.uint64))
        a, b = rng.integers(1, 9, n), np.where(rng.random(n) < 0.6, 3, rng.integers(1, 12, n))
        g = near_dedup.signatures(np.repeat([0, 1], n), np.tile(s, 2), np.concatenate([a, b]), 2)
        errors.append((g[0] == g[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(errors)) < 4 * np.std(errors) / len(errors) ** 0.5
    assert np.std(errors) < 0.06


def test_overlap_counts_exactly():
    texts = [t for _, t in corpus() if t is not None]
    pairs = [(texts[i], texts[(7 * i + 1) % len(texts)]) for i in range(len(texts))] + [("a b c d e a b c d e f", "a b c d e a b c d e g")]
    raw = [t.encode() for p in pairs for t in p]
    data, begin = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    for (x, y), s in zip(pairs, near_dedup.overlap(data, begin, len(pairs))):
        union = sum((bag(x) | bag(y)).values())
        assert s == pytest.approx(sum((bag(x) & bag(y)).values()) / union if union else 0)


def pair_overlap(pairs):
    raw = [t.encode() for p in pairs for t in p]
    data, begin = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    return near_dedup.overlap(data, begin, len(pairs)).tolist()


def test_no_words_of_equal_hash():
    for n in (1024, 2048):
        bits = [bin(i).count("1") % 2 for i in range(n)]
        assert pair_overlap([tuple("".join("ab"[b ^ x] for b in bits) for x in (0, 1))]) == [0.0]
    words = [c * n for n in (1, 7, 8, 9, 16, 63, 64, 65, 200) for c in "abxyz"] + [("ab" * 99)[i : i + 30] + c for i in (0, 1) for c in "\x00\x01"]
    data = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    assert len(set(near_dedup.hash_words(data, ends - [len(w) for w in words], ends).tolist())) == len(set(words))


@pytest.mark.parametrize("weak", ["hash_words", "hash_shingles"])
def test_overlap_is_exact_under_collisions(monkeypatch, weak):
    monkeypatch.setattr(near_dedup, weak, lambda x, *_: np.full(len(_[0]) if _ else len(x), 7, np.uint64))
    texts = [t for _, t in corpus() if t is not None]
    pairs = [(texts[i], texts[(7 * i + 1) % len(texts)]) for i in range(0, len(texts), 3)] + [("a b c d e f", "a b c d e g"), ("one", "two"), ("x", "x")]
    for (x, y), s in zip(pairs, pair_overlap(pairs)):
        union = sum((bag(x) | bag(y)).values())
        assert s == pytest.approx(sum((bag(x) & bag(y)).values()) / union if union else 0)


def test_hot_centres_and_hubs_are_split(spark, monkeypatch):
    from versalake.llm import common

    monkeypatch.setattr(near_dedup, "SHARE", 3)
    monkeypatch.setattr(common, "LEAST", 3)
    rows = [(*r, "") for r in corpus()]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert {r.doc_id: r.class_id for r in near_dedup.classes(docs).collect()} == brute([r[:2] for r in rows])
    star = spark.createDataFrame([(0, i) for i in range(1, 200)] + [(i, 500 + i) for i in range(1, 90)], "a long, b long")
    got = {r.id: r.root for r in near_dedup.components(star).collect()}
    assert len(got) == 289 and set(got.values()) == {0}


def test_one_id_with_two_texts(spark):
    rows = [(1, "a b c d e f", ""), (1, "g h i j k l", ""), (2, "a b c d e f", ""), (3, "g h i j k l", "")]
    got = {(r.doc_id, r.class_id) for r in near_dedup.classes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(1, 1), (2, 1), (3, 1)}


def test_texts_that_no_other_class_can_match_are_not_paired(spark, monkeypatch):
    rng, paired = random.Random(4), []
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(8))
    origin = [word() for _ in range(300)]
    rows = []
    for i in range(120):  # each like the others at about 0.6: they share buckets and no class
        copy = list(origin)
        for at in rng.sample(range(300), 9):
            copy[at] = word()
        rows.append((i, " ".join(copy)))
    rows += [(200 + i, " ".join(rows[i][1].split()[:290])) for i in range(0, 120, 10)]
    real = near_dedup.verify
    monkeypatch.setattr(near_dedup, "verify", lambda pairs, docs: (paired.append(pairs.count()), real(pairs, docs))[1])
    got = near_dedup.classes(spark.createDataFrame([(*r, "") for r in rows], SCHEMA)).collect()
    want = brute(rows)
    assert {r.doc_id: r.class_id for r in got} == want and len(set(want.values())) == 120
    assert sum(paired[1:]) < 10 * len(rows)


def test_bound_holds_for_cut_and_nested_texts(spark):
    rng = random.Random(6)
    word = lambda: rng.choice("abcdefgh") * rng.randint(1, 3)
    origin = [word() for _ in range(400)]  # few words: shingles repeat
    texts = [" ".join(origin[: rng.randint(200, 400)]) for _ in range(60)] + [" ".join(origin[rng.randint(0, 150) :]) for _ in range(40)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    docs = spark.createDataFrame([(*r, "") for r in rows], SCHEMA)
    assert {r.doc_id: r.class_id for r in near_dedup.classes(docs).collect()} == brute(rows)


def open_members(n, keys, seed):
    """Rows of `_across`: members of `keys` buckets whose bounds hold for some pairs and fail for others."""
    rng = np.random.default_rng(seed)
    kinds, rows = rng.integers(0, 4, (2, near_dedup.BINS)), []
    for i in range(n):
        own = rng.random(near_dedup.BINS) < rng.uniform(0, 0.3)
        bins = np.where(own, rng.integers(0, 4, near_dedup.BINS), kinds[i % 2]).tolist()
        size = sum(bins) + int(rng.integers(0, 30))
        rows += [(int(k), i, i - i % 3, float(rng.uniform(0.5, 1)), size, sum(bins), bins) for k in rng.choice(keys, 2, replace=False)]
    return rows


OPEN = "key long, id long, root long, s double, size long, shared long, bins array<int>"


def may_link(rows):
    """The pairs of `_across` one by one, once for each bucket."""
    pairs, least = [], lambda u, v: 0.8 / 1.8 * (u[4] + v[4]) - 1e-9
    for x, u in enumerate(rows):
        for v in rows[:x]:
            if u[0] == v[0] and u[2] != v[2] and abs(u[3] - v[3]) <= 0.2 + 1e-9 and min(u[5], v[5]) >= least(u, v) and sum(map(min, u[6], v[6])) >= least(u, v):
                pairs.append((max(u[1], v[1]), min(u[1], v[1])))
    return sorted(pairs)


@pytest.mark.parametrize(("many", "part"), [(64, 2048), (1, 7), (1, 2048), (20, 5)])
def test_pairs_of_small_and_large_buckets(spark, monkeypatch, many, part):
    monkeypatch.setattr(near_dedup, "MANY", many)
    monkeypatch.setattr(near_dedup, "PART", part)
    rows = open_members(60, 4, 3)
    want = may_link(rows)
    got = near_dedup._across(spark.createDataFrame(rows, OPEN)).collect()
    assert sorted((r.a, r.b) for r in got) == want
    assert 0 < len(want) < len(rows) * 14


def test_large_bucket_is_compared_as_arrays(spark):
    """Comparing these 4.5 million pairs row by row took minutes."""
    flat = [2] * near_dedup.BINS
    rows = [(1, i, i, 0.9, 272, 256, flat if i < 2 else [4 * ((i + k) % 2) for k in range(near_dedup.BINS)]) for i in range(3000)]
    left = spark.createDataFrame(rows, OPEN).localCheckpoint()
    began = time.monotonic()
    got = near_dedup._across(left).groupBy().count().first()[0]
    odd = 1499
    assert got == 1 + odd * (odd - 1)  # the two flat ones, and those of each parity among themselves
    assert time.monotonic() - began < 30
