import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from versalake.llm import line_dedup

SCHEMA = "doc_id long, text string, n_lines string, other int"


def brute(rows):
    def key(line):
        return line.strip(" \t\n\x0b\f\r").translate(str.maketrans(line_dedup.UPPER, line_dedup.LOWER))

    holders = defaultdict(set)
    for i, text, *_ in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(i)
    out = {}
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= 40 and len(holders[key(x)]) >= 5 and max(holders[key(x)]) != i)]
        out[i] = len(lines), len(lines) - len(kept), "\n".join(kept)
    return out


def corpus():
    rng = random.Random(8)
    shared = [c * 39 + str(i) for i, c in enumerate("aéZ日b")] + ["short"] * 2 + ["x" * 39]
    rows = [(i, rng.choice([None, "", "\n\n"]) if i % 17 == 0 else "\n".join(rng.choice([rng.choice(shared), " \t" + rng.choice(shared).upper() + "\r", f"line {i}"]) for _ in range(rng.randint(1, 12))), "x", i) for i in range(120)]
    return [*rows, (500, "\n".join([shared[0]] * 20000), "x", 0)]


def test_against_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    want = brute(rows)
    got = line_dedup.dedup(docs)
    assert set(got.columns) == {"doc_id", "text", "other", "n_lines", "n_dropped"}
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in got.collect()} == want
    assert {r.doc_id: r.kept_sha256 for r in line_dedup.digests(docs).collect()} == {i: hashlib.sha256(w[2].encode()).hexdigest() for i, w in want.items()}
    assert line_dedup.dedup(docs.limit(0)).count() == 0


def test_repeated_rows(spark):
    rows = [(i, "y" * 50, "", 0) for i in range(5)] + [(4, "y" * 50, "", 0), (None, "y" * 50, "", 0)]
    got = line_dedup.dedup(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_dropped) for r in got) == [(-1, 1), (0, 1), (1, 1), (2, 1), (3, 1), (4, 0), (4, 0)]


def test_runs_are_levelled(spark, tmp_path):
    runs = line_dedup.LineRuns(spark, str(tmp_path), fanout=3)
    for b in range(7):
        rows = [(k, k, 1, 2, b) for k in range(b, b + 4)]
        new = runs.add(spark.createDataFrame(rows, "h1 long, h2 long, n_docs long, n_lines long, last long"))
        assert {r.h1 for r in spark.table(new).collect()} == (set(range(4)) if b == 0 else {b + 3})
    assert [len(x) for x in runs.levels] == [1, 2] and [len(x) for x in runs.updates] == [0, 2]
    keys = [r.h1 for level in runs.levels for t in level for r in spark.table(t).collect()]
    assert sorted(keys) == list(range(10))
    want = {k: (len(h), 2 * len(h), max(h)) for k in range(10) if (h := [b for b in range(7) if b <= k < b + 4])}
    assert {r.h1: (r.n_docs, r.n_lines, r.last) for r in runs.totals().collect()} == want
    runs.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith(runs.name)]


def test_stored_runs_are_not_shuffled_or_sorted(spark):
    keys = line_dedup.keyed(spark.createDataFrame(corpus(), SCHEMA))
    runs = line_dedup.build(keys, fanout=9)
    earlier = runs._all(runs.levels)
    batch = runs._all([[runs.made[1]]])[0].select("h1", "h2")
    with line_dedup.settings(spark, line_dedup.SORTED | {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        for plan in (runs.met(), earlier[0].join(earlier[1].select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti"), batch):
            said = plan._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in said and "Sort [" not in said, said
    runs.close()
    assert spark.conf.get("spark.sql.legacy.bucketedTableScan.outputOrdering") == "false"


def test_hot_lines_and_clashing_names(spark, monkeypatch):
    from versalake.llm import common

    monkeypatch.setattr(common, "LEAST", 4)
    rows = [(*r[:2], "x", "clash") for r in corpus()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone string, lines string")
    got = line_dedup.dedup(docs.withColumns({"id": F.lit(1), "hash": F.lit(2), "own": F.lit(3), "kept": F.lit(4)}))
    assert got.columns == ["doc_id", "text", "gone", "lines", "id", "hash", "own", "kept", "n_lines", "n_dropped"]
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in got.collect()} == brute(rows)
