"""Every registered query against its SQL, on the smallest tables."""

import pytest

from tests.compare import DATA, differences
from versalake.operators import knn
from versalake.operators.ivf import VectorIndex
from versalake.plans import registry

SF = str(DATA / "sf0.001")


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, name):
    assert differences(spark, registry.QUERIES[name], registry.ORACLES[name], SF) == ""


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_plans_prune_and_push(spark):
    plan = registry.QUERIES["filter_cmp_and_or"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "l_quantity" in plan and "l_extendedprice" not in plan


def test_recall_of_cells(spark):
    exact = {(r.query_id, r.vec_id) for r in registry.QUERIES["knn_l2"](spark, SF).collect()}
    found = {(r.query_id, r.vec_id) for r in registry.QUERIES["ivf_search"](spark, SF).collect()}
    assert len(exact & found) >= 0.6 * len(exact)


@pytest.mark.parametrize("size, metric, params", [("sf0.001", "l2", {"nlist": 16}), ("sf0.1", "l2", {"nlist": 16}), ("sf0.1", "cosine", {}), ("sf0.1", "inner_product", {})])
def test_recall_of_measured_probes(spark, tmp_path, size, metric, params):
    rows = spark.read.parquet(str(DATA / size / "embeddings.parquet")).select("vec_id", "embedding")
    asked = [(r.vec_id, r.embedding) for r in rows.where("vec_id % 50 = 0").collect()]
    index = VectorIndex.create(rows, f"{tmp_path}/cells", "cells", "embedding", "IVFPQ", metric, "vec_id", **params).load(cache=False)
    exact = {(r.query_id, r.vec_id) for r in knn.knn(rows, asked, 10, metric, "vec_id", "embedding").collect()}
    found = {(r.query_id, r.vec_id) for r in index.search(asked, 10).collect()}
    assert len(exact) == 10 * len(asked) and len(exact & found) >= 0.9 * len(exact)


@pytest.mark.parametrize("name", ["knn_l2_blocks", "knn_ip_blocks", "knn_cosine_blocks", "knn_filtered_blocks", "knn_reranked_blocks", "ivf_search"])
def test_searches_ask_a_share_of_the_table(spark, name):
    got = registry.QUERIES[name](spark, SF).groupBy("query_id").count().collect()
    assert {r.query_id for r in got} >= set(range(0, 500, 50)) and all(r["count"] == 10 for r in got)


def test_blocks_equal_one_search(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    asked = rows.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    few = [(r.query_id, r.embedding) for r in asked.collect()]
    flat = lambda df: sorted((r.query_id, r["rank"], r.vec_id, round(r.distance, 9)) for r in df.collect())
    assert flat(knn.knn_blocks(rows, asked, 10, "l2", "vec_id", "embedding", block=3)) == flat(knn.knn(rows, few, 10, "l2", "vec_id", "embedding"))
    assert knn.knn_blocks(rows, asked.limit(0), 10, "l2", "vec_id", "embedding").count() == 0
    index = VectorIndex.create(rows, f"{tmp_path}/cells", "cells", "embedding", "IVFPQ", "cosine", "vec_id", nlist=16).load(cache=False)
    assert flat(index.search_blocks(asked, 10, nprobe=3)) == flat(index.search(few, 10, nprobe=3))
