import pytest
from pyspark.sql import functions as F

import versalake as v
from versalake import errors as E
from versalake.functions.text import ASCII, Analyser
from versalake.operators.text_index import TextIndex


@pytest.fixture
def animals(spark, tmp_path):
    ds = v.dataset(f"file://{tmp_path}/animals", spark=spark)
    ds.create_tensor("label", htype="class_label", class_names=["cat", "dog"])
    ds.create_tensor("n", dtype="int64")
    ds.extend({"label": ["cat", "dog", "cat", "dog"], "n": [0, 1, 2, 3]})
    ds.commit("base")
    return ds


def named(ds):
    rows = ds.frame().orderBy("_pos").select("label", "n").collect()
    names = ds.label.info["class_names"]
    return [(names[r.label], r.n) for r in rows]


@pytest.mark.parametrize("resolution", ["ours", "theirs"])
def test_merge_keeps_class_names(animals, resolution):
    ds = animals
    ds.checkout("dev", create=True)
    ds.set_info("label", class_names=["cat", "dog", "bat", "elk"])
    ds.extend({"label": ["bat"], "n": [10]})
    ds[0].update({"label": "bat"})
    ds[1].update({"label": "elk"})
    ds.commit("dev")
    ds.checkout("main")
    ds.set_info("label", class_names=["cat", "dog", "owl", "elk"])
    ds.extend({"label": ["owl"], "n": [20]})
    ds[0].update({"label": "owl"})
    ds[1].update({"label": "elk"})
    ds.commit("main")
    # Row 0 got number 2 on both sides, but of different names: a conflict. Row 1 got one name by two numbers.
    with pytest.raises(E.MergeConflict):
        ds.merge("dev", append_resolution="both")
    _, records = ds.detect_merge_conflict("dev")
    assert [list(d) for d in records["label"]["update_values"]["update_ori"]] == [[0], [1]]
    ds.merge("dev", append_resolution="both", update_resolution=resolution)
    assert ds.label.info["class_names"] == ["cat", "dog", "owl", "elk", "bat"]
    first = "owl" if resolution == "ours" else "bat"
    assert named(ds) == [(first, 0), ("elk", 1), ("cat", 2), ("dog", 3), ("owl", 20), ("bat", 10)]


def test_merge_of_reordered_names(animals):
    ds = animals
    ds.checkout("dev", create=True)
    ds.set_info("label", class_names=["bat", "cat", "dog"])
    ds.update_where(F.lit(True), {"label": F.col("label") + 1})
    ds[3].update({"label": "bat"})
    ds.commit("renumbered")
    ds.checkout("main")
    ds.merge("dev", update_resolution="theirs")
    assert named(ds) == [("cat", 0), ("dog", 1), ("cat", 2), ("bat", 3)]


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    ds = v.dataset(f"file://{tmp_path_factory.mktemp('indexed')}/ds", spark=spark)
    ds.create_tensor("text", htype="text")
    ds.create_tensor("code", htype="text")
    ds.create_tensor("n", dtype="int64")
    ds.create_tensor("tags", htype="list")
    ds.extend({"text": [f"word{i % 4} common {i}" for i in range(40)], "code": [f"c{i % 5}" for i in range(40)], "n": [i % 10 for i in range(40)], "tags": [[f"t{i % 3}", "all"] for i in range(40)]})
    ds.commit("rows")
    for column, kind in (("text", None), ("code", "exact_match"), ("n", None), ("tags", "value")):
        ds.create_index(column, index_type=kind)
    return ds


CASES = [
    ([("text", "CONTAINS", "word1 common", True)], None, [i for i in range(40) if i % 4 == 1]),
    ([("text", "CONTAINS", "word1||word3 3", True)], None, [i for i in range(40) if i % 4 == 1 or i == 3]),
    ([("text", "CONTAINS", "", True)], None, []),
    ([("code", "==", "c2", True)], None, [i for i in range(40) if i % 5 == 2]),
    ([("n", "==", 7, True), ("text", "CONTAINS", "word3", True)], ["AND"], [i for i in range(40) if i % 10 == 7 and i % 4 == 3]),
    ([("n", "BETWEEN", [3, 4], True)], None, [i for i in range(40) if i % 10 in (3, 4)]),
    ([("n", "BETWEEN", [8, 9], True), ("code", "==", "c0", True), ("n", ">", 4)], ["OR", "AND"], [i for i in range(40) if (i % 10 in (8, 9) or i % 5 == 0) and i % 10 > 4]),
    ([("n", ">", 5), ("code", "==", "c1", True)], ["OR"], [i for i in range(40) if i % 10 > 5 or i % 5 == 1]),
]


@pytest.mark.parametrize("conditions, connectors, want", CASES)
def test_indexed_filters_equal_scans(indexed, conditions, connectors, want):
    plain = [(*c[:3], False) for c in conditions]
    assert indexed.filter_vectorized(conditions, connectors).filtered_index == want == indexed.filter_vectorized(plain, connectors).filtered_index
    assert indexed.filter_vectorized(conditions, connectors, offset=10, limit=3).filtered_index == [i for i in want if i >= 10][:3]


def test_indexed_plans_read_the_index(indexed):
    plan = indexed.filter_vectorized([("text", "CONTAINS", "word1", True)]).frame()._jdf.queryExecution().executedPlan().toString()
    assert "indexes/text" in plan and "PartitionFilters: [isnotnull(shard" in plan.replace("shard#", "shard") and "regexp_extract_all" not in plan
    plan = indexed.filter_vectorized([("n", "BETWEEN", [3, 4], True)]).frame()._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(value,3)" in plan


def test_query_of_lists_numbers_and_ranges(indexed):
    assert indexed.query("tags", "t1") == {i for i in range(40) if i % 3 == 1}
    assert indexed.query("n", 3) == {3, 13, 23, 33} and indexed.query("n", (0, 1)) == {i for i in range(40) if i % 10 < 2}


def test_stale_indexes_are_not_asked(indexed):
    ds = indexed
    ds.checkout("more", create=True)
    ds.extend({"text": ["word1 new"], "code": ["c2"], "n": [7], "tags": [["t9"]]})
    for committed in (False, True):
        assert ds.filter_vectorized([("text", "CONTAINS", "word1 new", True)]).filtered_index == [40]
        assert ds.filter_vectorized([("n", "==", 7, True)]).filtered_index == [7, 17, 27, 37, 40]
        if not committed:
            ds.commit("more")
    ds.create_index("n")
    assert len(ds.get_inverted_index("n").meta["parts"]) == 2
    assert ds.filter_vectorized([("n", "==", 7, True)]).filtered_index == [7, 17, 27, 37, 40]
    ds.optimize_index("n")
    assert len(ds.get_inverted_index("n").meta["parts"]) == 1 and ds.query("n", 7) == {7, 17, 27, 37, 40}
    view = ds.filter_vectorized([("n", ">", 6)])
    assert view.filter_vectorized([("code", "==", "c2", True)]).filtered_index == [i for i in range(40) if i % 10 > 6 and i % 5 == 2] + [40]


def test_postings_a_task_writes_are_bounded(spark, tmp_path):
    """No task sorts a fixed share of all postings, neither when rows are added nor when shards are merged."""

    def most(index):
        """The most postings that one task wrote of the last part. Its number stands in the files' names."""
        task = F.regexp_extract(F.input_file_name(), r"part-(\d+)-[^/]*$", 1)
        counts = spark.read.parquet(index.meta["parts"][-1]).groupBy(task.alias("task")).count()
        return counts.agg(F.max("count"), F.sum("count")).first()

    small = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "16k"}
    before = {k: spark.conf.get(k, None) for k in small}
    words = "the quick brown fox jumps over lazy dogs while seven wise owls watch from old trees near our barn".split()
    rows = spark.range(0, 12_000, 1, 8).select(F.col("id").alias("pos"), F.concat_ws(" ", F.array(*(F.lit(w) for w in words))).alias("text"))
    try:
        for k, value in small.items():
            spark.conf.set(k, value)
        index = TextIndex.create(rows.where("pos % 4 <> 1"), f"file://{tmp_path}/index", "text", "pos", analyser=Analyser(ASCII), shards=3)
        n, every = most(index)
        assert every == 9_000 * len(words) and n < every / 24
        index.append(rows.where("pos % 4 = 1"))
        index.reshard(2)
        n, every = most(index)
        assert every == 12_000 * len(words) and n < every / 16
        assert len(index.meta["parts"]) == 1
        assert [r[0] for r in index.search("owls the").orderBy("pos").collect()] == list(range(12_000))
        assert {r[0] for r in index.rows().where("token = 'fox'").select("shard").distinct().collect()} <= {0, 1}
    finally:
        for k, value in before.items():
            spark.conf.unset(k) if value is None else spark.conf.set(k, value)
