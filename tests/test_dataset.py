import json

import numpy as np
import pytest
from pyspark.sql import functions as F

import versalake as v
from versalake import errors as E
from versalake.types import Column


@pytest.fixture
def ds(spark, tmp_path):
    return v.dataset(f"file://{tmp_path}/ds", spark=spark)


@pytest.fixture(scope="module")
def filled(spark, tmp_path_factory):
    ds = v.dataset(f"file://{tmp_path_factory.mktemp('d')}/ds", spark=spark)
    ds.create_tensor("n", dtype="int64")
    ds.create_tensor("label", htype="class_label", class_names=["cat", "dog"])
    ds.create_tensor("text", htype="text")
    ds.create_tensor("vec", htype="vector", dimension=3)
    ds.extend([{"n": i, "label": ["dog", "cat", "owl"][i % 3], "text": f"word{i % 4} common", "vec": [float(i), 0.0, 1.0]} for i in range(20)])
    ds.commit("rows")
    return ds


def test_types():
    assert Column("a", "embedding").dtype == "float32"
    for bad in (lambda: Column("a", "nothing"), lambda: Column("a", "embedding", "float64"), lambda: Column("a", "image", compression="mp3"), lambda: Column("a", "generic", "int128")):
        with pytest.raises(E.TypeMismatch):
            bad()
    assert Column("a", "generic", "uint8", 0).check(255) == 255
    for c, value in ((Column("a", "generic", "uint8", 0), 256), (Column("a", "generic", "int64", 0), 1.5), (Column("a", "bbox"), [[1, 2, 3]]), (Column("a", "text"), 5), (Column("a", "image"), np.zeros(3)), (Column("a", "vector", info={"dimension": 2}), [1.0])):
        with pytest.raises(E.TypeMismatch):
            c.check(value)
    for value, want in (({"a": 1}, "json"), ("x", "text"), (["x"], "list"), (1, "generic"), (np.zeros((2, 2)), "generic"), ([{"a": 1}], "json")):
        c = Column("a")
        c.learn(value)
        assert c.htype == want
    assert json.loads(Column("a", "json").check({"b": [1]})) == {"b": [1]}


def test_selection(filled):
    assert len(filled) == 20 and filled[3:6].n.list() == [3, 4, 5] and filled[-1].n.list() == [19]
    assert filled[[5, 2, 5]].n.list() == [5, 2, 5] and filled[::-7].n.list() == [19, 12, 5]
    assert filled[4:16:3][1:3].n.list() == [7, 10]
    assert filled[["n", "text"]].get_tensors() == ["n", "text"] and filled["n"][2:4].list() == [2, 3]
    assert [r["n"] for r in filled[:3]] == [0, 1, 2]
    with pytest.raises(IndexError):
        filled[20]
    with pytest.raises(E.UnknownColumn):
        filled["nothing"]
    assert filled.vec.shape == (20, 3) and filled.n.shape == (20,) and filled.vec.ndim == 2 and filled.vec.size == 60
    assert filled.n.numpy().tolist() == list(range(20)) and filled.n.numpy_continuous(2, 4).tolist() == [2, 3]
    assert filled.n.numpy_batch_random_access([4, 1]).tolist() == [4, 1]
    assert filled.label.data()["text"][:3] == ["dog", "cat", "owl"] and filled.label.info["class_names"] == ["cat", "dog", "owl"]
    assert filled.text.arrow().to_pylist()[0] == "word0 common" and filled.text.tobytes()[0] == b"word0 common"


def test_filters_and_groups(filled):
    view = filled.filter("label == 'dog' and n > 5", limit=2)
    assert view.filtered_index == [6, 9] and view.query_string == "label == 'dog' and n > 5"
    assert view[1].n.list() == [9]
    assert filled.filter_vectorized([("n", ">", 10), ("text", "CONTAINS", "word1")], ["AND"]).n.list() == [13, 17]
    assert filled.filter("n == 1", index_query=("n", "==", 2), connector="OR").n.list() == [1, 2]
    assert filled.query("n", 4) == {4}
    got = {r.label: r.count_all for r in filled.aggregate(["label"]).collect()}
    assert got == {"dog": 7, "cat": 7, "owl": 6}
    assert filled.aggregate(["label"], order_by_tensors=["label"], order_direction="ASC").first().label == "cat"
    with pytest.raises(E.InvalidCondition):
        filled.aggregate(["label"], ["n"])
    assert filled.statistics(["n"]).first().mean == 9.5 and filled.summary().count() == 4


def test_views(filled, spark):
    view_id = filled.filter("n >= 15").save_view("late")
    again = filled.load_view(view_id)
    assert again.n.list() == [15, 16, 17, 18, 19] and not again.is_optimized and again.query_string == "n >= 15"
    assert filled[[7, 3]].save_view(view_id="odd", optimize=True) == "odd"
    odd = filled.load_view("odd")
    assert odd.n.list() == [7, 3] and odd.is_optimized
    assert filled.load_view(view_id, optimize=True).is_optimized
    assert {x["id"] for x in filled.get_views()} == {view_id, "odd"}
    filled.delete_view("odd")
    with pytest.raises(E.ViewNotFound):
        filled.load_view("odd")
    with pytest.raises(E.ReadOnly):
        filled[:3].commit("no")


def test_text_index_follows_commits(filled):
    index = filled.create_index_vectorized("text", shards=4)
    find = lambda q: sorted(r[0] for r in filled.get_inverted_index("text").complex_search(q).collect())
    assert find("word1 COMMON") == [1, 5, 9, 13, 17] and find("word0||word1") == sorted([0, 4, 8, 12, 16, 1, 5, 9, 13, 17])
    assert filled.indexed_tensors == ["text"] and filled.query("text", "word2 common") == {2, 6, 10, 14, 18}
    filled.checkout("indexed", create=True)
    filled.append({"n": 20, "label": "cat", "text": "word1 fresh", "vec": [0.0, 0.0, 0.0]})
    with pytest.warns(UserWarning):
        assert filled.create_index_vectorized("text") is None
    filled.commit("more")
    filled.create_index_vectorized("text")
    assert find("fresh") == [20] and len(filled.get_inverted_index("text").meta["parts"]) == 2
    filled.optimize_index("text")
    filled.reshard_index("text", 4, 2)
    assert find("word1") == [1, 5, 9, 13, 17, 20] and len(filled.get_inverted_index("text").meta["parts"]) == 1
    assert {r.token for r in filled.create_hot_shard_index("text", 1).collect()} == {"common"}
    filled.pop(0)
    filled.commit("popped")
    filled.create_index_vectorized("text")
    assert find("fresh") == [19]
    assert index.meta["kind"] == "fuzzy_match"
    filled.checkout("main")


def test_vector_index_follows_commits(filled):
    filled.checkout("vectors", create=True)
    filled.create_vector_index("vec", "flat")
    with pytest.raises(E.IndexMissing):
        filled.vector_search([[0, 0, 1]], "vec", "flat", 2)
    filled.load_vector_index("vec", "flat")
    distances, ids = filled.vector_search([[0, 0, 1], [3.2, 0, 1]], "vec", "flat", 2)
    assert ids.tolist() == [[0, 1], [3, 4]] and distances[0].tolist() == [0.0, 1.0]
    with pytest.raises(E.IndexExists):
        filled.create_vector_index("vec", "flat")
    filled.append({"n": 99, "label": "cat", "text": "x", "vec": [0.1, 0.0, 1.0]})
    filled.commit("one more")
    filled.update_vector_index("vec", "flat")
    assert filled.vector_search([[0, 0, 1]], "vec", "flat", 2)[1].tolist() == [[0, 20]]
    filled.create_vector_index("vec", "cells", "IVFPQ", "cosine", nlist=3, nprobe=3)
    filled.load_vector_index("vec", "cells")
    similarity, ids = filled.vector_search([[0, 0, 1]], "vec", "cells", 1, refine_factor=2)
    assert ids[0, 0] == 0 and similarity[0, 0] == pytest.approx(1.0)
    assert filled.indexed_tensors_vec == {"vec": ["cells", "flat"]}
    assert filled.vector_search([[0, 0, 1]], "vec", "flat", 1, where=F.col("_pos") > 4)[1].tolist() == [[20]]
    filled.drop_vector_index("vec", "cells")
    assert filled.indexed_tensors_vec == {"vec": ["flat"]}
    filled.checkout("main")


def test_exports(filled, tmp_path):
    frame = filled.to_dataframe(["n", "text"], index_list=[3, 1])
    assert frame.n.tolist() == [3, 1]
    arrow = filled.to_arrow(["n"])
    assert arrow.count_rows() == 20 and arrow.head(2).to_pydict() == {"n": [0, 1]} and arrow.take([5, 4]).to_pydict() == {"n": [5, 4]}
    assert arrow.filter("n > 17").to_table().to_pydict() == {"n": [18, 19]} and arrow.sort_by([("n", "descending")]).first().n == 19
    with pytest.raises(NotImplementedError):
        arrow.join(arrow)
    filled.write_to_parquet(f"{tmp_path}/p", ["n"])
    assert filled.spark.read.parquet(f"{tmp_path}/p").count() == 20
    filled.to_json(f"{tmp_path}/all.json", ["n", "text"])
    rows = json.loads((tmp_path / "all.json").read_text())
    assert rows[1] == {"n": 1, "text": "word1 common"} and len(rows) == 20
    assert filled.numpy()["n"].tolist() == list(range(20)) and filled[:1].numpy(asrow=True)[0]["n"] == 0


def test_imports(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿name,score\nsample_0,0\n\"a, b\",x\n", encoding="utf-8")
    ds = v.from_csv(f"{tmp_path}/a.csv", f"file://{tmp_path}/csv", spark=spark)
    assert ds.name.list() == ["sample_0", "a, b"] and ds.score.list() == ["0", "x"]
    typed = v.from_csv(f"{tmp_path}/a.csv", f"file://{tmp_path}/csv2", {"name": "text", "score": "float64"}, spark=spark)
    assert typed.score.list() == [0.0, None]
    (tmp_path / "b.jsonl").write_text('{"a": 1, "b": {"c": "x", "d": 2.5}}\n{"a": 2, "b": {"c": "y", "d": 3}}\n')
    nested = v.from_file(f"{tmp_path}/b.jsonl", f"file://{tmp_path}/json", {"a": "int64", "b": {"c": "text", "d": "float32"}}, spark=spark)
    assert nested.get_tensors() == ["a", "b.c", "b.d"] and nested["b.d"].list() == [2.5, 3.0]
    rows = v.from_dataframes([{"a": '{"k": 1}', "tags": ["x", "y"], "n": 1}, {"a": '{"k": 2}', "tags": [], "n": 2.5}], f"file://{tmp_path}/rec", spark=spark)
    assert rows["a.k"].list() == [1, 2] and rows.tags.list() == ["x, y", ""] and rows.n.list() == [1.0, 2.5]
    (tmp_path / "c.csv").write_text(f"file,label\n{tmp_path}/b.jsonl,1\n")
    media = v.from_csv(f"{tmp_path}/c.csv", f"file://{tmp_path}/media", path_columns={"file": "read"}, spark=spark)
    assert media.file.list()[0].startswith(b'{"a": 1')
    assert v.read(f"{tmp_path}/b.jsonl", spark).first().length > 0


def test_module_functions(spark, tmp_path, filled):
    path = f"file://{tmp_path}/made"
    made = v.empty(path, spark=spark)
    with pytest.raises(E.DatasetExists):
        v.empty(path, spark=spark)
    made.create_tensor("a", dtype="int")
    made.append({"a": 1})
    made.commit("one")
    assert v.get_col_info(path, "a", spark)["dtype"] == "int64"
    twin = v.like(f"file://{tmp_path}/twin", filled, spark=spark)
    assert len(twin) == 0 and twin.get_tensors() == filled.get_tensors() and twin.label.info["class_names"][0] == "cat"
    copied = filled[5:8].copy_to(f"file://{tmp_path}/copy")
    assert copied.n.list() == [5, 6, 7]
    with pytest.raises(E.DatasetNotFound):
        v.load(f"file://{tmp_path}/none", spark=spark)
    v.delete(path, spark=spark)
    assert not v.exists(path, spark)
    assert v.tiled((5, 4), (3, 4)) == [{"start": [0, 0], "shape": [3, 4]}, {"start": [3, 0], "shape": [2, 4]}]


def test_transforms(ds, spark):
    ds.create_tensor("x", dtype="int")
    ds.extend({"x": [1, 2, 3]})
    ds.commit("in")

    @v.compute
    def repeat(sample_in, sample_out, times):
        for i in range(sample_in["x"]):
            sample_out.append({"x": sample_in["x"] * times + i})

    out = v.like(f"{ds.path}-out", ds)
    repeat(times=10).eval(ds, out, num_workers=2, checkpoint_interval=2)
    assert out.x.list() == [10, 20, 21, 30, 31, 32]
    assert [c["message"] for c in out.commits()] == ["checkpoint at 3", "checkpoint at 2"]

    @v.compute
    def fails(sample_in, sample_out):
        sample_out.append({"x": 1 // (sample_in["x"] - 2)})

    with pytest.raises(Exception, match="fails"):
        fails().eval(ds, out)
    fails().eval(ds, out, ignore_errors=True)
    assert out.x.list()[-2:] == [-1, 1]

    @v.compute(batch_enable=True)
    def double(batch):
        return batch.assign(x=batch["x"] * 2)

    v.compose([double(), double()]).eval(ds)
    assert ds.x.list() == [4, 8, 12]


def test_stream_ingestion(spark, tmp_path):
    from versalake.streaming.ingest import ingest

    spark.range(10).select(F.col("id").alias("n"), F.concat(F.lit("t"), "id").alias("text")).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("n long, text string").parquet(f"{tmp_path}/in")
    path = f"file://{tmp_path}/ds"
    for _ in range(2):
        ingest(stream, path, f"{tmp_path}/ck").awaitTermination()
    ds = v.load(path, spark=spark)
    assert sorted(ds.n.list()) == list(range(10)) and ds.commits()[-1]["message"] == "stream batch 0"
