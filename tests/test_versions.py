import pytest

import versalake as v
from versalake import errors as E


@pytest.fixture(scope="module", autouse=True)
def tiny_plans(spark):
    """Rows by the dozen: one partition and no re-planning keep these many small plans fast."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    for k, value in before.items():
        spark.conf.set(k, value)


@pytest.fixture
def ds(spark, tmp_path):
    return v.dataset(f"file://{tmp_path}/ds", spark=spark)


def table(ds, n=5):
    ds.create_tensor("labels", dtype="int")
    ds.create_tensor("categories", htype="text")
    ds.extend({"labels": list(range(n)), "categories": [chr(97 + i) for i in range(n)]})
    return ds


def values(ds, name="labels"):
    return ds[name].list()


def test_commit_checkout_reset(ds):
    table(ds)
    first = ds.commit("one")
    with pytest.raises(E.EmptyCommit):
        ds.commit()
    ds.append({"labels": 9, "categories": "z"})
    assert ds.has_head_changes and len(ds) == 6
    ds.reset()
    assert len(ds) == 5 and not ds.has_head_changes
    ds.checkout("dev", create=True)
    ds.append({"labels": 9, "categories": "z"})
    second = ds.commit("two", )
    ds.checkout("main")
    assert len(ds) == 5 and ds.branches == ["dev", "main"]
    ds.checkout(second)
    assert len(ds) == 6 and [c["message"] for c in ds.commits()] == ["two", "one"]
    assert ds.get_lowest_common_ancestor("main", "dev") == first
    assert [c["message"] for c in ds.commits_between("main", "dev", as_dict=True)] == ["two"]
    with pytest.raises(E.CheckoutError):
        ds.checkout("nothing")
    assert len(v.load(f"{ds.path}@dev", spark=ds.spark)) == 6
    assert ds.commits_frame().count() == 3 and "Message: two" in ds.log()


def test_work_survives_the_handle(ds):
    table(ds)
    again = v.load(ds.path, spark=ds.spark, check_integrity=True)
    assert len(again) == 5 and again.has_head_changes
    again.commit("one")
    ds.checkout("main")
    assert not ds.has_head_changes and values(ds) == [0, 1, 2, 3, 4]


def test_updates_and_pops(ds):
    table(ds)
    ds.commit("one")
    ds[1].update({"labels": 10})
    ds.labels[2] = 20
    ds[[0, 3]].update({"labels": [7, 8], "categories": ["p", "q"]})
    assert values(ds) == [7, 10, 20, 8, 4] and values(ds, "categories") == ["p", "b", "c", "q", "e"]
    ds.pop([1, 2])
    assert values(ds) == [7, 8, 4] and ds.sample_indices == [0, 1, 2]
    ds.pop()
    ds.labels[3] = 5  # beyond the end: empty samples in between
    assert values(ds) == [7, 8, None, 5]
    for bad in ([0, 0], [-1]):
        with pytest.raises(E.VersalakeError):
            ds.pop(bad)
    with pytest.raises(E.VersalakeError):
        ds.labels.pop(0)
    ds.commit("two")
    ds.rechunk()
    assert values(ds) == [7, 8, None, 5] and ds.sample_indices == [0, 1, 2, 3]
    ds.append({"labels": 1, "categories": "n"})
    assert values(ds) == [7, 8, None, 5, 1]


def test_schema_changes(ds):
    table(ds)
    ds.commit("one")
    ds.rename_tensor("labels", "numbers")
    ds.create_tensor("extra", dtype="float64")
    assert values(ds, "extra") == [None] * 5
    ds.delete_tensor("categories")
    ds.commit("two")
    assert ds.get_tensors() == ["numbers", "extra"] and values(ds, "numbers") == [0, 1, 2, 3, 4]
    ds.create_tensor("categories", dtype="int")  # a new column, not the old one's values
    assert values(ds, "categories") == [None] * 5
    with pytest.raises(E.ColumnExists):
        ds.create_tensor("extra")


def test_columns_filled_one_by_one(ds):
    ds.create_tensor("a", dtype="int")
    ds.create_tensor("b", htype="text")
    ds.a.extend([1, 2, 3])
    assert len(ds) == 0 and ds.max_len == 3
    ds.b.extend(["x", "y"])
    assert len(ds) == 2 and len(ds.min_view) == 2 and len(ds.max_view) == 3
    ds.b.extend(["z", "w"])
    assert values(ds, "a") == [1, 2, 3, None] and values(ds, "b") == ["x", "y", "z", "w"]
    ds.a.append(4)
    assert len(ds) == 4 and not ds._ragged


def test_append_rules(ds):
    table(ds)
    with pytest.raises(E.TypeMismatch):
        ds.append({"labels": 1})
    with pytest.raises(E.TypeMismatch):
        ds.extend([{"labels": 1, "categories": "ok"}, {"labels": "text", "categories": "no"}])
    assert len(ds) == 5
    ds.append({"labels": 1}, skip_ok=True)
    ds.extend([{"labels": "bad", "categories": "x"}, {"labels": 6, "categories": "y"}], ignore_errors=True)
    assert values(ds)[-2:] == [1, 6]
    with pytest.raises(E.TypeMismatch):
        ds.extend({"labels": [1, 2], "categories": ["x"]})


def two_branches(ds, first, second):
    table(ds)
    ds.checkout("dev-1", create=True)
    first(ds)
    ds.commit()
    ds.checkout("main")
    ds.checkout("dev-2", create=True)
    second(ds)
    ds.commit()
    ds.checkout("main")
    ds.merge("dev-1", pop_resolution="theirs")
    return ds


def extend(ds, numbers):
    ds.extend({"labels": numbers, "categories": [str(n) for n in numbers]})


def each(ds, **cases):
    """Merges dev-2 into a fresh branch of main for every resolution."""
    for i, (how, want) in enumerate(next(iter(cases.values())).items()):
        ds.checkout("main")
        ds.checkout(f"case-{i}", create=True)
        if want is None:
            with pytest.raises(E.MergeConflict):
                ds.merge("dev-2")
        else:
            ds.merge("dev-2", **{next(iter(cases)): how})
            assert values(ds) == want


def test_append_conflicts(ds):
    two_branches(ds, lambda d: extend(d, [10, 20, 30]), lambda d: extend(d, [100, 200, 300, 400]))
    _, records = ds.detect_merge_conflict("dev-2", show_value=True)
    assert records["labels"]["app_ori_idx"] == [5, 6, 7] and records["labels"]["app_tar_values"] == [100, 200, 300, 400]
    mine, new = [10, 20, 30], [100, 200, 300, 400]
    each(ds, append_resolution={"both": [*range(5), *mine, *new], "ours": [*range(5), *mine], "theirs": [*range(5), *new], None: None})


def test_update_conflicts(ds):
    def change(scale, rows):
        return lambda d: [d[i].update({"labels": scale * i}) for i in rows]

    two_branches(ds, change(10, [1, 2]), change(100, [1, 2, 3]))
    _, records = ds.detect_merge_conflict("dev-2")
    assert records["labels"]["update_values"] == {"update_ori": [{1: 10}, {2: 20}], "update_tar": [{1: 100}, {2: 200}]}
    each(ds, update_resolution={None: None, "ours": [0, 10, 20, 300, 4], "theirs": [0, 100, 200, 300, 4]})
    assert ds.log.get(ds.commit_id).merge_parent == ds.log.head("dev-2")
    before = ds.commit_id
    assert ds.merge("dev-2") == before  # nothing new


def test_pop_conflicts(ds):
    table(ds, 10)
    for name, gone in (("dev-1", [1, 2, 8]), ("dev-2", [1, 2, 4, 5])):
        ds.checkout("main")
        ds.checkout(name, create=True)
        ds.pop(gone)
        ds.commit()
    ds.checkout("main")
    with pytest.raises(E.MergeConflict):  # even a fast forward
        ds.merge("dev-1")
    ds.merge("dev-1", pop_resolution="theirs")
    _, records = ds.detect_merge_conflict("dev-2", show_value=True)
    assert records["labels"]["del_tar_idx"] == records["labels"]["del_tar_values"] == [4, 5]
    each(ds, pop_resolution={None: None, "both": [0, 3, 6, 7, 9], "ours": [0, 3, 4, 5, 6, 7, 9], "theirs": [0, 3, 6, 7, 9, 8]})


def mixed(ds, early: bool):
    """Both branches append, update and pop; early: they pop first, so positions shift under the updates."""

    def first(d):
        if early:
            d.pop(1)
        extend(d, [50, 60, 70])
        d.labels[2 if early else 3] = 30
        if not early:
            d.pop(1)

    def second(d):
        if early:
            d.pop([1, 2])
        extend(d, [500, 600, 700, 800])
        d.labels[1 if early else 3] = 300
        d.labels[2 if early else 4] = 400
        if not early:
            d.pop([1, 2])

    return two_branches(ds, first, second)


NEW, OWN = [500, 600, 700, 800], [50, 60, 70]


@pytest.mark.parametrize("early", [False, True])
def test_mixed_merges(ds, early):
    mixed(ds, early)
    cases = [
        ("both", "both", "theirs", [0, 300, 400, *OWN, *NEW]),
        ("ours", "both", "theirs", [0, 300, 400, *OWN]),
        ("theirs", "both", "theirs", [0, 300, 400, *NEW]),
        ("both", "ours", "theirs", [0, 2, 300, 400, *OWN, *NEW]),
        ("both", "theirs", "theirs", [0, 300, 400, *OWN, *NEW]),
        ("both", "both", "ours", [0, 30, 400, *OWN, *NEW]),
    ]
    for i, (append, pop, update, want) in enumerate(cases):
        ds.checkout("main")
        ds.checkout(f"case-{i}", create=True)
        ds.merge("dev-2", append_resolution=append, pop_resolution=pop, update_resolution=update)
        assert values(ds) == want


def test_mixed_merge_without_resolution(ds):
    mixed(ds, False)
    for append, pop, update in (("both", "both", None), ("both", None, "ours"), (None, "both", "ours")):
        with pytest.raises(E.MergeConflict):
            ds.merge("dev-2", append_resolution=append, pop_resolution=pop, update_resolution=update)
    assert values(ds) == [0, 2, 30, 4, *OWN]


def test_updated_there_and_popped_here(ds):
    table(ds)
    ds.commit("one")
    ds.checkout("dev", create=True)
    ds.pop([0, 1])
    ds[0].labels = 188
    extend(ds, [6, 7])
    there = ds.commit()
    ds.checkout("main")
    ds.pop([0, 1, 2, 3])
    ds[0].labels = 18
    extend(ds, [6, 7, 8])
    ds.commit()
    renames, records = ds.detect_merge_conflict(there, show_value=True)
    assert renames == {} and records["labels"]["del_ori_idx"] == [2, 3] and records["labels"]["del_tar_idx"] == []
    assert records["labels"]["update_values"]["update_tar"] == [{0: 188}]
    ds.merge("dev", append_resolution="both", update_resolution="theirs", pop_resolution="both")
    assert values(ds) == [18, 6, 7, 8, 188, 6, 7]


def test_columns_in_merges(ds):
    table(ds)
    ds.checkout("dev", create=True)
    ds.rename_tensor("labels", "renamed")
    ds.create_tensor("more", dtype="int")
    ds.more.extend([1, 2, 3, 4, 5])
    ds.commit()
    ds.checkout("main")
    ds.merge("dev")
    assert ds.get_tensors() == ["renamed", "categories", "more"] and values(ds, "more") == [1, 2, 3, 4, 5]
    ds.checkout("gone", create=True)
    ds.delete_tensor("more")
    ds.append({"renamed": 8, "categories": "y"})
    ds.commit()
    ds.checkout("main")
    ds.checkout("keeps", create=True)
    ds.merge("gone")
    assert "more" in ds.get_tensors() and values(ds, "more")[-1] is None
    ds.checkout("main")
    ds.merge("gone", delete_removed_tensors=True)
    assert ds.get_tensors() == ["renamed", "categories"] and values(ds, "renamed")[-1] == 8


def test_rename_conflicts(ds):
    table(ds)
    ds.checkout("dev", create=True)
    ds.rename_tensor("labels", "theirs")
    ds.commit()
    ds.checkout("main")
    ds.checkout("dropped", create=True)
    ds.delete_tensor("labels")
    ds.commit()
    renames, _ = ds.detect_merge_conflict("dev")
    assert renames == {"target": {"labels": "theirs"}, "original": {"labels": "Deleted"}}
    with pytest.raises(E.MergeConflict):
        ds.merge("dev")
    ds.checkout("main")
    ds.rename_tensor("labels", "ours")
    ds.commit()
    renames, _ = ds.detect_merge_conflict("dev")
    assert renames == {"target": {"labels": "theirs"}, "original": {"labels": "ours"}}
    with pytest.raises(E.MergeConflict):
        ds.merge("dev")
    ds.merge("dev", force=True)
    assert values(ds, "ours") == values(ds, "theirs") == [0, 1, 2, 3, 4]


def test_type_mismatch_in_merge(ds):
    ds.create_tensor("a", dtype="int")
    ds.append({"a": 1})
    ds.checkout("dev", create=True)
    ds.create_tensor("b", dtype="int")
    ds.commit()
    ds.checkout("main")
    ds.create_tensor("b", htype="text")
    ds.commit()
    with pytest.raises(E.MergeMismatch):
        ds.merge("dev")


def test_diffs(ds):
    table(ds)
    ds.commit("one")
    ds.checkout("dev", create=True)
    ds.labels[1] = 50
    ds.pop(3)
    extend(ds, [8, 9])
    dev = ds.commit("two")
    changes = ds.diff()[0]
    assert changes["data_updated"] == {"labels": {1}} and changes["data_deleted"] == {3} and changes["data_added"] == [4, 6]
    net = ds.direct_diff("main", "dev")
    assert {k: len(x) for k, x in net["modified_records"].items()} == {"added": 2, "removed": 1, "edited": 1}
    ds.create_tensor("more", dtype="int")
    ds.delete_tensor("categories")
    ds.commit("three")
    frames = ds.direct_diff("main", "dev", as_dataframe=True)
    assert [c for c in frames["added_columns"].columns if c != "_uuid"] == ["more"] and "categories" in frames["removed_columns"].columns
    edited = frames["edited_rows"].collect()
    assert len(edited) == 1 and edited[0]["labels (main)"] == 1 and edited[0]["labels (dev)"] == 50
    left, right = ds.diff("main", dev)
    assert left == [] and [c["message"] for c in right] == ["two"]
    assert isinstance(ds.diff(as_dict=False), str)
    assert len(ds.get_tensor_uuids("labels", "main")) == 5
    with pytest.raises(E.CheckoutError):
        ds.delete_branch("main")
    ds.checkout("main")
    ds.delete_branch("dev")
    assert ds.branches == ["main"]


def test_owners_and_read_only(ds, spark):
    table(ds)
    ds.commit("one")
    other = v.load(ds.path, spark=spark, user="someone-else")
    with pytest.raises(E.NotAuthorized):
        other.append({"labels": 1, "categories": "x"})
    other.enable_admin_mode()
    other.append({"labels": 1, "categories": "x"})
    other.reset()
    other.disable_admin_mode()
    other.checkout("theirs", create=True)
    other.append({"labels": 1, "categories": "x"})
    other.commit()
    closed = v.load(ds.path, read_only=True, spark=spark)
    with pytest.raises(E.ReadOnly):
        closed.append({"labels": 1, "categories": "x"})
    stale = v.load(ds.path, spark=spark)
    stale.append({"labels": 1, "categories": "x"})
    ds.append({"labels": 2, "categories": "y"})
    ds.commit("first")
    with pytest.raises(E.LockTaken):
        stale.commit("second")


def test_writing_from_an_old_commit(ds):
    table(ds)
    first = ds.commit("one")
    extend(ds, [5])
    ds.commit("two")
    ds.checkout(first)
    assert not ds.is_head_node
    extend(ds, [6])
    assert ds.branch.startswith("auto_") and values(ds) == [0, 1, 2, 3, 4, 6]
    ds.commit("aside")
    ds.checkout("main")
    assert values(ds) == [0, 1, 2, 3, 4, 5]
