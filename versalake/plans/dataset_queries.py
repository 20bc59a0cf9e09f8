"""Named queries over datasets: versions, merges, edits, indexes, exports and imports, with their SQL."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import versalake as v
from versalake.functions.text import ASCII, Analyser
from versalake.operators import aggregate as agg
from versalake.operators.filter import filter_rows, filter_vectorized
from versalake.operators.text_index import TextIndex
from versalake.operators.value_index import ValueIndex
from versalake.plans.registry import _L2, _SIDES, _TOKENS, ORACLES, QUERIES, _knn_sql, _scratch, query, read

CUSTOMER = ("c_custkey", "c_name", "c_acctbal", "c_mktsegment")


def stored(spark, sf: str, name: str = "customer", columns=CUSTOMER, order: str = "c_custkey") -> v.Dataset:
    """A dataset of a table's rows, in order, committed."""
    ds = v.dataset(_scratch(spark), spark=spark)
    ds.extend_frame(read(spark, sf, name).select(*columns).orderBy(order))
    ds.commit("rows")
    return ds


# -- reading and positions -----------------------------------------------------------------------------------

_PLACED = "(SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS p FROM customer)"


@query("SELECT c_name, c_acctbal FROM customer")
def ds_projection(spark, sf):
    return stored(spark, sf)[["c_name", "c_acctbal"]].frame().select("c_name", "c_acctbal")


@query(f"SELECT c_custkey FROM {_PLACED} WHERE p BETWEEN 20 AND 99 AND (p - 20) % 6 = 0")
def ds_slice_of_slice(spark, sf):
    return stored(spark, sf)[20:100:2][::3].frame().select("c_custkey")


@query(f"SELECT c_custkey FROM {_PLACED}, (VALUES (5), (2), (5), (60)) w(x) WHERE p = x")
def ds_positions(spark, sf):
    return stored(spark, sf)[[5, 2, 5, 60]].frame().select("c_custkey")


@query(f"SELECT p AS position FROM {_PLACED} WHERE c_acctbal > 5000 AND c_mktsegment = 'BUILDING'")
def ds_filtered_positions(spark, sf):
    view = stored(spark, sf).filter_vectorized([("c_acctbal", ">", 5000), ("c_mktsegment", "==", "BUILDING")], ["AND"])
    return view.frame().select(F.col("_pos").alias("position"))


@query("SELECT c_custkey FROM customer WHERE c_acctbal < 0 OR c_mktsegment = 'MACHINERY'")
def ds_filter_with_index_query(spark, sf):
    ds = stored(spark, sf)
    ds.create_index("c_mktsegment", index_type="exact_match")
    return ds.filter("c_acctbal < 0", index_query=("c_mktsegment", "==", "MACHINERY", True), connector="OR").frame().select("c_custkey")


# -- edits ---------------------------------------------------------------------------------------------------


@query(f"SELECT c_custkey FROM {_PLACED} WHERE p NOT IN (0, 3, 77)")
def ds_pop_positions(spark, sf):
    ds = stored(spark, sf)
    ds.pop([3, 77, 0])
    return ds.frame().select("c_custkey")


@query(f"""SELECT c_custkey, CASE WHEN p IN (4, 9) THEN 'SOLD' ELSE c_mktsegment END AS c_mktsegment,
CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM {_PLACED}""")
def ds_update_cells(spark, sf):
    ds = stored(spark, sf)
    ds[[4, 9]].update({"c_mktsegment": "SOLD"})
    ds.update_where(F.col("c_acctbal") < 0, {"c_acctbal": F.lit(0.0)})
    return ds.frame().select("c_custkey", "c_mktsegment", "c_acctbal")


@query("SELECT c_custkey, c_acctbal FROM customer UNION ALL SELECT -1, 1.5 UNION ALL SELECT -2, -2.5")
def ds_append_records(spark, sf):
    ds = stored(spark, sf, columns=("c_custkey", "c_acctbal"))
    ds.append({"c_custkey": -1, "c_acctbal": 1.5})
    ds.extend([{"c_custkey": -2, "c_acctbal": -2.5}])
    return ds.frame().select("c_custkey", "c_acctbal")


@query("""SELECT 'first' AS version, c_custkey, c_acctbal FROM customer
UNION ALL SELECT 'second', c_custkey, c_acctbal + 1 FROM customer WHERE c_custkey % 5 <> 0
UNION ALL SELECT 'branch', c_custkey, 0.0 FROM customer WHERE c_mktsegment <> 'AUTOMOBILE'""")
def ds_checkout_versions(spark, sf):
    ds = stored(spark, sf)
    first = ds.commit_id
    ds.checkout("zero", create=True)
    ds.update_where(F.lit(True), {"c_acctbal": F.lit(0.0)})
    ds.pop_where(F.col("c_mktsegment") == "AUTOMOBILE")
    ds.commit("branch")
    ds.checkout("main")
    ds.update_where(F.lit(True), {"c_acctbal": F.col("c_acctbal") + 1})
    ds.pop_where(F.col("c_custkey") % 5 == 0)
    second = ds.commit("second")
    shown = [ds.at(at).frame().select(F.lit(name).alias("version"), "c_custkey", "c_acctbal") for name, at in (("first", first), ("second", second), ("branch", "zero"))]
    return shown[0].union(shown[1]).union(shown[2])


@query("SELECT c_custkey, c_acctbal FROM customer")
def ds_reset(spark, sf):
    ds = stored(spark, sf)
    ds.pop_where(F.col("c_acctbal") > 0)
    ds.update_where(F.lit(True), {"c_acctbal": F.lit(1.0)})
    ds.reset()
    return ds.frame().select("c_custkey", "c_acctbal")


@query("SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS position, c_custkey, round(c_acctbal * 2, 4) AS c_acctbal FROM customer WHERE c_custkey % 4 <> 1")
def ds_compacted(spark, sf):
    ds = stored(spark, sf)
    ds.pop_where(F.col("c_custkey") % 4 == 1)
    ds.update_where(F.lit(True), {"c_acctbal": F.col("c_acctbal") * 2})
    ds.rechunk(rows_per_file=500)
    return ds.frame().select(F.col("_pos").alias("position"), "c_custkey", F.round("c_acctbal", 4).alias("c_acctbal"))


@query("SELECT c_custkey, c_name AS label, CAST(NULL AS VARCHAR) AS note FROM customer")
def ds_columns_changed(spark, sf):
    ds = stored(spark, sf)
    ds.rename_tensor("c_name", "label")
    ds.delete_tensor("c_acctbal")
    ds.create_tensor("note", htype="text")
    ds.commit("columns")
    return ds.frame().select("c_custkey", "label", "note")


@query("""SELECT 'added' AS change, count(*) AS n FROM customer WHERE c_custkey % 50 = 0 UNION ALL SELECT 'removed', count(*) FROM customer WHERE c_custkey % 7 = 0
UNION ALL SELECT 'edited', count(*) FROM customer WHERE c_custkey % 10 = 1 AND c_custkey % 7 <> 0""")
def ds_direct_diff(spark, sf):
    ds = stored(spark, sf)
    before = ds.commit_id
    more = ds.frame().where("c_custkey % 50 = 0").select(*CUSTOMER)
    ds.update_where(F.col("c_custkey") % 10 == 1, {"c_acctbal": F.col("c_acctbal") + 5})
    ds.pop_where(F.col("c_custkey") % 7 == 0)
    ds.extend_frame(more)
    ds.commit("after")
    found = ds.direct_diff(before, ds.commit_id, as_dataframe=True)
    parts = [found[f"{k}_rows"].groupBy().agg(F.lit(k).alias("change"), F.count(F.lit(1)).alias("n")) for k in ("added", "removed", "edited")]
    return parts[0].union(parts[1]).union(parts[2])


# -- merges --------------------------------------------------------------------------------------------------


def _sides_of(spark, sf) -> v.Dataset:
    """A dataset whose main and dev changed, dropped and added rows, each in its own way."""
    ds = v.dataset(_scratch(spark), spark=spark)
    ds.extend_frame(read(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v")).orderBy("k"))
    ds.commit("base")
    ds.checkout("dev", create=True)
    for branch, step, gone, plus, shift, new in (("dev", 15, 13, 2, 2_000_000, 60), ("main", 10, 11, 1, 1_000_000, 40)):
        ds.checkout(branch)
        more = ds.frame().where(F.col("k") % new == 0).select((F.col("k") + shift).alias("k"), "v")
        ds.update_where(F.col("k") % step == 1, {"v": F.col("v") + plus})
        ds.pop_where(F.col("k") % gone == 0)
        ds.extend_frame(more)
        ds.commit(branch)
    return ds


def _merge_sql(append: str, pop: str, update: str) -> str:
    theirs_win = "true" if update == "theirs" else "o.v = b.v"
    goes = ["(b.k IS NOT NULL AND t.k IS NULL)"] if pop != "ours" else []
    goes += ["b.k IS NULL"] if append == "theirs" else []
    comes = ["b.k IS NULL"] if append != "ours" else []
    comes += ["b.k IS NOT NULL"] if pop == "theirs" else ["(b.k IS NOT NULL AND t.v <> b.v)"] if update == "theirs" else []
    return f"""WITH {_SIDES}
SELECT o.k, CASE WHEN b.k IS NOT NULL AND t.k IS NOT NULL AND t.v <> b.v AND {theirs_win} THEN t.v ELSE o.v END AS v
FROM ours o LEFT JOIN base b ON b.k = o.k LEFT JOIN theirs t ON t.k = o.k WHERE NOT ({' OR '.join(goes) or 'false'})
UNION ALL SELECT t.k, t.v FROM theirs t LEFT JOIN base b ON b.k = t.k LEFT JOIN ours o ON o.k = t.k WHERE o.k IS NULL AND ({' OR '.join(comes) or 'false'})"""


def _merge(append: str, pop: str, update: str):
    def run(spark, sf) -> DataFrame:
        ds = _sides_of(spark, sf)
        ds.merge("dev", append_resolution=append, pop_resolution=pop, update_resolution=update)
        return ds.frame().select("k", "v")

    return run


for _append, _pop, _update in product(("both", "ours", "theirs"), ("both", "ours", "theirs"), ("ours", "theirs")):
    if (("both", "ours", "theirs").index(_append) + ("both", "ours", "theirs").index(_pop)) % 2 == (_update == "theirs"):
        _name = f"ds_merge_{_append}_{_pop}_{_update}"
        QUERIES[_name], ORACLES[_name] = _merge(_append, _pop, _update), _merge_sql(_append, _pop, _update)


@query("""SELECT vec_id, name FROM (SELECT vec_id, CASE WHEN vec_id % 7 = 1 THEN 'owl' WHEN vec_id % 5 = 2 THEN 'bat' WHEN label = 0 THEN 'cat' ELSE 'dog' END AS name FROM embeddings)
UNION ALL SELECT 1000001, 'owl' UNION ALL SELECT 1000002, 'bat'""")
def ds_merge_class_names(spark, sf):
    ds = v.dataset(_scratch(spark), spark=spark)
    ds.create_tensor("label", htype="class_label", class_names=["cat", "dog"])
    ds.extend_frame(read(spark, sf, "embeddings").select("vec_id", F.least("label", F.lit(1)).alias("label")).orderBy("vec_id"))
    ds.commit("base")
    ds.checkout("dev", create=True)
    # Both branches name a class number 2, each another one.
    for branch, name, chosen, added in (("dev", "bat", F.col("vec_id") % 5 == 2, 1_000_002), ("main", "owl", F.col("vec_id") % 7 == 1, 1_000_001)):
        ds.checkout(branch)
        ds.set_info("label", class_names=["cat", "dog", name])
        ds.update_where(chosen, {"label": F.lit(2)})
        ds.append({"vec_id": added, "label": name})
        ds.commit(branch)
    ds.merge("dev", append_resolution="both", update_resolution="ours")
    names = F.array(*(F.lit(n) for n in ds.label.info["class_names"]))
    return ds.frame().select("vec_id", F.get(names, F.col("label").cast("int")).alias("name"))


@query(f"""WITH {_SIDES}, n AS (SELECT k, row_number() OVER (ORDER BY k) - 1 AS p FROM base)
SELECT 'ours' AS side, p FROM n WHERE k % 11 = 0 AND k % 13 <> 0 UNION ALL SELECT 'theirs', p FROM n WHERE k % 13 = 0 AND k % 11 <> 0""")
def ds_conflicting_pops(spark, sf):
    _, records = _sides_of(spark, sf).detect_merge_conflict("dev")
    found = [(side, p) for side, key in (("ours", "del_ori_idx"), ("theirs", "del_tar_idx")) for p in records["v"][key]]
    return spark.createDataFrame(found, "side string, p long")


# -- aggregates in order -------------------------------------------------------------------------------------


def _ranked(out: DataFrame) -> DataFrame:
    """A small result with the place of each row in it."""
    rows = out.collect()
    return out.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(rows)], "place long, " + ", ".join(f"`{n}` {t}" for n, t in out.dtypes))


@query("SELECT row_number() OVER (ORDER BY count(*) DESC) - 1 AS place, o_orderpriority, count(*) AS count_all FROM orders GROUP BY o_orderpriority")
def agg_default_order(spark, sf):
    return _ranked(agg.aggregate(read(spark, sf, "orders"), ["o_orderpriority"]))


@query("SELECT row_number() OVER (ORDER BY CAST(l_linenumber AS VARCHAR) DESC) - 1 AS place, l_linenumber, count(*) AS count_all FROM lineitem GROUP BY l_linenumber")
def agg_lexicographic_order(spark, sf):
    return _ranked(agg.aggregate(read(spark, sf, "lineitem"), ["l_linenumber"], order_by=["l_linenumber"], lexicographic=True))


@query("SELECT row_number() OVER (ORDER BY l_returnflag, l_linestatus) - 1 AS place, l_returnflag, l_linestatus, max(l_quantity) AS max_l_quantity FROM lineitem GROUP BY 2, 3")
def agg_vectorized_key_order(spark, sf):
    return _ranked(agg.aggregate_vectorized(read(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], aggregates=["l_quantity"], method="max"))


@query("SELECT p_partkey FROM part WHERE 10 < p_size AND p_size <= 20 AND NOT p_retailprice < 950")
def expr_chained(spark, sf):
    return filter_rows(read(spark, sf, "part"), "10 < p_size <= 20 and not p_retailprice < 950").select("p_partkey")


@query("SELECT count(*) AS num_examples, min(length(text)) AS shortest, max(length(text)) AS longest FROM documents")
def text_lengths(spark, sf):
    row = agg.statistics(read(spark, sf, "documents"), ["text"], exact=False)
    return row.select("num_examples", F.col("min").cast("long").alias("shortest"), F.col("max").cast("long").alias("longest"))


# -- indexes -------------------------------------------------------------------------------------------------


def _indexed_documents(spark, sf) -> v.Dataset:
    return stored(spark, sf, "documents", ("doc_id", "text", "lang", "n_chars"), "doc_id")


@query(f"SELECT doc_id FROM ({_TOKENS}) WHERE list_has_all(t, ['the', 'with']) OR list_has_all(t, ['der', 'und'])")
def ds_indexed_contains(spark, sf):
    ds = _indexed_documents(spark, sf)
    ds.create_index("text", analyser=Analyser(ASCII))
    return ds.filter_vectorized([("text", "CONTAINS", "the with||der und", True)], analyser=Analyser(ASCII)).frame().select("doc_id")


@query("SELECT doc_id FROM documents WHERE n_chars BETWEEN 500 AND 900 AND lang = 'de'")
def ds_indexed_between(spark, sf):
    ds = _indexed_documents(spark, sf)
    ds.create_index("n_chars")
    ds.create_index("lang", index_type="exact_match")
    return ds.filter_vectorized([("n_chars", "BETWEEN", [500, 900], True), ("lang", "==", "de", True)], ["AND"]).frame().select("doc_id")


@query("SELECT doc_id FROM documents WHERE (n_chars BETWEEN 500 AND 900 OR lang = 'fr') AND doc_id > 50")
def ds_indexed_or(spark, sf):
    ds = _indexed_documents(spark, sf)
    ds.create_index("n_chars")
    ds.create_index("lang", index_type="exact_match")
    return ds.filter_vectorized([("n_chars", "BETWEEN", [500, 900], True), ("lang", "==", "fr", True), ("doc_id", ">", 50)], ["OR", "AND"]).frame().select("doc_id")


@query(f"SELECT doc_id AS pos FROM ({_TOKENS}) WHERE list_has_all(t, ['the', 'that'])")
def index_appended_and_resharded(spark, sf):
    rows = read(spark, sf, "documents").select("doc_id", "text")
    index = TextIndex.create(rows.where("doc_id % 3 <> 1"), _scratch(spark), "text", "doc_id", analyser=Analyser(ASCII), shards=8)
    index.append(rows.where("doc_id % 3 = 1"))
    index.reshard(3)
    return index.search("the that")


@query("SELECT o_orderkey AS pos FROM orders WHERE o_totalprice BETWEEN 100000 AND 120000")
def index_range(spark, sf):
    rows = read(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    index = ValueIndex.create(rows.where("o_orderkey % 2 = 0"), _scratch(spark), "o_totalprice", "o_orderkey")
    index.append(rows.where("o_orderkey % 2 = 1"))
    index.optimize()
    return index.between(100000, 120000)


@query(f"SELECT DISTINCT doc_id AS pos FROM ({_TOKENS}) WHERE list_contains(t, 'les')")
def index_of_lists(spark, sf):
    rows = read(spark, sf, "documents").select("doc_id", Analyser(ASCII).tokens(F.col("text")).alias("t"))
    return ValueIndex.create(rows, _scratch(spark), "t", "doc_id").equal("les")


@query(_knn_sql(_L2, "ASC", asked="vec_id % 50 = 0"))
def vector_index_appended(spark, sf):
    from versalake.operators.ivf import VectorIndex

    rows = read(spark, sf, "embeddings").select("vec_id", "embedding")
    index = VectorIndex.create(rows.where("vec_id % 4 <> 3"), _scratch(spark), "flat", "embedding", "FLAT", "l2", "vec_id")
    index.add(rows.where("vec_id % 4 = 3"))
    asked = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return index.load(cache=False).search_blocks(asked, 10).withColumn("distance", F.round("distance", 6))


# -- views and copies ----------------------------------------------------------------------------------------


@query("SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 2000")
def ds_view_copied(spark, sf):
    ds = stored(spark, sf)
    ds.filter_vectorized([("c_acctbal", ">", 2000)]).save_view(view_id="rich", optimize=True, tensors=["c_custkey", "c_name"])
    return ds.load_view("rich").frame().select("c_custkey", "c_name")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 2 = 0")
def ds_copied(spark, sf):
    ds = stored(spark, sf).filter("c_custkey % 2 == 0").copy_to(_scratch(spark))
    return ds.frame().select("c_custkey", "c_acctbal")


# -- imports and exports -------------------------------------------------------------------------------------


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal > 0")
def parquet_export(spark, sf):
    path = _scratch(spark)
    stored(spark, sf).filter("c_acctbal > 0").write_to_parquet(path, ["c_custkey", "c_name", "c_acctbal"])
    return spark.read.parquet(path)


@query("SELECT row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) - 1 AS place, c_custkey, c_acctbal FROM customer WHERE c_custkey % 3 = 0 QUALIFY place < 50")
def arrow_export(spark, sf):
    view = stored(spark, sf).to_arrow(["c_custkey", "c_acctbal"]).filter("c_custkey % 3 = 0")
    return _ranked(view.sort_by([("c_acctbal", "descending"), ("c_custkey", "ascending")]).limit(50))


@query("SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_nested(spark, sf):
    from versalake.sources.imports import read_json

    path = _scratch(spark)
    read(spark, sf, "events").select("event_id", "event_type", F.from_json("props", "k long").alias("props")).write.json(path)
    return read_json(spark, path).select("event_id", "event_type", F.col("`props.k`").alias("k"))


@query("SELECT c_custkey, c_acctbal, c_name FROM customer")
def csv_values(spark, sf):
    from versalake.sources.imports import read_csv

    path = _scratch(spark)
    read(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_name").write.option("header", True).csv(path)
    return read_csv(spark, path, {"c_custkey": "int64", "c_acctbal": "float64", "c_name": "text"})


@query("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT n_nationkey + 100, upper(n_name) FROM nation WHERE n_regionkey = 2")
def ds_transform_into(spark, sf):
    from versalake.operators.transform import compute

    @compute(schema="n_nationkey long, n_name string")
    def doubled(sample_in, sample_out):
        sample_out.append({"n_nationkey": sample_in["n_nationkey"], "n_name": sample_in["n_name"]})
        if sample_in["n_regionkey"] == 2:
            sample_out.append({"n_nationkey": sample_in["n_nationkey"] + 100, "n_name": sample_in["n_name"].upper()})

    out = v.dataset(_scratch(spark), spark=spark)
    out.create_tensor("n_nationkey", dtype="int64")
    out.create_tensor("n_name", htype="text")
    doubled().eval(stored(spark, sf, "nation", ("n_nationkey", "n_name", "n_regionkey"), "n_nationkey"), out)
    return out.frame().select("n_nationkey", "n_name")


@query("SELECT event_id, user_id, value FROM events")
def stream_ingest(spark, sf):
    from versalake.streaming.ingest import ingest

    path = _scratch(spark)
    source = _scratch(spark)
    rows = read(spark, sf, "events").select("event_id", "user_id", "value")
    rows.repartition(3, "event_id").write.parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    ingest(stream, path, _scratch(spark)).awaitTermination()
    return v.load(path, spark=spark).frame().select("event_id", "user_id", "value")


@query("SELECT o_orderkey FROM orders WHERE NOT regexp_matches(o_orderpriority, 'U.G|^[23]') AND o_totalprice < 60000")
def filter_patterns_negated(spark, sf):
    rows = read(spark, sf, "orders")
    return filter_vectorized(rows, [("o_orderpriority", "LIKE", "U.G|^[23]", False, "NOT"), ("o_totalprice", "<", 60000)], ["AND"]).select("o_orderkey")
