"""Named queries over the standard tables and the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versalake.functions.expr import compile_value
from versalake.functions.text import ASCII, Analyser
from versalake.functions.vectors import class_name, label_hash
from versalake.operators import aggregate as agg
from versalake.operators import knn, positions, text_index
from versalake.operators.filter import filter_rows, filter_vectorized
from versalake.session import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- filters -------------------------------------------------------------------------------------------------


@query("""SELECT l_returnflag, l_linestatus, count(*) AS count_all, round(sum(l_extendedprice), 2) AS revenue FROM lineitem
WHERE l_quantity > 30 AND l_discount <= 0.05 GROUP BY ALL""")
def filter_then_aggregate(spark, sf):
    rows = filter_vectorized(read(spark, sf, "lineitem"), [("l_quantity", ">", 30), ("l_discount", "<=", 0.05)], ["AND"])
    keys = ["l_returnflag", "l_linestatus"]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("count_all"), F.round(F.sum("l_extendedprice"), 2).alias("revenue"))


@query("""SELECT l_orderkey, l_linenumber FROM lineitem
WHERE ((l_quantity >= 45 AND l_discount < 0.02) OR l_tax == 0.08) AND l_returnflag <> 'R'""")
def filter_cmp_and_or(spark, sf):
    conditions = [("l_quantity", ">=", 45), ("l_discount", "<", 0.02), ("l_tax", "==", 0.08), ("l_returnflag", "!=", "R")]
    return filter_vectorized(read(spark, sf, "lineitem"), conditions, ["AND", "OR", "AND"]).select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' OR o_totalprice < 1000) AND o_custkey <= 700")
def filter_left_fold(spark, sf):
    return filter_vectorized(read(spark, sf, "orders"), [("o_orderstatus", "==", "F"), ("o_totalprice", "<", 1000), ("o_custkey", "<=", 700)], ["OR", "AND"]).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE NOT coalesce(o_totalprice > 200000, false)")
def filter_not(spark, sf):
    return filter_vectorized(read(spark, sf, "orders"), [("o_totalprice", ">", 200000, False, "NOT")]).select("o_orderkey")


@query("SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_type, 'STEEL$|^ECON')")
def filter_regex(spark, sf):
    return filter_vectorized(read(spark, sf, "part"), [("p_type", "LIKE", "STEEL$|^ECON")]).select("p_partkey", "p_name")


@query("SELECT p_partkey FROM part WHERE NOT regexp_matches(p_brand, '#[1-3]')")
def filter_not_regex(spark, sf):
    return filter_vectorized(read(spark, sf, "part"), [("p_brand", "LIKE", "#[1-3]", False, "NOT")]).select("p_partkey")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 50000 AND 60000.5")
def filter_between(spark, sf):
    return filter_vectorized(read(spark, sf, "orders"), [("o_totalprice", "BETWEEN", [50000, 60000.5], True)]).select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def filter_exact_match(spark, sf):
    return filter_vectorized(read(spark, sf, "customer"), [("c_mktsegment", "==", "BUILDING", True)]).select("c_custkey")


_TOKENS = "SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS t FROM documents"


@query(f"SELECT doc_id FROM ({_TOKENS}) WHERE list_has_all(t, ['the', 'and', 'with'])")
def filter_contains_tokens(spark, sf):
    return filter_vectorized(read(spark, sf, "documents"), [("text", "CONTAINS", "the AND. with")], analyser=Analyser(ASCII)).select("doc_id")


@query(f"SELECT doc_id FROM ({_TOKENS}) WHERE list_has_all(t, ['the', 'with']) OR list_has_all(t, ['der', 'und'])")
def filter_contains_groups(spark, sf):
    return filter_vectorized(read(spark, sf, "documents"), [("text", "CONTAINS", "the with||der und")], analyser=Analyser(ASCII)).select("doc_id")


@query("SELECT o_orderkey, _pos FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS _pos FROM orders) WHERE _pos >= 100 AND o_totalprice > 100000 ORDER BY _pos LIMIT 25")
def filter_offset_limit(spark, sf):
    rows = positions.number(read(spark, sf, "orders"), "o_orderkey")
    return filter_vectorized(rows, [("o_totalprice", ">", 100000)], offset=100, limit=25).select("o_orderkey", "_pos")


@query("SELECT n_nationkey FROM nation WHERE n_regionkey = 1 OR n_name LIKE '%A'")
def filter_callable(spark, sf):
    return filter_rows(read(spark, sf, "nation"), lambda df: (df.n_regionkey == 1) | df.n_name.endswith("A")).select("n_nationkey")


@query("SELECT p_partkey FROM part WHERE p_size % 7 = 3 AND length(p_name) > 10")
def filter_row_udf(spark, sf):
    def wanted(row):
        return row["p_size"] % 7 == 3 and len(row["p_name"]) > 10

    wanted.takes_row, wanted.columns = True, ["p_size", "p_name"]
    return filter_rows(read(spark, sf, "part"), wanted).select("p_partkey")


@query("SELECT o_orderkey FROM orders WHERE (o_custkey % 10 = 3 AND o_totalprice > 5000) OR o_orderpriority = '1-URGENT'")
def filter_expression_and_condition(spark, sf):
    import versalake as v

    ds = v.dataset(_scratch(spark), spark=spark)
    ds.extend_frame(read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"))
    return ds.filter("o_custkey % 10 == 3 and o_totalprice > 5000", index_query=("o_orderpriority", "==", "1-URGENT"), connector="OR").frame().select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O'")
def query_positions(spark, sf):
    return filter_vectorized(read(spark, sf, "orders"), [("o_orderstatus", "==", "O", True)]).select("o_orderkey")


# -- expressions ---------------------------------------------------------------------------------------------


@query("""SELECT p_partkey, p_retailprice / p_size AS ratio, floor(p_retailprice / p_size) AS whole, p_size - (p_size - 20) * floor(p_size / nullif(p_size - 20, 0)) AS modulo,
round(power(p_size, 2), 4) AS square, -p_size AS negative FROM part""")
def expr_arith(spark, sf):
    rows = read(spark, sf, "part")
    made = {"ratio": "p_retailprice / p_size", "whole": "p_retailprice // p_size", "modulo": "p_size % (p_size - 20)", "square": "p_size ** 2", "negative": "-p_size"}
    values = {k: compile_value(v, rows.schema).get() for k, v in made.items()}
    values["square"], values["whole"] = F.round(values["square"], 4), values["whole"].cast("double")
    values["modulo"] = values["modulo"].cast("double")
    return rows.select("p_partkey", *(c.alias(k) for k, c in values.items()))


@query("SELECT p_partkey FROM part WHERE (10 < p_size AND p_size <= 20) AND NOT (p_retailprice < 1200)")
def expr_chain(spark, sf):
    return filter_rows(read(spark, sf, "part"), "10 < p_size <= 20 and not p_retailprice < 1200").select("p_partkey")


@query("SELECT event_id FROM events WHERE event_type IN ('click', 'view') AND NOT (user_id IN (1, 2, 3)) AND (value > 0.5 OR value + 1 < 1.1)")
def expr_in(spark, sf):
    return filter_rows(read(spark, sf, "events"), "event_type in ['click', 'view'] and user_id not in (1, 2, 3) and (value > 0.5 or value + 1 < 1.1)").select("event_id")


@query("SELECT count(*) AS n FROM events WHERE (CASE WHEN user_id - user_id = 0 THEN user_id ELSE 0 END) <> 0 AND value IS NOT NULL")
def expr_truthiness(spark, sf):
    return filter_rows(read(spark, sf, "events"), "user_id and value != None").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT vec_id, list_min(CAST(embedding AS DOUBLE[])) AS low, list_max(CAST(embedding AS DOUBLE[])) AS high, round(list_avg(CAST(embedding AS DOUBLE[])), 9) AS mean, len(embedding) AS size,
CAST(embedding[1] AS DOUBLE) AS first, CAST(embedding[64] AS DOUBLE) AS last FROM embeddings""")
def expr_array_reductions(spark, sf):
    rows = read(spark, sf, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    made = {"low": "embedding.min", "high": "embedding.max", "mean": "embedding.mean", "size": "embedding.shape[0]", "first": "embedding[0]", "last": "embedding[-1]"}
    values = {k: compile_value(v, rows.schema).get() for k, v in made.items()}
    values["mean"] = F.round(values["mean"], 9)
    return rows.select("vec_id", *(c.alias(k) for k, c in values.items()))


@query("SELECT doc_id FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS t FROM documents) WHERE list_contains(t, 'der') OR (list_contains(t, 'est') AND len(t) > 100)")
def expr_array_member(spark, sf):
    rows = read(spark, sf, "documents").select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0).alias("t"))
    return filter_rows(rows, "'der' in t or (t == 'est' and t.size > 100)").select("doc_id")


@query("SELECT event_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS INT) > 50")
def expr_group_access(spark, sf):
    rows = read(spark, sf, "events").withColumn("props", F.from_json("props", "k int"))
    return filter_rows(rows, "props.k > 50").select("event_id")


@query("SELECT vec_id FROM embeddings WHERE label = 2 OR label IN (4, 5)")
def expr_class_names(spark, sf):
    rows = read(spark, sf, "embeddings")
    names = [f"class_{i}" for i in range(10)]
    import json

    rows = rows.withMetadata("label", {"class_names": json.dumps(names)})
    return filter_rows(rows, "label == 'class_2' or label in ['class_4', 'class_5', 'nothing']").select("vec_id")


# -- aggregates ----------------------------------------------------------------------------------------------


@query("SELECT l_returnflag, count(*) AS count_all FROM lineitem GROUP BY 1")
def agg_count(spark, sf):
    return agg.aggregate(read(spark, sf, "lineitem"), ["l_returnflag"])


@query("SELECT l_linestatus, count(*) FILTER (WHERE l_discount <> 0) AS count_l_discount, count(*) FILTER (WHERE l_tax <> 0) AS count_l_tax FROM lineitem GROUP BY 1")
def agg_count_truthy(spark, sf):
    return agg.aggregate(read(spark, sf, "lineitem"), ["l_linestatus"], aggregates=["l_discount", "l_tax"])


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_l_quantity FROM lineitem GROUP BY 1, 2")
def agg_sum(spark, sf):
    out = agg.aggregate(read(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], aggregates=["l_quantity"], method="sum")
    return out.withColumn("sum_l_quantity", F.round("sum_l_quantity", 2))


@query("SELECT l_returnflag, l_shipmode, n FROM (SELECT l_returnflag, l_linestatus AS l_shipmode, count(*) AS n FROM lineitem WHERE l_quantity > 25 GROUP BY 1, 2)")
def agg_filtered(spark, sf):
    out = agg.aggregate(read(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], function="l_quantity > 25")
    return out.withColumnsRenamed({"l_linestatus": "l_shipmode", "count_all": "n"})


@query("SELECT o_orderpriority, count(*) AS count_all FROM orders WHERE o_custkey % 3 = 1 GROUP BY 1")
def agg_udf_filter(spark, sf):
    def wanted(row):
        return row["o_custkey"] % 3 == 1

    wanted.takes_row, wanted.columns = True, ["o_custkey"]
    return agg.aggregate(read(spark, sf, "orders"), ["o_orderpriority"], function=wanted)


def _vectorized(method: str):
    def run(spark, sf):
        out = agg.aggregate_vectorized(read(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], aggregates=["l_extendedprice", "l_tax"], method=method)
        return out.select("l_returnflag", "l_linestatus", *(F.round(f"{method}_{c}", 4).alias(f"{method}_{c}") for c in ("l_extendedprice", "l_tax")))

    return run


for _method in ("sum", "avg", "min", "max"):
    QUERIES[f"agg_vectorized_{_method}"] = _vectorized(_method)
    ORACLES[f"agg_vectorized_{_method}"] = f"""SELECT l_returnflag, l_linestatus, round({_method}(l_extendedprice), 4) AS {_method}_l_extendedprice,
round({_method}(l_tax), 4) AS {_method}_l_tax FROM lineitem GROUP BY 1, 2"""


@query("SELECT l_linestatus, count(*) AS count_l_discount FROM lineitem GROUP BY l_returnflag, l_linestatus")
def agg_vectorized_count(spark, sf):
    return agg.aggregate_vectorized(read(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_linestatus"], aggregates=["l_discount"])


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def agg_distinct_keys(spark, sf):
    return agg.aggregate_vectorized(read(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"])


@query("SELECT o_custkey, round(sum(o_totalprice), 2) AS sum_o_totalprice FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 DESC LIMIT 10")
def agg_ordered_top(spark, sf):
    out = agg.aggregate_vectorized(read(spark, sf, "orders"), ["o_custkey"], order_by=["o_totalprice", "o_custkey"], aggregates=["o_totalprice"], order_direction="DESC", method="sum")
    return out.limit(10).withColumn("sum_o_totalprice", F.round("sum_o_totalprice", 2))


@query("SELECT CASE label WHEN 0 THEN 'zero' WHEN 1 THEN 'one' WHEN 2 THEN 'two' WHEN 3 THEN 'three' END AS label, count(*) AS count_all FROM embeddings GROUP BY label")
def agg_class_names(spark, sf):
    import json

    rows = read(spark, sf, "embeddings").withMetadata("label", {"class_names": json.dumps(["zero", "one", "two", "three"])})
    return agg.aggregate(rows, ["label"])


def _stat_sql(column: str, table: str, value: str) -> str:
    bars = ", ".join(
        f"count(*) FILTER (WHERE CASE WHEN lo = hi THEN {i} = 5 ELSE least(CAST(floor((v - lo) / (hi - lo) * 10) AS INT), 9) = {i} END)" for i in range(10)
    )
    return f"""SELECT '{column}' AS "column", count(*) AS num_examples, count(*) FILTER (WHERE v IS NULL OR isnan(v)) AS nan_count,
round(min(v), 6) AS min, round(max(v), 6) AS max, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(stddev_pop(v), 6) AS std, [{bars}] AS histogram
FROM (SELECT v, min(v) OVER () AS lo, max(v) OVER () AS hi FROM (SELECT CAST({value} AS DOUBLE) AS v FROM {table}))"""


@query(" UNION ALL ".join((_stat_sql("l_quantity", "lineitem", "l_quantity"), _stat_sql("l_linenumber", "lineitem", "l_linenumber"), _stat_sql("l_returnflag", "lineitem", "length(l_returnflag)"))))
def column_stats(spark, sf):
    out = agg.statistics(read(spark, sf, "lineitem"), ["l_quantity", "l_linenumber", "l_returnflag"], exact=True).drop("nan_proportion")
    return out.select(*(F.round(c, 6).alias(c) if c in ("min", "max", "mean", "median", "std") else c for c in out.columns))


@query()
def schema_summary(spark, sf):
    return agg.summary(read(spark, sf, "embeddings"))


# -- vectors -------------------------------------------------------------------------------------------------

_DOT = "list_sum(list_transform(generate_series(1, 64), lambda i: CAST(a.embedding[i] AS DOUBLE) * CAST(b.embedding[i] AS DOUBLE)))"
_L2 = "list_sum(list_transform(generate_series(1, 64), lambda i: (CAST(a.embedding[i] AS DOUBLE) - CAST(b.embedding[i] AS DOUBLE)) * (CAST(a.embedding[i] AS DOUBLE) - CAST(b.embedding[i] AS DOUBLE))))"
_NORM = "sqrt(list_sum(list_transform({0}.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))"


def _knn_sql(distance: str, order: str, where: str = "true", asked: str = "vec_id < 5") -> str:
    return f"""SELECT query_id, rank, vec_id, round(d, 6) AS distance FROM (SELECT a.vec_id AS query_id, b.vec_id, {distance} AS d,
row_number() OVER (PARTITION BY a.vec_id ORDER BY round({distance}, 9) {order}, b.vec_id) AS rank
FROM (SELECT * FROM embeddings WHERE {asked}) a, (SELECT * FROM embeddings WHERE {where}) b) WHERE rank <= 10"""


def _queries(rows: DataFrame) -> list[tuple[int, list[float]]]:
    return [(r.vec_id, r.embedding) for r in rows.where("vec_id < 5").orderBy("vec_id").collect()]


def _knn(metric: str, where: str | None = None):
    def run(spark, sf):
        rows = read(spark, sf, "embeddings")
        out = knn.knn(rows if where is None else rows.where(where), _queries(rows), 10, metric, "vec_id", "embedding")
        return out.withColumn("distance", F.round("distance", 6))

    return run


#: The queries of a search over a whole table: a share of it, so they grow with it.
ASKED = "vec_id % 50 = 0"


def _asked(rows: DataFrame, which: str = ASKED) -> DataFrame:
    return rows.where(which).select(F.col("vec_id").alias("query_id"), "embedding")


def _knn_blocks(metric: str, where: str | None = None):
    def run(spark, sf):
        rows = read(spark, sf, "embeddings")
        out = knn.knn_blocks(rows if where is None else rows.where(where), _asked(rows), 10, metric, "vec_id", "embedding")
        return out.withColumn("distance", F.round("distance", 6))

    return run


_COSINE = f"({_DOT}) / ({_NORM.format('a')} * {_NORM.format('b')})"
for _name, _metric, _distance, _order in (("knn_l2_blocks", "l2", _L2, "ASC"), ("knn_ip_blocks", "inner_product", _DOT, "DESC"), ("knn_cosine_blocks", "cosine", _COSINE, "DESC")):
    QUERIES[_name], ORACLES[_name] = _knn_blocks(_metric), _knn_sql(_distance, _order, asked=ASKED)
QUERIES["knn_filtered_blocks"], ORACLES["knn_filtered_blocks"] = _knn_blocks("l2", "label = 3"), _knn_sql(_L2, "ASC", "label = 3", ASKED)

for _name, _metric, _sql in (("knn_l2", "l2", _knn_sql(_L2, "ASC")), ("knn_ip", "inner_product", _knn_sql(_DOT, "DESC")), ("knn_cosine", "cosine", _knn_sql(f"({_DOT}) / ({_NORM.format('a')} * {_NORM.format('b')})", "DESC"))):
    QUERIES[_name], ORACLES[_name] = _knn(_metric), _sql
QUERIES["knn_filtered"], ORACLES["knn_filtered"] = _knn("l2", "label = 3"), _knn_sql(_L2, "ASC", "label = 3")


@query(f"SELECT vec_id, round({_L2}, 6) AS distance FROM embeddings b, (SELECT embedding FROM embeddings WHERE vec_id = 0) a")
def distance_expression(spark, sf):
    rows = read(spark, sf, "embeddings")
    one = rows.where("vec_id = 0").first().embedding
    return rows.select("vec_id", F.round(knn.distance_column("l2", F.col("embedding"), one), 6).alias("distance"))


@query(_knn_sql(_L2, "ASC"))
def knn_reranked(spark, sf):
    rows = read(spark, sf, "embeddings")
    asked = _queries(rows)
    wide = knn.knn(rows, asked, 40, "l2", "vec_id", "embedding")
    return knn.rerank(wide, rows, asked, 10, "l2", "vec_id", "embedding").withColumn("distance", F.round("distance", 6))


@query(_knn_sql(_L2, "ASC", asked=ASKED))
def knn_reranked_blocks(spark, sf):
    rows = read(spark, sf, "embeddings")
    wide = knn.knn_blocks(rows, _asked(rows), 40, "l2", "vec_id", "embedding")
    return knn.rerank(wide, rows, _asked(rows), 10, "l2", "vec_id", "embedding").withColumn("distance", F.round("distance", 6))


def _scratch(spark) -> str:
    """A fresh path in the folder that all executors share; one of this machine only in local mode."""
    return f"{shared_folder(spark)}/versalake-{uuid.uuid4().hex}"


@query()
def ivf_search(spark, sf):
    from versalake.operators.ivf import VectorIndex

    rows = read(spark, sf, "embeddings").select("vec_id", "embedding")
    index = VectorIndex.create(rows, _scratch(spark), "cells", "embedding", "IVFPQ", "l2", "vec_id", nlist=16).load(cache=False)
    # The first five are those of knn_l2, which it is compared with.
    return index.search_blocks(_asked(rows, f"{ASKED} OR vec_id < 5"), 10)


# -- text search ---------------------------------------------------------------------------------------------


@query(f"SELECT doc_id AS pos FROM ({_TOKENS}) WHERE list_has_all(t, ['the', 'that']) OR list_has_all(t, ['que', 'les'])")
def postings_search(spark, sf):
    rows = read(spark, sf, "documents").select("doc_id", "text")
    return text_index.TextIndex.create(rows, _scratch(spark), "text", "doc_id", analyser=Analyser(ASCII), shards=8).complex_search("The that||que LES")


@query("SELECT o_orderkey AS pos FROM orders WHERE o_orderpriority = '2-HIGH'")
def postings_exact(spark, sf):
    rows = read(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return text_index.TextIndex.create(rows, _scratch(spark), "o_orderpriority", "o_orderkey", kind="exact_match", shards=4).search("2-HIGH")


@query(f"SELECT token, count(*) AS n_rows FROM (SELECT doc_id, unnest(t) AS token FROM ({_TOKENS})) GROUP BY token ORDER BY n_rows DESC, token LIMIT 20")
def postings_topn(spark, sf):
    rows = text_index.postings(read(spark, sf, "documents"), "text", "doc_id", Analyser(ASCII))
    return text_index.top_tokens(rows, 20)


# -- positions and columns -----------------------------------------------------------------------------------

_NUMBERED = "(SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS _pos FROM orders)"


@query(f"SELECT o_orderkey, _pos, i AS _ord FROM {_NUMBERED}, (VALUES (0, 7), (1, 3), (2, 7), (3, 999)) AS w(i, p) WHERE _pos = p")
def take_positions(spark, sf):
    rows = positions.number(read(spark, sf, "orders"), "o_orderkey")
    return positions.take_list(rows, [7, 3, 7, 999]).select("o_orderkey", "_pos", "_ord")


@query(f"SELECT o_orderkey, _pos FROM {_NUMBERED} WHERE _pos >= 60 AND _pos < 400 AND (_pos - 60) % 35 = 0")
def take_slices(spark, sf):
    rows = positions.number(read(spark, sf, "orders"), "o_orderkey")
    s = positions.compose(slice(10, 400, 5), slice(10, None, 7))
    return positions.take_slice(rows, s.start, s.stop, s.step).select("o_orderkey", "_pos")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def projection(spark, sf):
    import versalake as v

    ds = v.dataset(_scratch(spark), spark=spark)
    ds.extend_frame(read(spark, sf, "customer"))
    return ds[["c_custkey", "c_name", "c_acctbal"]].frame().select("c_custkey", "c_name", "c_acctbal")


@query("SELECT min(len(embedding)) AS shortest, max(len(embedding)) AS longest, count(*) AS n FROM embeddings")
def shape_interval(spark, sf):
    rows = read(spark, sf, "embeddings")
    axis = agg.summary(rows).where("name = 'embedding'").select("shortest", "longest")
    return axis.crossJoin(agg.statistics(rows, ["vec_id"], exact=False).select(F.col("num_examples").alias("n")))


@query("SELECT vec_id, CASE label WHEN 0 THEN 'cat' WHEN 1 THEN 'dog' WHEN 2 THEN 'owl' END AS name FROM embeddings")
def class_label_names(spark, sf):
    return read(spark, sf, "embeddings").select("vec_id", class_name(F.col("label"), ["cat", "dog", "owl"]).alias("name"))


@query("SELECT DISTINCT p_brand, CAST(('0x' || substr(sha256(p_brand), 1, 8)) AS BIGINT) AS hash FROM part")
def label_hashes(spark, sf):
    return read(spark, sf, "part").select("p_brand", label_hash(F.col("p_brand")).alias("hash")).distinct()


# -- set operations on rows ----------------------------------------------------------------------------------


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 150000 UNION SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'")
def ids_union(spark, sf):
    return filter_vectorized(read(spark, sf, "orders"), [("o_totalprice", ">", 150000), ("o_orderstatus", "==", "P")], ["OR"]).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 150000 INTERSECT SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O'")
def ids_intersection(spark, sf):
    return filter_vectorized(read(spark, sf, "orders"), [("o_totalprice", ">", 150000), ("o_orderstatus", "==", "O")], ["AND"]).select("o_orderkey")


@query("SELECT o_orderkey FROM orders EXCEPT SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '%LOW'")
def ids_difference(spark, sf):
    return filter_vectorized(read(spark, sf, "orders"), [("o_orderpriority", "LIKE", "LOW$", False, "NOT")]).select("o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000)")
def semi_lookup(spark, sf):
    rich = filter_vectorized(read(spark, sf, "customer"), [("c_acctbal", ">", 9000)])
    return read(spark, sf, "orders").join(rich, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey", "o_totalprice")


# -- versions ------------------------------------------------------------------------------------------------


@query("""WITH b AS (SELECT c_custkey, c_name, CASE WHEN c_custkey % 10 = 1 THEN c_acctbal + 5 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 7 <> 0
  UNION ALL SELECT c_custkey + 1000000, c_name, c_acctbal FROM customer WHERE c_custkey % 50 = 0),
a AS (SELECT c_custkey, c_name, c_acctbal FROM customer)
SELECT coalesce(a.c_custkey, b.c_custkey) AS _uuid, CASE WHEN a.c_custkey IS NULL THEN 'added' WHEN b.c_custkey IS NULL THEN 'removed' ELSE 'edited' END AS change
FROM a FULL JOIN b ON a.c_custkey = b.c_custkey
WHERE a.c_custkey IS NULL OR b.c_custkey IS NULL OR a.c_name IS DISTINCT FROM b.c_name OR a.c_acctbal IS DISTINCT FROM b.c_acctbal""")
def direct_diff_rows(spark, sf):
    from versalake.store.diff import row_changes

    a = read(spark, sf, "customer").select(F.col("c_custkey").alias("_uuid"), "c_name", "c_acctbal")
    b = a.where("_uuid % 7 <> 0").withColumn("c_acctbal", F.when(F.col("_uuid") % 10 == 1, F.col("c_acctbal") + 5).otherwise(F.col("c_acctbal")))
    b = b.union(a.where("_uuid % 50 = 0").withColumn("_uuid", F.col("_uuid") + 1_000_000))
    return row_changes(a, b).select("_uuid", "change")


_SIDES = """base AS (SELECT c_custkey AS k, c_acctbal AS v FROM customer),
ours AS (SELECT k, CASE WHEN k % 10 = 1 THEN v + 1 ELSE v END AS v FROM base WHERE k % 11 <> 0 UNION ALL SELECT k + 1000000, v FROM base WHERE k % 40 = 0),
theirs AS (SELECT k, CASE WHEN k % 15 = 1 THEN v + 2 ELSE v END AS v FROM base WHERE k % 13 <> 0 UNION ALL SELECT k + 2000000, v FROM base WHERE k % 60 = 0)"""


def _sides(spark, sf):
    base = read(spark, sf, "customer").select(F.col("c_custkey").alias("_uuid"), F.col("c_custkey").alias("_pos"), F.col("c_acctbal").alias("v"))

    def side(step, gone, plus, shift, new):
        out = base.where(F.col("_uuid") % gone != 0).withColumn("v", F.when(F.col("_uuid") % step == 1, F.col("v") + plus).otherwise(F.col("v")))
        return out.union(base.where(F.col("_uuid") % new == 0).withColumns({"_uuid": F.col("_uuid") + shift, "_pos": F.col("_pos") + shift}))

    return base, side(10, 11, 1, 1_000_000, 40), side(15, 13, 2, 2_000_000, 60)


@query(f"""WITH {_SIDES}
SELECT coalesce(o.k, t.k) AS _uuid, CASE WHEN t.k IS NOT NULL AND b.k IS NOT NULL AND t.v IS DISTINCT FROM b.v THEN t.v WHEN o.k IS NOT NULL THEN o.v ELSE t.v END AS v
FROM ours o FULL JOIN theirs t ON o.k = t.k LEFT JOIN base b ON b.k = coalesce(o.k, t.k)
WHERE (b.k IS NULL) OR (o.k IS NOT NULL AND t.k IS NOT NULL) OR (o.k IS NULL AND t.v IS DISTINCT FROM b.v)""")
def merge_append_pop_update(spark, sf):
    from versalake.store.merge import merge_frames

    base, ours, theirs = _sides(spark, sf)
    return merge_frames(base, ours, theirs, append="both", pop="both", update="theirs").select("_uuid", "v")


@query(f"""WITH {_SIDES}
SELECT b.k AS _uuid, b.v AS v_base, o.v AS v_ours, t.v AS v_theirs FROM base b JOIN ours o ON b.k = o.k JOIN theirs t ON b.k = t.k
WHERE o.v IS DISTINCT FROM b.v AND t.v IS DISTINCT FROM b.v""")
def conflict_records(spark, sf):
    from versalake.store.merge import update_conflicts

    base, ours, theirs = _sides(spark, sf)
    return update_conflicts(base, ours, theirs, "v")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 300000")
def view_roundtrip(spark, sf):
    import versalake as v

    ds = v.dataset(_scratch(spark), spark=spark)
    ds.extend_frame(read(spark, sf, "orders").select("o_orderkey", "o_totalprice"))
    ds.commit("rows")
    ds.filter_vectorized([("o_totalprice", ">", 300000)]).save_view(view_id="large")
    return ds.load_view("large").frame().select("o_orderkey", "o_totalprice")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 9 <> 4 UNION ALL SELECT c_custkey, -1.0 FROM customer WHERE false")
def dataset_roundtrip(spark, sf):
    import versalake as v

    ds = v.dataset(_scratch(spark), spark=spark)
    ds.extend_frame(read(spark, sf, "customer").select("c_custkey", "c_acctbal"))
    ds.commit("rows")
    ds.pop_where(F.col("c_custkey") % 9 == 4)
    ds.commit("popped")
    return ds.frame().select("c_custkey", "c_acctbal")


# -- imports, exports, transforms ----------------------------------------------------------------------------


@query("""SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS INT) AS "props.k" FROM events""")
def import_flatten(spark, sf):
    from versalake.sources.imports import flatten

    rows = read(spark, sf, "events").select("event_id", "event_type", F.from_json("props", "k int").alias("props"))
    return flatten(rows).select("event_id", "event_type", "`props.k`")


@query("SELECT c_custkey, CAST(c_acctbal AS VARCHAR) IS NOT NULL AS present, c_name FROM customer")
def csv_roundtrip(spark, sf):
    from versalake.sources.imports import read_csv

    path = _scratch(spark)
    read(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_name").write.option("header", True).csv(path)
    rows = read_csv(spark, path, {"c_custkey": "int64", "c_acctbal": "float64", "c_name": "text"})
    return rows.select("c_custkey", F.col("c_acctbal").isNotNull().alias("present"), "c_name")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def jsonl_roundtrip(spark, sf):
    from versalake.sources.exports import write_json
    from versalake.sources.imports import read_json

    path = _scratch(spark)
    write_json(read(spark, sf, "nation"), path)
    out = read_json(spark, path)
    return out.select(F.col("n_nationkey").cast("int"), "n_name", F.col("n_regionkey").cast("int"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')) AS words FROM documents")
def map_partitions_udf(spark, sf):
    from versalake.operators.transform import compute

    @compute(batch_enable=True, schema="doc_id long, words long")
    def count_words(batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"doc_id": batch["doc_id"], "words": batch["text"].str.count(r"[^ \t\n\x0b\f\r]+")})

    return count_words().frame(read(spark, sf, "documents").select("doc_id", "text"))


@query("SELECT doc_id, i AS part FROM (SELECT doc_id, unnest(range(0, CAST(doc_id % 3 AS INT))) AS i FROM documents)")
def flat_map_udf(spark, sf):
    from versalake.operators.transform import compute

    @compute(schema="doc_id long, part long")
    def parts(sample_in, sample_out):
        for i in range(sample_in["doc_id"] % 3):
            sample_out.append({"doc_id": sample_in["doc_id"], "part": i})

    return parts().frame(read(spark, sf, "documents").select("doc_id"))


import versalake.plans.dataset_queries  # noqa: E402, F401  (registers the queries over datasets)
