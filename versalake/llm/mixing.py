"""Mixing sources to target weights (operator 3) by weighted fair queueing.

Every source offers its documents in shuffled order, `epochs` times over. A document's virtual finish time is its
source's words up to its end, divided by the source's weight; all offers are sorted by finish time and the sort is
cut where the words reach the total budget. A source that runs dry leaves its share to the others by weight.

Nothing is ordered in one task: shuffled order and finish times are cut into `BUCKETS` even ranges, whose sums are
accumulated first; only the range that the budget ends in is sorted further.

Null text has size 0; a null source is a source, the last one; documents of size 0 are in no mix (taken 0). Repeated
rows and doc_ids are offers of their own. An empty table gives an empty one. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from versalake.llm.common import running_sum, words, written

BUCKETS = 4096
WEIGHTS, SHARE, EPOCHS = (3, 1, 2), 1.5, 2


def shuffle_key(doc_id: Column, seed: str) -> Column:
    """Hexadecimal digits that put documents in an order without a pattern, the same in every run."""
    return F.md5(F.concat_ws(":", F.lit(seed), doc_id.cast("string")))


def targets(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """A row per source: source, source_size, weight, rank, level, target. Sources take the weights in turn, by code
    point, null last. `level` is where the water stands: target = least(epochs * source_size, weight * level)."""
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))  # a row per source
    turn = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    sources = sources.withColumn("rank", rank).withColumn("weight", turn)
    sources = sources.withColumn("_cap", F.lit(epochs) * F.col("source_size")).withColumn("_ratio", F.col("_cap") / F.col("weight"))
    by_ratio, whole = Window.orderBy("_ratio", "rank"), Window.partitionBy(F.lit(0))
    full = F.coalesce(F.sum("_cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    budget = F.lit(share) * F.sum("source_size").over(whole)
    sources = sources.withColumn("_level", (budget - full) / rest).withColumn("_order", F.row_number().over(by_ratio))
    fits = F.when(F.col("_level") <= F.col("_ratio"), F.col("_level"))
    level = F.coalesce(F.min_by("_level", F.when(fits.isNotNull(), F.col("_order"))).over(whole), F.max("_ratio").over(whole))
    sources = sources.withColumn("level", level)
    target = F.least(F.col("_cap").cast("double"), F.col("weight") * F.col("level"))
    return sources.select("source", "source_size", "weight", "rank", "level", target.alias("target"), budget.alias("budget"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: str = "mix", text: str = "text") -> DataFrame:
    """The decision on every document: doc_id, text_hash, source, size, source_size, target, copies, taken."""
    rows = docs.select("doc_id", "source", words(F.col(text)).alias("size"), F.xxhash64(text).alias("text_hash"), shuffle_key(F.col("doc_id"), seed).alias("key"))
    rows = written(rows, "mix-sizes")
    plan = targets(rows, weights, share, epochs)
    rows = running_sum(rows.withColumn("_range", F.substring("key", 1, 3)), ["source"], "_range", ["key", "doc_id", "size", "text_hash"], "size", "cum")
    rows = rows.alias("a").join(plan.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")))
    rows = written(rows.select("a.doc_id", "a.text_hash", "a.source", "a.size", "a.key", "a.cum", "b.source_size", "b.weight", "b.rank", "b.level", "b.target", "b.budget"), "mix-order")

    def finish(epoch: int) -> Column:
        return (F.lit(epoch) * F.col("source_size") + F.col("cum")) / F.col("weight")

    def place(epoch: int) -> Column:
        return F.struct(finish(epoch).alias("finish"), F.col("rank"), F.lit(epoch).alias("epoch"), "key", "doc_id", "size", "text_hash")

    offers = rows.where("size > 0").select("size", "level", "budget", F.explode(F.array(*map(place, range(epochs)))).alias("at"))
    bucket = F.least(F.floor(F.col("at.finish") / F.col("level") * BUCKETS), F.lit(BUCKETS + 1)).cast("int")
    offers = offers.withColumn("bucket", bucket)
    # At most BUCKETS + 2 rows come here.
    sums = sorted(offers.groupBy("bucket").agg(F.sum("size").alias("n"), F.first("budget").alias("budget")).collect())
    before, last = 0, None
    for number, n, budget in sums:
        if before + n > budget:
            last = number
            break
        before += n
    copies = F.lit(epochs)
    if last is not None:
        order = Window.partitionBy("bucket").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
        edge = offers.where(F.col("bucket") == last).withColumn("_total", F.lit(before) + F.sum("size").over(order))
        cut = edge.where(F.col("_total") > F.col("budget")).agg(F.min("at").alias("at")).first().at
        first = F.struct(*(F.lit(v).alias(k) for k, v in cut.asDict().items())).cast(offers.schema["at"].dataType)
        copies = sum(((place(e) < first).cast("int") for e in range(epochs)), F.lit(0))
    copies = F.when(F.col("size") > 0, copies).otherwise(0)
    return rows.select("doc_id", "text_hash", "source", "size", "source_size", "target", copies.cast("int").alias("copies")).withColumn("taken", F.col("size") * F.col("copies"))


def apply(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of `docs`. Rows that agree in doc_id
    and text are told apart by a number; texts are moved once."""
    who = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    right = decisions.groupBy(who.alias("_rid"), F.col("text_hash").alias("_rhash")).agg(F.sort_array(F.collect_list("copies"), False).alias("_copies"))
    right = right.where(F.col("_copies")[0] > 0)
    # Columns of the input stay in a struct, so that none clashes with the names here.
    left = docs.select(F.struct(*docs.columns).alias("doc"), who.alias("_id"), F.xxhash64("text").alias("_hash"))
    met = left.join(right.hint("shuffle_hash"), (F.col("_id") == F.col("_rid")) & (F.col("_hash") == F.col("_rhash")))
    same = Window.partitionBy("_id", "_hash").orderBy(F.lit(0))
    met = met.withColumn("_taken", F.get("_copies", F.row_number().over(same) - 1)).where("_taken > 0")
    return met.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_taken")))).select(*(F.col(f"doc.`{c}`") for c in docs.columns))


SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5('mix:' || CAST(doc_id AS VARCHAR)) AS k,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, rn, CAST(CASE (rn - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS weight
  FROM (SELECT source, source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rn FROM s)),
c AS (SELECT *, 2 * source_size AS cap, (2 * source_size) / weight AS ratio, 1.5 * (SELECT sum(source_size) FROM s) AS budget FROM w),
l AS (SELECT *, row_number() OVER (ORDER BY ratio, rn) AS o,
  (CAST(budget AS DOUBLE) - coalesce(sum(cap) OVER (ORDER BY ratio, rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY ratio, rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM c),
v AS (SELECT coalesce((SELECT lev FROM l WHERE lev <= ratio ORDER BY o LIMIT 1), (SELECT max(ratio) FROM l)) AS level),
t AS (SELECT source, source_size, weight, rn, CAST(budget AS DOUBLE) AS budget, least(CAST(cap AS DOUBLE), weight * level) AS target FROM l, v),
r AS (SELECT d.*, sum(size) OVER (PARTITION BY source ORDER BY k, doc_id ROWS UNBOUNDED PRECEDING) AS cum FROM d),
o AS (SELECT r.doc_id, r.size, r.k, t.rn, e.epoch, t.budget, (e.epoch * t.source_size + r.cum) / t.weight AS finish
  FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source, (VALUES (0), (1)) AS e(epoch) WHERE r.size > 0),
q AS (SELECT doc_id, size, budget, sum(size) OVER (ORDER BY finish, rn, epoch, k, doc_id ROWS UNBOUNDED PRECEDING) AS total FROM o),
g AS (SELECT doc_id, count(*) AS copies FROM q WHERE total <= budget GROUP BY doc_id)
SELECT r.doc_id, r.size, t.source_size, t.target, CAST(r.size * coalesce(g.copies, 0) AS BIGINT) AS taken
FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source LEFT JOIN g ON r.doc_id = g.doc_id
"""
