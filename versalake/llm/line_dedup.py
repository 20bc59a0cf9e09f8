"""Line dedup (operator 8): levelled sorted runs of line hashes.

A run is a table of line keys (two independent 64-bit hashes), bucketed and sorted by them. Each new batch
merge-anti-joins all runs: its keys that no run has become a run of level 0, with the number of documents and of lines
that hold them and the largest doc_id; its other keys become an *update* to a run's. So runs never share a key. When a
level has `fanout` runs (or updates), they are merged into one of the next level. Runs and updates meet bucket by bucket,
in order: nothing that is stored is shuffled or sorted again. A key without an update stands as its run has it; the others
add up. A line found in `min_docs` documents stays in the largest doc_id only.

A line's key is the line without blanks at its ends, A-Z lower-cased; keys of under `min_chars` code points are never
dropped. Rows with one doc_id are one document. A null or empty text is one empty line; the kept text is then empty.
A null doc_id counts as a document smaller than all others. Columns n_lines and n_dropped are replaced, all others
are kept. Empty tables give empty ones. Lines that very many documents share are few (`common.HOT`): they are broadcast
to where they lie, only the others are shuffled.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from versalake.llm.common import BLANKS, discard, join_hot, partitions, scratch, settings, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_CHARS, MIN_DOCS, BATCHES, FANOUT = 40, 5, 4, 2


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def keyed(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, text_hash, pos, h1, h2) of every line that is long enough."""
    cut = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(lines(F.col("text"))).alias("pos", "line"))
    cut = cut.withColumn("line", F.btrim("line", F.lit(BLANKS))).where(F.char_length("line") >= min_chars)
    key = F.translate("line", UPPER, LOWER)
    return cut.select("doc_id", "text_hash", "pos", F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2"))


COLUMNS = ["h1", "h2", "n_docs", "n_lines", "last"]
#: Lets Spark see that all these tables are bucketed, and sorted within buckets as they were written, one file each.
SORTED = {
    "spark.sql.legacy.bucketedTableScan.outputOrdering": "true",
    "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false",
    "spark.sql.unionOutputPartitioning": "false",
}


class LineRuns:
    """Levelled runs and updates in a folder of the shared file system. Their tables are in the session's catalog; `close`
    drops them and deletes the files."""

    def __init__(self, spark: SparkSession, path: str, fanout: int = FANOUT):
        self.spark, self.path, self.fanout = spark, path, fanout
        self.levels: list[list[str]] = [[]]
        self.updates: list[list[str]] = [[]]
        self.name, self.made = f"line_runs_{uuid.uuid4().hex}", []
        self.buckets = min(partitions(spark), 100_000)

    def store(self, rows: DataFrame) -> str:
        """Writes `rows` bucketed and sorted by (h1, h2); the name of its table."""
        table = f"{self.name}_{len(self.made)}"
        writer = rows.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2")
        with settings(self.spark, SORTED):
            writer.format("parquet").option("path", f"{self.path}/{len(self.made):06d}").saveAsTable(table)
        self.made.append(table)
        return table

    def _all(self, levels: list[list[str]]) -> list[DataFrame]:
        return [self.spark.table(t).select(*COLUMNS) for level in levels for t in level]

    def add(self, batch: DataFrame) -> str:
        """Adds a batch of (h1, h2, n_docs, n_lines, last), a row per key; it is stored unless it is bucketed already.
        Batches hold different documents. Gives the table of the keys that are new."""
        fresh = batch.select(*COLUMNS)
        earlier = self._all(self.levels)
        for run in earlier:
            fresh = fresh.join(run.select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        table = self.store(fresh)
        if earlier:
            known = batch.select(*COLUMNS).join(self.spark.table(table).select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
            self.updates[0].append(self.store(known))
            self._compact(self.updates)
        self.levels[0].append(table)
        self._compact(self.levels)
        return table

    def _compact(self, levels: list[list[str]]) -> None:
        for i, level in enumerate(levels):
            if len(level) >= self.fanout:
                if i + 1 == len(levels):
                    levels.append([])
                levels[i + 1].append(reduce(self._merge, level))
                level.clear()

    def _merge(self, one: str, two: str) -> str:
        """Two tables as one, by a merge join of their buckets; what both have adds up. (Never by grouping a union: of
        bucketed tables Spark 4.1 takes it for partitioned by key, which it isn't.)"""
        names = {c: f"_{c}" for c in COLUMNS[2:]}
        met = self.spark.table(one).join(self.spark.table(two).withColumnsRenamed(names).hint("merge"), ["h1", "h2"], "full_outer")
        sums = [(F.coalesce(c, F.lit(0)) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in ("n_docs", "n_lines")]
        return self.store(met.select("h1", "h2", *sums, F.greatest("last", "_last").alias("last")))

    def totals(self, min_docs: int = 1) -> DataFrame:
        """(h1, h2, n_docs, n_lines, last) over all batches, of the keys that `min_docs` documents hold; written."""
        with settings(self.spark, SORTED):
            return written(self.met().where(F.col("n_docs") >= min_docs), "line-totals")

    def met(self) -> DataFrame:
        """The plan of `totals`: runs and updates, bucket by bucket. It needs the settings `SORTED`."""
        out = []
        for run in self._all(self.levels):
            # No key is in two runs, so each run takes its updates by itself.
            for i, more in enumerate(self._all(self.updates)):
                more = more.select("h1", "h2", *(F.col(c).alias(f"{c}_{i}") for c in COLUMNS[2:])).hint("merge")
                run = run.join(more, ["h1", "h2"], "left")
                added = [(F.col(c) + F.coalesce(f"{c}_{i}", F.lit(0))).alias(c) for c in ("n_docs", "n_lines")]
                run = run.select("h1", "h2", *added, F.greatest("last", f"last_{i}").alias("last"))
            out.append(run)
        return reduce(DataFrame.union, out)

    def close(self) -> None:
        for table in self.made:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        discard(self.path, spark=self.spark)


def build(keys: DataFrame, batches: int = BATCHES, fanout: int = FANOUT) -> LineRuns:
    """The runs of a table of keys, in `batches` batches of documents. All batches are counted in one shuffle of sums a
    key and task, after one of distinct (key, doc_id), and lie in one bucketed table."""
    spark = keys.sparkSession
    runs = LineRuns(spark, scratch(spark, "line-runs"), fanout)
    each = keys.groupBy("h1", "h2", "doc_id").agg(F.count(F.lit(1)).alias("n")).withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)))
    sums = []
    for i in range(batches):
        mine = F.col("batch") == i
        sums += [F.count_if(mine).alias(f"n_docs_{i}"), F.sum(F.when(mine, F.col("n"))).alias(f"n_lines_{i}"), F.max(F.when(mine, F.col("doc_id"))).alias(f"last_{i}")]
    table = spark.table(runs.store(each.groupBy("h1", "h2").agg(*sums)))
    for i in range(batches):
        runs.add(table.where(F.col(f"n_docs_{i}") > 0).select("h1", "h2", *(F.col(f"{c}_{i}").alias(c) for c in COLUMNS[2:])))
    return runs


def common_lines(keys: DataFrame, min_docs: int) -> DataFrame:
    """(h1, h2, n_docs, n_lines, last) of the keys that `min_docs` documents hold."""
    runs = build(keys)
    try:
        return runs.totals(min_docs)
    finally:
        runs.close()


def dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """`docs` with the kept lines as `text`, plus n_lines (before) and n_dropped."""
    keys = written(keyed(docs, min_chars), "line-keys")
    common = common_lines(keys, min_docs)
    met = join_hot(keys, common, ["h1", "h2"], keys.count(), "n_lines").where(~F.col("doc_id").eqNullSafe(F.col("last")))
    gone = met.groupBy(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).agg(F.collect_list("pos").alias("gone"))
    # Columns of the input stay in a struct, so that none clashes with the names here.
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.xxhash64("text").alias("own"))
    on = F.col("doc.doc_id").eqNullSafe(F.col("id")) & (F.col("own") == F.col("hash"))
    rows = rows.join(gone.hint("shuffle_hash"), on, "left").withColumn("lines", lines(F.col("doc.text")))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    text = F.array_join(F.transform(kept, lambda i: F.element_at("lines", i + 1)), "\n")
    rows = rows.withColumn("kept", F.when(F.col("gone").isNull(), F.coalesce("doc.text", F.lit(""))).otherwise(text))
    size = F.when(F.col("gone").isNull(), 0).otherwise(F.size("lines") - F.size(kept))
    columns = [F.col("kept").alias(c) if c == "text" else F.col(f"doc.`{c}`") for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return rows.select(*columns, F.size("lines").cast("long").alias("n_lines"), size.cast("long").alias("n_dropped"))


def digests(docs: DataFrame) -> DataFrame:
    return dedup(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i, ls[i] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
k AS (SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.doc_id, k.i, k.line, c.key IS NOT NULL AND c.last <> k.doc_id AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
