"""Inverted index: postings (token, position) in shards by token hash, searched with AND inside and OR between groups.

Shards are folders, so a search reads only those of its tokens, and inside them the row groups that hold the tokens:
files are sorted by token.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from versalake.errors import IndexMissing
from versalake.functions.text import Analyser
from versalake.store.files import Files


#: Groups that a shard's postings are cut into, at least; there are more where the session has more shuffle partitions.
SPREAD = 8


def postings(df: DataFrame, column: str, pos: str, analyser: Analyser | None) -> DataFrame:
    """(token, pos): every token of a row once; without an analyser the value itself is the token."""
    if analyser is None:
        return df.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("token"), F.col(pos).alias("pos"))
    return df.select(F.col(pos).alias("pos"), F.explode(F.array_distinct(analyser.tokens(F.col(column)))).alias("token")).select("token", "pos")


def match(rows: DataFrame, groups: Sequence[Sequence[str]]) -> DataFrame:
    """Positions that hold all tokens of a group, for any group."""
    spark = rows.sparkSession
    groups = [list(dict.fromkeys(g)) for g in groups if g]
    if not groups:
        return rows.select("pos").where(F.lit(False))
    wanted = spark.createDataFrame([(i, t, len(g)) for i, g in enumerate(groups) for t in g], "grp int, token string, need int")
    tokens = sorted({t for g in groups for t in g})
    met = rows.where(F.col("token").isin(tokens)).join(F.broadcast(wanted), "token")
    full = met.groupBy("pos", "grp").agg(F.count(F.lit(1)).alias("n"), F.first("need").alias("need")).where("n = need")
    return full.select("pos").distinct()


def top_tokens(rows: DataFrame, n: int) -> DataFrame:
    """The n tokens that most positions hold; ties by token."""
    return rows.groupBy("token").agg(F.count(F.lit(1)).alias("n_rows")).orderBy(F.desc("n_rows"), "token").limit(n)


class TextIndex:
    """An index under a folder. kind: `fuzzy_match` (tokens) or `exact_match` (whole values)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files, self.meta = spark, path, Files(spark), None

    @classmethod
    def create(cls, df: DataFrame, path: str, column: str, pos: str = "_pos", kind: str = "fuzzy_match", analyser: Analyser | None = None, shards: int = 16, commit: str | None = None) -> TextIndex:
        if kind not in ("fuzzy_match", "exact_match"):
            raise ValueError(f"no kind of index: {kind!r}")
        index = cls(df.sparkSession, path)
        index.files.delete(path)
        analyser = analyser or Analyser()
        index.meta = {"column": column, "pos": pos, "kind": kind, "shards": shards, "parts": [], "commit": commit, "analyser": {"pattern": analyser.pattern, "case_sensitive": analyser.case_sensitive, "stop": list(analyser.stop)}}
        index.append(df, commit)
        return index

    def load(self) -> TextIndex:
        if not self.files.exists(f"{self.path}/meta.json"):
            raise IndexMissing(self.path)
        self.meta = json.loads(self.files.read(f"{self.path}/meta.json"))
        return self

    @property
    def analyser(self) -> Analyser:
        a = self.meta["analyser"]
        return Analyser(a["pattern"], a["case_sensitive"], tuple(a["stop"]))

    def _shard(self, token: Column) -> Column:
        return F.pmod(F.xxhash64(token), F.lit(self.meta["shards"])).cast("int")

    def _write(self, rows: DataFrame, name: str) -> None:
        path = f"{self.path}/{name}"
        # A frequent token's postings are spread by position, so that no task writes all of them. The groups are rebalanced:
        # adaptive execution joins small ones and splits large ones, so a task sorts no more the larger the input is.
        spread = max(SPREAD, -(-int(self.spark.conf.get("spark.sql.shuffle.partitions")) // self.meta["shards"]))
        group = self._shard(F.col("token")) * spread + F.pmod(F.xxhash64("pos"), F.lit(spread)).cast("int")
        out = rows.withColumn("_group", group).hint("rebalance", F.col("_group")).select("token", "pos", F.expr(f"int(_group div {spread})").alias("shard"))
        out.sortWithinPartitions("shard", "token", "pos").write.partitionBy("shard").parquet(path)
        self.meta["parts"].append(path)

    def append(self, df: DataFrame, commit: str | None = None) -> None:
        """Adds the postings of rows that aren't in the index yet."""
        rows = postings(df, self.meta["column"], self.meta["pos"], self.analyser if self.meta["kind"] == "fuzzy_match" else None)
        self._write(rows, f"part-{len(self.meta['parts']):05d}")
        self.meta["commit"] = commit or self.meta["commit"]
        self.files.write(f"{self.path}/meta.json", json.dumps(self.meta))

    def rows(self) -> DataFrame:
        parts = [self.spark.read.option("basePath", p).schema("token string, pos long, shard int").parquet(p) for p in self.meta["parts"]]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def _pruned(self, tokens: Sequence[str]) -> DataFrame:
        if not tokens:
            return self.rows().where(F.lit(False))
        shards = self.spark.range(1).select(F.explode(F.array(*(F.lit(t) for t in tokens))).alias("t")).select(self._shard(F.col("t"))).distinct().collect()
        return self.rows().where(F.col("shard").isin([r[0] for r in shards]))

    def search(self, query: str) -> DataFrame:
        """Positions with all tokens of the query; in exact indexes with that very value."""
        return self.complex_search(query, False)

    def complex_search(self, query: str, alternatives: bool = True) -> DataFrame:
        """Positions with all tokens of one of the alternatives that `||` separates."""
        parts = query.split("||") if alternatives else [query]
        groups = [[p] for p in parts] if self.meta["kind"] == "exact_match" else [self.analyser.query(self.spark, p) for p in parts]
        return match(self._pruned(sorted({t for g in groups for t in g})), groups)

    def optimize(self) -> None:
        """Merges the parts of all updates into one."""
        self.reshard(self.meta["shards"])

    def reshard(self, shards: int) -> None:
        old, rows = list(self.meta["parts"]), self.rows().drop("shard")
        self.meta = self.meta | {"shards": shards, "parts": []}
        self._write(rows, f"merged-{shards}-{len(old)}-{old[-1].rsplit('/', 1)[-1]}")
        self.files.write(f"{self.path}/meta.json", json.dumps(self.meta))
        for path in old:
            self.files.delete(path)

    def hot(self, n: int) -> DataFrame:
        """The postings of the n most frequent tokens, cached."""
        tokens = [r.token for r in top_tokens(self.rows(), n).collect()]
        return self._pruned(tokens).where(F.col("token").isin(tokens)).cache()
