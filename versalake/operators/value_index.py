"""Index of values: (value, position) sorted by value, for equality and ranges.

Numbers, dates, booleans and texts are indexed as they are, lists by their elements. Files hold ranges of values in order,
so a search reads those files, and inside them the row groups, whose ranges meet the wanted one; a value that very many
rows hold lies in several files. Null is in no index.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from versalake.errors import IndexMissing
from versalake.store.files import Files


def entries(df: DataFrame, column: str, pos: str) -> DataFrame:
    """(value, pos), once each."""
    cell = F.col(f"`{column}`")
    if isinstance(df.schema[column].dataType, T.ArrayType):
        return df.select(F.explode(F.array_distinct(cell)).alias("value"), F.col(pos).alias("pos")).where(F.col("value").isNotNull())
    return df.where(cell.isNotNull()).select(cell.alias("value"), F.col(pos).alias("pos"))


class ValueIndex:
    """An index under a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files, self.meta = spark, path, Files(spark), None

    @classmethod
    def create(cls, df: DataFrame, path: str, column: str, pos: str = "_pos", commit: str | None = None) -> ValueIndex:
        index = cls(df.sparkSession, path)
        index.files.delete(path)
        rows = entries(df, column, pos)
        index.meta = {"kind": "value", "column": column, "pos": pos, "commit": commit, "schema": rows.schema.json(), "parts": []}
        index.append(df, commit)
        return index

    def load(self) -> ValueIndex:
        if not self.files.exists(f"{self.path}/meta.json"):
            raise IndexMissing(self.path)
        self.meta = json.loads(self.files.read(f"{self.path}/meta.json"))
        return self

    def append(self, df: DataFrame, commit: str | None = None) -> None:
        """Adds rows that aren't in the index yet. They are cut into even ranges of (value, position)."""
        path = f"{self.path}/part-{len(self.meta['parts']):05d}"
        entries(df, self.meta["column"], self.meta["pos"]).repartitionByRange("value", "pos").sortWithinPartitions("value", "pos").write.parquet(path)
        self.meta["parts"].append(path)
        self.meta["commit"] = commit or self.meta["commit"]
        self.files.write(f"{self.path}/meta.json", json.dumps(self.meta))

    def rows(self) -> DataFrame:
        return self.spark.read.schema(T.StructType.fromJson(json.loads(self.meta["schema"]))).parquet(*self.meta["parts"])

    def where(self, condition: Column) -> DataFrame:
        """Positions (`pos`) with a value that meets a condition on `value`."""
        return self.rows().where(condition).select("pos").distinct()

    def equal(self, value) -> DataFrame:
        return self.where(F.col("value") == F.lit(value))

    def between(self, low, high) -> DataFrame:
        return self.where(F.col("value").between(low, high))

    def optimize(self) -> None:
        """Merges the parts of all updates into one."""
        old = list(self.meta["parts"])
        path = f"{self.path}/merged-{len(old)}-{old[-1].rsplit('/', 1)[-1]}"
        self.rows().repartitionByRange("value", "pos").sortWithinPartitions("value", "pos").write.parquet(path)
        self.meta["parts"] = [path]
        self.files.write(f"{self.path}/meta.json", json.dumps(self.meta))
        for part in old:
            self.files.delete(part)
