"""A snapshot as a DataFrame: appended rows, less tombstones, with the latest overlay of every cell.

Files hold rows under the columns' keys, with `_uuid` (who the row is) and `_ord` (where it stands). A step's number
in the commit chain is its time: tombstones and overlays touch rows that were appended before them.
"""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from versalake.operators.positions import POS, number
from versalake.store.log import Log
from versalake.types import Column

UUID, ORD, SEQ = "_uuid", "_ord", "_seq"


def columns_of(stored: list[dict]) -> list[Column]:
    return [Column(**c) for c in stored]


def stored(columns: list[Column]) -> list[dict]:
    return [asdict(c) for c in columns]


def steps_of(log: Log, commit_id: str) -> list[dict]:
    """All steps from the last base on, oldest first."""
    out = []
    for commit in log.chain(commit_id):
        out = commit.steps + out
        if commit.base:
            return [{"kind": "append", "path": commit.base, "rows": commit.changes["base_rows"], "first": 0}] + out
    return out


def frame(spark: SparkSession, columns: list[Column], steps: list[dict], hidden: bool = True) -> DataFrame:
    """The rows with all columns by their names, `_uuid` and `_ord`."""
    fields = [T.StructField(c.key, c.spark_type()) for c in columns]
    appended = [(i, s) for i, s in enumerate(steps) if s["kind"] == "append"]
    base = T.StructType([T.StructField(UUID, T.LongType()), T.StructField(ORD, T.LongType()), *fields])
    rows = None
    for i, step in appended:
        part = spark.read.schema(base).parquet(step["path"]).withColumn(SEQ, F.lit(i))
        rows = part if rows is None else rows.unionByName(part)
    if rows is None:
        rows = spark.createDataFrame([], base).withColumn(SEQ, F.lit(0))
    dead = [(i, s) for i, s in enumerate(steps) if s["kind"] == "pop"]
    if dead:
        gone = None
        for i, step in dead:
            part = spark.read.schema(f"{UUID} long").parquet(step["path"]).withColumn("_gone", F.lit(i))
            gone = part if gone is None else gone.unionByName(part)
        gone = gone.groupBy(UUID).agg(F.max("_gone").alias("_gone"))
        rows = rows.join(gone, UUID, "left").where(F.col("_gone").isNull() | (F.col("_gone") < F.col(SEQ))).drop("_gone")
    over = [(i, s) for i, s in enumerate(steps) if s["kind"] == "update"]
    if over:
        patch = None
        for i, step in over:
            # A row of an overlay has, for every column, whether it is changed and to what.
            names = [c for c in columns if c.key in step["keys"]]
            kinds = T.StructType([T.StructField(UUID, T.LongType()), *(f for c in names for f in (T.StructField(f"_has_{c.key}", T.BooleanType()), T.StructField(c.key, c.spark_type())))])
            part = spark.read.schema(kinds).parquet(step["path"])
            cells = [F.when(F.coalesce(F.col(f"`_has_{c.key}`"), F.lit(False)), F.struct(F.lit(i).alias("s"), F.col(f"`{c.key}`").alias("v"))).alias(c.key) if c in names else F.lit(None).cast(T.StructType([T.StructField("s", T.IntegerType()), T.StructField("v", c.spark_type())])).alias(c.key) for c in columns]
            part = part.select(UUID, *cells)
            patch = part if patch is None else patch.unionByName(part)
        latest = patch.groupBy(UUID).agg(*(F.max_by(F.col(f"`{c.key}`"), F.col(f"`{c.key}`.s")).alias(f"_new_{c.key}") for c in columns))
        rows = rows.join(latest, UUID, "left")
        for c in columns:
            new = F.col(f"`_new_{c.key}`")
            rows = rows.withColumn(c.key, F.when(new.isNotNull() & (new["s"] > F.col(SEQ)), new["v"]).otherwise(F.col(f"`{c.key}`"))).drop(f"_new_{c.key}")
    shown = [F.col(f"`{c.key}`").alias(c.name, metadata=c.field().metadata) for c in columns if hidden or not c.hidden]
    return rows.select(UUID, ORD, *shown)


def dense(df: DataFrame, is_dense: bool) -> DataFrame:
    """Adds `_pos`. Where nothing was ever removed, the order already is the position."""
    return df.withColumn(POS, F.col(ORD)) if is_dense else number(df, ORD, dense=True)


def is_dense(steps: list[dict]) -> bool:
    """Every append continues where the rows before it ended, and no row is gone."""
    at = 0
    for step in steps:
        if step["kind"] == "pop":
            return False
        if step["kind"] == "append":
            if step.get("first", 0) != at:
                return False
            at += step.get("rows", 0)
    return True
