"""Sources: CSV, JSON lines, records and media files, as DataFrames with typed columns."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from versalake.session import ship
from versalake.types import DTYPES, KINDS, Column


def convert_schema(schema: dict, parent: str = "") -> dict[str, str]:
    """A nested schema as {dotted name: htype or dtype}."""
    out: dict[str, str] = {}
    for key, value in schema.items():
        name = f"{parent}.{key}" if parent else key
        out |= convert_schema(value, name) if isinstance(value, dict) else {name: value}
    return out


def column_of(name: str, kind) -> Column:
    """A column from its htype, its dtype or (htype, dtype, compression)."""
    if isinstance(kind, (list, tuple)):
        htype, dtype, compression = (*kind, None, None)[:3]
        return Column(name, htype or "generic", dtype or None, None, {}, compression or None)
    return Column(name, kind) if kind in KINDS else Column(name, "generic", kind, 0)


def flatten(df: DataFrame, lists: bool = False) -> DataFrame:
    """Struct fields as columns `a.b`; with `lists`, arrays of values as texts joined by ", "."""

    def leaves(field: T.StructField, path: str, column):
        if isinstance(field.dataType, T.StructType):
            for f in field.dataType.fields:
                yield from leaves(f, f"{path}.{f.name}", column.getField(f.name))
        elif lists and isinstance(field.dataType, T.ArrayType) and not isinstance(field.dataType.elementType, (T.StructType, T.ArrayType)):
            yield F.array_join(column.cast("array<string>"), ", ").alias(path)
        else:
            yield column.alias(path)

    return df.select(*(c for f in df.schema.fields for c in leaves(f, f.name, F.col(f"`{f.name}`"))))


def typed(df: DataFrame, schema: dict | None) -> DataFrame:
    """Casts columns by a schema; what doesn't fit becomes null. Columns that the schema lacks stay away."""
    if not schema:
        return df
    out = []
    for name, kind in convert_schema(schema).items():
        column = column_of(name, kind)
        source = F.col(f"`{name}`") if name in df.columns else F.lit(None).cast("string")
        have = df.schema[name].dataType if name in df.columns else T.StringType()
        target = column.spark_type() if column.known else have
        if isinstance(have, T.StringType) and isinstance(target, T.ArrayType):
            value = F.from_json(source, target)
        elif isinstance(have, (T.StructType, T.ArrayType, T.MapType)) and isinstance(target, T.StringType):
            value = F.to_json(source)
        else:
            value = source.try_cast(target)
        out.append(value.alias(name, metadata=column.field().metadata if column.known else {}))
    return df.select(*out)


def read_csv(spark: SparkSession, path: str, schema: dict | None = None, path_columns: dict[str, str] | None = None) -> DataFrame:
    """A CSV file with a header; all texts unless a schema says otherwise. path_columns: columns that hold file paths
    and how those are taken: read (bytes), text or json."""
    names = None
    df = spark.read.option("header", True).option("inferSchema", False).option("multiLine", True).option("escape", '"').csv(path)
    first = df.columns[0] if df.columns else None
    if first and first.startswith("﻿"):
        names = [first.lstrip("﻿"), *df.columns[1:]]
        df = df.toDF(*names)
    df = typed(df, schema)
    for name, how in (path_columns or {}).items():
        df = load_paths(df, name, how)
    return df


def load_paths(df: DataFrame, column: str, how: str = "read") -> DataFrame:
    """Replaces file paths by the files' content, read where the task runs."""
    ship(df.sparkSession)
    kind = {"read": "binary", "text": "string", "json": "string"}[how]

    @F.pandas_udf(kind)
    def content(paths: pd.Series) -> pd.Series:
        from pyarrow import fs

        def one(path):
            if path is None:
                return None
            system, at = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
            with system.open_input_stream(at) as stream:
                raw = stream.read()
            return raw if how == "read" else raw.decode() if how == "text" else json.dumps(json.loads(raw))

        return paths.map(one)

    return df.withColumn(column, content(F.col(f"`{column}`")))


def read_json(spark: SparkSession, path: str, schema: dict | None = None, lists: bool = False) -> DataFrame:
    """JSON lines; nested objects become dotted columns."""
    return typed(flatten(spark.read.json(path), lists), schema)


def records(spark: SparkSession, rows: Sequence[dict], schema: dict | None = None, lists: bool = True) -> DataFrame:
    """Records in memory. Texts that hold a JSON object are taken as that object; nested objects become dotted
    columns, lists of values texts joined by ", "."""

    def parsed(value):
        if isinstance(value, str) and value[:1] in "{[":
            try:
                return json.loads(value)
            except ValueError:
                return value
        return value

    def flat(row: dict, parent: str = ""):
        for key, value in row.items():
            value, name = parsed(value), f"{parent}.{key}" if parent else key
            if isinstance(value, dict):
                yield from flat(value, name)
            elif lists and isinstance(value, list) and not any(isinstance(v, (dict, list)) for v in value):
                yield name, ", ".join(map(str, value))
            else:
                yield name, json.dumps(value) if isinstance(value, list) else value

    made = [dict(flat(r)) for r in rows]
    names = list(dict.fromkeys(k for r in made for k in r))
    if not names:
        return spark.createDataFrame([], T.StructType([]))
    fields = []
    for n in names:
        column = Column(n)
        for r in made:
            if r.get(n) is not None:
                column.learn(r[n])
                break
        values = [r.get(n) for r in made]
        if column.dtype == "int64" and any(isinstance(v, float) for v in values):
            column = Column(n, "generic", "float64", 0)
        fields.append(T.StructField(n, column.spark_type() if column.known else DTYPES["str"]))
    kinds = {f.name: f.dataType for f in fields}
    fit = lambda n, v: float(v) if v is not None and isinstance(kinds[n], T.DoubleType) else v
    return typed(spark.createDataFrame([tuple(fit(n, r.get(n)) for n in names) for r in made], T.StructType(fields)), schema)


def read_media(spark: SparkSession, path: str) -> DataFrame:
    """Files as (path, modificationTime, length, content)."""
    return spark.read.format("binaryFile").load(path)


def tiled(sample_shape: Sequence[int], tile_shape: Sequence[int]) -> list[dict]:
    """The tiles of an empty sample: where each begins and its shape; edge tiles are smaller."""
    grids = [range(0, n, t) for n, t in zip(sample_shape, tile_shape)]
    out: list[dict] = [{"start": [], "shape": []}]
    for n, t, grid in zip(sample_shape, tile_shape, grids):
        out = [{"start": [*x["start"], at], "shape": [*x["shape"], min(t, n - at)]} for x in out for at in grid]
    return out
