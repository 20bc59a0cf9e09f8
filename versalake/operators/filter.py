"""Filters over condition tuples.

A condition is (column, operator, value[, use_index[, "NOT"]]). Operators: > >= < <= == !=, LIKE (a regular expression
that is searched for), BETWEEN [low, high], CONTAINS "words" (all tokens; `||` separates alternatives). Connectors AND
and OR stand between conditions and fold strictly from left to right. All of it becomes one `where`: Spark pushes what
it can into the scan. `use_index` takes a condition's rows from the column's index where a dataset has a current one
(`Dataset.filter_vectorized`); the result is the same without.

Null never matches; the negation of a condition matches exactly the rows that the condition doesn't.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from versalake.errors import InvalidCondition, UnknownColumn
from versalake.functions.patterns import java
from versalake.functions.text import Analyser
from versalake.operators.positions import POS
from versalake.session import ship

COMPARISONS = (">", ">=", "<", "<=", "==", "!=")
OPERATORS = (*COMPARISONS, "LIKE", "BETWEEN", "CONTAINS")


def check(conditions: Sequence[tuple], connectors: Sequence[str] | None, schema: T.StructType) -> None:
    """Raises InvalidCondition for anything that isn't legal."""
    if not conditions:
        raise InvalidCondition("at least one condition is needed")
    connectors = connectors or []
    if len(connectors) != len(conditions) - 1:
        raise InvalidCondition(f"{len(conditions)} conditions take {len(conditions) - 1} connectors, not {len(connectors)}")
    for c in connectors:
        if c not in ("AND", "OR"):
            raise InvalidCondition(f"no connector: {c!r}")
    for condition in conditions:
        if not isinstance(condition, (tuple, list)) or not 3 <= len(condition) <= 5:
            raise InvalidCondition(f"a condition has three to five items: {condition!r}")
        name, op, value = condition[:3]
        index, negated = (*condition[3:], False, None)[:2]
        if name not in schema.fieldNames():
            raise UnknownColumn(name)
        if op not in OPERATORS:
            raise InvalidCondition(f"no operator: {op!r}")
        if not isinstance(index, bool) and index is not None:
            raise InvalidCondition("the fourth item is whether to use the index")
        if negated not in (None, "", "NOT", False):
            raise InvalidCondition("the fifth item is 'NOT' or nothing")
        kind = schema[name].dataType
        text, number = isinstance(kind, T.StringType), isinstance(value, (int, float)) and not isinstance(value, bool)
        if op == "LIKE":
            if not text or not isinstance(value, (str, re.Pattern)):
                raise InvalidCondition("LIKE takes a text column and a regular expression")
            try:
                re.compile(value)
            except re.error as error:
                raise InvalidCondition(f"{value!r} is no regular expression: {error}") from error
        elif op == "BETWEEN":
            if text or negated or not isinstance(value, (list, tuple)) or len(value) != 2:
                raise InvalidCondition("BETWEEN takes a column of numbers and [low, high], and no NOT")
        elif op == "CONTAINS":
            if not text or not isinstance(value, str) or negated:
                raise InvalidCondition("CONTAINS takes a text column and words, and no NOT")
        elif op in (">", ">=", "<", "<="):
            if index:
                raise InvalidCondition(f"no index serves {op}")
            if not (number or hasattr(value, "year")) or text:
                raise InvalidCondition(f"{op} compares numbers")
        else:
            if isinstance(value, (list, tuple, dict, set)):
                raise InvalidCondition(f"{op} takes one value")
            if index and (negated or op == "!="):
                raise InvalidCondition("an index lookup is an equality that isn't negated")
            if text != isinstance(value, str) and not (isinstance(value, str) and "class_names" in (schema[name].metadata or {})):
                raise InvalidCondition(f"{name} and {value!r} don't compare")


def like(column: Column, pattern: str | re.Pattern, spark=None) -> Column:
    """Whether Python's `re.search` finds the pattern in the text: in Java where it can be said there, in batches of
    Python elsewhere."""
    said = java(pattern)
    if said is not None:
        return column.rlike(said)
    if spark is not None:
        ship(spark)
    found = re.compile(pattern)

    @F.pandas_udf("boolean")
    def search(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t is not None and found.search(t) is not None).astype(bool)

    return search(column)


def contains(column: Column, words: str, analyser: Analyser, spark) -> Column:
    """All tokens of one of the alternatives that `||` separates."""
    tokens, out = analyser.tokens(column), F.lit(False)
    for part in words.split("||"):
        wanted = analyser.query(spark, part)
        if wanted:
            have = F.size(F.array_intersect(tokens, F.array(*(F.lit(w) for w in wanted)))) == len(wanted)
            out = out | have
    return out


def one(condition: tuple, schema: T.StructType, spark, analyser: Analyser) -> Column:
    """A condition as a column that is never null."""
    from versalake.functions.expr import class_names

    name, op, value = condition[:3]
    column = F.col(f"`{name}`")
    names = class_names(schema).get(name)
    if names is not None and isinstance(value, str) and op in ("==", "!="):
        value = names.index(value) if value in names else -1
    if op == "LIKE":
        out = like(column, value, spark)
    elif op == "BETWEEN":
        out = column.between(*value)
    elif op == "CONTAINS":
        out = contains(column, value, analyser, spark)
    else:
        out = {">": column > value, ">=": column >= value, "<": column < value, "<=": column <= value, "==": column == value, "!=": column != value}[op]
    out = F.coalesce(out, F.lit(False))
    return ~out if len(condition) == 5 and condition[4] == "NOT" else out


def predicate(df: DataFrame, conditions: Sequence[tuple], connectors: Sequence[str] | None = None, analyser: Analyser | None = None, hits: dict[int, Column] | None = None) -> Column:
    """All conditions, folded from left to right. hits: columns that stand for conditions by their number."""
    check(conditions, connectors, df.schema)
    made = [(hits or {}).get(i) if i in (hits or {}) else one(tuple(c), df.schema, df.sparkSession, analyser or Analyser()) for i, c in enumerate(conditions)]
    out = made[0]
    for connector, c in zip(connectors or [], made[1:]):
        out = (out & c) if connector == "AND" else (out | c)
    return out


def page(df: DataFrame, offset: int = 0, limit: int | None = None, pos: str = POS) -> DataFrame:
    """Rows from position `offset` on, the first `limit` of them (0 or None: all)."""
    if offset:
        df = df.where(F.col(pos) >= offset)
    return df.orderBy(pos).limit(limit) if limit else df


def filter_vectorized(df: DataFrame, conditions: Sequence[tuple], connectors: Sequence[str] | None = None, offset: int = 0, limit: int | None = None, analyser: Analyser | None = None, pos: str = POS, found: dict[int, DataFrame] | None = None) -> DataFrame:
    """The matching rows; with offset or limit, `pos` must be a column of df. found: for conditions, by their number, the
    positions (a column `pos`, once each) that an index gives. Where all conditions must hold, these rows alone are
    met; elsewhere they are marked."""
    names, found = df.columns, found or {}
    check(conditions, connectors, df.schema)
    if "OR" not in (connectors or []):
        for hit in found.values():
            df = df.join(hit.select(F.col("pos").alias("_at")), F.col(pos) == F.col("_at"), "left_semi")
        hits = {i: F.lit(True) for i in found}
    else:
        for i, hit in found.items():
            df = df.join(hit.select(F.col("pos").alias(f"_at_{i}")), F.col(pos) == F.col(f"_at_{i}"), "left")
        hits = {i: F.col(f"_at_{i}").isNotNull() for i in found}
    rows = df.where(predicate(df, conditions, connectors, analyser, hits))
    return page(rows.select(*(f"`{n}`" for n in names)) if found else rows, offset, limit, pos)


def filter_rows(df: DataFrame, condition, offset: int = 0, limit: int | None = None, pos: str = POS) -> DataFrame:
    """Filters by an expression text, a Column, a function of the DataFrame that gives a Column, or a function of a
    row (a dict) that runs as a vectorised UDF."""
    from versalake.functions.expr import compile_expression

    if isinstance(condition, str):
        made = compile_expression(condition, df.schema)
    elif isinstance(condition, Column):
        made = condition
    elif getattr(condition, "takes_row", False):
        made = row_udf(condition, df)
    else:
        # A function of rows fails on a DataFrame in one of these ways, or gives no Column; all else is its own error.
        try:
            made = condition(df)
        except (TypeError, KeyError, AttributeError, IndexError, PySparkException):
            made = None
        if not isinstance(made, Column):
            made = row_udf(condition, df)
    return page(df.where(F.coalesce(made, F.lit(False))), offset, limit, pos)


def row_udf(function, df: DataFrame) -> Column:
    """A predicate on row dicts, a batch at a time. Function attribute `columns` names the columns that it reads; by
    default it gets all visible ones."""
    ship(df.sparkSession)
    names = list(getattr(function, "columns", None) or [c for c in df.columns if not c.startswith("_")])

    @F.pandas_udf("boolean")
    def run(rows: pd.DataFrame) -> pd.Series:
        return pd.Series([bool(function(r)) for r in rows.to_dict("records")], dtype=bool)

    return run(F.struct(*(F.col(f"`{n}`") for n in names)))


def positions(df: DataFrame, pos: str = POS) -> DataFrame:
    """The result's source positions, in order."""
    return df.select(pos).orderBy(pos)
