"""Grouped aggregates in two styles, and per-column statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from versalake.errors import InvalidCondition
from versalake.functions.expr import class_names
from versalake.functions.vectors import class_name
from versalake.operators.filter import filter_rows

METHODS = ("count", "sum", "avg", "min", "max")


def check(df: DataFrame, group_by, selected, order_by, aggregates, method: str, methods=METHODS) -> None:
    if not group_by:
        raise InvalidCondition("group_by is needed")
    if method not in methods:
        raise InvalidCondition(f"no aggregate: {method!r}")
    known = set(df.columns)
    for name in [*group_by, *(selected or []), *(a for a in aggregates or [] if a != "*")]:
        if name not in known:
            raise InvalidCondition(f"no column: {name!r}")
    for name in selected or []:
        if name not in group_by:
            raise InvalidCondition(f"{name!r} is selected but isn't in group_by")
    for name in order_by or []:
        if name not in (selected or group_by) and name not in (aggregates or []):
            raise InvalidCondition(f"can't order by {name!r}: it's neither selected nor aggregated")
    if method != "count":
        for name in aggregates or []:
            if name == "*" or not isinstance(df.schema[name].dataType, (T.NumericType, T.ArrayType, T.BooleanType)):
                raise InvalidCondition(f"{method} takes numbers, not {name!r}")


def first_element(df: DataFrame, name: str) -> Column:
    """A cell's value; of an array its first element."""
    column, kind = F.col(f"`{name}`"), df.schema[name].dataType
    while isinstance(kind, T.ArrayType):
        column, kind = F.try_element_at(column, F.lit(1)), kind.elementType
    return column


def truthy_count(df: DataFrame, name: str) -> Column:
    """Rows whose value counts as true: not null, not zero, not empty."""
    column, kind = F.col(f"`{name}`"), df.schema[name].dataType
    if isinstance(kind, T.BooleanType):
        ok = column
    elif isinstance(kind, T.NumericType):
        ok = column != 0
    elif isinstance(kind, T.ArrayType):
        ok = F.size(column) > 0
    else:
        ok = column.cast("string") != ""
    return F.count_if(F.coalesce(ok, F.lit(False)))


def label(method: str, name: str) -> str:
    return f"{method}_{'all' if name == '*' else name}"


def _named(df: DataFrame, out: DataFrame, names: Sequence[str]) -> DataFrame:
    for name, known in class_names(df.schema).items():
        if name in names:
            out = out.withColumn(name, class_name(F.col(f"`{name}`"), known))
    return out


def _ordered(out: DataFrame, columns: Sequence[str], ties: Sequence[str], descending: bool, lexicographic: bool) -> DataFrame:
    """Sorted by `columns`; rows that are equal there ascend by `ties`, which tell all groups apart."""
    made = [F.col(f"`{c}`").cast("string") if lexicographic else F.col(f"`{c}`") for c in columns]
    rest = [F.col(f"`{c}`").cast("string") if isinstance(out.schema[c].dataType, T.MapType) else F.col(f"`{c}`") for c in ties if c not in columns or lexicographic]
    return out.orderBy(*(c.desc() if descending else c.asc() for c in made), *rest)


def aggregate(df: DataFrame, group_by: Sequence[str], selected: Sequence[str] | None = None, order_by: Sequence[str] | None = None, aggregates: Sequence[str] = ("*",), function=None, order_direction: str = "DESC", method: str = "count", lexicographic: bool = False) -> DataFrame:
    """count or sum by group, with an optional filter first. count of a column counts its truthy values, count of `*`
    rows; sum takes a cell's first element. Without order_by the largest first aggregate comes first. Of equal groups the
    one that is met first comes first where rows have positions, then the one of the smaller keys.
    lexicographic: order by the values' texts, as older code expects."""
    aggregates = list(aggregates) or ["*"]
    selected = list(selected or group_by)
    check(df, group_by, selected, order_by, aggregates, method, ("count", "sum"))
    rows = filter_rows(df, function) if function is not None else df
    made = []
    for name in aggregates:
        if method == "count":
            value = F.count(F.lit(1)) if name == "*" else truthy_count(df, name)
        else:
            value = F.sum(first_element(df, name))
        made.append(value.alias(label(method, name)))
    ties = list(group_by)
    if "_pos" in df.columns:
        made.append(F.min("_pos").alias("_first_pos"))
        ties.insert(0, "_first_pos")
    out = _named(df, rows.groupBy(*(f"`{g}`" for g in group_by)).agg(*made), group_by)
    by = [o if o in selected else label(method, o) for o in order_by or []] or [label(method, aggregates[0])]
    out = _ordered(out, by, ties, order_direction == "DESC" or not order_by, lexicographic and bool(order_by))
    return out.select(*(f"`{s}`" for s in selected), *(label(method, a) for a in aggregates))


def aggregate_vectorized(df: DataFrame, group_by: Sequence[str], selected: Sequence[str] | None = None, order_by: Sequence[str] | None = None, aggregates: Sequence[str] | None = None, order_direction: str = "ASC", method: str = "count") -> DataFrame:
    """count, sum, avg, min or max by group over all rows; without aggregates the distinct keys. count counts rows.
    Without order_by groups come sorted by their keys; so do groups that order_by leaves equal."""
    selected = list(selected or group_by)
    check(df, group_by, selected, order_by, aggregates, method)
    if not aggregates:
        out = _named(df, df.select(*(f"`{g}`" for g in group_by)).distinct(), group_by)
        out = _ordered(out, list(order_by or selected), group_by, order_direction == "DESC" and bool(order_by), False)
        return out.select(*(f"`{s}`" for s in selected))
    functions = {"count": lambda n: F.count(F.lit(1)), "sum": lambda n: F.sum(first_element(df, n)), "avg": lambda n: F.avg(first_element(df, n)), "min": lambda n: F.min(first_element(df, n)), "max": lambda n: F.max(first_element(df, n))}
    made = [functions[method](a).alias(label(method, a)) for a in aggregates]
    out = _named(df, df.groupBy(*(f"`{g}`" for g in group_by)).agg(*made), group_by)
    by = [o if o in selected else label(method, o) for o in order_by or []] or selected
    out = _ordered(out, by, group_by, order_direction == "DESC" and bool(order_by), False)
    return out.select(*(f"`{s}`" for s in selected), *(label(method, a) for a in aggregates))


def statistics(df: DataFrame, columns: Sequence[str] | None = None, bins: int = 10, exact: bool = False) -> DataFrame:
    """A row per column: count, nan_count, nan_proportion, min, max, mean, median, std (population) and a histogram
    of `bins` even bins. Texts are measured by their length. One pass for the moments, one for the histograms. The median
    is that of a sketch, within a ten-thousandth of the rows; exact=True counts every distinct value in one task."""
    spark = df.sparkSession
    names = [f.name for f in df.schema.fields if (columns is None or f.name in columns) and not f.name.startswith("_") and isinstance(f.dataType, (T.NumericType, T.StringType))]
    values = {n: (F.char_length(f"`{n}`") if isinstance(df.schema[n].dataType, T.StringType) else F.col(f"`{n}`")).cast("double") for n in names}
    schema = "column string, num_examples long, nan_count long, nan_proportion double, min double, max double, mean double, median double, std double, histogram array<long>"
    if not names:
        return spark.createDataFrame([], schema)
    fine = {n: F.when(~F.isnan(v), v) for n, v in values.items()}
    median = F.median if exact else (lambda c: F.approx_percentile(c, 0.5, 10_000))
    made = [F.count(F.lit(1)).alias("n")]
    for i, n in enumerate(names):
        v = fine[n]
        made += [F.count(v).alias(f"c{i}"), F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}"), F.avg(v).alias(f"m{i}"), median(v).alias(f"md{i}"), F.stddev_pop(v).alias(f"s{i}")]
    row = df.agg(*made).first()
    counts = []
    for i, n in enumerate(names):
        low, high = row[f"lo{i}"], row[f"hi{i}"]
        for b in range(bins):
            if low is None or low == high:
                inside = fine[n].isNotNull() & F.lit(b == bins // 2)
            else:
                inside = F.least(F.width_bucket(fine[n], F.lit(low), F.lit(high), F.lit(bins)), F.lit(bins)) == b + 1
            counts.append(F.count_if(inside).alias(f"h{i}_{b}"))
    bars = df.agg(*counts).first()
    out = []
    for i, n in enumerate(names):
        missing = row.n - row[f"c{i}"]
        out.append((n, row.n, missing, missing / row.n if row.n else None, row[f"lo{i}"], row[f"hi{i}"], row[f"m{i}"], row[f"md{i}"], row[f"s{i}"], [bars[f"h{i}_{b}"] for b in range(bins)]))
    return spark.createDataFrame(out, schema)


def summary(df: DataFrame) -> DataFrame:
    """A row per column: name, htype, dtype, Spark type, compression, shortest and longest first axis."""
    spark = df.sparkSession
    arrays = [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)]
    sizes = df.agg(*(x for a in arrays for x in (F.min(F.size(f"`{a}`")).alias(f"lo_{a}"), F.max(F.size(f"`{a}`")).alias(f"hi_{a}")))).first().asDict() if arrays else {}
    rows = []
    for f in df.schema.fields:
        meta = f.metadata or {}
        rows.append((f.name, meta.get("htype", "generic"), meta.get("dtype") or f.dataType.simpleString(), f.dataType.simpleString(), meta.get("compression") or None, sizes.get(f"lo_{f.name}"), sizes.get(f"hi_{f.name}")))
    return spark.createDataFrame(rows, "name string, htype string, dtype string, type string, compression string, shortest int, longest int")
