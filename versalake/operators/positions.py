"""Row positions: dense numbers in order, slices and lists of positions, and their composition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

POS = "_pos"
#: Rows that are numbered in one task, about.
SPAN = 1 << 16
#: Ranges that the driver knows the bounds of, at most.
RANGES = 1 << 14


def number(df: DataFrame, order: str, out: str = POS, span: int = SPAN, dense: bool | None = None) -> DataFrame:
    """Adds `out`: 0, 1, 2, ... in the order of the whole-number column `order`. Rows are cut into ranges of about even
    numbers of rows, whatever the values: the ranges are counted first, the counts accumulated, and each range numbers its
    own rows. Where values are dense (by the caller's word, or measured), ranges are `span` values wide; elsewhere they
    follow the quantiles of a sketch."""
    stat = None if dense else df.agg(F.count(order).alias("n"), F.min(order).alias("low"), F.max(order).alias("high")).first()
    if stat is None or not stat.n or stat.high - stat.low < 4 * max(stat.n, span):
        bounds = F.floor(F.col(order) / span)
    else:
        parts = int(min(RANGES, max(2, -(-stat.n // span))))
        found = df.agg(F.approx_percentile(order, [i / parts for i in range(1, parts)], 20 * parts)).first()[0]
        # How many cuts lie below a value, by halving.
        cuts, most = sorted(set(found)), (1 << 63) - 1
        held, steps = F.lit(cuts), [1 << i for i in reversed(range(len(cuts).bit_length()))]
        below = lambda at, step: F.coalesce(F.get(held, at + step - 1), F.lit(most)) < F.col(order)
        bounds = F.aggregate(F.lit(steps), F.lit(0), lambda at, step: F.when(below(at, step), at + step).otherwise(at))
    cut = df.withColumn("_range", bounds.cast("long"))
    counts = cut.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    # One row per range: some thousand times fewer than rows.
    before = counts.select(F.col("_range").alias("_of"), (F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(order))
    met = cut.join(before, F.col("_range").eqNullSafe(F.col("_of")))
    return met.withColumn(out, (F.col("_before") + within - 1).cast("long")).drop("_range", "_of", "_before")


def resolve(item, length: int) -> tuple[str, object]:
    """An index as ("slice", (start, stop, step)) or ("list", [positions]) within `length` rows."""
    if isinstance(item, slice):
        return "slice", item.indices(length)
    if isinstance(item, (int,)) and not isinstance(item, bool):
        at = item + length if item < 0 else item
        if not 0 <= at < length:
            raise IndexError(f"position {item} of {length}")
        return "list", [at]
    if isinstance(item, Sequence):
        return "list", [resolve(i, length)[1][0] for i in item]
    raise TypeError(f"no position: {item!r}")


def compose(outer: slice, inner: slice) -> slice:
    """The slice that takes `inner` of what `outer` gives. Bounds are not negative."""
    for s in (outer, inner):
        if any(v is not None and v < 0 for v in (s.start, s.stop)) or (s.step is not None and s.step <= 0):
            raise IndexError("slices with negative bounds can't be composed")
    start, step = outer.start or 0, outer.step or 1
    first = start + (inner.start or 0) * step
    stops = [v for v in (outer.stop, None if inner.stop is None else start + inner.stop * step) if v is not None]
    return slice(first, min(stops) if stops else None, step * (inner.step or 1))


def take_slice(df: DataFrame, start: int, stop: int, step: int = 1, pos: str = POS) -> DataFrame:
    """Rows at start, start + step, ... before stop: a range filter that row groups are pruned by."""
    if step < 0:
        span = range(start, stop, step)
        return take_slice(df, span[-1], start + 1, -step, pos) if len(span) else df.where(F.lit(False))
    out = df.where((F.col(pos) >= start) & (F.col(pos) < stop))
    return out if step == 1 else out.where((F.col(pos) - start) % step == 0)


def take_list(df: DataFrame, positions: Sequence[int], pos: str = POS, order: str = "_ord") -> DataFrame:
    """Rows at the positions, as often and in the order that they are listed; `order` numbers the list. The list is
    the caller's own, so it is broadcast."""
    spark = df.sparkSession
    wanted = spark.createDataFrame([(i, int(p)) for i, p in enumerate(positions)], f"{order} long, _want long")
    low, high = (min(positions), max(positions)) if len(positions) else (0, -1)
    near = df.where(F.col(pos).between(low, high))
    return near.join(F.broadcast(wanted), F.col(pos) == F.col("_want")).drop("_want")
