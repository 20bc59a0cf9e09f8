"""Sinks: pandas, Arrow, Parquet and JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versalake.errors import TooLarge

#: Rows that are brought to the driver without an explicit yes.
MOST_ROWS = 100_000


def to_pandas(df: DataFrame, rows: int, force: bool = False):
    if rows > MOST_ROWS and not force:
        raise TooLarge(f"{rows} rows; pass force=True or write to Parquet")
    return df.toPandas()


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines; for a path that ends in .json one file with an array, written by the driver from an iterator."""
    if not path.endswith(".json"):
        df.write.json(path)
        return
    from versalake.store.files import Files

    lines = (r[0] for r in df.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)))).toLocalIterator())
    Files(df.sparkSession).write(path, "[" + ",\n".join(lines) + "]")


class ArrowView:
    """A dataset in Arrow's terms: filter, head, take, count_rows, sort_by, to_table, to_batches."""

    def __init__(self, ds, columns: Sequence[str] | None = None, frame: DataFrame | None = None):
        self.ds, self.columns = ds, list(columns) if columns else [c.name for c in ds.columns()]
        self.rows = frame if frame is not None else ds.frame()

    def _with(self, frame: DataFrame) -> ArrowView:
        return ArrowView(self.ds, self.columns, frame)

    def _ordered(self) -> DataFrame:
        return self.rows.orderBy(*(["_sort"] if "_sort" in self.rows.columns else [c for c in ("_listed", "_pos") if c in self.rows.columns][:1]))

    def _out(self, df: DataFrame) -> DataFrame:
        return df.select(*(f"`{c}`" for c in self.columns))

    @property
    def schema(self):
        return self._out(self.rows).limit(0).toArrow().schema

    def filter(self, condition: Column | str) -> ArrowView:
        return self._with(self.rows.where(condition))

    def head(self, n: int):
        return self._out(self._ordered().limit(n)).toArrow()

    def take(self, positions: Sequence[int]):
        from versalake.operators.positions import take_list

        return self._out(take_list(self.rows.drop("_listed"), positions, order="_listed").orderBy("_listed")).toArrow()

    def count_rows(self) -> int:
        return self.rows.count()

    def sort_by(self, columns: str | Sequence[tuple[str, str]]) -> DataFrame:
        keys = [(columns, "ascending")] if isinstance(columns, str) else columns
        return self._out(self.rows.orderBy(*(F.col(c).desc() if d == "descending" else F.col(c) for c, d in keys)))

    def to_table(self):
        return self._out(self._ordered()).toArrow()

    def to_batches(self, rows: int = 131_072):
        return self.to_table().to_batches(rows)

    def join(self, *_, **__):
        raise NotImplementedError("join DataFrames: ds.frame().join(...)")
