"""Differences of two row sets by `_uuid`, as plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UUID = "_uuid"


def common_columns(a: DataFrame, b: DataFrame) -> list[str]:
    return [c for c in a.columns if c in b.columns and not c.startswith("_")]


def row_changes(a: DataFrame, b: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(_uuid, change) of rows that b adds, removes or edits; edited is a row of both that differs in a column that
    both have. One full outer join."""
    names = list(columns or common_columns(a, b))
    left = a.select(F.col(UUID), F.lit(1).alias("_in_a"), *(F.col(f"`{c}`").alias(f"_a_{i}") for i, c in enumerate(names)))
    right = b.select(F.col(UUID), F.lit(1).alias("_in_b"), *(F.col(f"`{c}`").alias(f"_b_{i}") for i, c in enumerate(names)))
    met = left.join(right, UUID, "full_outer")
    differs = F.lit(False)
    for i in range(len(names)):
        differs = differs | ~F.col(f"_a_{i}").eqNullSafe(F.col(f"_b_{i}"))
    change = F.when(F.col("_in_a").isNull(), "added").when(F.col("_in_b").isNull(), "removed").when(differs, "edited")
    return met.select(UUID, change.alias("change")).where(F.col("change").isNotNull())


def added(a: DataFrame, b: DataFrame) -> DataFrame:
    return b.join(a.select(UUID), UUID, "left_anti")


def removed(a: DataFrame, b: DataFrame) -> DataFrame:
    return added(b, a)


def edited(a: DataFrame, b: DataFrame, names: tuple[str, str] = ("id_1", "id_2")) -> DataFrame:
    """Edited rows with both values of every common column: `column (id_1)`, `column (id_2)`."""
    columns = common_columns(a, b)
    left = a.select(UUID, *(F.col(f"`{c}`").alias(f"{c} ({names[0]})") for c in columns))
    right = b.select(UUID, *(F.col(f"`{c}`").alias(f"{c} ({names[1]})") for c in columns))
    met = left.join(right, UUID)
    differs = F.lit(False)
    for c in columns:
        differs = differs | ~F.col(f"`{c} ({names[0]})`").eqNullSafe(F.col(f"`{c} ({names[1]})`"))
    return met.where(differs).select(UUID, *(f"`{c} ({n})`" for c in columns for n in names))
