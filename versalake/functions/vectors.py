"""Vector measures as column expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("l2", "inner_product", "cosine")


def _pairs(a: Column, b: Column, term) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: term(x.cast("double"), y.cast("double"))), F.lit(0.0), lambda s, t: s + t)


def squared_l2(a: Column, b: Column) -> Column:
    return _pairs(a, b, lambda x, y: (x - y) * (x - y))


def inner_product(a: Column, b: Column) -> Column:
    return _pairs(a, b, lambda x, y: x * y)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """A similarity: larger is closer. Null for a zero vector."""
    return F.try_divide(inner_product(a, b), norm(a) * norm(b))


def measure(metric: str, a: Column, b: Column) -> Column:
    """l2 is the squared distance."""
    return {"l2": squared_l2, "inner_product": inner_product, "cosine": cosine}[metric](a, b)


def ascending(metric: str) -> bool:
    """Whether smaller is closer."""
    return metric == "l2"


def class_name(ids: Column, names: list[str]) -> Column:
    """The name of a class id; null for ids without one."""
    return F.try_element_at(F.array(*(F.lit(n) for n in names)) if names else F.array().cast("array<string>"), (ids + 1).cast("int"))


def label_hash(text: Column) -> Column:
    """A 32-bit hash of a label: the first eight hexadecimal digits of its SHA-256."""
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("long")
