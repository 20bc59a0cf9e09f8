"""Order of groups whose counts are equal."""

import pytest
from pyspark.sql import functions as F

from tests.compare import DATA
from versalake.operators.aggregate import aggregate, aggregate_vectorized
from versalake.plans import registry


@pytest.fixture(scope="module")
def even(spark):
    """Forty groups of three rows each; the keys fall as positions rise."""
    return spark.range(120).select(F.col("id").alias("_pos"), F.format_string("k%02d", 39 - F.col("id") % 40).alias("k"), (F.col("id") % 40).alias("m"), F.lit(1).alias("x"), F.col("id").alias("n")).repartition(7)


def test_ties_without_positions_ascend_by_keys(even):
    rows = even.drop("_pos")
    assert [r.k for r in aggregate(rows, ["k"]).collect()] == [f"k{i:02d}" for i in range(40)]
    assert [r.k for r in aggregate(rows, ["m", "k"], ["k"]).collect()] == [f"k{39 - i:02d}" for i in range(40)]
    assert aggregate(rows, ["m", "k"], ["k"]).columns == ["k", "count_all"]


def test_ties_with_positions_stand_as_first_met(even):
    assert [r.k for r in aggregate(even, ["k"]).collect()] == [f"k{39 - i:02d}" for i in range(40)]
    assert [r.k for r in aggregate(even, ["k"], function="n >= 60").collect()][:21] == [f"k{19 - i:02d}" for i in range(20)] + ["k39"]
    assert aggregate(even, ["k"]).columns == ["k", "count_all"]


def test_ties_that_order_by_leaves_open(even):
    for direction in ("ASC", "DESC"):
        got = aggregate_vectorized(even, ["k", "m"], order_by=["x"], aggregates=["x"], order_direction=direction)
        assert [r.k for r in got.collect()] == [f"k{i:02d}" for i in range(40)] and got.columns == ["k", "m", "count_x"]
    assert [r.m for r in aggregate_vectorized(even, ["m", "k"], ["m"]).collect()] == list(range(40))


def test_default_order_on_tied_counts(spark):
    """On these rows two priorities have 3003 orders each. The SQL leaves their places open: DuckDB puts them by first
    row in one thread, now and then the other way round in several."""
    sf = str(DATA / "sf0.01")
    got = [r.o_orderpriority for r in registry.QUERIES["agg_default_order"](spark, sf).orderBy("place").collect()]
    assert got == ["4-NOT SPECIFIED", "2-HIGH", "3-MEDIUM", "5-LOW", "1-URGENT"]
