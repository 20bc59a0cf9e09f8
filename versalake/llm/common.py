"""What the training-data operators share: scratch tables, keyed running sums, tokenizer files."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from versalake.session import ship

#: A word: a run of anything but space, tab, newline, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: The white space of `WORD`, for trimming.
BLANKS = " \t\n\x0b\f\r"
#: Rows per Arrow batch: documents may be long, so batches are kept short.
BATCH_ROWS = 512
#: Keys with more than a `HOT`-th of all rows are at most as many: their rows of a lookup table are broadcast. Keys with
#: fewer than `LEAST` rows are never hot.
HOT, LEAST = 20_000, 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: `spark.checkpoint.dir`. Where that is unset, a folder of this machine in local
    mode, as in tests; on a cluster it must be named."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext._jsc.sc()
    if at is None and context.getCheckpointDir().isDefined():
        at = context.getCheckpointDir().get()
    if at is None:
        if not re.fullmatch(r"local(\[[^,]*(,.*)?\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="versalake-")
        spark.sparkContext.setCheckpointDir(at)
    return at if ":" in at.split("/")[0] else f"file://{at}" if at.startswith("/") else at


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/versalake-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read again: lineage ends there and lost executors cost nothing."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._scratch = path
    return back


def discard(*tables: DataFrame | str, spark: SparkSession | None = None) -> None:
    """Deletes what `written` or `scratch` made and nothing needs any more."""
    for table in tables:
        path = table if isinstance(table, str) else getattr(table, "_scratch", None)
        if path:
            session = spark or table.sparkSession
            at = session._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(session.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def short_batches(spark: SparkSession) -> None:
    """Before Python work: keeps Arrow batches short, so that very long documents don't fill a worker, and lets workers
    import this package. Plans are lazy, so the setting stays for the session; shorter ones are left alone."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
    ship(spark)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for what is run inside; then they are as before."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running_sum(df: DataFrame, groups: list[str], bucket: str, order: list[str], value: str, out: str) -> DataFrame:
    """Adds `out`: the sum of `value` over the rows of the same `groups` that come before or at this one in
    the order (bucket, *order), and `{out}_total`: the group's sum. No group is ever in one task: buckets are
    summed first (a row per group and bucket), those sums are accumulated, and each bucket adds its own rows."""
    sums = df.groupBy(*groups, bucket).agg(F.sum(value).alias("_sum"))
    within = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    before = sums.select(
        *groups,
        bucket,
        (F.sum("_sum").over(within.orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_sum")).alias("_before"),
        F.sum("_sum").over(within).alias(f"{out}_total"),
    )
    keys = [*groups, bucket]
    joined = df.alias("a").join(before.alias("b"), [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
    joined = joined.select("a.*", "b._before", f"b.{out}_total")
    rows = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return joined.withColumn(out, F.col("_before") + F.sum(value).over(rows)).drop("_before")


def join_hot(left: DataFrame, right: DataFrame, on: str | list[str], rows: int, count: str = "n") -> DataFrame:
    """Inner join of `left`, of at most `rows` rows, with a narrow lookup table that has one row a key and how many rows
    of `left` have it (`count`). No task gets all rows of a hot key: those keys are few, they are broadcast and their
    rows stay where they are; only the others are shuffled."""
    on = [on] if isinstance(on, str) else on
    limit = max(LEAST, rows // HOT)
    if rows <= limit:
        return left.join(right, on)
    hot = right.where(F.col(count) > limit)
    cold = left.join(F.broadcast(hot.select(*on)), on, "left_anti").join(right.where(F.col(count) <= limit), on)
    return left.join(F.broadcast(hot), on).unionByName(cold)


def trim() -> None:
    """Gives memory that a task has freed back to the system: Python workers outlive their tasks."""
    import ctypes

    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public tokenizer file is; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)
