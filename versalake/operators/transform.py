"""Transforms by user functions: a sample gives any number of samples, or a batch a batch.

    @compute
    def f(sample_in, sample_out, scale):
        sample_out.append({"x": sample_in["x"] * scale})

    f(scale=2).eval(ds_in, ds_out)

Functions run batch by batch in `mapInPandas`; Spark plans, retries and spreads them. Without an output dataset the
result replaces the input's rows. num_workers and scheduler are accepted for old callers and not needed.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from versalake.errors import TransformError
from versalake.session import ship


class SampleOut:
    """Collects the samples that a function gives."""

    def __init__(self):
        self.rows: list[dict] = []

    def append(self, sample: dict) -> None:
        self.rows.append(dict(sample))

    def extend(self, samples: dict) -> None:
        """Columns of equal length."""
        sizes = {len(v) for v in samples.values()}
        if len(sizes) > 1:
            raise TransformError(f"columns of different lengths: { {k: len(v) for k, v in samples.items()} }")
        self.rows += [dict(zip(samples, values)) for values in zip(*samples.values())]


class Step:
    def __init__(self, function: Callable, arguments: dict, batch: bool, schema):
        self.function, self.arguments, self.batch, self.schema = function, arguments, batch, schema

    def frame(self, df: DataFrame, schema=None, skip_ok: bool = False, ignore_errors: bool = False) -> DataFrame:
        """The transformed rows. schema: of the output; by default the step's own, or the input's. skip_ok: columns
        that a sample leaves out become null; ignore_errors: samples whose function fails are left out."""
        ship(df.sparkSession)
        schema = schema or self.schema or df.schema
        if isinstance(schema, str):
            schema = T._parse_datatype_string(schema)
        names = schema.fieldNames()
        function, arguments, batch = self.function, self.arguments, self.batch

        def finished(rows: list[dict]) -> pd.DataFrame:
            for row in rows:
                missing = [n for n in names if n not in row]
                if missing and not skip_ok:
                    raise TransformError(f"a sample lacks {missing}")
                if extra := set(row) - set(names):
                    raise TransformError(f"a sample has columns that the output lacks: {sorted(extra)}")
            return pd.DataFrame({n: pd.Series([r.get(n) for r in rows], dtype=object) for n in names})

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in batches:
                if batch:
                    try:
                        out = function(rows, **arguments)
                        yield out[names]
                    except Exception as error:
                        if not ignore_errors:
                            raise TransformError(f"{function.__name__}: {error}") from error
                    continue
                made: list[dict] = []
                for sample in rows.to_dict("records"):
                    out = SampleOut()
                    try:
                        function(sample, out, **arguments)
                        finished(out.rows)
                    except Exception as error:
                        if ignore_errors:
                            continue
                        raise TransformError(f"{function.__name__}: {error}") from error
                    made += out.rows
                yield finished(made)

        return df.mapInPandas(run, schema)

    def eval(self, data_in, ds_out=None, num_workers: int = 0, scheduler: str | None = None, skip_ok: bool = False, ignore_errors: bool = False, checkpoint_interval: int = 0, schema=None, **_):
        """Runs over a dataset, a DataFrame or a list of dicts and writes to `ds_out` (default: back into data_in).
        checkpoint_interval: a commit after about so many input samples."""
        return Pipeline([self]).eval(data_in, ds_out, skip_ok=skip_ok, ignore_errors=ignore_errors, checkpoint_interval=checkpoint_interval, schema=schema)


class Pipeline:
    def __init__(self, steps: list[Step]):
        self.steps = steps

    def frame(self, df: DataFrame, schema=None, skip_ok: bool = False, ignore_errors: bool = False) -> DataFrame:
        for i, step in enumerate(self.steps):
            df = step.frame(df, schema if i == len(self.steps) - 1 else None, skip_ok, ignore_errors)
        return df

    def eval(self, data_in, ds_out=None, num_workers: int = 0, scheduler: str | None = None, skip_ok: bool = False, ignore_errors: bool = False, checkpoint_interval: int = 0, schema=None, **_):
        from versalake.dataset import Dataset

        target = ds_out if ds_out is not None else data_in
        if not isinstance(target, Dataset):
            raise TransformError("an output dataset is needed")
        schema = schema or next((s.schema for s in reversed(self.steps) if s.schema), None) or target.visible_schema() or None
        frame = data_in.frame() if isinstance(data_in, Dataset) else data_in if isinstance(data_in, DataFrame) else target.spark.createDataFrame(data_in)
        pos = "_pos" in frame.columns
        visible = [c for c in frame.columns if not c.startswith("_")]
        if ds_out is None:
            rows = self.frame(frame.orderBy("_pos").select(*visible), schema, skip_ok, ignore_errors)
            target.replace_frame(rows)
            return target
        if checkpoint_interval and pos:
            total = frame.count()
            for at in range(0, total, checkpoint_interval):
                part = frame.where((frame._pos >= at) & (frame._pos < at + checkpoint_interval)).select(*visible)
                target.extend_frame(self.frame(part, schema, skip_ok, ignore_errors))
                target.commit(f"checkpoint at {min(total, at + checkpoint_interval)}", checkpoint=True)
            return target
        target.extend_frame(self.frame((frame.orderBy("_pos") if pos else frame).select(*visible), schema, skip_ok, ignore_errors))
        return target


def compute(function: Callable | None = None, *, batch_enable: bool = False, schema=None, name: str | None = None):
    """Decorates a transform; calling it with its keyword arguments gives a Step."""

    def wrap(f: Callable):
        @functools.wraps(f)
        def make(*args, **kwargs) -> Step:
            code = f.__code__
            own = code.co_varnames[: code.co_argcount][1 if batch_enable else 2 :]
            return Step(f, dict(zip(own, args)) | kwargs, batch_enable, schema)

        return make

    return wrap(function) if function is not None else wrap


def compose(steps: list[Step]) -> Pipeline:
    return Pipeline(steps)
