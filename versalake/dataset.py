"""The dataset handle: ordered rows of typed columns with branches and commits, and views of them.

All reading gives lazy DataFrames; `frame()` is the plan behind any handle, with `_uuid` (a row's identity), `_ord`
(its place in the store's order) and `_pos` (its dense position). Writing adds files and notes them in the branch's
working state; `commit` turns that into a commit.
"""

from __future__ import annotations

import copy
import hashlib
import json
import random
import time
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from versalake import errors as E
from versalake.functions.text import Analyser
from versalake.operators import aggregate as agg
from versalake.operators import filter as flt
from versalake.operators.ivf import VectorIndex
from versalake.operators.positions import POS, number, resolve, take_list, take_slice
from versalake.operators.text_index import TextIndex
from versalake.operators.value_index import ValueIndex
from versalake.store import diff as dif
from versalake.store import snapshot as snap
from versalake.store.log import FIRST, MAIN, Commit, Log
from versalake.store.merge import Plan
from versalake.types import Column, of_spark

UUID, ORD, LISTED, STEP = snap.UUID, snap.ORD, "_listed", 1 << 12
MANY = 100_000


def _session(spark: SparkSession | None) -> SparkSession:
    return spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


class Tensor:
    """A column of a dataset or view."""

    def __init__(self, ds: Dataset, name: str):
        self.ds, self.name = ds, name
        self.meta = ds.column(name)

    def frame(self) -> DataFrame:
        return self.ds.frame().select(*self.ds._keys(), f"`{self.name}`")

    def _values(self, df: DataFrame | None = None) -> list:
        rows = self.ds._sorted(df if df is not None else self.ds.frame())
        return [r[0] for r in rows.select(f"`{self.name}`").collect()]

    def __len__(self) -> int:
        return len(self.ds)

    def __getitem__(self, item) -> Tensor:
        return Tensor(self.ds[item], self.name)

    def __setitem__(self, item, value) -> None:
        """Updates cells; an index past the end appends empty samples up to it."""
        if isinstance(item, int) and item >= self.ds._count():
            empty = {c.name: None for c in self.ds.columns()}
            self.ds.extend([dict(empty) for _ in range(item - self.ds._count())] + [empty | {self.name: value}])
            return
        self.ds[item].update({self.name: value})

    def __iter__(self) -> Iterator:
        return iter(r[0] for r in self.ds._sorted(self.ds.frame()).select(f"`{self.name}`").toLocalIterator())

    def numpy(self, aslist: bool = False, **_):
        values = self._values()
        if aslist:
            return [np.asarray(v) for v in values]
        try:
            return np.array(values)
        except ValueError:
            return np.array(values, dtype=object)

    def numpy_full(self):
        return self.numpy()

    def numpy_continuous(self, start: int = 0, stop: int | None = None):
        return self[start:stop].numpy()

    def numpy_batch_random_access(self, index_list: Sequence[int], parallel: str | None = None):
        return self[list(index_list)].numpy()

    numpy_multi_process = numpy_full

    def text(self) -> list[str]:
        return ["" if v is None else str(v) for v in self._values()]

    def dict(self) -> list:
        return [None if v is None else json.loads(v) for v in self._values()]

    def list(self) -> list:
        return self._values()

    def tobytes(self) -> list[bytes]:
        return [bytes(v) if isinstance(v, (bytes, bytearray)) else str(v).encode() for v in self._values()]

    def arrow(self):
        return self.ds._sorted(self.frame()).select(f"`{self.name}`").toArrow().column(0)

    def data(self, aslist: bool = False) -> dict:
        out: dict = {"value": self.numpy(aslist)}
        if "class_names" in self.meta.info:
            names = self.meta.info["class_names"]
            out["text"] = [names[v] if v is not None and 0 <= v < len(names) else None for v in self._values()]
        return out

    @property
    def htype(self) -> str:
        return self.meta.htype

    @property
    def dtype(self) -> str | None:
        return self.meta.dtype

    @property
    def info(self) -> dict:
        return self.meta.info

    @property
    def shape_interval(self) -> tuple:
        low, high = [], []
        column, kind = F.col(f"`{self.name}`"), self.meta.spark_type()
        while isinstance(kind, T.ArrayType):
            row = self.frame().agg(F.min(F.size(column)), F.max(F.size(column))).first()
            low.append(row[0])
            high.append(row[1])
            column, kind = F.try_element_at(column, F.lit(1)), kind.elementType
        n = len(self)
        return (n, *low), (n, *high)

    @property
    def shape(self) -> tuple:
        low, high = self.shape_interval
        return tuple(a if a == b else None for a, b in zip(low, high))

    @property
    def ndim(self) -> int:
        return len(self.shape)

    @property
    def size(self) -> int | None:
        return None if None in self.shape else int(np.prod(self.shape))

    def shapes(self) -> list[tuple]:
        return [np.asarray(v).shape for v in self._values()]

    def append(self, value) -> None:
        self.extend([value])

    def extend(self, values: Sequence) -> None:
        """Appends to this column alone: first to rows that other columns already have, then in new rows. Whole rows
        at once (the dataset's extend) are one file; this is for callers that fill columns one after another."""
        values, ds = list(values), self.ds
        total = ds._count()
        start = ds.lengths()[self.name] if len(ds.columns()) > 1 and total else total
        old = min(len(values), total - start)
        if old:
            ds[start : start + old].update({self.name: values[:old] if old > 1 else values[0]})
        if len(values) > old:
            ds.extend([{self.name: v} for v in values[old:]], append_empty=True)
        if len(ds.columns()) > 1:
            ds._state["ragged"] = len(set(ds.lengths().values())) > 1
            ds._save()

    def clear(self) -> None:
        """Empties all cells."""
        self.ds.update({self.name: None}, everywhere=True)

    def pop(self, index=None) -> None:
        raise E.VersalakeError("rows are popped from the dataset, not from one column")

    @property
    def sample_indices(self) -> list[int]:
        return self.ds.sample_indices


class Dataset:
    def __init__(self, path: str, spark: SparkSession | None = None, read_only: bool = False, user: str | None = None, address: str | None = None):
        self.spark, self.path, self.read_only = _session(spark), path.rstrip("/"), read_only
        self.log = Log(self.spark, self.path, user)
        self.log.text = self.log_text
        self.admin = False
        self._view: DataFrame | None = None
        self._names: list[str] | None = None
        self._source: Dataset | None = None
        self.filtered_index_frame: DataFrame | None = None
        self.query_string: str | None = None
        self.indexes: dict[str, VectorIndex] = {}
        self.commit_id, self.branch = self.log.resolve(address or MAIN)
        self._state = self.log.working(self.branch) if self.branch else None

    def __enter__(self) -> Dataset:
        return self

    def __exit__(self, *_) -> None:
        self.flush()

    # -- state ---------------------------------------------------------------------------------------------

    def _working(self) -> dict:
        """The branch's uncommitted state, begun if need be; from a commit that isn't a head, on a branch of its own."""
        self._writable()
        if self.branch is None:
            name = f"auto_{self.log.new_id()[:12]}"
            self.log.set_branch(name, self.commit_id)
            self.branch = name
        if self._state is None:
            self._state = {"base": self.commit_id, "columns": snap.stored(self._committed_columns()), "steps": [], "next": self._next_order(), "changes": {}, "ragged": self.log.get(self.commit_id).ragged}
        return self._state

    def _save(self) -> None:
        self.log.set_working(self.branch, self._state)

    def _writable(self) -> None:
        if self.read_only:
            raise E.ReadOnly(self.path)
        if self._view is not None:
            raise E.ReadOnly("a view can't be written; save it or write to the dataset")
        if self.branch is not None and not self.admin and self.log.branch(self.branch)["owner"] != self.log.user:
            raise E.NotAuthorized(f"branch {self.branch!r} belongs to {self.log.branch(self.branch)['owner']}")

    def _committed_columns(self) -> list[Column]:
        return snap.columns_of(self.log.get(self.commit_id).columns)

    def _all_columns(self) -> list[Column]:
        return snap.columns_of(self._state["columns"]) if self._state else self._committed_columns()

    def _steps(self) -> list[dict]:
        return snap.steps_of(self.log, self.commit_id) + (self._state["steps"] if self._state else [])

    def _next_order(self) -> int:
        ends = [s["first"] + s["rows"] for s in snap.steps_of(self.log, self.commit_id) if s["kind"] == "append"]
        return max(ends, default=0)

    def columns(self, hidden: bool = False) -> list[Column]:
        found = [c for c in self._all_columns() if hidden or not c.hidden]
        return found if self._names is None else [next(c for c in found if c.name == n) for n in self._names]

    def column(self, name: str) -> Column:
        for c in self._all_columns():
            if c.name == name:
                return c
        raise E.UnknownColumn(name)

    @property
    def tensors(self) -> dict[str, Tensor]:
        return {c.name: Tensor(self, c.name) for c in self.columns()}

    def get_tensors(self) -> list[str]:
        return [c.name for c in self.columns()]

    def visible_schema(self) -> T.StructType | None:
        fields = [c.field() for c in self.columns() if c.known]
        return T.StructType(fields) if fields else None

    def frame(self) -> DataFrame:
        """The rows as a lazy plan."""
        if self._view is not None:
            out = self._view
        else:
            steps = self._steps()
            out = snap.dense(snap.frame(self.spark, self._all_columns(), steps), snap.is_dense(steps))
        names = [c.name for c in self.columns()]
        return out.select(*self._keys(out), *(f"`{n}`" for n in names))

    @staticmethod
    def _key_names(df: DataFrame) -> list[str]:
        return [c for c in (UUID, ORD, POS, LISTED) if c in df.columns]

    def _keys(self, df: DataFrame | None = None) -> list[str]:
        return self._key_names(df if df is not None else (self._view if self._view is not None else self.frame()))

    def _sorted(self, df: DataFrame) -> DataFrame:
        return df.orderBy(LISTED if LISTED in df.columns else POS)

    def _as_view(self, df: DataFrame, names: list[str] | None = None) -> Dataset:
        out = copy.copy(self)
        out._view, out._names = df, names if names is not None else self._names
        out._source = self._root()
        return out

    @property
    def is_view(self) -> bool:
        return self._view is not None or self._names is not None

    @property
    def is_head_node(self) -> bool:
        return self.branch is not None

    @property
    def has_head_changes(self) -> bool:
        return bool(self._state and (self._state["steps"] or self._state["changes"]))

    @property
    def pending_commit_id(self) -> str:
        return f"{self.commit_id}+" if self.has_head_changes else self.commit_id

    @property
    def append_only(self) -> bool:
        return all(s["kind"] == "append" for s in self._steps())

    def _count(self) -> int:
        """Rows, however far single columns reach."""
        if self._view is None:
            steps = self._steps()
            if all(s["kind"] != "pop" for s in steps) and all("rows" in s for s in steps if s["kind"] == "append"):
                return sum(s["rows"] for s in steps if s["kind"] == "append")
        return self.frame().count()

    @property
    def _ragged(self) -> bool:
        return bool((self._state or {}).get("ragged", False) or self.log.get(self.commit_id).ragged)

    def __len__(self) -> int:
        """The length of the shortest column; it is the number of rows unless columns were filled one by one."""
        return self.min_len if self._view is None and self._ragged else self._count()

    @property
    def num_samples(self) -> int:
        return len(self)

    def lengths(self) -> dict[str, int]:
        """For each column the position after its last value that isn't empty."""
        names = [c.name for c in self.columns()]
        if not names:
            return {}
        row = self.frame().agg(*(F.max(F.when(F.col(f"`{n}`").isNotNull(), F.col(POS) + 1)).alias(n) for n in names)).first()
        return {n: row[n] or 0 for n in names}

    @property
    def min_len(self) -> int:
        return min(self.lengths().values(), default=0)

    @property
    def max_len(self) -> int:
        return self._count()

    @property
    def min_view(self) -> Dataset:
        """The rows up to the end of the shortest column."""
        return self._as_view(self.frame().where(F.col(POS) < self.min_len))

    @property
    def max_view(self) -> Dataset:
        """All rows; shorter columns are null there."""
        return self._as_view(self.frame())

    # -- selection -----------------------------------------------------------------------------------------

    def __getitem__(self, item):
        if isinstance(item, str):
            if item in [c.name for c in self.columns(hidden=True)]:
                return Tensor(self, item)
            inside = [c.name for c in self.columns() if c.name.startswith((item + "/", item + "."))]
            if inside:
                return self._as_view(self._view, inside) if self._view is not None else self._projected(inside)
            raise E.UnknownColumn(item)
        if isinstance(item, (list, tuple)) and item and all(isinstance(i, str) for i in item):
            for name in item:
                self.column(name)
            return self._projected(list(item))
        if isinstance(item, tuple):
            item = list(item)
        kind, where = resolve(item, self._count())
        rows = self.frame()
        at = POS
        if self._view is not None:
            rows, at = self._renumbered(rows), "_at"
        if kind == "slice":
            out = take_slice(rows, *where, pos=at)
            if where[2] < 0:
                out = out.withColumn(LISTED, -F.col(at))
        else:
            out = take_list(rows.drop(LISTED), where, pos=at, order=LISTED)
        return self._as_view(out.drop("_at"))

    def __getattr__(self, name: str):
        if name.startswith("_") or "log" not in self.__dict__:
            raise AttributeError(name)
        try:
            return self[name]
        except E.UnknownColumn:
            raise AttributeError(name) from None

    def __setattr__(self, name: str, value) -> None:
        if self.__dict__.get("_view") is not None and not name.startswith("_") and name in [c.name for c in self.columns()]:
            self.update({name: value})
        else:
            object.__setattr__(self, name, value)

    def _projected(self, names: list[str]) -> Dataset:
        out = copy.copy(self)
        out._names = names
        out._source = self._root()
        return out

    @staticmethod
    def _renumbered(rows: DataFrame) -> DataFrame:
        """Adds `_at`, the position inside the view."""
        return number(rows, LISTED if LISTED in rows.columns else POS, "_at", dense=True)

    def __setitem__(self, item, value) -> None:
        raise E.VersalakeError("assign to a column's rows: ds['column'][i] = value")

    def __iter__(self) -> Iterator[dict]:
        names = [c.name for c in self.columns()]
        for row in self._sorted(self.frame()).select(*(f"`{n}`" for n in names)).toLocalIterator():
            yield dict(zip(names, row))

    @property
    def sample_indices(self) -> list[int]:
        return [r[0] for r in self._sorted(self.frame()).select(POS).collect()]

    get_sample_indices = sample_indices

    @property
    def filtered_index(self) -> list[int]:
        return self.sample_indices

    # -- columns -------------------------------------------------------------------------------------------

    def create_tensor(self, name: str, htype: str = "generic", dtype: str | None = None, sample_compression: str | None = None, chunk_compression: str | None = None, hidden: bool = False, exist_ok: bool = False, **info) -> Tensor:
        if name.startswith("_") and not hidden or not name:
            raise E.ColumnExists(f"{name!r} is reserved")
        if name in [c.name for c in self._all_columns()]:
            if exist_ok:
                return Tensor(self, name)
            raise E.ColumnExists(name)
        state = self._working()
        keys = {c["key"] for c in state["columns"]} | {k for c in self.log.chain(self.commit_id) for k in (x["key"] for x in c.columns)}
        levels = info.pop("levels", None)
        key = name if name not in keys else f"{name}#{self.log.new_id()[:8]}"
        made = Column(name, htype, dtype, levels, info, sample_compression or chunk_compression, hidden, key)
        state["columns"].append(snap.stored([made])[0])
        if not hidden and any(x["kind"] == "append" for x in self._steps()):
            state["ragged"] = True
        self._note("created", name)
        self._save()
        return Tensor(self, name)

    def create_tensor_like(self, name: str, source: Tensor) -> Tensor:
        m = source.meta
        return self.create_tensor(name, m.htype, m.dtype, m.compression, levels=m.levels, **m.info)

    def delete_tensor(self, name: str, large_ok: bool = False) -> None:
        self.column(name)
        if not large_ok and self.size_approx() > (1 << 34):
            raise E.TooLarge(f"{name}: pass large_ok=True")
        state = self._working()
        state["columns"] = [c for c in state["columns"] if c["name"] != name]
        self._note("deleted", name)
        self._save()

    def rename_tensor(self, name: str, new_name: str) -> None:
        self.column(name)
        if new_name in [c.name for c in self._all_columns()]:
            raise E.ColumnExists(new_name)
        state = self._working()
        next(c for c in state["columns"] if c["name"] == name)["name"] = new_name
        self._note("renamed", [name, new_name])
        self._save()

    def set_info(self, name: str, **info) -> None:
        state = self._working()
        next(c for c in state["columns"] if c["name"] == name)["info"].update(info)
        self._note("info", name)
        self._save()

    def _note(self, what: str, value) -> None:
        known = self._state["changes"].setdefault(what, [])
        if value not in known:
            known.append(value)

    # -- rows ----------------------------------------------------------------------------------------------

    def append(self, sample: dict, skip_ok: bool = False, append_empty: bool = False) -> None:
        self.extend([sample], skip_ok, append_empty)

    def extend(self, samples, skip_ok: bool = False, append_empty: bool = False, ignore_errors: bool = False, progressbar: bool = False) -> None:
        """Appends rows: a list of dicts or a dict of columns of equal length. A column that a row lacks is an error
        unless skip_ok or append_empty. All or nothing, unless ignore_errors leaves out rows that don't fit."""
        if isinstance(samples, dict):
            if len({len(v) for v in samples.values()}) > 1:
                raise E.TypeMismatch(f"columns of different lengths: { {k: len(v) for k, v in samples.items()} }")
            samples = [dict(zip(samples, values)) for values in zip(*samples.values())]
        before = copy.deepcopy(self._state)
        state = self._working()
        columns = snap.columns_of(state["columns"])
        named, rows = {c.name: c for c in columns}, []
        try:
            for sample in samples:
                try:
                    if unknown := set(sample) - set(named):
                        raise E.UnknownColumn(f"{sorted(unknown)}")
                    missing = [c.name for c in columns if c.name not in sample and not c.hidden]
                    if missing and not (skip_ok or append_empty):
                        raise E.TypeMismatch(f"the sample lacks {missing}")
                    for name, value in sample.items():
                        named[name].learn(value)
                    rows.append({c.key: c.check(sample.get(c.name)) for c in columns})
                except (E.VersalakeError, TypeError, ValueError):
                    if not ignore_errors:
                        raise
        except Exception:
            self._state = before
            raise
        if not rows:
            return
        state["columns"] = snap.stored(columns)
        schema = T.StructType([T.StructField(UUID, T.LongType()), T.StructField(ORD, T.LongType()), *(T.StructField(c.key, c.spark_type()) for c in columns)])
        first = state["next"]
        data = [(random.getrandbits(63), first + i, *(r[c.key] for c in columns)) for i, r in enumerate(rows)]
        self._add_rows(self.spark.createDataFrame(data, schema).coalesce(max(1, len(data) // 100_000)), len(data))

    def extend_frame(self, df: DataFrame) -> None:
        """Appends a DataFrame's rows in its own order, column by name; new columns take its types."""
        state = self._working()
        columns = snap.columns_of(state["columns"])
        for f in df.schema.fields:
            if not f.name.startswith("_") and f.name not in {c.name for c in columns}:
                self.create_tensor_from(of_spark(f))
        columns = snap.columns_of(self._state["columns"])
        for c in columns:
            if not c.known:
                found = of_spark(df.schema[c.name]) if c.name in df.columns else None
                if found:
                    c.htype, c.dtype, c.levels = found.htype if c.htype == "generic" else c.htype, found.dtype, found.levels
        self._state["columns"] = snap.stored(columns)
        cells = [(F.col(f"`{c.name}`").cast(c.spark_type()) if not (c.htype == "json" and not isinstance(df.schema[c.name].dataType, T.StringType)) else F.to_json(F.col(f"`{c.name}`"))).alias(c.key) if c.name in df.columns else F.lit(None).cast(c.spark_type()).alias(c.key) for c in columns]
        # Written once with the partitions' own numbers, then numbered densely by counting partitions first.
        raw = self._new_path("raw")
        df.select(*cells).withColumn("_m", F.monotonically_increasing_id()).write.parquet(raw)
        rows = self.spark.read.parquet(raw)
        n = rows.count()
        salt = random.getrandbits(62)
        numbered = number(rows, "_m", ORD, 1 << 33, dense=True).withColumn(ORD, F.col(ORD) + self._state["next"])
        numbered = numbered.withColumn(UUID, F.xxhash64(F.lit(salt), ORD))
        self._add_rows(numbered.select(UUID, ORD, *(f"`{c.key}`" for c in columns)), n)
        self.log.files.delete(raw)

    def create_tensor_from(self, column: Column) -> None:
        if column.name not in [c.name for c in self._all_columns()]:
            self.create_tensor(column.name, column.htype, column.dtype, column.compression, levels=column.levels, **column.info)

    def _new_path(self, kind: str) -> str:
        return f"{self.path}/data/{kind}-{self.log.new_id()}"

    def _add_rows(self, df: DataFrame, n: int) -> None:
        path = self._new_path("append")
        df.write.parquet(path)
        self._state["steps"].append({"kind": "append", "path": path, "rows": n, "first": self._state["next"]})
        self._state["next"] += n
        self._save()

    def replace_frame(self, df: DataFrame) -> None:
        """All rows replaced by those of a DataFrame."""
        old = self.frame().select(UUID)
        path = self._new_path("pop")
        # What replaces the rows may be computed from them: it is written before they go.
        staged = self._new_path("raw")
        df.withColumn("_m", F.monotonically_increasing_id()).write.parquet(staged)
        self._working()
        old.write.parquet(path)
        self._state["steps"].append({"kind": "pop", "path": path})
        self.extend_frame(self.spark.read.parquet(staged).orderBy("_m").drop("_m"))
        self.log.files.delete(staged)

    def update(self, sample: dict, everywhere: bool = False) -> None:
        """Changes cells of the rows of this view: one value for all of them, or a list with one for each."""
        if self._view is None and not everywhere:
            raise E.VersalakeError("select rows first: ds[i].update({...})")
        base = self._root()
        state = base._working()
        columns = {c.name: c for c in snap.columns_of(state["columns"])}
        n = self._count()
        changed, many = {}, False
        for name, value in sample.items():
            if name not in columns:
                raise E.UnknownColumn(name)
            c = columns[name]
            single = n == 1 or value is None or not isinstance(value, (list, tuple, np.ndarray)) or (c.levels and not isinstance(value[0], (list, tuple, np.ndarray)))
            values = [value] if single else list(value)
            if not single and len(values) != n:
                raise E.TypeMismatch(f"{name}: {len(values)} values for {n} rows")
            for v in values:
                c.learn(v)
            changed[c.key] = [c.check(v) for v in values]
            many |= not single
        state["columns"] = snap.stored(list(columns.values()))
        kinds = {c.key: c.spark_type() for c in columns.values()}
        rows = self.frame().select(*self._keys())
        if many:
            schema = T.StructType([T.StructField("_at", T.LongType()), *(T.StructField(k, kinds[k]) for k in changed)])
            data = [(i, *(v[i] if len(v) == n else v[0] for v in changed.values())) for i in range(n)]
            rows = self._renumbered(rows).join(F.broadcast(self.spark.createDataFrame(data, schema)), "_at")
        else:
            one = self.spark.createDataFrame([tuple(v[0] for v in changed.values())], T.StructType([T.StructField(k, kinds[k]) for k in changed])).first()
            for k in changed:
                rows = rows.withColumn(k, _literal(one[k], kinds[k]))
        self._overlay(base, rows.select(UUID, *(x for k in changed for x in (F.lit(True).alias(f"_has_{k}"), F.col(f"`{k}`")))), list(changed))

    def update_where(self, condition: SparkColumn, values: dict[str, SparkColumn]) -> None:
        """Changes cells of all rows that meet a condition, to expressions of the row."""
        base = self._root()
        state = base._working()
        columns = {c.name: c for c in snap.columns_of(state["columns"])}
        rows = self.frame().where(condition)
        cells = [x for name, v in values.items() for x in (F.lit(True).alias(f"_has_{columns[name].key}"), v.cast(columns[name].spark_type()).alias(columns[name].key))]
        self._overlay(base, rows.select(UUID, *cells), [columns[n].key for n in values])

    @staticmethod
    def _overlay(base: Dataset, rows: DataFrame, keys: list[str]) -> None:
        path = base._new_path("update")
        rows.write.parquet(path)
        base._state["steps"].append({"kind": "update", "path": path, "keys": keys})
        base._save()

    def _root(self) -> Dataset:
        """The dataset that this handle is a view of."""
        return self._source if self._source is not None else self

    def pop(self, index=None) -> None:
        """Removes rows by position: one, or a list without negatives or repetitions; by default the last."""
        n = self._count()
        wanted = [n - 1] if index is None else [index] if isinstance(index, int) else list(index)
        if len(set(wanted)) != len(wanted) or any(not isinstance(i, (int, np.integer)) or i < 0 for i in wanted):
            raise E.VersalakeError("positions to pop are distinct and not negative")
        if any(i >= n for i in wanted):
            raise IndexError(f"{max(wanted)} of {n}")
        self.pop_where(F.col(POS).isin([int(i) for i in wanted]))

    def pop_where(self, condition: SparkColumn) -> None:
        self._working()
        path = self._new_path("pop")
        self.frame().where(condition).select(UUID).write.parquet(path)
        self._state["steps"].append({"kind": "pop", "path": path})
        self._save()

    def rechunk(self, tensors=None, num_workers: int = 0, scheduler=None, rows_per_file: int = 1_000_000) -> None:
        """Compacts all files of the snapshot into one new base, in order."""
        self._writable()
        if self.has_head_changes:
            self.commit("before compaction")
        rows, columns = self.frame(), self._all_columns()
        n = self._count()
        path = self._new_path("base")
        out = rows.select(UUID, F.col(POS).alias(ORD), *(F.col(f"`{c.name}`").alias(c.key) for c in columns))
        out.repartitionByRange(max(1, -(-n // rows_per_file)), ORD).sortWithinPartitions(ORD).write.parquet(path)
        old = self.log.get(self.commit_id)
        made = self.log.put(Commit(self.log.new_id(), old.id, self.branch, self.log.user, time.time(), "compacted", columns=old.columns, base=path, changes={"base_rows": n}))
        self.log.set_branch(self.branch, made.id, old.id)
        self.commit_id, self._state = made.id, None

    def rechunk_if_necessary(self, spec: dict | None = None, num_workers: int = 0) -> bool:
        """Compacts when overlays, tombstones and small appends have piled up."""
        steps = self._steps()
        if len(steps) <= (spec or {}).get("max_steps", 16):
            return False
        self.rechunk()
        return True

    def clear(self) -> None:
        self.pop_where(F.lit(True))

    # -- queries -------------------------------------------------------------------------------------------

    def filter(self, function, index_query=None, connector: str = "AND", offset: int = 0, limit: int | None = None, **_) -> Dataset:
        """Rows that meet an expression text or a function; index_query: a condition tuple that is combined with it."""
        rows = self.frame()
        if index_query is not None:
            from versalake.functions.expr import compile_expression

            names, found = rows.columns, self._looked_up(tuple(index_query), None)
            if found is None:
                other = flt.predicate(rows, [index_query])
            else:
                flt.check([index_query], None, rows.schema)
                rows = rows.join(found.select(F.col("pos").alias("_at")), F.col(POS) == F.col("_at"), "left")
                other = F.col("_at").isNotNull()
            mine = compile_expression(function, rows.schema) if isinstance(function, str) else function(rows) if callable(function) else function
            mine = F.coalesce(mine, F.lit(False))
            out = flt.page(rows.where((mine & other) if connector == "AND" else (mine | other)).select(*(f"`{n}`" for n in names)), offset, limit, POS)
        else:
            out = flt.filter_rows(rows, function, offset, limit, POS)
        view = self._tied(out)
        view.query_string = function if isinstance(function, str) else getattr(function, "__name__", None)
        return view

    def filter_vectorized(self, condition_list: Sequence[tuple], connector_list: Sequence[str] | None = None, offset: int = 0, limit: int | None = None, analyser: Analyser | None = None, **_) -> Dataset:
        rows = self.frame()
        flt.check(condition_list, connector_list, rows.schema)
        found = {i: hit for i, c in enumerate(condition_list) if (hit := self._looked_up(tuple(c), analyser)) is not None}
        view = self._tied(flt.filter_vectorized(rows, condition_list, connector_list, offset, limit, analyser, POS, found))
        view.query_string = json.dumps([condition_list, connector_list], default=str)
        return view

    def _tied(self, rows: DataFrame) -> Dataset:
        return self._as_view(rows)

    def query(self, tensor_name: str, query) -> set[int]:
        """Positions that an index finds: all words of a text, or a value."""
        index = self._index(tensor_name)
        if isinstance(index, TextIndex):
            return {r[0] for r in index.complex_search(query).collect()}
        if isinstance(index, ValueIndex):
            found = index.between(*query) if isinstance(query, (list, tuple)) else index.equal(query)
            return {r[0] for r in found.collect()}
        op = "CONTAINS" if self.column(tensor_name).htype == "text" else "=="
        return set(self.filter_vectorized([(tensor_name, op, query, True)]).sample_indices)

    def aggregate(self, group_by_tensors, selected_tensors=None, order_by_tensors=None, aggregate_tensors=("*",), function=None, order_direction: str = "DESC", method: str = "count", lexicographic: bool = False, **_) -> DataFrame:
        return agg.aggregate(self.frame(), group_by_tensors, selected_tensors, order_by_tensors, aggregate_tensors, function, order_direction, method, lexicographic)

    def aggregate_vectorized(self, group_by_tensors, selected_tensors=None, order_by_tensors=None, aggregate_tensors=None, order_direction: str = "ASC", method: str = "count", **_) -> DataFrame:
        return agg.aggregate_vectorized(self.frame(), group_by_tensors, selected_tensors, order_by_tensors, aggregate_tensors, order_direction, method)

    def statistics(self, columns: Sequence[str] | None = None) -> DataFrame:
        return agg.statistics(self.frame(), columns)

    def summary(self) -> DataFrame:
        return agg.summary(self.frame().select(*(f"`{c.name}`" for c in self.columns())))

    def size_approx(self) -> int:
        return sum(self.log.files.size(s["path"]) for s in self._steps())

    # -- indexes -------------------------------------------------------------------------------------------

    def _text_index_path(self, column: str) -> str:
        return f"{self.path}/indexes/text/{self.column(column).key}"

    def _vector_index_path(self, column: str, name: str) -> str:
        return f"{self.path}/indexes/vector/{self.column(column).key}/{name}"

    def create_index_vectorized(self, column: str, index_type: str | None = None, force_create: bool = False, analyser: Analyser | None = None, shards: int = 16, **_) -> TextIndex | ValueIndex | None:
        """Builds or updates the index of a column: an inverted one of texts (`fuzzy_match`, their default: words;
        `exact_match`: whole values), else one of values in order (`value`, for equality and ranges). Only committed rows
        are indexed: with uncommitted changes nothing is done. After appends only new rows are added; after updates or
        pops it is built anew."""
        if self.has_head_changes:
            import warnings

            warnings.warn("there are uncommitted changes; commit before indexing", stacklevel=2)
            return None
        path = self._text_index_path(column)
        rows = self.frame().select(POS, F.col(f"`{column}`").alias("value"))
        index = None if force_create else self._index(column)
        if index is not None and index_type in (None, index.meta["kind"]):
            since = self._steps_since(index.meta["commit"])
            if since is not None and all(s["kind"] == "append" for s in since):
                if since:
                    start = self._count() - sum(s["rows"] for s in since)
                    index.append(rows.where(F.col(POS) >= start), self.commit_id)
                return index
            index_type = index.meta["kind"]
            if isinstance(index, TextIndex):
                analyser, shards = analyser or index.analyser, index.meta["shards"]
        kind = index_type or ("fuzzy_match" if isinstance(rows.schema["value"].dataType, T.StringType) else "value")
        if kind == "value":
            return ValueIndex.create(rows, path, "value", POS, self.commit_id)
        return TextIndex.create(rows, path, "value", POS, kind, analyser, shards, self.commit_id)

    def _index(self, column: str) -> TextIndex | ValueIndex | None:
        """The column's index, if there is one."""
        path = self._text_index_path(column)
        if not self.log.files.exists(f"{path}/meta.json"):
            return None
        index = TextIndex(self.spark, path).load()
        return ValueIndex(self.spark, path).load() if index.meta["kind"] == "value" else index

    def _looked_up(self, condition: tuple, analyser: Analyser | None) -> DataFrame | None:
        """The positions (`pos`) of a condition by the column's index; None where the rows must be read instead: there is
        no index of that kind, or it isn't that of the rows at hand."""
        name, op, value, use = (*condition, False)[:4]
        if not use or self._view is not None or self.has_head_changes or op not in ("==", "BETWEEN", "CONTAINS"):
            return None
        index = self._index(name)
        if index is None or index.meta["commit"] != self.commit_id:
            return None
        if isinstance(index, ValueIndex):
            names = self.column(name).info.get("class_names")
            if op == "==" and names is not None and isinstance(value, str):
                value = names.index(value) if value in names else -1
            return index.equal(value) if op == "==" else index.between(*value) if op == "BETWEEN" else None
        if index.meta["kind"] == "exact_match":
            return index.search(value) if op == "==" else None
        if op != "CONTAINS" or (analyser or Analyser()) != index.analyser:
            return None
        # CONTAINS with no token at all finds nothing, as without an index.
        return index.complex_search(value)

    create_index = create_index_vectorized

    def get_inverted_index(self, column: str) -> TextIndex | ValueIndex:
        index = self._index(column)
        if index is None:
            raise E.IndexMissing(column)
        return index

    def optimize_index(self, column: str) -> None:
        self.get_inverted_index(column).optimize()

    def reshard_index(self, column: str, old_shard_num: int, new_shard_num: int) -> None:
        self.get_inverted_index(column).reshard(new_shard_num)

    def create_hot_shard_index(self, column: str, n: int) -> DataFrame:
        return self.get_inverted_index(column).hot(n)

    @property
    def indexed_tensors(self) -> list[str]:
        keys = set(self.log.files.list(f"{self.path}/indexes/text"))
        return [c.name for c in self.columns() if c.key in keys]

    @property
    def indexed_tensors_vec(self) -> dict[str, list[str]]:
        return {c.name: found for c in self.columns() if (found := self.log.files.list(f"{self.path}/indexes/vector/{c.key}"))}

    def _steps_since(self, commit_id: str | None) -> list[dict] | None:
        out: list[dict] = []
        for c in self.log.chain(self.commit_id):
            if c.id == commit_id:
                return out
            if c.base:
                return None
            out = c.steps + out
        return None

    def create_vector_index(self, tensor_name: str, index_name: str, index_type: str = "FLAT", metric: str = "l2", overwrite: bool = False, **params) -> VectorIndex:
        if self.has_head_changes:
            raise E.UncommittedChanges("commit before indexing")
        return VectorIndex.create(self.frame(), self._vector_index_path(tensor_name, index_name), index_name, tensor_name, index_type, metric, POS, overwrite, self.commit_id, **params)

    def update_vector_index(self, tensor_name: str, index_name: str) -> None:
        """Adds the rows that were appended since the index was built; after updates or pops it is built anew."""
        index = VectorIndex(self.spark, self._vector_index_path(tensor_name, index_name)).load(cache=False)
        since, meta = self._steps_since(index.meta.commit), index.meta
        if since is None or any(s["kind"] != "append" for s in since):
            self.create_vector_index(tensor_name, index_name, meta.kind, meta.metric, True, **meta.params)
        elif since:
            start = self._count() - sum(s["rows"] for s in since)
            index.add(self.frame().where(F.col(POS) >= start), self.commit_id)
        if (key := f"{tensor_name}/{index_name}") in self.indexes:
            self.indexes[key].unload()
            self.load_vector_index(tensor_name, index_name)

    def load_vector_index(self, tensor_name: str, index_name: str) -> None:
        self.indexes[f"{tensor_name}/{index_name}"] = VectorIndex(self.spark, self._vector_index_path(tensor_name, index_name)).load()

    def unload_vector_index(self, tensor_name: str, index_name: str) -> None:
        index = self.indexes.pop(f"{tensor_name}/{index_name}", None)
        if index is not None:
            index.unload()

    def drop_vector_index(self, tensor_name: str, index_name: str) -> None:
        self.unload_vector_index(tensor_name, index_name)
        VectorIndex(self.spark, self._vector_index_path(tensor_name, index_name)).drop()

    def vector_search(self, query_vector, tensor_name: str, index_name: str, topk: int = 10, nprobe: int | None = None, refine_factor: int = 1, where=None, **_) -> tuple[np.ndarray, np.ndarray]:
        """(distances, positions), each queries x topk; missing places are NaN and -1."""
        index = self.indexes.get(f"{tensor_name}/{index_name}")
        if index is None:
            raise E.IndexMissing(f"{index_name} isn't loaded")
        asked = np.atleast_2d(np.asarray(query_vector, np.float64))
        found = index.search(list(enumerate(asked.tolist())), topk, nprobe, refine_factor, where).collect()
        distances, ids = np.full((len(asked), topk), np.nan), np.full((len(asked), topk), -1, np.int64)
        for r in found:
            distances[r.query_id, r["rank"] - 1], ids[r.query_id, r["rank"] - 1] = r.distance, r[POS]
        return distances, ids

    # -- versions ------------------------------------------------------------------------------------------

    def commit(self, message: str = "", allow_empty: bool = False, checkpoint: bool = False) -> str:
        if self._view is not None:
            raise E.ReadOnly("a view can't be committed")
        self._writable()
        if not self.has_head_changes and not allow_empty:
            raise E.EmptyCommit("nothing has changed")
        state = self._working()
        made = Commit(self.log.new_id(), self.commit_id, self.branch, self.log.user, time.time(), message, state.get("merge_parent"), checkpoint, state["columns"], state["steps"], state["changes"], ragged=state.get("ragged", self.log.get(self.commit_id).ragged))
        self.log.put(made)
        self.log.set_branch(self.branch, made.id, self.commit_id)
        self.commit_id, self._state = made.id, None
        self.log.set_working(self.branch, None)
        return made.id

    def checkout(self, address: str, create: bool = False, reset: bool = False) -> str:
        """Goes to a branch or commit; create: a new branch from here, after committing what is open."""
        if reset:
            self.reset(force=True)
        if create:
            if address in self.log.branches():
                raise E.CheckoutError(f"branch {address!r} exists")
            if self.has_head_changes:
                self.commit(f"auto commit before branching to {address}")
            self.log.set_branch(address, self.commit_id)
        self.commit_id, self.branch = self._resolve(address)
        self._state = self.log.working(self.branch) if self.branch else None
        return self.commit_id

    def _resolve(self, address: str) -> tuple[str, str | None]:
        try:
            return self.log.resolve(address)
        except E.UnknownCommit as error:
            raise E.CheckoutError(f"no branch or commit {address!r}") from error

    @property
    def branches(self) -> list[str]:
        return self.log.branches()

    def commits(self, ordered_by_date: bool = False) -> list[dict]:
        """The branch's commits, newest first, without what is uncommitted."""
        chain = [c for c in self.log.chain(self.commit_id) if c.id != FIRST]
        return [c.brief() for c in (sorted(chain, key=lambda c: -c.time) if ordered_by_date else chain)]

    def log_text(self) -> str:
        return "\n".join(f"Commit : {c['commit']}\nAuthor : {c['author']}\nTime   : {c['time']}\nMessage: {c['message']}\n" for c in self.commits())

    def commits_frame(self) -> DataFrame:
        rows = [(c.id, c.parent, c.merge_parent, c.branch, c.author, c.time, c.message, c.checkpoint) for c in self.log.all()]
        return self.spark.createDataFrame(rows, "commit string, parent string, merge_parent string, branch string, author string, time double, message string, checkpoint boolean")

    def get_commit_details(self, commit_id: str) -> dict:
        return self.log.get(commit_id).brief()

    def commits_under(self, branch: str | None = None, ordered_by_date: bool = False) -> list[dict]:
        chain = [c for c in self.log.chain(self.log.head(branch) if branch else self.commit_id) if c.id != FIRST]
        return [c.brief() for c in (sorted(chain, key=lambda c: -c.time) if ordered_by_date else chain)]

    def commits_between(self, id_1: str, id_2: str | None = None, as_dict: bool = False):
        found = self.log.between(self._resolve(id_1)[0], self._resolve(id_2)[0] if id_2 else self.commit_id)
        return [c.brief() for c in found] if as_dict else [c.id for c in found]

    def get_children_nodes(self, target: str) -> list[str]:
        return [c.id for c in self.log.children(self._resolve(target)[0])]

    def get_lowest_common_ancestor(self, p: str, q: str) -> str:
        return self.log.common(self._resolve(p)[0], self._resolve(q)[0])

    def reset(self, force: bool = False) -> None:
        """Drops what is uncommitted."""
        self._writable()
        if self._state:
            for step in self._state["steps"]:
                self.log.files.delete(step["path"])
        self._state = None
        if self.branch:
            self.log.set_working(self.branch, None)

    def delete_branch(self, name: str) -> None:
        if name == MAIN or name == self.branch:
            raise E.CheckoutError(f"branch {name!r} can't be deleted from here")
        info = self.log.branch(name)
        if info["owner"] != self.log.user and not self.admin:
            raise E.NotAuthorized(name)
        if any(c.merge_parent in {x.id for x in self.log.chain(info["head"]) if x.branch == name} for c in self.log.all() if c.branch != name):
            raise E.CheckoutError(f"branch {name!r} is part of another one")
        self.log.drop_branch(name)

    def branch_info(self, name: str) -> dict:
        return self.log.branch(name)

    def at(self, address: str | None) -> Dataset:
        """A read-only handle on a branch (with what is uncommitted there) or commit."""
        if address is None:
            return self
        out = Dataset(self.path, self.spark, True, self.log.user, address)
        return out

    def get_tensor_uuids(self, tensor: str, commit: str | None = None) -> list[int]:
        ds = self.at(commit)
        return [r[0] for r in ds.frame().where(F.col(f"`{tensor}`").isNotNull()).orderBy(POS).select(UUID).collect()]

    def change_log(self, commit_id: str) -> DataFrame:
        """(_uuid, column, op, pos): what a commit added, updated and popped. Positions of updated and popped rows are
        those at the commit's start, of added rows those after it."""
        c = self.log.get(commit_id)
        names = {x["key"]: x["name"] for x in c.columns}
        made: DataFrame = self.spark.createDataFrame([], f"{UUID} long, column string, op string, pos long")
        before = self.at(c.parent).frame().select(UUID, F.col(POS).alias("pos")) if c.parent else None
        after = self.at(c.id).frame().select(UUID, F.col(POS).alias("pos"))
        for step in c.steps:
            rows = self.spark.read.parquet(step["path"])
            if step["kind"] == "append":
                made = made.union(rows.select(UUID).join(after, UUID).select(UUID, F.lit(None).cast("string"), F.lit("added"), "pos"))
            elif step["kind"] == "pop":
                made = made.union(rows.select(UUID).join(before, UUID).select(UUID, F.lit(None).cast("string"), F.lit("popped"), "pos"))
            else:
                for k in step["keys"]:
                    touched = rows.where(F.col(f"`_has_{k}`")).select(UUID).join(before, UUID)
                    made = made.union(touched.select(UUID, F.lit(names.get(k, k)), F.lit("updated"), "pos"))
        return made.distinct()

    def commit_changes(self, commit_id: str, show_value: bool = False) -> dict:
        """What a commit did: columns created, deleted, renamed; positions added, updated, popped."""
        c = self.log.get(commit_id)
        rows = self.change_log(commit_id).collect()
        updated: dict[str, set] = {}
        for r in rows:
            if r.op == "updated":
                updated.setdefault(r.column, set()).add(r.pos)
        added = sorted(r.pos for r in rows if r.op == "added")
        return c.brief() | {
            "created": c.changes.get("created", []), "deleted": c.changes.get("deleted", []), "renamed": dict(c.changes.get("renamed", [])), "info_updated": c.changes.get("info", []),
            "data_added": [added[0], added[-1] + 1] if added else [0, 0], "data_updated": updated, "data_deleted": {r.pos for r in rows if r.op == "popped"},
        }

    def diff(self, id_1: str | None = None, id_2: str | None = None, as_dict: bool = True, show_value: bool = False):
        """Changes commit by commit: of the head since its parent, of a commit against the head, or of two commits,
        each back to their common ancestor."""
        if id_1 is None:
            return self._said([self.commit_changes(self.commit_id)], as_dict)
        a, b = self._resolve(id_1)[0], self._resolve(id_2)[0] if id_2 else self.commit_id
        top = self.log.common(a, b)
        sides = []
        for at in (a, b):
            chain = [c.id for c in self.log.chain(at)]
            sides.append([self.commit_changes(c) for c in chain[: chain.index(top)]])
        return self._said(sides, as_dict)

    def diff_to_prev(self, commit_id: str | None = None, as_dict: bool = True):
        return self._said([self.commit_changes(commit_id or self.commit_id)], as_dict)

    @staticmethod
    def _said(found, as_dict: bool):
        return found if as_dict else json.dumps(found, indent=1, default=lambda x: sorted(x) if isinstance(x, set) else str(x))

    def direct_diff(self, id_1: str | None = None, id_2: str | None = None, as_dataframe: bool = False, force: bool = False):
        """id_2 against id_1 (by default the head against its parent): columns and rows added and removed, rows edited."""
        b = self.at(id_2) if id_2 else self
        a = self.at(id_1 or self.log.get(self.commit_id).parent)
        mine, theirs = [c.name for c in a.columns()], [c.name for c in b.columns()]
        plus, minus = [c for c in theirs if c not in mine], [c for c in mine if c not in theirs]
        left, right = a.frame(), b.frame()
        if not as_dataframe:
            changes: dict[str, list] = {"added": [], "removed": [], "edited": []}
            for r in dif.row_changes(left, right).collect():
                changes[r.change].append(r[UUID])
            return {"added_columns": plus, "removed_columns": minus, "modified_records": changes}
        names = (id_1 or "id_1", id_2 or "id_2")
        columns = lambda df, keep: df.select(UUID, *(f"`{c}`" for c in keep))
        return {
            "added_columns": columns(right, plus), "removed_columns": columns(left, minus),
            "added_rows": dif.added(left, right), "removed_rows": dif.removed(left, right), "edited_rows": dif.edited(left, right, names),
        }

    # -- merge ---------------------------------------------------------------------------------------------

    def _by_key(self) -> DataFrame:
        return self.frame_of(self._all_columns())

    def frame_of(self, columns: list[Column]) -> DataFrame:
        rows = self.frame()
        return rows.select(*self._keys(rows), *(F.col(f"`{c.name}`").alias(c.key) for c in columns))

    def _merge_sides(self, target: str) -> tuple[Dataset, Dataset]:
        theirs = self.at(target)
        base = self.at(self.log.merge_base(self.commit_id, theirs.commit_id))
        return base, theirs

    def detect_merge_conflict(self, target_id: str, show_value: bool = False) -> tuple[dict, dict]:
        """(columns that theirs renamed and ours renamed otherwise or dropped, {column: changes of both sides}). Deleted
        positions are those of the common ancestor, appended and updated ones those of each side."""
        base, theirs = self._merge_sides(target_id)
        names = {c.key: c.name for c in self._all_columns()}
        old, mine, other = ({c.key: c.name for c in d._all_columns()} for d in (base, self, theirs))
        renames: dict[str, dict] = {}
        for key, was in old.items():
            now, there = mine.get(key, "Deleted"), other.get(key, "Deleted")
            if there not in (was, "Deleted") and now not in (was, there):
                renames.setdefault("target", {})[was] = there
                renames.setdefault("original", {})[was] = now
        b, o, t = base._by_key(), self._by_key(), theirs._by_key()
        keys = [k for k in old if k in mine and k in other]
        sides = [{c.key: c for c in d._all_columns()} for d in (base, self, theirs)]
        labels = _joint_names(*sides)
        plan = Plan(*(_relabelled(df, columns, labels) for df, columns in zip((b, o, t), sides)), keys, self._new_path("delta"))
        at = lambda df, ids: [r[0] for r in df.join(ids, UUID, "left_semi").orderBy(POS).select(POS).collect()]
        rows = {"del_ori_idx": at(b, plan.gone_ours), "del_tar_idx": at(b, plan.gone_theirs), "app_ori_idx": at(o, plan.new_ours), "app_tar_idx": at(t, plan.new_theirs)}
        records = {}
        for i, k in enumerate(keys):
            record: dict = dict(rows)
            mine_too, there = plan.changed("o", i), plan.changed("t", i)
            cell = F.col(f"`{k}`")
            pick = lambda df, ids, c=cell: [{r[0]: r[1]} for r in df.join(ids, UUID, "left_semi").orderBy(POS).select(POS, c).collect()]
            both = mine_too.join(there, UUID)
            record["update_values"] = {"update_ori": pick(o, both), "update_tar": pick(t, both.union(plan.ids(plan.is_gone_ours & F.col(f"t_{i}"))))}
            if show_value:
                value = lambda df, ids, c=cell: [r[0] for r in df.join(ids, UUID, "left_semi").orderBy(POS).select(c).collect()]
                record |= {"app_ori_values": value(o, plan.new_ours), "app_tar_values": value(t, plan.new_theirs), "del_ori_values": value(b, plan.gone_ours), "del_tar_values": value(b, plan.gone_theirs)}
            records[names[k]] = record
        return renames, records

    def merge(self, target_id: str, append_resolution: str | None = None, update_resolution: str | None = None, pop_resolution: str | None = None, delete_removed_tensors: bool = False, force: bool = False) -> str:
        """Merges a branch or commit into this branch and commits the result."""
        self._writable()
        if self.has_head_changes:
            self.commit(f"auto commit before merging {target_id}")
        if target_id in self.log.branches() and self.log.working(target_id):
            other = Dataset(self.path, self.spark, False, self.log.branch(target_id)["owner"], target_id)
            if other.has_head_changes:
                other.commit("auto commit before being merged")
        base, theirs = self._merge_sides(target_id)
        if theirs.commit_id in self.log.ancestors(self.commit_id):
            return self.commit_id
        old, mine, other = ({c.key: c for c in d._all_columns()} for d in (base, self, theirs))
        self._twins: list[tuple[str, str]] = []
        columns = self._merged_columns(old, mine, other, base, theirs, delete_removed_tensors, force)
        # Labels of all sides in the numbers of the merged names: sides that name new classes number them alike.
        labels = _joint_names(old, mine, other)
        b, o, t = (_relabelled(d._by_key(), side, labels) for d, side in ((base, old), (self, mine), (theirs, other)))
        for c in columns:
            if c.key in labels:
                c.info["class_names"] = labels[c.key]
        for key, twin in self._twins:
            t = t.withColumn(twin, F.col(f"`{key}`"))
        plan = Plan(b, o, t, [k for k in old if k in mine and k in other], self._new_path("delta"))
        plan.check(append_resolution, pop_resolution, update_resolution)
        pops = plan.pops(append_resolution, pop_resolution, update_resolution)
        brought = plan.brought(append_resolution, pop_resolution, update_resolution)
        patch = plan.updates(update_resolution)
        fresh = [c.key for c in columns if c.key not in mine and c.key in t.columns]
        if fresh:
            cells = o.select(UUID).join(t.select(UUID, *(f"`{k}`" for k in fresh)), UUID)
            cells = cells.select(UUID, *(x for k in fresh for x in (F.lit(True).alias(f"_has_{k}"), F.col(f"`{k}`"))))
            patch = patch.join(cells, UUID, "full_outer")
        state = self._working()
        state["columns"] = snap.stored(columns)
        kinds = {c.key: c.spark_type() for c in columns}
        shared = [k for k in kinds if f"_has_{k}" in patch.columns]
        paths = {k: self._new_path(k) for k in ("pop", "update", "append")}
        n = plan.counts()
        if shared and (fresh or n.patched):
            patch.select(UUID, *(x for k in shared for x in (F.col(f"`_has_{k}`"), F.col(f"`{k}`").cast(kinds[k])))).write.parquet(paths["update"])
            state["steps"].append({"kind": "update", "path": paths["update"], "keys": shared})
        if n.gone or n.new_ours:
            pops.write.parquet(paths["pop"])
            state["steps"].append({"kind": "pop", "path": paths["pop"]})
        if n.new_theirs or n.gone:
            rows = number(brought, POS, "_new", dense=True).select(UUID, (F.col("_new") + state["next"]).alias(ORD), *((F.col(f"`{k}`").cast(v) if k in brought.columns else F.lit(None).cast(v)).alias(k) for k, v in kinds.items()))
            rows.write.parquet(paths["append"])
            count = self.spark.read.parquet(paths["append"]).count()
            state["steps"].append({"kind": "append", "path": paths["append"], "rows": count, "first": state["next"]})
            state["next"] += count
        state["merge_parent"] = theirs.commit_id
        state["ragged"] = self._ragged or theirs._ragged
        return self.commit(f"Merge {target_id} into {self.branch}", allow_empty=True)

    def _merged_columns(self, old, mine, other, base: Dataset, theirs: Dataset, delete_removed: bool, force: bool) -> list[Column]:
        out: list[Column] = []
        for key, c in mine.items():
            if key in other:
                x = other[key]
                open_ = any(z.htype == "generic" and z.dtype is None for z in (c, x))
                if not open_ and (c.htype, c.dtype, c.compression) != (x.htype, x.dtype, x.compression) or c.known and x.known and c.spark_type() != x.spark_type():
                    raise E.MergeMismatch(f"{c.name}: {c.htype} {c.dtype} and {x.htype} {x.dtype}")
                made = copy.deepcopy(c if c.known else x)
                made.name = c.name
                was = old[key].name if key in old else c.name
                if x.name != was and x.name != c.name:
                    if c.name != was:
                        if not force:
                            raise E.MergeConflict(f"{was} was renamed to {c.name} and to {x.name}")
                        twin = copy.deepcopy(x)
                        twin.key = f"{key}#{self.log.new_id()[:8]}"
                        self._twins.append((key, twin.key))
                        out.append(twin)
                    else:
                        made.name = x.name
                out.append(made)
            elif key in old and delete_removed:
                continue
            else:
                out.append(c)
        for key, x in other.items():
            if key in mine:
                continue
            if key in old:
                # We dropped it: it comes back only if theirs changed it meanwhile.
                if x.name != old[key].name and not force:
                    raise E.MergeConflict(f"{old[key].name} was dropped here and renamed to {x.name} there")
                a, b = base._by_key(), theirs._by_key()
                same = dif.row_changes(a, b, [key]).limit(1).count() == 0
                if same:
                    continue
            if any(c.name == x.name for c in out):
                raise E.MergeMismatch(f"both sides made a column {x.name!r}")
            out.append(x)
        return out

    # -- views ---------------------------------------------------------------------------------------------

    def save_view(self, message: str = "", path: str | None = None, view_id: str | None = None, optimize: bool = False, tensors: Sequence[str] | None = None, num_workers: int = 0, **_) -> str:
        """Saves the view's positions, with optimize its rows. The dataset must have nothing uncommitted."""
        if self.has_head_changes:
            raise E.UncommittedChanges("commit before saving a view")
        view_id = view_id or self.view_hash()
        at = f"{self.path}/views/{view_id}"
        old = self.get_view(view_id)["rows"] if self.log.files.exists(f"{at}/meta.json") else None
        place = f"{at}/rows-{self.log.new_id()[:12]}"
        rows = self.frame()
        if tensors:
            rows = rows.select(*self._keys(rows), *(f"`{t}`" for t in tensors))
        order = LISTED if LISTED in rows.columns else POS
        rows = rows.withColumn("_order", F.col(order))
        out = rows.drop(LISTED) if optimize else rows.select("_order", POS)
        out.write.parquet(place)
        names = list(tensors) if tensors else self._names
        meta = {"id": view_id, "message": message, "commit": self.commit_id, "optimized": optimize, "query": self.query_string, "columns": names, "time": time.time(), "rows": place}
        self.log.files.write(f"{at}/meta.json", json.dumps(meta))
        if old:  # only now: the view may have been saved from its own rows
            self.log.files.delete(old)
        return view_id

    def view_hash(self) -> str:
        """Names a view by its content: path, commit, query and positions' plan."""
        plan = self.query_string or (self._view._jdf.queryExecution().analyzed().canonicalized().toString() if self._view is not None else "")
        return hashlib.sha256(json.dumps([self.path, self.commit_id, plan, self._names]).encode()).hexdigest()[:32]

    def load_view(self, view_id: str, optimize: bool = False, tensors: Sequence[str] | None = None, **_) -> Dataset:
        """A saved view as it was: its rows at the commit that it was saved on."""
        meta = self.get_view(view_id)
        if optimize and not meta["optimized"]:
            self.at(meta["commit"]).load_view(view_id).save_view(meta["message"], view_id=view_id, optimize=True)
            meta = self.get_view(view_id)
        rows = self.spark.read.parquet(meta["rows"])
        source = self.at(meta["commit"])
        names = list(tensors) if tensors else meta["columns"]
        if meta["optimized"]:
            out = rows.withColumnRenamed("_order", LISTED)
        else:
            out = source.frame().join(rows.withColumnRenamed("_order", LISTED), POS)
        view = source._as_view(out, names)
        view.is_optimized = meta["optimized"]
        view.query_string = meta["query"]
        return view

    is_optimized = False

    def get_views(self, commit_id: str | None = None) -> list[dict]:
        found = [self.get_view(v) for v in self.log.files.list(f"{self.path}/views")]
        return [v for v in found if commit_id is None or v["commit"] == commit_id]

    def get_view(self, view_id: str) -> dict:
        path = f"{self.path}/views/{view_id}/meta.json"
        if not self.log.files.exists(path):
            raise E.ViewNotFound(view_id)
        return json.loads(self.log.files.read(path))

    def delete_view(self, view_id: str) -> None:
        self.get_view(view_id)
        self.log.files.delete(f"{self.path}/views/{view_id}")

    def copy_to(self, path: str, overwrite: bool = False) -> Dataset:
        """The rows in a dataset of their own."""
        out = dataset(path, overwrite=overwrite, spark=self.spark)
        for c in self.columns():
            out.create_tensor(c.name, c.htype, c.dtype, c.compression, levels=c.levels, **c.info)
        out.extend_frame(self._sorted(self.frame()).select(*(f"`{c.name}`" for c in self.columns())))
        out.commit("copied")
        return out

    # -- import and export ---------------------------------------------------------------------------------

    def add_data(self, org_dicts: Sequence[dict], schema=None, **_) -> None:
        from versalake.sources.imports import records

        self.extend_frame(records(self.spark, org_dicts, schema))

    add_data_from_dataframes = add_data

    def add_data_from_file(self, ori_path: str, schema=None, **_) -> None:
        from versalake.sources.imports import read_json

        self.extend_frame(read_json(self.spark, ori_path, schema))

    def add_data_from_csv(self, csv_path: str, schema=None, path_columns: dict | None = None, **_) -> None:
        from versalake.sources.imports import read_csv

        self.extend_frame(read_csv(self.spark, csv_path, schema, path_columns))

    def _export(self, names: Sequence[str] | None = None) -> DataFrame:
        names = list(names) if names else [c.name for c in self.columns()]
        return self._sorted(self.frame()).select(*(f"`{n}`" for n in names))

    def to_dataframe(self, tensor_list: Sequence[str] | None = None, index_list: Sequence[int] | None = None, force: bool = False):
        from versalake.sources.exports import to_pandas

        ds = self[list(index_list)] if index_list is not None else self
        return to_pandas(ds._export(tensor_list), len(ds), force)

    def to_arrow(self, tensors: Sequence[str] | None = None):
        from versalake.sources.exports import ArrowView

        return ArrowView(self, tensors)

    def write_to_parquet(self, path: str, columns: Sequence[str] | None = None) -> None:
        self._export(columns).write.parquet(path)

    def to_json(self, path: str, tensors: Sequence[str] | None = None, num_workers: int = 1) -> None:
        from versalake.sources.exports import write_json

        write_json(self._export(tensors or sorted(c.name for c in self.columns())), path)

    def numpy(self, aslist: bool = False, asrow: bool = False, **_):
        if asrow:
            return [{k: np.asarray(v) for k, v in row.items()} for row in self]
        return {c.name: Tensor(self, c.name).numpy(aslist) for c in self.columns()}

    # -- housekeeping --------------------------------------------------------------------------------------

    def rename(self, path: str) -> None:
        self._writable()
        self.log.files.rename(self.path, path.rstrip("/"))
        self.path = path.rstrip("/")
        self.log = Log(self.spark, self.path, self.log.user)
        self.log.text = self.log_text

    def delete(self, large_ok: bool = False) -> None:
        self._writable()
        if not large_ok and self.size_approx() > (1 << 30):
            raise E.TooLarge("pass large_ok=True")
        self.log.files.delete(self.path)

    def flush(self) -> None:
        """Nothing is buffered."""

    def enable_admin_mode(self) -> None:
        self.admin = True

    def disable_admin_mode(self) -> None:
        self.admin = False

    @property
    def is_admin_mode(self) -> bool:
        return self.admin

    def set_read_only(self, value: bool) -> None:
        self.read_only = value


def _joint_names(old: dict[str, Column], mine: dict[str, Column], other: dict[str, Column]) -> dict[str, list[str]]:
    """For each column of class labels that both sides have: ours' names, then theirs', then those that only the base had."""
    out = {}
    for key in mine:
        if key in other and any("class_names" in s[key].info for s in (mine, other)):
            sides = (s[key].info.get("class_names") or [] for s in (mine, other, old) if key in s)
            out[key] = list(dict.fromkeys(n for names in sides for n in names))
    return out


def _relabelled(rows: DataFrame, columns: dict[str, Column], labels: dict[str, list[str]]) -> DataFrame:
    """Class labels as the numbers of their names in `labels`; numbers without a name stay."""
    for key, joint in labels.items():
        names = columns[key].info.get("class_names") or [] if key in columns else []
        moved = {i: joint.index(n) for i, n in enumerate(names) if joint.index(n) != i}
        if not moved or key not in rows.columns:
            continue
        table = F.create_map(*(F.lit(x) for pair in moved.items() for x in pair))

        def to(x: SparkColumn, kind: T.DataType, table=table) -> SparkColumn:
            if isinstance(kind, T.ArrayType):
                return F.transform(x, lambda e: to(e, kind.elementType))
            return F.coalesce(F.element_at(table, x.cast("int")).cast(kind), x)

        rows = rows.withColumn(key, to(F.col(f"`{key}`"), rows.schema[key].dataType))
    return rows


def _literal(value, kind: T.DataType) -> SparkColumn:
    if value is None:
        return F.lit(None).cast(kind)
    if isinstance(kind, T.ArrayType):
        return F.array(*(_literal(v, kind.elementType) for v in value)).cast(kind)
    if isinstance(kind, T.BinaryType):
        return F.lit(bytes(value))
    return F.lit(value).cast(kind)


# -- module functions ----------------------------------------------------------------------------------------


def _address(path: str) -> tuple[str, str | None]:
    """`path@address` names a branch or commit."""
    head, sign, tail = path.rpartition("@")
    return (head, tail) if sign and "/" not in tail else (path, None)


def exists(path: str, spark: SparkSession | None = None) -> bool:
    return Log(_session(spark), _address(path)[0]).exists()


def dataset(path: str, read_only: bool = False, overwrite: bool = False, spark: SparkSession | None = None, user: str | None = None, **_) -> Dataset:
    """Opens a dataset, making it if there is none."""
    at, address = _address(path)
    log = Log(_session(spark), at, user)
    if overwrite and log.exists():
        log.files.delete(at)
        log = Log(_session(spark), at, user)
    if not log.exists():
        if read_only:
            raise E.DatasetNotFound(at)
        log.create()
    return Dataset(at, spark, read_only, user, address)


def load(path: str, read_only: bool = False, check_integrity: bool = False, spark: SparkSession | None = None, user: str | None = None, **_) -> Dataset:
    at, address = _address(path)
    if not exists(at, spark):
        raise E.DatasetNotFound(at)
    ds = Dataset(at, spark, read_only, user, address)
    if check_integrity:
        for step in ds._steps():
            if not ds.log.files.exists(step["path"]):
                raise E.DatasetNotFound(step["path"])
    return ds


def empty(path: str, overwrite: bool = False, spark: SparkSession | None = None, user: str | None = None, **_) -> Dataset:
    if exists(path, spark) and not overwrite:
        raise E.DatasetExists(path)
    return dataset(path, overwrite=overwrite, spark=spark, user=user)


def like(dest: str, src, tensors: Sequence[str] | None = None, overwrite: bool = False, spark: SparkSession | None = None) -> Dataset:
    """A dataset with the columns of another and no rows."""
    source = load(src, spark=spark) if isinstance(src, str) else src
    out = empty(dest, overwrite, source.spark)
    for c in source.columns():
        if tensors is None or c.name in tensors:
            out.create_tensor(c.name, c.htype, c.dtype, c.compression, levels=c.levels, **copy.deepcopy(c.info))
    return out


def delete(path: str, large_ok: bool = False, spark: SparkSession | None = None, **_) -> None:
    load(path, spark=spark).delete(large_ok)


def get_col_info(path: str, col_name: str | None = None, spark: SparkSession | None = None) -> dict:
    ds = load(path, read_only=True, spark=spark)
    found = {c.name: {"htype": c.htype, "dtype": c.dtype, "compression": c.compression, "length": len(ds), **c.info} for c in ds.columns()}
    if col_name is None:
        return found
    if col_name not in found:
        raise E.UnknownColumn(col_name)
    return found[col_name]
