"""Three-way merge of row sets by `_uuid`, one resolution for each kind of conflict.

append   conflict if both sides added rows: ours, theirs (ours' additions go) or both.
pop      conflict if a side alone removed rows: ours (nothing more goes), both (theirs' removals apply, too) or
         theirs (they apply and rows that only ours removed come back).
update   conflict if both changed a row's cell, or theirs changed a row that ours removed: ours or theirs (the row
         comes back). Changes of theirs alone always apply.

A conflict without a resolution raises MergeConflict. Ours keeps its order; rows that come from theirs follow, sorted
by their position there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versalake.errors import MergeConflict

UUID, POS = "_uuid", "_pos"


def _check(name: str, value: str | None, allowed: Sequence[str]) -> None:
    if value is not None and value not in allowed:
        raise ValueError(f"{name}: {value!r} isn't one of {allowed}")


def _columns(base: DataFrame) -> list[str]:
    return [c for c in base.columns if not c.startswith("_")]


def update_conflicts(base: DataFrame, ours: DataFrame, theirs: DataFrame, column: str) -> DataFrame:
    """Rows whose cell both sides changed, with the three values."""
    pick = lambda df, name: df.select(UUID, F.col(f"`{column}`").alias(f"{column}_{name}"))
    met = pick(base, "base").join(pick(ours, "ours"), UUID).join(pick(theirs, "theirs"), UUID)
    b, o, t = (F.col(f"`{column}_{n}`") for n in ("base", "ours", "theirs"))
    return met.where(~b.eqNullSafe(o) & ~b.eqNullSafe(t))


def delta(base: DataFrame, ours: DataFrame, theirs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(_uuid, b, o, t, o_0, t_0, o_1, ...): which of the three sets have a row, and which of its cells each side
    changed; rows that nobody touched are left out. One pass over the three sets, joined by `_uuid`."""

    def side(df: DataFrame, mark: str) -> DataFrame:
        return df.select(UUID, F.lit(True).alias(mark), *(F.col(f"`{c}`").alias(f"{mark}v_{i}") for i, c in enumerate(columns)))

    met = side(base, "b").join(side(ours, "o"), UUID, "full_outer").join(side(theirs, "t"), UUID, "full_outer")
    here = {m: F.coalesce(F.col(m), F.lit(False)) for m in "bot"}
    flags = [(here["b"] & here[m] & ~F.col(f"bv_{i}").eqNullSafe(F.col(f"{m}v_{i}"))).alias(f"{m}_{i}") for i in range(len(columns)) for m in "ot"]
    out = met.select(UUID, *(here[m].alias(m) for m in "bot"), *flags)
    touched = ~(F.col("b") & F.col("o") & F.col("t"))
    for i in range(len(columns)):
        touched = touched | F.col(f"o_{i}") | F.col(f"t_{i}")
    return out.where(touched)


class Plan:
    """The row sets of a merge. scratch: a path where the differences are written once, so that what follows reads
    them instead of joining the snapshots again."""

    def __init__(self, base: DataFrame, ours: DataFrame, theirs: DataFrame, columns: Sequence[str] | None = None, scratch: str | None = None):
        self.base, self.ours, self.theirs = base, ours, theirs
        self.columns = list(columns if columns is not None else [c for c in _columns(base) if c in ours.columns and c in theirs.columns])
        self.delta = delta(base, ours, theirs, self.columns)
        if scratch is not None:
            self.delta.write.parquet(scratch)
            self.delta = base.sparkSession.read.parquet(scratch)
        n = range(len(self.columns))
        some = lambda conditions: _any(conditions)
        b, o, t = (F.col(m) for m in "bot")
        self.is_new_ours, self.is_new_theirs = ~b & o, ~b & t & ~o
        self.is_gone_ours, self.is_gone_theirs = b & ~o & t, b & o & ~t
        self.is_changed_ours = some(F.col(f"o_{i}") for i in n)
        self.is_changed_theirs = some(F.col(f"t_{i}") for i in n)
        self.is_updated_both = some(F.col(f"o_{i}") & F.col(f"t_{i}") for i in n)
        self.is_updated_popped = self.is_gone_ours & self.is_changed_theirs
        self._counts = None

    def ids(self, condition) -> DataFrame:
        return self.delta.where(condition).select(UUID)

    @property
    def new_ours(self) -> DataFrame:
        return self.ids(self.is_new_ours)

    @property
    def new_theirs(self) -> DataFrame:
        return self.ids(self.is_new_theirs)

    @property
    def gone_ours(self) -> DataFrame:
        return self.ids(self.is_gone_ours)

    @property
    def gone_theirs(self) -> DataFrame:
        return self.ids(self.is_gone_theirs)

    def changed(self, side: str, i: int) -> DataFrame:
        """Rows whose i-th column a side ("o" or "t") changed."""
        return self.ids(F.col(f"{side}_{i}"))

    def counts(self):
        """How many rows there are of each kind: one aggregation."""
        if self._counts is None:
            kinds = {"new_ours": self.is_new_ours, "new_theirs": self.is_new_theirs, "gone": self.is_gone_ours | self.is_gone_theirs, "updated": self.is_updated_both | self.is_updated_popped, "patched": self.is_changed_theirs & F.col("o")}
            self._counts = self.delta.agg(*(F.count_if(c).alias(k) for k, c in kinds.items())).first()
        return self._counts

    def check(self, append: str | None, pop: str | None, update: str | None) -> None:
        _check("append", append, ("ours", "theirs", "both"))
        _check("pop", pop, ("ours", "theirs", "both"))
        _check("update", update, ("ours", "theirs"))
        n = self.counts()
        if append is None and n.new_ours and n.new_theirs:
            raise MergeConflict("both sides appended rows: an append resolution is needed")
        if pop is None and n.gone:
            raise MergeConflict("rows were popped on one side: a pop resolution is needed")
        if update is None and n.updated:
            raise MergeConflict("both sides updated rows: an update resolution is needed")

    def pops(self, append: str | None, pop: str | None, update: str | None) -> DataFrame:
        """Ids of ours' rows that go. Rows that theirs popped go even where ours updated them."""
        goes = self.is_gone_theirs if pop in ("both", "theirs") else F.lit(False)
        if append == "theirs" and self.counts().new_theirs:
            # Only where both sides appended do ours' additions go.
            goes = goes | self.is_new_ours
        return self.ids(goes)

    def brought(self, append: str | None, pop: str | None, update: str | None) -> DataFrame:
        """Rows of theirs that ours gets, in full."""
        comes = F.lit(False) if append == "ours" and self.counts().new_ours else self.is_new_theirs
        if pop == "theirs":
            comes = comes | self.is_gone_ours
        if update == "theirs":
            comes = comes | self.is_updated_popped
        return self.theirs.join(self.ids(comes), UUID, "left_semi")

    def updates(self, update: str | None) -> DataFrame:
        """(_uuid, _has_<column>, <column>...) of cells of ours that get theirs' values."""
        takes = [F.col(f"t_{i}") if update == "theirs" else F.col(f"t_{i}") & ~F.col(f"o_{i}") for i in range(len(self.columns))]
        wanted = self.delta.where(F.col("o") & _any(takes)).select(UUID, *(c.alias(f"_take_{i}") for i, c in enumerate(takes)))
        values = self.theirs.select(UUID, *(F.col(f"`{c}`").alias(f"_v_{i}") for i, c in enumerate(self.columns)))
        met = wanted.join(values, UUID)
        return met.select(UUID, *(x for i, c in enumerate(self.columns) for x in (F.col(f"_take_{i}").alias(f"_has_{c}"), F.when(F.col(f"_take_{i}"), F.col(f"_v_{i}")).alias(c))))


def _any(conditions):
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def merge_frames(base: DataFrame, ours: DataFrame, theirs: DataFrame, append: str | None = None, pop: str | None = None, update: str | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """The merged rows, with a new dense order in `_order` (side, position)."""
    plan = Plan(base, ours, theirs, columns)
    plan.check(append, pop, update)
    kept = ours.join(plan.pops(append, pop, update), UUID, "left_anti")
    patch = plan.updates(update)
    patch = patch.select(UUID, *(F.col(f"`{x}{c}`").alias(f"_p{x}{c}") for c in plan.columns for x in ("_has_", "")))
    met = kept.join(patch, UUID, "left")
    for c in plan.columns:
        met = met.withColumn(c, F.when(F.coalesce(F.col(f"`_p_has_{c}`"), F.lit(False)), F.col(f"`_p{c}`")).otherwise(F.col(f"`{c}`")))
    names = [UUID, *([POS] if POS in ours.columns else []), *plan.columns]
    out = met.select(*names, F.lit(0).alias("_side"))
    return out.unionByName(plan.brought(append, pop, update).select(*names, F.lit(1).alias("_side")))
