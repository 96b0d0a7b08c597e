"""The two descriptors every operator works on: ``Task`` and ``TaskSet``.

A task is a lazy DataFrame with named feature columns, one label column and a
unique row id.  A split is a column of that frame, so the label can never get
out of step with the features.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RID = "rid"
SPLIT = "split"
TRAIN, TEST = "train", "test"

# Column names that operators add beside the features of a task. A feature or label of
# such a name would be overwritten, so a task stores it under another name.
RESERVED = frozenset(
    "rid split y y_hat p1 variant origin code features label weight fold round place grid_idx idx draw rank "
    "prediction probability rawprediction vec other cats dist other_vec other_cats dataset path model metric _h _u _new".split()
)
LABELS_ALLOWED = frozenset({"y", "label"})


def stored_names(names: Sequence[str], taken: Iterable[str] = (), allowed: frozenset[str] = frozenset()) -> dict[str, str]:
    """The name under which a task keeps each column: its own, or ``<name>_kept`` for a reserved one."""
    used = {n.lower() for n in [*names, *taken]}
    out = {}
    for name in names:
        stored = name
        if name.lower() in RESERVED - allowed:
            stored = f"{name}_kept"
            while stored.lower() in used:
                stored += "_"
            used.add(stored.lower())
        out[name] = stored
    return out


@dataclass(frozen=True)
class Task:
    """One labelled table. ``df`` holds ``rid``, the features and the label."""

    name: str
    df: DataFrame
    features: tuple[str, ...]
    label: str | None
    categorical: tuple[str, ...] | None = None
    majority: Any = None

    @property
    def was_split(self) -> bool:
        return SPLIT in self.df.columns

    def part(self, which: str) -> "Task":
        if not self.was_split:
            raise ValueError(f"task {self.name} was not split")
        return replace(self, name=f"{self.name}_{which}", df=self.df.where(F.col(SPLIT) == which).drop(SPLIT))

    @property
    def train(self) -> "Task":
        return self.part(TRAIN)

    @property
    def test(self) -> "Task":
        return self.part(TEST)

    @property
    def fitting_rows(self) -> DataFrame:
        """Train part, or everything when there is no split; rows without a label take no part."""
        return self._labelled(self.train.df if self.was_split else self.df)

    @property
    def judging_rows(self) -> DataFrame:
        """Test part, or everything when there is no split; rows without a label take no part."""
        return self._labelled(self.test.df if self.was_split else self.df)

    def _labelled(self, rows: DataFrame) -> DataFrame:
        return rows if self.label is None else rows.where(F.col(self.label).isNotNull())

    def with_df(self, df: DataFrame, **changes) -> "Task":
        return replace(self, df=df, **changes)

    def require_label(self) -> str:
        if self.label is None:
            raise ValueError(f"task {self.name} has no label")
        return self.label


@dataclass(frozen=True)
class TaskSet:
    """Ordered catalog of tasks keyed by path; members may differ in schema."""

    members: tuple[tuple[tuple[str, ...], Task], ...] = ()
    name: str = "tasks"

    def __post_init__(self):
        paths = [p for p, _ in self.members]
        if len(set(paths)) != len(paths):
            raise ValueError("task names must be unique among siblings")

    @staticmethod
    def of(tasks: Iterable[Task], name: str = "tasks") -> "TaskSet":
        return TaskSet(tuple(((t.name,), t) for t in tasks), name)

    def append(self, *tasks: Task) -> "TaskSet":
        return replace(self, members=self.members + tuple(((t.name,), t) for t in tasks))

    def union(self, other: "TaskSet") -> "TaskSet":
        return replace(self, members=self.members + other.members)

    def nested(self, parent: str) -> "TaskSet":
        """The same members one level deeper, below ``parent``."""
        return replace(self, members=tuple(((parent,) + p, t) for p, t in self.members))

    def subset(self, names: str | Sequence[str]) -> "TaskSet":
        """Members by (top-level or own) name; unknown names are skipped."""
        wanted = {names} if isinstance(names, str) else set(names)
        return replace(self, members=tuple((p, t) for p, t in self.members if p[0] in wanted or p[-1] in wanted))

    def map(self, fn: Callable[[Task], Task]) -> "TaskSet":
        return replace(self, members=tuple((p, fn(t)) for p, t in self.members))

    @property
    def tasks(self) -> list[Task]:
        return [t for _, t in self.members]

    @property
    def train(self) -> "TaskSet":
        return self.map(lambda t: t.train)

    @property
    def test(self) -> "TaskSet":
        return self.map(lambda t: t.test)

    def __len__(self) -> int:
        return len(self.members)

    def __getitem__(self, name: str) -> Task:
        found = self.subset(name).tasks
        if len(found) != 1:
            raise KeyError(name)
        return found[0]

    def long(self, columns: Sequence[str | Column] | None = None) -> DataFrame:
        """All members as one long table with a ``dataset`` column."""
        frames = [
            (t.df if columns is None else t.df.select(*columns)).withColumn("dataset", F.lit("/".join(p)))
            for p, t in self.members
        ]
        out = frames[0]
        for frame in frames[1:]:
            out = out.unionByName(frame, allowMissingColumns=True)
        return out
