"""Views that a stream keeps up to date: each batch adds what it changes, nothing is worked out anew.

A view is an aggregate whose rows can be merged: counts add up, tops are cut again, sketches are united. A batch's rows go
in as a part of level 0. When a level has :data:`FAN_IN` parts they are merged into one of the next, so a view
of n batches has some FAN_IN * log(n) parts, each row is rewritten log(n) times, and readers merge what is there.
All views of a table switch together (see :mod:`httplens.sources.snapshots`), along with the number of the batch:
one that is delivered again counts once.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from httplens.plans.rules import order_by
from httplens.sources.snapshots import Snapshots, State

FAN_IN = 8


@dataclass(frozen=True)
class View:
    """``delta`` makes rows of ``schema`` from a batch, ``merge`` makes one such table of the rows of several."""

    schema: str
    delta: Callable[[DataFrame], DataFrame]
    merge: Callable[[DataFrame], DataFrame]


def counts(keys: list[str], schema: str, count: str, made: Callable[[DataFrame], DataFrame]) -> View:
    return View(schema, made, lambda rows: rows.groupBy(*keys).agg(F.sum(count).alias(count)))


def top(schema: str, n: int, order: Sequence[str], made: Callable[[DataFrame], DataFrame]) -> View:
    """The first ``n`` rows by ``order`` (``"-id"`` is descending): the rows of a batch beyond them can never be among them later."""
    cut = lambda rows: rows.orderBy(*[order_by(key) for key in order]).limit(n)
    return View(schema, lambda batch: cut(made(batch)), cut)


def absorb(batch: DataFrame, batch_id: int, views: Mapping[str, View], path: str) -> State:
    """Add a batch to the views at ``path``, unless it is in them already."""
    table = Snapshots(batch.sparkSession, path)

    def step(before: State):
        if before.marks.get("batch", -1) >= batch_id:
            return None
        parts = [*before.parts, *(table.write(v.delta(batch), view=name, level=0) for name, v in views.items())]
        for name, view in views.items():
            parts = _compacted(table, parts, name, view)
        return parts, {"batch": batch_id}

    return table.change(step)


def _compacted(table: Snapshots, parts: list[dict], name: str, view: View) -> list[dict]:
    level = 0
    while True:
        full = [p for p in parts if p["view"] == name and p["level"] == level]
        if not full:
            return parts
        if len(full) >= FAN_IN:
            merged = table.write(view.merge(table.read(full, view.schema)), view=name, level=level + 1)
            parts = [*[p for p in parts if p not in full], merged]
        level += 1


def current(spark: SparkSession, path: str, name: str, view: View) -> DataFrame:
    """A view as of the last batch."""
    table = Snapshots(spark, path)
    return view.merge(table.read([p for p in table.state().parts if p["view"] == name], view.schema))
