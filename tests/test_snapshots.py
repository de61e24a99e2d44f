"""States switched as a whole: stored saved queries and views of a stream."""

import datetime as dt
import json

import pytest
from conftest import exchange, raw_frame
from pyspark.sql import functions as F

from httplens.operators.ingest import normalize
from httplens.operators.saved import MANY_PARTS, SavedQueries
from httplens.sources import snapshots
from httplens.sources.snapshots import Conflict, Snapshots
from httplens.streaming import views


def queries(spark, *names):
    return spark.createDataFrame([("c", n, f"SELECT '{n}'") for n in names], "category string, name string, sql_text string")


def listed(table):
    return sorted((r["id"], r["name"]) for r in table.rows.collect())


def folders(path):
    return sorted(p.name for p in (path / "parts").iterdir())


def test_states_follow_each_other(spark, tmp_path):
    table = Snapshots(spark, str(tmp_path))
    assert table.state() == snapshots.State()
    first = table.commit(table.state(), [table.write(spark.range(3))], {"n": 1})
    assert table.state() == first and first.version == 1
    with pytest.raises(Conflict):
        table.commit(snapshots.State(), [], {})
    assert table.state() == first and not [p for p in (tmp_path / "_versions").iterdir() if p.name.startswith("draft")]
    assert table.read(list(first.parts), "id long").count() == 3


def test_old_states_and_their_parts_are_removed(spark, tmp_path):
    table = Snapshots(spark, str(tmp_path))
    for n in range(12):
        table.change(lambda before: ([table.write(spark.range(1))], {"n": n}))
    other = table.write(spark.range(1))  # somebody else is about to commit this
    table.change(lambda before: (list(before.parts), {}))
    assert len(table.versions()) == snapshots.KEPT
    assert len(folders(tmp_path)) <= snapshots.KEPT + 1 and other["folder"].split("/")[1] in folders(tmp_path)


def test_two_appends_at_once_get_different_ids(spark, tmp_path):
    one, two = (SavedQueries(spark, str(tmp_path)) for _ in range(2))
    one.append(queries(spark, "a", "b"))
    commit, met = Snapshots.commit, []

    def late(self, before, parts, marks):
        if self is one._table and not met:
            met.append(True)
            two.append(queries(spark, "between"))
        return commit(self, before, parts, marks)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(Snapshots, "commit", late)
        one.append(queries(spark, "d", "c"))
    assert listed(one) == [(1, "a"), (2, "b"), (3, "between"), (4, "c"), (5, "d")]


def test_deletes_and_appends(spark, tmp_path):
    table = SavedQueries(spark, str(tmp_path))
    for name in "abcd":
        table.append(queries(spark, name))
    before = table.rows
    table.delete([2, 4, 77, None])
    assert listed(table) == [(1, "a"), (3, "c")] and before.count() == 4  # who reads the state before still can
    table.delete([99])
    table.append(queries(spark, "e"))
    assert listed(table) == [(1, "a"), (3, "c"), (5, "e")]
    table.delete(table.rows)
    assert listed(table) == []
    table.append(queries(spark))
    assert table.rows.count() == 0


def test_no_column_may_be_null(spark, tmp_path):
    table = SavedQueries(spark, str(tmp_path))
    with pytest.raises(Exception, match="without sql_text"):
        table.append(spark.createDataFrame([("c", "n", None)], "category string, name string, sql_text string"))
    assert table.rows.count() == 0
    at = dt.datetime(2024, 5, 1)
    table.append(queries(spark, "old").withColumn("created_at", F.lit(at)).unionByName(
        queries(spark, "new").withColumn("created_at", F.lit(None).cast("timestamp"))))
    assert {r["name"]: r["created_at"] == at for r in table.rows.collect()} == {"old": True, "new": False}


def test_arrays_are_imported(spark, tmp_path):
    (tmp_path / "in.json").write_text(json.dumps(
        [{"category": "c", "name": "two\nlines", "sql_text": "SELECT 1"}, {"category": "b", "name": "n", "sql_text": "SELECT 2"}], indent=2))
    table = SavedQueries(spark, str(tmp_path / "table"))
    table.load(str(tmp_path / "in.json"), multi_line=True)
    assert listed(table) == [(1, "n"), (2, "two\nlines")]


def test_many_small_parts_become_one(spark, tmp_path):
    table = SavedQueries(spark, str(tmp_path))
    for n in range(MANY_PARTS + 3):
        table.append(queries(spark, f"q{n:02d}"))
    assert len(table._table.state().parts) <= MANY_PARTS
    assert listed(table) == [(n + 1, f"q{n:02d}") for n in range(MANY_PARTS + 3)]


def test_views_of_many_batches(spark, tmp_path):
    """The number of parts grows with the logarithm of the batches, and a batch that comes again changes nothing."""
    view = views.counts(["host"], "host string, n long", "n", lambda b: b.groupBy("host").agg(F.count("*").alias("n")))
    largest = views.top("id long, resp_length int", 2, ("-resp_length", "id"), lambda b: b.select("id", "resp_length"))
    made = {"hosts": view, "largest": largest}
    batches = 20
    for k in range(batches):
        rows = [exchange(10 * k + i, f"h{i % 2}", 80, False, "GET", "/", 200, resp_body="x" * i) for i in range(3)]
        for _ in range(1 + (k % 7 == 0)):
            views.absorb(normalize(raw_frame(spark, rows)), k, made, str(tmp_path))
    assert {r["host"]: r["n"] for r in views.current(spark, str(tmp_path), "hosts", view).collect()} == {"h0": 2 * batches, "h1": batches}
    assert [tuple(r) for r in views.current(spark, str(tmp_path), "largest", largest).collect()] == [(2, 2), (12, 2)]
    state = Snapshots(spark, str(tmp_path)).state()
    assert len(state.parts) <= 2 * 2 * views.FAN_IN
    assert len(folders(tmp_path)) <= len(state.parts) + 2 * snapshots.KEPT * (views.FAN_IN + 1)
