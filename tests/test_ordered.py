"""Numbering and looking back, against plain Python, with one group holding most rows."""

import random

import pytest
from pyspark.sql import functions as F

from httplens.operators import keyed, ordered


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(7)
    rows = []
    for i in range(3000):
        host = "hot" if rng.random() < .5 else rng.choice(["a", "b", "c", None])
        rows.append((i, host, rng.randrange(500), rng.choice([200, 401, 500])))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "id long, host string, at long, status int").repartition(5).cache()


def grouped(events):
    groups = {}
    for r in sorted(events.collect(), key=lambda r: (r["at"], r["id"])):
        groups.setdefault(r["host"], []).append(r)
    return groups


def test_hot_group_is_spread(events):
    chunks = ordered.in_chunks(events, ["host", "at", "id"], chunks=8)
    sizes = chunks.groupBy("_chunk").count().collect()
    assert len(sizes) == 8 and max(r["count"] for r in sizes) < 1000
    assert chunks.where("host = 'hot'").select("_chunk").distinct().count() >= 4


def test_numbers_are_gap_free_and_in_order(events):
    got = ordered.number_rows(events, ["host", "at", "id"], "n", chunks=7).collect()
    want = sorted(events.collect(), key=lambda r: (r["host"] is not None, r["host"] or "", r["at"], r["id"]))
    assert [r["id"] for r in sorted(got, key=lambda r: r["n"])] == [r["id"] for r in want]
    assert sorted(r["n"] for r in got) == list(range(1, 3001))


def test_equal_rows_are_spread_and_numbered(spark):
    same = spark.range(4000).select(F.lit("x").alias("k"), F.lit(1).alias("v")).repartition(4)
    chunks = ordered.in_chunks(same, ["k", "v"], unique=False, chunks=4)
    assert max(r["count"] for r in chunks.groupBy("_chunk").count().collect()) < 2000
    numbers = [r["n"] for r in ordered.number_rows(same, ["k"], "n", unique=False, chunks=4).collect()]
    assert sorted(numbers) == list(range(1, 4001))


def test_running_count(events):
    got = {r["id"]: r["n"] for r in ordered.running_count(events, ["host"], ["at", "id"], "n").collect()}
    want = {r["id"]: i for rows in grouped(events).values() for i, r in enumerate(rows, 1)}
    assert got == want


def test_previous_value(events):
    got = {r["id"]: r["before"] for r in
           ordered.previous_value(events, ["host"], ["at", "id"], "at", "before", chunks=11).collect()}
    want = {}
    for rows in grouped(events).values():
        for i, r in enumerate(rows):
            want[r["id"]] = rows[i - 1]["at"] if i else None
    assert got == want


def test_previous_value_keeps_nulls(spark):
    df = spark.createDataFrame([(i, "g", None if i % 2 else i) for i in range(50)], "id long, g string, v long")
    got = {r["id"]: r["p"] for r in ordered.previous_value(df, ["g"], ["id"], "v", "p", chunks=9).collect()}
    assert got == {i: (None if i == 0 or (i - 1) % 2 else i - 1) for i in range(50)}


def test_next_match(events):
    ok = F.when(F.col("status") == 200, F.col("id"))
    got = {r["id"]: r["ok"] for r in
           ordered.next_match(events, ["host"], ["at", "id"], ok, "ok", chunks=13).collect()}
    want = {}
    for rows in grouped(events).values():
        later = None
        for r in reversed(rows):
            want[r["id"]] = later
            later = r["id"] if r["status"] == 200 else later
    assert got == want


def table(spark, rows):
    return spark.createDataFrame(rows, "id long, category string, name string, sql_text string")


def test_append_with_ids(spark):
    new = table(spark, [(None, "b", "n", "SELECT 2"), (None, "a", "n", "SELECT 1")]).drop("id")
    empty = table(spark, [])
    first = keyed.append_with_ids(empty, new)
    assert sorted((r["id"], r["category"]) for r in first.collect()) == [(1, "a"), (2, "b")]
    second = keyed.append_with_ids(first, new)
    assert sorted(r["id"] for r in second.collect()) == [1, 2, 3, 4]


def test_id_is_reused_after_deleting_the_last(spark):
    rows = table(spark, [(1, "a", "x", "s"), (2, "a", "y", "s")])
    left = keyed.delete_keys(rows, [2])
    again = keyed.append_with_ids(left, rows.where("id = 2").drop("id"))
    assert sorted(r["id"] for r in again.collect()) == [1, 2]


def test_delete_by_frame(spark):
    rows = table(spark, [(1, "a", "x", "s"), (2, "a", "y", "s")])
    assert [r["id"] for r in keyed.delete_keys(rows, rows.where("name = 'x'")).collect()] == [2]


def test_json_round_trip(spark, tmp_path):
    rows = table(spark, [(5, "b", "two", 'SELECT "x"\nFROM t'), (9, "a", "one", "SELECT 'é'")])
    path = str(tmp_path / "q")
    keyed.export_definitions(rows, path)
    after = keyed.import_definitions(table(spark, []), path)
    assert [tuple(r) for r in keyed.listing(after).collect()] == [
        (1, "a", "one", "SELECT 'é'"), (2, "b", "two", 'SELECT "x"\nFROM t')]


def test_import_of_an_array_in_any_column_order(spark, tmp_path):
    (tmp_path / "a.json").write_text('[\n {"name": "x", "sql_text": "s",\n  "category": "c"},\n {"sql_text": "t", "category": "c", "name": "y"}\n]')
    after = keyed.import_definitions(table(spark, [(4, "a", "w", "s")]), str(tmp_path / "a.json"), multi_line=True, chunks=3)
    assert sorted(map(tuple, after.collect())) == [(4, "a", "w", "s"), (5, "c", "x", "s"), (6, "c", "y", "t")]


@pytest.mark.parametrize("line", ["no json", '{"category": "a", "name": null, "sql_text": "s"}', '{"category": "a", "name": "x"}'])
def test_bad_definitions_are_refused(spark, tmp_path, line):
    (tmp_path / "d.json").write_text('{"category": "a", "name": "x", "sql_text": "s"}\n' + line + "\n")
    with pytest.raises(Exception, match="definition without|MALFORMED_RECORD"):
        keyed.import_definitions(table(spark, []), str(tmp_path / "d.json")).collect()


def test_listing_categories_and_tree(spark):
    rows = table(spark, [(1, "b", "x", "s"), (2, "a", "y", "s"), (3, "a", "x", "s")])
    assert [r["id"] for r in keyed.listing(rows).collect()] == [3, 2, 1]
    assert [r[0] for r in keyed.categories(rows).collect()] == ["a", "b"]
    tree = {(r["category"], r["position"]): r["name"] for r in keyed.category_tree(rows).collect()}
    assert tree == {("a", 1): "x", ("a", 2): "y", ("b", 1): "x"}


def test_nothing_to_number(spark, events):
    none = events.where("false")
    assert ordered.number_rows(none, ["at"], "n", unique=False).count() == 0
    assert ordered.running_count(none, ["host"], ["at", "id"], "n").count() == 0
    assert keyed.append_with_ids(table(spark, [(3, "a", "x", "s")]), table(spark, []).drop("id")).count() == 1
