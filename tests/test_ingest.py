"""Normalising, first-wins append, lookup, project folders."""

import pytest
from conftest import SEED_A, exchange, raw_frame
from pyspark.sql import functions as F

from httplens.operators.ingest import append_new, first_per_key, normalize, upsert_ignore
from httplens.operators.lookup import default_listing, message_detail
from httplens.schema import TRAFFIC
from httplens.sources.exchanges import parse_exchanges, read_exchanges, rejected_exchanges
from httplens.sources.traffic import load_project, load_traffic, save_project


def test_layout_and_derived_columns(spark):
    rows = [exchange(1, "a", 80, False, "GET", "/", 200, resp_body="é😀"),
            exchange(2, "a", 443, True, "GET", "/", 200, [("A", "1"), ("A", "2")], None, None)]
    first, second = normalize(raw_frame(spark, rows)).orderBy("id").collect()
    assert normalize(raw_frame(spark, rows)).schema.fieldNames() == TRAFFIC.fieldNames()
    assert (first["protocol"], second["protocol"]) == ("http", "https")
    assert (first["resp_length"], second["resp_length"]) == (2, 0)
    assert first["req_headers"] == "{}"
    assert second["req_headers"] == '{"A":"1","A":"2"}'
    assert second["req_body"] is None


def test_first_arrival_wins(spark):
    rows = [exchange(42, "b.com", 80, False, "GET", "/late", 200, seconds=9),
            exchange(42, "a.com", 80, False, "GET", "/early", 404, seconds=1),
            exchange(7, "c.com", 80, False, "GET", "/", 200)]
    kept = first_per_key(normalize(raw_frame(spark, rows))).orderBy("id").collect()
    assert [(r["id"], r["host"], r["path"], r["status_code"]) for r in kept] == [
        (7, "c.com", "/", 200), (42, "a.com", "/early", 404)]


def test_stored_rows_stay(spark, seed_a):
    again = normalize(raw_frame(spark, [
        exchange(3, "other", 80, False, "GET", "/", 200), exchange(11, "new", 80, False, "GET", "/", 200),
        exchange(11, "new2", 80, False, "GET", "/", 200, seconds=12)]))
    assert [(r["id"], r["host"]) for r in append_new(seed_a, again).collect()] == [(11, "new")]
    after = upsert_ignore(seed_a, again)
    assert after.count() == 11
    assert after.where("id = 3").first()["host"] == "shop.test"
    assert upsert_ignore(seed_a, again.where("false")).count() == 10


def test_key_of_project_and_id(spark, seed_a):
    from pyspark.sql import functions as F
    one = seed_a.withColumn("project_id", F.lit("one"))
    two = seed_a.withColumn("project_id", F.lit("two"))
    assert append_new(one, one.unionByName(two), key=("project_id", "id")).count() == 10


def test_one_id_holding_most_rows_is_combined_before_the_shuffle(spark):
    df = spark.range(30_000).selectExpr(
        "if(id % 3 = 0, -1, id) AS id", "timestamp_seconds(id) AS timestamp", "id AS payload")
    found = first_per_key(df)
    assert found.count() == 20_001
    assert found.where("id = -1").first()["payload"] == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_min_by") > plan.index("Exchange hashpartitioning(id")  # printed top down


def test_detail(seed_a):
    found = {r["id"]: r for r in message_detail(seed_a, [2, 3, 99, None]).collect()}
    assert set(found) == {2, 3}
    assert found[2]["request"] == '{"content-type":"application/json; charset=utf-8"}\r\n\r\n{"sku":7}'
    assert found[3]["response"] == "{}"


def test_detail_of_a_result(spark, seed_a):
    result = seed_a.where("status_code >= 400").select("id")
    with_null = result.unionByName(result).unionByName(spark.createDataFrame([(None,)], "id long"))
    assert sorted(r["id"] for r in message_detail(seed_a, with_null).collect()) == [3, 6]
    with pytest.raises(ValueError, match="id"):
        message_detail(seed_a, seed_a.select("host"))


def test_listing(seed_a):
    rows = default_listing(seed_a).collect()
    assert [r["id"] for r in rows] == list(range(10, 0, -1))
    assert default_listing(seed_a, 3).count() == 3


def test_projects_are_apart(spark, seed_a, tmp_path):
    path = str(tmp_path / "t")
    save_project(seed_a, path, "one")
    save_project(seed_a.where("id <= 3"), path, "two")
    assert load_project(spark, path, "one").count() == 10
    assert load_project(spark, path, "two").schema.fieldNames() == TRAFFIC.fieldNames()
    assert load_project(spark, path, "two", since="2024-05-01", until="2024-05-01").count() == 3
    assert load_project(spark, path, "two", since="2024-05-02").count() == 0
    plan = load_project(spark, path, "two")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(project_id" in plan


def test_load_keeps_column_order(spark, seed_a, tmp_path):
    path = str(tmp_path / "t")
    seed_a.select(*reversed(seed_a.columns)).write.parquet(path)
    df = load_traffic(spark, path)
    assert df.columns == TRAFFIC.fieldNames() and df.count() == len(SEED_A)


def test_exchanges_from_files_and_texts(spark, tmp_path):
    raw = raw_frame(spark, SEED_A)
    for fmt in ("parquet", "json"):
        path = str(tmp_path / fmt)
        raw.write.format(fmt).save(path)
        assert sorted(map(str, read_exchanges(spark, path, fmt).collect())) == sorted(map(str, raw.collect()))
    texts = raw.selectExpr("to_json(struct(*)) AS value").unionByName(
        spark.createDataFrame([("not json",), ("{}",), (None,)], "value string"))
    assert sorted(map(str, parse_exchanges(texts).collect())) == sorted(map(str, raw.collect()))


def test_every_message_is_kept_or_rejected(spark):
    bad = {"not json": "not an exchange", "{}": "no id", '{"id":1,"port":"eighty"}': "not an exchange",
           '{"id":"x"}': "not an exchange", "": "no id", None: "no text"}
    sent = spark.createDataFrame([(i, t) for i, t in enumerate([*bad, '{"id":7,"host":"h","extra":1}'])], "n long, value string")
    assert [(r["id"], r["host"]) for r in parse_exchanges(sent).collect()] == [(7, "h")]
    rejected = rejected_exchanges(sent)
    assert rejected.columns == ["n", "value", "reason"]
    assert {r["value"]: r["reason"] for r in rejected.collect()} == bad


def test_time_of_arrival_by_default(spark):
    timeless = raw_frame(spark, SEED_A[:1]).withColumn("ts", F.lit(None).cast("timestamp"))
    row = normalize(timeless).select(F.abs(F.unix_timestamp(F.current_timestamp()) - F.unix_timestamp("timestamp"))).first()
    assert row[0] < 600


def test_same_winner_in_any_layout(spark, seed_a):
    tied = seed_a.where("id = 1").withColumn("host", F.explode(F.array([F.lit(f"h{i}") for i in range(40)])))
    late = tied.withColumn("timestamp", F.lit(None).cast("timestamp")).withColumn("host", F.lit("timeless"))
    rows = tied.unionByName(late)
    layouts = [rows.coalesce(1), rows.repartition(7, "host"), rows.repartitionByRange(3, F.desc("host"))]
    winners = {first_per_key(layout).first()["host"] for layout in layouts}
    assert len(winners) == 1 and winners != {"timeless"}
