"""What whole rows are spared: keys and places go to them."""

import os

import pytest
from conftest import exchange, raw_frame
from pyspark.sql import functions as F

from httplens.operators import ingest
from httplens.operators.lookup import message_detail
from httplens.plans.rules import Rule
from httplens.session import stage
from httplens.sources import clustered, export, traffic as store
from httplens.streaming import capture as cap

EXTREMES = [None, None, -(2**63), -40_000, -32_768, -1, 0, 1, 32_768, 32_769, 70_000, 70_000, 2**63 - 1]


def listed(df):
    return sorted(map(str, df.collect()))


def moved_bodies(df):
    text = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in text.splitlines() if "Exchange" in line and "Broadcast" not in line]


def repeated(spark):
    rows = [exchange(k % 40, f"h{k}", k, False, "GET", f"/{k}", 200, seconds=k % 7, resp_body="b" * k) for k in range(200)]
    return ingest.normalize(raw_frame(spark, rows)).cache()


@pytest.mark.parametrize("limit", [ingest.SENT_BITMAPS, 0])
def test_keys_that_are_sent(spark, monkeypatch, limit):
    monkeypatch.setattr(ingest, "SENT_BITMAPS", limit)
    rows = spark.createDataFrame([(i, str(i)) for i in EXTREMES], "id long, text string")
    keys = spark.createDataFrame([(i,) for i in [None, -32_768, 0, 32_769, 70_000, 2**63 - 1, 5, -(2**63)]], "id long")
    assert listed(ingest.within(rows, keys)) == listed(rows.join(keys, "id", "left_semi"))
    assert listed(ingest.without(rows, keys)) == listed(rows.join(keys, "id", "left_anti"))


@pytest.mark.parametrize("limit", [ingest.SENT_BITMAPS, 0])
def test_the_same_winners_without_a_move(spark, monkeypatch, limit):
    monkeypatch.setattr(ingest, "SENT_BITMAPS", limit)
    incoming = repeated(spark)
    existing = incoming.where("id % 3 = 0").limit(3)
    assert listed(ingest.new_rows(existing, incoming)) == listed(ingest.append_new(existing, incoming))
    by_host = incoming.withColumn("project_id", F.lit("p"))
    key = ("project_id", "id")
    assert listed(ingest.new_rows(by_host.limit(0), by_host, key)) == listed(ingest.append_new(by_host.limit(0), by_host, key))


def test_stored_rows_are_not_staged_and_winners_not_shuffled(spark):
    incoming = repeated(spark)
    assert moved_bodies(ingest.append_new(incoming.limit(0), incoming))
    whole = stage(incoming.repartition(3), "batch")
    places = stage(ingest.winners(whole, lambda narrow: narrow), "winners")
    found = ingest.kept_at(whole, places)
    assert not any("resp_body" in line for line in found._jdf.queryExecution().executedPlan().toString().splitlines()
                   if "Exchange" in line) and "ShuffledHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert listed(found) == listed(ingest.first_per_key(incoming))


def test_what_is_stored_is_not_written_again(spark, tmp_path, monkeypatch):
    staged, put = [], cap.stage
    monkeypatch.setattr(cap, "stage", lambda df, label: staged.append((label, put(df, label))) or staged[-1][1])
    incoming, out = repeated(spark), str(tmp_path / "out")
    cap.create_table(spark, out)
    for _ in range(2):
        cap.store_batch(incoming, out)
    assert [df.count() for label, df in staged if label == "batch"] == [200, 0]
    assert listed(store.load_traffic(spark, out)) == listed(ingest.first_per_key(incoming))


def test_messages_of_a_long_result_are_not_shuffled(spark):
    traffic = repeated(spark)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = message_detail(traffic, traffic.select("id").where("id < 20"))
        text = found._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in text and "hashpartitioning" not in text.split("InMemoryTableScan")[0]
        assert sorted(r.id for r in found.collect()) == sorted(k % 40 for k in range(200) if k % 40 < 20)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_clustered_bodies_stay_as_they_came(spark, tmp_path):
    path, traffic = str(tmp_path / "t"), repeated(spark)
    clustered.write_clustered(traffic.repartition(4, "path"), path, files=8)
    assert "resp_body" not in spark.read.parquet(f"{path}/data").columns
    assert listed(clustered.load_clustered(spark, path).drop("req_length")) == listed(traffic)
    assert listed(clustered.messages(spark, path, [3, 4, 99])) == listed(message_detail(traffic, [3, 4, 99]))
    rule = Rule("Z", "Test", "Long bodies", lambda: F.length("resp_body") > 150, columns=("id", "path", "resp_body"), order=("id",))
    for limit in (3, 1000):
        found = clustered.first_findings(spark, path, rule, limit).collect()
        assert [r.id for r in found] == [r.id for r in rule.run(traffic, limit=limit).collect()]
        assert all(len(r.resp_body) > 150 and r.path == f"/{len(r.resp_body)}" for r in found)


@pytest.mark.parametrize("bodies", [400, 1200])
def test_a_clustered_body_that_comes_again_is_not_written_again(spark, tmp_path, bodies):
    """Bodies of 6 KB, 2.3 MB of them between one and the next that equals it; and bodies that all differ."""
    body = F.expr(f"concat_ws('', transform(sequence(1, 90), k -> sha2(concat(id % {bodies}, '-', k), 256)))")
    traffic = raw_frame(spark, [exchange(k, "h", 1, False, "GET", f"/{k}", 200) for k in range(1200)]).coalesce(1)
    traffic = ingest.normalize(traffic.sortWithinPartitions("id").withColumn("resp_body", body)).cache()
    path = str(tmp_path / "t")
    clustered.write_clustered(traffic, path, rows_per_file=1200, files=2)
    written = sum(p.stat().st_size for p in (tmp_path / "t" / "rows").glob("part-*"))
    assert written < 0.7 * bodies * 90 * 64
    assert listed(clustered.load_clustered(spark, path).drop("req_length")) == listed(traffic)
    assert listed(clustered.messages(spark, path, [3, 403, 1199])) == listed(message_detail(traffic, [3, 403, 1199]))


def test_clustered_bodies_are_written_once_in_any_order(spark, tmp_path):
    """150 bodies of 6 KB in all of eight tasks, which write a file each."""
    body = F.expr("concat_ws('', transform(sequence(1, 90), k -> sha2(concat(id % 150, '-', k), 256)))")
    traffic = raw_frame(spark, [exchange(k, "h", 1, False, "GET", f"/{k}", 200) for k in range(1200)]).repartition(8, "path")
    traffic = ingest.normalize(traffic.withColumn("resp_body", body)).cache()
    path = str(tmp_path / "t")
    clustered.write_clustered(traffic, path, rows_per_file=1200, files=2)
    written = sum(p.stat().st_size for p in (tmp_path / "t").rglob("part-*"))
    assert written < 2 * 150 * 90 * 32
    assert listed(clustered.load_clustered(spark, path).drop("req_length")) == listed(traffic)
    assert listed(clustered.messages(spark, path, [3, 403, 1199])) == listed(message_detail(traffic, [3, 403, 1199]))


@pytest.mark.parametrize("signs", [8, 1])
def test_clustered_bodies_of_odd_rows(spark, tmp_path, monkeypatch, signs):
    """Ids and bodies that are missing or come again, each alone and together; and no rows."""
    monkeypatch.setattr(clustered, "SIGNS", signs)
    odd = [(i, b) for i in (None, 1, 1, 7, -5, 2**62) for b in (None, "", "a", "a", "b")] + [(k, f"own {k}") for k in range(50)]
    given = repeated(spark).limit(1).drop("id", "resp_body").crossJoin(spark.createDataFrame(odd, "id long, resp_body string"))
    traffic = given.select(*clustered.CLUSTERED.fieldNames()[:-1]).cache()
    for name, some in (("all", traffic), ("bodiless", traffic.where("resp_body IS NULL")), ("none", traffic.limit(0))):
        path = str(tmp_path / name)
        clustered.write_clustered(some, path, files=3)
        again = clustered.load_clustered(spark, path)
        assert listed(again.drop("req_length")) == listed(some)
        assert listed(clustered.messages(spark, path, [1, 7, None])) == listed(message_detail(some, [1, 7]))
        rule = Rule("Z", "Test", "Bodies", lambda: F.length("resp_body") > 0, columns=("id", "resp_body"), order=("id",))
        found = clustered.first_findings(spark, path, rule, 1000)
        assert listed(found) == listed(rule.run(some, limit=1000))
    clustered.write_clustered(clustered.load_clustered(spark, str(tmp_path / "all")), str(tmp_path / "copy"), files=3)
    assert listed(clustered.load_clustered(spark, str(tmp_path / "copy"))) == listed(clustered.load_clustered(spark, str(tmp_path / "all")))


def test_clustered_bodies_that_are_others_each_time(spark, tmp_path):
    drawn = F.udf(lambda: os.urandom(8).hex()).asNondeterministic()
    traffic, path = repeated(spark).withColumn("resp_body", drawn()), str(tmp_path / "t")
    clustered.write_clustered(traffic, path, files=3)
    again = clustered.load_clustered(spark, path)
    assert again.count() == 200 and again.where("length(resp_body) = 16").select("resp_body").distinct().count() == 200


@pytest.mark.parametrize("fmt", ["CSV", "JSON"])
def test_compressed_export_comes_back(spark, tmp_path, seed_a, fmt):
    path = str(tmp_path / "x")
    export.export(seed_a, fmt, path, compression="gzip")
    names = [p.name for p in (tmp_path / "x").glob("part-*")]
    assert names and all(n.endswith(".gz") for n in names)
    read = export.read_csv if fmt == "CSV" else export.read_json
    assert listed(read(spark, path, seed_a.schema)) == listed(seed_a)


def test_project_files_are_compressed_well(tmp_path, seed_a):
    store.save_project(seed_a, str(tmp_path / "p"), "one")
    assert all(".zstd." in p.name for p in (tmp_path / "p").rglob("part-*"))


def test_project_rows_are_written_where_they_are(spark, tmp_path, monkeypatch):
    """A file per task and folder, with some folders open or all; the session's own setting is back afterwards."""
    traffic = repeated(spark).withColumn("project_id", F.expr("CASE id % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN '' END"))
    traffic = traffic.withColumn("timestamp", F.expr("CASE WHEN id % 5 > 0 THEN timestamp + make_dt_interval(id % 3) END")).repartition(3).cache()
    writers = "spark.sql.maxConcurrentOutputFileWriters"
    given, before = traffic.withColumn("date", F.to_date("timestamp")), spark.conf.get(writers)
    kept = given.withColumn("project_id", F.expr("nullif(project_id, '')"))
    folders = kept.select("project_id", "date").distinct().count()
    for files in (128, 2):
        monkeypatch.setattr(store, "OPEN_FILES", files, raising=False)
        path = tmp_path / str(files)
        store.save_project(traffic, str(path))
        assert listed(store.load_projects(spark, str(path)).select(*kept.columns)) == listed(kept)
        assert len(list(path.rglob("part-*"))) == given.select(F.spark_partition_id(), "project_id", "date").withColumn(
            "project_id", F.expr("nullif(project_id, '')")).distinct().count() > folders
        assert spark.conf.get(writers) == before
    store.save_project(traffic, str(tmp_path / "few"), gathered=True)
    assert listed(store.load_projects(spark, str(tmp_path / "few")).select(*kept.columns)) == listed(kept)
    assert len(list((tmp_path / "few").rglob("part-*"))) == folders
