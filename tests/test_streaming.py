"""Streams against the same work done in one go."""

import datetime as dt

import pytest
from conftest import SEED_B, exchange, raw_frame
from pyspark.sql import functions as F, types as T

from httplens.operators.findings import tag_findings
from httplens.operators.ingest import normalize
from httplens.plans.rollups import PANELS, timeline
from httplens.schema import RAW_EXCHANGE, TRAFFIC
from httplens.sources.traffic import load_project, load_traffic
from httplens.streaming import capture as cap
from httplens.streaming import live


def arrive(spark, folder, name, rows):
    raw_frame(spark, rows).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def stream(spark, folder, files_per_batch=1):
    return (spark.readStream.schema(RAW_EXCHANGE).option("recursiveFileLookup", True)
            .option("maxFilesPerTrigger", files_per_batch).parquet(str(folder)))


def text(df):
    return sorted(map(str, df.collect()))


@pytest.fixture
def folders(tmp_path):
    return tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "checkpoint")


def test_capture_keeps_the_first_arrival(spark, folders):
    inbox, out, checkpoint = folders
    arrive(spark, inbox, "1", [exchange(1, "first", 80, False, "GET", "/", 200),
                               exchange(1, "later", 80, False, "GET", "/", 200, seconds=50),
                               exchange(2, "x", 80, False, "GET", "/", 200)])
    cap.capture(stream(spark, inbox), out, checkpoint, every=None).awaitTermination()
    arrive(spark, inbox, "2", [exchange(1, "again", 80, False, "GET", "/", 200, seconds=0),
                               exchange(3, "y", 80, False, "GET", "/", 200)])
    cap.capture(stream(spark, inbox), out, checkpoint, every=None).awaitTermination()
    rows = load_traffic(spark, out).orderBy("id").collect()
    assert [(r["id"], r["host"]) for r in rows] == [(1, "first"), (2, "x"), (3, "y")]


def test_projects_do_not_meet(spark, folders, tmp_path):
    inbox, out, checkpoint = folders
    arrive(spark, inbox, "1", SEED_B)
    for project in ("one", "two", "one"):
        here = str(tmp_path / f"c{len(list(tmp_path.iterdir()))}")
        cap.capture(stream(spark, inbox), out, here, every=None, project_id=project).awaitTermination()
    for project in ("one", "two"):
        assert text(load_project(spark, out, project)) == text(normalize(raw_frame(spark, SEED_B)))


def test_batch_delivered_again(spark, folders, seed_b):
    _, out, _ = folders
    cap.create_table(spark, out, TRAFFIC)
    cap.store_batch(seed_b.where("id <= 4"), out)  # a first try that got this far
    cap.store_batch(seed_b, out)
    cap.store_batch(seed_b, out)
    assert text(load_traffic(spark, out)) == text(seed_b)


def test_deduplicated_across_batches(spark, folders):
    inbox, out, checkpoint = folders
    arrive(spark, inbox, "1", SEED_B[:6])
    arrive(spark, inbox, "2", SEED_B)
    cap.append_to(cap.deduplicated(stream(spark, inbox)), out, checkpoint, every=None).awaitTermination()
    assert text(load_traffic(spark, out)) == text(normalize(raw_frame(spark, SEED_B)))


def test_deduplicated_within_a_span(spark, folders):
    inbox, out, checkpoint = folders
    arrive(spark, inbox, "1", SEED_B)
    arrive(spark, inbox, "2", SEED_B)
    within = cap.deduplicated(stream(spark, inbox), within="1 hour")
    cap.append_to(within, out, checkpoint, every=None).awaitTermination()
    assert load_traffic(spark, out).count() == 10


def test_findings(spark, folders):
    inbox, out, checkpoint = folders
    arrive(spark, inbox, "1", SEED_B)
    cap.append_to(live.live_findings(stream(spark, inbox)), out, checkpoint, every=None).awaitTermination()
    assert text(spark.read.parquet(out)) == text(tag_findings(normalize(raw_frame(spark, SEED_B))))


def test_panels_follow_the_table(spark, folders, tmp_path):
    inbox, out, checkpoint = folders
    panels = str(tmp_path / "panels")
    arrive(spark, inbox, "1", SEED_B[:5])
    arrive(spark, inbox, "2", SEED_B)
    live.live_panels(stream(spark, inbox), out, panels, checkpoint, every=None).awaitTermination()
    whole = normalize(raw_frame(spark, SEED_B))
    for name, panel in PANELS.items():
        assert text(live.latest_panel(spark, panels, name)) == text(panel(whole))


def test_no_refresh_reads_the_stored_traffic(spark, folders, tmp_path):
    """Panels after batches with repeats that differ; what they read is the views alone."""
    inbox, out, checkpoint = folders
    panels = str(tmp_path / "panels")
    later = [(*row[:1], row[1] + dt.timedelta(hours=1), f"again.{row[2]}", *row[3:]) for row in SEED_B]
    for k in range(5):
        arrive(spark, inbox, str(k), [*SEED_B[2 * k:2 * k + 2], *later[:2 * k + 2]])
        live.live_panels(stream(spark, inbox, 100), out, panels, checkpoint, every=None).awaitTermination()
    whole = normalize(raw_frame(spark, SEED_B))
    for name, panel in PANELS.items():
        found = live.latest_panel(spark, panels, name)
        assert text(found) == text(panel(whole))
        assert found.inputFiles() and all(panels in f for f in found.inputFiles())
    assert text(load_traffic(spark, out)) == text(whole)
    exact = {(r.host, r.protocol): r.unique_paths for r in live.latest_panel(spark, panels, "hosts").collect()}
    assert {(r.host, r.protocol): r.about_paths for r in live.distinct_paths(spark, panels).collect()} == exact


def test_each_alert_leaves_the_stream_once(spark, folders):
    inbox, out, checkpoint = folders
    told = []

    def run(name, *seconds):
        arrive(spark, inbox, name, [exchange(1000 * len(told) + i, "h", 80, False, "GET", "/login", 401, seconds=s) for i, s in enumerate(seconds)])
        live.emitted_alerts(
            normalize(stream(spark, inbox, 100)), out, checkpoint, every=None, span="1 minute", slide="1 minute", late="10 minutes",
            tell=lambda new: told.append(sorted((r.since, r.failures) for r in new.collect()))).awaitTermination()

    run("1", 0, 10, 300)
    run("2", 310, 20)  # the late one makes the first minute's third
    run("3", 30, 320, 330)  # the first minute goes on growing
    run("4", 2000)
    run("5", 331, 332, 333, 0, 1)  # far behind the watermark
    assert [a for batch in told for a in batch] == [("2024-05-01 12:00", 3), ("2024-05-01 12:05", 4)]
    assert sorted(r.since for r in live.past_alerts(spark, out).collect()) == ["2024-05-01 12:00", "2024-05-01 12:05"]


def test_timeline_counts_open_minutes_and_late_rows(spark, folders):
    inbox, out, checkpoint = folders
    rows = [exchange(i, "h", 80, False, "GET", "/", 200, seconds=20 * i) for i in range(90)]
    for name, part in (("1", rows[60:]), ("2", rows[:30]), ("3", rows[30:60])):
        arrive(spark, inbox, name, part)
    for _ in range(2):  # the second run finds nothing new
        live.live_timeline(normalize(stream(spark, inbox)), out, checkpoint, every=None).awaitTermination()
    assert text(live.latest_timeline(spark, out)) == text(timeline(normalize(raw_frame(spark, rows)), limit=None))


def test_a_batch_of_counts_delivered_again_counts_once(spark, folders, seed_b):
    inbox, out, checkpoint = folders
    arrive(spark, inbox, "1", SEED_B)
    for here in (checkpoint, checkpoint + "-lost"):  # the second run starts over
        live.live_timeline(normalize(stream(spark, inbox)), out, here, every=None).awaitTermination()
    assert text(live.latest_timeline(spark, out)) == text(timeline(seed_b, limit=None))


def test_nothing_arrived(spark, folders):
    inbox, out, checkpoint = folders
    inbox.mkdir()
    live.auth_failure_alerts(normalize(stream(spark, inbox)), out, checkpoint, every=None).awaitTermination()
    assert live.latest_alerts(spark, out).columns == ["since", "host", "path", "failures"]
    assert live.latest_alerts(spark, out).count() == 0


def test_alerts(spark, folders):
    inbox, out, checkpoint = folders
    rows = [exchange(i, "h", 80, False, "GET", "/login", 401, seconds=30 * i) for i in range(3)]
    arrive(spark, inbox, "1", [*rows[1:], *(
        exchange(10 + i, "h", 80, False, "GET", "/other", 403, seconds=600 * i) for i in range(9))])
    arrive(spark, inbox, "2", rows[:1])
    live.auth_failure_alerts(normalize(stream(spark, inbox)), out, checkpoint, every=None).awaitTermination()
    got = live.latest_alerts(spark, out)
    assert {r["path"] for r in got.collect()} == {"/login"}
    # Seconds 0, 30 and 60 share the spans that start from 4 minutes before to the minute of the first.
    assert got.count() == 4 and got.agg(F.max("failures")).first()[0] == 3


def test_first_arrivals_from_state(spark, folders):
    """Repeats differ in every column and tie in time; an earlier batch wins even over an earlier time."""
    inbox, out, checkpoint = folders
    one = [exchange(1, f"h{k}", k, False, "GET", f"/{k}", 200, resp_body=str(k), seconds=5) for k in range(6)]
    arrive(spark, inbox, "1", [*one, exchange(2, "x", 80, False, "GET", "/", 200)])
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        cap.keep_first(stream(spark, inbox), out, checkpoint, every=None).awaitTermination()
        kept = {r["id"]: r["host"] for r in cap.load_first(spark, out).collect()}
        arrive(spark, inbox, "2", [exchange(1, "early", 80, False, "GET", "/", 200, seconds=0),
                                   exchange(2, "x", 80, False, "GET", "/", 200), exchange(3, "y", 80, False, "GET", "/", 200)])
        cap.keep_first(stream(spark, inbox), out, checkpoint, every=None).awaitTermination()
    finally:
        spark.conf.unset(provider)
    rows = cap.load_first(spark, out).orderBy("id").collect()
    assert [(r["id"], r["host"]) for r in rows] == [(1, kept[1]), (2, "x"), (3, "y")]
    assert {(r["host"], r["port"], r["path"], r["resp_body"]) for r in rows if r["id"] == 1} <= {
        (f"h{k}", k, f"/{k}", str(k)) for k in range(6)}


def shuffled(query):
    """The columns that the last batch of a stream shuffled."""
    def nodes(node):
        yield node
        for i in range(node.children().size()):
            yield from nodes(node.children().apply(i))

    plan = query._jsq.streamingQuery().lastExecution().executedPlan()
    return [node.output().mkString(" ") for node in nodes(plan) if node.nodeName() == "Exchange"]


def dedupe(spark, inbox, out, checkpoint, files_per_batch=1):
    query = cap.append_to(cap.deduplicated(stream(spark, inbox, files_per_batch)), out, checkpoint, every=None)
    query.awaitTermination()
    return query


@pytest.fixture
def large(spark, folders):
    """40 bodies of 64 KB that do not compress well, each twice."""
    body = F.expr("concat_ws('', transform(sequence(1, 1000), k -> sha2(concat(id, '-', k), 256)))")
    rows = [exchange(k % 40, "h", 80, False, "GET", f"/{k % 40}", 200, seconds=k % 40) for k in range(80)]
    whole = raw_frame(spark, rows).withColumn("resp_body", body).cache()
    whole.coalesce(1).write.parquet(f"{folders[0]}/1")
    return whole


def test_state_gets_no_bodies(spark, folders, large):
    inbox, out, checkpoint = folders
    query = dedupe(spark, inbox, out, checkpoint)
    assert shuffled(query) and not any("resp_body" in columns for columns in shuffled(query))
    assert text(load_traffic(spark, out)) == text(normalize(large).distinct())


def test_first_arrivals_are_stored_without_bodies_in_state(spark, folders, large, tmp_path):
    inbox, out, checkpoint = folders
    query = cap.keep_first(stream(spark, inbox), out, checkpoint, every=None)
    query.awaitTermination()
    assert shuffled(query) and not any("resp_body" in columns for columns in shuffled(query))
    assert sum(p.stat().st_size for p in (tmp_path / "checkpoint" / "state").rglob("*") if p.is_file()) < 40 * 32_000
    assert text(cap.load_first(spark, out)) == text(normalize(large).distinct())


def test_a_deduplicated_batch_that_is_run_again(spark, folders, tmp_path):
    """Of the last batch only some files were left, and the stream knows nothing of its end."""
    inbox, out, checkpoint = folders
    arrive(spark, inbox, "1", SEED_B[:3])
    dedupe(spark, inbox, out, checkpoint)
    before = set((tmp_path / "out").glob("*"))
    raw_frame(spark, SEED_B).repartition(4, "id").write.parquet(f"{inbox}/2")
    dedupe(spark, inbox, out, checkpoint, 100)
    new = sorted(p for p in set((tmp_path / "out").glob("part-*")) - before if spark.read.parquet(str(p)).count())
    for lost in [new[0], tmp_path / "out" / f".{new[0].name}.crc", *(tmp_path / "checkpoint" / "commits").glob("*1*")]:
        lost.unlink()
    assert load_traffic(spark, out).count() < 10
    for _ in range(2):
        dedupe(spark, inbox, out, checkpoint, 100)
        assert text(load_traffic(spark, out)) == text(normalize(raw_frame(spark, SEED_B)))


def test_a_table_of_the_file_sink_goes_on(spark, folders):
    inbox, out, checkpoint = folders
    arrive(spark, inbox, "1", SEED_B[:6])
    cap.append_to(cap.deduplicated(stream(spark, inbox)).select("*"), out, checkpoint, every=None).awaitTermination()
    arrive(spark, inbox, "2", SEED_B)
    dedupe(spark, inbox, out, checkpoint)
    assert text(load_traffic(spark, out)) == text(normalize(raw_frame(spark, SEED_B)))


@pytest.mark.parametrize("within", [None, "1 minute"])
def test_odd_repeats_as_whole_rows_through_the_state(spark, folders, within):
    """Null ids and times, repeats that come late, rows behind the watermark: what the state lets through is what is stored."""
    inbox, out, checkpoint = folders
    row = lambda id, s, host="h": exchange(id, host, 80, False, "GET", "/", 200, seconds=s)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in RAW_EXCHANGE])
    nothing = raw_frame(spark, [row(0, 5)]).withColumn("id", F.lit(None).cast("long"))
    arrive(spark, inbox, "1", [row(1, 0), row(1, 0), row(2, 300)])
    arrive(spark, inbox, "2", [row(3, 1), row(4, 310), row(4, 310), row(1, 305), row(5, 2), row(5, 320)])
    for name in ("3", "4"):
        nothing.unionByName(nothing).withColumn("ts", F.col("ts") + F.expr("INTERVAL 400 SECONDS")).coalesce(1).write.parquet(f"{inbox}/{name}")
    arrive(spark, inbox, "5", [row(6, 500), row(1, 505), row(2, 510), row(7, 1), row(8, 2), row(8, 505)])
    given = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(inbox))
    cap.append_to(cap.deduplicated(given, within), out, checkpoint, every=None).awaitTermination()
    whole = cap.deduplicated(given, within).select("*")
    cap.append_to(whole, out + "-whole", checkpoint + "-whole", every=None).awaitTermination()
    ids = lambda path: sorted(str(r.id) for r in spark.read.schema(TRAFFIC).parquet(f"{path}/part-*").collect())
    assert ids(out) == ids(out + "-whole") and ids(out).count("None") == 1
    if within:
        late = load_traffic(spark, out).where("id IN (7, 8)").collect()
        assert [(r.id, r.timestamp) for r in late] == [(8, row(8, 505)[1])]
    else:
        cap.keep_first(given, out + "-first", checkpoint + "-first", every=None).awaitTermination()
        assert sorted(str(r.id) for r in cap.load_first(spark, out + "-first").collect()) == ids(out)
