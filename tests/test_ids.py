"""The index of stored ids: what it opens, what it survives, what moves."""

import pytest
from conftest import exchange, raw_frame
from pyspark.sql import functions as F

from httplens.operators.ingest import at_places, normalize, winners
from httplens.session import stage
from httplens.sources.ids import StoredIds
from httplens.sources.snapshots import Snapshots
from httplens.sources.traffic import load_traffic
from httplens.streaming import capture as cap
from httplens.streaming.views import FAN_IN


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def test_only_files_that_may_hold_an_id_are_opened(spark, tmp_path):
    index = StoredIds(spark, str(tmp_path / "ids"), ids_per_file=100)
    for k in range(3):
        index.add(spark.range(1_000 * k, 1_000 * k + 500))
    asked = spark.createDataFrame([(5,), (2_005,), (2_400,), (700,), (-9,)], "id long")
    opened = index.files(asked)
    assert 2 <= len(opened) <= 3
    held = ids(spark.read.parquet(*opened))
    assert len(held) <= 300 and {5, 2_005, 2_400} <= set(held)
    assert ids(index.absent(asked)) == [-9, 700]
    assert index.files(spark.createDataFrame([(700,), (None,)], "id long")) == []


def test_parts_stay_few(spark, tmp_path):
    path = str(tmp_path / "ids")
    index = StoredIds(spark, path)
    for k in range(2 * FAN_IN + 1):
        index.add(spark.range(k, k + 2))
    state = Snapshots(spark, path).state()
    assert sorted(p["level"] for p in state.parts) == [0, 1, 1]
    assert ids(index.absent(spark.range(0, 40))) == list(range(2 * FAN_IN + 2, 40))


@pytest.mark.parametrize("lost_after", ["note", "append"])
def test_a_writer_lost_on_the_way(spark, seed_b, tmp_path, monkeypatch, lost_after):
    out = str(tmp_path / "out")
    cap.create_table(spark, out)
    cap.store_batch(seed_b.where("id <= 3"), out)

    def lost(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(cap, "_store", lost) if lost_after == "note" else patch.setattr(StoredIds, "add", lost)
        with pytest.raises(RuntimeError, match="lost"):
            cap.store_batch(seed_b.where("id <= 7"), out)
    cap.store_batch(seed_b, out)
    assert ids(load_traffic(spark, out)) == list(range(1, 11))


def test_a_table_without_an_index_gets_one(spark, seed_b, tmp_path):
    out = str(tmp_path / "out")
    seed_b.where("id <= 4").write.parquet(out)
    cap.store_batch(seed_b, out)
    assert ids(load_traffic(spark, out)) == list(range(1, 11))
    cap.store_batch(seed_b.where("id < 0"), out)
    assert ids(load_traffic(spark, out)) == list(range(1, 11))


def test_same_winner_in_any_layout_and_no_body_in_a_sort(spark):
    rows = normalize(raw_frame(spark, [exchange(k % 3, f"h{k}", k, False, "GET", f"/{k}", 200, seconds=1) for k in range(60)]))
    timeless = rows.withColumn("timestamp", F.lit(None).cast("timestamp")).withColumn("host", F.lit("timeless"))
    rows, found = rows.unionByName(timeless), set()
    for layout in (rows.coalesce(1), rows.repartition(7, "host"), rows.repartitionByRange(3, F.desc("host"))):
        whole = stage(layout.unionByName(layout), "batch")
        new = at_places(whole, stage(winners(whole, lambda df: df), "winners"))
        found.add(tuple(sorted(map(str, new.collect()))))
    assert len(found) == 1 and len(next(iter(found))) == 3 and "timeless" not in str(found)
    chosen = winners(whole, lambda df: df)._jdf.queryExecution().executedPlan().toString()
    assert not any("resp_body" in line for line in chosen.splitlines() if "Exchange" in line or "Sort" in line)
    moved = at_places(whole, stage(winners(whole, lambda df: df), "winners"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = moved._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "ShuffledHashJoin" in text and "Sort" not in text.replace("SortMerge", "")
