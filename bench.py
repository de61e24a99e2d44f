"""Time the headline queries and print one JSON line.

Raw exchanges and the traffic table are written to Parquet first, as they would be at
rest; that is reported as ``setup`` and not part of the value. Each query runs to a sink that
takes every row; its figure is the best of a few runs.
"""

from __future__ import annotations

import json
import os
import sys
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from httplens.acceptance.queries import ORDERED, SQL, queries
from httplens.operators.ingest import normalize, upsert_ignore
from httplens.operators.lookup import message_detail
from httplens.plans.adhoc import run_sql
from httplens.plans.catalogue import CATALOGUE
from httplens.session import build_session, scratch_path
from httplens.sources import fixture
from httplens.sources.exchanges import read_exchanges, stream_exchanges
from httplens.sources.export import export, read_csv, read_json
from httplens.sources.traffic import load_project, load_traffic, save_project
from httplens.streaming.capture import append_to, capture, deduplicated
from httplens.streaming.live import latest_timeline, live_findings, live_timeline

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))

# Queries that write whole tables on the way get one run less.
WRITING = ("T-4", "T-6", "T-7", "T-12", "W-1", "W-2", "W-4")

# Queries that read the test tables themselves.
FROM_TABLES = ("K-1", "K-2", "K-5", "K-6", "G-1", "G-3", "G-4", "G-5", "G-6")


def _seconds(make: Callable[[], DataFrame], runs: int) -> float:
    best = float("inf")
    for _ in range(runs):
        start = time.perf_counter()
        make().write.format("noop").mode("overwrite").save()
        best = min(best, time.perf_counter() - start)
    return round(best, 3)


def _round_trip(spark: SparkSession, traffic: DataFrame, fmt: str) -> DataFrame:
    path = scratch_path(spark, fmt)
    export(traffic, fmt, path)
    return {"csv": read_csv, "json": read_json}[fmt](spark, path, traffic.schema)


def _timeline(spark: SparkSession, raw_path: str) -> DataFrame:
    path, checkpoint = scratch_path(spark, "bench-timeline"), scratch_path(spark, "bench-checkpoint")
    live_timeline(normalize(stream_exchanges(spark, raw_path)), path, checkpoint, every=None).awaitTermination()
    return latest_timeline(spark, path)


def _drained(spark: SparkSession, make: Callable[[DataFrame], DataFrame], raw_path: str) -> DataFrame:
    stream = make(stream_exchanges(spark, raw_path))
    path = scratch_path(spark, "bench-stream")
    append_to(stream, path, scratch_path(spark, "bench-checkpoint"), every=None).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def _captured(spark: SparkSession, raw_path: str) -> DataFrame:
    path = scratch_path(spark, "bench-capture")
    raw = stream_exchanges(spark, raw_path)
    capture(raw, path, scratch_path(spark, "bench-checkpoint"), every=None).awaitTermination()
    return load_traffic(spark, path)


def _projects(spark: SparkSession, traffic: DataFrame) -> DataFrame:
    path = scratch_path(spark, "bench-projects")
    save_project(traffic.withColumn("project_id", F.lower("method")), path)
    return load_project(spark, path, "post")


def _headline(spark: SparkSession, traffic: DataFrame, raw_path: str) -> dict[str, Callable[[], DataFrame]]:
    found = {i: (lambda a=a: a.run(traffic)) for i, a in CATALOGUE.items()}
    found |= {i: (lambda t=text: run_sql(traffic, t)) for i, text in SQL.items()}
    found |= {i: (lambda q=ordered_query: q(traffic)) for i, ordered_query in ORDERED.items()}
    whole, raw = queries(), read_exchanges(spark, raw_path)
    found |= {i: (lambda q=whole[i]: q(spark, SF_DIR)) for i in FROM_TABLES}
    return found | {
        "V1": lambda: message_detail(traffic, traffic.where("status_code >= 500")),
        "T-2": lambda: normalize(raw),
        "T-3": lambda: upsert_ignore(traffic.where("method = 'GET'"), normalize(raw)),
        "T-4": lambda: _captured(spark, raw_path),
        "T-6": lambda: _round_trip(spark, traffic, "csv"),
        "T-7": lambda: _round_trip(spark, traffic, "json"),
        "T-12": lambda: _projects(spark, traffic),
        "W-1": lambda: _drained(spark, deduplicated, raw_path),
        "W-2": lambda: _timeline(spark, raw_path),
        "W-4": lambda: _drained(spark, live_findings, raw_path),
    }


def main() -> None:
    spark = build_session(
        f"local[{CPUS}]",
        **{"spark.sql.shuffle.partitions": CPUS, "spark.ui.enabled": "false",
           "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")

    start = time.perf_counter()
    raw_path, path = scratch_path(spark, "bench-raw"), scratch_path(spark, "bench-traffic")
    fixture.raw_exchanges(spark, SF_DIR).repartitionByRange(int(CPUS), "id").write.parquet(raw_path)
    fixture.traffic(spark, SF_DIR).repartitionByRange(int(CPUS), "id").write.parquet(path)
    setup = round(time.perf_counter() - start, 3)
    traffic = load_traffic(spark, path)

    chosen = sys.argv[1:]
    timed = {
        name: _seconds(make, max(RUNS - (name in WRITING), 1))
        for name, make in _headline(spark, traffic, raw_path).items() if not chosen or name in chosen}
    print(json.dumps({
        "metric": "sum of best query times", "value": round(sum(timed.values()), 3), "unit": "sec",
        "queries": timed, "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1], "setup": setup,
        "rows": traffic.count(), "cpus": int(CPUS)}))
    spark.stop()


if __name__ == "__main__":
    main()
