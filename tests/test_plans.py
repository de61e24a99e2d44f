"""What the plans must look like to hold at scale."""

import pytest

from httplens.operators.lookup import message_detail
from httplens.plans import rollups
from httplens.plans.catalogue import CATALOGUE, run
from httplens.plans.digest import digest
from httplens.sources.traffic import load_traffic


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, seed_a, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stored") / "t")
    seed_a.write.parquet(path)
    return load_traffic(spark, path)


@pytest.mark.parametrize("analysis_id", sorted(CATALOGUE))
def test_bodies_are_not_read(stored, analysis_id):
    read = [line for line in plan(run(stored, analysis_id)).splitlines() if "ReadSchema" in line]
    assert read and all("resp_body" not in line and "resp_headers" not in line for line in read)


@pytest.mark.parametrize("analysis_id", sorted(CATALOGUE))
def test_no_python_and_no_pairs(stored, analysis_id):
    text = plan(run(stored, analysis_id))
    for bad in ("Python", "CartesianProduct", "BroadcastNestedLoopJoin", "Window ["):
        assert bad not in text


@pytest.mark.parametrize("analysis_id,pushed", [
    ("A1", "In(status_code, [401,403])"), ("A2", "Or(EqualTo(status_code,200),In(status_code, [401,403]))"),
    ("E1", "GreaterThanOrEqual(status_code,500)"), ("O2", "EqualTo(status_code,200)"),
    ("O3", "EqualTo(protocol,http)"), ("C4", "In(method, [DELETE,PATCH,POST,PUT])"),
    ("I1", "Not(In(method, [GET,HEAD,OPTIONS]))"), ("E4", "EqualTo(status_code,404)"),
    ("S4", "LessThan(status_code,400)"), ("X1", "EqualTo(status_code,200)"),
])
def test_filters_reach_the_scan(stored, analysis_id, pushed):
    assert pushed in plan(run(stored, analysis_id))


@pytest.mark.parametrize("analysis_id", ["A4", "C1", "C4", "D2", "D5", "E3", "M2", "M5", "R5", "S2"])
def test_top_k_without_a_full_sort(stored, analysis_id):
    text = plan(run(stored, analysis_id))
    assert "TakeOrderedAndProject" in text and "rangepartitioning" not in text


@pytest.mark.parametrize("analysis_id", ["F1", "F2"])
def test_findings_take_one_scan(stored, analysis_id):
    text = plan(run(stored, analysis_id))
    assert text.count("FileScan") == 1
    assert "Exchange hashpartitioning" not in text


def test_lower_is_worked_out_once_per_row(stored):
    assert plan(run(stored, "S1")).count("lower(path") == 1


@pytest.mark.parametrize("analysis_id", ["R1", "D7", "S2", "D4"])
def test_distinct_counts_shuffle_on_the_counted_value_too(stored, analysis_id):
    """So that the rows of one busy host are spread before they are counted."""
    first = plan(run(stored, analysis_id)).split("Exchange hashpartitioning(")[-1].split("]")[0]
    counted = "status_code" if analysis_id == "D4" else "path"
    assert f"{counted}#" in first


def test_top_rows_per_host_are_cut_before_the_shuffle(stored):
    from httplens.acceptance.queries import SQL
    from httplens.plans.adhoc import run_sql
    assert "WindowGroupLimit" in plan(run_sql(stored, SQL["Q1"])).split("Exchange hashpartitioning")[1]


def test_stored_ids_are_read_in_the_span_of_the_batch(stored):
    from httplens.operators.ingest import append_new
    text = plan(append_new(stored, stored.where("id > 8")))
    assert "(id#" in text and ">= Subquery" in text and "<= Subquery" in text


@pytest.mark.parametrize("analysis_id", ["A3", "S1", "X1"])
def test_full_sorts_do_not_search_twice(stored, analysis_id):
    """The sort samples an exchange that is there already, not the scan."""
    text = plan(run(stored, analysis_id))
    assert text.index("rangepartitioning") < text.index("REBALANCE_PARTITIONS") < text.index("Filter")
    assert "Exchange" not in plan(run(stored, analysis_id, ordered=False))


def test_lookup_by_id_reaches_the_scan(stored):
    from httplens.operators.lookup import message_detail
    assert "In(id, [2,3,9])" in plan(message_detail(stored, [2, 3, 9]))


def test_ordered_work_shuffles_its_rows_once(spark, stored):
    """One exchange feeds both the window and the join; the other sides are one row per segment."""
    from pyspark.sql import functions as F
    from httplens.operators.ordered import previous_value
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        seen = stored.select("id", "host", F.unix_micros("timestamp").alias("at"))
        text = plan(previous_value(seen, ["host"], ["at", "id"], "at", "before"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    rows_side = text.split("Exchange hashpartitioning")[1]
    assert "SortMergeJoin" in text and "FileScan" in rows_side and "Window" not in rows_side.split("FileScan")[0]


def test_interesting_paths_are_searched_before_the_shuffle(seed_a):
    plan = rollups.interesting_path_panel(seed_a)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("Filter")


def test_null_groups_have_a_digest(spark, seed_a):
    traffic = seed_a.selectExpr("* EXCEPT (host)", "nullif(host, 'cdn.test') AS host")
    found = {r.host: r.digest for r in digest(traffic, ["host"]).collect()}
    assert None in found and all(found.values())


def test_detail_by_an_id_column_of_any_case(spark, seed_a):
    ids = seed_a.where("status_code = 403").selectExpr("id AS ID")
    assert [r.id for r in message_detail(seed_a, ids).collect()] == [3]
