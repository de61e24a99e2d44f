"""Queries that open only the files that can hold their rows."""

import pytest
from pyspark.sql import functions as F

from httplens.plans import catalogue, rollups
from httplens.sources import clustered, fixture

SF_DIR = "/root/testdata/sf0.001"
FILES = 32


@pytest.fixture(scope="module")
def traffic(spark):
    return fixture.traffic(spark, SF_DIR).cache()


@pytest.fixture(scope="module")
def path(spark, traffic, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("clustered") / "table")
    clustered.write_clustered(traffic, path, files=FILES)
    return path


@pytest.fixture
def opened(monkeypatch):
    """The files that were asked for."""
    names, read = [], clustered._files
    monkeypatch.setattr(clustered, "_files", lambda spark, some: names.extend(some) or read(spark, some))
    return names


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_the_directory_knows_every_file(spark, traffic, path):
    about = clustered.directory(spark, path)
    n, first, last, most = about.agg(F.sum("rows"), F.min("low"), F.max("high"), F.max("resp_length")).head()
    assert (n, first, last, most) == tuple(traffic.agg(F.count("*"), F.min("id"), F.max("id"), F.max("resp_length")).head())
    assert about.count() > FILES // 2


def test_few_ids_open_few_files(spark, traffic, path, opened):
    ids = [r.id for r in traffic.select("id").orderBy("id").limit(3).collect()]
    found = clustered.messages(spark, path, [*ids, None, -5])
    assert sorted(r["id"] for r in found.collect()) == ids and 1 <= len(opened) <= len(ids)
    assert clustered.messages(spark, path, []).collect() == []


@pytest.mark.parametrize("rule", ["O4", "C1", "O7", "C3", "I4"])
def test_a_full_list_opens_no_further_file(spark, traffic, path, opened, rule):
    for limit in (1, 5, 100_000):
        opened.clear()
        assert rows(clustered.first_findings(spark, path, rule, limit)) == rows(catalogue.run(traffic, rule, limit=limit))
        assert len(opened) == len(set(opened))
        if limit == 1:
            assert len(opened) < FILES // 2
    assert len(opened) == clustered.directory(spark, path).count()


def test_other_orders_are_refused(spark, path):
    with pytest.raises(ValueError, match="order of ids"):
        clustered.first_findings(spark, path, "O2")
    with pytest.raises(ValueError, match="limited"):
        clustered.first_findings(spark, path, "A1")


@pytest.mark.parametrize("analysis", list(clustered.RANKINGS))
def test_files_of_small_rows_are_not_opened(spark, traffic, path, opened, analysis):
    assert rows(clustered.largest_findings(spark, path, analysis)) == rows(catalogue.run(traffic, analysis))
    assert len(opened) == len(set(opened))
    clustered.largest_findings(spark, path, analysis, limit=0)
    opened.clear()
    assert rows(clustered.largest_findings(spark, path, analysis, limit=1)) == rows(catalogue.run(traffic, analysis, limit=1))
    assert len(opened) < FILES


def test_lengths_are_not_read_from_bodies(spark, path):
    plan = clustered.load_clustered(spark, path).where("req_length > 0").select("id", "req_length")
    assert "req_body" not in plan._jdf.queryExecution().executedPlan().toString()


def test_equal_lengths_go_by_id(spark, traffic, tmp_path):
    same = traffic.withColumn("resp_length", F.lit(7))
    clustered.write_clustered(same, str(tmp_path / "t"), files=8)
    assert rows(clustered.largest_findings(spark, str(tmp_path / "t"), "E3")) == rows(catalogue.run(same, "E3"))


def test_only_refused_paths_are_shuffled(spark, traffic):
    """What passes the sieve: all refused paths, and few of the others."""
    own = traffic.select("path", "status_code")
    denied = own.where("status_code IN (401, 403)")
    passed = own.where("status_code = 200").where(rollups.Sieve(denied, "path").may_hold("path")).select("path").distinct()
    refused = {r.path for r in denied.select("path").distinct().collect()}
    answered = {r.path for r in own.where("status_code = 200").select("path").distinct().collect()}
    through = {r.path for r in passed.collect()}
    assert answered & refused <= through and len(through - refused) <= 0.05 * len(answered)
    for run in (rollups.mixed_auth_paths, rollups.broken_access_paths):
        assert rows(run(traffic, sieved=True)) == rows(run(traffic))
        plan = run(traffic, sieved=True)._jdf.queryExecution().executedPlan().toString()
        assert plan.index("Exchange hashpartitioning(path") < plan.index("may_hold" if "may_hold" in plan else "Subquery")


def test_a_sieve_of_nothing_lets_nothing_through(spark):
    some = spark.createDataFrame([("a",), (None,)], "path string")
    assert some.where(rollups.Sieve(some.limit(0), "path").may_hold("path")).count() == 0
    assert some.where(rollups.Sieve(some, "path").may_hold("path")).count() == 2
