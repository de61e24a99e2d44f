"""Files written and read back, free SQL."""

import glob

import pytest
from pyspark.errors import AnalysisException, ParseException

from httplens.plans.adhoc import clean, execute, run_sql
from httplens.sources.export import export, read_csv, read_json, write_csv, write_json

AWKWARD = [(1, "", None), (2, None, ""), (3, 'a"b', "x,y"), (4, "l1\nl2", "\\"), (5, '"q"', 'a\\"b'),
           (6, " lead ", "\r\n"), (7, "\r", "a\rb"), (8, None, None), (9, "é😀", "\t"),
           (10, "\uffff", "null")]
SCHEMA = "id int, a string, b string"


def same(left, right):
    return sorted(map(str, left.collect())) == sorted(map(str, right.collect()))


def test_csv_round_trip(spark, tmp_path):
    df, path = spark.createDataFrame(AWKWARD, SCHEMA), str(tmp_path / "csv")
    write_csv(df, path)
    assert same(df, read_csv(spark, path, SCHEMA))
    text = "".join(open(f, newline="").read() for f in glob.glob(path + "/*.csv"))
    assert text.startswith("id,a,b\n") and '"a""b","x,y"' in text


def test_json_round_trip(spark, tmp_path):
    df, path = spark.createDataFrame(AWKWARD, SCHEMA), str(tmp_path / "json")
    write_json(df, path)
    assert same(df, read_json(spark, path, SCHEMA))
    assert same(df.select("a", "b", "id"), read_json(spark, path).select("a", "b", "id"))
    assert '"b":null' in "".join(open(f).read() for f in glob.glob(path + "/*.json"))


@pytest.mark.parametrize("write,read", [(write_csv, read_csv), (write_json, read_json)])
def test_times_to_the_microsecond(spark, tmp_path, write, read):
    df = spark.sql("SELECT 1 AS n, timestamp'2024-05-01 12:00:00.123456' AS t UNION ALL "
                   "SELECT 2, timestamp'1969-12-31 23:59:59.000001' UNION ALL SELECT 3, NULL")
    write(df, str(tmp_path / "t"))
    assert same(df, read(spark, str(tmp_path / "t"), df.schema))


def test_no_row_of_a_single_column_is_lost(spark, tmp_path):
    texts = spark.createDataFrame([("a",), (None,), ("",)], "t string")
    write_csv(texts, str(tmp_path / "s"))
    assert sorted(r[0] for r in read_csv(spark, str(tmp_path / "s"), "t string").collect()) == ["", "", "a"]
    times = spark.sql("SELECT timestamp'2024-05-01 12:00:00.5' AS t UNION ALL SELECT NULL")
    write_csv(times, str(tmp_path / "t"))
    assert same(times, read_csv(spark, str(tmp_path / "t"), times.schema))


def test_json_array_file(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"name": "x", "n": 1},\n {"name": "y", "n": null}]')
    assert read_json(spark, str(tmp_path / "a.json"), multi_line=True).count() == 2


@pytest.mark.parametrize("fmt,suffix", [("CSV", "csv"), ("json", "json"), ("Parquet", "parquet"), ("xls", "csv")])
def test_export_of_a_query(spark, seed_a, tmp_path, fmt, suffix):
    path = str(tmp_path / "out")
    export("SELECT host, count(*) AS n FROM traffic GROUP BY host ; \n", fmt, path, traffic=seed_a)
    assert glob.glob(f"{path}/*.{suffix}")


def test_export_needs_a_query(seed_a, tmp_path):
    with pytest.raises(ValueError):
        export("  ", "csv", str(tmp_path / "o"), traffic=seed_a)
    with pytest.raises(ValueError):
        export("SELECT 1", "csv", str(tmp_path / "o"))


def test_free_sql(spark, seed_a):
    assert clean("  SELECT 1 ;  \n") == "SELECT 1"
    assert run_sql(seed_a, "   ") is None
    assert run_sql(seed_a, "SELECT count(*) FROM traffic;").first()[0] == 10
    empty = run_sql(seed_a, "WITH x AS (SELECT * FROM traffic) SELECT id, host FROM x WHERE id < 0")
    assert empty.columns == ["id", "host"] and empty.count() == 0


def test_result_keeps_to_its_traffic(seed_a):
    first = run_sql(seed_a, "SELECT id FROM traffic")
    run_sql(seed_a.where("id = 1"), "SELECT id FROM traffic")
    assert first.count() == 10


def test_bad_sql_is_raised(seed_a):
    with pytest.raises(ParseException):
        run_sql(seed_a, "SELEC nothing")
    with pytest.raises(AnalysisException):
        run_sql(seed_a, "SELECT nothing FROM traffic")


def test_statement(spark, seed_a):
    run_sql(seed_a, "SELECT 1")
    execute(spark, "CREATE OR REPLACE TEMPORARY VIEW denied AS SELECT * FROM traffic WHERE status_code = 403;")
    assert spark.table("denied").count() == 1


@pytest.mark.parametrize("fmt", ["csv", "json"])
def test_nothing_to_export(spark, seed_a, tmp_path, fmt):
    path = str(tmp_path / "none")
    export("SELECT id, host FROM traffic WHERE id < 0", fmt, path, traffic=seed_a)
    read = {"csv": read_csv, "json": read_json}[fmt]
    assert read(spark, path, "id long, host string").count() == 0
