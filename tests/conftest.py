import datetime as dt
import sys
from pathlib import Path

import pytest
from pyspark import SparkConf, SparkContext

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from httplens.operators.ingest import normalize  # noqa: E402
from httplens.schema import RAW_EXCHANGE  # noqa: E402
from httplens.session import build_session  # noqa: E402

START = dt.datetime(2024, 5, 1, 12, 0, 0)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    memory = {"spark.driver.memory": "4g"}
    SparkContext._ensure_initialized(conf=SparkConf(loadDefaults=False).setAll(memory.items()))
    shared = SparkConf().get("spark.checkpoint.dir") or str(tmp_path_factory.mktemp("shared"))
    session = build_session("local[8]", **memory, **{
        "spark.checkpoint.dir": shared,
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def exchange(id, host, port, secure, method, path, status, req_headers=(), req_body="", resp_body="", seconds=None):
    """One raw exchange; by default they are a second apart, in id order."""
    ts = START + dt.timedelta(seconds=id if seconds is None else seconds)
    return (id, ts, host, port, secure, method, path, status, list(req_headers), req_body, [], resp_body)


def raw_frame(spark, rows):
    return spark.createDataFrame(rows, RAW_EXCHANGE)


# Traffic with an odd method, a missing body, a body of several lines and texts beyond ASCII.
SEED_A = [
    exchange(1, "shop.test", 80, False, "GET", "/", 200, resp_body="welcome\nback"),
    exchange(2, "shop.test", 80, False, "POST", "/cart", 201,
             [("content-type", "application/json; charset=utf-8")], '{"sku":7}', "added"),
    exchange(3, "shop.test", 80, False, "GET", "/staff", 403),
    exchange(4, "shop.test", 80, False, "GET", "/staff", 200, resp_body="rota"),
    exchange(5, "pay.test", 8443, True, "PATCH", "/invoices/1907", 200, req_body="total=9"),
    exchange(6, "pay.test", 8443, True, "GET", "/report", 503, resp_body="später"),
    exchange(7, "pay.test", 8443, True, "GET", "/export", 200, resp_body="é" * 40_000),
    exchange(8, "pay.test", 8443, True, "PROPFIND", "/old", 301, req_body=None),
    exchange(9, "cdn.test", 80, False, "DELETE", "/files/31", 202, [("authorization", "Basic dTpw")]),
    exchange(10, "cdn.test", 80, False, "GET", "/find?term=straße", 200, resp_body="hits"),
]

# Traffic for the panels: repeated refusals at one time, an empty and a very long response.
SEED_B = [
    exchange(1, "shop.test", 80, False, "GET", "/", 200, resp_body="y" * 640),
    exchange(2, "shop.test", 80, False, "GET", "/logo.svg", 304),
    exchange(3, "shop.test", 80, False, "GET", "/config", 403, resp_body="y" * 60, seconds=3),
    exchange(4, "shop.test", 80, False, "GET", "/config", 401, resp_body="y" * 61, seconds=3),
    exchange(5, "shop.test", 80, False, "POST", "/cart", 201, resp_body="y" * 310),
    exchange(6, "shop.test", 80, False, "PUT", "/cart/88", 200),
    exchange(7, "pay.test", 8443, True, "GET", "/ledger", 403, resp_body="y" * 75),
    exchange(8, "pay.test", 8443, True, "GET", "/report", 503, resp_body="y" * 130),
    exchange(9, "pay.test", 8443, True, "GET", "/backup.tar", 200, resp_body="ß" * 800_000),
    exchange(10, "cdn.test", 80, False, "GET", "/a.js", 200, resp_body="y" * 210),
]


@pytest.fixture(scope="session")
def seed_a(spark):
    return normalize(raw_frame(spark, SEED_A)).cache()


@pytest.fixture(scope="session")
def seed_b(spark):
    return normalize(raw_frame(spark, SEED_B)).cache()
