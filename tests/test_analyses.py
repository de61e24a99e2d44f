"""Every analysis on the two ten-row seeds, with the results known by hand."""

import pytest

from httplens.plans.catalogue import CATALOGUE, categories, run


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("analysis_id", sorted(CATALOGUE))
def test_runs_on_rows_and_on_none(seed_a, analysis_id):
    run(seed_a, analysis_id).collect()
    empty = run(seed_a.where("false"), analysis_id)
    assert empty.columns == run(seed_a, analysis_id).columns
    empty.collect()


def test_catalogue_is_complete():
    assert sum(len(v) for k, v in categories().items()
               if k in ("Recon", "Authentication", "Input Surface", "Errors & Leakage",
                        "OWASP Top 10", "CWE Web", "Security")) == 36 + 3
    assert len(categories()["Dashboard"]) == 7


def test_auth_failures_newest_first(seed_a):
    assert rows(run(seed_a, "A1")) == [(3, "shop.test", "GET", "/staff", 403)]


def test_mixed_auth(seed_a):
    assert rows(run(seed_a, "A2")) == [("/staff", 1, 1)]
    assert run(seed_a, "O1").columns == ["path", "ok_200", "denied"]


def test_non_get(seed_a):
    assert {r[0] for r in rows(run(seed_a, "I1"))} == {"POST", "PATCH", "PROPFIND", "DELETE"}


def test_largest_first(seed_a):
    lengths = [r["resp_length"] for r in run(seed_a, "E3").collect()]
    assert lengths == sorted(lengths, reverse=True) and lengths[0] == 40_000


def test_numeric_ids(seed_a):
    found = {(r["host"], r["path_pattern"], r["id_variations"]) for r in run(seed_a, "S2").collect()}
    assert found == {("pay.test", "/invoices/{id}", 1), ("cdn.test", "/files/{id}", 1)}


def test_first_number_only(spark, seed_a):
    from pyspark.sql import functions as F
    df = seed_a.limit(1).withColumn("path", F.lit("/v1/users/42"))
    assert run(df, "S2").first()["path_pattern"] == "/v{id}/users/42"


def test_header_rules(seed_a):
    assert [r["id"] for r in run(seed_a, "A4").collect()] == [9]
    assert [r["id"] for r in run(seed_a, "I4").collect()] == [2]
    assert [r["id"] for r in run(seed_a, "C4").collect()] == [9, 5, 2]


def test_limits_can_be_lifted(seed_a):
    assert run(seed_a, "E3", limit=2).count() == 2
    assert run(seed_a, "E3", limit=None, ordered=False).count() == 10


def test_null_cells(spark, seed_a):
    from pyspark.sql import functions as F
    gone = seed_a.withColumns({c: F.lit(None).cast("string") for c in ("path", "req_headers", "req_body")})
    for analysis_id in ("A3", "A4", "C1", "C4", "O4", "S1", "S3", "S5", "X1"):
        assert run(gone, analysis_id).count() == 0
    assert {r["hits"] for r in run(gone, "F2").where("rule IN ('A3', 'A4', 'C4', 'S1')").collect()} == {0}
    assert all("A3" not in r["findings"] for r in run(gone, "F1").collect())


def test_traversal_quirk(seed_a):
    from pyspark.sql import functions as F
    path = lambda p: seed_a.limit(1).withColumn("path", F.lit(p))
    assert run(path("/x/2E2E/y"), "C3").count() == 1
    assert run(path("/x/%2e%2e/y"), "C3").count() == 0
    assert run(path("/x/..%5Cy"), "C3").count() == 1


def test_panels(seed_b):
    assert rows(run(seed_b, "D1")) == [(10, 3)]
    assert rows(run(seed_b, "D2")) == [("/config", 2, 1), ("/ledger", 1, 1)]
    assert rows(run(seed_b, "D3")) == [("pay.test", "/report", 503, 1)]
    assert {r["method"] for r in run(seed_b, "D4").collect()} == {"POST", "PUT"}
    assert run(seed_b, "D5").first()["resp_length"] == 800_000
    paths = {r["path"] for r in run(seed_b, "D6").collect()}
    assert paths == {"/config", "/backup.tar"}
    hosts = {r["host"]: r for r in run(seed_b, "D7").collect()}
    assert len(hosts) == 3 and hosts["pay.test"]["errors"] == 2


def test_overview_of_nothing(seed_b):
    assert rows(run(seed_b.where("false"), "D1")) == [(0, 0)]


def test_approximate_counts(seed_b):
    for analysis_id in ("R1", "D1", "D2", "D4", "D7", "M1", "S2"):
        assert rows(run(seed_b, analysis_id, exact=False)) == rows(run(seed_b, analysis_id))


def test_digest(seed_b):
    text = run(seed_b, "M6").first()[0]
    lines = text.split("\n")
    assert lines[0] == "10 reqs | 3 hosts | 3 methods | 3 auth_fails | 1 server_errs"
    assert lines[1] == "hosts: shop.test(6) pay.test(3) cdn.test(1)"
    assert lines[2] == "status: 200(4) 403(2) 201(1) 304(1) 401(1) 503(1)"
    assert lines[3] == "methods: GET(8) POST(1) PUT(1)"
    assert lines[4].startswith("recent: GET /a.js→200, GET /backup.tar→200, ")
    assert lines[5:] == [""]


def test_digest_of_nothing(seed_b):
    assert run(seed_b.where("false"), "M6").first()[0] == "No traffic captured yet."


def test_digest_per_group(seed_b):
    found = {r["protocol"]: r["digest"] for r in run(seed_b, "M6", by=["protocol"]).collect()}
    for protocol, text in found.items():
        assert text == run(seed_b.where(f"protocol = '{protocol}'"), "M6").first()[0]


def test_findings_agree_with_single_rules(seed_a):
    from httplens.operators.findings import TAGGED_RULES
    tagged = {r["id"]: set(r["findings"]) for r in run(seed_a, "F1").collect()}
    counts = {r["rule"]: r["hits"] for r in run(seed_a, "F2").collect()}
    for rule in TAGGED_RULES:
        ids = {r["id"] for r in rule.matches(seed_a).select("id").collect()}
        assert ids == {i for i, tags in tagged.items() if rule.id in tags}
        assert counts[rule.id] == len(ids)


def test_counts_per_host(seed_a):
    found = run(seed_a, "F2", by=["host"]).where("rule = 'A1' AND hits > 0").collect()
    assert [(r["host"], r["hits"]) for r in found] == [("shop.test", 1)]
