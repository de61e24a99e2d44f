"""Row-level analyses: a predicate, the columns to show, an order and a limit."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from httplens import patterns as P
from httplens.functions.match import any_of
from httplens.functions.traffic_text import with_texts
from httplens.schema import BASE

DEFAULT = object()

NEWEST = ("-id",)
BY_HOST_PATH = ("host", "path", "id")
WITH_BODY = ("id", "host", "method", "path", "req_body")


@dataclass(frozen=True)
class Rule:
    id: str
    category: str
    title: str
    where: Callable[[], Column] | None
    columns: tuple[str, ...] = BASE
    order: tuple[str, ...] = NEWEST
    limit: int | None = None
    texts: tuple[str, ...] = ()
    distinct: bool = False

    def matches(self, traffic: DataFrame) -> DataFrame:
        df = with_texts(traffic, self.texts)
        return df if self.where is None else df.where(self.where())

    def run(self, traffic: DataFrame, limit=DEFAULT, ordered: bool = True) -> DataFrame:
        """The findings; ``limit=None`` gives all of them, ``ordered=False`` saves the sort."""
        limit = self.limit if limit is DEFAULT else limit
        df = self.matches(traffic).select(*[_shown(c) for c in self.columns])
        if self.distinct:
            df = df.distinct()
        keys = [order_by(key) for key in self.order]
        if limit is not None:
            return df.orderBy(*keys).limit(limit)
        if not ordered:
            return df
        if self.where is not None and not self.distinct:
            # A full sort first samples its input. What that reads twice should be the
            # findings, shuffled once, and not the scan with its search.
            df = df.hint("rebalance")
        return df.orderBy(*keys)


def _shown(column: str) -> Column:
    if column == "body_length":
        return F.length("req_body").alias("body_length")
    return F.col(column)


def order_by(key: str) -> Column:
    """``"-id"`` is descending; missing values come last either way."""
    return F.col(key[1:]).desc_nulls_last() if key.startswith("-") else F.col(key).asc_nulls_last()


def _any(column: str, pattern: str) -> Callable[[], Column]:
    return lambda: any_of(F.col(column), pattern)


def _denied() -> Column:
    return F.col("status_code").isin(*P.DENIED_STATUSES)


def _ok_on(pattern: str) -> Callable[[], Column]:
    return lambda: (F.col("status_code") == 200) & any_of(F.col("_path"), pattern)


def _ok_unauthenticated_on(pattern: str) -> Callable[[], Column]:
    return lambda: _ok_on(pattern)() & ~any_of(F.col("_headers"), P.AUTHORIZATION_HEADER)


def _state_change_without_token() -> Column:
    return (F.col("method").isin(*P.STATE_CHANGING_METHODS)
            & ~any_of(F.col("_headers"), P.CSRF_HEADERS))


def _status_between(low: int, high: int) -> Callable[[], Column]:
    return lambda: (F.col("status_code") >= low) & (F.col("status_code") < high)


RULES: tuple[Rule, ...] = (
    Rule("A1", "Authentication", "Requests answered with 401 or 403", _denied),
    Rule("A3", "Authentication", "Login and session endpoints",
         _any("_path", P.LOGIN_PATHS), order=BY_HOST_PATH, texts=("_path",)),
    Rule("A4", "Authentication", "Requests that carry credentials in a header",
         _any("_headers", P.AUTH_HEADERS), columns=("id", "host", "path", "req_headers"),
         order=BY_HOST_PATH, limit=50, texts=("_headers",)),
    Rule("I3", "Input Surface", "Requests with a body",
         lambda: F.col("req_body").isNotNull() & (F.length("req_body") > 0),
         columns=(*BASE, "body_length"), order=("-body_length", "id"), limit=50),
    Rule("I4", "Input Surface", "JSON requests",
         _any("_headers", P.JSON_CONTENT), limit=50, texts=("_headers",)),
    Rule("E1", "Errors & Leakage", "Server errors", lambda: F.col("status_code") >= 500,
         columns=("id", "host", "path", "status_code")),
    Rule("E2", "Errors & Leakage", "Client errors", _status_between(400, 500),
         columns=("id", "host", "path", "status_code")),
    Rule("E3", "Errors & Leakage", "Largest responses", None,
         columns=(*BASE, "resp_length"), order=("-resp_length", "id"), limit=20),
    Rule("E5", "Errors & Leakage", "Error responses with a large body",
         lambda: (F.col("status_code") >= 400) & (F.col("resp_length") > 1000),
         columns=("id", "host", "path", "status_code", "resp_length"),
         order=("-resp_length", "id"), limit=20),
    Rule("O2", "OWASP Top 10", "A01: privileged paths that answered 200",
         _ok_on(P.PRIVILEGED_PATHS), order=BY_HOST_PATH, limit=50, texts=("_path",)),
    Rule("O3", "OWASP Top 10", "A02: sensitive words sent over plain HTTP",
         lambda: (F.col("protocol") == "http") & any_of(F.col("_path_and_body"), P.SENSITIVE_WORDS),
         limit=50, texts=("_path_and_body",)),
    Rule("O4", "OWASP Top 10", "A03: injection attempts",
         _any("_path_then_body", P.INJECTION), columns=WITH_BODY, order=("id",), limit=50,
         texts=("_path_then_body",)),
    Rule("O5", "OWASP Top 10", "A05: reachable debug and config endpoints",
         _ok_on(P.DEBUG_PATHS), order=BY_HOST_PATH, limit=50, texts=("_path",)),
    Rule("O7", "OWASP Top 10", "A10: internal addresses in requests",
         _any("_path_then_body_cased", P.INTERNAL_URLS), columns=WITH_BODY, order=("id",),
         limit=50, texts=("_path_then_body_cased",)),
    Rule("C1", "CWE Web", "CWE-79: script payloads",
         _any("_body_then_path", P.SCRIPT_PAYLOADS), columns=WITH_BODY, order=("id",), limit=50,
         texts=("_body_then_path",)),
    Rule("C2", "CWE Web", "CWE-89: SQL payloads",
         _any("_body_then_path", P.SQL_PAYLOADS), columns=WITH_BODY, order=("id",), limit=50,
         texts=("_body_then_path",)),
    Rule("C3", "CWE Web", "CWE-22: path traversal",
         lambda: (F.col("path").contains("../") | F.col("_path").contains("2e2e")
                  | any_of(F.col("_path"), P.ENCODED_TRAVERSAL)),
         limit=50, texts=("_path",)),
    Rule("C4", "CWE Web", "CWE-352: state changes without an anti-forgery header",
         _state_change_without_token, columns=("id", "host", "method", "path", "req_headers"),
         limit=50, texts=("_headers",)),
    Rule("C5", "CWE Web", "CWE-601: redirect parameters",
         _any("_path", P.REDIRECT_PARAMS), limit=50, texts=("_path",)),
    Rule("C6", "CWE Web", "CWE-918: server-side URL parameters",
         _any("_path_then_body", P.SSRF_PARAMS), columns=WITH_BODY, order=("id",), limit=50,
         texts=("_path_then_body",)),
    Rule("S1", "Security", "Paths worth a look",
         _any("_path", P.INTERESTING_PATHS), order=BY_HOST_PATH, texts=("_path",)),
    Rule("S3", "Security", "API endpoints",
         _any("_path", P.API_PATHS), order=("path", "id"), texts=("_path",)),
    Rule("S4", "Security", "Redirects", _status_between(300, 400)),
    Rule("S5", "Security", "Possible uploads",
         lambda: (any_of(F.col("_headers"), P.MULTIPART_CONTENT)
                  | any_of(F.col("_path"), P.UPLOAD_PATHS)),
         order=BY_HOST_PATH, texts=("_path", "_headers")),
    Rule("X1", "Security", "Privileged paths that answered 200 without authorization",
         _ok_unauthenticated_on(P.UNAUTHENTICATED_PATHS), order=BY_HOST_PATH,
         texts=("_path", "_headers")),
    Rule("X2", "Security", "Distinct endpoints that answered 200 without authorization",
         _ok_unauthenticated_on(P.UNAUTHENTICATED_API_PATHS),
         columns=("host", "path", "status_code"), order=("host", "path"),
         texts=("_path", "_headers"), distinct=True),
    Rule("X3", "Security", "State changes without an anti-forgery header, base columns",
         _state_change_without_token, limit=50, texts=("_headers",)),
)

BY_ID = {rule.id: rule for rule in RULES}
