"""Grouped analyses.

Each function takes the traffic and returns a lazy frame. Counts are combined before
the shuffle; exact distinct counts shuffle on group *and* counted value first, so one
very busy host does not end up in one task. ``exact=False`` trades the distinct
count for a sketch where that is enough.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from httplens import patterns as P
from httplens.functions.match import any_of
from httplens.functions.sieve import Sieve
from httplens.functions.strings import first_number_to_id
from httplens.functions.traffic_text import with_texts
from httplens.plans.rules import order_by


def _finish(df: DataFrame, order: tuple[str, ...], limit: int | None) -> DataFrame:
    df = df.orderBy(*[order_by(key) for key in order])
    return df if limit is None else df.limit(limit)


def _distinct(column: str, exact: bool) -> Column:
    return F.count_distinct(column) if exact else F.approx_count_distinct(column)


def _denied() -> Column:
    return F.col("status_code").isin(*P.DENIED_STATUSES)


def _not_safe(traffic: DataFrame) -> DataFrame:
    return traffic.where(~F.col("method").isin(*P.SAFE_METHODS))


def hosts(traffic: DataFrame, limit=None, exact=True) -> DataFrame:
    df = traffic.groupBy("host", "protocol").agg(
        F.count("*").alias("requests"), _distinct("path", exact).alias("unique_paths"))
    return _finish(df, ("-requests", "host", "protocol"), limit)


def url_inventory(traffic: DataFrame, limit=None) -> DataFrame:
    url = F.concat(F.col("protocol"), F.lit("://"), F.col("host"), F.col("path"))
    return _finish(traffic.select(url.alias("url"), "method").distinct(), ("url", "method"), limit)


def methods(traffic: DataFrame, limit=None) -> DataFrame:
    df = traffic.groupBy("method").agg(F.count("*").alias("count"))
    return _finish(df, ("-count", "method"), limit)


def statuses(traffic: DataFrame, limit=None) -> DataFrame:
    df = traffic.groupBy("status_code").agg(F.count("*").alias("count"))
    return _finish(df, ("status_code",), limit)


def timeline(traffic: DataFrame, limit: int | None = 60) -> DataFrame:
    """Requests per minute, newest first."""
    return _finish(timeline_counts(traffic), ("-minute",), limit)


def timeline_counts(traffic: DataFrame) -> DataFrame:
    """Groups by the minute itself; the label is made per group."""
    minutes = traffic.groupBy(F.date_trunc("minute", "timestamp").alias("m")).agg(
        F.count("*").alias("requests"))
    return minutes.select(F.date_format("m", "yyyy-MM-dd HH:mm").alias("minute"), "requests")


def _mixed(traffic: DataFrame, ok: str, denied: str, limit, sieved: bool) -> DataFrame:
    answered = F.col("status_code") == 200
    if sieved:
        answered = answered & Sieve(traffic.where(_denied()), "path").may_hold("path")
    df = (
        traffic.where(answered | _denied())
        .groupBy("path")
        .agg(F.count(F.when(F.col("status_code") == 200, 1)).alias(ok), F.count(F.when(_denied(), 1)).alias(denied))
        .where((F.col(ok) > 0) & (F.col(denied) > 0))
    )
    return _finish(df, (f"-{denied}", "path"), limit)


def mixed_auth_paths(traffic: DataFrame, limit=None, sieved: bool = False) -> DataFrame:
    """Paths that both answered 200 and refused; other statuses cannot matter and are cut at the scan.

    ``sieved`` reads the refusals first and keeps their paths as a Bloom filter of fixed size, so that of the many 200s only those on
    refused paths are counted and shuffled. It pays where the table is too large for a second, narrow scan to matter.
    """
    return _mixed(traffic, "ok_hits", "auth_fail_hits", limit, sieved)


def broken_access_paths(traffic: DataFrame, limit=None, sieved: bool = False) -> DataFrame:
    return _mixed(traffic, "ok_200", "denied", limit, sieved)


def non_get_endpoints(traffic: DataFrame, limit=None) -> DataFrame:
    df = _not_safe(traffic).groupBy("method", "host", "path").agg(F.count("*").alias("requests"))
    return _finish(df, ("method", "-requests", "host", "path"), limit)


def query_endpoints(traffic: DataFrame, limit=None) -> DataFrame:
    part = lambda n: F.split_part(F.col("path"), F.lit("?"), F.lit(n))
    df = traffic.where(F.col("path").contains("?")).select(
        "host", part(1).alias("base_path"), part(2).alias("query_string")).distinct()
    return _finish(df, ("host", "base_path", "query_string"), limit)


def not_found_paths(traffic: DataFrame, limit=None) -> DataFrame:
    df = traffic.where("status_code = 404").groupBy("path").agg(F.count("*").alias("hits"))
    return _finish(df, ("-hits", "path"), limit)


def auth_hotspots(traffic: DataFrame, limit=None, at_least: int = 3) -> DataFrame:
    df = (
        traffic.where(_denied()).groupBy("host", "path").agg(F.count("*").alias("failures"))
        .where(F.col("failures") >= at_least)
    )
    return _finish(df, ("-failures", "host", "path"), limit)


def numeric_id_patterns(traffic: DataFrame, limit: int | None = 30, exact=True) -> DataFrame:
    df = (
        traffic.where(F.col("path").rlike(P.NUMERIC_SEGMENT))
        .groupBy("host", "method", first_number_to_id(F.col("path")).alias("path_pattern"))
        .agg(_distinct("path", exact).alias("id_variations"))
    )
    return _finish(df, ("-id_variations", "path_pattern", "host", "method"), limit)


# --- dashboard panels --------------------------------------------------------


# Each panel also works on counted traffic, where ``weight`` is the column that says for how many requests a row stands.


def _requests(weight: str | None) -> Column:
    return F.count("*") if weight is None else F.coalesce(F.sum(weight), F.lit(0).cast("long"))


def overview(traffic: DataFrame, exact=True, weight: str | None = None) -> DataFrame:
    return traffic.agg(
        _requests(weight).alias("total_requests"), _distinct("host", exact).alias("unique_hosts"))


def auth_failure_panel(traffic: DataFrame, limit: int | None = 15, exact=True, weight: str | None = None) -> DataFrame:
    df = traffic.where(_denied()).groupBy("path").agg(
        _requests(weight).alias("hits"), _distinct("host", exact).alias("hosts"))
    return _finish(df, ("-hits", "path"), limit)


def server_error_panel(traffic: DataFrame, limit: int | None = 15, weight: str | None = None) -> DataFrame:
    df = traffic.where("status_code >= 500").groupBy("host", "path", "status_code").agg(
        _requests(weight).alias("hits"))
    return _finish(df, ("-hits", "host", "path", "status_code"), limit)


def attack_surface_panel(traffic: DataFrame, limit: int | None = 20, exact=True, weight: str | None = None) -> DataFrame:
    df = _not_safe(traffic).groupBy("method", "host", "path").agg(
        _requests(weight).alias("requests"), _distinct("status_code", exact).alias("response_variants"))
    return _finish(df, ("-requests", "method", "host", "path"), limit)


def largest_response_panel(traffic: DataFrame, limit: int | None = 10) -> DataFrame:
    shown = ("host", "method", "path", "status_code", "resp_length")
    return _finish(traffic.select("id", *shown), ("-resp_length", "id"), limit).select(*shown)


def interesting_path_panel(traffic: DataFrame, limit: int | None = 20, weight: str | None = None) -> DataFrame:
    """Searches before it counts: paths are nearly unique, and only those found are shuffled."""
    keys = ("host", "method", "path", "status_code")
    shown = keys if weight is None else (*keys, weight)
    found = with_texts(traffic.select(*shown), ("_path",)).where(any_of(F.col("_path"), P.INTERESTING_PATHS))
    return _finish(found.groupBy(*keys).agg(_requests(weight).alias("hits")), ("-hits", "path", "host", "method", "status_code"), limit)


def hosts_panel(traffic: DataFrame, limit=None, exact=True, weight: str | None = None) -> DataFrame:
    one = F.lit(1) if weight is None else F.col(weight)
    df = traffic.groupBy("host", "protocol").agg(
        _requests(weight).alias("requests"),
        _distinct("path", exact).alias("unique_paths"),
        F.sum(F.when(F.col("status_code") >= 400, one).otherwise(0)).alias("errors"))
    return _finish(df, ("-requests", "host", "protocol"), limit)


PANELS = {
    "overview": overview,
    "auth_failures": auth_failure_panel,
    "server_errors": server_error_panel,
    "attack_surface": attack_surface_panel,
    "largest_responses": largest_response_panel,
    "interesting_paths": interesting_path_panel,
    "hosts": hosts_panel,
}
