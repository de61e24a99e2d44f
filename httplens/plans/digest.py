"""Summary counters, compact tops and the text digest made of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from httplens import patterns as P
from httplens.plans.rules import order_by


def _cube(traffic: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Requests per host, method and status: far fewer rows than the traffic, and all the
    counters and tops below can be taken from it. The exchange is shared within one plan."""
    return traffic.groupBy(*by, "host", "method", "status_code").agg(F.count("*").alias("n"))


def _sum_if(condition: Column) -> Column:
    return F.sum(F.when(condition, F.col("n")).otherwise(0))


def _counters(cube: DataFrame, by: Sequence[str] = (), exact: bool = True) -> DataFrame:
    distinct = F.count_distinct if exact else F.approx_count_distinct
    return cube.groupBy(*by).agg(
        F.sum("n").alias("n"),
        distinct("host").alias("hosts"),
        distinct("method").alias("methods"),
        _sum_if(F.col("status_code").isin(*P.DENIED_STATUSES)).alias("auth_fails"),
        _sum_if(F.col("status_code") >= 500).alias("server_errs"),
    ).withColumn("total", F.coalesce("n", F.lit(0))).drop("n")


def counters(traffic: DataFrame, exact: bool = True) -> DataFrame:
    """Totals in one row. The two distinct counts expand the small cube, not the traffic."""
    return _counters(_cube(traffic), exact=exact).select("total", "hosts", "methods", "auth_fails", "server_errs")


def _first(df: DataFrame, order: Sequence[str], n: int | None, by: Sequence[str]) -> DataFrame:
    """The first ``n`` rows, of each ``by`` group if there are any."""
    keys = [order_by(key) for key in order]
    if n is None:
        return df
    if not by:
        return df.orderBy(*keys).limit(n)
    # Spark cuts each task's rows to n per group before the shuffle.
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*keys))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def _label() -> Column:
    return F.concat(F.col("label").cast("string"), F.lit("("), F.col("n").cast("string"), F.lit(")"))


def _tops(cube: DataFrame, column: str, n: int | None, by: Sequence[str] = ()) -> DataFrame:
    counted = cube.groupBy(*by, F.col(column).alias("label")).agg(F.sum("n").alias("n"))
    return _first(counted, ("-n", "label"), n, by)


def _compact(traffic: DataFrame, column: str, limit: int | None) -> DataFrame:
    df = traffic.groupBy(F.col(column).alias("label")).agg(F.count("*").alias("n"))
    df = df.orderBy(order_by("-n"), order_by("label"))
    df = df if limit is None else df.limit(limit)
    return df.select(_label().alias("v"))


def top_hosts(traffic: DataFrame, limit: int | None = 5) -> DataFrame:
    return _compact(traffic, "host", limit)


def top_statuses(traffic: DataFrame, limit: int | None = 8) -> DataFrame:
    return _compact(traffic, "status_code", limit)


def method_counts(traffic: DataFrame, limit: int | None = None) -> DataFrame:
    return _compact(traffic, "method", limit)


def recent(traffic: DataFrame, limit: int | None = 10) -> DataFrame:
    df = traffic.select("id", "method", "path", "status_code").orderBy(order_by("-id"))
    return (df if limit is None else df.limit(limit)).select("method", "path", "status_code")


def _line(rows: DataFrame, order: Sequence[Column], text: Column, separator: str, by: Sequence[str]) -> DataFrame:
    """The rows of each group as one text; only the few first rows per group get here."""
    items = F.array_sort(F.collect_list(
        F.struct(*[key.alias(f"k{i}") for i, key in enumerate(order)],
                 F.coalesce(text, F.lit("null")).alias("t"))))
    return rows.groupBy(*by).agg(
        F.array_join(F.transform(items, lambda i: i["t"]), separator).alias("line"))


def digest(traffic: DataFrame, by: Sequence[str] = (), max_methods: int = 50) -> DataFrame:
    """A short text about the traffic: one row, or one per ``by`` group (say, per project).

    Every line is bounded: hosts, statuses and recent requests are cut to their first few, and of more than ``max_methods``
    different methods the rarest are only counted.
    """
    cube = _cube(traffic, by)
    request = F.concat(F.col("method"), F.lit(" "), F.col("path"), F.lit("→"), F.col("status_code").cast("string"))
    newest = _first(traffic.select(*by, "id", "method", "path", "status_code"), ("-id",), 10, by)
    most = (-F.col("n"), F.col("label").isNull(), F.col("label"))
    top = lambda column, n: _line(_tops(cube, column, n, by), most, _label(), " ", by)
    lines = {
        "hosts": top("host", 5),
        "status": top("status_code", 8),
        "methods": top("method", max_methods),
        "recent": _line(newest, (-F.col("id"),), request, ", ", by),
    }
    df = _counters(cube, by)
    left = F.col("methods") - max_methods
    more = {"methods": F.when(left > 0, F.concat(F.lit(" and "), left.cast("string"), F.lit(" more"))).otherwise("")}
    for name, line in lines.items():
        column = f"_{name}"
        if by:
            # A null group is a group as well.
            own = line.select(*[F.col(c).alias(f"{column}_{c}") for c in by], F.col("line").alias(column))
            same = [F.col(c).eqNullSafe(F.col(f"{column}_{c}")) for c in by]
            df = df.join(own, same, "left")
        else:
            df = df.withColumn(column, line.scalar())
    number = lambda name: F.col(name).cast("string")
    text = F.concat(
        number("total"), F.lit(" reqs | "), number("hosts"), F.lit(" hosts | "),
        number("methods"), F.lit(" methods | "), number("auth_fails"), F.lit(" auth_fails | "),
        number("server_errs"), F.lit(" server_errs\n"),
        *[F.concat(F.lit(f"{name}: "), F.col(f"_{name}"), more.get(name, F.lit("")), F.lit("\n")) for name in lines])
    return df.select(*by, F.when(F.col("total") == 0, P.EMPTY_DIGEST).otherwise(text).alias("digest"))
