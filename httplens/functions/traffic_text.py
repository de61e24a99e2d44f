"""The lower-cased texts that the analyses search, computed once per row."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, functions as F


def _body():
    return F.coalesce(F.col("req_body"), F.lit(""))


# Name -> expression. The order of path and body and the separator matter: a pattern may span them.
TEXTS = {
    "_path": lambda: F.lower("path"),
    "_headers": lambda: F.lower("req_headers"),
    "_path_and_body": lambda: F.lower(F.concat(F.col("path"), _body())),
    "_path_then_body": lambda: F.lower(F.concat(F.col("path"), F.lit(" "), _body())),
    "_path_then_body_cased": lambda: F.concat(F.col("path"), F.lit(" "), _body()),
    "_body_then_path": lambda: F.lower(F.concat(_body(), F.lit(" "), F.col("path"))),
}


def bind(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Add columns that stay columns.

    A plain projection may be merged with its neighbours: a search over ``lower(path)``
    then spells out ``lower(path)`` again for each word, and long lists of predicates end
    up in one method too long for the JVM to compile. ``inline`` of a one-row
    array is a step of its own.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def with_texts(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Add the named texts, each worked out once per row."""
    columns = {name: TEXTS[name]() for name in names}
    return bind(df, columns) if columns else df
