"""Chat replies: SQL blocks in Markdown, and response JSON in its several shapes."""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from httplens import patterns as P
from httplens.functions import variants as V
from httplens.functions.strings import not_blank, preview, strip


def _or(conditions) -> Column:
    return functools.reduce(operator.or_, conditions)


def _upper_contains(upper: Column, words: Sequence[str]) -> Column:
    return _or([upper.contains(word) for word in words])


def looks_like_sql(text: Column) -> Column:
    """A statement keyword at the start, or FROM as a word of its own."""
    upper = F.upper(text)
    return _or([upper.startswith(w) for w in P.SQL_STARTS]) | _upper_contains(upper, P.SQL_MARKERS)


def classify(text: Column, rules=P.CATEGORY_WORDS, default: str = P.DEFAULT_CATEGORY) -> Column:
    """The first category one of whose words occurs in the upper-cased text."""
    upper = F.upper(text)
    (name, words), *rest = rules
    found = F.when(_upper_contains(upper, words), name)
    for name, words in rest:
        found = found.when(_upper_contains(upper, words), name)
    return found.otherwise(default)


def extract_sql_blocks(df: DataFrame, text_col: str) -> DataFrame:
    """One row per fenced SQL block, with ``block_no`` counting the SQL blocks of a reply from 0."""
    keep = [c for c in df.columns if c != text_col]
    blocks = F.regexp_extract_all(F.col(text_col), F.lit(P.SQL_BLOCK), F.lit(1))
    sql = F.filter(F.transform(blocks, strip), lambda b: not_blank(b) & looks_like_sql(b))
    # The word search keeps the regular expression away from replies without any fence.
    fenced = df.where(F.col(text_col).contains("```"))
    return fenced.select(*keep, F.posexplode(sql).alias("block_no", "sql_text"))


def suggest(df: DataFrame, text_col: str) -> DataFrame:
    """The SQL blocks with a suggested category and a one-line preview."""
    return extract_sql_blocks(df, text_col).withColumns({
        "category": classify(F.col("sql_text")),
        "preview": preview(F.col("sql_text")),
    })


def normalize_chat_response(df: DataFrame, json_col: str) -> DataFrame:
    """Adds ``content`` and ``error``; exactly one of them is set in each row."""
    json = F.coalesce(F.col(json_col), F.lit(""))
    parsed = df.withColumn("_root", F.try_parse_json(F.col(json_col)))
    root = F.col("_root")
    content = F.when(~V.has_error(root), V.reply_content(root))
    described = parsed.withColumn("content", content)
    error = F.when(
        V.has_error(root),
        F.concat(F.lit(P.API_ERROR), F.coalesce(V.error_message(root), json)),
    ).when(F.col("content").isNull(), F.concat(F.lit(P.NO_CONTENT), json))
    return described.withColumn("error", error).drop("_root")


def http_error(df: DataFrame, status_col: str, body_col: str) -> DataFrame:
    """Adds ``error``: the status and whatever message the response body carries."""
    root = F.try_parse_json(F.col(body_col))
    body = F.when(not_blank(F.col(body_col)), F.col(body_col)).otherwise(P.EMPTY_BODY)
    message = F.coalesce(V.error_message(root, whole_error=True), body)
    return df.withColumn(
        "error", F.concat(F.lit("HTTP "), F.col(status_col).cast("string"), F.lit(": "), message))
