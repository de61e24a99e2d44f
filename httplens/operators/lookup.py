"""Request and response text of single messages."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from httplens.functions.strings import message_text
from httplens.operators.ingest import within


def message_detail(traffic: DataFrame, ids: DataFrame | Iterable[int]) -> DataFrame:
    """``id``, request text and response text for each known id.

    ``ids`` is a short list, pushed down to the scan, or any result with an ``id``
    column in any case: it is sent to the traffic as bitmaps, so that bodies are not shuffled.
    """
    if isinstance(ids, DataFrame):
        named = [c for c in ids.columns if c.lower() == "id"]
        if not named:
            raise ValueError("no message detail: the result has no 'id' column")
        wanted = within(traffic, ids.select(F.col(named[0]).alias("id")).where("id IS NOT NULL"))
    else:
        wanted = traffic.where(F.col("id").isin([i for i in ids if i is not None]))
    return wanted.select(
        "id",
        message_text(F.col("req_headers"), F.col("req_body")).alias("request"),
        message_text(F.col("resp_headers"), F.col("resp_body")).alias("response"))


def default_listing(traffic: DataFrame, limit: int | None = 100) -> DataFrame:
    """The newest messages."""
    df = traffic.select("id", "host", "method", "path", "status_code", "resp_length").orderBy(F.desc("id"))
    return df if limit is None else df.limit(limit)
