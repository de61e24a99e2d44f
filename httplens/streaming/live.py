"""Live views over the traffic stream: timeline, alerts, findings and panels."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from httplens import patterns as P
from httplens.operators.findings import tag_findings
from httplens.operators.ingest import normalize
from httplens.plans import rollups
from httplens.plans.rollups import PANELS
from httplens.streaming.capture import capture, trigger
from httplens.streaming.views import View, absorb, counts, current, top

SKETCH_BITS = 12


TIMELINE = counts(["minute"], "minute string, requests long", "requests", rollups.timeline_counts)


def live_timeline(traffic: DataFrame, path: str, checkpoint: str, every: str | None = "30 seconds") -> StreamingQuery:
    """Requests per minute, kept at ``path`` and read with ``latest_timeline``: open minutes and late rows count."""
    return keep_views(traffic, {"timeline": TIMELINE}, path, checkpoint, every)


def latest_timeline(spark: SparkSession, path: str) -> DataFrame:
    """The timeline of all that has arrived, the same as that of the whole traffic."""
    return current(spark, path, "timeline", TIMELINE)


def auth_failure_counts(traffic: DataFrame, span: str = "5 minutes", slide: str = "1 minute") -> DataFrame:
    """Refusals per host and path in each sliding span."""
    refused = traffic.where(F.col("status_code").isin(*P.DENIED_STATUSES))
    counted = refused.groupBy(F.window("timestamp", span, slide), "host", "path").agg(F.count("*").alias("failures"))
    return counted.select(
        F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("since"), "host", "path", "failures")


def _failures(span: str = "5 minutes", slide: str = "1 minute") -> View:
    return counts(
        ["since", "host", "path"], "since string, host string, path string, failures long", "failures",
        lambda batch: auth_failure_counts(batch, span, slide))


def auth_failure_alerts(
    traffic: DataFrame, path: str, checkpoint: str, every: str | None = "30 seconds",
    span: str = "5 minutes", slide: str = "1 minute",
) -> StreamingQuery:
    """Refusals per span, kept at ``path`` and read with ``latest_alerts``."""
    return keep_views(traffic, {"failures": _failures(span, slide)}, path, checkpoint, every)


def latest_alerts(spark: SparkSession, path: str, at_least: int = 3) -> DataFrame:
    """Host and path with ``at_least`` refusals within a span, spans that are still open included."""
    return current(spark, path, "failures", _failures()).where(F.col("failures") >= at_least)


_ALERT = ["since", "host", "path"]
EMITTED = View(
    "since string, host string, path string, failures long, batch long", lambda batch: batch,
    lambda rows: rows.groupBy(*_ALERT).agg(F.min_by("failures", "batch").alias("failures"), F.min("batch").alias("batch")))


def emitted_alerts(
    traffic: DataFrame, path: str, checkpoint: str, every: str | None = "30 seconds",
    span: str = "5 minutes", slide: str = "1 minute", at_least: int = 3, late: str = "10 minutes",
    tell: Callable[[DataFrame], object] | None = None,
) -> StreamingQuery:
    """Each span, host and path leaves the stream once: in the batch in which it reaches ``at_least`` refusals.

    Counts are kept in stream state by span and combined before the shuffle; a span is forgotten once the watermark,
    ``late`` behind the newest request, has passed it, and rows that are later still do not count. What has left is kept
    at ``path`` (read with ``past_alerts``), so that a span that goes on growing, or a batch that is delivered again, is not told
    twice. ``tell`` gets the new alerts of a batch before they are kept.
    """
    refused = traffic.where(F.col("status_code").isin(*P.DENIED_STATUSES)).withWatermark("timestamp", late)
    counted = refused.groupBy(F.window("timestamp", span, slide), "host", "path").agg(F.count("*").alias("failures"))
    reached = counted.where(F.col("failures") >= at_least).select(
        F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("since"), "host", "path", "failures")

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        known = past_alerts(batch.sparkSession, path).select(F.struct(*_ALERT).alias("_told"))
        fresh = batch.join(known, F.struct(*_ALERT) == F.col("_told"), "left_anti").withColumn("batch", F.lit(batch_id).cast("long"))
        if tell is not None:
            tell(fresh)
        absorb(fresh, batch_id, {"alerts": EMITTED}, path)

    writer = reached.writeStream.outputMode("update").foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    return trigger(writer, every).start()


def past_alerts(spark: SparkSession, path: str) -> DataFrame:
    """The alerts that have left the stream, with their refusals at that time and the batch."""
    return current(spark, path, "alerts", EMITTED)


def keep_views(
    stream: DataFrame, views: Mapping[str, View], path: str, checkpoint: str, every: str | None = "30 seconds",
) -> StreamingQuery:
    """Add each batch to the views at ``path``, a few rows instead of the traffic.

    A batch delivered again counts once; no state is kept, no row comes too late. A path belongs to one checkpoint.
    """
    def on_batch(batch: DataFrame, batch_id: int) -> None:
        absorb(batch, batch_id, views, path)

    writer = stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    return trigger(writer, every).start()


def live_findings(raw: DataFrame) -> DataFrame:
    """The rules matched by each request, as it arrives."""
    return tag_findings(normalize(raw))


_COUNTED = ["host", "protocol", "method", "path", "status_code"]
_LARGEST = "id long, host string, method string, path string, status_code int, resp_length int"

# What the panels are made of: requests per kind, the largest responses, and sketches of paths per host and day.
PANEL_VIEWS = {
    "requests": counts(
        _COUNTED, "host string, protocol string, method string, path string, status_code int, requests long", "requests",
        lambda batch: batch.groupBy(*_COUNTED).agg(F.count("*").alias("requests"))),
    "largest": top(
        _LARGEST, 100, ("-resp_length", "id"),
        lambda batch: batch.select("id", "host", "method", "path", "status_code", "resp_length")),
    "paths": View(
        "date date, host string, protocol string, requests long, sketch binary",
        lambda batch: batch.groupBy(F.to_date("timestamp").alias("date"), "host", "protocol").agg(
            F.count("*").alias("requests"), F.hll_sketch_agg("path", F.lit(SKETCH_BITS)).alias("sketch")),
        lambda rows: rows.groupBy("date", "host", "protocol").agg(
            F.sum("requests").alias("requests"), F.hll_union_agg("sketch").alias("sketch"))),
}


def live_panels(
    raw: DataFrame, path: str, panel_path: str, checkpoint: str, every: str | None = "30 seconds",
) -> StreamingQuery:
    """Capture, and keep what the panels are made of.

    A batch adds the messages that are new to the stored table, so what is sent again counts once; the stored traffic is not
    read for it. The views take a batch before the table does: where the job fails in between, the batch comes
    again, is the same, is known to the views and goes to the table.
    """
    return capture(raw, path, checkpoint, every, first=lambda new, batch_id: absorb(new, batch_id, PANEL_VIEWS, panel_path))


def latest_panel(spark: SparkSession, panel_path: str, name: str, **options) -> DataFrame:
    """A panel as of the last batch, from the counts that are kept for it."""
    if name == "largest_responses":
        return PANELS[name](current(spark, panel_path, "largest", PANEL_VIEWS["largest"]), **options)
    return PANELS[name](current(spark, panel_path, "requests", PANEL_VIEWS["requests"]), weight="requests", **options)


def distinct_paths(
    spark: SparkSession, panel_path: str, since: str | None = None, until: str | None = None, by: Sequence[str] = ("host", "protocol"),
) -> DataFrame:
    """``requests``, and about how many different paths, within a span of days: sketches united, no path is kept or shuffled.

    The standard error is 1.04 / sqrt(2 ** SKETCH_BITS), about 1.6 %.
    """
    days = current(spark, panel_path, "paths", PANEL_VIEWS["paths"])
    if since is not None:
        days = days.where(F.col("date") >= F.lit(since).cast("date"))
    if until is not None:
        days = days.where(F.col("date") <= F.lit(until).cast("date"))
    return days.groupBy(*by).agg(
        F.sum("requests").alias("requests"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("about_paths"))
