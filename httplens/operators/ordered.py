"""Numbering and looking back over rows in order, without one task per group.

A window over ``partitionBy("host")`` puts all rows of a host into one task, and one
host may hold a third of all rows. Here the rows are range-partitioned on group *and*
order into chunks, written once to the shared folder, and worked on chunk by chunk;
what has to cross from one chunk to the next is a single row per group and chunk.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from httplens.session import stage

_POSITION_BITS = 33  # monotonically_increasing_id: partition number above, row number below


def in_chunks(df: DataFrame, order: Sequence[str], unique: bool = True, chunks: int | None = None) -> DataFrame:
    """``df`` with ``_chunk`` and ``_pos``: chunks follow each other in ``order``.

    The chunks are written before anyone reads them, as range boundaries are
    sampled and must not be drawn twice. Where ``order`` is not unique the rows first get
    a stored arrival number, so that even a third of all rows being equal can be
    spread over chunks.
    """
    spark = df.sparkSession
    if not unique:
        df = stage(df.withColumn("_arrival", F.monotonically_increasing_id()), "arrival")
        order = [*order, "_arrival"]
    chunks = chunks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = (
        df.repartitionByRange(chunks, *order)
        .sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_chunk", F.shiftright("_at", _POSITION_BITS).cast("int"))
        .withColumn("_pos", F.col("_at").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)))
    )
    drop = ["_at"] if unique else ["_at", "_arrival"]
    return stage(placed.drop(*drop), "chunks")


def number_rows(
    df: DataFrame, order: Sequence[str], column: str, after: Column | None = None,
    unique: bool = True, chunks: int | None = None,
) -> DataFrame:
    """``df`` with consecutive numbers in ``order``, from 1 or from ``after`` + 1."""
    placed = in_chunks(df, order, unique, chunks)
    sizes = placed.groupBy("_chunk").agg(F.count("*").alias("_rows"))
    # One row per chunk, at most as many as there are partitions: safe to broadcast.
    before = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_chunk", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    number = F.col("_before") + F.col("_pos") + 1
    if after is not None:
        number = number + after
    return placed.join(F.broadcast(offsets), "_chunk").select(*df.columns, number.alias(column))


# Group and chunk together key all further work: rows are shuffled on them once, for the window and the
# join alike. The group is a struct because structs are equal where their fields are both null.
_SEGMENT = ("_group", "_chunk")


def _grouped_chunks(df: DataFrame, group: Sequence[str], order: Sequence[str], **options) -> DataFrame:
    return in_chunks(df, [*group, *order], **options).withColumn("_group", F.struct(*group))


def _segments(placed: DataFrame, *measures: Column) -> DataFrame:
    """One row per group and chunk it occurs in; combined before the shuffle."""
    return placed.groupBy(*_SEGMENT).agg(*measures)


def _across(newest_first: bool = False):
    """The segments of the same group before a segment, or after it."""
    order = F.desc("_chunk") if newest_first else F.asc("_chunk")
    return Window.partitionBy("_group").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def running_count(df: DataFrame, group: Sequence[str], order: Sequence[str], column: str, **options) -> DataFrame:
    """How many rows of its group there are up to and including each row."""
    placed = _grouped_chunks(df, group, order, **options)
    segments = _segments(placed, F.min("_pos").alias("_start"), F.count("*").alias("_rows"))
    segments = segments.withColumn("_before", F.coalesce(F.sum("_rows").over(_across()), F.lit(0)))
    number = F.col("_before") + F.col("_pos") - F.col("_start") + 1
    return placed.join(segments, list(_SEGMENT)).select(*df.columns, number.alias(column))


def previous_value(
    df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, column: str, **options
) -> DataFrame:
    """``value`` of the row before in the same group, null for the first."""
    placed = _grouped_chunks(df, group, order, **options)
    segments = _segments(placed, F.max_by(value, "_pos").alias("_last")).withColumn(
        "_carried", F.lag("_last").over(Window.partitionBy("_group").orderBy("_chunk")))
    inside = Window.partitionBy(*_SEGMENT).orderBy("_pos")
    rows = placed.withColumn("_here", F.lag(value).over(inside)).withColumn(
        "_first", F.row_number().over(inside) == 1)
    found = F.when(F.col("_first"), F.col("_carried")).otherwise(F.col("_here"))
    return rows.join(segments, list(_SEGMENT)).select(*df.columns, found.alias(column))


def next_match(
    df: DataFrame, group: Sequence[str], order: Sequence[str], value: Column, column: str, **options
) -> DataFrame:
    """The first non-null ``value`` among the later rows of the same group."""
    placed = _grouped_chunks(df.withColumn("_value", value), group, order, **options)
    first = F.min_by("_value", F.when(F.col("_value").isNotNull(), F.col("_pos"))).alias("_first")
    segments = _segments(placed, first).withColumn(
        "_later", F.last("_first", ignorenulls=True).over(_across(newest_first=True)))
    after = Window.partitionBy(*_SEGMENT).orderBy(F.desc("_pos")).rowsBetween(Window.unboundedPreceding, -1)
    rows = placed.withColumn("_here", F.last("_value", ignorenulls=True).over(after))
    found = F.coalesce("_here", "_later")
    return rows.join(segments, list(_SEGMENT)).select(*df.columns, found.alias(column))
