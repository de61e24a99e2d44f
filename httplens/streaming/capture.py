"""Live capture: exchanges arriving as a stream, stored once each."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from httplens.operators.ingest import kept_at, new_rows, normalize, place, winners, without
from httplens.schema import TRAFFIC
from httplens.session import WIDE_PAGES, exists, stage
from httplens.sources.ids import StoredIds
from httplens.sources.snapshots import Snapshots
from httplens.sources.traffic import PARTITIONS, STORED, load_project, load_traffic, save_project

# What the state sees of a row.
SENT = ("id", "timestamp")


def trigger(stream_writer, every: str | None):
    """Every so often, or if ``every`` is None, all that is there now and then stop."""
    if every is None:
        return stream_writer.trigger(availableNow=True)
    return stream_writer.trigger(processingTime=every)


def create_table(spark: SparkSession, path: str, schema: StructType = TRAFFIC) -> None:
    """An empty table, unless there is one already."""
    by = [c for c in PARTITIONS if c in schema.fieldNames()]
    empty = spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])
    empty.write.mode("ignore").partitionBy(*by).parquet(path)


def _stored(spark: SparkSession, path: str, project_id: str | None) -> DataFrame:
    return load_traffic(spark, path) if project_id is None else load_project(spark, path, project_id)


def stored_ids(spark: SparkSession, path: str, project_id: str | None = None) -> StoredIds:
    """The index of the ids of a table, or of one of its projects, in a folder that readers of the table pass over."""
    return StoredIds(spark, f"{path}/_ids/{'all' if project_id is None else 'project-' + quote(project_id, safe='')}")


def store_batch(
    batch: DataFrame, path: str, arrival: Sequence[str] = ("timestamp",), project_id: str | None = None,
    first: Callable[[DataFrame], object] | None = None, indexed: bool = True,
) -> None:
    """Append the messages of a normalised batch that are not stored yet.

    A batch delivered again after a failure finds its own rows stored, whole or in part, and
    adds only what is missing. Ids of different projects do not meet. ``first`` gets the new messages before they are stored.

    What the batch brings of new ids is written once to the shared folder. Ids meet the index of stored ids, not the table, and
    whole rows are not shuffled: the places of the winners are sent to them. The index knows what this function stores: a table to which others append too is stored
    with ``indexed=False``, which reads the ids of the batch's range from the table.
    """
    spark = batch.sparkSession
    stored = _stored(spark, path, project_id)
    if not indexed:
        new = new_rows(stored, batch, arrival=arrival)
        new = new if first is None else new.persist()
        _store(new, path, project_id, first)
        new.unpersist()
        return
    index = stored_ids(spark, path, project_id)
    index.begin(stored)
    held = index.held(batch)
    whole = stage(batch if held is None else without(batch, held), "batch")
    places = stage(winners(whole, index.absent, arrival), "winners")
    span = places.agg(F.min("id").alias("low"), F.max("id").alias("high")).head()
    if span.low is None:
        if first is not None:
            first(whole.limit(0))
        return
    index.note(span.low, span.high)
    _store(kept_at(whole, places), path, project_id, first)
    index.add(places)


def _store(new: DataFrame, path: str, project_id: str | None, first: Callable[[DataFrame], object] | None) -> None:
    if first is not None:
        first(new)
    if project_id is None:
        new.write.mode("append").option("compression", "zstd").parquet(path)
    else:
        save_project(new, path, project_id, gathered=True)


def capture(
    raw: DataFrame,
    path: str,
    checkpoint: str,
    every: str | None = "30 seconds",
    project_id: str | None = None,
    first: Callable[[DataFrame, int], object] | None = None,
    indexed: bool = True,
) -> StreamingQuery:
    """Store a stream of raw exchanges; the first arrival of an id wins, in and across batches.

    Duplicates inside a batch are combined before the shuffle. No per-id state is kept: each batch
    meets the index of stored ids instead (see :func:`store_batch`). With ``project_id`` the
    table is the one partitioned by project and day. ``first`` gets the new messages of each batch, and its
    number, before they are stored.
    """
    create_table(raw.sparkSession, path, TRAFFIC if project_id is None else STORED)

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        told = None if first is None else lambda new: first(new, batch_id)
        store_batch(normalize(batch), path, project_id=project_id, first=told, indexed=indexed)

    writer = raw.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    return trigger(writer, every).start()


def deduplicated(raw: DataFrame, within: str | None = None) -> DataFrame:
    """The normalised stream without repeated ids, kept apart by state.

    State holds every id ever seen, or with ``within`` only those of that
    event-time span: bounded, but a repeat that comes later gets through. All repeats of an
    id travel to the task that keeps its state; ``capture`` combines them before that. :func:`append_to` sends
    only their ids and times there; any other use of this stream sends whole rows.
    """
    rows = normalize(raw)
    kept = _without_repeats(rows, within)
    kept._by_state = rows, _without_repeats(rows.select(*SENT), within)
    return kept


def _without_repeats(rows: DataFrame, within: str | None) -> DataFrame:
    if within is None:
        return rows.dropDuplicates(["id"])
    return rows.withWatermark("timestamp", within).dropDuplicatesWithinWatermark(["id"])


def first_arrivals(raw: DataFrame) -> DataFrame:
    """The normalised stream with the first arrival of each id, once: that of the earliest batch, in it that of the earliest time, then by digest.

    State holds the first row of every id (keep it in RocksDB); batches are ordered by the clock, which must not go back. ``min_by`` is combined in each task, so a busy id crosses once per task. An
    id is put out in the batch that brought it. To be written in update mode, see :func:`keep_first`.
    """
    return _first_by_state(normalize(raw))


def _first_by_state(rows: DataFrame) -> DataFrame:
    rest = [c for c in rows.columns if c != "id"]
    order = F.struct("_batch", F.col("timestamp").isNull(), "timestamp", F.xxhash64(*rest))
    first = F.min_by(F.struct("_batch", *rest), order)
    # The time of the batch is the same in a batch that is run again.
    kept = rows.withColumn("_batch", F.current_timestamp()).groupBy("id").agg(first.alias("_first"))
    return kept.where(F.col("_first._batch") == F.current_timestamp()).select("id", "_first.*").select(*rows.columns)


def _with_kept(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """Whole rows, which no state sees, and beside them the ids and times that state let through in the same batch."""
    return rows.withColumn("_kept", F.lit(False)).unionByName(kept.withColumn("_kept", F.lit(True)), allowMissingColumns=True)


def _kept_places(staged: DataFrame) -> DataFrame:
    """Where the rows stand that state let through: of rows with one id and time the first by digest. Null ids and times are values too."""
    row = F.struct(F.xxhash64(*[c for c in staged.columns if c not in ("id", "_kept")]).alias("_digest"), *place())
    found = staged.select(*SENT, "_kept", F.when(~F.col("_kept"), row).alias("_place")).groupBy(*SENT).agg(
        F.max("_kept").alias("_kept"), F.min("_place").alias("_place"))
    return found.where("_kept AND _place IS NOT NULL").select(*SENT, "_place._file", "_place._row")


def keep_first(raw: DataFrame, path: str, checkpoint: str, every: str | None = "30 seconds") -> StreamingQuery:
    """Store :func:`first_arrivals`, a folder per batch: one that is run again takes the place of what it left.

    State holds the batch and the time of the first arrival of every id. Whole rows do not go there: they are written
    once to the shared folder, and the places of the first ones are sent to them. The stream is read twice.
    """
    rows = normalize(raw)

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        staged = stage(batch, "batch", **WIDE_PAGES)
        new = kept_at(staged, stage(_kept_places(staged), "winners")).select(*rows.columns)
        new.write.mode("overwrite").option("compression", "zstd").options(**WIDE_PAGES).parquet(f"{path}/{batch_id:012d}")

    writer = _with_kept(rows, _first_by_state(rows.select(*SENT))).writeStream.outputMode("update").foreachBatch(on_batch)
    return trigger(writer.option("checkpointLocation", checkpoint), every).start()


def load_first(spark: SparkSession, path: str) -> DataFrame:
    """What :func:`keep_first` stored."""
    return spark.read.schema(TRAFFIC).option("recursiveFileLookup", True).parquet(path)


def append_to(stream: DataFrame, path: str, checkpoint: str, every: str | None = "30 seconds") -> StreamingQuery:
    """Append a stream to Parquet, each row exactly once.

    Of :func:`deduplicated` only ids and times go to the state. Whole rows are written once to the shared folder, and the places of
    those kept are sent to them; the stream is read twice. A table begun with Spark's own file sink stays with it.
    """
    by_state = getattr(stream, "_by_state", None)
    if by_state is None or exists(stream.sparkSession, f"{path}/_spark_metadata"):
        writer = stream.writeStream.format("parquet").outputMode("append").option("compression", "zstd").option(
            "path", path).option("checkpointLocation", checkpoint)
        return trigger(writer, every).start()
    create_table(stream.sparkSession, path, stream.schema)

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        begun = Snapshots(spark, f"{path}/_begun")
        staged = stage(batch, "batch", **WIDE_PAGES)
        places = _kept_places(staged)
        if begun.state().marks.get("batch", -1) < batch_id:
            begun.change(lambda before: ([], {"batch": batch_id}))
        else:
            places = _not_stored(places, spark.read.schema(stream.schema).parquet(path))
        new = kept_at(staged, stage(places, "winners")).select(*stream.columns)
        new.write.mode("append").option("compression", "zstd").options(**WIDE_PAGES).parquet(path)

    writer = _with_kept(*by_state).writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    return trigger(writer, every).start()


def _not_stored(places: DataFrame, stored: DataFrame) -> DataFrame:
    """Of a batch that is run again, what its first run did not store."""
    there = stored.select(*[F.col(c).alias(f"_stored_{c}") for c in SENT])
    same = [F.col(c).eqNullSafe(F.col(f"_stored_{c}")) for c in SENT]
    return places.join(there, same, "left_anti")
