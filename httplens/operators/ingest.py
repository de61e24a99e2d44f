"""From captured exchanges to rows of the traffic table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from httplens.functions.strings import header_json
from httplens.schema import TRAFFIC
from httplens.session import stage

# 256 MB at most, for 537 million keys without gaps.
SENT_BITMAPS = 1 << 16


def normalize(raw: DataFrame) -> DataFrame:
    """Raw exchanges in the traffic layout; row by row, so batch and stream alike.

    An exchange without a time gets that of the batch it arrives in.
    """
    derived = {
        "timestamp": F.coalesce(F.col("ts").cast("timestamp"), F.current_timestamp()),
        "protocol": F.when(F.col("secure"), "https").otherwise("http"),
        "req_headers": header_json(F.col("req_headers")),
        "resp_headers": header_json(F.col("resp_headers")),
        "resp_length": F.coalesce(F.length("resp_body"), F.lit(0)),
    }
    return raw.select(*[
        derived.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in TRAFFIC.fields])


def first_per_key(
    df: DataFrame, key: Sequence[str] = ("id",), arrival: Sequence[str] = ("timestamp",)
) -> DataFrame:
    """One whole row per key, the one that arrived first, rows without a time last. Where times
    are equal a digest of the row decides, so that the choice does not hang on the partitioning.

    ``min_by`` is combined on the map side, so a message replayed millions of times
    reaches the reducer as one row per task.
    """
    rest = [c for c in df.columns if c not in key]
    times = [part for c in arrival for part in (F.col(c).isNull(), F.col(c))]
    first = F.min_by(F.struct(*rest), F.struct(*times, F.xxhash64(*rest)))
    return df.groupBy(*key).agg(first.alias("_first")).select(*key, "_first.*").select(*df.columns)


def append_new(
    existing: DataFrame,
    incoming: DataFrame,
    key: Sequence[str] = ("id",),
    arrival: Sequence[str] = ("timestamp",),
) -> DataFrame:
    """The incoming rows to add: one per key, none for keys that are stored already.

    Of the stored table only the key columns are read, and of those only the range the
    incoming keys span: ids grow with time, so a batch meets a small part of the table.
    Lazy, but whole rows are shuffled: see :func:`new_rows`.
    """
    fresh = first_per_key(incoming, key, arrival)
    return fresh.join(_within(existing.select(*key), incoming, key), list(key), "left_anti").select(*incoming.columns)


def new_rows(
    existing: DataFrame,
    incoming: DataFrame,
    key: Sequence[str] = ("id",),
    arrival: Sequence[str] = ("timestamp",),
) -> DataFrame:
    """The same rows as :func:`append_new`. Those whose key is not stored are written once to the shared folder, and only keys, times
    and digests are compared and shuffled."""
    fresh = stage(without(incoming, _within(existing.select(*key), incoming, key), key), "incoming")
    places = stage(winners(fresh, lambda narrow: narrow, arrival, key), "winners")
    return kept_at(fresh, places).select(*incoming.columns)


def winners(
    staged: DataFrame, absent: Callable[[DataFrame], DataFrame], arrival: Sequence[str] = ("timestamp",),
    key: Sequence[str] = ("id",),
) -> DataFrame:
    """The key and the place (``_file``, ``_row``) of the first row per key among those that ``absent`` lets through.

    ``staged`` is a table of Parquet files. Only keys, times and digests are compared and shuffled. Rows of one key with equal times and
    digests are equal: any of them will do.
    """
    rest = [c for c in staged.columns if c not in key]
    narrow = staged.select(*key, *[c for c in arrival if c not in key], F.xxhash64(*rest).alias("_digest"), *place())
    times = [part for c in arrival for part in (F.col(c).isNull(), F.col(c))]
    first = F.min_by(F.struct("_file", "_row"), F.struct(*times, "_digest", "_file", "_row"))
    return absent(narrow).groupBy(*key).agg(first.alias("_first")).select(*key, "_first.*")


def at_places(staged: DataFrame, places: DataFrame) -> DataFrame:
    """The rows of ``staged`` at ``places``: whole rows are moved once at most and not sorted, and of a busy id's rows each goes its own way."""
    found = staged.select("*", *place()).join(places.select("_file", "_row").hint("shuffle_hash"), ["_file", "_row"], "left_semi")
    return found.select(*staged.columns)


def kept_at(staged: DataFrame, places: DataFrame) -> DataFrame:
    """As :func:`at_places`, but whole rows stay where they are: the places are sent to them, a bit per row, if that takes
    no more than :data:`SENT_BITMAPS` bitmaps. ``places`` is staged too."""
    row = F.col("_row") + 1  # positive numbers fill a bitmap without a gap
    bits = places.groupBy("_file", F.bitmap_bucket_number(row).alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(row)).alias("_bits"))
    if bits.select("_bucket").limit(SENT_BITMAPS + 1).count() > SENT_BITMAPS:
        return at_places(staged, places)
    found = staged.select("*", *place()).withColumn("_bucket", F.bitmap_bucket_number(row)).join(
        F.broadcast(bits), ["_file", "_bucket"])
    return found.where(_is_set(F.col("_bits"), F.bitmap_bit_position(row))).select(*staged.columns)


def place() -> list[Column]:
    return [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")]


def _is_set(bits: Column, position: Column) -> Column:
    """Whether a bitmap has a bit: the lowest of a byte comes first."""
    byte = F.conv(F.hex(F.substring(bits, (position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.call_function("shiftright", byte, (position % 8).cast("int")).bitwiseAND(F.lit(1)) == 1


def within(rows: DataFrame, keys: DataFrame, key: Sequence[str] = ("id",)) -> DataFrame:
    """The rows whose key is among ``keys``; where :func:`_sent` can do it, they are not shuffled."""
    bits = _bitmaps(rows, keys, key)
    return rows.join(keys, list(key), "left_semi").select(*rows.columns) if bits is None else _sent(rows, bits, key[0], False)


def without(rows: DataFrame, keys: DataFrame, key: Sequence[str] = ("id",)) -> DataFrame:
    """The rows whose key is not among ``keys``, those without a key included."""
    bits = _bitmaps(rows, keys, key)
    return rows.join(keys, list(key), "left_anti").select(*rows.columns) if bits is None else _sent(rows, bits, key[0], True)


def _bitmaps(rows: DataFrame, keys: DataFrame, key: Sequence[str]) -> DataFrame | None:
    """A bitmap per range of 32,768 keys, if the key is one number and there are no more than :data:`SENT_BITMAPS` ranges."""
    if len(key) > 1 or any(not isinstance(df.schema[key[0]].dataType, T.IntegralType) for df in (rows, keys)):
        return None
    number = F.col(key[0]).cast("long")
    own = keys.where(F.col(key[0]).isNotNull()).select(
        F.bitmap_bucket_number(number).alias("_bucket"), F.bitmap_bit_position(number).alias("_position"))
    if own.select("_bucket").distinct().limit(SENT_BITMAPS + 1).count() > SENT_BITMAPS:
        return None
    return stage(own.groupBy("_bucket").agg(F.bitmap_construct_agg("_position").alias("_bits")), "bitmaps")


def _sent(rows: DataFrame, bits: DataFrame, key: str, absent: bool) -> DataFrame:
    """The bitmaps go to the rows, 4 KB each, so that whole rows need not meet the keys by a shuffle."""
    number = F.col(key).cast("long")
    met = rows.withColumn("_bucket", F.bitmap_bucket_number(number)).join(F.broadcast(bits), "_bucket", "left" if absent else "inner")
    held = F.coalesce(_is_set(F.col("_bits"), F.bitmap_bit_position(number)), F.lit(False))
    return met.where(~held if absent else held).select(*rows.columns)


def _within(stored: DataFrame, incoming: DataFrame, key: Sequence[str]) -> DataFrame:
    """Stored keys between the lowest and the highest incoming one."""
    for column in key:
        low = incoming.agg(F.min(column)).scalar()
        high = incoming.agg(F.max(column)).scalar()
        stored = stored.where((F.col(column) >= low) & (F.col(column) <= high))
    return stored


def upsert_ignore(
    existing: DataFrame,
    incoming: DataFrame,
    key: Sequence[str] = ("id",),
    arrival: Sequence[str] = ("timestamp",),
) -> DataFrame:
    """The table after the append: stored rows stay, the first new row per key is added."""
    columns = existing.columns
    return existing.unionByName(new_rows(existing, incoming, key, arrival).select(*columns))
