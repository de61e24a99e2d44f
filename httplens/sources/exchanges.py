"""Raw exchanges as they come in: files dropped into a folder, or JSON texts from a queue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from httplens.schema import RAW_EXCHANGE


def read_exchanges(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(RAW_EXCHANGE).format(fmt).load(path)


def stream_exchanges(spark: SparkSession, path: str, fmt: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    """New files in a folder as a stream. The schema is given, as a stream cannot infer it."""
    reader = spark.readStream.schema(RAW_EXCHANGE)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.format(fmt).load(path)


def parse_exchanges(messages: DataFrame, column: str = "value") -> DataFrame:
    """Exchanges from JSON texts, say the ``value`` of a Kafka stream; the other messages are
    ``rejected_exchanges``, so that each message is in one of the two."""
    return _judged(messages, column).where(f"{_REASON} IS NULL").select(
        *[F.col(_EXCHANGE)[name].alias(name) for name in RAW_EXCHANGE.fieldNames()])


def rejected_exchanges(messages: DataFrame, column: str = "value") -> DataFrame:
    """The messages that are no exchange with an id, as they came, with the ``reason``."""
    return _judged(messages, column).where(f"{_REASON} IS NOT NULL").select(
        *messages.columns, F.col(_REASON).alias("reason"))


_EXCHANGE, _REASON, _UNREAD = "_exchange", "_reason", "_unread"


def _judged(messages: DataFrame, column: str) -> DataFrame:
    text = F.col(column).cast("string")
    schema = T.StructType([*RAW_EXCHANGE.fields, T.StructField(_UNREAD, T.StringType())])
    exchange = F.col(_EXCHANGE)
    return messages.withColumn(
        _EXCHANGE, F.from_json(text, schema, {"columnNameOfCorruptRecord": _UNREAD})
    ).withColumn(
        _REASON, F.when(text.isNull(), "no text").when(exchange[_UNREAD].isNotNull(), "not an exchange")
        .when(exchange["id"].isNull(), "no id"))
