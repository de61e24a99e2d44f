"""Results to files and back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from httplens.plans.adhoc import run_sql


# Quotes inside a value are doubled, spaces at its ends are kept.
_CSV = {
    "header": True, "escape": '"', "lineSep": "\n",
    "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}
# Times are written to the microsecond; reading takes any ISO time.
_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


# So that a compressed file, which one task has to read from its start, stays short.
ROWS_PER_FILE = 200_000


def _writer(df: DataFrame, compression: str | None):
    if compression is None:
        return df.write
    return df.write.options(compression=compression, maxRecordsPerFile=ROWS_PER_FILE)


def write_csv(df: DataFrame, path: str, compression: str | None = None) -> None:
    """With header. Empty text is written quoted, no value as nothing. ``compression`` is a codec of Spark's, such as gzip.

    In a table of one column a null is written as empty text, because a line with nothing in it is no row.
    """
    if len(df.columns) == 1:
        only = df.columns[0]
        df = df.select(F.coalesce(df[only].cast("string"), F.lit("")).alias(only))
    _writer(df, compression).options(**_CSV, **_TIMES).csv(path)


def write_json(df: DataFrame, path: str, compression: str | None = None) -> None:
    """Newline-delimited, with null fields written out."""
    _writer(df, compression).options(ignoreNullFields=False, **_TIMES).json(path)


def write_parquet(df: DataFrame, path: str, compression: str | None = None) -> None:
    _writer(df, compression).parquet(path)


_WRITERS = {"json": write_json, "parquet": write_parquet}


def export(
    result: DataFrame | str, fmt: str, path: str, traffic: DataFrame | None = None, compression: str | None = None,
) -> None:
    """Write a frame, or the result of a query over ``traffic``; unknown formats become CSV.

    Gives a folder with one file per task, so that nothing has to pass through one.
    """
    if isinstance(result, str):
        if traffic is None:
            raise ValueError("a query needs the traffic it runs over")
        result = run_sql(traffic, result)
        if result is None:
            raise ValueError("no query to export")
    _WRITERS.get(fmt.lower(), write_csv)(result, path, compression)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Reads back what ``write_csv`` wrote, line breaks in values and empty texts included.

    The mark the reader puts for null is drawn anew for each read, after the texts were written,
    so that only a field with nothing in it is null.
    """
    return (spark.read.schema(schema).options(**_CSV)
            .option("multiLine", True).option("nullValue", uuid.uuid4().hex).csv(path))


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
              multi_line: bool = False) -> DataFrame:
    """Newline-delimited JSON, or with ``multi_line`` files that hold one array. Columns are
    inferred where no schema is given, which costs a pass over the files."""
    reader = spark.read.option("multiLine", multi_line)
    return (reader.schema(schema) if schema is not None else reader).json(path)
