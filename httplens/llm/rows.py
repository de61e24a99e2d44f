"""What the operators share about the rows of a document table."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from httplens.operators.ordered import number_rows


def identified(
    docs: DataFrame, key: str, columns: list[str], column: str = "row_id"
) -> tuple[DataFrame, bool]:
    """``key`` and ``columns`` with a unique number per row that follows the order of ``key``; whether it is the key itself.

    Where the key is unique and never null it is the number itself. Otherwise rows are numbered by
    key (null first) and then by the other columns, so that repeated rows are told apart; which of
    two equal rows comes first makes no difference to any result.
    """
    own = docs.select(key, *[c for c in columns if c != key])
    plain = own.schema[key].dataType.typeName() in ("long", "integer", "short", "byte")
    doubtful = own.groupBy(key).count().where((F.col("count") > 1) | F.col(key).isNull())
    if plain and doubtful.isEmpty():
        return own.withColumn(column, F.col(key).cast("long")), True
    return number_rows(own, own.columns, column, unique=False), False


def named(found: DataFrame, rows: DataFrame, key: str, is_key: bool, column: str = "row_id") -> DataFrame:
    """``found`` with ``key`` in place of the number from :func:`identified`."""
    if is_key:
        return found.withColumn(key, F.col(column).cast(rows.schema[key].dataType)).drop(column)
    return found.join(rows.select(column, key), column).drop(column)


def free_name(name: str, taken: list[str]) -> str:
    """``name``, made longer until no column has it."""
    while name.lower() in {t.lower() for t in taken}:
        name = f"_{name}"
    return name


def importable(spark: SparkSession) -> None:
    """Let local Python workers import this package from where the driver does, whatever their working folder.

    On a cluster the package is shipped as any other (``--py-files`` or installed); there this does nothing.
    """
    root = str(Path(__file__).resolve().parents[2])
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([p for p in paths if p] + [root])
