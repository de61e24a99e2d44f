"""Free-form Spark SQL over the traffic."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEW = "traffic"


def clean(sql: str) -> str:
    """Without surrounding space and trailing semicolon."""
    return re.sub(r"\s*;?\s*\Z", "", sql.strip())


def run_sql(traffic: DataFrame, sql: str) -> DataFrame | None:
    """Any query over the view ``traffic``. An empty text gives None; errors are raised.

    The view stays registered for later statements; the frame returned keeps to the
    traffic it was made with.
    """
    sql = clean(sql)
    if not sql:
        return None
    traffic.createOrReplaceTempView(VIEW)
    return traffic.sparkSession.sql(sql)


def execute(spark: SparkSession, sql: str) -> None:
    """A statement that is not a query."""
    spark.sql(clean(sql))
