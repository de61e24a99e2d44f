"""The traffic table at rest: Parquet, one folder per project and day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from httplens.schema import TRAFFIC

PARTITIONS = ("project_id", "date")
STORED = T.StructType([
    *TRAFFIC.fields, T.StructField("project_id", T.StringType()), T.StructField("date", T.DateType())])
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
# Files that a task has open at a time, and what each holds back: pages before, row groups after compression.
OPEN_FILES, OPEN = 128, {"parquet.page.size": str(1 << 19), "parquet.block.size": str(2 << 20)}


def load_traffic(spark: SparkSession, path: str) -> DataFrame:
    """A plain traffic folder or file, in the fixed column order."""
    return spark.read.schema(TRAFFIC).parquet(path)


def save_project(traffic: DataFrame, path: str, project_id: str | None = None, gathered: bool = False) -> None:
    """Append to the project table; ``traffic`` brings its own ``project_id`` if none is given.

    Every task writes its rows straight to their folders, with a small row group open for each, so that whole rows are neither shuffled nor
    sorted: a file per task and folder. Only what a task has beyond :data:`OPEN_FILES` folders is sorted by Spark first.
    ``gathered`` shuffles the rows to write few files per folder, as for a small batch; a day that holds most of the rows is still split.
    """
    df = traffic if project_id is None else traffic.withColumn("project_id", F.lit(project_id))
    df = df.withColumn("date", F.to_date("timestamp"))
    if gathered:
        _append(df.hint("rebalance", *PARTITIONS), path)
        return
    conf, before = df.sparkSession.conf, df.sparkSession.conf.get(WRITERS)
    conf.set(WRITERS, OPEN_FILES)
    try:
        _append(df, path, **OPEN)
    finally:
        conf.set(WRITERS, before)


def _append(df: DataFrame, path: str, **options: str) -> None:
    df.write.mode("append").option("compression", "zstd").options(**options).partitionBy(*PARTITIONS).parquet(path)


def load_projects(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STORED).parquet(path)


def load_project(
    spark: SparkSession, path: str, project_id: str, since: str | None = None, until: str | None = None
) -> DataFrame:
    """One project's traffic; only its folders, and those of the days asked for, are read."""
    df = load_projects(spark, path).where(F.col("project_id") == project_id)
    if since is not None:
        df = df.where(F.col("date") >= F.lit(since).cast("date"))
    if until is not None:
        df = df.where(F.col("date") <= F.lit(until).cast("date"))
    return df.select(*TRAFFIC.fieldNames())
