"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# Pages and dictionaries of whole rows, before compression: in Parquet's own 1 MB few bodies find their equals. A dictionary that does
# not pay is given up after the first page.
WIDE_PAGES = {"parquet.page.size": str(32 << 20), "parquet.dictionary.page.size": str(32 << 20)}


def build_session(master: str | None = None, app: str = "httplens", **conf: str) -> SparkSession:
    """A session with UTC time and adaptive execution; the cluster's own settings win elsewhere."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``, which has to be set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/httplens/{label}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def stage(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage at a table that survives the loss of executors, and unlike a
    checkpoint keeps column pruning for whoever reads it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
