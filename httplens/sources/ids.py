"""The ids that a table holds, kept beside it, so that an append neither lists nor opens the table.

A part is a batch's ids in sorted files with Parquet Bloom filters; the state lists each file's least and greatest id, a row per
:data:`IDS_PER_FILE` ids and part. Parts are merged by level, so that there are some FAN_IN * log(n) of them after n batches. Before an append
the range of its ids is noted, afterwards its ids go in: where a writer was lost between the two, the
next one reads the ids of that range from the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from httplens.sources.snapshots import Snapshots
from httplens.streaming.views import FAN_IN

IDS_PER_FILE = 10_000_000


class StoredIds:
    def __init__(self, spark: SparkSession, path: str, ids_per_file: int = IDS_PER_FILE):
        self.spark, self.ids_per_file = spark, ids_per_file
        self._table = Snapshots(spark, path)

    def begin(self, stored: DataFrame) -> None:
        """Bring the index up to the table ``stored``: all of it at first, then what a lost writer left open."""
        state = self._table.state()
        if not state.version:
            self.add(stored.select("id"))
        elif "open" in state.marks:
            low, high = state.marks["open"]
            self.add(self.absent(stored.select("id").where(F.col("id").between(low, high))))

    def note(self, low: int, high: int) -> None:
        """Ids between ``low`` and ``high`` are about to be stored."""
        self._table.change(lambda before: (list(before.parts), {"open": [low, high]}))

    def add(self, ids: DataFrame) -> None:
        """``ids`` are stored now; nothing is open any more."""
        part = self._written(ids.select("id").where("id IS NOT NULL").distinct(), 0)
        self._table.change(lambda before: (self._compacted([*before.parts, part] if part["files"] else list(before.parts)), {}))

    def files(self, rows: DataFrame) -> list[str]:
        """The files whose range holds an id of ``rows``."""
        held = [(f"{self._table.path}/{p['folder']}/{name}", low, high)
                for p in self._table.state().parts for name, low, high in p["files"]]
        if not held:
            return []
        # A row per file of many ids: small enough to broadcast.
        about = self.spark.createDataFrame(held, "file string, low long, high long")
        met = rows.select("id").join(F.broadcast(about), F.col("id").between(F.col("low"), F.col("high")))
        return sorted(r.file for r in met.select("file").distinct().collect())

    def held(self, rows: DataFrame) -> DataFrame | None:
        """The ids of the files that may hold one of ``rows``, None if there is no such file."""
        names = self.files(rows)
        return self.spark.read.schema("id long").parquet(*names) if names else None

    def absent(self, rows: DataFrame) -> DataFrame:
        """The rows whose id is not stored; only files that may hold one of the ids are opened."""
        held = self.held(rows)
        return rows if held is None else rows.join(held, "id", "left_anti").select(*rows.columns)

    def _written(self, ids: DataFrame, level: int) -> dict:
        folder = self._table.new_folder()
        path = f"{self._table.path}/{folder}"
        writer = ids.repartitionByRange("id").sortWithinPartitions("id").write.option("maxRecordsPerFile", self.ids_per_file)
        writer.option("parquet.bloom.filter.enabled#id", "true").option(
            "parquet.bloom.filter.expected.ndv#id", str(self.ids_per_file)).parquet(path)
        own = self.spark.read.schema("id long").parquet(path).select("id", F.col("_metadata.file_name").alias("file"))
        files = own.groupBy("file").agg(F.min("id").alias("low"), F.max("id").alias("high")).orderBy("low").collect()
        return {"folder": folder, "level": level, "files": [list(f) for f in files]}

    def _compacted(self, parts: list[dict]) -> list[dict]:
        level = 0
        while full := [p for p in parts if p["level"] >= level]:
            own = [p for p in full if p["level"] == level]
            if len(own) >= FAN_IN:
                merged = self._written(self._table.read(own, "id long").distinct(), level + 1)
                parts = [*[p for p in parts if p not in own], merged]
            level += 1
        return parts
