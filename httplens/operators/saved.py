"""The table of saved queries at rest: appends and deletes are new states of it, put in place as a whole.

Ids are given out with the state, so two writers never give out one twice: who comes second numbers anew. A delete is seen at
once or not at all. Only the parts that can hold a deleted id are written again, and many small parts become one.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

from httplens.operators.keyed import KEY_ORDER, delete_keys, read_definitions
from httplens.operators.ordered import number_rows
from httplens.schema import SAVED_QUERIES
from httplens.sources.snapshots import Snapshots, State

MANY_PARTS = 16


class SavedQueries:
    """``rows`` is the table as it is; changes are made by :meth:`append`, :meth:`load` and :meth:`delete`."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self._table = spark, Snapshots(spark, path)

    @property
    def rows(self) -> DataFrame:
        return self._read(list(self._table.state().parts))

    def _read(self, parts: list[dict]) -> DataFrame:
        return self._table.read(parts, SAVED_QUERIES)

    def _part(self, rows: DataFrame) -> dict | None:
        part = self._table.write(rows.select(*SAVED_QUERIES.fieldNames()))
        about = self._read([part]).agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("n")).head()
        return {**part, "low": about.low, "high": about.high, "rows": about.n} if about.n else None

    def append(self, new: DataFrame) -> State:
        """Add rows with the next ids, in the order of category, name and text; what has no ``created_at`` gets the time of now.

        No column of the table may be null: a row without category, name or text fails the append as a whole.
        """
        given = [F.coalesce(c, F.raise_error(F.lit(f"a saved query without {c}"))).alias(c) for c in KEY_ORDER]
        at = F.col("created_at") if "created_at" in new.columns else F.lit(None)
        ready = new.select(*given, F.coalesce(at.cast("timestamp"), F.current_timestamp()).alias("created_at"))

        def step(before: State):
            last = before.marks.get("last_id", 0)
            part = self._part(number_rows(ready, [*KEY_ORDER, "created_at"], "id", after=F.lit(last), unique=False))
            if part is None:
                return None
            return self._compacted([*before.parts, part]), {"last_id": part["high"]}

        return self._table.change(step)

    def load(self, path: str, multi_line: bool = False) -> State:
        """Append an export: newline-delimited JSON, or with ``multi_line`` files that hold one array each."""
        return self.append(read_definitions(self.spark, path, multi_line))

    def delete(self, ids: Iterable[int] | DataFrame) -> State:
        """Remove the rows of the given ids; ids that are not there do not matter, and none is given out again."""
        gone = ids.select(F.col("id").cast("long")) if isinstance(ids, DataFrame) else self.spark.createDataFrame(
            [(i,) for i in ids if i is not None], "id long")

        def step(before: State):
            span = gone.agg(F.min("id").alias("low"), F.max("id").alias("high")).head()
            hit = [p for p in before.parts if span.low is not None and p["low"] <= span.high and p["high"] >= span.low]
            if not hit:
                return None
            left = self._part(delete_keys(self._read(hit), gone))
            kept = [p for p in before.parts if p not in hit]
            return [*kept, *([left] if left else [])], before.marks

        return self._table.change(step)

    def _compacted(self, parts: list[dict]) -> list[dict]:
        if len(parts) <= MANY_PARTS:
            return parts
        return [self._part(self._read(parts))]
