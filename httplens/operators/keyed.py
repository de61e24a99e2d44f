"""Maintenance of keyed tables: numbered append, listing, delete, JSON round trip, rollup."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from httplens.operators.ordered import number_rows, running_count

KEY_ORDER = ("category", "name", "sql_text")


def new_ids(existing: DataFrame, new_rows: DataFrame, id_col: str = "id",
            order: Sequence[str] = KEY_ORDER, unique: bool = False, chunks: int | None = None) -> DataFrame:
    """``new_rows`` numbered from the highest stored id on, sorted in ``chunks`` tasks."""
    highest = existing.agg(F.coalesce(F.max(id_col), F.lit(0)).cast("long")).scalar()
    return number_rows(new_rows, order, id_col, after=highest, unique=unique, chunks=chunks)


def append_with_ids(existing: DataFrame, new_rows: DataFrame, id_col: str = "id",
                    order: Sequence[str] = KEY_ORDER, unique: bool = False, chunks: int | None = None) -> DataFrame:
    """The table after the append. ``unique`` says that ``order`` has no ties."""
    numbered = new_ids(existing, new_rows, id_col, order, unique, chunks)
    return existing.unionByName(numbered.select(*existing.columns))


def listing(table: DataFrame) -> DataFrame:
    return table.select("id", "category", "name", "sql_text").orderBy("category", "name", "id")


def delete_keys(table: DataFrame, keys: DataFrame | Iterable[int], id_col: str = "id") -> DataFrame:
    """The table without the rows of the given ids: a short list or a frame with ``id_col``."""
    if isinstance(keys, DataFrame):
        return table.join(keys.select(id_col).distinct(), id_col, "left_anti").select(*table.columns)
    return table.where(~F.col(id_col).isin(list(keys)))


def export_definitions(table: DataFrame, path: str) -> None:
    """Newline-delimited JSON without ids, sorted by category and name."""
    (table.select("category", "name", "sql_text").orderBy("category", "name", "sql_text")
     .write.option("ignoreNullFields", False).json(path))


def import_definitions(existing: DataFrame, path: str, unique: bool = False, multi_line: bool = False,
                       chunks: int | None = None) -> DataFrame:
    """The table after importing an export; imported rows get fresh ids.

    No column of the table may be null: a definition without category, name or text stops the import.
    """
    rows = read_definitions(existing.sparkSession, path, multi_line)
    given = [F.coalesce(c, F.raise_error(F.lit(f"a definition without {c}"))).alias(c) for c in rows.columns]
    return append_with_ids(existing, rows.select(*given), unique=unique, chunks=chunks)


def read_definitions(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """An export as rows. Columns are found by name. With ``multi_line`` each file holds one array. A line that is no
    definition stops the import."""
    return spark.read.schema("category string, name string, sql_text string").options(
        mode="FAILFAST", multiLine=multi_line).json(path)


def categories(table: DataFrame) -> DataFrame:
    return table.select("category").distinct().orderBy("category")


def category_tree(table: DataFrame, chunks: int | None = None) -> DataFrame:
    """Each entry with its place in its category, names in order.

    Entries stay rows: a category may hold a third of the table, too much for one list.
    """
    return running_count(
        table.select("category", "name", "id"), ["category"], ["name", "id"], "position", chunks=chunks)
