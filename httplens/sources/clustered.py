"""The traffic table clustered by id, with a directory of what each file can hold.

Rows are written without their response bodies, which stand beside them, about once each whatever the order of the rows, and are found
by their digest: ``traffic`` is worked out twice, and of rows with equal bodies that with the least id writes it (if the id comes
again, all its rows do; see also :data:`SIGNS`). Bodies are neither shuffled nor sorted. The rows stand in files that are ranges of
ids, sorted, with Parquet Bloom filters on the id. The directory has a row per such file: its least and greatest id, its largest
response and request. It is itself a table: a query asks it for the next few files only, so neither the directory nor the traffic
passes through the driver.

* :func:`messages` opens the files whose range holds the ids asked for, and those with the bodies of these.
* :func:`first_findings` reads files in the order of the result and stops once the limit is full: a rare pattern may need
  all of them, a frequent one a few.
* :func:`largest_findings` reads files by their largest value and stops once no file can hold a row that belongs
  to the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from httplens.operators.ingest import SENT_BITMAPS, kept_at, place, within
from httplens.operators.lookup import message_detail
from httplens.plans.rules import RULES, Rule, order_by
from httplens.schema import BASE, TRAFFIC
from httplens.session import stage

CLUSTERED = T.StructType([*TRAFFIC.fields, T.StructField("req_length", T.IntegerType())])
BODY = "resp_body"
# Of the response body its digest.
POINTING = T.StructType([*[f for f in CLUSTERED.fields if f.name != BODY], T.StructField("_body", T.BinaryType())])
BODIES = T.StructType([T.StructField("_body", T.BinaryType()), T.StructField(BODY, T.StringType())])
PLACES = "_body binary, _file string, _row long"
DIRECTORY = "file string, low long, high long, rows long, resp_length int, req_length int"
FIRST_FILES = 4
# Bytes of a page and of a dictionary of bodies, before compression. Of Parquet's own 1 MB a few hundred bodies take all, so that
# those of one page are hardly ever alike; a dictionary that does not pay is given up after the first page.
BODIES_PAGE = 32 << 20
# Signs for each row: of those that need not write their body, as many as an eighth of the bodies share the sign of one that does.
# From 268 million rows on there are fewer signs for each.
SIGNS = 8

_BY_ID = {rule.id: rule for rule in RULES}


def write_clustered(traffic: DataFrame, path: str, rows_per_file: int = 1_000_000, files: int | None = None) -> None:
    """``traffic`` in ``files`` ranges of ids (as many as there are shuffle partitions), none longer than ``rows_per_file``."""
    spark = traffic.sparkSession
    if not _write_rows(traffic, path, rows_per_file):
        # Rows that are others when worked out again, such as those of a limit without an order.
        _write_rows(stage(traffic, "traffic"), path, rows_per_file, "overwrite")
    rows = spark.read.schema(POINTING).parquet(f"{path}/rows")
    ranges = rows.repartitionByRange(files, "id") if files else rows.repartitionByRange("id")
    _files_of(ranges.sortWithinPartitions("id"), rows_per_file, key="id").parquet(f"{path}/data")
    own = spark.read.schema(POINTING).parquet(f"{path}/data")
    about = own.select(F.col("_metadata.file_path").alias("file"), "id", "resp_length", "req_length").groupBy("file").agg(
        F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("rows"),
        F.max("resp_length").alias("resp_length"), F.max("req_length").alias("req_length"))
    about.write.parquet(f"{path}/directory")


def _write_rows(traffic: DataFrame, path: str, rows_per_file: int, mode: str = "error") -> bool:
    """The rows without bodies as they come, the bodies, and where each stands; whether the bodies of all rows are there."""
    spark = traffic.sparkSession
    digest = F.substring(F.unhex(F.sha2(BODY, 256)), 1, 16)
    narrow = traffic.withColumn("req_length", F.coalesce(F.length("req_body"), F.lit(0))).withColumn("_body", digest)
    _files_of(narrow.select(*POINTING.fieldNames()), rows_per_file, mode).parquet(f"{path}/rows")
    rows = spark.read.schema(POINTING).parquet(f"{path}/rows").where("_body IS NOT NULL")
    first = stage(rows.groupBy("_body").agg(F.min("id").alias("id")), "bodies")
    # No more signs than there are bits to send: every row can be asked without a shuffle, whatever its id.
    signs = max(1, min(SIGNS * rows.count(), SENT_BITMAPS << 15))
    sign = (F.pmod(F.xxhash64("id"), F.lit(signs)) + 1).alias("_sign")
    writing = within(traffic.where(F.col(BODY).isNotNull()).select(BODY, sign), first.select(sign), ("_sign",))
    pages = {"parquet.page.size": str(BODIES_PAGE), "parquet.dictionary.page.size": str(BODIES_PAGE)}
    _files_of(writing.select(digest.alias("_body"), BODY), rows_per_file, mode).options(**pages).parquet(f"{path}/bodies")
    places = spark.read.schema(BODIES).parquet(f"{path}/bodies").select("_body", *place()).groupBy("_body").agg(
        F.min(F.struct("_file", "_row")).alias("_place")).select("_body", "_place.*")
    _files_of(places.sortWithinPartitions("_body"), rows_per_file, mode, "_body").parquet(f"{path}/places")
    return first.join(_places(spark, path), "_body", "left_anti").isEmpty()


def _files_of(df: DataFrame, rows_per_file: int, mode: str = "error", key: str | None = None):
    writer = df.write.mode(mode).option("compression", "zstd").option("maxRecordsPerFile", rows_per_file)
    return writer if key is None else writer.option(f"parquet.bloom.filter.enabled#{key}", "true").option(
        f"parquet.bloom.filter.expected.ndv#{key}", str(rows_per_file))


def load_clustered(spark: SparkSession, path: str) -> DataFrame:
    """The whole rows."""
    return _whole(spark, path, spark.read.schema(POINTING).parquet(f"{path}/rows"))


def _places(spark: SparkSession, path: str) -> DataFrame:
    """A file and a row in it for each body."""
    return spark.read.schema(PLACES).parquet(f"{path}/places")


def _whole(spark: SparkSession, path: str, own: DataFrame, few: bool = False) -> DataFrame:
    """Some rows with their bodies, each of which is read once. The digests of a ``few`` rows are pushed down to the scan."""
    asked, places = own.select("_body").where("_body IS NOT NULL").distinct(), _places(spark, path)
    if few:
        places = places.where(F.col("_body").isin([row["_body"] for row in asked.collect()]))
    else:
        places = places.join(asked, "_body", "left_semi")
    names = [row["_file"] for row in places.select("_file").distinct().orderBy("_file").collect()]
    bodies = kept_at(spark.read.schema(BODIES).parquet(*names), places) if names else spark.createDataFrame([], BODIES)
    return own.join(bodies, "_body", "left").select(*CLUSTERED.fieldNames())


def directory(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DIRECTORY).parquet(f"{path}/directory")


def _files(spark: SparkSession, names: list[str]) -> DataFrame:
    if not names:
        return spark.createDataFrame([], POINTING)
    return spark.read.schema(POINTING).parquet(*names)


def _search(spark: SparkSession, path: str, names: list[str], run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``run`` over the rows of some files; bodies are opened only if it asks for them."""
    own = _files(spark, names)
    try:
        return run(own)
    except AnalysisException as error:
        if BODY not in str(error):
            raise
        return run(_whole(spark, path, own))


def messages(spark: SparkSession, path: str, ids: Iterable[int]) -> DataFrame:
    """Request and response text of a few messages; unknown and null ids give no row."""
    wanted = sorted({i for i in ids if i is not None})
    asked = spark.createDataFrame([(i,) for i in wanted], "id long")
    # As many files as ids at most: safe to collect, and the ids to broadcast.
    held = directory(spark, path).join(F.broadcast(asked), (F.col("id") >= F.col("low")) & (F.col("id") <= F.col("high")))
    names = [row.file for row in held.select("file").distinct().orderBy("file").collect()]
    pointing = _files(spark, names).where(F.col("id").isin(wanted))
    return message_detail(_whole(spark, path, pointing, few=True), wanted)


# --- in the order of the result ----------------------------------------------------------------


def _result(spark: SparkSession, parts: list[DataFrame], empty: DataFrame, order: list[Column], limit: int) -> DataFrame:
    found = empty.limit(0)
    for part in parts:
        found = found.unionByName(part)
    return found.orderBy(*order).limit(limit)


def first_findings(spark: SparkSession, path: str, rule: Rule | str, limit: int | None = None) -> DataFrame:
    """The first ``limit`` findings of a rule in id order, the same rows as of the whole table.

    Files are read in growing groups; the findings of a group, ``limit`` at most, are written to the shared folder, so that no file is
    searched twice. A rule in another order, or without a limit, cannot stop early and is refused.
    """
    rule = _BY_ID[rule] if isinstance(rule, str) else rule
    limit = rule.limit if limit is None else limit
    if rule.order not in (("id",), ("-id",)) or rule.distinct or limit is None:
        raise ValueError(f"{rule.id}: only a limited list in the order of ids can stop early")
    ascending, files = rule.order == ("id",), directory(spark, path)
    side = "low" if ascending else "high"
    order = [order_by(key) for key in rule.order]
    parts, found, at, group = [], 0, None, FIRST_FILES
    while found < limit:
        left = files if at is None else files.where(F.col(side) > at if ascending else F.col(side) < at)
        names = left.orderBy(F.asc(side) if ascending else F.desc(side)).limit(group).select("file", side).collect()
        if not names:
            break
        own = _search(spark, path, [n.file for n in names], lambda df: rule.run(df, limit=limit - found))
        parts.append(stage(own, "findings"))
        found += parts[-1].count()
        at, group = names[-1][side], 2 * group
    return _result(spark, parts, _search(spark, path, [], lambda df: rule.run(df, limit=0)), order, limit)


@dataclass(frozen=True)
class Ranking:
    """A list by a length that the directory knows, largest first and then by id."""

    length: str
    where: Callable[[], Column] | None
    columns: tuple[str, ...]
    limit: int
    name: str | None = None


# The rules that are lists of the largest, and the panel of largest responses.
RANKINGS = {
    "E3": Ranking("resp_length", None, (*BASE, "resp_length"), 20),
    "E5": Ranking("resp_length", _BY_ID["E5"].where, _BY_ID["E5"].columns, 20),
    "D5": Ranking("resp_length", None, ("host", "method", "path", "status_code", "resp_length"), 10),
    "I3": Ranking("req_length", lambda: F.col("req_length") > 0, (*BASE, "req_length"), 50, "body_length"),
}


def largest_findings(spark: SparkSession, path: str, ranking: Ranking | str, limit: int | None = None) -> DataFrame:
    """The rows of a list of the largest, the same as of the whole table; lengths come from the table, no body is read for them."""
    ranking = RANKINGS[ranking] if isinstance(ranking, str) else ranking
    limit, size = ranking.limit if limit is None else limit, ranking.length
    order = [F.desc_nulls_last(size), F.asc("id")]
    kept = list(dict.fromkeys([*ranking.columns, size, "id"]))

    def largest(own: DataFrame) -> DataFrame:
        own = own if ranking.where is None else own.where(ranking.where())
        return own.select(*kept).orderBy(*order).limit(limit)

    def read(names: list[str]) -> DataFrame:
        return _search(spark, path, names, largest)

    best, at, group = stage(read([]), "largest"), None, FIRST_FILES
    files = directory(spark, path).withColumn(size, F.coalesce(size, F.lit(-1)))  # a file without lengths comes last
    while limit:
        left = files
        if at is not None:
            left = left.where((F.col(size) < at[size]) | ((F.col(size) == at[size]) & (F.col("file") > at["file"])))
        names = left.orderBy(F.desc(size), "file").limit(group).select("file", size).collect()
        least = best.agg(F.count("*").alias("n"), F.min(F.coalesce(size, F.lit(-1))).alias("least")).head()
        if least.n >= limit:
            # A file whose largest equals the last place may hold a smaller id.
            names = [n for n in names if n[size] >= least.least]
        if not names:
            break
        best = stage(best.unionByName(read([n.file for n in names])).orderBy(*order).limit(limit), "largest")
        at, group = names[-1], 2 * group
    shown = [F.col(c).alias(ranking.name) if c == size and ranking.name else F.col(c) for c in ranking.columns]
    return best.orderBy(*order).select(*shown)
