"""WARC archives with a two-level capture index.

Archives are written by Spark's text writer, a record per row, the record separator as line separator; they are plain
WARC 1.0 files on any file system Spark writes to. Of records with equal payloads the one with the
smallest id is a response, the others are revisits that refer to it.

The index sorts captures by reversed-host URL key (``com,example)/path``) and record id, and cuts them into compressed
blocks. A sparse directory keeps the first key of each block. A lookup searches the directory, opens only the
blocks found, searches in them, and reads only the byte ranges they name.

Tasks open archives themselves and read by offset, a record at a time, wherever pyarrow knows the store (local and mounted
folders, HDFS, S3, GCS): neither whole files nor payloads are moved between tasks. Of other stores Spark hands
a task the whole file, at most ``max_records`` records, joined to its ranges. The directory is searched by sorting it together with
the places wanted; none of it is collected.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import zlib
from collections.abc import Iterator
from itertools import islice
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from httplens.llm.text import released
from httplens.operators.ordered import in_chunks
from httplens.session import stage

BLOCK_LINES = 300
_AHEAD = 1 << 20

# Fixed values of the format.
END = "\r\n\r\n"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
_URN = "urn:page:"

RECORD = (
    "record_id string, record_type string, refers_to string, url string, payload_digest string, payload_bytes long, payload binary")
CAPTURE = f"file string, offset long, length long, {RECORD.removesuffix(', payload binary')}"


def sha1_base32(payload: Column) -> Column:
    """SHA-1 of a text's bytes in upper-case base32."""
    hex_digits = F.sha1(payload)
    groups = [F.conv(F.substring(hex_digits, 1 + 5 * k, 5), 16, 10).cast("int") for k in range(8)]
    return F.concat(*[
        F.substring(F.lit(_BASE32), F.shiftright(g, by).bitwiseAND(F.lit(31)) + 1, F.lit(1))
        for g in groups for by in (15, 10, 5, 0)])


# --- writing ---------------------------------------------------------------------------


def records(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html",
            min_revisit_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """The record of each page as text, without its end.

    Payloads of at least ``min_revisit_bytes`` that are equal to one of a smaller key become revisits. A null
    payload is empty; a null url is left out; line ends in urls are percent-encoded. A null key is written as
    ``null``, is larger than all others and not referred to; rows that share the smallest key are all responses.
    """
    own = pages.select(
        F.col(key).cast("long").alias("id"), F.col(url).alias("url"), F.coalesce(F.col(payload), F.lit("")).alias("payload"))
    own = own.withColumn("same", F.unhex(F.sha2("payload", 256))).withColumn("bytes", F.octet_length("payload"))
    # Who refers to whom is found on narrow rows, written so that Spark knows their size. The payloads themselves
    # are shuffled only where the revisits are too many for Spark to broadcast by its own size check.
    sent = own.where(F.col("bytes") >= min_revisit_bytes).select("id", "same")
    first = sent.where("id IS NOT NULL").groupBy("same").agg(F.min("id").alias("refers_to"))
    again = stage(sent.join(first, "same").where("id IS NULL OR id > refers_to").distinct().select(
        F.col("id").alias("again_id"), F.col("same").alias("again_same"), "refers_to"), "revisits")
    own = own.join(again, (F.col("same") == F.col("again_same")) & F.col("id").eqNullSafe(F.col("again_id")), "left")
    revisits = F.col("refers_to").isNotNull()
    address = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("bytes").cast("string"), F.lit(END))
    block = F.when(revisits, http).otherwise(F.concat(http, "payload"))
    digest = F.concat(F.lit("sha1:"), sha1_base32(F.col("payload")))
    name = F.coalesce(F.col("id").cast("string"), F.lit("null"))
    lines = [
        F.lit("WARC/1.0"),
        F.concat(F.lit("WARC-Type: "), F.when(revisits, "revisit").otherwise("response")),
        F.concat(F.lit(f"WARC-Record-ID: <{_URN}"), name, F.lit(">")),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), address),
        F.concat(F.lit(f"WARC-Profile: {_PROFILE}\r\nWARC-Refers-To: <{_URN}"), F.col("refers_to").cast("string"), F.lit(">")),
        F.concat(F.lit("WARC-Payload-Digest: "), digest),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return own.select(F.concat(F.concat_ws("\r\n", *lines), F.lit(END), block).alias("value"))


def write_archives(pages: DataFrame, path: str, max_records: int = 10_000, **options) -> None:
    """The records of ``pages`` as archive files of at most ``max_records`` each."""
    records(pages, **options).write.option("lineSep", END).option("maxRecordsPerFile", max_records).text(path)


# --- reading ---------------------------------------------------------------------------


def _headers(data: bytes, at: int) -> tuple[dict[str, str], int]:
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")[1:]
    return {name.lower(): value for name, value in (line.split(": ", 1) for line in lines)}, end + 4


def _records_in(data: bytes) -> Iterator[tuple[int, int]]:
    """Offset and length of each record, its end included."""
    at = 0
    while at < len(data):
        headers, body = _headers(data, at)
        end = body + int(headers["content-length"])
        if data[end:end + 4] != b"\r\n\r\n":
            raise ValueError(f"no record end at byte {end}")
        yield at, end + 4 - at
        at = end + 4


def _urn(value: str | None) -> str | None:
    return value[1 + len(_URN):-1] if value else None


def parse_record(data: bytes, whole: bool = True) -> tuple:
    """What :data:`RECORD` lists of one record; a response's digest and length are checked against its payload.

    Without ``whole`` only headers are read, and the payload is left out.
    """
    headers, body = _headers(data, 0)
    http, start = _headers(data, body)
    size, digest = int(http["content-length"]), headers["warc-payload-digest"].removeprefix("sha1:")
    payload = None
    if whole and headers["warc-type"] == "response":
        payload = data[start:body + int(headers["content-length"])]
        if len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"damaged record {headers['warc-record-id']}")
    return (_urn(headers["warc-record-id"]), headers["warc-type"], _urn(headers.get("warc-refers-to")),
            headers.get("warc-target-uri"), digest, size, payload)


def _rows(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else ([] for _ in schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


_KINDS = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "int": pa.int32()}


def _arrow(ddl: str) -> pa.Schema:
    return pa.schema([(name, _KINDS[kind]) for name, kind in (c.split(" ") for c in ddl.split(", "))])


def files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option(
        "pathGlobFilter", "part-*").load(path).select(F.col("path").alias("file"), "content")


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The store a file lies in, and its path there."""
    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def _has_ranges(archives: DataFrame) -> bool:
    """Whether tasks can read ranges of the files themselves. Where they cannot, Spark hands them whole files."""
    some = archives.select("file").head()
    try:
        return some is None or _store(some.file) is not None
    except (pa.ArrowException, ImportError, OSError):
        return False


class _Archive:
    """Reads of a file by offset, a little ahead."""

    def __init__(self, file: str):
        store, path = _store(file)
        self.source = store.open_input_file(path)
        self.size, self.data, self.at = self.source.size(), b"", 0

    def read(self, at: int, size: int) -> bytes:
        if not self.at <= at <= at + size <= self.at + len(self.data):
            self.at, self.data = at, self.source.read_at(max(size, _AHEAD), at)
        return self.data[at - self.at:at - self.at + size]

    def headers(self, at: int) -> tuple[bytes, int]:
        """The header lines at a place, and where they end."""
        size = 1 << 10
        while (end := self.read(at, min(size, self.size - at)).find(b"\r\n\r\n")) < 0:
            if at + size >= self.size:
                raise ValueError(f"no end of headers after byte {at}")
            size *= 4
        return self.read(at, end + 4), at + end + 4


def _heads_in(file: str) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and both headers of each record; payloads are skipped."""
    archive, at = _Archive(file), 0
    while at < archive.size:
        head, body = archive.headers(at)
        end = body + int(_headers(head, 0)[0]["content-length"])
        if archive.read(end, 4) != b"\r\n\r\n":
            raise ValueError(f"no record end at byte {end}")
        yield at, end + 4 - at, head + archive.headers(body)[0]
        at = end + 4


def captures(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives: where it is and what its headers say. A task holds one record's headers at a time."""
    schema = _arrow(CAPTURE)

    def whole(batches):
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = content.as_buffer().to_pybytes()
                yield _rows([(file, at, n, *parse_record(data[at:at + n], whole=False)[:-1]) for at, n in _records_in(data)], schema)

    def heads(batches):
        for batch in batches:
            for file in batch.column(0).to_pylist():
                found = ((file, at, n, *parse_record(head, whole=False)[:-1]) for at, n, head in _heads_in(file))
                while some := list(islice(found, 1000)):
                    yield _rows(some, schema)

    archives = files(spark, path)
    if _has_ranges(archives):
        return archives.select("file").mapInArrow(released(heads), CAPTURE)
    return archives.mapInArrow(released(whole), CAPTURE)


# --- the index -----------------------------------------------------------------------------


def url_key(url: str | None) -> str:
    """The reversed host, then path and query: ``com,example)/a?b``; other texts stay as they are.

    Line ends are percent-encoded as in records, so that a page's own url finds its record.
    """
    if not url:
        return ")"
    url = url.replace("\r", "%0D").replace("\n", "%0A")
    try:
        parts = urlsplit(url)
        host = parts.hostname
        port = parts.port
    except ValueError:
        host = None
    if not host:
        return url
    reversed_host = ",".join(reversed(host.split(".")))
    place = f":{port}" if port else ""
    query = f"?{parts.query}" if parts.query else ""
    return f"{reversed_host}{place}){parts.path or '/'}{query}"


def _url_keys(url: str) -> Column:
    def keys(urls: pa.Array) -> pa.Array:
        return pa.array([url_key(u) for u in urls.to_pylist()], pa.string())

    return F.arrow_udf(keys, "string")(url)


# Keys are compared byte by byte, in Spark and in Python alike.
def _bytes(key: str, record: str) -> bytes:
    return key.encode() + b"\0" + record.encode()


def write_index(found: DataFrame, path: str, block_lines: int = BLOCK_LINES) -> None:
    """The capture index of ``found`` (see :func:`captures`): ``blocks`` and the sparse ``directory``."""
    keyed = found.select(
        _url_keys("url").alias("key"), F.coalesce("record_id", F.lit("")).alias("record"), "file", "offset", "length")
    ordered = keyed.repartitionByRange("key", "record", "file", "offset").sortWithinPartitions("key", "record", "file", "offset")
    schema = _arrow("first binary, n int, data binary")

    def cut(batches):
        lines, first = [], None
        for batch in batches:
            for key, record, file, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                first = first if lines else _bytes(key, record)
                lines.append(f"{key.encode().hex()} {record.encode().hex()} {offset} {length} {file}")
                if len(lines) == block_lines:
                    yield _rows([(first, len(lines), zlib.compress("\n".join(lines).encode()))], schema)
                    lines = []
        if lines:
            yield _rows([(first, len(lines), zlib.compress("\n".join(lines).encode()))], schema)

    blocks = ordered.mapInArrow(released(cut), "first binary, n int, data binary").withColumn("block", F.monotonically_increasing_id())
    blocks.write.parquet(f"{path}/blocks")
    spark = found.sparkSession
    spark.read.parquet(f"{path}/blocks").select("first", "block").write.parquet(f"{path}/directory")


def _lines(data: bytes) -> list[tuple[bytes, str, int, int]]:
    found = []
    for line in zlib.decompress(data).decode().split("\n"):
        key, record, offset, length, file = line.split(" ", 4)
        found.append((bytes.fromhex(key) + b"\0" + bytes.fromhex(record), file, int(offset), int(length)))
    return found


def _blocks_of(wanted: DataFrame, path: str) -> DataFrame:
    """The blocks each wanted place can be in: the last that begins before it, and all that begin with it.

    Places and directory are sorted together into chunks; what crosses from chunk to chunk is one block number each.
    """
    directory = wanted.sparkSession.read.parquet(f"{path}/directory").select(F.col("first").alias("place"), "block")
    both = wanted.select("place", F.lit(None).cast("long").alias("block"), F.lit(0).alias("kind")).unionByName(
        directory.withColumn("kind", F.lit(1)))
    placed = in_chunks(both, ["place", "kind", "block"])
    here = F.last("block", ignorenulls=True).over(
        Window.partitionBy("_chunk").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0))
    last = F.max_by("block", F.when(F.col("block").isNotNull(), F.col("_pos")))
    # One row per chunk, at most as many as there are partitions: safe to broadcast.
    before = placed.groupBy("_chunk").agg(last.alias("last")).select("_chunk", F.last("last", ignorenulls=True).over(
        Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    below = placed.withColumn("here", here).where("kind = 0").join(F.broadcast(before), "_chunk").select(
        "place", F.coalesce("here", "carried").alias("block")).where("block IS NOT NULL")
    return below.unionByName(wanted.join(directory, "place").select("place", "block"))


def _beside(held: DataFrame, wanted: DataFrame, by: str) -> DataFrame:
    """Both tables in one, rows of a ``by`` together, the held row first."""
    both = held.withColumn("asks", F.lit(0)).unionByName(wanted.withColumn("asks", F.lit(1)), allowMissingColumns=True)
    return both.repartition(by).sortWithinPartitions(by, "asks")


def lookup(wanted: DataFrame, archives: str, index: str, url: str = "url", record: str = "record_id") -> DataFrame:
    """The records of the wanted (url, record id) pairs, read from their byte ranges; pairs that are not there give no row."""
    spark = wanted.sparkSession
    place = F.concat(F.encode(F.col("key"), "UTF-8"), F.lit(b"\0"), F.encode(F.col("record"), "UTF-8"))
    asked = wanted.select(
        _url_keys(url).alias("key"), F.coalesce(F.col(record), F.lit("")).alias("record")).select(place.alias("place")).distinct()
    found = _blocks_of(asked, index)
    blocks = spark.read.parquet(f"{index}/blocks").select("block", "data")
    ranges_schema = _arrow("file string, offset long, length long")

    def search(batches):
        current, lines, keys = None, [], []
        for batch in batches:
            out = []
            for block, data, asks, place in zip(*(batch.column(c).to_pylist() for c in ("block", "data", "asks", "place"))):
                if not asks:
                    current, lines = block, _lines(data)
                    keys = [line[0] for line in lines]
                elif block == current:
                    for k in range(bisect.bisect_left(keys, place), bisect.bisect_right(keys, place)):
                        out.append(lines[k][1:])
            yield _rows(out, ranges_schema)

    ranges = _beside(blocks, found, "block").mapInArrow(released(search), "file string, offset long, length long")
    found_in = stage(ranges.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("ranges")), "ranges")
    record_schema = _arrow(RECORD)

    def whole(batches):
        for batch in batches:
            for content, places in zip(batch.column("content"), batch.column("ranges")):
                data = memoryview(content.as_buffer())
                yield _rows([parse_record(bytes(data[r["offset"]:r["offset"] + r["length"]])) for r in places.as_py()], record_schema)

    def read(batches):
        for batch in batches:
            for file, places in zip(batch.column(0).to_pylist(), batch.column(1)):
                archive, out, held = _Archive(file), [], 0
                for place in places.as_py():
                    out.append(parse_record(archive.read(place["offset"], place["length"])))
                    held += place["length"]
                    if held >= _AHEAD:
                        yield _rows(out, record_schema)
                        out, held = [], 0
                yield _rows(out, record_schema)

    contents = files(spark, archives)
    if _has_ranges(contents):
        return found_in.mapInArrow(released(read), RECORD)
    return contents.join(found_in, "file").select("content", "ranges").mapInArrow(released(whole), RECORD)
