"""Traffic made from the test tables ``events`` and ``pages``, chat tables from ``conversations``.

The expressions are plain SQL that Spark and a checking engine read the same way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])

_URL = "^(https?)://([^/]+)(/.*)$"

SITES = {
    "page_id": "page_id",
    "protocol": f"regexp_extract(url, '{_URL}', 1)",
    "host": f"regexp_extract(url, '{_URL}', 2)",
    "page_path": f"regexp_extract(url, '{_URL}', 3)",
    "html_length": "CAST(length(html) AS INT)",
    "html": "html",
}

HITS = {"e": "event_id", "u": "user_id", "t": "event_type", "seen": "CAST(ts AS TIMESTAMP)"}

METHOD = """CASE WHEN t IN ('view', 'click') THEN 'GET' WHEN t = 'signup' THEN 'POST'
    WHEN t = 'purchase' THEN 'PUT' WHEN u % 2 = 0 THEN 'GET' ELSE 'DELETE' END"""

_PATHS = (
    "'/admin/users/' || CAST(u AS STRING)",
    "'/login'",
    "'/api/v1/items/' || CAST(u AS STRING) || '/orders/' || CAST(e % 7 AS STRING)",
    "'/oauth/token?next=/home'",
    "'/debug/trace'",
    "'/.env'",
    "'/upload/file?name=' || CAST(u AS STRING)",
    "'/search?q=%3Cscript%3E'",
    "'/search?q=<script>alert(1)</script>'",
    "'/items?id=1 UNION all select 1'",
    "'/static/../../etc/hosts'",
    "'/static/..%2Fconf'",
    "'/go?url=http://10.1.2.3/x'",
    "'/graphql?query=a?b'",
    "'/internal/health'",
    "'/backup/config.bak'",
    "'/static/2e2e/x'",
    "'/Admin/Staff'",
)

PATH = "CASE e % 40 " + " ".join(f"WHEN {i} THEN {p}" for i, p in enumerate(_PATHS)) + " ELSE page_path END"

STATUS = """CAST(CASE
    WHEN t = 'error' THEN
        CASE e % 5 WHEN 0 THEN 500 WHEN 1 THEN 401 WHEN 2 THEN 403 WHEN 3 THEN 404 ELSE 503 END
    WHEN t = 'click' AND e % 10 = 0 THEN 302 WHEN t = 'signup' THEN 201 ELSE 200 END AS INT)"""

REQ_HEADERS = """CASE e % 6
    WHEN 0 THEN '{"Host":"' || host || '","Authorization":"Bearer t' || CAST(u AS STRING) || '"}'
    WHEN 1 THEN '{"Content-Type":"application/json"}'
    WHEN 2 THEN '{"X-API-Key":"k' || CAST(u AS STRING) || '"}'
    WHEN 3 THEN '{"Content-Type":"multipart/form-data"}'
    WHEN 4 THEN '{"X-CSRF-Token":"c"}' ELSE '{}' END"""

REQ_BODY = f"""CASE WHEN {METHOD} = 'GET' THEN CASE WHEN e % 2 = 0 THEN '' END
    ELSE CASE e % 8 WHEN 0 THEN 'user=a&password=b' WHEN 1 THEN '{{"id":' || CAST(u AS STRING) || '}}'
        WHEN 2 THEN 'q=1 OR 1=1; --' WHEN 3 THEN 'u=http://localhost/x' WHEN 4 THEN '<img onerror=x>'
        WHEN 5 THEN 'drop  table t' WHEN 7 THEN '' END END"""

TRAFFIC = {
    "id": "e",
    "timestamp": "seen",
    "host": "host",
    "port": "CAST(CASE protocol WHEN 'https' THEN 443 ELSE 80 END AS INT)",
    "protocol": "protocol",
    "method": METHOD,
    "path": PATH,
    "status_code": STATUS,
    "req_headers": REQ_HEADERS,
    "req_body": REQ_BODY,
    "resp_headers": "'{\"Content-Type\":\"text/html\"}'",
    "resp_body": "html",
    "resp_length": "html_length",
}

_HEADER = "named_struct('name', '{}', 'value', {})"

# The same exchanges before normalisation. The response repeats a header name and has
# values that need escaping: a quote, a backslash, a tab, a newline and a return.
RAW = {
    "id": "e",
    "ts": "seen",
    "host": "host",
    "port": TRAFFIC["port"],
    "secure": "protocol = 'https'",
    "method": METHOD,
    "path": PATH,
    "status_code": STATUS,
    "req_headers": f"""CASE e % 6
        WHEN 0 THEN array({_HEADER.format('Host', 'host')},
                          {_HEADER.format('Authorization', "'Bearer t' || CAST(u AS STRING)")})
        WHEN 1 THEN array({_HEADER.format('Content-Type', "'application/json'")})
        WHEN 2 THEN array({_HEADER.format('X-API-Key', "'k' || CAST(u AS STRING)")})
        WHEN 3 THEN array({_HEADER.format('Content-Type', "'multipart/form-data'")})
        WHEN 4 THEN array({_HEADER.format('X-CSRF-Token', "'c'")}) ELSE array() END""",
    "req_body": REQ_BODY,
    "resp_headers": f"""array({_HEADER.format('Content-Type', "'text/html'")},
        {_HEADER.format('Set-Cookie', "'u=' || chr(34) || CAST(u AS STRING) || chr(34)")},
        {_HEADER.format('Set-Cookie', "'p=C:' || chr(92) || page_path || chr(9) || t || chr(10) || chr(13)")})""",
    "resp_body": "html",
}

_FENCE = "'```'"
_NL = "chr(10)"


def _lines(*lines: str) -> str:
    return f" || {_NL} || ".join(("text", *lines))


REPLY = f"""CASE (conv_id + turn) % 6
    WHEN 0 THEN {_lines("'Try:'", "'```sql'", "'SELECT host, COUNT(*) FROM traffic GROUP BY host'", _FENCE)}
    WHEN 1 THEN {_lines(_FENCE, "'  SELECT id FROM traffic WHERE status_code >= 500  '", _FENCE)}
    WHEN 2 THEN {_lines(_FENCE, "'curl -X GET /x'", _FENCE)}
    WHEN 3 THEN {_lines("'```SQL  '", "'SELECT * FROM traffic WHERE path = 401'", _FENCE, "'and'", "'```sql'",
                        "'SELECT id FROM traffic LIMIT 1'", _FENCE)}
    WHEN 4 THEN {_lines("'```bash'", "'ls'", _FENCE, "'rows FROM here'", "'```sql'", "'SELECT 1'", _FENCE)}
    ELSE text END"""

# Response bodies around the whole text, which stands as a JSON string in ``q``.
RESPONSE = """CASE conv_id % 9
    WHEN 0 THEN '{"output_text":' || q || '}'
    WHEN 1 THEN '{"choices":[{"message":{"role":"assistant","content":' || q || '}}]}'
    WHEN 2 THEN '{"choices":[{"message":{"content":[{"type":"text","text":' || q || '},"tail",{"value":"end"}]}}]}'
    WHEN 3 THEN '{"choices":[{"text":' || q || '}]}'
    WHEN 4 THEN '{"output":[{"type":"reasoning","content":"skip"},{"type":"message","content":[{"text":'
                || q || '}]},{"type":"message","content":"more"}]}'
    WHEN 5 THEN '{"error":{"message":' || repeat('{"value":', turn % 13) || q || repeat('}', turn % 13) || '}}'
    WHEN 6 THEN '{"message":{"content":' || repeat('{"text":', 1 + (conv_id + turn) % 12) || q
                || repeat('}', 1 + (conv_id + turn) % 12) || '}}'
    WHEN 7 THEN '{}' ELSE 'not json' END"""


def _select(columns: dict[str, str]):
    return [F.expr(sql).alias(name) for name, sql in columns.items()]


def _select_sql(columns: dict[str, str]) -> str:
    return ", ".join(f"{sql} AS {name}" for name, sql in columns.items())


def traffic_cte() -> str:
    """The traffic fixture as common table expressions."""
    return (
        f"hits AS (SELECT {_select_sql(HITS)}, event_id % (SELECT count(*) FROM pages) AS page_no FROM events), "
        f"sites AS (SELECT {_select_sql(SITES)} FROM pages), "
        f"traffic AS (SELECT {_select_sql(TRAFFIC)} FROM hits JOIN sites ON hits.page_no = sites.page_id)")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exchanges(events: DataFrame, pages: DataFrame) -> DataFrame:
    """Each event with its page. The key spreads evenly, and a page side that is small is broadcast."""
    pages_in_all = pages.agg(F.count("*")).scalar()
    hits = events.select(*_select(HITS), (F.col("event_id") % pages_in_all).alias("page_no"))
    sites = pages.select(*_select(SITES))
    return hits.join(sites, F.col("page_no") == F.col("page_id"))


def traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exchanges(table(spark, sf_dir, "events"), table(spark, sf_dir, "pages")).select(*_select(TRAFFIC))


def raw_exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exchanges(table(spark, sf_dir, "events"), table(spark, sf_dir, "pages")).select(*_select(RAW))


def raw_stream(spark: SparkSession, sf_dir: str, inbox: str | None = None) -> DataFrame:
    """The exchanges arriving as a file stream; with ``inbox`` those of the events in its folders."""
    reader = spark.readStream.schema(EVENTS)
    if inbox is None:
        events = reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    else:
        events = reader.option("recursiveFileLookup", True).parquet(inbox)
    return exchanges(events, table(spark, sf_dir, "pages")).select(*_select(RAW))


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant replies as Markdown in ``md``."""
    return table(spark, sf_dir, "conversations").where("role = 'assistant'").select(
        "conv_id", "turn", F.expr(REPLY).alias("md"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn wrapped as the JSON body of a chat service, in one of nine shapes."""
    array = F.to_json(F.array("text"))
    quoted = F.substring(array, F.lit(2), F.length(array) - 2)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", quoted.alias("q")).select(
        "conv_id", "turn", F.expr(RESPONSE).alias("json"))
