"""Column layouts, declared up front so that no read has to infer them."""

from pyspark.sql import types as T

TRAFFIC = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("host", T.StringType()),
    T.StructField("port", T.IntegerType()),
    T.StructField("protocol", T.StringType()),
    T.StructField("method", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("status_code", T.IntegerType()),
    T.StructField("req_headers", T.StringType()),
    T.StructField("req_body", T.StringType()),
    T.StructField("resp_headers", T.StringType()),
    T.StructField("resp_body", T.StringType()),
    T.StructField("resp_length", T.IntegerType()),
])

HEADER_LIST = T.ArrayType(T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("value", T.StringType()),
]))

RAW_EXCHANGE = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("ts", T.TimestampType()),
    T.StructField("host", T.StringType()),
    T.StructField("port", T.IntegerType()),
    T.StructField("secure", T.BooleanType()),
    T.StructField("method", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("status_code", T.IntegerType()),
    T.StructField("req_headers", HEADER_LIST),
    T.StructField("req_body", T.StringType()),
    T.StructField("resp_headers", HEADER_LIST),
    T.StructField("resp_body", T.StringType()),
])

SAVED_QUERIES = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("category", T.StringType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("sql_text", T.StringType(), False),
    T.StructField("created_at", T.TimestampType(), False),
])

BASE = ("id", "host", "method", "path", "status_code")
