"""SQL blocks in Markdown and the shapes of response JSON."""

import json
import re

import pytest
from pyspark.sql import functions as F

from httplens import patterns as P
from httplens.operators import replies

FENCE = "```"
MARKDOWN = {
    "tagged": f"Try:\n{FENCE}sql\nSELECT 1\n{FENCE}",
    "untagged": f"{FENCE}\nSELECT host FROM traffic\n{FENCE}",
    "upper": f"{FENCE}SQL  \t\nselect 2\n{FENCE}",
    "two": f"{FENCE}sql\nSELECT 1\n{FENCE}\nand\n{FENCE}\nWITH x AS (SELECT 2) TABLE x\n{FENCE}",
    "bash": f"{FENCE}bash\nls\n{FENCE}\nrows FROM here\n{FENCE}sql\nSELECT 1\n{FENCE}",
    "shell": f"{FENCE}\ncurl -X GET /x\n{FENCE}",
    "tagged but not sql": f"{FENCE}sql\njust words\n{FENCE}",
    "blank": f"{FENCE}sql\n   \n{FENCE}",
    "prose": "SELECT is a keyword",
    "open": f"{FENCE}sql\nSELECT 1",
    "lines": f"{FENCE}\nx\nFROM y\n{FENCE}",
    "windows": f"{FENCE}sql\r\nSELECT 1\r\n{FENCE}",
    "empty": "",
    "null": None,
}


def plain_blocks(text):
    found = []
    for block in re.findall(P.SQL_BLOCK, text or ""):
        block = block.strip()
        upper = block.upper()
        if block and (upper.startswith(P.SQL_STARTS) or any(m in upper for m in P.SQL_MARKERS)):
            found.append(block)
    return found


def test_blocks(spark):
    df = spark.createDataFrame(list(MARKDOWN.items()), "name string, md string")
    got = {}
    for r in replies.extract_sql_blocks(df, "md").orderBy("name", "block_no").collect():
        got.setdefault(r["name"], []).append((r["block_no"], r["sql_text"]))
    assert got == {n: list(enumerate(plain_blocks(t))) for n, t in MARKDOWN.items() if plain_blocks(t)}
    assert got["bash"] == [(0, "rows FROM here")]
    assert got["two"][1] == (1, "WITH x AS (SELECT 2) TABLE x")


@pytest.mark.parametrize("sql,category", [
    ("SELECT * FROM traffic WHERE status_code = 401", "Authentication"),
    ("select * from traffic where path like '%login%'", "Authentication"),
    ("SELECT id FROM traffic WHERE status_code >= 500", "Errors & Leakage"),
    ("SELECT req_body FROM traffic", "Input Surface"),
    ("SELECT id FROM traffic WHERE path LIKE '%<script%'", "Security"),
    ("SELECT host FROM traffic", "Recon"),
    ("SELECT id FROM traffic LIMIT 1", "AI Generated"),
    ("SELECT count(*), 'post' FROM traffic", "Input Surface"),
])
def test_category(spark, sql, category):
    df = spark.createDataFrame([(sql,)], "t string")
    assert df.select(replies.classify(F.col("t"))).first()[0] == category


CHAT = [
    ({"output_text": "hi"}, "hi", None),
    ({"output_text": {"value": "hi"}}, "hi", None),
    ({"output_text": {"text": {"value": {"text": "deep"}}}}, "deep", None),
    ({"output_text": " ", "choices": [{"text": "t"}]}, "t", None),
    ({"choices": [{"message": {"content": "a \"q\"\n\té"}}]}, "a \"q\"\n\té", None),
    ({"choices": [{"message": {"content": "[not a list]"}}]}, "[not a list]", None),
    ({"choices": [{"message": {"content": [{"text": "a"}, "b", {"value": "c"}, {"text": ""}, None, 5, {"x": 1}]}}]},
     "a\nb\nc", None),
    ({"choices": [{"message": {"content": {"text": {"value": "v"}}}}]}, "v", None),
    ({"choices": [{"message": {"content": {"text": None, "value": "v"}}}]}, "v", None),
    ({"choices": [{"message": {"content": None}, "text": "legacy"}]}, "legacy", None),
    ({"choices": [{"message": {"content": "first"}}, {"message": {"content": "second"}}]}, "first", None),
    ({"output": [{"type": "reasoning", "content": "no"}, {"type": "message", "content": [{"text": "x"}, {"text": "y"}]},
                 {"type": "message", "content": ""}, {"type": "message", "content": "z"}]}, "x\ny\nz", None),
    ({"message": {"content": "m"}}, "m", None),
    ({"error": None, "message": {"content": "m"}}, "m", None),
    ({"error": {"message": "boom"}, "output_text": "x"}, None, "API error: boom"),
    ({"error": "plain", "detail": "d"}, None, "API error: d"),
    ({"error": {"code": 1}}, None, 'API error: {"error": {"code": 1}}'),
    ({"error": False}, None, 'API error: {"error": false}'),
    ({}, None, "No text content in response: {}"),
    ({"choices": []}, None, 'No text content in response: {"choices": []}'),
    ({"choices": "x", "output": "y", "message": "z"}, None,
     'No text content in response: {"choices": "x", "output": "y", "message": "z"}'),
    ([], None, "No text content in response: []"),
    ({"output_text": 5}, None, 'No text content in response: {"output_text": 5}'),
]


def test_chat_responses(spark):
    rows = [(i, json.dumps(body, ensure_ascii=False)) for i, (body, _, _) in enumerate(CHAT)]
    rows += [(100, "not json"), (101, ""), (102, None)]
    df = spark.createDataFrame(rows, "i int, json string")
    got = {r["i"]: (r["content"], r["error"]) for r in replies.normalize_chat_response(df, "json").collect()}
    for i, (_, content, error) in enumerate(CHAT):
        assert got[i] == (content, error), CHAT[i]
    assert got[100] == (None, "No text content in response: not json")
    assert got[101] == got[102] == (None, "No text content in response: ")


def wrapped(text, times):
    for i in range(times):
        text = {"value": text} if i % 2 else {"text": text, "annotations": [{"n": {}}]}
    return text


@pytest.mark.parametrize("times", [*range(1, 13), 90])
def test_texts_wrapped_again_and_again(spark, times):
    text = wrapped("in {the} middle", times)
    bodies = [{"output_text": text}, {"message": {"content": [text, "end"]}}, {"error": {"message": text}}]
    df = spark.createDataFrame([(i, json.dumps(b)) for i, b in enumerate(bodies)], "i int, json string")
    got = {r["i"]: (r["content"], r["error"]) for r in replies.normalize_chat_response(df, "json").collect()}
    assert got == {0: ("in {the} middle", None), 1: ("in {the} middle\nend", None), 2: (None, "API error: in {the} middle")}


@pytest.mark.parametrize("body,message", [
    ('{"error": {"message": "m"}, "message": "n"}', "m"),
    ('{"error": {"message": " "}, "message": "n"}', "n"),
    ('{"detail": {"text": "d"}}', "d"),
    ('{"error": "e"}', "e"),
    ('{"error": {"value": "v"}}', "v"),
    ('{"x": 1}', '{"x": 1}'),
    ("<html>", "<html>"),
    ("", "(empty response body)"),
    ("  \n", "(empty response body)"),
    (None, "(empty response body)"),
])
def test_http_errors(spark, body, message):
    df = spark.createDataFrame([(502, body)], "status int, body string")
    assert replies.http_error(df, "status", "body").first()["error"] == f"HTTP 502: {message}"
