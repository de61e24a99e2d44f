"""Text functions against plain Python."""

import random
import re

import pytest
from hypothesis import given, settings, strategies as st

from httplens import patterns as P
from httplens.functions import strings
from httplens.functions.match import any_of
from pyspark.sql import functions as F

PATTERNS = {name: value for name, value in vars(P).items()
            if name.isupper() and isinstance(value, str) and ("|" in value or name in ("NUMERIC_SEGMENT",))
            and name != "SQL_BLOCK"}


def texts(pattern, seed):
    """Random texts with pieces of the pattern in them, whole and broken."""
    rng = random.Random(seed)
    pieces = [re.sub(r"\\(.)", r"\1", a) for a in pattern.split("|")]
    pieces += ["union all select", "drop  table", "exec (", "or 1 = 1", "10.20.", "172.16.", ";  --", "\n", "\r", "union\r \u2028select", "é", "😀"]
    for _ in range(120):
        chosen = [rng.choice(pieces) for _ in range(rng.randint(0, 3))]
        noise = ["".join(rng.choice("abct.=/ 1%") for _ in range(rng.randint(0, 6))) for _ in range(3)]
        text = "".join(x for pair in zip(noise, chosen + [""] * 3) for x in pair)
        yield text if rng.random() < .7 else text[1:-1]


@pytest.mark.parametrize("name", sorted(PATTERNS))
def test_any_of_is_the_regular_expression(spark, name):
    pattern = PATTERNS[name]
    rows = list(dict.fromkeys(texts(pattern, name)))
    df = spark.createDataFrame([(t,) for t in rows], "t string")
    found = {r["t"]: r["hit"] for r in df.select("t", any_of(F.col("t"), pattern).alias("hit")).collect()}
    assert found == {t: re.search(pattern, t) is not None for t in rows}


def test_any_of_guard_leaves_out_optional_text(spark):
    df = spark.createDataFrame([("ac",), ("abbc",), ("a.c",), ("bc",)], "t string")
    hits = [r[0] for r in df.select(any_of(F.col("t"), r"ab*c|a\.?c")).collect()]
    assert hits == [True, True, True, False]


def apply(spark, function, values):
    df = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    return [r[1] for r in df.select("i", function(F.col("t"))).orderBy("i").collect()]


AWKWARD = ["", " ", " a ", "\t\n a b \u2003", "a\x0bb", "\x1f a \x1f", "x" * 110, "x" * 111, "a  " * 60, "é😀 " * 50,
           "back\\slash \"quote\"\n\r\t", "1a22b333", "no digits", "/v1/users/42"]

JAVA_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2008\u2009\u200a\u2028\u2029\u205f\u3000"


def test_strip(spark):
    assert apply(spark, strings.strip, AWKWARD) == [t.strip(JAVA_SPACE) for t in AWKWARD]


def test_preview(spark):
    def plain(t):
        line = re.sub(r"[ \t\n\x0b\f\r]+", " ", t).strip("".join(map(chr, range(33))))
        return line[:107] + "…" if len(line) > 110 else line
    assert apply(spark, strings.preview, AWKWARD) == [plain(t) for t in AWKWARD]


def test_first_number(spark):
    assert apply(spark, strings.first_number_to_id, AWKWARD) == [
        re.sub(r"[0-9]+", "{id}", t, count=1) for t in AWKWARD]


def plain_header_json(headers):
    def escape(s):
        return (s.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n")
                .replace("\r", "\\r").replace("\t", "\\t"))
    return "{" + ",".join(f'"{escape(n)}":"{escape(v)}"' for n, v in headers) + "}"


header_text = st.text(alphabet='ab\\"\n\r\t\x01é:,{}', max_size=6)


@settings(max_examples=3, deadline=None)
@given(st.lists(st.lists(st.tuples(header_text, header_text), max_size=4), min_size=30, max_size=60))
def test_header_json(spark, lists):
    df = spark.createDataFrame(
        [(i, h) for i, h in enumerate(lists)], "i int, h array<struct<name:string,value:string>>")
    got = [r[1] for r in df.select("i", strings.header_json(F.col("h"))).orderBy("i").collect()]
    assert got == [plain_header_json(h) for h in lists]


def test_message_text(spark):
    df = spark.createDataFrame(
        [(0, "{}", "b"), (1, "{}", ""), (2, None, None), (3, "", "b"), (4, "{}", None)], "i int, h string, b string")
    got = [r[1] for r in df.select("i", strings.message_text(F.col("h"), F.col("b"))).orderBy("i").collect()]
    assert got == ["{}\r\n\r\nb", "{}", "", "\r\n\r\nb", "{}"]
