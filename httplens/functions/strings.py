"""Small string expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from httplens import patterns as P


def first_number_to_id(column: Column) -> Column:
    """Replace the first run of digits, wherever it is, by ``{id}``."""
    return F.regexp_replace(column, r"^([^0-9]*)[0-9]+", "$1{id}")


# Every character that Java counts as white space: also what a blank text may consist of.
WHITE_SPACE = "".join(map(chr, (
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x1680, *range(0x2000, 0x2007), *range(0x2008, 0x200B),
    0x2028, 0x2029, 0x205F, 0x3000)))
CONTROL_AND_SPACE = "".join(map(chr, range(0x21)))


def strip(column: Column) -> Column:
    """Cut white space of any kind from both ends."""
    return F.btrim(column, F.lit(WHITE_SPACE))


def not_blank(column: Column) -> Column:
    return column.rlike(r"\P{javaWhitespace}")


def preview(column: Column) -> Column:
    """One line of at most 108 characters: white space collapsed, the rest cut with an ellipsis."""
    # Single spaces, by far the most white space, are left alone.
    spaced = F.regexp_replace(column, r"[\t\n\x0B\f\r]\s*| \s+", " ")
    line = F.btrim(spaced, F.lit(CONTROL_AND_SPACE))
    return F.when(
        F.length(line) > P.PREVIEW_LENGTH,
        F.concat(F.substring(line, 1, P.PREVIEW_KEPT), F.lit("…")),
    ).otherwise(line)


def json_escape(column: Column) -> Column:
    """Escape backslash, quote, newline, return and tab; the backslash has to go first."""
    for plain, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        column = F.replace(column, F.lit(plain), F.lit(escaped))
    return column


def header_json(headers: Column) -> Column:
    """A list of (name, value) as JSON object text, in order and with repeated names kept."""
    members = F.transform(headers, lambda h: F.concat(
        F.lit('"'), json_escape(F.coalesce(h["name"], F.lit(""))),
        F.lit('":"'), json_escape(F.coalesce(h["value"], F.lit(""))), F.lit('"')))
    return F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}"))


def message_text(headers: Column, body: Column) -> Column:
    """Header text, blank line, body; only the headers where the body is empty."""
    headers = F.coalesce(headers, F.lit(""))
    body = F.coalesce(body, F.lit(""))
    return F.when(body == "", headers).otherwise(F.concat(headers, F.lit("\r\n\r\n"), body))
