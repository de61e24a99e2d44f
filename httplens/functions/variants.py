"""Reading text out of chat-completion JSON held as VARIANT."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from httplens.functions.strings import not_blank

def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` worked out once, however often it is mentioned."""
    return F.transform(F.array(value), body)[0]


def _get(node: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(node, path, kind)


def _is_text(node: Column) -> Column:
    return F.schema_of_variant(node) == "STRING"


def _is_list(node: Column) -> Column:
    return F.schema_of_variant(node).startswith("ARRAY")


def _present(node: Column) -> Column:
    return node.isNotNull() & ~F.is_variant_null(node)


def _text(node: Column) -> Column:
    return _get(node, "$", "string")


def _either(node: Column, first: str, second: str) -> Column:
    """The first of two members that is there and not null."""
    return let(_get(node, f"$.{first}"), lambda m: F.when(_present(m), m).otherwise(_get(node, f"$.{second}")))


def _objects(node: Column) -> Column:
    """How many objects a node can hold inside each other: as often as its JSON opens one."""
    json = F.to_json(node)
    opened = F.length(json) - F.length(F.replace(json, F.lit("{"), F.lit("")))
    return F.when(_is_text(node), 0).otherwise(opened)


def node_text(node: Column) -> Column:
    """The text of a node: a string itself, or what its ``value`` or else ``text`` holds, however deep."""
    def inmost(n: Column) -> Column:
        return F.aggregate(
            F.array_repeat(F.lit(0), _objects(n)), n, lambda at, _: F.coalesce(_either(at, "value", "text"), at))
    return let(let(node, inmost), lambda n: F.when(_is_text(n), _text(n)).otherwise(""))


def _part_text(part: Column) -> Column:
    return F.when(_is_text(part), _text(part)).otherwise(node_text(_either(part, "text", "value")))


def _join_lines(texts: Column) -> Column:
    return F.array_join(F.filter(texts, not_blank), "\n")


def message_content(content: Column) -> Column:
    """A message's content: a string, a list of parts (one per line), or one part."""
    parts = F.when(_is_list(content), _get(content, "$", "array<variant>")).otherwise(F.array(content))
    return _join_lines(F.transform(parts, _part_text))


def first_not_blank(*texts: Column) -> Column:
    return F.get(F.filter(F.array(*texts), not_blank), F.lit(0))


def _output_contents(root: Column) -> Column:
    items = F.filter(
        _get(root, "$.output", "array<variant>"),
        lambda item: _get(item, "$.type", "string") == "message")
    return F.transform(F.coalesce(items, F.array().cast("array<variant>")), lambda item: _get(item, "$.content"))


def reply_content(root: Column) -> Column:
    """The reply text from any of the known response shapes; NULL where there is none."""
    plain = F.transform(
        F.array(_get(root, "$.output_text"), _get(root, "$.choices[0].text")), lambda n: node_text(n))
    messages = F.transform(
        F.concat(F.array(_get(root, "$.choices[0].message.content"), _get(root, "$.message.content")),
                 _output_contents(root)), message_content)
    return let(F.struct(plain.alias("p"), messages.alias("m")), lambda t: first_not_blank(
        t["p"][0], t["m"][0], t["p"][1],
        _join_lines(F.slice(t["m"], 3, F.size(t["m"]))), t["m"][1]))


def has_error(root: Column) -> Column:
    return let(_get(root, "$.error"), _present)


def error_message(root: Column, *, whole_error: bool = False) -> Column:
    """The first non-blank of error.message, message, detail and, if asked, error itself."""
    places = ["$.error.message", "$.message", "$.detail"] + (["$.error"] if whole_error else [])
    nodes = F.array(*[_get(root, p) for p in places])
    return F.get(F.filter(F.transform(nodes, lambda n: node_text(n)), not_blank), F.lit(0))
