"""Repair of conversation structure at the least cost.

A repaired conversation has roles of the form ``(s?(ua)+)?``: an optional system turn, then user and assistant in turn.
Every turn is kept, given another role, or deleted, and empty turns may be inserted. The edits are the edges of a graph
without cycles over (turns read, state of the form).

A weight is one integer. Its high digits are the cost, its low digits the letters of the audit, one digit of
three bits per place, in alphabetical order, with zeros after the last. The smaller of two integers so is the cheaper
path, and of equally cheap ones that whose audit comes first; the integer minimum decides everything. Two audits of one cost
for the same turns are never beginnings of each other, because what is longer has more insertions and those cost. So
the least path to a node stays the least whatever follows. Two inserted turns never stand next to each other
in a cheapest repair: leaving out both is cheaper. So one insertion before each turn and one at the end suffice.

Turns are numbered over the whole table and cut into pieces of :data:`PIECE` numbers, so that a conversation of any
length is spread. A piece gives the least weight from each state to each. Pieces of one conversation are joined 64 at a
time until one is left, its audit is cut into pieces again, and each turn gets its edit from its piece.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from httplens.llm.text import released
from httplens.operators.ordered import number_rows
from httplens.session import stage

PIECE = 256
FAN_IN = 64

# Costs and letters of the edits, states of the form, legal pairs of roles.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
LETTERS = "DIKR"
CODE = {letter: k + 1 for k, letter in enumerate(LETTERS)}
START, SYSTEM, USER, ASSISTANT = range(4)
AFTER = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
PAIRS = ("su", "ua", "au")
SPACE = " \t\n\x0b\x0c\r"
BITS = 3


# --- weights ------------------------------------------------------------------------------


class Weight:
    """Sums of cost and letters in an integer with room for ``width`` letters."""

    def __init__(self, width: int):
        self.width, self.unit = width, 1 << (BITS * width)

    def then(self, value: int, used: int, letter: str, cost: int) -> tuple[int, int]:
        return value + cost * self.unit + (CODE[letter] << (BITS * (self.width - 1 - used))), used + 1

    def used(self, value: int) -> int:
        """The number of letters: all digits but the zeros at the end."""
        letters = value & (self.unit - 1)
        return self.width - ((letters & -letters).bit_length() - 1) // BITS if letters else 0

    def cost(self, value: int) -> int:
        return value >> (BITS * self.width)

    def audit(self, value: int) -> str:
        used = self.used(value)
        return "".join(LETTERS[int(d) - 1] for d in format(
            (value & (self.unit - 1)) >> (BITS * (self.width - used)), "o").zfill(used)) if used else ""


def joined(value: int, width: int, other: int, other_width: int) -> int:
    """The weight of one path followed by another."""
    first, second = Weight(width), Weight(other_width)
    letters = (value & (first.unit - 1)) << (BITS * other_width)
    letters |= (other & (second.unit - 1)) << (BITS * (width - first.used(value)))
    return ((first.cost(value) + second.cost(other)) << (BITS * (width + other_width))) | letters


Table = dict[tuple[int, int], int]


def _least(found: dict, state: int, candidate: tuple[int, int]) -> None:
    if state not in found or candidate < found[state]:
        found[state] = candidate


def inserted(nodes: dict, weight: Weight) -> dict:
    """The nodes, and what an insertion reaches from them."""
    found = dict(nodes)
    for state, (value, used) in nodes.items():
        for role in "ua":
            if state in AFTER[role]:
                _least(found, AFTER[role][state], weight.then(value, used, "I", INSERT))
    return found


def piece_table(turns: list[tuple[str, bool, bool]], starts: tuple[int, ...]) -> Table:
    """The least weight from each of ``starts`` to each state; turns are (initial, must go, truncated)."""
    weight, table = Weight(2 * len(turns)), {}
    for start in starts:
        nodes = {start: (0, 0)}
        for initial, gone, truncated in turns:
            found: dict = {}
            more = TRUNCATED if truncated else 0
            for state, (value, used) in inserted(nodes, weight).items():
                _least(found, state, weight.then(value, used, "D", DELETE))
                if gone:
                    continue
                if state in AFTER.get(initial, {}):
                    _least(found, AFTER[initial][state], weight.then(value, used, "K", KEEP + more))
                for role in "ua":
                    if state in AFTER[role]:
                        _least(found, AFTER[role][state], weight.then(value, used, "R", REROLE + more))
            nodes = found
        table.update({(start, state): value for state, (value, _) in nodes.items()})
    return table


def joined_tables(table: Table, width: int, other: Table, other_width: int) -> Table:
    found: Table = {}
    for (a, middle), value in table.items():
        for (b, c), more in other.items():
            if b == middle:
                both = joined(value, width, more, other_width)
                if (a, c) not in found or both < found[a, c]:
                    found[a, c] = both
    return found


def finished(table: Table, width: int) -> tuple[int, str]:
    """Cost and audit of the whole conversation: an end where the form is complete, after an insertion if that is least."""
    room = Weight(width + 1)
    nodes = {}
    for (start, state), value in table.items():
        if start == START:
            value <<= BITS
            _least(nodes, state, (value, room.used(value)))
    value = min(v for state, (v, _) in inserted(nodes, room).items() if state in (START, ASSISTANT))
    return room.cost(value), room.audit(value)


# --- pieces in tasks -----------------------------------------------------------------------

_TABLE = "weights array<struct<start:int, state:int, weight:binary>>, width long"
_COUNTS = "blank long, duplicate long, truncated long, illegal long, first string, last string"
_ARROW_TABLE = [
    ("weights", pa.list_(pa.struct([("start", pa.int32()), ("state", pa.int32()), ("weight", pa.binary())]))), ("width", pa.int64()),
    ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()),
    ("first", pa.string()), ("last", pa.string())]
COUNTS = ("blank", "duplicate", "truncated", "illegal")


def _written(table: Table, width: int) -> list[dict]:
    return [{"start": a, "state": b, "weight": w.to_bytes(w.bit_length() // 8 + 1, "big")} for (a, b), w in sorted(table.items())]


def _read(weights: list[dict]) -> Table:
    return {(w["start"], w["state"]): int.from_bytes(w["weight"], "big") for w in weights}


def _illegal(before: str, after: str) -> bool:
    return before + after not in PAIRS


def _one_piece(turns: list[dict], seen: list[bytes], edge: bool) -> dict:
    known, given, counts, before = set(seen or ()), [], dict.fromkeys(COUNTS, 0), None
    for turn in turns:
        same = turn["digest"] in known
        known.add(turn["digest"])
        fault = "blank" if turn["blank"] else "duplicate" if same else "truncated" if turn["cut"] else None
        if fault:
            counts[fault] += 1
        if before is not None:
            counts["illegal"] += _illegal(before, turn["initial"])
        before = turn["initial"]
        given.append((before, fault in ("blank", "duplicate"), fault == "truncated"))
    # Only a piece that begins with its first number can follow another of the same conversation.
    table = piece_table(given, tuple(range(4)) if edge else (START,))
    return {"weights": _written(table, 2 * len(given)), "width": 2 * len(given), **counts, "first": given[0][0], "last": before}


def _joined_pieces(pieces: list[dict]) -> dict:
    """Neighbours are joined in pairs until one is left, so that each letter is moved as often as there are rounds."""
    while len(pieces) > 1:
        rest = []
        for a, b in zip(pieces[::2], pieces[1::2]):
            table = joined_tables(_read(a["weights"]), a["width"], _read(b["weights"]), b["width"])
            width = a["width"] + b["width"]
            rest.append({
                "weights": _written(table, width), "width": width, **{c: a[c] + b[c] for c in COUNTS},
                "first": a["first"], "last": b["last"]})
            rest[-1]["illegal"] += _illegal(a["last"], b["first"])
        pieces = rest + pieces[len(rest) * 2:]
    return pieces[0]


def _mapped(batches: Iterator[pa.RecordBatch], make, fields: list) -> Iterator[pa.RecordBatch]:
    """The first two columns as they are, and what ``make`` gives for the others, row by row."""
    schema = pa.schema(fields)
    for batch in batches:
        found = [make(*row) for row in zip(*(batch.column(k).to_pylist() for k in range(2, batch.num_columns)))]
        made = [pa.array([f[name] for f in found], kind) for name, kind in fields]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], [*batch.schema.names[:2], *schema.names])


def edits(audit: str) -> Iterator[tuple[str, int | None, str | None]]:
    """Each edit with its place in the repaired conversation and the role it sets there; both null for a deletion."""
    size = len(audit) - audit.count("D")
    place = 0
    for letter in audit:
        if letter == "D":
            yield letter, None, None
            continue
        role = ("assistant" if (place - size % 2) % 2 else "user") if letter in "IR" else None
        yield letter, place, role
        place += 1


_EDIT = pa.struct([("edit", pa.string()), ("position", pa.int64()), ("role", pa.string())])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, first number, audit) as a row per piece: the edits of its turns and its insertions."""
    for batch in batches:
        for k in range(batch.num_rows):
            number, audit = batch.column(1)[k].as_py(), batch.column(2)[k].as_py()
            key, own, extra, start = batch.column(0).slice(k, 1), [], [], number

            def row():
                return pa.RecordBatch.from_arrays(
                    [key, pa.array([(start - 1) // PIECE]), pa.array([start]), pa.array([own], pa.list_(_EDIT)),
                     pa.array([extra], pa.list_(_EDIT))], ["key", "piece", "start", "edits", "extra"])

            for letter, place, role in edits(audit):
                edit = {"edit": letter, "position": place, "role": role}
                if letter == "I":
                    extra.append(edit)
                    continue
                if own and (start + len(own) - 1) % PIECE == 0:
                    yield row()
                    start, own, extra = start + len(own), [], []
                own.append(edit)
            yield row()


# --- on tables ---------------------------------------------------------------------------------


def _cleaned(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def described(turns: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """Turns with ``no``, their number in the order of the table: conversation, turn (nulls first), role, text."""
    own = turns.select(
        F.col(conversation).alias("conv"), F.col(turn).cast("long").alias("turn"), _cleaned(role).alias("role"), _cleaned(text).alias("text"))
    numbered = number_rows(own, ["conv", "turn", "role", "text"], "no", unique=False)
    return numbered.withColumn("key", F.struct("conv")).withColumn("piece", F.expr(f"(no - 1) div {PIECE}"))


def _pieces(turns: DataFrame) -> DataFrame:
    trimmed = F.rtrim("text", F.lit(SPACE))
    digest = F.unhex(F.md5(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text")))
    about = F.struct(
        "no", F.substring("role", 1, 1).alias("initial"), (trimmed == "").alias("blank"),
        (~F.substring(trimmed, -1, 1).isin(*".!?")).alias("cut"), digest.alias("digest"))
    return stage(turns.groupBy("key", "piece").agg(F.sort_array(F.collect_list(about)).alias("turns")), "pieces")


def _seen_before(pieces: DataFrame) -> DataFrame:
    """Per piece the digests that an earlier piece of the conversation has. Only pieces at an edge can have neighbours."""
    first, last = F.get("turns", F.lit(0))["no"], F.element_at("turns", F.lit(-1))["no"]
    shared = pieces.where((first == F.col("piece") * PIECE + 1) | (last == (F.col("piece") + 1) * PIECE))
    told = shared.select("key", "piece", F.explode(F.array_distinct("turns.digest")).alias("digest"))
    earliest = told.groupBy("key", "digest").agg(F.min("piece").alias("earliest"), F.count("*").alias("n")).where("n > 1")
    return told.join(earliest, ["key", "digest"]).where("piece > earliest").groupBy("key", "piece").agg(F.collect_list("digest").alias("seen"))


def _tables(pieces: DataFrame) -> DataFrame:
    edge = F.get("turns", F.lit(0))["no"] == F.col("piece") * PIECE + 1
    kind = pieces.schema["key"].dataType.simpleString()
    schema = f"key {kind}, {{}} long, {_TABLE}, {_COUNTS}"
    given = pieces.join(_seen_before(pieces), ["key", "piece"], "left").select("key", "piece", "turns", "seen", edge.alias("edge"))
    tables = stage(given.mapInArrow(released(lambda b: _mapped(b, _one_piece, _ARROW_TABLE)), schema.format("piece")), "tables")

    spans = tables.groupBy("key").agg(F.min("piece").alias("low"), F.count("*").alias("pieces"))
    placed = tables.join(spans, "key").withColumn("at", F.col("piece") - F.col("low"))
    whole = placed.where("pieces = 1").select("key", *[name for name, _ in _ARROW_TABLE])
    several = stage(placed.where("pieces > 1").select("key", "at", *[name for name, _ in _ARROW_TABLE]), "several")
    parts = F.struct("at", *[name for name, _ in _ARROW_TABLE])
    while several.agg(F.max("at")).head()[0]:
        grouped = several.groupBy("key", F.expr(f"at div {FAN_IN}").alias("_at")).agg(F.sort_array(F.collect_list(parts)).alias("parts"))
        several = stage(grouped.mapInArrow(
            released(lambda b: _mapped(b, _joined_pieces, _ARROW_TABLE)), schema.format("_at")).withColumnRenamed("_at", "at"), "several")
    return whole.unionByName(several.drop("at"))


def _whole(weights: list[dict], width: int) -> dict:
    cost, audit = finished(_read(weights), width)
    return {"cost": cost, "audit": audit}


class Repair:
    """A table's least repair; what it works out is written to the shared folder once.

    ``report``: per conversation with turns its faults, ``illegal`` pairs of neighbours, ``cost`` and ``audit``.
    ``turns``: the repaired turns with ``position`` from 0, ``role``, ``text`` and ``edit``.

    Turns are taken in the order of ``turn`` (nulls first), then role and text; repeated rows follow each other and all but
    the first are duplicates. Null roles and texts count as one blank. A null conversation is one like any other. Texts and
    conversations may be of any length. Other columns are not looked at. An empty table has an empty report.
    """

    def __init__(self, turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"):
        self.conversation = conversation
        self._rows = described(turns, conversation, turn, role, text)
        kind = f"struct<conv:{turns.schema[conversation].dataType.simpleString()}>"
        whole = _tables(_pieces(self._rows)).select("key", "width", "weights", F.col("width").alias("_width"), *COUNTS)
        costs = whole.select("key", "width", "weights", "_width").mapInArrow(
            lambda b: _mapped(b, _whole, [("cost", pa.int64()), ("audit", pa.string())]),
            f"key {kind}, width long, cost long, audit string")
        self._found = stage(costs.join(whole.select("key", *COUNTS), "key").drop("width"), "repairs")
        self._kind = kind

    @property
    def report(self) -> DataFrame:
        return self._found.select(F.col("key.conv").alias(self.conversation), *COUNTS, "cost", "audit")

    @property
    def turns(self) -> DataFrame:
        first = self._rows.groupBy("key").agg(F.min("no").alias("first"))
        edit = "array<struct<edit:string, position:long, role:string>>"
        cut = stage(self._found.join(first, "key").select("key", "first", "audit").mapInArrow(
            released(_cut), f"key {self._kind}, piece long, start long, edits {edit}, extra {edit}"), "edits")
        kept = self._rows.join(cut, ["key", "piece"]).withColumn("own", F.get("edits", (F.col("no") - F.col("start")).cast("int")))
        kept = kept.where("own.edit <> 'D'").select(
            "key", "own.position", F.coalesce("own.role", "role").alias("role"), "text", "own.edit")
        more = cut.select("key", F.explode("extra").alias("own")).select("key", "own.position", "own.role", F.lit("").alias("text"), "own.edit")
        return kept.unionByName(more).select(F.col("key.conv").alias(self.conversation), "position", "role", "text", "edit")


# --- damage to repair, and what a reader finds ----------------------------------------------------


def damaged(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows dropped, emptied, without end marks, repeated or of another role, by the CRC-32 of ``conversation:turn``."""
    case = F.crc32(F.concat(_cleaned(conversation), F.lit(":"), _cleaned(turn)).cast("binary")) % 20
    own = turns.select(conversation, turn, _cleaned(role).alias("_role"), _cleaned(text).alias("_text"), case.alias("_case")).where("_case <> 0")
    own = own.withColumn("_text", F.when(F.col("_case") == 1, "").when(F.col("_case") == 2, F.translate("_text", ".!?", "")).otherwise(F.col("_text")))
    own = own.withColumn("_role", F.when(F.col("_case") == 4, "user").otherwise(F.col("_role")))
    own = own.withColumn("_copy", F.explode(F.when(F.col("_case") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return own.select(conversation, turn, F.col("_role").alias(role), F.col("_text").alias(text))


def gaps(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Per conversation how many turn numbers are left out between the least and the greatest; 0 if all are null."""
    counted = turns.groupBy(conversation).agg(
        F.min(turn).alias("_low"), F.max(turn).alias("_high"), F.count_distinct(turn).alias("_n"))
    return counted.select(conversation, F.coalesce(F.col("_high") - F.col("_low") + 1 - F.col("_n"), F.lit(0)).cast("long").alias("gaps"))


def _hashed(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Turns in order: per conversation the digest of ``role:text``, joined by line feeds. One turn is held at a time."""
    current = state = None
    for batch in batches:
        keys, digests = [], []
        for k, (key, role, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 2, 3)))):
            own = key["conv"]
            if state is None or own != current:
                if state is not None:
                    keys.append(current)
                    digests.append(state.hexdigest())
                current, state = own, hashlib.sha256()
            else:
                state.update(b"\n")
            state.update(f"{role}:{text}".encode())
        if keys:
            yield _digest_rows(keys, digests, kind)
    if state is not None:
        yield _digest_rows([current], [state.hexdigest()], kind)


def _digest_rows(keys: list, digests: list[str], kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([{"conv": k} for k in keys], kind), pa.array(digests)], ["key", "repaired_sha256"])


def turns_digest(turns: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """A SHA-256 per conversation. It needs its text in order, so a task reads a conversation turn by turn."""
    key = F.struct(F.col(conversation).alias("conv")).alias("key")
    kind = f"struct<conv:{turns.schema[conversation].dataType.simpleString()}>"
    arrow = pa.struct([("conv", {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[turns.schema[conversation].dataType.simpleString()])])
    ordered = turns.select(key, "position", "role", "text").repartition("key").sortWithinPartitions("key", "position")
    return ordered.mapInArrow(released(lambda b: _hashed(b, arrow)), f"key {kind}, repaired_sha256 string").select(
        F.col("key.conv").alias(conversation), "repaired_sha256")
