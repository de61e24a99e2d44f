"""Hierarchical packing of token sequences into windows of several sizes.

A document is routed by its length to the smallest tier that holds it, a longer one to the largest, where its ids are
cut into whole windows and a rest. Tiers are packed from long to short. The longest rest opens a window; its gap is
filled with the longest rests of the same tier that fit, then with those of the shorter tiers, longest tier first. Where
nothing fits, the gap is filled with the head of a longer rest, whose tail stays in its tier: windows of the shorter
tiers are exactly full, only those of the largest may lack up to ``slack``. A window that cannot be filled
waits for more.

Each task packs the rows it reads, a few million tokens at a time, and carries unfinished windows on;
what is left at its end is cut at powers of two. Nothing is shuffled. Windows of one tier form step
groups of equal token count, to which windows are dealt by their attention cost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from httplens.llm.rows import free_name
from httplens.llm.text import blocks, released
from httplens.llm.tokens import encoder

TIERS = (128, 256, 512, 1024)
SLACK = 4
BUFFER_TOKENS = 2_000_000
STEP_TOKENS = 64 * 1024

PIECE = (
    "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier int, step_group long")


class Rests:
    """Rests by length, with the lengths there are as the bits of a number."""

    def __init__(self):
        self.by_length: dict[int, list] = {}
        self.there = 0
        self.tokens = 0

    def put(self, rest: tuple, length: int) -> None:
        self.by_length.setdefault(length, []).append(rest)
        self.there |= 1 << length
        self.tokens += length

    def take(self, length: int) -> tuple:
        own = self.by_length[length]
        rest = own.pop()
        if not own:
            self.there &= ~(1 << length)
        self.tokens -= length
        return rest

    def longest(self, most: int) -> int:
        """The longest length there is up to ``most``, or 0."""
        return max(0, (self.there & ((2 << most) - 1)).bit_length() - 1)

    def shortest_over(self, length: int) -> int:
        over = self.there >> (length + 1)
        return length + 1 + (over & -over).bit_length() - 1 if over else 0


class Packer:
    """Packs (document, start, ids, document's tokens) into windows; a task has one."""

    def __init__(self, tiers: tuple[int, ...], slack: int, step_tokens: int, task: int):
        self.tiers, self.slack, self.step_tokens = sorted(tiers), slack, step_tokens
        self.rests, self.closed = {tier: Rests() for tier in self.tiers}, []
        self.next_sequence = self.next_step = task << 36

    @property
    def waiting(self) -> int:
        return sum(rests.tokens for rests in self.rests.values())

    def add(self, doc, ids: np.ndarray) -> int:
        """A document's ids; how many tokens wait to be written."""
        top, total = self.tiers[-1], len(ids)
        whole = total - total % top if total > top else 0
        for start in range(0, whole, top):
            self.closed.append([(doc, start, ids[start:start + top], total)])
        if whole < total:
            self.rests[self._route(total)].put((doc, whole, ids[whole:], total), total - whole)
        return total

    def _route(self, total: int) -> int:
        return next((tier for tier in self.tiers if total <= tier), self.tiers[-1])

    def _close_windows(self, tier: int) -> None:
        """Windows of ``tier``, until its rests are used up or no window can be filled."""
        own, slack = self.rests[tier], self.slack if tier == self.tiers[-1] else 0
        sources = [self.rests[t] for t in reversed(self.tiers) if t <= tier]
        while own.there:
            length = own.longest(tier)
            window, gap = [own.take(length)], tier - length
            for rests in sources:
                while gap and (fits := rests.longest(gap)):
                    window.append(rests.take(fits))
                    gap -= fits
            if gap > slack:
                longer, rests = next(((n, r) for r in sources if (n := r.shortest_over(gap))), (0, own))
                if not longer:
                    # All that is left is in the window: it waits for more.
                    for rest in window:
                        self.rests[self._route(rest[3])].put(rest, len(rest[2]))
                    return
                doc, start, ids, total = rests.take(longer)
                window.append((doc, start, ids[:gap], total))
                rests.put((doc, start + gap, ids[gap:], total), longer - gap)
            self.closed.append(window)

    def _finish(self) -> None:
        """What is left is filled into windows in turn; the last is cut at powers of two."""
        left, top = [], self.tiers[-1]
        for rests in self.rests.values():
            while rests.there:
                left.append(rests.take(rests.longest(top)))
        total = sum(len(rest[2]) for rest in left)
        sizes = [top] * (total // top) + [1 << b for b in range(top.bit_length() - 1, -1, -1) if (total % top) >> b & 1]
        for size in sizes:
            window = []
            while size:
                doc, start, ids, tokens = left.pop()
                window.append((doc, start, ids[:size], tokens))
                if len(ids) > size:
                    left.append((doc, start + size, ids[size:], tokens))
                size -= min(size, len(ids))
            self.closed.append(window)

    def batch(self, last: bool = False) -> Iterator[list]:
        """The pieces of the windows closed so far, each with its window, place and step group."""
        for tier in reversed(self.tiers):
            self._close_windows(tier)
        if last:
            self._finish()
        by_tier: dict[int, list] = {}
        for window in self.closed:
            used = sum(len(piece[2]) for piece in window)
            by_tier.setdefault(next(t for t in [*self.tiers, used] if t >= used), []).append(window)
        self.closed = []
        for tier, windows in by_tier.items():
            windows.sort(key=lambda w: -sum(len(piece[2]) ** 2 for piece in w))
            groups = max(1, -(-len(windows) * tier // self.step_tokens))
            for k, window in enumerate(windows):
                lap, at = divmod(k, groups)
                step = self.next_step + (at if lap % 2 == 0 else groups - 1 - at)
                offset = 0
                for doc, start, ids, total in window:
                    yield [doc, start, len(ids), ids.astype("<u4").tobytes(), total, self.next_sequence, offset, tier, step]
                    offset += len(ids)
                self.next_sequence += 1
            self.next_step += groups


def _packed(batches, schema: pa.Schema, encode, end_id: int, buffer_tokens: int, make: dict) -> Iterator[pa.RecordBatch]:
    packer = Packer(task=TaskContext.get().partitionId(), **make)
    waiting = 0

    def written(last=False):
        columns = list(zip(*packer.batch(last)))
        return pa.RecordBatch.from_arrays(
            [pa.array(list(column), field.type) for column, field in zip(columns, schema)], schema=schema) if columns else None

    for batch in batches:
        docs = batch.column(0).to_pylist()
        for block in blocks(batch.column(1)):
            ids, bounds = encode(block)
            for i in range(len(block)):
                own = np.append(ids[bounds[i]:bounds[i + 1]], np.uint32(end_id))
                waiting += packer.add(docs[block.first + i], own)
            if waiting >= buffer_tokens:
                waiting = packer.waiting
                if (out := written()) is not None:
                    yield out
    if (out := written(last=True)) is not None:
        yield out


def pack(
    docs: DataFrame, tokenizer: str, ranks: str | None = None, key: str = "doc_id", text: str = "text", end_id: int = 0,
    tiers: tuple[int, ...] = TIERS, slack: int = SLACK, step_tokens: int = STEP_TOKENS, buffer_tokens: int = BUFFER_TOKENS,
) -> DataFrame:
    """One row per piece: ``key``, then what :data:`PIECE` lists, ``ids`` as little-endian unsigned 32-bit numbers.

    Every row of ``docs`` is a document: its ids by the file ``tokenizer``, then ``end_id``. A null or
    empty text is ``end_id`` alone; null and repeated keys and repeated rows are packed like any other. Each id is
    in exactly one piece, however long its text. ``tier`` is the smallest window size that holds the sequence (at a
    task's end also a smaller power of two), ``step_group`` the group of equal token count it belongs to. Other
    columns of ``docs`` are left out; a key named like a column of :data:`PIECE` gets an underscore before its name.
    """
    piece = dict(c.split() for c in PIECE.split(", "))
    kept = free_name(key, list(piece))
    rows = docs.select(F.col(key).alias(kept), F.col(text).alias("_text"))
    schema = rows.select(kept, *[F.lit(None).cast(kind).alias(name) for name, kind in piece.items()]).schema
    arrow = pa.schema([
        (f.name, {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}[f.dataType.simpleString()])
        for f in schema])
    make = {"tiers": tuple(tiers), "slack": slack, "step_tokens": step_tokens}

    def run(batches):
        return _packed(batches, arrow, encoder(tokenizer, ranks).block, end_id, buffer_tokens, make)

    return rows.mapInArrow(released(run), schema)
