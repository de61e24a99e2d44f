"""Substring dedup: repeated word sequences found by seed and extend.

A *window* is ``length`` consecutive words of one text. Seeds are k-grams picked by
winnowing: every window is owned by its smallest k-gram hash, leftmost on ties, so that equal
windows are owned by equal seeds at the same place. A seed picked in a text owns a run of
windows around it; that run, from the first word of its first window to the last
word of its last, is as far as the seed is extended.

1. Each picked seed becomes one narrow row: seed hash, hash of its extended run, place. Per
   seed and run the earliest place is the *first*; all others repeat it whole. Equal runs of a batch
   are reduced to their first before the shuffle, so that copies cost a row per batch.
2. Where one seed has several different runs, the runs agree only in part. Their firsts, and only
   those, are extended again window by window; per window the earliest start wins.
3. A text learns which of its runs are firsts throughout and which windows of the others are. All
   other windows are repeats; the words they cover are the maximal repeats.

No pairs are formed and nothing is capped: work grows with the number of seeds, about an eighth of
the words. Windows are told apart by two 64-bit hashes of different families (seed and window).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from httplens.llm.rows import identified, named
from httplens.llm.text import SOLID, Block, Words, blocks, covered, mix, windows

LENGTH = 20
SEED = 5


class Seeds:
    """The picked seeds of a block: place, hash, and the run of windows each owns."""

    def __init__(self, block: Block, length: int, seed: int):
        self.words = words = Words(block, SOLID)
        hashes = words.hashes(block)
        grams = windows(hashes, seed, seed=11)
        span = length - seed + 1
        self.windows = windows(words.hashes(block, seed=2), length, seed=13)
        n = len(self.windows)
        last = np.repeat(words.first[1:], words.counts)[:n]
        starts = np.flatnonzero(np.arange(n) + length <= last)
        self.text = np.searchsorted(words.first, starts, "right") - 1
        # Owner of each window: the smallest of ``span`` neighbouring grams, leftmost on ties.
        owner = np.arange(len(grams))
        reach = 1 if n else span
        while reach < span:
            step = min(reach, span - reach)
            a, b = owner[:len(owner) - step], owner[step:]
            owner = np.where(grams[b] < grams[a], b, a)
            reach += step
        owner = owner[starts]
        # Windows owned by the same seed of the same text follow each other.
        new = np.ones(len(starts), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (self.text[1:] != self.text[:-1])
        heads = np.flatnonzero(new)
        self.window, self.run = starts, np.cumsum(new) - 1
        self.place, self.text_of = owner[heads], self.text[heads]
        self.start = starts[heads]
        self.size = np.diff(np.append(heads, len(starts)))
        self.hash = grams[self.place]
        # The run's hash: of its windows, and of where the seed lies in it.
        if len(heads):
            content = self.windows[starts] * (2 * (starts - self.start[self.run]).astype(np.uint64) + np.uint64(1))
            shape = (self.place - self.start).astype(np.uint64) * np.uint64(64) + self.size.astype(np.uint64)
            self.whole = mix(mix(np.add.reduceat(mix(content), heads)) + shape)
        else:
            self.whole = np.zeros(0, np.uint64)


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _picked(batches: Iterator[pa.RecordBatch], length: int, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        parts = []
        for block in blocks(batch.column(1)):
            found = Seeds(block, length, seed)
            parts.append((found.hash, found.whole, ids[block.first + found.text_of],
                          found.start - found.words.first[found.text_of]))
        if parts:
            seeds, runs, rows, starts = (np.concatenate(p) for p in zip(*parts))
            order = np.lexsort((starts, rows, runs, seeds))
            seeds, runs = seeds[order], runs[order]
            first = np.ones(len(order), bool)
            first[1:] = (seeds[1:] != seeds[:-1]) | (runs[1:] != runs[:-1])
            order = order[first]
            yield pa.RecordBatch.from_arrays(
                [_signed(seeds[first]), _signed(runs[first]), pa.array(rows[order], pa.int64()),
                 pa.array(starts[order].astype(np.int32))],
                ["seed", "run", "row_id", "start"])


def _extended(batches: Iterator[pa.RecordBatch], length: int, seed: int) -> Iterator[pa.RecordBatch]:
    """The windows of the runs that begin at the given word numbers, in the second column's texts."""
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        wanted = batch.column(2)
        for block in blocks(batch.column(1)):
            found = Seeds(block, length, seed)
            chosen = _chosen(found, wanted, block.first)
            keep = chosen[found.run]
            of, window = found.text[keep], found.window[keep]
            yield pa.RecordBatch.from_arrays(
                [_signed(found.hash[found.run[keep]]), _signed(found.windows[window]),
                 pa.array(ids[block.first + of], pa.int64()),
                 pa.array((window - found.words.first[of]).astype(np.int32))],
                ["seed", "window", "row_id", "start"])


def _flat(lists: pa.Array, first: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The values of lists ``first`` to ``first + n`` and the list each is in."""
    part = lists.slice(first, n)
    values = part.flatten().to_numpy(zero_copy_only=False)
    lengths = part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return values.astype(np.int64), np.repeat(np.arange(n), lengths)


def _chosen(found: Seeds, lists: pa.Array, first: int) -> np.ndarray:
    """Which runs of the block begin at the word numbers in ``lists``."""
    values, of = _flat(lists, first, len(found.words.counts))
    return np.isin(found.start, values + found.words.first[of])


def _kept(batches: Iterator[pa.RecordBatch], length: int, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, spans, kept = [], [], []
        for block in blocks(batch.column(1)):
            found = Seeds(block, length, seed)
            words = found.words
            repeats = ~_chosen(found, batch.column(2), block.first)[found.run]
            values, of = _flat(batch.column(3), block.first, len(block))
            repeats &= ~np.isin(found.window, values + words.first[of])
            at = found.window[repeats]
            gone = covered(at, at + length, len(words))
            for i in range(len(block)):
                a, b = words.first[i], words.first[i + 1]
                own = gone[a:b]
                change = np.flatnonzero(np.diff(np.concatenate([[0], own.astype(np.int8), [0]])))
                stay = np.flatnonzero(~own) + a
                n_words.append(int(b - a))
                spans.append([{"start": int(x), "end": int(y)} for x, y in zip(change[::2], change[1::2])])
                data = block.data
                kept.append(b" ".join(
                    [data[s:e].tobytes() for s, e in zip(words.starts[stay].tolist(), words.ends[stay].tolist())]).decode())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.struct(
                [("start", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.string())],
            ["row_id", "n_words", "repeats", "kept"])


def remove_repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, seed: int = SEED,
) -> DataFrame:
    """Per row: key, ``n_words``, ``repeats`` (maximal runs of words that occur earlier, by word number) and ``kept``.

    Earlier means a smaller key, or an earlier place in the same text. Null texts have no words. A null
    key comes first; rows that share a key follow each other in the order of their texts, and
    of two equal rows the second is removed whole (where it has ``length`` words).
    """
    rows, is_key = identified(docs.select(key, text), key, [text])
    texts = rows.select("row_id", F.coalesce(F.col(text), F.lit("")).alias("text")).where("row_id IS NOT NULL")
    picked = texts.mapInArrow(
        lambda b: _picked(b, length, seed), "seed long, run long, row_id long, start int")
    # One exchange by seed serves both the firsts and the number of runs per seed.
    firsts = picked.repartition("seed").groupBy("seed", "run").agg(F.min(F.struct("row_id", "start")).alias("first"))
    runs = F.count("*").over(Window.partitionBy("seed"))
    firsts = firsts.select("first.row_id", "first.start", (runs == 1).alias("sure"))
    lists = firsts.groupBy("row_id").agg(
        F.collect_list(F.when(F.col("sure"), F.col("start"))).alias("sure"),
        F.collect_list(F.when(~F.col("sure"), F.col("start"))).alias("unsure"))
    # Both uses read the same exchanges of texts and lists: same columns, same filters.
    both = texts.join(lists, "row_id", "left")
    owned = both.where(F.size("unsure") > 0).select("row_id", "text", "unsure", "sure").mapInArrow(
        lambda b: _extended(b, length, seed), "seed long, window long, row_id long, start int")
    earliest = owned.groupBy("seed", "window").agg(F.min(F.struct("row_id", "start")).alias("first"))
    earliest = earliest.groupBy("first.row_id").agg(F.collect_list("first.start").alias("earliest"))
    kept = both.join(earliest, "row_id", "left").select("row_id", "text", "sure", "earliest", "unsure").mapInArrow(
        lambda b: _kept(b, length, seed),
        "row_id long, n_words long, repeats array<struct<start:int, end:int>>, kept string")
    return named(kept, rows, key, is_key).select(key, "n_words", "repeats", "kept")
