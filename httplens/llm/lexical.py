"""Ranked lexical search of all documents, with equal bags of terms scored once.

1. The terms of the items are the vocabulary. One pass over the texts counts each document's terms and keeps, of those
   in the vocabulary, the sorted pairs of term and frequency: its *bag*. A term is found by a 64-bit hash and then
   compared byte by byte.
2. The score of a document depends on its bag and its length norm ``m`` alone. Documents are grouped by a hash of both and
   by bag and norm themselves, which verifies the hash. Such a class, however many copies it holds, is one row.
3. Each task scores its classes against all items and keeps the best ``top`` classes of each item: by score, then by
   smallest document. No more can matter, as every class holds a document. The best of all tasks are picked by Spark.
4. The ``top`` smallest documents of each class picked are its members in the result, ranked by score and document.

What a task holds is bounded by ``max_terms``: with more distinct terms of items than that, the items are dealt into
parts, which are searched one after the other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from httplens.llm.text import ALNUM, LOWER, Block, Words, blocks, released
from httplens.session import stage

TOP = 50
MAX_TERMS = 1_000_000
LAST = np.iinfo(np.int64).max

_CELLS = 1 << 19  # scores and postings that a task holds at once
SALT = 32


# --- terms and bags ------------------------------------------------------------------------


def terms_of(block: Block, words: Words, i: int) -> list[bytes]:
    """The terms of a text of the block, once each."""
    first, last = words.first[i], words.first[i + 1]
    return list(dict.fromkeys(
        LOWER[block.data[s:e]].tobytes() for s, e in zip(words.starts[first:last], words.ends[first:last])))


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        numbers = batch.column(0)
        for block in blocks(batch.column(1)):
            words = Words(block, ALNUM)
            found = [terms_of(block, words, i) for i in range(len(block))]
            yield pa.RecordBatch.from_arrays(
                [numbers.slice(block.first, len(block)), pa.array(found, pa.list_(pa.binary()))], ["_number", "terms"])


class Vocabulary:
    """The terms of some items: found by hash, verified by their bytes."""

    def __init__(self, terms: list[bytes]):
        data = b"".join(terms)
        self.starts = np.cumsum([0, *map(len, terms)])
        self.data = np.frombuffer(data, np.uint8)
        hashes = Words(Block(self.data, self.starts, 0), ALNUM).hashes(Block(self.data, self.starts, 0), seed=9)
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.order]

    def __len__(self) -> int:
        return len(self.order)

    def numbers(self, block: Block, words: Words) -> np.ndarray:
        """The number of each word's term, -1 for words beyond the vocabulary."""
        found = np.full(len(words), -1, np.int64)
        if not len(self) or not len(words):
            return found
        hashes = words.hashes(block, seed=9, fold=LOWER)
        # Equal hashes of different terms would follow each other: all of them are tried.
        at = np.searchsorted(self.hashes, hashes)
        left = np.flatnonzero(at < len(self))
        while len(left):
            left = left[self.hashes[at[left]] == hashes[left]]
            number = self.order[at[left]]
            good = self._same(block, words, left, number)
            found[left[good]] = number[good]
            left = left[~good]
            at[left] += 1
            left = left[at[left] < len(self)]
        return found

    def _same(self, block: Block, words: Words, which: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Whether the words are letter by letter the terms."""
        sizes = words.ends[which] - words.starts[which]
        same = sizes == self.starts[number + 1] - self.starts[number]
        which, number, sizes = which[same], number[same], sizes[same]
        if len(which):
            ends = np.cumsum(sizes)
            place = np.arange(int(ends[-1]))
            wrong = (LOWER[block.data[place + np.repeat(words.starts[which] - (ends - sizes), sizes)]]
                     != self.data[place + np.repeat(self.starts[number] - (ends - sizes), sizes)])
            same[same] = np.add.reduceat(wrong, ends - sizes) == 0
        return same


def _bags(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary) -> Iterator[pa.RecordBatch]:
    """Per document its number of terms, and its bag: (term, frequency) as pairs of 32-bit numbers, by term."""
    for batch in batches:
        for block in blocks(batch.column(1)):
            words = Words(block, ALNUM)
            numbers = vocabulary.numbers(block, words)
            known = np.flatnonzero(numbers >= 0)
            cells, times = np.unique(
                words.owner()[known] * max(1, len(vocabulary)) + numbers[known], return_counts=True)
            owner, term = np.divmod(cells, max(1, len(vocabulary)))
            pairs = np.column_stack([term, times]).astype("<i4")
            ends = np.append(0, np.cumsum(np.bincount(owner, minlength=len(block)))) * 8
            bags = pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), len(block), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(pairs.tobytes())])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(block.first, len(block)), pa.array(words.counts.astype(np.int64)), bags.cast(pa.binary())],
                ["doc", "n", "bag"])


def _holders(batches: Iterator[pa.RecordBatch], n_terms: int) -> Iterator[pa.RecordBatch]:
    """How many documents of the task hold each term."""
    count = np.zeros(n_terms, np.int64)
    for batch in batches:
        count += np.bincount(_pairs(batch.column(0))[0], minlength=n_terms)
    some = np.flatnonzero(count)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some])], ["term", "df"])


def _pairs(bags: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms and frequencies of all bags one after the other, and how many each bag has."""
    _, offsets, data = bags.buffers()
    at = np.frombuffer(offsets, np.int32)[bags.offset:bags.offset + len(bags) + 1].astype(np.int64)
    flat = np.frombuffer(data, "<i4")[at[0] // 4:at[-1] // 4] if data is not None else np.zeros(0, "<i4")
    return flat[::2].astype(np.int64), flat[1::2].astype(np.int64), np.diff(at) // 8


# --- scores ----------------------------------------------------------------------------------


@dataclass
class Postings:
    """The items of each term, and the term's weight."""

    weight: np.ndarray
    starts: np.ndarray
    items: np.ndarray
    n_items: int


def postings(items: list[np.ndarray], n_terms: int, df: np.ndarray, n_docs: int) -> Postings:
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    holder = np.repeat(np.arange(len(items)), [len(own) for own in items])
    terms = np.concatenate(items) if items else np.zeros(0, np.int64)
    order = np.argsort(terms, kind="stable")
    starts = np.append(0, np.cumsum(np.bincount(terms, minlength=n_terms)))
    return Postings(weight, starts, holder[order], len(items))


def _slices(sizes: np.ndarray, work: np.ndarray, n_items: int) -> Iterator[tuple[int, int]]:
    """Consecutive classes whose scores, and whose postings, fit into memory; at least one."""
    total = np.cumsum(work)
    first = 0
    while first < len(sizes):
        base = total[first - 1] if first else 0
        last = min(first + max(1, _CELLS // max(1, n_items)), int(np.searchsorted(total, base + _CELLS, "right")))
        last = max(first + 1, last)
        yield first, last
        first = last


def _scored(batches: Iterator[pa.RecordBatch], about: Postings, top: int) -> Iterator[pa.RecordBatch]:
    """The best classes of the task for each item."""
    least = np.zeros(about.n_items, np.float64)
    kept = None
    for batch in batches:
        norm, first = batch.column(1).to_numpy(), batch.column(3).fill_null(LAST).to_numpy()
        term, times, sizes = _pairs(batch.column(2))
        ends = np.cumsum(sizes)
        counts = about.starts[term + 1] - about.starts[term]
        value = about.weight[term] * ((1_000_000_000 * times) // (1000 * times + 20 * np.repeat(norm, sizes)))
        owner = np.repeat(np.arange(len(sizes)), sizes)
        work = np.bincount(owner, counts, len(sizes))
        for a, b in _slices(sizes, work, about.n_items):
            own = slice(int(ends[a] - sizes[a]), int(ends[b - 1]))
            times_held = counts[own]
            stop = np.cumsum(times_held)
            item = about.items[np.arange(int(stop[-1]) if len(stop) else 0)
                               + np.repeat(about.starts[term[own]] - (stop - times_held), times_held)]
            cell = np.repeat((owner[own] - a) * about.n_items, times_held) + item
            # Sums stay below 2^53, where doubles are whole numbers.
            score = np.bincount(cell, np.repeat(value[own], times_held), (b - a) * about.n_items).reshape(b - a, about.n_items)
            at, held = np.nonzero((score > 0) & (score >= least))
            points = score[at, held].astype(np.int64)
            good = _best(held, points, first[a + at], top, least)
            rows = pa.array(a + at[good])
            fresh = pa.RecordBatch.from_arrays(
                [pa.array(held[good].astype(np.int32)), pa.array(points[good]), pa.array(first[a + at[good]]),
                 *[batch.column(k).take(rows) for k in range(3)]],
                ["item", "score", "first", "hash", "m", "bag"])
            if kept is not None:
                both = pa.concat_batches([kept, fresh])
                fresh = both.take(pa.array(_best(*(both.column(k).to_numpy() for k in range(3)), top, least)))
            kept = fresh
    if kept is not None:
        yield kept


def _best(item: np.ndarray, score: np.ndarray, first: np.ndarray, top: int, least: np.ndarray) -> np.ndarray:
    """The ``top`` rows of each item; ``least`` becomes the lowest score that can still get among them."""
    order = np.lexsort((first, -score, item))
    own = item[order]
    heads = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, np.int64)
    rank = np.arange(len(own)) - np.repeat(heads, np.diff(np.append(heads, len(own))))
    full = order[rank == top - 1]
    least[item[full]] = np.maximum(least[item[full]], score[full])
    return order[rank < top]


# --- the search --------------------------------------------------------------------------------


def _norm(n_docs: int, n_terms: int) -> Column:
    return F.expr(f"50L + (50L * n * {n_docs}L) div {n_terms}L")


def search(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text", top: int = TOP, max_terms: int = MAX_TERMS,
) -> DataFrame:
    """Per item its ``top`` best documents: ``item_id``, ``rank`` from 1, ``doc_id``, ``score``; named after ``item`` and ``key``.

    ``key`` is an integer. Only scores above 0 count; equal scores go by ascending key, rows without a key last. Every row of
    ``docs`` is a document and every row of ``items`` a query of its own, repeated keys, ids and rows too. Null and empty texts
    have no terms: such items find nothing, such documents are not found and not counted. Texts may be of any
    length. Without items or documents the result is empty.
    """
    asked = stage(items.select(F.monotonically_increasing_id().alias("_number"), F.col(item).alias("_item"), F.col(item_text).alias("_text")), "items")
    spoken = stage(asked.select("_number", "_text").mapInArrow(released(_item_terms), "_number long, terms array<binary>"), "terms")
    total = spoken.agg(F.sum(F.size("terms"))).head()[0] or 0
    parts = max(1, -(-total // max_terms))
    found = None
    for k in range(parts):
        own = spoken.where(F.pmod(F.xxhash64("_number"), F.lit(parts)) == k)
        part = _search(docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("_text")), own, top)
        found = part if found is None else found.unionByName(part)
    ids = asked.select("_number", F.col("_item").alias(item))
    return found.join(ids, "_number").select(
        item, "rank", F.col("doc").cast(docs.schema[key].dataType).alias(key), "score")


def _search(docs: DataFrame, spoken: DataFrame, top: int) -> DataFrame:
    rows = spoken.orderBy("_number").collect()
    terms = sorted({bytes(t) for r in rows for t in r.terms})
    place = {t: k for k, t in enumerate(terms)}
    vocabulary = Vocabulary(terms)
    wanted = [np.array([place[bytes(t)] for t in r.terms], np.int64) for r in rows]
    bags = stage(docs.mapInArrow(released(lambda b: _bags(b, vocabulary)), "doc long, n long, bag binary"), "bags")

    size = bags.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).head()
    n_terms = len(vocabulary)
    df = np.zeros(n_terms, np.int64)
    counted = bags.select("bag").mapInArrow(released(lambda b: _holders(b, n_terms)), "term long, df long")
    for row in counted.groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[row.term] = row.df
    about = postings(wanted, n_terms, df, size.docs)

    normed = bags.where(F.octet_length("bag") > 0).select("doc", "bag", _norm(size.docs, max(1, size.terms)).alias("m"))
    hashed = normed.withColumn("hash", F.xxhash64("m", "bag"))
    same = ["hash", "m", "bag"]
    classes = hashed.groupBy(*same).agg(F.min("doc").alias("first"))
    best = classes.select(*same, "first").mapInArrow(
        released(lambda b: _scored(b, about, top)), "item int, score long, first long, hash long, m long, bag binary")
    ahead = Window.partitionBy("item").orderBy(F.desc("score"), "first", *same)
    picked = stage(best.withColumn("_at", F.row_number().over(ahead)).where(F.col("_at") <= top).drop("_at"), "picked")

    # At most ``top`` classes an item. The narrow join by hash leaves few rows, which are then compared whole. A class may
    # hold a third of all documents: its smallest are found among each of the salts first.
    chosen = stage(picked.select(*same).distinct().withColumn("class", F.monotonically_increasing_id()), "classes")
    near = hashed.join(chosen.select("hash", "m").distinct(), ["hash", "m"], "left_semi").join(chosen, same).select("class", "doc")
    members = near.withColumn("_salt", F.pmod(F.xxhash64("doc"), F.lit(SALT)))
    for own in (["class", "_salt"], ["class"]):
        by_doc = Window.partitionBy(*own).orderBy(F.col("doc").asc_nulls_last())
        members = members.withColumn("_at", F.row_number().over(by_doc)).where(F.col("_at") <= top).drop("_at")
    ranking = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc").asc_nulls_last())
    found = picked.join(chosen, same).select("item", "score", "class").join(members.select("class", "doc"), "class")
    ranked = found.withColumn("rank", F.row_number().over(ranking)).where(F.col("rank") <= top)
    numbers = spoken.sparkSession.createDataFrame([(k, r[0]) for k, r in enumerate(rows)], "item int, _number long")
    return ranked.join(numbers, "item").select("_number", "rank", "doc", "score")
