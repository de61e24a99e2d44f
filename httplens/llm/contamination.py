"""Benchmark decontamination: test n-grams found in training texts.

The n-grams of the benchmark are a set of 64-bit hashes that every task holds, guarded by a
small bitmap. Texts are scanned window by window; a hash that is found is verified word
by word before it counts. Where the benchmark has more n-grams than ``max_ngrams``, it is cut into
parts of that size by n-gram; the texts are scanned once per part and the hits are united, so that
what a task holds stays bounded and nothing is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from httplens.llm.rows import free_name
from httplens.llm.text import ALNUM, LOWER, Words, blocks, covered, released, windows, within
from httplens.session import stage

WINDOW = 13
MAX_NGRAMS = 2_000_000

RESULT = "struct<n_words:long, n_hit:long, items:array<string>, spans:array<struct<start:int, end:int>>>"
_RESULT = pa.struct([
    ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
    ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])

_BITS = 22


class Ngrams:
    """Normalised n-grams by length, each with the items that hold it."""

    def __init__(self, grams: dict[bytes, list[str]]):
        self.grams = grams
        by_size: dict[int, list[bytes]] = {}
        for gram in grams:
            by_size.setdefault(gram.count(b" ") + 1, []).append(gram)
        self.tables = {size: self._table(found, size) for size, found in by_size.items()}

    @staticmethod
    def _table(found: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
        data = b"".join(found)
        block = next(blocks(pa.array([data.decode()], pa.large_string()), len(data) + 1))
        bounds = np.cumsum([0, *map(len, found)])
        block.bounds = bounds.astype(np.int64)
        words = Words(block, ALNUM)
        # Every gram has exactly ``size`` words, so that its first word's window is the gram.
        keys = np.sort(windows(words.hashes(block), size)[words.first[:-1]])
        bitmap = np.zeros(1 << _BITS, bool)
        bitmap[keys & np.uint64((1 << _BITS) - 1)] = True
        return keys, bitmap


def _grams(texts: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in texts:
        items = batch.column(0)
        for block in blocks(batch.column(1)):
            words, grams, holders = Words(block, ALNUM), [], []
            for i in range(len(block)):
                first, last = words.first[i], words.first[i + 1]
                own = [LOWER[block.data[s:e]].tobytes()
                       for s, e in zip(words.starts[first:last], words.ends[first:last])]
                if own:
                    found = {b" ".join(own[k:k + size]) for k in range(max(1, len(own) - size + 1))}
                    grams += found
                    holders += [items[block.first + i].as_py()] * len(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(grams, pa.binary()), pa.array(holders, pa.string())], ["gram", "item"])


def benchmark_ngrams(
    benchmark: DataFrame, item: str = "item_id", text: str = "text", size: int = WINDOW,
    max_ngrams: int = MAX_NGRAMS,
) -> list[Callable[[], Ngrams]]:
    """The n-grams of the benchmark, in as many parts as ``max_ngrams`` asks for; each is read when it is called for.

    An item of fewer words is one shorter n-gram; one without words (or null) has none. An item
    without an id is known by the empty string; rows that share an id are one item.
    """
    rows = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.col(text).alias("text"))
    found = rows.mapInArrow(released(lambda batches: _grams(batches, size)), "gram binary, item string").distinct()
    parts = max(1, -(-found.count() // max_ngrams))
    if parts > 1:
        found = stage(found.withColumn("part", F.pmod(F.xxhash64("gram", "item"), F.lit(parts))), "ngrams")

    def part(k: int) -> Ngrams:
        grams: dict[bytes, set[str]] = {}
        for row in (found.where(F.col("part") == k) if parts > 1 else found).collect():
            grams.setdefault(bytes(row.gram), set()).add(row.item)
        return Ngrams({gram: sorted(items) for gram, items in grams.items()})

    return [partial(part, k) for k in range(parts)]


def _scan(texts: pa.Array, ngrams: Ngrams, known: pa.Array | None = None) -> pa.Array:
    """What is found in each text, united with what is ``known`` of it."""
    n_words, n_hit, items, spans = [], [], [], []
    for block in blocks(texts):
        words = Words(block, ALNUM)
        hashes = words.hashes(block, fold=LOWER)
        starts, ends, names = [], [], []
        for size, (keys, bitmap) in ngrams.tables.items():
            found = windows(hashes, size)
            maybe = np.flatnonzero(bitmap[found & np.uint64((1 << _BITS) - 1)] & within(words, size))
            maybe = maybe[np.isin(found[maybe], keys)]
            for at in maybe.tolist():
                gram = b" ".join(
                    LOWER[block.data[s:e]].tobytes()
                    for s, e in zip(words.starts[at:at + size], words.ends[at:at + size]))
                holders = ngrams.grams.get(gram)
                if holders:
                    starts.append(at)
                    ends.append(at + size)
                    names.append(holders)
        of = (np.searchsorted(words.first, np.array(starts, np.int64), "right") - 1).tolist()
        for i in range(len(block) if known is not None else 0):
            if (more := known[block.first + i].as_py()) is not None:
                at = int(words.first[i])
                starts += [at + run["start"] for run in more["spans"]]
                ends += [at + run["end"] for run in more["spans"]]
                of.append(i)
                names.append(more["items"])
        hit = covered(np.array(starts, np.int64), np.array(ends, np.int64), len(words)) if starts else None
        sums = np.concatenate([[0], np.cumsum(hit)]) if starts else np.zeros(len(words) + 1, np.int64)
        held: dict[int, set[str]] = {}
        for doc, holders in zip(of, names):
            held.setdefault(doc, set()).update(holders)
        n_words += words.counts.tolist()
        n_hit += (sums[words.first[1:]] - sums[words.first[:-1]]).tolist()
        for i in range(len(block)):
            items.append(sorted(held.get(i, ())))
            spans.append(_runs(hit[words.first[i]:words.first[i + 1]]) if i in held else [])
    return pa.array(
        [{"n_words": a, "n_hit": b, "items": c, "spans": d} for a, b, c, d in zip(n_words, n_hit, items, spans)],
        _RESULT)


def _runs(hit: np.ndarray) -> list[dict]:
    change = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return [{"start": int(a), "end": int(b)} for a, b in zip(change[::2], change[1::2])]


def hits(text: str | Column, ngrams: Ngrams, known: Column | None = None) -> Column:
    """Per text: words, words inside any n-gram, the items found, and the runs of such words.

    ``known`` is what other parts of a benchmark have found, null for nothing.
    """
    if known is None:
        @F.arrow_udf(RESULT)
        @released
        def scan(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in texts:
                yield _scan(batch, ngrams)

        return scan(text)

    @F.arrow_udf(RESULT)
    @released
    def united(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, more in batches:
            yield _scan(texts, ngrams, more)

    return united(text, known)


def _found_by(parts: list[Callable[[], Ngrams]], texts: DataFrame) -> DataFrame:
    """What the parts find in ``texts`` (digest, text): a row per digest with hits, whatever its copies.

    A digest has a row per part at most, so that no group is large.
    """
    found = None
    for part in parts:
        own = texts.select("digest", hits("text", part()).alias("hit")).where("hit.n_hit > 0")
        own = stage(own.groupBy("digest").agg(F.first("hit").alias("hit")).select("digest", "hit.items", "hit.spans"), "hits")
        found = own if found is None else found.unionByName(own)
    return found.groupBy("digest").agg(F.struct(
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
        F.flatten(F.collect_list("spans")).alias("spans")).alias("known"))


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", size: int = WINDOW,
    max_ngrams: int = MAX_NGRAMS, column: str = "contamination",
) -> DataFrame:
    """``docs`` with a struct of what was found in each text, and whether the text is contaminated.

    Every row is judged by itself: null texts have no words, equal rows get equal results, however long the text,
    and an empty benchmark finds nothing. A column named ``column`` is replaced, all others are kept.
    """
    first, *others = benchmark_ngrams(benchmark, text=text, size=size, max_ngrams=max_ngrams)
    if others:
        digest = F.sha2(F.col(text), 256)
        known = _found_by(others, docs.select(digest.alias("digest"), F.col(text).alias("text")))
        name = free_name("known", docs.columns)
        key = free_name("digest", [*docs.columns, name])
        found = docs.withColumn(key, digest).join(
            known.select(F.col("digest").alias(key), F.col("known").alias(name)), key, "left")
        found = found.withColumn(column, hits(F.col(text), first(), F.col(name))).drop(key, name)
    else:
        found = docs.withColumn(column, hits(F.col(text), first()))
    contaminated = (F.col(f"{column}.n_hit") > 0) & (20 * F.col(f"{column}.n_hit") >= F.col(f"{column}.n_words"))
    return found.withColumn(column, F.col(column).withField("contaminated", contaminated))


def items_digest(items: Column) -> Column:
    return F.sha2(F.array_join(items, ","), 256)


def remove_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words in ``spans`` and what stands between them."""
    data = np.frombuffer(text.encode(), np.uint8)
    block = next(blocks(pa.array([text], pa.large_string()), len(data) + 1), None)
    words, kept, at = Words(block, ALNUM), [], 0
    for start, end in spans:
        kept.append(data[at:words.starts[start]].tobytes())
        at = words.ends[end - 1]
    return b"".join([*kept, data[at:].tobytes()]).decode()
