"""Document fingerprints from content-defined chunks.

A gear hash rolls over the UTF-8 bytes of a text; a chunk ends where its low bits are zero. Chunking is
normalised: up to the normal size more bits are asked for than beyond it, which draws
chunk sizes together. Boundaries depend on nearby bytes only, so an insertion shifts chunks
without changing those further on. A fingerprint is the set of chunk digests with their lengths in bytes,
written as sorted ``digest:length`` entries.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from httplens.llm.rows import identified, named
from httplens.llm.text import Block, _letters, _powers, blocks, mix
from httplens.operators.ordered import number_rows

MINIMUM, NORMAL, MAXIMUM = 24, 64, 256
HARD_BITS, EASY_BITS = 7, 5

_GEAR = np.random.default_rng(9).integers(0, 1 << 16, 256, dtype=np.uint16)


def _gear(data: np.ndarray) -> np.ndarray:
    """The low 16 bits of the gear hash after each byte; they depend on the last 16 bytes."""
    h = _GEAR[data]
    for reach in (1, 2, 4, 8):
        shifted = h[:-reach] << np.uint16(reach)
        h = h.copy()
        h[reach:] += shifted
    return h


def boundaries(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Where chunks begin, and the text of each chunk. A chunk lies within one text."""
    h = _gear(block.data)
    # The highest of the 16 bits have seen the most bytes.
    easy_mask = np.uint16(((1 << EASY_BITS) - 1) << (16 - HARD_BITS))
    hard_mask = np.uint16(((1 << HARD_BITS) - 1) << (16 - HARD_BITS))
    easy = np.flatnonzero((h & easy_mask) == 0)
    hard = easy[(h[easy] & hard_mask) == 0].tolist()
    easy = easy.tolist()
    # A cut may not depend on bytes before the chunk; MINIMUM is longer than what the hash remembers.
    starts, owner = [], []
    bounds = block.bounds.tolist()
    n_easy, n_hard = len(easy), len(hard)
    for i in range(len(block)):
        at, end = bounds[i], bounds[i + 1]
        e, d = bisect_left(easy, at), bisect_left(hard, at)
        while at < end:
            starts.append(at)
            owner.append(i)
            if end - at <= MINIMUM:
                break
            low, mid, top = at + MINIMUM - 1, at + NORMAL - 1, at + MAXIMUM
            while d < n_hard and hard[d] < low:
                d += 1
            if d < n_hard and hard[d] < mid:
                cut = hard[d] + 1
            else:
                e = bisect_left(easy, mid, e)
                cut = easy[e] + 1 if e < n_easy else top
                if cut > top:
                    cut = top
            at = cut
    return np.array(starts, np.int64), np.array(owner, np.int64)


class Chunks:
    """Chunk digests and lengths of the texts of a block; equal chunks of a text once."""

    def __init__(self, block: Block):
        starts, owner = boundaries(block)
        n = len(block.data)
        if len(starts):
            lengths = np.diff(np.append(starts, n))
            place = np.arange(n) - np.repeat(starts, lengths)
            values = _letters(21)[block.data] * _powers(int(lengths.max()), 21)[place]
            digest = mix(np.add.reduceat(values, starts) + lengths.astype(np.uint64))
        else:
            lengths, digest = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        order = np.lexsort((lengths, digest, owner))
        owner, digest, lengths = owner[order], digest[order], lengths[order]
        new = np.ones(len(order), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (digest[1:] != digest[:-1]) | (lengths[1:] != lengths[:-1])
        self.digest, self.length = digest[new], lengths[new]
        self.first = np.searchsorted(owner[new], np.arange(len(block) + 1))

    def of(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.first[i], self.first[i + 1]
        return self.digest[a:b], self.length[a:b]

    def written(self, i: int) -> str:
        return ",".join([f"{d:016x}:{n}" for d, n in zip(*(x.tolist() for x in self.of(i)))])


def containment(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The share of ``a``'s bytes whose chunks are in ``b`` too; two empty sets are alike."""
    if not len(a[0]):
        return float(not len(b[0]))
    if not len(b[0]):
        return 0.0
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    return float(a[1][(b[0][at] == a[0])].sum() / a[1].sum())


def texts_chunks(texts: list[str]) -> list[tuple[str, tuple[np.ndarray, np.ndarray]]]:
    """The written fingerprint and the chunk set of each text."""
    found = []
    for block in blocks(pa.array(texts, pa.large_string())):
        chunks = Chunks(block)
        found += [(chunks.written(i), chunks.of(i)) for i in range(len(block))]
    return found


def fingerprint(text: str | Column) -> Column:
    """The fingerprint of each text; null counts as empty, an empty text has an empty fingerprint."""

    @F.arrow_udf("string")
    def written(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for block in blocks(batch):
                chunks = Chunks(block)
                out += [chunks.written(i) for i in range(len(block))]
            yield pa.array(out, pa.string())

    return written(text)


def likeness(a: str | None, b: str | None) -> float:
    """Containment of one written fingerprint in another, from 0 to 1."""

    def read(text):
        pairs = [entry.split(":") for entry in (text or "").split(",") if entry]
        return np.array([int(d, 16) for d, _ in pairs], np.uint64), np.array([int(n) for _, n in pairs], np.int64)

    return containment(read(a), read(b))


# --- each document against the next ------------------------------------------------


def _edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, row_id, text, borrowed) in order; each row is compared with the one after it in its bucket."""
    waiting = None
    for batch in batches:
        buckets, ids, texts, borrowed = (batch.column(i).to_pylist() for i in range(4))
        if waiting:
            buckets, ids, texts, borrowed = ([w, *own] for w, own in zip(waiting, (buckets, ids, texts, borrowed)))
        if not ids:
            continue
        at = [i for i in range(len(ids) - 1) if not borrowed[i] and buckets[i] == buckets[i + 1]]
        waiting = None if borrowed[-1] else (buckets[-1], ids[-1], texts[-1], borrowed[-1])
        own = texts_chunks(texts)
        edited = [_edited(texts[i], texts[i + 1]) for i in at]
        changed = texts_chunks(edited)
        yield pa.RecordBatch.from_arrays([
            pa.array([ids[i] for i in at], pa.int64()),
            pa.array([len(texts[i]) for i in at], pa.int64()),
            pa.array(edited, pa.string()),
            pa.array([own[i][0] for i in at], pa.string()),
            pa.array([c[0] for c in changed], pa.string()),
            pa.array([containment(own[i][1], c[1]) for i, c in zip(at, changed)], pa.float64()),
            pa.array([containment(own[i][1], own[i + 1][1]) for i in at], pa.float64()),
        ], ["row_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def beside_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row its fingerprint, that of its text with the second half taken from the next row, and likeness to both.

    The next row is the one with the next smaller key, for the last the first. Null texts count as empty.
    A null key is the smallest; rows that share a key are ordered by text. Every text is shuffled
    once: keys are cut into even buckets, a bucket is read in order, and only the top row
    of each bucket is sent a second time, to the bucket before.
    """
    spark = docs.sparkSession
    rows, is_key = identified(docs.select(key, text), key, [text])
    n_buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts, tops = _bucketed(rows, text, n_buckets)
    if tops and max(t["n"] for t in tops) > 8 * max(1.0, sum(t["n"] for t in tops) / n_buckets) + 64:
        # Keys that cluster are numbered first, so that buckets are even.
        rows, is_key = number_rows(rows.drop("row_id"), [key, text], "row_id", unique=False), False
        texts, tops = _bucketed(rows, text, n_buckets)
    tops.sort(key=lambda t: t["bucket"])
    before = [(t["top"], tops[i + 1 if i + 1 < len(tops) else 0]["bucket"]) for i, t in enumerate(tops)]
    # One row per bucket, a few per partition: safe to broadcast.
    lent = spark.createDataFrame(before, "row_id long, to int")
    lent = texts.join(F.broadcast(lent), "row_id").select(F.col("to").alias("bucket"), "row_id", "text", F.lit(True).alias("borrowed"))
    ordered = (
        texts.select("bucket", "row_id", "text", F.lit(False).alias("borrowed")).unionByName(lent)
        .repartition(max(1, n_buckets // 4), "bucket")
        .sortWithinPartitions("bucket", "borrowed", F.desc("row_id")))
    found = ordered.mapInArrow(
        _pairs, "row_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, "
                "near_edited double, near_next double")
    return named(found, rows, key, is_key)


def _bucketed(rows: DataFrame, text: str, n_buckets: int) -> tuple[DataFrame, list]:
    """The texts with even key ranges as buckets; per bucket its number of rows and its largest key."""
    low, high = rows.agg(F.min("row_id"), F.max("row_id")).first()
    width = max(1, -(-((high or 0) - (low or 0) + 1) // n_buckets))
    bucket = F.floor((F.col("row_id") - F.lit(low or 0)) / F.lit(width)).cast("int")
    texts = rows.select("row_id", F.coalesce(F.col(text), F.lit("")).alias("text"), bucket.alias("bucket"))
    tops = texts.groupBy("bucket").agg(F.max("row_id").alias("top"), F.count("*").alias("n")).collect()
    return texts, tops
