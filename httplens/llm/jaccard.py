"""Similarity join on word shingles, with Bayesian pruning of candidates (BayesLSH-Lite).

1. Texts with equal shingle sets are one *class*, kept by a 128-bit digest of the set. All further work is on
   classes, so that copies, however many, cost one row.
2. Classes that agree on all MinHash values of a band are candidates. 40 bands of 5 values miss a pair at
   similarity 0.8 with a probability of 1e-7, and less above.
3. Within a bucket, pairs compare their MinHash values step by step. After each step those
   pairs are dropped whose posterior probability of reaching the threshold, given the agreements so far
   and a uniform prior, is below ``tolerance``. Survivors are joined into clusters.
4. In a cluster the same pruning is done once more, and what survives is verified exactly
   on the shingle sets. Links are counted per class, not listed.

A bucket or a cluster beyond ``block`` members is cut into blocks by a hash of the member, and each pair
of blocks is a task's work: memory is bounded and a hot group is spread. What tasks put out grows with
their members, not with their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import lgamma

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from httplens.llm.rows import free_name, identified, named
from httplens.llm.text import SOLID, Words, blocks, mix, released, windows
from httplens.session import stage

SHINGLE, THRESHOLD = 5, 0.8
BANDS, BAND = 40, 5
TOLERANCE = 1e-7
BLOCK = 1024
STEP = 20
SMALL = 16
SALTS = 256

_RANDOM = np.random.default_rng(31)
_N = BANDS * BAND
_FACTORS = _RANDOM.integers(1, 1 << 32, _N, dtype=np.uint32) | np.uint32(1)
_SHIFTS = _RANDOM.integers(0, 1 << 32, _N, dtype=np.uint32)
_BAND_FACTORS = _RANDOM.integers(1, 1 << 62, (BANDS, BAND), dtype=np.uint64) | np.uint64(1)


# --- shingle sets and their MinHash values -----------------------------------------


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text; shorter texts are one shingle, empty ones have none."""
    for block in blocks(texts):
        words = Words(block, SOLID)
        hashes = words.hashes(block, seed=3)
        grams = windows(hashes, size, seed=17)
        for i in range(len(block)):
            a, b = int(words.first[i]), int(words.first[i + 1])
            if b - a >= size:
                yield np.unique(grams[a:b - size + 1])
            elif b > a:
                yield windows(hashes[a:b], b - a, seed=17)
            else:
                yield np.zeros(0, np.uint64)


def minhash(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of each of the hash functions over a set."""
    if not len(shingles):
        return np.zeros(_N, np.uint32)
    h = (shingles >> np.uint64(32)).astype(np.uint32)
    smallest = np.full(_N, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(h), 512):
        values = h[at:at + 512, None] * _FACTORS + _SHIFTS
        np.minimum(smallest, values.min(axis=0), out=smallest)
    return smallest


def _described(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Per text: digest and size of its set, MinHash values cut to a byte each, and a hash per band."""
    for batch in batches:
        keys, sizes, signs, bands = [], [], [], []
        for own in shingle_sets(batch.column(1), size):
            values = minhash(own)
            keys.append(_digest(own))
            sizes.append(len(own))
            signs.append((mix(values.astype(np.uint64)) & np.uint64(255)).astype(np.uint8).tobytes())
            parts = (values.reshape(BANDS, BAND).astype(np.uint64) + np.uint64(1)) * _BAND_FACTORS
            bands.append(mix(mix(parts).sum(axis=1, dtype=np.uint64)).view(np.int64))
        flat = np.concatenate(bands) if bands else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(signs, pa.binary()),
             pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BANDS), pa.int32()), pa.array(flat))],
            ["row_id", "digest", "n_shingles", "sign", "bands"])


def _digest(own: np.ndarray) -> bytes:
    place = np.arange(1, len(own) + 1, dtype=np.uint64)
    return b"".join(
        int((mix(own ^ np.uint64(salt)) * (2 * place + np.uint64(1))).sum(dtype=np.uint64)).to_bytes(8, "big")
        for salt in (0x51, 0xA7))


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [own.tobytes() for own in shingle_sets(batch.column(1), size)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["class_id", "shingles"])


# --- Bayesian pruning ----------------------------------------------------------------


@cache
def least_agreements(n: int, threshold: float, tolerance: float) -> int:
    """The fewest agreements of ``n`` MinHash bytes with which a pair may still reach the threshold.

    Bytes agree with probability p = s + (1 - s) / 256 at similarity s. With a uniform prior on s the
    posterior of p after m agreements is Beta(m + 1, n - m + 1), cut to p >= 1/256.
    """
    grid = np.linspace(1 / 256, 1, 20001)[1:-1]
    reach = grid >= threshold + (1 - threshold) / 256
    for m in range(n + 1):
        logs = m * np.log(grid) + (n - m) * np.log1p(-grid) + lgamma(n + 2) - lgamma(m + 1) - lgamma(n - m + 1)
        density = np.exp(logs - logs.max())
        if density[reach].sum() / density.sum() >= tolerance:
            return m
    return n


def survivors(signs: np.ndarray, x: np.ndarray, y: np.ndarray, threshold: float, tolerance: float):
    """Those of the pairs of rows (x, y) that no step drops."""
    count = np.zeros(len(x), np.uint16)
    for done in range(0, signs.shape[1], STEP):
        count += (signs[x, done:done + STEP] == signs[y, done:done + STEP]).sum(axis=1).astype(np.uint16)
        stay = count >= least_agreements(min(done + STEP, signs.shape[1]), threshold, tolerance)
        x, y, count = x[stay], y[stay], count[stay]
    return x, y


# --- groups in blocks ----------------------------------------------------------------


def in_block_pairs(members: DataFrame, group: str, size: str, member: str, block: int) -> DataFrame:
    """``members`` with ``_i``, ``_j``, ``_own``: each pair of blocks of a group, and which of both the member is in.

    A group of up to ``block`` members is one block. Otherwise a member is in one of ``n`` blocks, and is sent
    to the ``n`` pairs that its block is part of.
    """
    n = F.ceil(F.col(size) / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64(member), n).cast("int")
    others = F.when(n > 1, F.sequence(F.lit(0), n - 1)).otherwise(F.array(F.lit(0)))
    spread = members.withColumn("_own", own).withColumn("_other", F.explode(others))
    return spread.select(
        *members.columns, "_own", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"))


def _starts(frame: pd.DataFrame, keys: list[str]) -> np.ndarray:
    change = np.ones(len(frame), bool)
    change[1:] = False
    for key in keys:
        values = frame[key].to_numpy()
        change[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(change)


def _whole_groups(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Rows sorted by ``keys``, cut between groups only. A group is a pair of blocks, so what is held back is bounded."""
    held = None
    for frame in frames:
        frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
        if frame.empty:
            continue
        last = int(_starts(frame, keys)[-1])
        if last:
            yield frame.iloc[:last].reset_index(drop=True)
        held = frame.iloc[last:].reset_index(drop=True)
    if held is not None and len(held):
        yield held


def _within_groups(frame: pd.DataFrame, keys: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs to compare, each once: of a block with itself, or of one block with the other."""
    starts = _starts(frame, keys)
    sizes = np.diff(np.append(starts, len(frame)))
    i, j, own = (frame[c].to_numpy() for c in ("_i", "_j", "_own"))
    small = (sizes <= SMALL) & (i[starts] == j[starts])
    left = np.where(small, sizes, 0)
    room = np.repeat(left, sizes) - (np.arange(len(frame)) - np.repeat(starts, sizes))
    for apart in range(1, int(left.max(initial=0))):
        x = np.flatnonzero(room > apart)
        yield x, x + apart
    for at, size in zip(starts[~small].tolist(), sizes[~small].tolist()):
        rows = np.arange(at, at + size)
        if i[at] == j[at]:
            first, second = rows, rows
        else:
            first, second = rows[own[at:at + size] == i[at]], rows[own[at:at + size] == j[at]]
        for k in range(0, len(first), 64):
            part = first[k:k + 64]
            x, y = np.repeat(part, len(second)), np.tile(second, len(part))
            if first is second:
                once = x < y
                x, y = x[once], y[once]
            yield x, y


def _surviving(frame: pd.DataFrame, keys: list[str], threshold: float, tolerance: float):
    signs = np.frombuffer(b"".join(frame["sign"]), np.uint8).reshape(len(frame), _N)
    none = np.zeros(0, np.int64)
    found = [(none, none), *(survivors(signs, x, y, threshold, tolerance) for x, y in _within_groups(frame, keys))]
    return tuple(np.concatenate(side) for side in zip(*found))


def _tree(n: int, x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect whatever the pairs connect, at most n - 1."""
    root, kept = list(range(n)), []

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for u, v in zip(x.tolist(), y.tolist()):
        p, q = find(u), find(v)
        if p != q:
            root[q] = p
            kept.append((u, v))
    return kept


def _bucket_edges(frames, threshold: float, tolerance: float) -> Iterator[pd.DataFrame]:
    keys = ["bucket", "_i", "_j"]
    for frame in _whole_groups(frames, keys):
        ids = frame["class_id"].to_numpy()
        x, y = _surviving(frame, keys, threshold, tolerance)
        edges = _tree(len(ids), x, y)
        if edges:
            u, v = (ids[list(e)] for e in zip(*edges))
            yield pd.DataFrame({"a": np.minimum(u, v), "b": np.maximum(u, v)})


def _verified(frames, threshold: float, tolerance: float) -> Iterator[pd.DataFrame]:
    """Per member of pairs of blocks its number of links there, weighted by copies, and a tree of the links."""
    keys = ["cluster", "_i", "_j"]
    for frame in _whole_groups(frames, keys):
        ids = frame["class_id"].to_numpy()
        x, y = _surviving(frame, keys, threshold, tolerance)
        sets = [np.frombuffer(s, np.uint64) for s in frame["shingles"]]
        sizes = np.array([len(s) for s in sets], np.int64)
        good = np.minimum(sizes[x], sizes[y]) >= threshold * np.maximum(sizes[x], sizes[y])
        x, y = x[good], y[good]
        linked = np.zeros(len(x), bool)
        for k, (i, j) in enumerate(zip(x.tolist(), y.tolist())):
            at = np.searchsorted(sets[i], sets[j])
            at[at == len(sets[i])] = 0
            shared = int((sets[i][at] == sets[j]).sum())
            linked[k] = shared >= threshold * (sizes[i] + sizes[j] - shared) - 1e-9
        x, y = x[linked], y[linked]
        copies = frame["n_copies"].to_numpy()
        links = np.bincount(x, copies[y], len(ids)) + np.bincount(y, copies[x], len(ids))
        classes = np.bincount(x, minlength=len(ids)) + np.bincount(y, minlength=len(ids))
        some = np.flatnonzero(classes)
        tree = _tree(len(ids), x, y)
        parent = [int(ids[u]) for u, _ in tree]
        child = [int(ids[v]) for _, v in tree]
        yield pd.DataFrame({
            "class_id": np.concatenate([ids[some], np.array(child, np.int64)]),
            "n_links": np.concatenate([links[some].astype(np.int64), np.zeros(len(tree), np.int64)]),
            "n_class_links": np.concatenate([classes[some].astype(np.int64), np.zeros(len(tree), np.int64)]),
            "other": np.concatenate([ids[some], np.array(parent, np.int64)]),
        })


# --- connected components --------------------------------------------------------------


def _with_least(pairs: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with ``m``, the smallest ``b`` of their ``a``.

    The pairs of an ``a`` are dealt over :data:`SALTS` by their ``b``. Each salt gives its own minimum, the minima
    of an ``a`` are a bounded number of rows, and theirs goes back to the salts: a star of any size is spread.
    """
    salted = pairs.withColumn("salt", F.pmod(F.hash("b"), F.lit(SALTS)))
    own = salted.groupBy("a", "salt").agg(F.min("b").alias("m"))
    least = own.groupBy("a").agg(F.min("m").alias("m"))
    return salted.join(own.select("a", "salt").join(least, "a"), ["a", "salt"]).select("a", "b", "m")


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, its component's smallest node, for all nodes of ``edges`` (a, b).

    Alternates large-star and small-star steps: each round is a few shuffles of narrow rows, is written to
    the shared folder, and the number of rounds grows with the logarithm of the component.
    No task gets a whole star: its pairs are salted (:func:`_with_least`).
    """
    both = edges.where("a <> b").select("a", "b")
    pairs = stage(both.distinct(), "links")
    while True:
        ways = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = _with_least(ways).select("b", F.least("a", "m").alias("m"), "a").where("b > a")
        down = near.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Every node is greater than what it hangs on now: its pairs go down to the smallest of them.
        moved = F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b"))))
        small = _with_least(down).select(moved.alias("pair")).select("pair.*").where("a <> b").distinct()
        after = stage(small, "links")
        # Done once every node hangs on one smaller node that is a root itself.
        hanging = after.select(F.col("a").alias("node")).intersect(after.select(F.col("b").alias("node")))
        many = after.groupBy("a").count().where("count > 1")
        if hanging.isEmpty() and many.isEmpty():
            roots = after.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
        pairs = after


# --- the join ----------------------------------------------------------------------------


def similar(
    docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, threshold: float = THRESHOLD,
    tolerance: float = TOLERANCE, block: int = BLOCK,
) -> DataFrame:
    """Per row: key, ``class_id``, ``n_copies``, ``n_links``, ``group_id``.

    ``class_id`` is the smallest row number with the same shingle set (the key, where that is unique and
    not null), ``n_copies`` the rows of the class. ``n_links`` counts the other rows whose similarity is at least
    the threshold, copies among them. ``group_id`` is the smallest class that is reached over links.
    Null and empty texts have no shingles and are copies of each other. A null key comes
    first; rows that share a key are ordered by their texts.
    """
    rows, is_key = identified(docs.select(key, text), key, [text])
    return named(_similar(rows, text, size, threshold, tolerance, block), rows, key, is_key)


def _similar(rows, text, size, threshold, tolerance, block) -> DataFrame:
    texts = rows.select("row_id", F.coalesce(F.col(text), F.lit("")).alias("text"))
    described = stage(texts.mapInArrow(
        released(lambda b: _described(b, size)),
        "row_id long, digest binary, n_shingles int, sign binary, bands array<long>"), "described")
    classes = stage(described.groupBy("digest").agg(
        F.min("row_id").alias("class_id"), F.count("*").alias("n_copies")), "classes")
    firsts = classes.select(F.col("class_id").alias("row_id"), "n_copies")
    signed = stage(described.where("n_shingles > 0").join(firsts, "row_id").select(
        F.col("row_id").alias("class_id"), "n_copies", "sign", "bands"), "signed")

    places = signed.select("class_id", F.explode("bands").alias("bucket"))
    shared = places.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = places.join(shared, "bucket").join(signed.select("class_id", "sign"), "class_id")
    spread = in_block_pairs(members, "bucket", "size", "class_id", block)
    edges = _sorted(spread, ["bucket", "_i", "_j"]).select("bucket", "class_id", "sign", "_own", "_i", "_j").mapInPandas(
        released(lambda f: _bucket_edges(f, threshold, tolerance)), "a long, b long")

    clusters = stage(components(edges).select(F.col("node").alias("class_id"), F.col("root").alias("cluster")), "clusters")
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("size"))
    own = clusters.join(sizes, "cluster")
    sets = texts.join(clusters.select(F.col("class_id").alias("row_id")), "row_id", "left_semi").mapInArrow(
        released(lambda b: _sets(b, size)), "class_id long, shingles binary")
    clustered = sets.join(own, "class_id").join(signed.drop("bands"), "class_id")
    spread = in_block_pairs(clustered, "cluster", "size", "class_id", block)
    found = stage(_sorted(spread, ["cluster", "_i", "_j"]).mapInPandas(
        released(lambda f: _verified(f, threshold, tolerance)),
        "class_id long, n_links long, n_class_links long, other long"), "found")
    links = found.where("n_class_links > 0").groupBy("class_id").agg(
        F.sum("n_links").alias("n_links"), F.sum("n_class_links").alias("n_class_links"))
    groups = components(found.where("n_class_links = 0").select(F.col("other").alias("a"), F.col("class_id").alias("b")))
    groups = groups.select(F.col("node").alias("class_id"), F.col("root").alias("group_id"))

    about = classes.join(links, "class_id", "left").join(groups, "class_id", "left").select(
        "digest", "class_id", "n_copies",
        (F.col("n_copies") - 1 + F.coalesce("n_links", F.lit(0))).alias("n_links"),
        F.coalesce("group_id", "class_id").alias("group_id"))
    return described.select("row_id", "digest").join(about, "digest").select("row_id", "class_id", "n_copies", "n_links", "group_id")


def _sorted(spread: DataFrame, keys: list[str]) -> DataFrame:
    return spread.repartition(*keys).sortWithinPartitions(*keys)


def one_of_each_group(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each group of similar texts: that with the smallest key.

    All columns stay. Rows with a null key, or that share one, are told apart by their texts.
    """
    number = free_name("row_id", docs.columns)
    rows, _ = identified(docs, key, docs.columns, number)
    found = _similar(
        rows.select(F.col(number).alias("row_id"), F.col(text).alias("text")), "text", options.get("size", SHINGLE),
        options.get("threshold", THRESHOLD), options.get("tolerance", TOLERANCE), options.get("block", BLOCK))
    kept = found.where("row_id = group_id").select(F.col("row_id").alias(number))
    return rows.join(kept, number, "left_semi").select(*docs.columns)
