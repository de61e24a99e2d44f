"""Quality classifier: histogram gradient-boosted trees over statistics of a text.

The statistics are counted from the bytes of whole texts. Trees are fitted to the logistic loss on binned values,
on at most ``max_labels`` labelled rows (those with the smallest hash of the key). Every tree is a full binary
tree of fixed depth in flat arrays, so that scoring is a walk of all rows at once, level by level.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from httplens.llm.text import ALNUM, LOWER, NO_BREAK, SOLID, Block, Words, blocks, released

MAX_LABELS = 20_000
TREES, DEPTH, BINS, RATE, L2 = 80, 4, 64, 0.15, 2.0

STATISTICS = (
    "log_bytes", "words", "mean_word", "sd_word", "longest_word", "upper", "lower", "digit", "space", "line_breaks",
    "comma", "stop", "shout", "bar", "hash_dollar", "percent_amp_star", "other_punctuation", "beyond_ascii", "entropy",
    "upper_words", "number_words", "symbol_words", "distinct_words", "top_word", "distinct_lines", "mean_line", "short_words")


def _share(hist: np.ndarray, codes, total: np.ndarray) -> np.ndarray:
    return hist[:, list(codes)].sum(axis=1) / total


def _of_words(values: np.ndarray, owner: np.ndarray, n: int, counts: np.ndarray) -> np.ndarray:
    return np.bincount(owner, values, n) / np.maximum(counts, 1)


def _distinct(words: Words, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text the number of different words, and how often the most frequent one occurs."""
    owner = words.owner()
    order = np.lexsort((hashes, owner))
    own, h = owner[order], hashes[order]
    new = np.ones(len(order), bool)
    new[1:] = (own[1:] != own[:-1]) | (h[1:] != h[:-1])
    heads = np.flatnonzero(new)
    times = np.diff(np.append(heads, len(order)))
    most = np.zeros(n)
    np.maximum.at(most, own[heads], times)
    return np.bincount(own[heads], minlength=n), most


def statistics(block: Block) -> np.ndarray:
    """A row of :data:`STATISTICS` per text; an empty text has zeros."""
    n, data = len(block), block.data
    sizes = np.diff(block.bounds)
    text = np.repeat(np.arange(n), sizes)
    hist = np.bincount(text * 256 + data, minlength=n * 256).reshape(n, 256).astype(np.float64)
    total = np.maximum(sizes, 1).astype(np.float64)
    share = hist / total[:, None]
    entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1)

    words = Words(block, SOLID)
    owner, counts = words.owner(), words.counts
    lengths = (words.ends - words.starts).astype(np.float64)
    mean = _of_words(lengths, owner, n, counts)
    spread = np.sqrt(np.maximum(_of_words(lengths ** 2, owner, n, counts) - mean ** 2, 0))
    longest = np.zeros(n)
    np.maximum.at(longest, owner, lengths)
    first = data[words.starts] if len(words) else np.zeros(0, np.uint8)
    last = data[words.ends - 1] if len(words) else np.zeros(0, np.uint8)
    distinct, most = _distinct(words, words.hashes(block, seed=5, fold=LOWER), n)

    lines = Words(block, NO_BREAK)
    n_lines = np.maximum(lines.counts, 1)
    distinct_lines, _ = _distinct(lines, lines.hashes(block, seed=6), n)
    upper = range(0x41, 0x5B)
    named = set(b",.!|#$%&*") | {0x20, *range(0x09, 0x0E)}
    other = [c for c in range(0x21, 0x80) if not ALNUM[c] and c not in named]
    return np.column_stack([
        np.log1p(sizes), np.log1p(counts), mean, spread, np.log1p(longest), _share(hist, upper, total),
        _share(hist, range(0x61, 0x7B), total), _share(hist, range(0x30, 0x3A), total), _share(hist, [0x20, 9, 13], total),
        _share(hist, [10], total), _share(hist, b",", total), _share(hist, b".", total), _share(hist, b"!", total),
        _share(hist, b"|", total), _share(hist, b"#$", total), _share(hist, b"%&*", total), _share(hist, other, total),
        _share(hist, range(0x80, 0x100), total), entropy,
        _of_words(((first >= 0x41) & (first <= 0x5A)).astype(float), owner, n, counts),
        _of_words(((first >= 0x30) & (first <= 0x39)).astype(float), owner, n, counts),
        _of_words((~ALNUM[last]).astype(float), owner, n, counts),
        distinct / np.maximum(counts, 1), most / np.maximum(counts, 1), distinct_lines / n_lines,
        np.log1p(counts / n_lines), _of_words((lengths <= 3).astype(float), owner, n, counts),
    ]).astype(np.float32)


def all_statistics(texts: pa.Array) -> np.ndarray:
    found = [statistics(block) for block in blocks(texts)]
    return np.concatenate(found) if found else np.zeros((0, len(STATISTICS)), np.float32)


# --- boosted trees ------------------------------------------------------------------------


@dataclass
class Trees:
    """Full binary trees: node k has children 2k + 1 and 2k + 2; the last level's values are in ``leaf``."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    start: float
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - (2 ** self.depth - 1)]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def edges_of(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Upper edges of the bins of each column, between different values."""
    found = []
    for column in x.T:
        cuts = np.unique(np.quantile(column, np.arange(1, bins) / bins, method="lower")) if len(column) else np.zeros(0)
        found.append(cuts[cuts < column.max()] if len(column) else cuts)
    return found


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE,
        l2: float = L2) -> Trees:
    """Boosted trees for labels 0 and 1. Without rows of both labels the score is the share of ones (a half of none)."""
    inner, leaves = 2 ** depth - 1, 2 ** depth
    share = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    feature = np.zeros((trees, inner), np.int32)
    threshold = np.full((trees, inner), np.inf)
    leaf = np.zeros((trees, leaves))
    made = Trees(feature, threshold, leaf, start, depth)
    if len(np.unique(y)) < 2:
        made.feature, made.threshold, made.leaf = feature[:0], threshold[:0], leaf[:0]
        return made
    edges = edges_of(x, bins)
    binned = np.column_stack([np.searchsorted(cuts, column, "left") for cuts, column in zip(edges, x.T)])
    width, n_features = bins, x.shape[1]
    cells = binned + np.arange(n_features) * width
    raw = np.full(len(y), start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        gradient, weight = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, count = 2 ** level - 1, 2 ** level
            at = ((node - first)[:, None] * (n_features * width) + cells).ravel()
            shape = (count, n_features, width)
            g = np.bincount(at, np.repeat(gradient, n_features), count * n_features * width).reshape(shape).cumsum(axis=2)
            h = np.bincount(at, np.repeat(weight, n_features), count * n_features * width).reshape(shape).cumsum(axis=2)
            all_g, all_h = g[:, :, -1:], h[:, :, -1:]
            gain = g ** 2 / (h + l2) + (all_g - g) ** 2 / (all_h - h + l2) - all_g ** 2 / (all_h + l2)
            gain[(h < 1e-3) | (all_h - h < 1e-3)] = 0
            for f, cuts in enumerate(edges):
                gain[:, f, len(cuts):] = 0
            best = gain.reshape(count, -1).argmax(axis=1)
            for k in range(count):
                f, b = divmod(int(best[k]), width)
                if gain[k, f, b] > 1e-6:
                    feature[t, first + k], threshold[t, first + k] = f, edges[f][b]
            right = x[np.arange(len(y)), feature[t, node]] > threshold[t, node]
            node = 2 * node + 1 + right
        own = node - inner
        g, h = np.bincount(own, gradient, leaves), np.bincount(own, weight, leaves)
        leaf[t] = -rate * g / (h + l2)
        raw += leaf[t, own]
    return made


# --- on tables ---------------------------------------------------------------------------------


def training_rows(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str,
                  max_labels: int) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of at most ``max_labels`` labelled documents, those with the smallest hash of the key.

    A key with several labels takes their mean, rounded, a half as 0; null keys and labels are left out, and of documents
    that share a key the smallest text counts.
    """
    marked = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(
        (F.avg(label) > 0.5).cast("int").alias("_label"))
    # At most ``max_labels`` narrow rows: safe to broadcast, so that only their texts leave the scan.
    chosen = marked.orderBy(F.xxhash64(key), key).limit(max_labels)
    own = docs.select(key, text).join(F.broadcast(chosen), key)
    own = own.groupBy(key, "_label").agg(F.min(F.coalesce(text, F.lit(""))).alias("_text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = all_statistics(batch.column(2))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.string()), batch.column(1), pa.array(rows.astype(np.float64).tolist(), pa.list_(pa.float64()))],
                ["key", "label", "x"])

    found = sorted(own.mapInArrow(released(counted), "key string, label int, x array<double>").collect())
    x = np.array([r.x for r in found], np.float32).reshape(len(found), len(STATISTICS))
    return x, np.array([r.label for r in found], np.float64)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
          max_labels: int = MAX_LABELS, **options) -> Trees:
    return fit(*training_rows(docs, labels, key, text, label, max_labels), **options)


def score(text: str | Column, model: Trees) -> Column:
    """The probability of label 1 by the statistics of each text alone; a null text counts as empty."""

    @F.arrow_udf("double")
    @released
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = [model.score(statistics(block)) for block in blocks(texts)]
            yield pa.array(np.concatenate(found) if found else np.zeros(0), pa.float64())

    return scored(text)


def held_out(key: str | Column) -> Column:
    """Rows kept from training: those whose key's text has a CRC-32 of remainder 1 by 3."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))
