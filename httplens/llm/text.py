"""Words of many texts at once, as numpy arrays over UTF-8 bytes.

A text column arrives in Arrow batches. Its bytes are worked on in blocks of a few
megabytes, so that memory is bounded by the block (or by one text, where that is longer).
A null text counts as an empty one.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 19

# Words of the contamination rule: letters and digits of ASCII, and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

# Words between ASCII white space.
SOLID = np.ones(256, bool)
SOLID[[0x20, *range(0x09, 0x0E)]] = False

# Lines.
NO_BREAK = np.ones(256, bool)
NO_BREAK[0x0A] = False

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


# What a task keeps while it runs: powers of hash bases, encoders.
KEPT: list[dict] = []


def released(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same task, after which its worker gives back what it took.

    Workers outlive their tasks and are used by later stages; what one stage keeps is missing in the next.
    """
    @wraps(task)
    def run(batches):
        try:
            yield from task(batches)
        finally:
            for kept in KEPT:
                kept.clear()
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return run


class Block:
    """Consecutive texts of a batch: their bytes, and where each begins in them."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, first: int):
        self.data, self.bounds, self.first = data, bounds, first

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.bounds[i]:self.bounds[i + 1]].tobytes()


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """The texts in order, as blocks of at most ``limit`` bytes or of one longer text."""
    if len(texts) == 0:
        return
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        last = min(last, len(texts))
        yield Block(data[at[first]:at[last]], at[first:last + 1] - at[first], first)
        first = last


class Words:
    """Where the words of a block start and end, and the first word of each text."""

    def __init__(self, block: Block, kind: np.ndarray):
        inside = kind[block.data]
        n = len(inside)
        edge = np.zeros(n + 1, bool)
        edge[block.bounds] = True
        before = np.zeros(n + 1, bool)
        before[1:] = inside
        after = np.zeros(n + 1, bool)
        after[:n] = inside
        self.starts = np.flatnonzero(after & (edge | ~before))
        self.ends = np.flatnonzero(before & (edge | ~after))
        self.first = np.searchsorted(self.starts, block.bounds)
        self.counts = np.diff(self.first)
        self._inside = np.flatnonzero(inside)

    def __len__(self) -> int:
        return len(self.starts)

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self, block: Block, seed: int = 1, fold: np.ndarray | None = None) -> np.ndarray:
        """A 64-bit hash of each word; ``fold`` maps bytes first, as to lower case."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        lengths = self.ends - self.starts
        at = np.cumsum(lengths) - lengths
        place = np.arange(len(self._inside)) - np.repeat(at, lengths)
        letters = block.data[self._inside]
        if fold is not None:
            letters = fold[letters]
        values = _letters(seed)[letters] * _powers(int(lengths.max()), seed)[place]
        return mix(np.add.reduceat(values, at) + lengths.astype(np.uint64))


def _letters(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1 << 62, 1 << 63, 256, dtype=np.uint64)


_POWERS: dict[int, np.ndarray] = {}
KEPT.append(_POWERS)


def _powers(n: int, seed: int) -> np.ndarray:
    known = _POWERS.get(seed)
    if known is None or len(known) < n:
        base = int(np.random.default_rng(seed + 1000).integers(1 << 62, 1 << 63)) | 1
        steps = np.full(max(64, 1 << (n - 1).bit_length()), base, np.uint64)
        steps[0] = 1
        known = _POWERS[seed] = np.multiply.accumulate(steps)
    return known


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def windows(hashes: np.ndarray, size: int, seed: int = 7) -> np.ndarray:
    """A hash of each ``size`` consecutive values; windows that cross texts are the caller's to leave out."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = np.uint64(int(np.random.default_rng(seed).integers(1 << 62, 1 << 63)) | 1)
    total = hashes[:n].copy()
    for i in range(1, size):
        total *= base
        total += hashes[i:i + n]
    return mix(total)


def within(words: Words, size: int) -> np.ndarray:
    """Whether the window of ``size`` words from each word on lies within one text."""
    n = max(0, len(words) - size + 1)
    last = np.repeat(words.first[1:], words.counts)[:n]
    return np.arange(n) + size <= last


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` places lie in at least one of the half-open spans."""
    change = np.bincount(starts, minlength=n + 1) - np.bincount(ends, minlength=n + 1)
    return np.cumsum(change[:n]) > 0
