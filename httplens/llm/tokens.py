"""Token ids of many texts at once.

Byte-level BPE cuts a text at white space before it merges, so that a run of white space and what follows it up to
the next can be encoded by itself. Such chunks repeat; each task keeps those it has met, by a 64-bit
hash, in a table of fixed size where a newer chunk takes an older one's place, and encodes only what
is not there. Texts with special tokens or white space beyond ASCII, and chunks beyond Latin letters, go to
the tokenizer as they are.
"""

from __future__ import annotations

import base64
import re

import numpy as np

from httplens.llm.text import KEPT, Block, _letters, _powers, mix

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

# White space that ASCII does not have, in UTF-8.
_WIDE_SPACE = rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80"

_SLOTS = 1 << 19
_KNOWN_IDS = 1 << 21


class Encoder:
    """Ids by a tokenizer's file; ``ranks``, the same vocabulary as ranks, makes new chunks cheaper."""

    def __init__(self, path: str, ranks: str | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.quick, self.lengths = _quick(ranks) if ranks else (None, None)
        special = [re.escape(t.content.encode()) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = re.compile(b"|".join([_WIDE_SPACE, *special]))
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(_SLOTS, np.uint64)
        self.at, self.size = np.zeros(_SLOTS, np.int32), np.zeros(_SLOTS, np.int32)
        self.ids, self.used = np.zeros(1 << 18, np.uint32), 0

    def plain(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def block(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts of a block one after the other, and where each text's begin."""
        n, data = len(block.data), block.data
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(block) + 1, np.int64)
        space = _SPACE[data]
        cut = space.copy()
        cut[1:] &= ~space[:-1]
        cut[block.bounds[:-1][block.bounds[:-1] < n]] = True
        starts = np.flatnonzero(cut)
        lengths = np.diff(np.append(starts, n))
        place = np.arange(n) - np.repeat(starts, lengths)
        values = _letters(41)[data] * _powers(int(lengths.max()), 41)[place]
        hashes = mix(np.add.reduceat(values, starts) + lengths.astype(np.uint64))
        at, sizes = self._places(block, hashes, starts, lengths)
        ends = np.cumsum(sizes)
        ids = self.ids[np.repeat(at - (ends - sizes), sizes) + np.arange(int(ends[-1]))]
        bounds = np.append(0, ends)[np.searchsorted(starts, block.bounds)]
        if self.odd.search(data.tobytes()):
            return self._with_odd(block, ids, bounds)
        return ids, bounds

    def _with_odd(self, block: Block, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts = []
        for i in range(len(block)):
            own = block.text(i)
            parts.append(np.array(self.plain(own.decode()), np.uint32) if self.odd.search(own) else ids[bounds[i]:bounds[i + 1]])
        return np.concatenate(parts), np.cumsum([0, *map(len, parts)])

    def _places(self, block: Block, hashes: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        """Where the ids of each chunk are among the known ids, and how many."""
        if self.used > _KNOWN_IDS:
            self._forget()
        slots = (hashes & np.uint64(_SLOTS - 1)).astype(np.int64)
        at, sizes = self.at[slots].astype(np.int64), self.size[slots].astype(np.int64)
        absent = np.flatnonzero(self.keys[slots] != hashes)
        if len(absent):
            _, first, which = np.unique(hashes[absent], return_index=True, return_inverse=True)
            first = absent[first]
            ids, places, counts = self._encode(block, starts[first], lengths[first])
            self.ids = _room(self.ids, self.used + len(ids))
            self.ids[self.used:self.used + len(ids)] = ids
            places = places + self.used
            self.used += len(ids)
            at[absent], sizes[absent] = places[which], counts[which]
            # Where two new chunks meet in one slot one of them stays, with its own key and place.
            own, order = np.unique(slots[first], return_index=True)
            self.keys[own], self.at[own], self.size[own] = hashes[first[order]], places[order], counts[order]
        return at, sizes

    def _encode(self, block: Block, starts: np.ndarray, lengths: np.ndarray):
        """The ids of the chunks, where each chunk's begin and how many there are."""
        data = block.data.tobytes()
        chunks = [data[a:a + n] for a, n in zip(starts.tolist(), lengths.tolist())]
        alone = np.ones(len(chunks), bool)
        ids, counts = np.zeros(0, np.uint32), np.zeros(len(chunks), np.int64)
        if self.quick and block.data.max() < 0xC9:
            # Chunks of white space and a word do not merge with each other: all are encoded as one text, and
            # cut again by the length of each id in bytes.
            alone = ~_SPACE[block.data[starts]] | _SPACE[block.data[starts + lengths - 1]]
            joined = np.flatnonzero(~alone)
            ids = self.quick.encode_to_numpy(b"".join([chunks[k] for k in joined.tolist()]).decode())
            ends = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum(lengths[joined]), "left") + 1
            counts[joined] = np.diff(np.append(0, ends))
        single = np.flatnonzero(alone)
        lists = [self.plain(chunks[k].decode()) for k in single.tolist()]
        counts[single] = [len(own) for own in lists]
        order = np.concatenate([np.flatnonzero(~alone), single])
        places = np.zeros(len(chunks), np.int64)
        places[order] = np.cumsum(counts[order]) - counts[order]
        return np.concatenate([ids, *(np.array(own, np.uint32) for own in lists)]), places, counts


def _room(values: np.ndarray, n: int) -> np.ndarray:
    return values if n <= len(values) else np.concatenate([values, np.zeros(max(n, 2 * len(values)) - len(values), values.dtype)])


def _quick(ranks: str):
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    lengths = np.zeros(max(table.values()) + 1, np.int64)
    lengths[list(table.values())] = [len(token) for token in table]
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}), lengths


_ENCODERS: dict[tuple, Encoder] = {}
KEPT.append(_ENCODERS)


def encoder(path: str, ranks: str | None = None) -> Encoder:
    """One encoder per task."""
    found = _ENCODERS.get((path, ranks))
    if found is None:
        found = _ENCODERS[path, ranks] = Encoder(path, ranks)
    return found
