"""N-grams of a batch of texts, interned in an open-addressed NumPy table."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

from panelforecast.llm.common import gather

SEED = 0
#: N-grams of fewer bytes are hashed and compared side by side, as four 64-bit lanes.
SHORT = 32
#: Occurrences of one table; a text of any length is interned in several.
GRAMS_AT_ONCE = 1 << 19
# The primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(0x9E3779B185EBCA87), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9),
    np.uint64(0x85EBCA77C2B2AE63), np.uint64(0x27D4EB2F165667C5),
)


def _word_bytes() -> np.ndarray:
    """For every byte its lower case if it belongs to words, else 0: digits, letters and all of UTF-8 beyond ASCII."""
    table = np.zeros(256, np.uint8)
    for low, high in ((0x30, 0x3A), (0x61, 0x7B), (0x80, 0x100)):
        table[low:high] = np.arange(low, high)
    table[0x41:0x5B] = np.arange(0x61, 0x7B)
    return table


_WORD = _word_bytes()
_KEEP = (np.arange(SHORT)[None, :] < np.arange(SHORT + 1)[:, None]).astype(np.uint8) * np.uint8(255)


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _hash_short(lanes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """XXH64 of inputs of fewer than 32 bytes, zero-padded to four lanes each."""
    size = lengths.astype(np.uint64)
    h = np.uint64(SEED) + _P5 + size
    for at in range(3):
        full = size >= 8 * (at + 1)
        h = np.where(full, _turn(h ^ (_turn(lanes[:, at] * _P2, 31) * _P1), 27) * _P1 + _P4, h)
    rest = lanes[np.arange(len(lanes)), lengths // 8]
    four = (size & np.uint64(4)) != 0
    h = np.where(four, _turn(h ^ ((rest & np.uint64(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3, h)
    rest = np.where(four, rest >> np.uint64(32), rest)
    for at in range(3):
        byte = (rest >> np.uint64(8 * at)) & np.uint64(255)
        h = np.where((size & np.uint64(3)) > at, _turn(h ^ (byte * _P5), 11) * _P1, h)
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


class Words:
    """The words of a column of texts, in one buffer with one space after each.

    Words are runs of digits, ASCII letters (in lower case) and characters beyond ASCII.
    Null texts have none. ``doc`` tells each word's text, and words of a text are adjacent.
    """

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        edges = offsets - offsets[0]
        lower = _WORD[raw]
        inside = np.zeros(len(raw) + 2, bool)
        inside[1:-1] = lower != 0
        inner = edges[(edges > 0) & (edges < len(raw))]
        first, last = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
        first[inner] = inside[1:-1][inner]  # a text's end ends its last word
        last[inner - 1] = inside[1:-1][inner - 1]
        starts = np.flatnonzero(first)
        lengths = np.flatnonzero(last) + 1 - starts
        self.texts = len(texts)
        self.doc = np.searchsorted(edges, starts, side="right") - 1
        self.starts = np.cumsum(lengths + 1) - (lengths + 1)
        self.lengths = lengths
        self.buffer = np.full(int((lengths + 1).sum()) + SHORT, 32, np.uint8)
        self.buffer[gather(self.starts, lengths)] = lower[gather(starts, lengths)]

    def grams(self, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(doc, start, length)`` of every run of 1 to ``order`` words of one text, joined by single spaces."""
        doc, start, length = [], [], []
        for more in range(order):
            stop = max(0, len(self.doc) - more)
            ends = slice(more, more + stop)
            same = self.doc[:stop] == self.doc[ends]
            doc.append(self.doc[:stop][same])
            start.append(self.starts[:stop][same])
            length.append((self.starts[ends] + self.lengths[ends] - self.starts[:stop])[same])
        return np.concatenate(doc), np.concatenate(start), np.concatenate(length)


class Interned:
    """The distinct n-grams of a batch: slots of an open-addressed table, probed one by one.

    The XXH64 key chooses the slot; a slot is shared only by n-grams of the same bytes, so
    keys that collide get slots of their own. ``slot`` holds every occurrence's slot,
    ``taken`` the slots in use, ``bucket`` and ``count`` (by slot) the n-gram's CRC-32
    modulo ``buckets`` and its occurrences.
    """

    def __init__(self, buffer: np.ndarray, start: np.ndarray, length: np.ndarray, buckets: int):
        self.buffer, self.start, self.length = buffer, start, length
        windows = np.lib.stride_tricks.sliding_window_view(buffer, SHORT)
        self.lanes = (windows[start] & _KEEP[np.minimum(length, SHORT)]).view("<u8")
        keys = _hash_short(self.lanes, np.minimum(length, SHORT - 1))
        for i in np.flatnonzero(length >= SHORT):
            keys[i] = xxhash.xxh64_intdigest(self._bytes(i), SEED)
        size = 1 << max(4, int(2 * len(start)).bit_length())
        owner = np.full(size, -1, np.int64)
        self.slot = (keys & np.uint64(size - 1)).astype(np.int64)
        pending = np.arange(len(start))
        while len(pending):
            at = self.slot[pending]
            free = owner[at] < 0
            owner[at[free][::-1]] = pending[free][::-1]  # the first to ask gets the slot
            holder = owner[at]
            same = keys[holder] == keys[pending]
            same[same] = self._same_bytes(holder[same], pending[same])
            pending = pending[~same]
            self.slot[pending] = (self.slot[pending] + 1) & (size - 1)
        self.taken = np.flatnonzero(owner >= 0)
        self.bucket = np.zeros(size, np.int64)
        self.bucket[self.taken] = [zlib.crc32(self._bytes(i)) % buckets for i in owner[self.taken]]
        self.count = np.bincount(self.slot, minlength=size)

    def _bytes(self, i: int) -> bytes:
        return self.buffer[self.start[i] : self.start[i] + self.length[i]].tobytes()

    def _same_bytes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        same = (self.length[a] == self.length[b]) & (self.lanes[a] == self.lanes[b]).all(axis=1)
        for i in np.flatnonzero(same & (self.length[a] > SHORT) & (a != b)):
            same[i] = self._bytes(a[i]) == self._bytes(b[i])
        return same


def interned(words: Words, order: int, buckets: int) -> Iterator[tuple[np.ndarray, Interned]]:
    """The n-grams of 1 to ``order`` words, table by table, each with the texts that its occurrences are in."""
    doc, start, length = words.grams(order)
    for at in range(0, len(doc), GRAMS_AT_ONCE):
        part = slice(at, at + GRAMS_AT_ONCE)
        yield doc[part], Interned(words.buffer, start[part], length[part], buckets)
