"""Words of whole texts as flat numpy arrays, straight from Arrow buffers.

A word is a maximal run of bytes other than space and \\x09-\\x0D, which on UTF-8 equals the
pattern ``[^\\x20\\x09-\\x0D]+`` on characters. Texts are taken in slices of bounded size; a
text is never cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
SLICE_BYTES = 2_000_000      # text bytes taken at once (a longer text is taken alone)
LONG_BYTES = 256              # a longer byte range is hashed by the library

_BREAK = np.zeros(256, dtype=bool)
_BREAK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_KEEP = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=U64)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (the splitmix64 steps)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


@dataclass
class Words:
    """``data``: bytes of all texts; ``text_at``: n + 1 byte offsets of the texts; ``start``,
    ``end``: byte range of each word; ``first``: n + 1 offsets of each text's first word."""

    data: np.ndarray
    text_at: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.n_words)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.start, self.end)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of an Arrow string array, and their n + 1 offsets; null counts as empty."""
    texts = pa.array(texts, pa.large_string()) if not isinstance(texts, pa.Array) else texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    at = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = texts.buffers()[2] if n else None
    data = np.frombuffer(raw, dtype=np.uint8)[at[0]:at[-1]] if raw is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return data, at - at[0]


def lowered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`text_bytes`, with A-Z lower-cased."""
    data, at = text_bytes(texts)
    return _LOWER[data], at


def scan(texts: pa.Array, lower: bool = False, word_bytes: np.ndarray | None = None) -> Words:
    """Words of an Arrow string array; null counts as an empty text. ``lower`` lower-cases A-Z;
    ``word_bytes`` (256 flags) makes a word a run of those bytes instead."""
    data, at = text_bytes(texts)
    if lower:
        data = _LOWER[data]
    word = ~_BREAK[data] if word_bytes is None else word_bytes[data]
    opens, closes = word.copy(), word.copy()
    opens[1:] &= ~word[:-1]
    closes[:-1] &= ~word[1:]
    full = np.flatnonzero(at[1:] > at[:-1])
    heads, tails = at[:-1][full], at[1:][full] - 1
    opens[heads] = word[heads]
    closes[tails] = word[tails]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return Words(data, at, start, end, np.searchsorted(start, at))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range; equal bytes, equal hash. Ranges are taken in steps of 8 bytes, each
    step through :func:`mix` (no polynomial: those give one hash to certain unlike words, whatever the
    base); long ranges by BLAKE2b."""
    length = end - start
    eight = np.ndarray(len(data) + 1, "<u8", np.concatenate((data, np.zeros(8, np.uint8))), strides=(1,))

    def step(state: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
        return mix(state ^ (eight[at] & _KEEP[np.minimum(left, 8)]))

    out = step(length.astype(U64) * U64(0x9E3779B97F4A7C15), start, length)
    more = np.flatnonzero(length > 8)
    more = more[np.argsort(-length[more], kind="stable")]  # the longest stand first
    first = int(np.count_nonzero(length[more] > LONG_BYTES))
    for i in more[:first].tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i]:end[i]], digest_size=8).digest(), "little")
    more = more[first:]
    at, left, state = start[more] + 8, length[more] - 8, out[more]
    while len(at) and left[0] > 0:
        n = int(np.searchsorted(-left, 0))  # ranges that go on
        at, left = at[:n], left[:n]
        state[:n] = step(state[:n] * U64(0xD6E8FEB86659FD93), at, left)
        at, left = at + 8, left - 8
    out[more] = state
    return out


def windows(hashes: np.ndarray, first: np.ndarray, size: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Every window of ``size`` consecutive words of one text: the index of its first word, and
    its 64-bit hash."""
    n = np.diff(first)
    count = np.maximum(n - size + 1, 0)
    at = np.repeat(first[:-1] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
    factors = np.random.default_rng(1000 + 7 * size + seed).integers(1, 2**63, size, dtype=np.int64).astype(U64) * U64(2) + U64(1)
    total = np.zeros(len(at), dtype=U64)
    for j in range(size):
        total += hashes[at + j] * factors[j]
    return at, mix(total)


def repeated(group: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per element: whether an equal (group, key) stands earlier, and whether one stands anywhere else."""
    both = mix(key ^ mix(group.astype(U64) + U64(0x632BE59BD9B4E019)))
    order = np.argsort(both, kind="stable")
    same = both[order][1:] == both[order][:-1]
    earlier, other = np.zeros(len(both), bool), np.zeros(len(both), bool)
    earlier[order[1:]] = same
    other[order[1:]] = same
    other[order[:-1]] |= same
    return earlier, other


def covered(at: np.ndarray, size: int, n_words: int) -> np.ndarray:
    """Per word: whether a window of ``size`` words that starts at one of ``at`` covers it."""
    steps = np.zeros(n_words + size + 1, dtype=np.int64)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + size, -1)
    return np.cumsum(steps)[:n_words] > 0


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ``limit`` bytes of ``column``; a longer text comes alone."""
    texts = batch.column(column).cast(pa.large_string())
    if not len(texts):
        return
    at = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, side="right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def per_text(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` over each text's range."""
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[first[1:]] - total[first[:-1]]
