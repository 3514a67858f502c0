"""Byte-level pre-tokens of many texts at once, and the distinct ones among them.

The pre-tokens are those of the byte-level tokenizers' pattern: the contractions
's 't 're 've 'm 'll 'd; runs of letters, of numbers and of other characters,
each with the blank before it; and white space, whose last character before a
word is left to that word. They follow from the classes of neighbouring
characters, so they are found for whole blocks of texts with array operations.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import regex

OTHER, LETTER, NUMBER, SPACE = range(4)
#: Fixed value: what may follow the apostrophe of a contraction.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
BLOCK_BYTES = 1 << 20


@functools.cache
def char_classes() -> np.ndarray:
    """The class of every code point, from the properties L and N and white space."""
    table = np.zeros(0x110000, np.uint8)
    points = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, points):
            table[np.array([ord(c) for c in m[0]])] = kind
    return table


@functools.cache
def _powers(size: int, which: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number for each byte, the powers of an odd base modulo 2**64, and those of its inverse."""
    base = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)[which]
    up = np.full(size, base, np.uint64)
    down = np.full(size, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.random.default_rng(11 + which).integers(1, 1 << 63, 256, dtype=np.uint64), np.multiply.accumulate(up), np.multiply.accumulate(down)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash, one of two, of each span of the bytes ``data``, by its contents and length alone."""
    size = 1 << max(16, int(len(data)).bit_length())
    values, up, down = _powers(size, which)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * up[: len(data)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _starts(chars: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Which characters begin a pre-token. chars: code points of non-empty texts end to end; firsts: where each text begins."""
    n, kind = len(chars), char_classes()[chars]
    first = np.zeros(n + 1, bool)
    first[firsts] = True
    first[n] = True
    begins = first.copy()
    begins[1:n] |= kind[1:] != kind[:-1]  # runs of one class
    # White space: its last character stands alone, and a blank there belongs to the word that follows.
    follows = np.zeros(n, bool)
    follows[:-1] = (kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~first[1:n]
    begins[:n] |= follows
    blank = np.flatnonzero(follows & (chars == 32))
    begins[blank + 1] = False
    # Contractions: a lone apostrophe that no blank belongs to, with its letters.
    for at in np.flatnonzero(chars[:-1] == 39):
        if begins[at] and kind[at + 1] == LETTER and not first[at + 1] and (first[at] or kind[at - 1] != OTHER):
            one = chr(chars[at + 1])
            two = one + chr(chars[at + 2]) if at + 2 < n and not first[at + 2] else ""
            size = 1 if one in CONTRACTIONS else 2 if two in CONTRACTIONS else 0
            if size:
                begins[at + 1] = False
                begins[at + 1 + size] = True
    return begins[:n]


@dataclass
class Block:
    """Pre-tokens of some texts: the distinct ones, and which one stands at each place."""

    data: bytes
    starts: np.ndarray  # of each distinct pre-token in data
    ends: np.ndarray
    counts: np.ndarray
    places: np.ndarray  # the distinct pre-token at each place of all texts
    bounds: np.ndarray  # where each text's places begin, and the end
    hashes: np.ndarray  # of the distinct pre-tokens, ascending

    def words(self, which: Iterable[int] | None = None) -> list[bytes]:
        which = range(len(self.starts)) if which is None else which
        s, e, d = self.starts.tolist(), self.ends.tolist(), self.data
        return [d[s[i] : e[i]] for i in which]


def pretokenize(texts: list[str]) -> Block:
    """The pre-tokens of whole texts; empty texts have none."""
    joined = "".join(texts)
    data = joined.encode("utf-8")
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    where = np.r_[0, np.cumsum(sizes)]
    if not joined:
        none = np.empty(0, np.int64)
        return Block(b"", none, none, none, none, np.zeros(len(texts) + 1, np.int64), none.astype(np.uint64))
    chars = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    begins = np.flatnonzero(_starts(chars, where[:-1][sizes > 0]))
    wide = len(data) != len(chars)
    if wide:
        width = np.ones(len(chars), np.int64)
        for limit in (0x80, 0x800, 0x10000):
            width += chars >= limit
        offsets = np.r_[0, np.cumsum(width)]
    at = offsets[begins] if wide else begins
    ends = np.r_[at[1:], len(data)]
    hashes, index, inverse, counts = np.unique(span_hashes(np.frombuffer(data, np.uint8), at, ends), return_index=True, return_inverse=True, return_counts=True)
    return Block(data, at[index], ends[index], counts, inverse, np.searchsorted(begins, where), hashes)


def blocks(rows: Iterable[tuple[object, str]], most: int = BLOCK_BYTES) -> Iterator[tuple[list, list[str]]]:
    """Rows of (id, text) in runs of about ``most`` characters; a longer text is a run of its own."""
    ids, texts, size = [], [], 0
    for i, t in rows:
        if texts and size + len(t) > most:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(i)
        texts.append(t)
        size += len(t)
    if texts:
        yield ids, texts


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The slices flat[start : start + size] end to end."""
    ends = np.cumsum(sizes)
    if not len(ends):
        return flat[:0]
    return flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1])]
