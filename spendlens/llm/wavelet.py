"""A wavelet matrix of token ids: one compressed file with access, counting and occurrence lookup.

The ids' bits make one plane for each bit, the highest first; below each plane
the ids with a 0 there come before those with a 1, each in the order they had.
Planes are stored as bits, deflated one by one and inflated when first asked for,
with the number of ones before every 512th bit beside them, so that rank is one
lookup and a few bytes' count, and select a binary search over that. A header holds the documents (id and ids' number).
"""

from __future__ import annotations

import struct
from collections.abc import Sequence

import numpy as np
import zstandard

MAGIC = b"WVM1"
STEP = 512


class _Planes:
    """Deflated planes, each inflated when it is first asked for."""

    def __init__(self, parts: list[bytes]):
        self.parts, self.found = parts, {}

    def __len__(self) -> int:
        return len(self.parts)

    def __getitem__(self, level: int) -> np.ndarray:
        if level not in self.found:
            self.found[level] = np.frombuffer(zstandard.ZstdDecompressor().decompress(self.parts[level]), np.uint8)
        return self.found[level]


class WaveletMatrix:
    """Token ids of some documents end to end."""

    def __init__(self, docs: np.ndarray, known: np.ndarray, sizes: np.ndarray, n: int, planes: Sequence[np.ndarray], zeros: list[int]):
        self.docs, self.known, self.sizes, self.n = docs, known, sizes, n
        self.planes, self.zeros = planes, zeros  # planes: packed bits, the lowest bit of a byte first
        self._ones: list[np.ndarray | None] = [None] * len(planes)

    @classmethod
    def build(cls, docs: np.ndarray, known: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> WaveletMatrix:
        """docs: document ids, known: which of them are not null, sizes: ids of each document, ids: those end to end, below 2**32."""
        levels = max(1, int(ids.max(initial=0)).bit_length())
        a = ids.astype(np.uint16 if levels <= 16 else np.uint32)
        planes, zeros = [], []
        for level in range(levels - 1, -1, -1):
            one = (a & a.dtype.type(1 << level)) != 0
            planes.append(np.packbits(one, bitorder="little"))
            low = a[np.flatnonzero(~one)]
            zeros.append(len(low))
            a = np.concatenate([low, a[np.flatnonzero(one)]])
        return cls(docs, known, sizes, len(ids), planes, zeros)

    def tobytes(self) -> bytes:
        pack = zstandard.ZstdCompressor(level=1).compress
        parts = [pack(np.ascontiguousarray(x, t).tobytes()) for x, t in ((self.docs, "<i8"), (self.known, "u1"), (self.sizes, "<i8"))]
        parts += [pack(p.tobytes()) for p in self.planes] + [pack(self.samples(k).astype("<u4").tobytes()) for k in range(len(self.planes))]
        head = struct.pack("<4sQQI", MAGIC, self.n, len(self.docs), len(self.planes)) + struct.pack(f"<{len(self.planes)}Q", *self.zeros)
        return head + struct.pack(f"<{len(parts)}Q", *map(len, parts)) + b"".join(parts)

    @classmethod
    def frombytes(cls, data: bytes) -> WaveletMatrix:
        magic, n, _, levels = struct.unpack_from("<4sQQI", data)
        if magic != MAGIC:
            raise ValueError("no wavelet matrix file")
        at = struct.calcsize("<4sQQI")
        zeros = list(struct.unpack_from(f"<{levels}Q", data, at))
        at += 8 * levels
        sizes = struct.unpack_from(f"<{3 + 2 * levels}Q", data, at)
        at += 8 * len(sizes)
        parts = [data[e - s : e] for s, e in zip(sizes, np.cumsum(sizes) + at, strict=True)]
        of = lambda k, t: np.frombuffer(zstandard.ZstdDecompressor().decompress(parts[k]), t)
        found = cls(of(0, "<i8"), of(1, "u1").astype(bool), of(2, "<i8"), n, _Planes(parts[3 : 3 + levels]), zeros)
        found._ones = [of(3 + levels + k, "<u4").astype(np.int64) for k in range(levels)]
        return found

    def samples(self, level: int) -> np.ndarray:
        """Ones of a plane before every STEP-th bit."""
        if self._ones[level] is None:
            p = self.planes[level]
            padded = np.zeros(-(-len(p) // (STEP // 8)) * (STEP // 8), np.uint8)
            padded[: len(p)] = np.bitwise_count(p)
            self._ones[level] = np.r_[0, np.cumsum(padded.reshape(-1, STEP // 8).sum(axis=1, dtype=np.int64))]
        return self._ones[level]

    def bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i >> 3] >> (i & 7) & 1)

    def rank(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        block = i // STEP
        part = self.planes[level][block * (STEP // 8) : i >> 3]
        ones = int(self.samples(level)[block]) + int(np.bitwise_count(part).sum())
        return ones + (int(self.planes[level][i >> 3] & ((1 << (i & 7)) - 1)).bit_count() if i & 7 else 0)

    def select(self, level: int, bit: int, k: int) -> int:
        """The position of the k-th (from 0) bit of a plane that equals ``bit``."""
        low, high = 0, self.n
        while low < high:
            mid = (low + high) // 2
            ones = self.rank(level, mid + 1)
            if (ones if bit else mid + 1 - ones) > k:
                high = mid
            else:
                low = mid + 1
        return low

    def __getitem__(self, i: int) -> int:
        """The token at a place."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        token = 0
        for level in range(len(self.planes)):
            b = self.bit(level, i)
            token = token << 1 | b
            ones = self.rank(level, i)
            i = self.zeros[level] + ones if b else i - ones
        return token

    def access(self, places: np.ndarray) -> np.ndarray:
        """The tokens at many places."""
        at, token = np.asarray(places, np.int64), np.zeros(len(places), np.int64)
        for level in range(len(self.planes)):
            plane, block = self.planes[level], at // STEP
            one = plane[at >> 3] >> (at & 7).astype(np.uint8) & 1
            # Ones of the 64 bytes of each place's block, those at and behind it masked out.
            inside = block[:, None] * (STEP // 8) + np.arange(STEP // 8)
            bits = np.where(inside < (at >> 3)[:, None], plane[np.minimum(inside, len(plane) - 1)], np.uint8(0))
            ones = self.samples(level)[block] + np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
            ones += np.bitwise_count(plane[at >> 3] & ((1 << (at & 7)) - 1).astype(np.uint8))
            token = token << 1 | one
            at = np.where(one == 1, self.zeros[level] + ones, at - ones)
        return token

    def _range(self, token: int, start: int, end: int) -> tuple[int, int]:
        """Where the occurrences of a token among places start..end-1 lie below the last plane."""
        if token >> len(self.planes):
            return 0, 0
        for level in range(len(self.planes)):
            a, b = self.rank(level, start), self.rank(level, end)
            one = token >> (len(self.planes) - 1 - level) & 1
            start, end = (self.zeros[level] + a, self.zeros[level] + b) if one else (start - a, end - b)
        return start, end

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """Occurrences of a token among places start..end-1."""
        a, b = self._range(token, start, self.n if end is None else end)
        return b - a

    def find(self, token: int, k: int) -> int:
        """The place of the k-th (from 0) occurrence of a token."""
        a, b = self._range(token, 0, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        i = a + k
        for level in reversed(range(len(self.planes))):
            one = token >> (len(self.planes) - 1 - level) & 1
            i = self.select(level, one, i - self.zeros[level] if one else i)
        return i

    def tokens(self) -> np.ndarray:
        """All tokens, from the lowest plane up."""
        a = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for level in reversed(range(len(self.planes))):
            one = np.unpackbits(self.planes[level], count=self.n, bitorder="little").astype(bool)
            up = np.empty_like(a)
            up[np.flatnonzero(~one)] = a[: self.zeros[level]]
            up[np.flatnonzero(one)] = a[self.zeros[level] :] | a.dtype.type(1 << (len(self.planes) - 1 - level))
            a = up
        return a
