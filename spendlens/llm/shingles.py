"""Hashes of word shingles and the bit sums of SimHash."""

from __future__ import annotations

import numpy as np
import xxhash

SEED = 42
ROWS = 255  # whose sums of bits fit a byte


def shingle_hashes(text: str | None, n: int) -> np.ndarray:
    """XXH64 of each shingle of ``n`` words, in order: A-Z lower-cased, words split at ASCII white space.

    A text of fewer words counts as one shingle; one without words, or null, has none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    joined, of = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= n:
        return np.array([of(joined, SEED)] if words else [], dtype="<u8")
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-n].tolist()]
    return np.array([of(joined[a:b], SEED) for a, b in zip(starts, (ends[n - 1 :] - 1).tolist(), strict=True)], dtype="<u8")


def bit_sums(hashes: np.ndarray, width: int = 8) -> np.ndarray:
    """How many of the hashes have each of 8 * ``width`` bits set; beyond the first 64, bits are those of hashes of the hash."""
    words = hashes[:, None]
    if width > 8:
        turn = np.random.default_rng(31).integers(1, 1 << 63, width // 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        words = words * turn
        words ^= words >> np.uint64(32)
        words *= np.uint64(0xD6E8FEB86659FD93)
        words ^= words >> np.uint64(32)
    sums = np.zeros(8 * width, np.int64)
    for at in range(0, len(words), ROWS):
        bits = np.unpackbits(np.ascontiguousarray(words[at : at + ROWS]).view(np.uint8), axis=1, bitorder="little")
        sums += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return sums
