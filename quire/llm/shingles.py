"""Five-word shingles of whole texts in Python workers: words, 64-bit shingle hashes and MinHash values, all with numpy."""

from __future__ import annotations

import numpy as np
import xxhash

GRAM = 5
_POWERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], dtype=np.uint64)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, with A-Z (and nothing else) in lower case. bytes.lower and bytes.split know ASCII only."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def hashes(w: list[bytes]) -> np.ndarray:
    """A 64-bit hash for each five-word window in order; a shorter text is one window; no words, none."""
    if not w:
        return np.zeros(0, dtype=np.uint64)
    if len(w) < GRAM:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w), seed=len(w))], dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, w), dtype=np.uint64, count=len(w))
    n = len(w) - GRAM + 1
    out = h[:n] * _POWERS[0]
    for k in range(1, GRAM):
        out += h[k : k + n] * _POWERS[k]
        out ^= out >> np.uint64(29)
    out *= _MIX
    return out ^ (out >> np.uint64(32))


def grams(w: list[bytes]) -> set[tuple[bytes, ...]]:
    """The shingles themselves, for exact comparison."""
    if not w:
        return set()
    return set(zip(*(w[k:] for k in range(GRAM)), strict=False)) if len(w) >= GRAM else {tuple(w)}


class MinHash:
    """``size`` minima of 32-bit linear permutations; the same numbers in every process."""

    def __init__(self, size: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.a = (rng.integers(1, 1 << 31, size, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
        self.b = rng.integers(0, 1 << 32, size, dtype=np.uint32)

    def values(self, h: np.ndarray) -> np.ndarray:
        """One row of permuted values for each hash."""
        return (h >> np.uint64(32)).astype(np.uint32)[:, None] * self.a + self.b

    def minima(self, h: np.ndarray, block: int = 2048) -> np.ndarray:
        out = self.values(h[:block]).min(axis=0)
        for i in range(block, len(h), block):
            np.minimum(out, self.values(h[i : i + block]).min(axis=0), out=out)
        return out
