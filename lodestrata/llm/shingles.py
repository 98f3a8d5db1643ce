"""Sets of hashed word shingles, vectorised over a batch of texts."""

from __future__ import annotations

import numpy as np
import xxhash

from lodestrata.llm.common import Recent, held

U = np.uint64


class WordHashes(Recent):
    """64-bit hashes of words."""

    def make(self, word: bytes) -> int:
        return xxhash.xxh64_intdigest(word)


#: About 130 bytes an entry, two generations.
MOST = 100_000


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that leaves no pattern."""
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def shingle_sets(texts: list[str | None], width: int = 3) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of ``width`` words.

    A-Z become lower case; words are what stands between the ASCII white space
    0x20 and 0x09-0x0D.  A text with fewer words is one shingle; one without words
    has none.
    """
    known = held("words", lambda: WordHashes(MOST))
    words = [(t or "").encode().lower().split() for t in texts]
    counts = np.array([len(w) for w in words])
    h = np.fromiter((x for w in words for x in map(known.__getitem__, w)), U, int(counts.sum()))
    at = np.append(0, np.cumsum(counts))
    factors = [U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9), U(0x27D4EB2F165667C5), U(0x85EBCA77C2B2AE63)]
    full = np.zeros(0, U)
    if len(h) >= width:
        n = len(h) - width + 1
        full = h[:n].copy()
        for j in range(1, width):
            full = mixed(full * factors[0] + h[j : j + n] * factors[j % 5])
        full = mixed(full)
    out = []
    for k, c in enumerate(counts):
        a = at[k]
        if c >= width:
            s = full[a : a + c - width + 1].copy()
            s.sort()
            out.append(s[np.append(True, s[1:] != s[:-1])] if len(s) > 1 else s)
        elif c:
            x = U(c)
            for y in h[a : a + c]:
                x = mixed(np.array([x], U) * factors[1] + y)[0]
            out.append(np.array([x], U))
        else:
            out.append(np.zeros(0, U))
    return out


def sketches(sets: list[np.ndarray], n: int, seed: int = 11) -> np.ndarray:
    """n minwise values of each set (which isn't empty).

    The upper halves of the hashes are permuted as 32-bit numbers, which processors
    multiply in vectors.
    """
    r = np.random.default_rng(seed)
    a, b = r.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), r.integers(0, 1 << 32, n, dtype=np.uint32)
    out = np.zeros((len(sets), n), np.uint32)
    first, size = 0, 0
    for k in range(len(sets) + 1):
        if k == len(sets) or size > 1 << 15:  # what fits into a processor's cache
            some = sets[first:k]
            if some:
                flat = (np.concatenate(some) >> U(32)).astype(np.uint32)
                starts = np.append(0, np.cumsum([len(s) for s in some])[:-1])
                held = np.empty_like(flat)
                for j in range(n):
                    np.bitwise_xor(flat, b[j], out=held)
                    np.multiply(held, a[j], out=held)
                    held ^= held >> np.uint32(15)
                    out[first:k, j] = np.minimum.reduceat(held, starts)
            first, size = k, 0
        if k < len(sets):
            size += len(sets[k])
    return out


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |a and b| >= percent * |a or b|, for sorted distinct arrays."""
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    both = np.concatenate((a, b))
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)
