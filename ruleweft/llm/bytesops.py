"""Words, lines and hashes of many texts at once, over their UTF-8 bytes laid end to end.

All separators are ASCII, so byte positions never split a character. A span's hash is a polynomial over its bytes
modulo 2**64: a prefix sum of ``table[byte] * BASE**position``, a difference of two prefixes and a shift back.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

U = np.uint64
#: [\x20\x09-\x0D]
SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that are neither blanks nor ASCII punctuation nor control characters.
LETTERLIKE = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
#: Bytes that continue a UTF-8 character.
CONTINUES = (np.arange(256) & 0xC0) == 0x80
BASES = (U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection that spreads all bits."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def values(salt: int, n: int = 256) -> np.ndarray:
    """``n`` pseudo-random odd-and-even 64-bit values that depend on ``salt`` only."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(salt) * U(0xD1342543DE82EF95))


@lru_cache(maxsize=4)
def _powers(which: int, inverse: bool, size: int) -> np.ndarray:
    base = int(BASES[which])
    if inverse:
        base = pow(base, -1, 1 << 64)
    out = np.full(size, base, U)
    out[0] = 1
    return np.cumprod(out)


def powers(which: int, inverse: bool, n: int) -> np.ndarray:
    return _powers(which, inverse, 1 << max(16, int(n).bit_length()))[:n]


class Hasher:
    """Hashes of any spans of ``data``."""

    def __init__(self, data: np.ndarray, which: int = 0) -> None:
        n = len(data)
        self.sums = np.zeros(n + 1, U)
        np.cumsum(values(which + 1)[data] * powers(which, False, n), out=self.sums[1:])
        self.back = powers(which, True, n + 1)

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.back[starts] + (ends - starts).astype(U))


def runs(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true bytes within rows: starts, ends, and the n + 1 offsets of the rows' runs."""
    n = len(inside)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = offs[offs < n]
    first[edge] = inside[edge]
    edge = offs[offs > 0] - 1
    last[edge] = inside[edge]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offs)


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+``."""
    return runs(~SPACE[data], offs)


def lines(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines between newlines, empty ones included: starts, ends, and the n + 1 offsets of the rows' lines."""
    cut = np.flatnonzero(data == 10)
    before = np.searchsorted(cut, offs)
    starts = np.sort(np.concatenate([offs[:-1], cut + 1]), kind="stable")
    ends = np.sort(np.concatenate([offs[1:], cut]), kind="stable")
    return starts, ends, before + np.arange(len(offs))


def per_row(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` in each row."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offs[1:]] - sums[offs[:-1]]


def owners(offs: np.ndarray) -> np.ndarray:
    """Row of each element."""
    return np.repeat(np.arange(len(offs) - 1), np.diff(offs))


def windows(hashes: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``k`` successive elements within rows, and the n + 1 offsets of the rows' windows."""
    n = len(hashes) - k + 1
    counts = np.maximum(np.diff(offs) - k + 1, 0)
    out = np.concatenate([[0], np.cumsum(counts)])
    if n <= 0:
        return np.zeros(0, U), out
    scale = values(77, k) | U(1)
    h = hashes[:n] * scale[0]
    for j in range(1, k):
        h += hashes[j : j + n] * scale[j]
    at = np.repeat(offs[:-1] - out[:-1], counts) + np.arange(out[-1])
    return mix(h[at]), out


def repeated(keys: np.ndarray) -> np.ndarray:
    """True where a key occurs more than once."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    same = np.zeros(len(k) + 1, bool)
    same[1:-1] = k[1:] == k[:-1]
    out = np.zeros(len(k), bool)
    out[order] = same[1:] | same[:-1]
    return out


def later(keys: np.ndarray) -> np.ndarray:
    """True where a key equals an earlier one."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    out = np.zeros(len(k), bool)
    out[order[1:]] = k[1:] == k[:-1]
    return out
