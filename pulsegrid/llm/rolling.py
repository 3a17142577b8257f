"""Hashes of byte ranges in constant time each, and of word shingles, as numpy operations on one text."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

U = np.uint64
_ALL = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (multiply and shift rounds)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


with np.errstate(over="ignore"):
    #: A random value for each byte, and an odd base whose powers (and inverse powers) weigh the positions.
    BYTES = mix((np.arange(256, dtype=U) + U(1)) * U(0x9E3779B97F4A7C15))
BASE = 0xD1342543DE82EF95
INVERSE = pow(BASE, -1, 1 << 64)

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** n modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        size = max(4096, 2 * n)
        with np.errstate(over="ignore"):
            out = np.ones(size + 1, U)
            out[1:] = U(base)
            have = _powers[base] = np.multiply.accumulate(out)
    return have[: n + 1]


class RangeHash:
    """Hashes of the ranges [a, b) of some bytes. Equal bytes have equal hashes, whatever stands around them."""

    def __init__(self, raw: np.ndarray):
        n = len(raw)
        self.sums = np.zeros(n + 1, U)
        np.cumsum(BYTES[raw] * powers(BASE, n)[:n], out=self.sums[1:])
        self.back = powers(INVERSE, n)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.sums[b] - self.sums[a]) * self.back[a])


#: A polynomial modulo 2^64 has collisions among regular strings of a thousand letters; longer words than this are
#: hashed by blake2b.
LONG_WORD = 256
_GAP = np.zeros(256, bool)
_GAP[[32, *range(9, 14)]] = True
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_TURN = [U(pow(0x9FB21C651E98DF25, k + 1, 1 << 64)) for k in range(64)]


def word_hashes(text: str) -> np.ndarray:
    """A hash of each word; A-Z are lower-cased and ASCII white space divides words."""
    raw = np.frombuffer(text.encode().translate(_LOWER), np.uint8)
    if not len(raw):
        return np.zeros(0, U)
    gap = np.concatenate([[True], _GAP[raw], [True]])
    edge = np.diff(gap.view(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    out = RangeHash(raw).of(starts, ends)
    for i in np.flatnonzero(ends - starts > LONG_WORD):
        out[i] = U(int.from_bytes(blake2b(raw[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little"))
    return out


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles of `size` words; of the whole sequence where it has fewer words;
    none without words."""
    w = word_hashes(text or "")
    if not len(w):
        return w
    n = min(size, len(w))
    out = np.zeros(len(w) - n + 1, U)
    for k in range(n):
        out += w[k : len(w) - n + 1 + k] * _TURN[k]
    return np.unique(mix(out + U(n)))
