"""Vectorised text kernels shared by the corpus operators.

A batch of texts becomes one array of code points, and any span of it can then
be hashed in O(1) from prefix sums (``PrefixHash``).  Everything here works on a
whole Arrow batch at once; nothing loops over characters or words in Python.

Defined results: a null text counts as the empty text; an empty batch gives
empty arrays; text length is bounded only by the batch's memory.
"""

from __future__ import annotations

import functools
import sys

import numpy as np

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = U64(pow(int(_BASE), -1, 1 << 64))


@functools.cache
def tables() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: its lower case (same length mappings only), and whether it is a word character."""
    lower = np.arange(sys.maxunicode + 1, dtype=np.uint32)
    word = np.zeros(sys.maxunicode + 1, dtype=bool)
    for c in range(0x20000):
        s = chr(c)
        low = s.lower()
        if len(low) == 1:
            lower[c] = ord(low)
        word[c] = s.isalnum()
    for c in range(0x20000, 0x32000):  # ideographs beyond the first two planes
        word[c] = chr(c).isalnum()
    return lower, word


def codepoints(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one uint32 array, and the n+1 offsets of the texts in it."""
    joined = "".join(t for t in texts if t)
    cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    offsets = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) if t else 0 for t in texts], out=offsets[1:])
    return cps, offsets


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int, inverse: bool) -> np.ndarray:
    key = "inv" if inverse else "pow"
    have = _POWERS.get(key)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, _BASE_INV if inverse else _BASE, dtype=U64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _POWERS[key] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64 bit hash (splitmix64)."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


class PrefixHash:
    """Polynomial prefix sums over ``values``; ``span(s, e)`` hashes values[s:e] whatever its place."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.sums = np.zeros(n + 1, dtype=U64)
        if n:
            terms = mix(values.astype(U64) + U64(0x632BE59BD9B4E019))
            terms *= _powers(n, False)
            np.cumsum(terms, out=self.sums[1:])
        self._inverse = _powers(n + 1, True)

    def span(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (self.sums[ends] - self.sums[starts]) * self._inverse[starts]
        h += (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93)
        return mix(h)


class Words:
    """The words of a batch: maximal runs of letters and digits, lower-cased.

    starts, ends: offsets into the batch's code points; doc: index of each word's
    text; first: n+1 offsets of the texts in the list of words; hashes: 64 bits a word.
    """

    def __init__(self, texts: list[str | None]):
        lower, word = tables()
        self.cps, self.offsets = codepoints(texts)
        self.lower = lower[self.cps]
        flags = np.zeros(len(self.cps) + 1, dtype=np.int8)
        flags[:-1] = word[self.cps]
        step = np.diff(flags, prepend=np.int8(0))
        begin, stop = step == 1, step == -1
        inner = self.offsets[1:-1]
        inner = inner[(inner > 0) & (inner < len(self.cps))]
        if len(inner):  # a word never spans two texts
            cut = inner[(flags[inner] == 1) & (flags[inner - 1] == 1)]
            begin[cut] = True
            stop[cut] = True
        self.starts = np.flatnonzero(begin)
        self.ends = np.flatnonzero(stop)
        self.first = np.searchsorted(self.starts, self.offsets)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.prefix = PrefixHash(self.lower)
        self.hashes = self.prefix.span(self.starts, self.ends)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Places (word indices) and hashes of all n-word windows inside one text."""
        count = len(self.hashes)
        if count < n:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=U64)
        at = np.flatnonzero(self.doc[: count - n + 1] == self.doc[n - 1 :])
        return at, PrefixHash(self.hashes).span(at, at + n)


def multipliers(k: int, seed: int) -> np.ndarray:
    """k odd 32 bit multipliers."""
    return np.random.default_rng(seed).integers(1, 1 << 32, size=k, dtype=np.uint32) | np.uint32(1)


def minhash(h32: np.ndarray, bounds: np.ndarray, k: int, seed: int) -> np.ndarray:
    """(n, k) uint32 signatures of n sets of uint32; set i is h32[bounds[i]:bounds[i+1]], repeats allowed.

    An empty set has the signature of all ones.  The hashes are well mixed, so permutation j is
    just ``h * a_j`` for an odd ``a_j``; the tests hold its recall against the binomial's.
    """
    n = len(bounds) - 1
    out = np.full((k, n), np.uint32(0xFFFFFFFF), dtype=np.uint32)
    some = np.flatnonzero(np.diff(bounds) > 0)
    if not len(some):
        return out.T
    mul = multipliers(k, seed + 1)
    starts, ends = bounds[some], bounds[some + 1]
    # groups of sets of about 64 k values, so that every pass stays in the cache
    group = (ends - starts[0]) // 65536
    cuts = np.flatnonzero(np.diff(group, prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], len(some)]):
        lo, hi = starts[a], ends[b - 1]
        part, at = h32[lo:hi], starts[a:b] - lo
        buf = np.empty_like(part)
        for j in range(k):
            np.multiply(part, mul[j], out=buf)
            out[j, some[a:b]] = np.minimum.reduceat(buf, at)
    return out.T


def shingles32(values: np.ndarray, k: int) -> np.ndarray:
    """A 32 bit hash of values[i:i+k] for each i; windows over the end are padded with zeros."""
    v = np.zeros(len(values) + k - 1, dtype=np.uint32)
    v[: len(values)] = values
    n = len(values)
    h = np.zeros(n, dtype=np.uint32)
    for j in range(k):
        h *= np.uint32(0x01000193)
        h += v[j : j + n] * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    return h
