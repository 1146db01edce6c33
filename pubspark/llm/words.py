"""Words, lines and hashes of whole Arrow batches of texts, by numpy on the UTF-8 bytes.

A word is a run of bytes other than space and 0x09-0x0D. Hashes are polynomials
modulo 2^61 - 1: prefix sums of bytes times powers of a base, so that any
span's hash needs two lookups. Work goes on in chunks of about ``CHUNK`` bytes of
whole documents, which bounds memory whatever the batch holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1_000_000
U = np.uint64
#: Hashes are polynomials modulo this prime: no two structured strings (as those of Thue and Morse) meet for every base, as they do modulo 2^64.
P = (1 << 61) - 1
_BASE = 0x1E3779B97F4A7C15 % P
_STEP = 1 << 16
_P, _M30, _M31 = U(P), U((1 << 30) - 1), U((1 << 31) - 1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser: each input bit changes about half of the output's."""
    h = h.astype(U, copy=True)
    h ^= h >> U(30)
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def _fold(x: np.ndarray) -> np.ndarray:
    """x modulo P."""
    x = (x & _P) + (x >> U(61))
    return np.where(x >= _P, x - _P, x)


def _shift31(x: np.ndarray) -> np.ndarray:
    """x * 2^31, not yet reduced, as 2^61 is 1."""
    return ((x & _M30) << U(31)) + (x >> U(30))


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo P, of numbers below P."""
    ah, al, bh, bl = a >> U(31), a & _M31, b >> U(31), b & _M31
    return _fold(_fold(ah * bh * U(2) + al * bl) + _shift31(ah * bl + al * bh))


def _power(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The base's powers up to n (low 31 bits, high ones), and their inverses."""
    have = _powers.get(0)
    if have is None or len(have[0]) < n:
        size = max(n, CHUNK + (1 << 17))
        both = []
        for base in (_BASE, pow(_BASE, -1, P)):
            p, step = np.ones(1, U), base
            while len(p) < size:
                p = np.concatenate([p, times(p, np.full(len(p), step, U))])
                step = step * step % P
            both.append(p[:size])
        have = (both[0] & _M31, both[0] >> U(31), both[1])
        if n <= CHUNK + (1 << 17):
            _powers[0] = have
    return have


class Spans:
    """Hashes of any [start, end) spans of ``data``."""

    def __init__(self, data: np.ndarray):
        low, high, self.down = _power(len(data) + 1)
        key = data.astype(U) + U(1)
        self.sums = np.zeros(len(data) + 1, U)
        for i in range(0, len(data), _STEP):  # sums of so many 40-bit products fit into 64 bits
            j = min(i + _STEP, len(data))
            a, b = np.cumsum(key[i:j] * low[i:j]), np.cumsum(key[i:j] * high[i:j])
            self.sums[i + 1 : j + 1] = _fold(_fold(_shift31(b) + a) + self.sums[i])

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return times(_fold(self.sums[end] + (_P - self.sums[start])), self.down[start])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(self.raw(start, end) + (end - start).astype(U) * U(0xD6E8FEB86659FD93))


class Chunk:
    """Some whole documents of a batch: ``data`` (bytes), ``at`` (n + 1 byte offsets), ``first`` (row of the first)."""

    def __init__(self, data: np.ndarray, at: np.ndarray, first: int):
        self.data, self.at, self.first, self.n = data, at, first, len(at) - 1

    def per_doc(self, mask: np.ndarray) -> np.ndarray:
        """How many bytes of each document the mask holds."""
        sums = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=sums[1:])
        return sums[self.at[1:]] - sums[self.at[:-1]]

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and document of each word, in order."""
        full = ~SPACE[self.data]
        n = len(self.data)
        edge = np.zeros(n + 1, bool)
        edge[self.at] = True
        before = np.zeros(n, bool)
        after = np.zeros(n, bool)
        if n:
            before[1:] = full[:-1]
            after[:-1] = full[1:]
        start = np.flatnonzero(full & (~before | edge[:n]))
        end = np.flatnonzero(full & (~after | edge[1:])) + 1
        doc = np.searchsorted(self.at, start, side="right") - 1
        return start, end, doc


def chunks(texts: pa.Array) -> Iterator[Chunk]:
    """A null text counts as an empty one."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    a = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    if a.null_count:
        a = a.fill_null(b"")
    at = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    data = np.frombuffer(a.buffers()[2], np.uint8) if len(a) and a.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(a):
        j = max(i + 1, int(np.searchsorted(at, at[i] + CHUNK, side="right")) - 1)
        j = min(j, len(a))
        yield Chunk(data[at[i] : at[j]], at[i : j + 1] - at[i], i)
        i = j


def ranks_in_doc(doc: np.ndarray, n: int) -> np.ndarray:
    """The place of each word in its document; ``doc`` ascends."""
    first = np.searchsorted(doc, np.arange(n))
    return np.arange(len(doc)) - first[doc] if len(doc) else np.zeros(0, np.int64)


def windows(h: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each k words in a row that lie in one document, and the place of their first word."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    g = np.zeros(n, U)
    for j in range(k):
        g = mix(g * U(0x2545F4914F6CDD1D) + h[j : j + n])
    at = np.flatnonzero(doc[:n] == doc[k - 1 : k - 1 + n])
    return g[at], at
