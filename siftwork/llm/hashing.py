"""Vectorised hashing of words, word n-grams and byte windows of many documents at once.

Hashes are equal for equal strings whatever their place, so they can be compared between tasks. Words are
hashed eight bytes at a time with an avalanche mix after each step, long ones by xxh3, and n-grams by mixing
the hashes of their halves, so that no structure of a text (as that of Thue-Morse words, which collide in any
polynomial modulo 2**64) carries over to the hash. `prefix` and `spans` are such polynomials: fast for windows at
every place, and only for what is confirmed by its bytes or names phrases.
"""

from __future__ import annotations

import functools

import numpy as np
import xxhash

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
SEGMENT = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTE = mix(np.arange(1, 257, dtype=U) * U(BASE))


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for b in (BASE, INVERSE):
        p = np.full(n + 1, b, U)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(1 << max(16, int(n).bit_length()))


def prefix(values: np.ndarray) -> np.ndarray:
    """p with p[b] - p[a] the polynomial of values[a:b], times BASE**a."""
    p = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers(len(values))[0][: len(values)], out=p[1:])
    return p


def spans(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix((p[b] - p[a]) * powers(len(p))[1][a] + (b - a).astype(U))


def after(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of what `a` stands for followed by what `b` stands for."""
    return mix(mix(a) + b)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of hashes[i:i+k] for each i that has k values; they may run over a document's end."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out, at, width, doubled = None, 0, 1, hashes
    while True:  # a gram is put together from parts whose widths are powers of two
        if k & width:
            part = doubled[at : at + n]
            out = part if out is None else after(out, part)
            at += width
        if 2 * width > k:
            return out
        doubled = after(doubled[:-width], doubled[width:])
        width *= 2


#: Longer strings than so many bytes are hashed one by one.
STEPWISE = 64


def eights(buf: bytes) -> np.ndarray:
    """The eight bytes from every place of `buf` (zeros after its end) as numbers."""
    return np.ndarray(len(buf) + 1, "<u8", buf + bytes(8), strides=(1,))


def strings(buf: bytes, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of buf[start:end] for each pair; other seeds give independent hashes."""
    data, size = eights(buf), end - start
    h = mix(size.astype(U) * U(BASE) + U(seed))
    left, at = np.flatnonzero((size > 0) & (size <= STEPWISE)), 0
    while len(left):
        some = data[start[left] + at]
        short = np.flatnonzero(size[left] - at < 8)
        some[short] &= (U(1) << (U(8) * (size[left[short]] - at).astype(U))) - U(1)
        h[left] = mix((h[left] ^ some) * U(BASE))
        at += 8
        left = left[size[left] > at]
    for i in np.flatnonzero(size > STEPWISE).tolist():
        h[i] = xxhash.xxh3_64_intdigest(buf[start[i] : end[i]], seed)
    return h


def equal(buf: bytes, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the `size` bytes from `a` are those from `b`, for each triple."""
    data, out = eights(buf), np.ones(len(size), bool)
    left, at = np.flatnonzero((size > 0) & (size <= STEPWISE) & (a != b)), 0
    while len(left):
        odd = data[a[left] + at] ^ data[b[left] + at]
        short = np.flatnonzero(size[left] - at < 8)
        odd[short] &= (U(1) << (U(8) * (size[left[short]] - at).astype(U))) - U(1)
        out[left] &= odd == 0
        at += 8
        left = left[size[left] > at]
    for i in np.flatnonzero((size > STEPWISE) & (a != b)).tolist():
        out[i] = buf[a[i] : a[i] + size[i]] == buf[b[i] : b[i] + size[i]]
    return out


class Words:
    """The words [^\\x20\\x09-\\x0D]+ of texts: hash, document index and place of each, byte spans in `buf`."""

    def __init__(self, texts: list, lower: bool = False):
        raw = [(t or "").encode("utf-8", "replace") for t in texts]
        self.buf = b"\n".join(raw) + b"\n"
        if lower:
            self.buf = self.buf.translate(LOWER)
        b = np.frombuffer(self.buf, np.uint8)
        sizes = np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw))
        self.begin = np.concatenate([[0], np.cumsum(sizes)])
        space = SPACE[b]
        edge = np.flatnonzero(np.diff(space.view(np.int8), prepend=1, append=1))
        self.start, self.end = edge[::2], edge[1::2]
        self.hash = self.hashed()
        self.doc = np.searchsorted(self.begin, self.start, side="right") - 1
        self.count = np.bincount(self.doc, minlength=len(raw)).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.count)])
        self.place = np.arange(len(self.start)) - self.first[self.doc]

    def hashed(self, seed: int = 0) -> np.ndarray:
        """Hash of every word."""
        out, i = np.zeros(len(self.start), U), 0
        while i < len(self.start):  # segments, so that memory follows SEGMENT and not the longest text
            j = max(i + 1, int(np.searchsorted(self.end, self.start[i] + SEGMENT)))
            a = int(self.start[i])
            out[i:j] = strings(self.buf[a : int(self.end[j - 1])], self.start[i:j] - a, self.end[i:j] - a, seed)
            i = j
        return out

    def inside(self, k: int) -> np.ndarray:
        """Whether the k words from each gram start (see grams) are of one document."""
        n = max(0, len(self.start) - k + 1)
        return self.place[:n] + k <= self.count[self.doc[:n]]
