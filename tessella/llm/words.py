"""Words and word n-grams of many texts at once, in numpy.

A word is a run of letters and digits (Unicode categories L and N) of the lower-case text. Words are told by 64-bit
hashes: a polynomial over mixed code points, made of prefix sums, so that no Python runs per word.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters that are worked on at once; a longer text is cut between words, never inside one. Results don't depend on it,
#: a worker's memory does: for each character some arrays of 8 bytes are held.
BLOCK_CHARS = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: is it of a word; its mixed value."""
    n = 0x110000
    of = np.fromiter((unicodedata.category(chr(i))[0] in "LN" for i in range(0x3FFFF)), np.bool_, 0x3FFFF)
    return np.concatenate([of, np.zeros(n - len(of), np.bool_)]), mix64(np.arange(1, 0x3FFFF + 1, dtype=_U) * _U(_BASE))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, n or more; kept for blocks, but not for what is longer."""
    return _usual() if n <= BLOCK_CHARS + 1 else _progressions(n)


@cache
def _usual() -> tuple[np.ndarray, np.ndarray]:
    return _progressions(BLOCK_CHARS + 1)


def _progressions(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        b = np.full(n, _BASE, _U)
        b[0] = 1
        inv = np.full(n, pow(_BASE, -1, 1 << 64), _U)
        inv[0] = 1
        return np.cumprod(b, dtype=_U), np.cumprod(inv, dtype=_U)


def _words(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words in code points that end with one outside of words."""
    is_word, value = _tables()
    flag = is_word[cp]
    step = np.flatnonzero(np.diff(flag, prepend=False))
    start, end = step[0::2], step[1::2]
    power, inverse = _powers(len(cp))
    v = value[np.where(flag, cp, 0)]
    v *= power[: len(cp)]
    np.cumsum(v, out=v)
    # cp[start - 1] is outside of a word, but it counts in the sums: take the sum up to it.
    before = np.where(start > 0, v[np.maximum(start, 1) - 1], _U(0))
    return start, end, mix64((v[end - 1] - before) * inverse[start] + (end - start).astype(_U))


def _pieces(text: str) -> Iterator[tuple[int, str]]:
    """A long text in pieces that end outside of words, with their offsets."""
    at, n = 0, len(text)
    is_word = _tables()[0]
    while n - at > BLOCK_CHARS:
        cut = at + BLOCK_CHARS
        while cut > at and is_word[ord(text[cut - 1])]:
            cut -= 1
        if cut == at:
            cut = at + BLOCK_CHARS
            while cut < n and is_word[ord(text[cut])]:
                cut += 1
        yield at, text[at:cut]
        at = cut
    yield at, text[at:]


class Words:
    """Words of texts: hash, start and end (in the lower-case text) of each; text k has those from first[k] to first[k + 1]."""

    def __init__(self, hash: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray):
        self.hash, self.start, self.end, self.first = hash, start, end, first

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the n-grams of words, and where each text's begin. A text of 1 to n - 1 words has one, of all its words."""
        h, first = self.hash, self.first
        count = np.diff(first)
        if not len(h):
            return h, np.zeros(len(first), np.int64)
        pad = np.concatenate([h, np.zeros(n, _U)])
        g = np.zeros(len(h), _U)
        place = np.arange(len(h))
        last = np.repeat(first[1:], count)
        for i in range(n):
            # Words beyond the text's end count as nothing: only the one n-gram of a short text has such.
            g += np.where(place + i < last, pad[i : i + len(h)] * _U((_BASE * (2 * i + 3)) % 2**64 | 1), _U(0))
        keep = (place + n <= last) | ((np.repeat(count, count) < n) & (place == np.repeat(first[:-1], count)))
        many = np.where(count >= n, count - n + 1, np.minimum(count, 1))
        return mix64(g[keep]), np.concatenate([[0], np.cumsum(many)])


def words(texts: list[str | None]) -> Words:
    """Words of texts; a null text has none."""
    with np.errstate(over="ignore"):
        return _all(texts)


def _all(texts: list[str | None]) -> Words:
    low = [(t or "").lower() for t in texts]
    if len(low) == 1 and len(low[0]) > BLOCK_CHARS:
        parts = []
        for at, piece in _pieces(low[0]):
            cp = np.frombuffer((piece + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
            s, e, h = _words(cp)
            parts.append((s + at, e + at, h))
        s, e, h = (np.concatenate(x) for x in zip(*parts, strict=True))
        return Words(h, s, e, np.array([0, len(h)]))
    offset = np.concatenate([[0], np.cumsum(np.fromiter((len(t) + 1 for t in low), np.int64, len(low)))])
    cp = np.frombuffer((" ".join(low) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    s, e, h = _words(cp)
    first = np.searchsorted(s, offset)
    base = np.repeat(offset[:-1], np.diff(first))
    return Words(h, s - base, e - base, first)


def blocks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of BLOCK_CHARS in all, with a blank after each, or of one text that is longer."""
    a = size = 0
    for i, t in enumerate(texts):
        n = len(t) + 1 if t else 1
        if i > a and size + n > BLOCK_CHARS:
            yield a, i
            a, size = i, 0
        size += n
    if a < len(texts):
        yield a, len(texts)



def portions(texts: list[str | None] | pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """Texts and the number of the first, of an Arrow column BLOCK_CHARS bytes at a time or one text that is longer: as
    strings, all texts of a batch would be a few times its size."""
    if not isinstance(texts, pa.Array) or pa.types.is_null(texts.type):
        yield 0, texts if isinstance(texts, list) else texts.to_pylist()
        return
    a = size = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).tolist()):
        if i > a and size + n + 1 > BLOCK_CHARS:
            yield a, texts.slice(a, i - a).to_pylist()
            a, size = i, 0
        size += n + 1
    if a < len(texts):
        yield a, texts.slice(a).to_pylist()


class Lookup:
    """Which of many hashes are among given ones, and which."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        self.bits = max(10, int(8 * len(self.keys) + 1).bit_length())
        self.seen = np.zeros(1 << self.bits, np.bool_)
        self.seen[self.keys >> np.uint64(64 - self.bits)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in hashes and in keys of the hits."""
        at = np.flatnonzero(self.seen[hashes >> np.uint64(64 - self.bits)])
        if not len(at) or not len(self.keys):
            return at[:0], at[:0]
        k = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
        ok = self.keys[k] == hashes[at]
        return at[ok], k[ok]
