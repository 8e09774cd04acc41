"""Words of a text as 64-bit hashes in numpy arrays, and hashes of runs of words."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import xxhash

#: Word hashes that a worker keeps.
CACHE_ENTRIES = 500_000

_FIRST, _SECOND = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_SHIFT = np.uint64(33)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        if len(word) <= 64:
            self[word] = value
        return value


@lru_cache(maxsize=1)
def _cache() -> _Hashes:
    return _Hashes()


def split(raw: bytes | None) -> list[bytes]:
    """Runs of bytes other than space and 0x09 to 0x0D, which are the only ones that bytes.split() drops."""
    return (raw or b"").split()


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_cache().__getitem__, words), np.uint64, len(words))


#: Which bytes are white space, as split() has it.
SPACES = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_IN_WORD = (~SPACES).tobytes()
#: A value for each byte, nothing for a space, and powers of an odd number and of its inverse for the bytes of a stretch.
_VALUES = np.random.default_rng(13).integers(1, 1 << 64, 256, np.uint64) * ~SPACES
_BASE, STRETCH = 0xD1342543DE82EF95, 1 << 16


def _powers(base: int, n: int) -> np.ndarray:
    factors = np.full(n, base, np.uint64)
    factors[0] = 1
    return np.cumprod(factors, dtype=np.uint64)


_UP, _DOWN = _powers(_BASE, STRETCH), _powers(pow(_BASE, -1, 1 << 64), STRETCH)


class Spaced:
    """The words of several texts in a row, as bytes with one space behind each word."""

    def __init__(self, texts: list[bytes | None]):
        raw = b"\n".join([*(x or b"" for x in texts), b""])
        word = np.frombuffer(raw.translate(_IN_WORD), bool)
        kept = word.copy()
        kept[1:] |= word[:-1]  # and the white space right behind a word
        begins = np.flatnonzero(word[1:] > word[:-1]) + 1
        if word[:1].any():
            begins = np.concatenate([[0], begins])
        edges = np.concatenate([[0], np.searchsorted(begins, np.cumsum([len(x or b"") + 1 for x in texts]))])
        #: Words of each text, and where among all words its own begin.
        self.sizes, self.first = np.diff(edges), edges[:-1]
        self.bytes = np.frombuffer(raw, np.uint8)[kept]
        #: Where each word ends, and where it starts.
        self.ends = np.flatnonzero(~word[kept])
        self.bytes[self.ends] = 0x20
        self.starts = np.concatenate([[0], self.ends[:-1] + 1])[: len(self.ends)]


def hashes_at(text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A hash of each word of a text, given as bytes with a space behind each word, and of the places where words start.

    Sums of bytes times powers, for all words of a stretch at once. Equal words have equal hashes; others
    can be made to collide, so a hash finds what is then compared.
    """
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + STRETCH)) - 1)  # its last word ends within the stretch
        begin, end = int(starts[i]), int(starts[j]) if j < len(starts) else len(text)
        up = _UP[: end - begin] if end - begin <= STRETCH else _powers(_BASE, end - begin)
        at = starts[i:j] - begin
        out[i:j] = np.add.reduceat(_VALUES[text[begin:end]] * up, at) * _DOWN[at]
        i = j
    return mix(out)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _SHIFT)) * _FIRST
    x = (x ^ (x >> _SHIFT)) * _SECOND
    return x ^ (x >> _SHIFT)


def runs(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """A hash of each run of k neighbouring items, in order; empty if there are fewer than k."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, np.uint64(seed), np.uint64)
    for j in range(k):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n])
    return out
