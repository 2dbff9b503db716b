"""Vectorised word and line hashing over many texts at once (numpy)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_RNG = np.random.default_rng(20240131)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = np.uint64(0xD6E8FEB86659FD93)
_MIX = np.uint64(0xFF51AFD7ED558CCD)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that begin a code point.
IS_HEAD = (np.arange(256) & 0xC0) != 0x80

#: Bytes of text handled at once.
CHUNK_BYTES = 2 << 20


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX
    return x ^ (x >> np.uint64(29))


def chunked(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about ``limit`` bytes (a longer text is a run of its own), with the index of the first."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        if i > first and size + len(text) > limit:
            yield first, texts[first:i]
            first, size = i, 0
        size += len(text) + 1
    if first < len(texts):
        yield first, texts[first:]


class _Powers:
    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, CHUNK_BYTES + (1 << 16))
            up = np.full(size, _BASE, np.uint64)
            down = np.full(size, pow(_BASE, -1, 2**64), np.uint64)
            up[0] = down[0] = 1
            cls.up, cls.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return cls.up[:n], cls.down[:n]


class Texts:
    """The words and lines of a run of texts.

    ``starts`` and ``ends`` bound the words in ``buf``; ``first_word[i]`` is the
    number of words before text ``i``.  Each text is followed by one newline.
    """

    def __init__(self, texts: list[bytes]):
        self.n = len(texts)
        self.buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, self.n)
        self.bounds = np.concatenate([[0], np.cumsum(sizes)])
        space = IS_SPACE[self.buf]
        flips = np.flatnonzero(np.diff(np.concatenate([[True], space])))
        self.starts, self.ends = flips[0::2], flips[1::2]
        self.first_word = np.searchsorted(self.starts, self.bounds)
        self.n_words = np.diff(self.first_word)
        self.text_of_word = np.repeat(np.arange(self.n), self.n_words)
        self._space = space

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each slice ``buf[start:end]``: a rolling polynomial, then mixed."""
        if not hasattr(self, "_sums"):
            up, self._down = _Powers.of(len(self.buf))
            sums = np.empty(len(self.buf) + 1, np.uint64)
            sums[0] = 0
            np.cumsum(_BYTE[self.buf] * up, out=sums[1:])
            self._sums = sums
        span = (self._sums[ends] - self._sums[starts]) * self._down[np.minimum(starts, len(self.buf) - 1)]
        return mix(span + (ends - starts).astype(np.uint64))

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Sum over each text of a value for each byte of ``buf``."""
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return sums[self.bounds[1:]] - sums[self.bounds[:-1]]

    def per_text_words(self, values: np.ndarray) -> np.ndarray:
        """Sum over each text of a value for each word."""
        sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        return sums[self.first_word[1:]] - sums[self.first_word[:-1]]

    def heads(self) -> np.ndarray:
        """Code points before each byte."""
        return np.concatenate([[0], np.cumsum(IS_HEAD[self.buf], dtype=np.int64)])


def repeated(keys: np.ndarray) -> np.ndarray:
    """True for each key that occurs more than once."""
    out = np.zeros(len(keys), bool)
    if len(keys) > 1:
        order = np.argsort(keys)
        same = keys[order][1:] == keys[order][:-1]
        both = np.zeros(len(keys), bool)
        both[1:] |= same
        both[:-1] |= same
        out[order] = both
    return out


def salted(keys: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Keys told apart by the group (text) that they are in."""
    return mix(keys + group.astype(np.uint64) * _STEP)


def rolled(keys: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The rolling hash of n words moved on to n + 1 by one more word."""
    return keys * _STEP + word
