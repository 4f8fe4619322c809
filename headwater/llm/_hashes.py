"""Rolling 64-bit hashes over words, vectorised over many documents at once."""

from __future__ import annotations

import numpy as np
import xxhash

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


class WordHashes(dict):
    """A bounded memo from word to its hash."""

    MOST = 500_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: Bytes that ``text_word_hashes`` works on at a time, but for a longer word.
_PIECE = 1 << 21
_WEIGHTS: list[np.ndarray] = []


def _weights(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base, and of its inverse, modulo 2^64."""
    if not _WEIGHTS or len(_WEIGHTS[0]) < n:
        _WEIGHTS[:] = [np.full(n, b, np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
        for w in _WEIGHTS:
            w[0] = 1
            np.cumprod(w, out=w)
    return _WEIGHTS[0], _WEIGHTS[1]


def text_word_hashes(text: bytes) -> np.ndarray:
    """A hash of each word of a text whose words, none of them empty, are parted by single spaces or line feeds: differences
    of a running polynomial over its bytes, many times faster than a look-up a word. For routing: equal words have equal
    hashes, and a crafted text may make different words collide."""
    out = []
    at = 0
    while at < len(text):
        stop = len(text)
        if stop - at > _PIECE:
            cuts = [x for x in (text.find(b" ", at + _PIECE), text.find(b"\n", at + _PIECE)) if x >= 0]
            stop = min(cuts, default=stop)
        raw = np.frombuffer(text, np.uint8, stop - at, at)
        n = len(raw)
        up, down = _weights(max(n, _PIECE))
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
        ends = np.concatenate((np.flatnonzero((raw == 32) | (raw == 10)), [n]))
        starts = np.concatenate(([0], ends[:-1] + 1))
        out.append(mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64)))
        at = stop + 1
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over all others."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def roll(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` entries, in about 2 log2 k passes."""
    if len(h) < k:
        return h[:0]
    done, size = None, 0
    power, width = h, 1
    while True:
        if k & width:
            if done is None:
                done, size = power, width
            else:  # the runs of `done` first, those of `power` after them
                n = len(h) - size - width + 1
                done = done[:n] * np.uint64(pow(_BASE, width, 1 << 64)) + power[size : size + n]
                size += width
        if size == k:
            return done
        n = len(h) - 2 * width + 1
        power = power[:n] * np.uint64(pow(_BASE, width, 1 << 64)) + power[width : width + n]
        width *= 2


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """Least of each run of ``w`` entries."""
    if len(h) < w:
        return h[:0]
    m, width = h, 1
    while 2 * width <= w:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    if width < w:
        d = w - width
        m = np.minimum(m[:-d], m[d:])
    return m
