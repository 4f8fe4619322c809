"""A compressed full-text index over sequences of words: the BWT in a wavelet matrix, longest common prefixes in a byte
each, a sampled suffix array. Texts and suffix array are given up once the index stands. All steps work on whole arrays."""

from __future__ import annotations

import numpy as np

#: Longest common prefixes are kept up to here; longer ones count as this.
LCP_CAP = 63
#: Every so many positions of a text, and its first, have their place in the sampled suffix array.
SAMPLE = 32


class BitVector:
    """Packed bits with rank."""

    def __init__(self, bits: np.ndarray):
        packed = np.zeros((len(bits) // 64 + 1) * 8, np.uint8)
        raw = np.packbits(bits, bitorder="little")
        packed[: len(raw)] = raw
        self.words = packed.view(np.uint64)
        self.counts = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1])).astype(np.int32)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position ``i``."""
        low = (np.uint64(1) << (i & 63).view(np.uint64)) - np.uint64(1)
        at = i >> 6
        return self.counts[at] + np.bitwise_count(self.words[at] & low)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).view(np.uint64) & np.uint64(1)).astype(bool)

    @property
    def nbytes(self) -> int:
        return self.words.nbytes + self.counts.nbytes


class WaveletMatrix:
    """Rank and access over a sequence of symbols, one bit vector for each bit of the alphabet."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        self.bits = max(1, int(alphabet - 1).bit_length())
        self.levels: list[BitVector] = []
        self.zeros: list[int] = []
        cur = symbols.astype(np.int64)
        for level in range(self.bits):
            bit = (cur >> (self.bits - 1 - level) & 1).astype(bool)
            self.levels.append(BitVector(bit))
            self.zeros.append(int(len(cur) - bit.sum()))
            cur = np.concatenate((cur[~bit], cur[bit]))
        # where each symbol's block begins after the last level
        self.first = self._walk(np.arange(alphabet), np.zeros(alphabet, np.int64))

    def _walk(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level in range(self.bits):
            ones = self.levels[level].rank(i)
            i = np.where(c >> (self.bits - 1 - level) & 1, self.zeros[level] + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often ``c`` occurs before position ``i``."""
        return self._walk(c, i) - self.first[c]

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at ``i``, and how often each occurs before."""
        c = np.zeros(len(i), np.int64)
        for level in range(self.bits):
            bit = self.levels[level].get(i)
            ones = self.levels[level].rank(i)
            c = c << 1 | bit
            i = np.where(bit, self.zeros[level] + ones, i - ones)
        return c, i - self.first[c]


class SmallestBefore:
    """For small values: the nearest entry to the left, or to the right, that is less than a given one."""

    BLOCK = 32

    def __init__(self, values: np.ndarray):
        """``values``: bytes; zero at both ends."""
        self.n = len(values)
        pad = -self.n % self.BLOCK
        self.values = np.concatenate((values, np.zeros(pad, np.uint8)))
        level = self.values.reshape(-1, self.BLOCK).min(1)
        self.table = [level]
        while len(level) > 1:
            half = 1 << (len(self.table) - 1)
            level = np.minimum(level[:-half], level[half:]) if len(level) > half else level[:0]
            if not len(level):
                break
            self.table.append(level)

    def left(self, i: np.ndarray, q: np.ndarray) -> np.ndarray:
        """The greatest place up to ``i`` whose value is less than ``q`` (more than 0)."""
        return self._find(i, q, -1)

    def right(self, i: np.ndarray, q: np.ndarray) -> np.ndarray:
        """The least place from ``i`` on whose value is less than ``q``."""
        return self._find(i, q, 1)

    def _find(self, i: np.ndarray, q: np.ndarray, way: int) -> np.ndarray:
        out, ok = self._inside(i // self.BLOCK, i, q, way)
        rest = np.flatnonzero(~ok)
        if len(rest):
            block, limit = i[rest] // self.BLOCK + way, q[rest]
            for k in range(len(self.table) - 1, -1, -1):  # jump over blocks without such a value
                t, span = self.table[k], 1 << k
                at = block if way > 0 else block - span + 1
                there = (at >= 0) & (at < len(t))
                skip = there & (t[np.clip(at, 0, len(t) - 1)] >= limit)
                block = np.where(skip, block + way * span, block)
            edge = block * self.BLOCK + (0 if way > 0 else self.BLOCK - 1)
            out[rest] = self._inside(block, edge, limit, way)[0]
        return out

    def _inside(self, block: np.ndarray, i: np.ndarray, q: np.ndarray, way: int) -> tuple[np.ndarray, np.ndarray]:
        at = block[:, None] * self.BLOCK + np.arange(self.BLOCK)
        less = (self.values[at] < q[:, None]) & ((at >= i[:, None]) if way > 0 else (at <= i[:, None]))
        k = less.argmax(1) if way > 0 else self.BLOCK - 1 - less[:, ::-1].argmax(1)
        return block * self.BLOCK + k, less.any(1)

    @property
    def nbytes(self) -> int:
        return self.values.nbytes + sum(t.nbytes for t in self.table)


def suffix_array(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array by prefix doubling, and the common prefix of each suffix with the one before it in that order, up to
    ``LCP_CAP``. The last symbol occurs once."""
    n = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    ranks = [rank.astype(np.int32)]  # by the first 1, 2, 4, ... symbols
    k = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: max(0, n - k)] = rank[k:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        s = key[order]
        new = np.concatenate(([0], np.cumsum(s[1:] != s[:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = new
        k *= 2
        if k <= LCP_CAP // 2 + 1:
            ranks.append(rank.astype(np.int32))
        if new[-1] == n - 1:
            break
    a, b = order[:-1].copy(), order[1:].copy()
    common = np.zeros(n - 1, np.int64)
    for j in range(len(ranks) - 1, -1, -1):
        same = ranks[j][np.minimum(a, n - 1)] == ranks[j][np.minimum(b, n - 1)]
        same &= (a < n) & (b < n)
        common += same << j
        a, b = a + (same << j), b + (same << j)
    return order, np.concatenate(([0], common)).astype(np.uint8)


class FMIndex:
    """Over texts (arrays of word numbers from 1), each closed by a separator of its own."""

    def __init__(self, texts: list[np.ndarray]):
        lengths = np.array([len(t) for t in texts], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1])).astype(np.int64) if texts else np.zeros(0, np.int64)
        self.size = int((lengths + 1).sum())
        word = np.zeros(self.size, np.int64)  # 0: separator
        for s, t in zip(self.starts.tolist(), texts):
            word[s : s + len(t)] = t
        self.alphabet = int(word.max(initial=0)) + 1
        self.c = np.concatenate(([0], np.cumsum(np.bincount(word, minlength=self.alphabet)))) if self.size else np.zeros(2, np.int64)
        if not self.size:
            return
        separators = np.flatnonzero(word == 0)
        unique = word + len(separators)
        unique[separators] = np.arange(len(separators))
        order, common = suffix_array(unique)
        self.bwt = WaveletMatrix(word[order - 1], self.alphabet)  # before position 0: the last separator
        self.lcp = SmallestBefore(np.concatenate((common, np.zeros(1, np.uint8))))
        position = order - self.starts[np.searchsorted(self.starts, order, "right") - 1]
        sampled = position % SAMPLE == 0
        self.sampled = BitVector(sampled)
        self.samples = order[sampled].astype(np.int32)

    @property
    def nbytes(self) -> int:
        """What the index holds."""
        return sum(v.nbytes for v in self.bwt.levels) + self.bwt.first.nbytes + self.lcp.nbytes + self.sampled.nbytes + self.samples.nbytes + self.c.nbytes + self.starts.nbytes

    def extend(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the matches with one more word in front."""
        both = self.c[c] + self.bwt.rank(np.concatenate((c, c)), np.concatenate((lo, hi))).reshape(2, -1)
        return both[0], both[1]

    def shorten(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The next greater intervals and the lengths of their matches: words are dropped at the end."""
        q = np.maximum(self.lcp.values[lo], self.lcp.values[hi])
        some = q > 0
        a, b = np.zeros(len(lo), np.int64), np.full(len(lo), self.size, np.int64)
        a[some], b[some] = self.lcp.left(lo[some], q[some]), self.lcp.right(hi[some], q[some])
        return a, b, q.astype(np.int64)

    def locate(self, i: np.ndarray) -> np.ndarray:
        """Where the suffixes at places ``i`` of the suffix array begin: steps to the left up to a sampled one."""
        i = i.copy()
        out, steps = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
        live = np.arange(len(i))
        while len(live):
            there = self.sampled.get(i[live])
            at = live[there]
            out[at] = self.samples[self.sampled.rank(i[at])] + steps[at]
            live = live[~there]
            if len(live):
                c, before = self.bwt.access(i[live])
                i[live] = self.c[c] + before
                steps[live] += 1
        return out

    def text_of(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, position, "right") - 1

    def matching_statistics(self, texts: list[np.ndarray]):
        """Backward search of all texts at once, from their ends. Yields (numbers of the texts, position, length of the
        longest match that begins there, start of its suffix array interval) for each step. Where the word in front
        doesn't match, words are dropped at the end of the match until it does. Lengths over ``LCP_CAP`` may come out
        less than they are, but not under ``LCP_CAP``."""
        length = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-length, kind="stable")
        flat = np.concatenate([texts[i] for i in order]) if len(texts) else np.zeros(0, np.int64)
        size = length[order]
        begin = np.cumsum(size) - size
        lo, hi = np.zeros(len(order), np.int64), np.full(len(order), self.size, np.int64)
        matched = np.zeros(len(order), np.int64)
        for step in range(int(size.max(initial=0))):
            live = int(np.searchsorted(-size, -step, "left"))  # texts longer than `step`
            c = flat[begin[:live] + size[:live] - 1 - step]
            known = (c > 0) & (c < self.alphabet)
            c = np.where(known, c, 0)
            known &= self.c[c + 1] > self.c[c]
            lo[:live][~known], hi[:live][~known], matched[:live][~known] = 0, self.size, 0
            open_ = np.flatnonzero(known)
            while len(open_):
                a, b = self.extend(c[open_], lo[open_], hi[open_])
                hit = b > a
                at = open_[hit]
                lo[at], hi[at] = a[hit], b[hit]
                matched[at] += 1
                open_ = open_[~hit]
                if len(open_):
                    lo[open_], hi[open_], matched[open_] = self.shorten(lo[open_], hi[open_])
            yield order[:live], size[:live] - 1 - step, matched[:live].copy(), lo[:live].copy()
