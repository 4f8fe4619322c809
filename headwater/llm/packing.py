"""Operator 5, packing by non-negative least squares.

A document of more than ``window`` ids gives full pieces of ``window`` ids and a remainder. The remainders'
lengths form a histogram (at most window - 1 bins, whatever the corpus). Shallow combinations of two to four
lengths that fill a window exactly are the columns of a matrix; non-negative least squares finds how often
to repeat each so that the histogram is used up as well as possible. The counts are rounded and trimmed to
what is there. What is left is packed greedily, whole: the longest remainder, then the longest that fit, as soon as
possible one or two that fill the window exactly. Only remainders for which this finds no full window are cut, at the
powers of two of their length, and the parts are laid out from large to small. A part of size 2^k then starts at a
multiple of 2^k, so none crosses the end of a window, and the last window parts into sequences whose lengths are powers
of two, which need no padding either.

Which sequence and place a piece gets follows by arithmetic from its length and its rank among the
remainders of that length; ranks are counted within partitions and offset by the counts of the partitions
before, so no bin gathers in a task. The ids themselves are needed once: all cut points a piece may get are
known when the text is encoded, and so are their checksums.

Cases: null and empty texts hold the end id only; texts are encoded whole; repeated rows are packed each
for itself; null doc_ids stay null; other columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import batch, cut

WINDOW = 2048
#: Columns of the least-squares problem at most, the ones with the most documents first; what they leave is packed greedily.
COLUMNS = 4096

_PLAIN = re.compile("[^\\x00-\\u024f]")


def _byte_chars() -> dict[str, int]:
    """The byte-level alphabet of such vocabularies: printable bytes stand for themselves, the others take
    the code points from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class JsonTokenizer:
    """Ids of a byte-level BPE file of ``tokenizers``. Texts of Latin script take a faster encoder over
    the same vocabulary and merge order; any other text, and every probe of the tests, goes to
    ``tokenizers`` itself. ``added``: as in its plain call, the names of added tokens in a text become those tokens;
    otherwise they are text like any other."""

    def __init__(self, content: str, pattern: str, added: bool = False):
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_str(content)
        self.slow.encode_special_tokens = not added
        of = _byte_chars()
        vocab = json.loads(content)["model"]["vocab"]
        special = {t["content"] for t in json.loads(content)["added_tokens"]}
        self.added = re.compile("|".join(map(re.escape, special))) if added and special else None
        ranks = {bytes(of[c] for c in token): i for token, i in vocab.items() if token not in special}
        self.fast = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, "<u4")
        if _PLAIN.search(text) or self.added and self.added.search(text):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4")
        return np.asarray(self.fast.encode_ordinary(text), "<u4")


_TOKENIZERS: dict[tuple[str, str, bool], JsonTokenizer] = {}


def json_tokenizer(path: str, pattern: str, spark, added: bool = False) -> Callable[[], JsonTokenizer]:
    """A function that gives a worker its tokenizer; the file (one vocabulary) is read on the driver."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    key = (hashlib.sha256(text.encode()).hexdigest(), pattern, added)
    content = spark.sparkContext.broadcast(text)

    def get() -> JsonTokenizer:
        if key not in _TOKENIZERS:
            _TOKENIZERS[key] = JsonTokenizer(content.value, pattern, added)
        return _TOKENIZERS[key]

    return get


def halves(length: int) -> list[int]:
    """The powers of two that make up ``length``, largest first."""
    return [1 << k for k in range(length.bit_length() - 1, -1, -1) if length >> k & 1]


def combinations(histogram: np.ndarray, window: int = WINDOW, columns: int = COLUMNS) -> list[tuple[int, ...]]:
    """Combinations of two, three and four lengths that fill the window, from lengths that occur. Pairs
    all come first; deeper ones by the smallest count among their lengths."""
    have = np.flatnonzero(histogram)
    have = have[have > 0]
    pairs = [(int(a), int(window - a)) for a in have if a <= window - a and histogram[window - a]]
    top = have[np.argsort(-histogram[have], kind="stable")][:256]
    deep: dict[tuple[int, ...], int] = {}
    for i, a in enumerate(top):
        c = window - a - top[i:]
        ok = c > 0
        b, c = top[i:][ok], c[ok]
        there = histogram[c] > 0
        for x, y in zip(b[there], c[there]):
            key = tuple(sorted((int(a), int(x), int(y))))
            deep[key] = int(min(histogram[list(key)]))
        if (rest := int(window - 2 * a)) > 1:  # twice one length, and two others
            c = rest - top
            ok = c > 0
            b, c = top[ok], c[ok]
            there = histogram[c] > 0
            for x, y in zip(b[there], c[there]):
                key = tuple(sorted((int(a), int(a), int(x), int(y))))
                deep[key] = int(min(histogram[list(key)]))
    best = sorted(deep, key=lambda k: (-deep[k], k))[: max(0, columns - len(pairs))]
    return (pairs + best)[:columns]


def nnls(columns: list[tuple[int, ...]], histogram: np.ndarray, sweeps: int = 30) -> np.ndarray:
    """Non-negative least squares by coordinate descent; a column counts how often each length occurs."""
    left = histogram.astype(float).copy()
    x = np.zeros(len(columns))
    parts = [np.unique(c, return_counts=True) for c in columns]
    for _ in range(sweeps):
        moved = 0.0
        for j, (at, n) in enumerate(parts):
            step = max(-x[j], float(left[at] @ n) / float(n @ n))
            if step:
                x[j] += step
                left[at] -= step * n
                moved = max(moved, abs(step))
        if moved < 0.01:
            break
    return x


def greedy(rest: np.ndarray, window: int = WINDOW) -> list[tuple[list[int], int]]:
    """Whole lengths that fill windows exactly, and how often: the longest one left with the longest that still fit, until
    one or two of those left fill the window. A length for which that comes to no end is left out."""
    left = rest.astype(np.int64).copy()
    out: list[tuple[list[int], int]] = []
    while (have := np.flatnonzero(left)).size:
        longest = int(have[-1])
        combination, space = [longest], window - longest
        left[longest] -= 1
        while space:
            if left[space] > 0:
                combination.append(space)
                left[space] -= 1
                break
            fit = np.flatnonzero(left[: space + 1])
            if not len(fit):
                break
            other = space - fit
            pair = fit[left[other] > (other == fit)]
            best = int(pair[-1] if len(pair) else fit[-1])
            combination.append(best)
            left[best] -= 1
            space -= best
        np.add.at(left, combination, 1)
        if sum(combination) == window:
            lengths, n = np.unique(combination, return_counts=True)
            times = int((left[lengths] // n).min())
            left[lengths] -= times * n
            out.append((combination, times))
        else:
            left[longest] = 0
    return out


class Layout:
    """From (length, rank) of a remainder to its pieces. Its size depends on window and columns only."""

    def __init__(self, histogram: np.ndarray, window: int = WINDOW, columns: int = COLUMNS):
        if window & (window - 1):
            raise ValueError("the window is a power of two")
        self.window = window
        cols = combinations(histogram, window, columns)
        x = nnls(cols, histogram) if cols else np.zeros(0)
        used = np.zeros(window, np.int64)
        rows: list[tuple[int, int, int, int, int]] = []  # length, first rank, first sequence, times, offset
        n = 0

        def lay(combination, wished: int) -> None:
            nonlocal n
            length, times = np.unique(combination, return_counts=True)
            count = min(wished, int(((histogram - used)[length] // times).min()))
            if count <= 0:
                return
            offset = 0
            for a, m in zip(length.tolist(), times.tolist()):
                rows.append((a, int(used[a]), n, m, offset))
                used[a] += m * count
                offset += a * m
            n += count

        for j in np.argsort(-x, kind="stable"):
            lay(cols[j], int(np.floor(x[j] + 0.5)))
        self.by_columns = int(used.sum())  # remainders that the columns place
        for combination, times in greedy(histogram - used, window):
            lay(combination, times)
        self.whole = int(used.sum())  # with those packed greedily
        rows.sort()
        table = np.array(rows, np.int64).reshape(-1, 5)
        self.key = table[:, 0] << 44 | table[:, 1]
        self.first, self.base, self.times, self.offset = (table[:, i] for i in range(1, 5))
        self.used = used
        rest = histogram - used
        bits = window.bit_length() - 1
        self.before = np.zeros((bits, window), np.int64)  # parts of size 2^k from shorter lengths
        self.start = np.zeros(bits, np.int64)  # where the parts of size 2^k begin
        at = 0
        for k in range(bits - 1, -1, -1):
            own = np.where(np.arange(window) >> k & 1, rest, 0)
            self.before[k] = np.cumsum(own) - own
            self.start[k] = at
            at += int(own.sum()) << k
        self.residual_base, self.residual_total = n, at
        self.tail = halves(at % window)
        self.full_base = n + at // window + len(self.tail)

    def place(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """(start, length, sequence, offset) of each part of a remainder."""
        if rank < self.used[length]:
            j = int(np.searchsorted(self.key, length << 44 | rank, "right")) - 1
            r = rank - int(self.first[j])
            m = int(self.times[j])
            return [(0, length, int(self.base[j]) + r // m, int(self.offset[j]) + r % m * length)]
        r, out, start = rank - int(self.used[length]), [], 0
        for part in halves(length):
            k = part.bit_length() - 1
            pos = int(self.start[k]) + (int(self.before[k][length]) + r) * part
            window, off = divmod(pos, self.window)
            seq = self.residual_base + window
            if window == self.residual_total // self.window:
                for block in self.tail:
                    if off < block:
                        break
                    off -= block
                    seq += 1
            out.append((start, part, seq, off))
            start += part
        return out


_DOC_DDL = "doc_id long, pid long, n long, full_before long, rem int, rank long, crcs array<long>"
_DOC = pa.schema([("doc_id", pa.int64()), ("pid", pa.int64()), ("n", pa.int64()), ("full_before", pa.int64()), ("rem", pa.int32()), ("rank", pa.int64()), ("crcs", pa.list_(pa.int64()))])
_PIECE_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_PIECE = pa.schema([(c.split()[0], pa.int64()) for c in _PIECE_DDL.split(", ")])


def measured(docs: DataFrame, tokenizer: Callable[[], JsonTokenizer], end_id: int, window: int = WINDOW) -> DataFrame:
    """Length, rank within the partition and checksums of every document, stored."""

    def run(batches):
        encode = tokenizer().encode
        pid, full_before, ranks = TaskContext.get().partitionId(), 0, [0] * window
        end = np.array([end_id], "<u4")
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = np.concatenate((encode(text.as_py()), end)).astype("<u4")
                raw = memoryview(ids.tobytes())
                full, rem = divmod(len(ids), window)
                crcs = [zlib.crc32(raw[4 * window * i : 4 * window * (i + 1)]) for i in range(full)]
                at = window * full
                if rem:
                    crcs.append(zlib.crc32(raw[4 * at :]))
                    for part in halves(rem):
                        crcs.append(zlib.crc32(raw[4 * at : 4 * (at + part)]))
                        at += part
                rows.append((doc_id, pid, len(ids), full_before, rem, ranks[rem], crcs))
                full_before += full
                ranks[rem] += 1
            yield batch(_DOC, *(zip(*rows) if rows else [[]] * 7))

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return cut(source.mapInArrow(run, _DOC_DDL))


def pack(docs: DataFrame, tokenizer: Callable[[], JsonTokenizer], end_id: int = 1, window: int = WINDOW, columns: int = COLUMNS) -> DataFrame:
    """The pieces of all documents, each with its sequence and place."""
    table = measured(docs, tokenizer, end_id, window)
    by_bin = table.groupBy("pid", "rem").agg(F.count("*").alias("k"))
    earlier = Window.partitionBy("rem").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_bin.withColumn("earlier", F.coalesce(F.sum("k").over(earlier), F.lit(0)))
    full = table.groupBy("pid").agg(F.sum(F.floor(F.col("n") / window)).cast("long").alias("f"))
    all_before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    full = full.withColumn("full_offset", F.coalesce(F.sum("f").over(all_before), F.lit(0)))
    histogram = np.zeros(window, np.int64)
    for r in by_bin.groupBy("rem").agg(F.sum("k").alias("k")).collect():  # window bins at most
        histogram[r["rem"]] = r["k"]
    histogram[0] = 0
    layout = docs.sparkSession.sparkContext.broadcast(Layout(histogram, window, columns))

    def run(batches):
        lay = layout.value
        for b in batches:
            rows = []
            for doc_id, n, full_at, rem, rank, crcs in zip(*(b.column(i).to_pylist() for i in range(6))):
                full = n // window
                for i in range(full):
                    rows.append((doc_id, i * window, window, crcs[i], n, lay.full_base + full_at + i, 0))
                if rem:
                    parts = lay.place(rem, rank)
                    sums = [crcs[full]] if parts[0][1] == rem else crcs[full + 1 :]
                    for (start, size, seq, off), crc in zip(parts, sums):
                        rows.append((doc_id, full * window + start, size, crc, n, seq, off))
            yield batch(_PIECE, *(zip(*rows) if rows else [[]] * 7))

    placed = table.join(offsets.drop("k"), ["pid", "rem"]).join(full.select("pid", "full_offset"), "pid")
    return placed.select("doc_id", "n", (F.col("full_offset") + F.col("full_before")).alias("full_at"), "rem", (F.col("earlier") + F.col("rank")).alias("rank"), "crcs").mapInArrow(run, _PIECE_DDL)
